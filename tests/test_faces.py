"""Faces with known eyes and heads."""

import math

import pytest

from sightline.operators import faces
from sightline.schemas import Gaze


def mesh(h=0.0, v=0.0):
    """Eyes 0.1 wide and 0.04 high, 0.25 apart; the iris is off its centre by h and v of half the eye."""
    lm = [0.0] * (478 * 3)

    def put(i, x, y):
        lm[3 * i], lm[3 * i + 1] = x, y

    for eye, cx in ((faces.RIGHT, 0.375), (faces.LEFT, 0.625)):
        put(eye["inner"], cx + 0.05, 0.4)
        put(eye["outer"], cx - 0.05, 0.4)
        put(eye["top"], cx, 0.38)
        put(eye["bottom"], cx, 0.42)
        for i in eye["iris"]:
            put(i, cx + h * 0.05, 0.4 - v * 0.02)
    return lm


def face(spark, lm, pose=(0.0, 0.0, 0.0), jaw=None):
    return spark.createDataFrame([(0, 0, 0.0, "p", lm, pose, jaw, 0.9)], "recording_id bigint, obs_no bigint, ts double, person_id string, lm array<float>, head_pose struct<yaw:double,pitch:double,roll:double>, jaw double, detection double")


@pytest.mark.parametrize("h, v", [(0.0, 0.0), (0.5, 0.0), (-0.4, 0.6), (3.0, -3.0)])
def test_geometric(spark, h, v):
    r = faces.geometric(face(spark, mesh(h, v), (0.1, -0.05, 0.0))).first()
    p = Gaze()
    assert r.yaw == pytest.approx(0.1 + max(-1, min(1, h)) * p.yaw_gain, abs=1e-5) and r.pitch == pytest.approx(-0.05 + max(-1, min(1, v)) * p.pitch_gain, abs=1e-5)
    assert r.quality.size == pytest.approx(1.0, abs=1e-5) and r.quality.openness == pytest.approx(1.0, abs=1e-5)
    assert r.confidence == pytest.approx(0.9 * (1 - 0.1 / (math.pi / 2)), abs=1e-5)


def test_five_point(spark):
    det = [10.0, 10.0, 100.0, 120.0, 40.0, 50.0, 80.0, 50.0, 60.0, 72.0, 45.0, 90.0, 75.0, 90.0, 0.8]
    df = spark.createDataFrame([(0, 0, 0.0, "p", det, 160, 120)], "recording_id bigint, obs_no bigint, ts double, person_id string, det array<float>, width int, height int")
    r = faces.five_point(df).first()
    assert (r.yaw, r.pitch, r.head_pose.roll) == pytest.approx((0.0, -0.16, 0.0)) and r.quality.size == pytest.approx(1.0) and r.quality.detection == pytest.approx(0.8)
    det[8] = 80.0
    assert faces.five_point(df.sparkSession.createDataFrame([(0, 0, 0.0, "p", det, 160, 120)], df.schema)).first().yaw == pytest.approx(0.5 * 0.45)


def test_mouth(spark):
    lm = mesh()
    assert faces.mouth_open(face(spark, lm)).first().mouth_open is None
    assert faces.mouth_open(face(spark, lm, jaw=0.4)).first().mouth_open == 0.4
    for k, y in (("top", 0.7), ("bottom", 0.75)):
        lm[3 * faces.MOUTH[k]], lm[3 * faces.MOUTH[k] + 1] = 0.5, y
    assert faces.mouth_open(face(spark, lm)).first().mouth_open == pytest.approx(0.2, abs=1e-5)
