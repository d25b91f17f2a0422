"""From faces to gaze directions. Models only find points; everything after that is Column expressions.

A face row has recording_id, obs_no, ts, person_id and, from a landmark model: lm array<float> (x, y, z of each point in turn, 0 to 1 in the
crop), head_pose, jaw (null where unknown), detection. From a five-point detector: det array<float> (box, five points, score) with the
crop's width and height in pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..schemas import Gaze

# Numbers of landmarks in the public 478-point face mesh.
RIGHT = {"inner": 133, "outer": 33, "top": 159, "bottom": 145, "iris": (468, 469, 470, 471, 472)}
LEFT = {"inner": 362, "outer": 263, "top": 386, "bottom": 374, "iris": (473, 474, 475, 476, 477)}
MOUTH = {"top": 13, "bottom": 14, "left": 61, "right": 291}
#: Height of an eye as a share of its width that a five-point detector's faces are given, as it doesn't see lids.
ASPECT = 0.45

FIVE_POINTS = "recording_id bigint, ts double, person_id string, hit boolean, det array<float>, width int, height int"
LANDMARKS = "recording_id bigint, ts double, person_id string, hit boolean, lm array<float>, head_pose struct<yaw:double,pitch:double,roll:double>, jaw double, detection double"


def point(lm: Column, i: int) -> Column:
    return F.struct(F.get(lm, F.lit(3 * i)).cast("double").alias("x"), F.get(lm, F.lit(3 * i + 1)).cast("double").alias("y"))


def iris(lm: Column, eye: dict) -> Column:
    return G.iris_centre(F.array(*[point(lm, i) for i in eye["iris"]]))


def offsets(lm: Column) -> Column:
    """h, v and openness, averaged over both eyes."""
    return G.both_eyes(*[G.eye(*[point(lm, e[k]) for k in ("inner", "outer", "top", "bottom")], iris(lm, e)) for e in (RIGHT, LEFT)])


def eye_distance(lm: Column) -> Column:
    a, b = iris(lm, RIGHT), iris(lm, LEFT)
    return F.hypot(a.x - b.x, a.y - b.y)


def _directions(df: DataFrame, pose: Column, h: Column, v: Column, openness: Column, iod: Column, detection: Column, p: Gaze) -> DataFrame:
    df = df.withColumns({"head_pose": pose, "_h": h, "_v": v}).withColumn("quality", G.quality(detection, iod, openness, F.col("head_pose.yaw"), F.col("head_pose.pitch"), p))
    yaw, pitch = G.gaze_angles(F.col("head_pose.yaw"), F.col("head_pose.pitch"), F.col("_h"), F.col("_v"), p)
    return df.select("recording_id", "obs_no", "ts", "person_id", yaw.alias("yaw"), pitch.alias("pitch"), "head_pose", G.combined(F.col("quality")).alias("confidence"), "quality")


def geometric(faces: DataFrame, p: Gaze = Gaze()) -> DataFrame:
    """Directions from landmarks: the head's angles, and the eyes' offsets scaled to angles."""
    df = faces.withColumn("_o", offsets(F.col("lm")))
    return _directions(df, F.col("head_pose"), F.col("_o.h"), F.col("_o.v"), F.col("_o.openness"), eye_distance(F.col("lm")), F.col("detection"), p)


def five_point(faces: DataFrame, p: Gaze = Gaze()) -> DataFrame:
    """Directions from five points: the head's alone. Such a detector has no iris, and the eyes count as open and centred."""
    at = lambda i: F.get("det", F.lit(i)).cast("double")
    rx, ry, lx, ly = at(4), at(5), at(6), at(7)
    gap = F.greatest(F.abs(lx - rx), F.lit(1.0))
    roll = F.atan2(ly - ry, F.greatest(lx - rx, F.lit(1.0)))
    pose = G.frontal_pose(at(8), at(9), (rx + lx) / 2.0, (ry + ly) / 2.0, gap, roll)
    iod = F.hypot((lx - rx) / F.col("width"), (ly - ry) / F.col("height"))
    zero = F.lit(0.0)
    return _directions(faces, pose, zero, zero, ASPECT * F.col("width") / F.col("height"), iod, at(14), p)


def mouth_open(faces: DataFrame) -> DataFrame:
    """faces with mouth_open: null where nothing tells."""
    lm = F.col("lm")
    return faces.withColumn("mouth_open", G.mouth_open(F.col("jaw"), *[point(lm, MOUTH[k]) for k in ("top", "bottom", "left", "right")], eye_distance(lm)))
