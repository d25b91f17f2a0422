"""Scalar semantics as Column expressions: poses, eyes, quality, projection, rectangles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import FACTORS, Gaze, Screen

EPS = 1e-6


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def unit(x: Column) -> Column:
    return finite(x) & x.between(0.0, 1.0)


def head_pose(m: Column) -> Column:
    """Yaw, pitch and roll of a rotation: a row-major array of 9, whose third and second columns are forward and up."""
    at = lambda r, c: F.get(m, F.lit(3 * r + c))
    fx, fy, fz, ux, uy = at(0, 2), at(1, 2), at(2, 2), at(0, 1), at(1, 1)
    return F.struct(F.atan2(fx, fz).alias("yaw"), F.atan2(-fy, F.hypot(fx, fz)).alias("pitch"), F.atan2(-ux, uy).alias("roll"))


def iris_centre(points: Column) -> Column:
    """Mean of an array of (x, y)."""
    n = F.size(points)
    total = lambda f: F.aggregate(points, F.lit(0.0), lambda s, p: s + p[f]) / n
    return F.struct(total("x").alias("x"), total("y").alias("y"))


def eye(inner: Column, outer: Column, top: Column, bottom: Column, iris: Column) -> Column:
    """One eye's (h, v, openness); points are structs (x, y)."""
    half_w, half_h = F.abs(outer.x - inner.x) / 2.0, F.abs(bottom.y - top.y) / 2.0
    h = F.when(half_w > EPS, (iris.x - (inner.x + outer.x) / 2.0) / half_w).otherwise(0.0)
    v = F.when(half_h > EPS, ((top.y + bottom.y) / 2.0 - iris.y) / half_h).otherwise(0.0)
    open_ = F.when(half_w > EPS, (2.0 * half_h) / (2.0 * half_w)).otherwise(0.0)
    return F.struct(clamp(h, -1.0, 1.0).alias("h"), clamp(v, -1.0, 1.0).alias("v"), open_.alias("openness"))


def both_eyes(a: Column, b: Column) -> Column:
    return F.struct(*[((a[k] + b[k]) / 2.0).alias(k) for k in ("h", "v", "openness")])


def quality(detection: Column, iod: Column, openness: Column, yaw: Column, pitch: Column, p: Gaze = Gaze()) -> Column:
    span = max(p.full_openness - p.min_openness, EPS)
    extreme = F.greatest(F.abs(yaw), F.abs(pitch))
    return F.struct(
        clamp(detection, 0.0, 1.0).alias("detection"),
        clamp(iod / p.reference_iod, 0.0, 1.0).alias("size"),
        clamp((openness - p.min_openness) / span, 0.0, 1.0).alias("openness"),
        clamp(1.0 - extreme / (math.pi / 2.0), 0.0, 1.0).alias("head"),
    )


def combined(q: Column) -> Column:
    return q.detection * q.size * q.openness * q.head


def limiting(q: Column) -> Column:
    """The least factor's name; the first one where factors tie."""
    return F.array_min(F.array(*[F.struct(q[f].alias("v"), F.lit(i).alias("i"), F.lit(f).alias("name")) for i, f in enumerate(FACTORS)]))["name"]


def gaze_angles(yaw: Column, pitch: Column, h: Column, v: Column, p: Gaze = Gaze()) -> tuple[Column, Column]:
    return yaw + p.yaw_sign * h * p.yaw_gain, pitch + p.pitch_sign * v * p.pitch_gain


def frontal_pose(nose_x: Column, nose_y: Column, eye_mid_x: Column, eye_mid_y: Column, eye_gap: Column, roll: Column) -> Column:
    """Head pose from a five-point face: fixed gains 0.45 and 0.35, a frontal nose drop of 0.55 and a resting pitch of -0.16."""
    horizontal, vertical = (nose_x - eye_mid_x) / eye_gap, (nose_y - eye_mid_y) / eye_gap - 0.55
    return F.struct(clamp(horizontal * 0.45, -0.35, 0.35).alias("yaw"), clamp(-0.16 - vertical * 0.35, -0.40, 0.05).alias("pitch"), roll.alias("roll"))


def mouth_open(jaw: Column, top: Column, bottom: Column, left: Column, right: Column, iod: Column) -> Column:
    """The jaw coefficient, else the lip gap, else the distance of the mouth's corners, in eye distances; null where none can be told."""
    there = lambda p: (F.abs(p.x) > EPS) | (F.abs(p.y) > EPS)
    scaled = F.when(iod > EPS, F.when(there(top) & there(bottom), F.abs(bottom.y - top.y) / iod).when(there(left) & there(right), F.hypot(right.x - left.x, right.y - left.y) / iod))
    return F.coalesce(jaw, scaled)


def screen_x(yaw: Column, s: Screen = Screen()) -> Column:
    return (yaw - s.left) / (s.right - s.left)


def screen_y(pitch: Column, s: Screen = Screen()) -> Column:
    return (s.top - pitch) / (s.top - s.bottom)


def off_screen(x: Column, y: Column, margin: float = Screen.margin) -> Column:
    return ~(x.between(-margin, 1.0 + margin) & y.between(-margin, 1.0 + margin))


def contains(r: Column, x: Column, y: Column) -> Column:
    """Closed on all four edges."""
    return x.between(r.x, r.x + r.width) & y.between(r.y, r.y + r.height)


def edge_distance(r: Column, x: Column, y: Column) -> Column:
    return F.least(x - r.x, r.x + r.width - x, y - r.y, r.y + r.height - y)


def centre(r: Column) -> Column:
    return F.struct((r.x + r.width / 2.0).alias("x"), (r.y + r.height / 2.0).alias("y"))


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where rectangles only touch."""
    w = F.least(a.x + a.width, b.x + b.width) - F.greatest(a.x, b.x)
    h = F.least(a.y + a.height, b.y + b.height) - F.greatest(a.y, b.y)
    both = w * h
    return F.when((w > 0) & (h > 0), both / (a.width * a.height + b.width * b.height - both)).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def signature(tiles: Column) -> Column:
    """What an arrangement is, whatever the order of its tiles: kinds and places in fiftieths, rounded half to even."""
    cell = lambda v: F.rint(v * 50.0).cast("int")
    return F.array_sort(F.transform(tiles, lambda t: F.struct(t.kind.alias("kind"), cell(t.x).alias("x"), cell(t.y).alias("y"), cell(t.width).alias("w"), cell(t.height).alias("h"))))
