"""Per-viewer calibration from weak labels: people tend to look at who speaks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..schemas import Screen
from .layouts import in_order
from .ranges import first_holding

EPS = 1e-9


def weak_labels(directions: DataFrame, segments: DataFrame, layouts: DataFrame) -> DataFrame:
    """recording_id, viewer_id, obs_no, ts, yaw, pitch, x, y: directions at moments when another participant with a tile speaks.

    The first segment, by number, that holds the moment counts; tiles are those of the viewer's first layout, the last one of a name.
    """
    first = in_order(layouts, ["recording_id"]).select("recording_id", F.get("layouts", F.lit(0))["regions"].alias("regions"))
    at = directions.select("recording_id", F.col("person_id").alias("viewer_id"), "obs_no", "ts", "yaw", "pitch")
    spoke = first_holding(at, "ts", segments, ["recording_id"], "segment_no", "start_time", "end_time", ["participant_id"], "said")
    rows = spoke.withColumn("speaker", F.col("said.participant_id")).filter("speaker <> viewer_id").join(first, "recording_id")
    mine = F.filter("regions", lambda r: r.participant_id == F.col("speaker"))
    rows = rows.withColumn("t", F.try_element_at(mine, F.lit(-1))).filter("t is not null").withColumn("c", G.centre(F.col("t")))
    return rows.select("recording_id", "viewer_id", "obs_no", "ts", "yaw", "pitch", "c.x", "c.y")


def fit_ransac(x: np.ndarray, y: np.ndarray, threshold: float, iterations: int = 200, seed: int = 0) -> tuple[float, float]:
    """Slope and intercept by least squares over the largest set of inliers that lines through two points find."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    if len(x) != len(y):
        raise ValueError("x and y differ in length")
    if len(x) < 2:
        raise ValueError("a line takes two points")
    if np.ptp(x) < EPS:
        raise ValueError("x doesn't vary")
    rng, most, chosen = np.random.default_rng(seed), -1, np.ones(len(x), bool)
    for _ in range(iterations):
        a, b = rng.choice(len(x), size=2, replace=False)
        run = x[b] - x[a]
        if abs(run) < EPS:
            continue
        m = (y[b] - y[a]) / run
        near = np.abs(y - (m * x + (y[a] - m * x[a]))) <= threshold
        if near.sum() > most:
            most, chosen = int(near.sum()), near
    if most < 2:
        chosen = np.ones(len(x), bool)
    m, c = np.polyfit(x[chosen], y[chosen], 1)
    return float(m), float(c)


def calibrate(yaw: np.ndarray, pitch: np.ndarray, x: np.ndarray, y: np.ndarray, threshold: float = 0.05) -> Screen:
    """Angles at which the fitted lines meet the screen's edges."""
    mx, cx = fit_ransac(yaw, x, threshold)
    my, cy = fit_ransac(pitch, y, threshold)
    if mx <= EPS:
        raise ValueError("x must grow with yaw")
    if my >= -EPS:
        raise ValueError("y must fall with pitch")
    return Screen(left=-cx / mx, right=(1 - cx) / mx, top=-cy / my, bottom=(1 - cy) / my)


def calibrations(labels: DataFrame, viewers: DataFrame, least: int = 20, segments: DataFrame | None = None, layouts: DataFrame | None = None) -> DataFrame:
    """One row for each viewer: calibrated, labels, reason and the edges, null where the prior stays."""
    schema = "recording_id bigint, viewer_id string, calibrated boolean, labels bigint, reason string, left double, right double, top double, bottom double"
    known = viewers.select("recording_id", "viewer_id").distinct()
    yes = F.lit(True)
    for name, table in (("has_layout", layouts), ("has_speech", segments)):
        known = known.withColumn(name, yes) if table is None else known.join(table.select("recording_id", yes.alias(name)).distinct(), "recording_id", "left")
    rows = known.join(labels.select("recording_id", "viewer_id", "obs_no", "ts", "yaw", "pitch", "x", "y"), ["recording_id", "viewer_id"], "left")

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf_l = pdf[pdf["yaw"].notna()].sort_values(["ts", "obs_no"])
        n, made, reason = len(pdf_l), None, "fit from speaker cues"
        if pd.isna(pdf["has_layout"].iloc[0]):
            reason, n = "no layout", 0
        elif pd.isna(pdf["has_speech"].iloc[0]):
            reason, n = "no speaker segments", 0
        elif n < least:
            reason = "too few weak labels"
        else:
            try:
                made = calibrate(*(pdf_l[k].to_numpy() for k in ("yaw", "pitch", "x", "y")))
            except ValueError as e:
                reason = str(e)
        edges = [[made.left, made.right, made.top, made.bottom] if made else [None] * 4][0]
        return pd.DataFrame(
            [[*key, made is not None, n, reason, *edges]],
            columns=["recording_id", "viewer_id", "calibrated", "labels", "reason", "left", "right", "top", "bottom"],
        ).astype({k: float for k in ("left", "right", "top", "bottom")})

    return rows.groupBy("recording_id", "viewer_id").applyInPandas(work, schema)


def least_squares(labels: DataFrame) -> DataFrame:
    """The plain fit of each viewer's labels, in SQL aggregates alone."""
    return labels.groupBy("recording_id", "viewer_id").agg(
        F.count("*").alias("labels"), F.regr_slope("x", "yaw").alias("x_slope"), F.regr_intercept("x", "yaw").alias("x_intercept"),
        F.regr_slope("y", "pitch").alias("y_slope"), F.regr_intercept("y", "pitch").alias("y_intercept")
    )


def project_calibrated(directions: DataFrame, fits: DataFrame, screen: Screen = Screen()) -> DataFrame:
    """Projection with each viewer's own edges where there are some."""
    own = fits.filter("calibrated").select("recording_id", F.col("viewer_id").alias("person_id"), "left", "right", "top", "bottom")
    d = directions.join(own, ["recording_id", "person_id"], "left").withColumns(
        {k: F.coalesce(F.col(k), F.lit(v)) for k, v in (("left", screen.left), ("right", screen.right), ("top", screen.top), ("bottom", screen.bottom))}
    )
    d = d.withColumns({"_x": (F.col("yaw") - F.col("left")) / (F.col("right") - F.col("left")), "_y": (F.col("top") - F.col("pitch")) / (F.col("top") - F.col("bottom"))})
    d = d.withColumn("off_screen", G.off_screen(F.col("_x"), F.col("_y"), screen.margin)).withColumns({"x": G.clamp(F.col("_x"), 0.0, 1.0), "y": G.clamp(F.col("_y"), 0.0, 1.0)})
    return d.drop("_x", "_y", "left", "right", "top", "bottom")
