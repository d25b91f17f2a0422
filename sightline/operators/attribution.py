"""Who or what a fixation looked at, and who was never seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from .layouts import active, in_order, participants


def verdict(regions: Column, x: Column, y: Column, confidence: Column, viewer: Column, floor: float = 0.15) -> Column:
    """Struct of target, confidence, reason, margin_ratio: of a point against rectangles, without a join."""
    hits = F.filter(regions, lambda r: G.contains(r, x, y))
    hit = F.get(hits, F.lit(0))
    target = F.coalesce(hit.participant_id, hit.kind)
    ratio = G.clamp(G.edge_distance(hit, x, y) / (F.least(hit.width, hit.height) / 2.0), 0.0, 1.0)
    sure = confidence * ratio

    def say(t: Column, c: Column, reason: Column, margin: Column) -> Column:
        return F.struct(t.alias("target"), c.alias("confidence"), reason.alias("reason"), margin.cast("double").alias("margin_ratio"))

    none = F.lit(None)
    return (
        F.when(F.size(hits) == 0, say(F.lit("unknown"), confidence, F.lit("no region"), none))
        .when(F.size(hits) > 1, say(F.lit("unknown"), confidence, F.lit("ambiguous overlap"), none))
        .when(sure < floor, say(F.lit("low_confidence"), sure, F.concat(F.lit("near border: "), target), ratio))
        .otherwise(say(target, sure, F.when(target == viewer, F.lit("self")).otherwise(F.lit("center hit")), ratio))
    )


def sentinel(target: str, confidence: float = 1.0) -> Column:
    """The verdict of an outcome that needs no layout."""
    return F.struct(F.lit(target).alias("target"), F.lit(confidence).alias("confidence"), F.lit(target).alias("reason"), F.lit(None).cast("double").alias("margin_ratio"))


def attribute_fixations(fixations: DataFrame, layouts: DataFrame, per_viewer: bool = False, floor: float = 0.15) -> DataFrame:
    """Fixations judged by the layout that is active at their start; without one they go.

    per_viewer: layouts are a viewer's own (a manifest); else a recording's, which every viewer is assumed to have seen.
    """
    by = ["recording_id", "viewer_id"] if per_viewer else ["recording_id"]
    rows = fixations.withColumnRenamed("person_id", "viewer_id").join(in_order(layouts, by), by)
    rows = rows.withColumn("l", active(F.col("layouts"), F.col("start_time"))).filter("l is not null")
    v = verdict(F.col("l.regions"), F.col("x"), F.col("y"), F.col("confidence"), F.col("viewer_id"), floor)
    source = F.col("l.source") if per_viewer else F.lit("assumed_shared")
    return rows.withColumn("v", v).select("recording_id", "viewer_id", "start_time", "end_time", "v.target", "v.confidence", "v.reason", "v.margin_ratio", source.alias("layout_source"))


def not_visible(layouts: DataFrame, events: DataFrame, directions: DataFrame, own_source: bool = False) -> DataFrame:
    """A window for each participant of a layout who has no event in it; open layouts end with the recording's directions.

    own_source: windows carry the layout's source (with a manifest); else assumed_shared.
    """
    horizon = directions.groupBy("recording_id").agg(F.max("ts").alias("horizon"))
    rows = layouts.join(horizon, "recording_id", "left").withColumn("end_time", F.coalesce("end_time", "horizon", F.lit(0.0))).filter("end_time > start_time")
    who = rows.select("recording_id", "layout_no", "start_time", "end_time", "source", F.explode(F.transform(participants(F.col("regions")), lambda r: r.participant_id)).alias("viewer_id"))
    seen = events.select(F.col("recording_id").alias("r"), F.col("viewer_id").alias("v"), F.col("start_time").alias("s"), F.col("end_time").alias("e"))
    gone = who.join(seen, (F.col("recording_id") == F.col("r")) & (F.col("viewer_id") == F.col("v")) & (F.col("e") > F.col("start_time")) & (F.col("s") < F.col("end_time")), "left_anti")
    return gone.select(
        "recording_id", "viewer_id", F.lit("not_visible").alias("target"), "start_time", "end_time", F.lit(1.0).alias("confidence"),
        (F.col("source") if own_source else F.lit("assumed_shared")).alias("layout_source"), F.lit("no usable observation").alias("reason"),
    )
