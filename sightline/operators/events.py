"""Runs of equal labels in time: gaze events and speaker segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def islands(rows: DataFrame, by: list[str], label: str, gap: float, order: list[str]) -> DataFrame:
    """rows with island: a number for each run of one label whose parts follow within gap seconds of the run's end so far."""
    w = Window.partitionBy(*by).orderBy("start_time", *order)
    changed = F.coalesce((F.col(label) != F.lag(label).over(w)).cast("int"), F.lit(1))
    rows = rows.withColumn("_run", changed).withColumn("_run", F.sum("_run").over(w)).withColumn("_pos", F.row_number().over(w))
    inside = Window.partitionBy(*by, "_run").orderBy("_pos")
    upto = F.max("end_time").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    split = F.coalesce((F.col("start_time") - upto > gap).cast("int"), F.lit(0))
    return rows.withColumn("_split", split).withColumn("_split", F.sum("_split").over(inside)).withColumn("island", F.struct("_run", "_split"))


def _weight():
    return F.greatest(F.col("end_time") - F.col("start_time"), F.lit(1e-9))


def gaze_events(attributions: DataFrame, least: float = 0.2, gap: float = 0.3) -> DataFrame:
    """Attributions of each viewer merged into events; short ones go afterwards, and their neighbours stay apart."""
    by = ["recording_id", "viewer_id"]
    rows = islands(attributions, by, "target", gap, ["end_time", "reason", "confidence", "target"]).withColumn("_w", _weight())
    # sums in the order of time, whatever the reasons are: a confidence meets edges unrounded
    upto = Window.partitionBy(*by, "_run", "_split").orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_sums", F.struct(F.sum("_w").over(upto).alias("w"), F.sum(F.col("_w") * F.col("confidence")).over(upto).alias("wc")))
    reasons = rows.groupBy(*by, "island", "reason").agg(
        F.sum("_w").alias("w"), F.max(F.struct("_pos", "_sums")).alias("upto"), F.min("start_time").alias("start_time"),
        F.max("end_time").alias("end_time"), F.first("target").alias("target"), F.min("_pos").alias("pos"),
        F.min_by("layout_source", "_pos").alias("layout_source")
    )
    merged = reasons.groupBy(*by, "island").agg(
        F.first("target").alias("target"), F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.max("upto").alias("upto"),
        F.min_by("layout_source", "pos").alias("layout_source"), F.max_by("reason", F.struct(F.col("w"), -F.col("pos"))).alias("reason"),
    )
    confidence = F.col("upto._sums.wc") / F.col("upto._sums.w")
    kept = merged.filter(F.col("end_time") - F.col("start_time") >= least)
    return kept.select(*by, "target", "start_time", "end_time", confidence.alias("confidence"), "layout_source", "reason")


def speaker_segments(flags: DataFrame, cue: str = "highlight", least: float = 0.4, gap: float = 0.5) -> DataFrame:
    """Moments at which a participant seemed to speak, merged; segment_no orders a recording's segments."""
    rows = islands(flags, ["recording_id"], "participant_id", gap, ["end_time", "participant_id", "confidence"]).withColumn("_w", _weight())
    merged = rows.groupBy("recording_id", "island").agg(
        F.first("participant_id").alias("participant_id"), F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"),
        (F.sum(F.col("_w") * F.col("confidence")) / F.sum("_w")).alias("confidence"),
    )
    w = Window.partitionBy("recording_id").orderBy("island")
    kept = merged.filter(F.col("end_time") - F.col("start_time") >= least)
    return kept.withColumn("segment_no", F.row_number().over(w).cast("long")).withColumn("cue", F.lit(cue)).drop("island")


def numbered(events: DataFrame) -> DataFrame:
    """event_no: viewers by name, then time; it decides which of several events is met first."""
    w = Window.partitionBy("recording_id").orderBy((F.col("target") == "not_visible").cast("int"), "viewer_id", "start_time", "end_time", "target")
    return events.withColumn("event_no", F.row_number().over(w).cast("long"))
