"""The shape of a run's results: who, for how long, how concentrated, where on the screen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..schemas import SENTINELS



def _dur():
    return F.col("end_time") - F.col("start_time")


def matrix(events: DataFrame) -> DataFrame:
    """Who looked at whom: events and seconds for each viewer and target."""
    return events.groupBy("recording_id", "viewer_id", "target").agg(F.count("*").alias("events"), F.sum(_dur()).alias("seconds"))


def summary(events: DataFrame) -> DataFrame:
    """Each viewer's events, and a map of seconds by target."""
    m = matrix(events)
    return m.groupBy("recording_id", "viewer_id").agg(
        F.sum("events").alias("events"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("target", F.round("seconds", 3))))).alias("duration_by_target"),
    )


def by_target(events: DataFrame) -> DataFrame:
    return events.groupBy("recording_id", "target").agg(F.sum(_dur()).alias("seconds"))


def by_reason(events: DataFrame) -> DataFrame:
    return events.groupBy("recording_id", F.when(F.coalesce("reason", F.lit("")) == "", "unrecorded").otherwise(F.col("reason")).alias("reason")).agg(F.sum(_dur()).alias("seconds"))


def shares(events: DataFrame, support: DataFrame | None = None) -> DataFrame:
    """recording_id, top_target, top_target_share, normalized_entropy, self_view_share, unresolved_share.

    support: recording_id, participants - how many there were to look at, which scales the entropy. Times that are equal to 9 places are
    equal, whatever order they were summed in; of targets with equal times the one met first is the top.
    """
    t = events.groupBy("recording_id", "target").agg(
        F.sum(_dur()).alias("d"), F.min("event_no").alias("first"),
        F.sum(F.when(F.col("target") == F.col("viewer_id"), _dur()).otherwise(0.0)).alias("self"),
    )
    named = ~F.col("target").isin(*SENTINELS)
    base = t.groupBy("recording_id").agg(
        F.sum("d").alias("all"), F.sum("self").alias("self"), F.sum(F.when(~named, F.col("d")).otherwise(0.0)).alias("unresolved"), F.sum(F.when(named, F.col("d")).otherwise(0.0)).alias("named"),
        F.max_by(F.when(named, F.struct("target", "d")), F.when(named, F.struct(F.round("d", 9), -F.col("first")))).alias("top"),
        F.collect_list(F.when(named & (F.col("d") > 0), F.col("d"))).alias("ds"),
    )
    base = base.join(support, "recording_id", "left") if support is not None else base.withColumn("participants", F.lit(0))
    k = F.greatest(F.coalesce("participants", F.lit(0)), F.size("ds"))
    total = F.aggregate("ds", F.lit(0.0), lambda s, x: s + x)
    h = F.aggregate(F.transform("ds", lambda x: x / total), F.lit(0.0), lambda s, p: s - p * F.ln(p))
    share = lambda c: F.when(F.col("all") > 0, F.col(c) / F.col("all")).otherwise(0.0)
    return base.select(
        "recording_id", F.col("top.target").alias("top_target"), F.when(F.col("named") > 0, F.col("top.d") / F.col("named")).otherwise(0.0).alias("top_target_share"),
        F.when((k < 2) | (total <= 0), 0.0).otherwise(h / F.ln(k.cast("double"))).alias("normalized_entropy"), share("self").alias("self_view_share"), share("unresolved").alias("unresolved_share"),
    )


def screen_histogram(points: DataFrame, bins: int = 16) -> DataFrame:
    """row, col, n: cells that have points."""
    cell = lambda k: F.least(F.lit(bins - 1), (F.col(k) * bins).cast("int"))
    return points.groupBy("recording_id", cell("y").alias("row"), cell("x").alias("col")).agg(F.count("*").alias("n"))


def dense_histogram(cells: DataFrame, bins: int = 16) -> DataFrame:
    """One row for each recording: counts as bins rows of bins columns."""
    m = cells.groupBy("recording_id").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("row", "col"), "n"))).alias("m"))
    axis = F.sequence(F.lit(0), F.lit(bins - 1))
    return m.select("recording_id", F.transform(axis, lambda r: F.transform(axis, lambda c: F.coalesce(F.try_element_at("m", F.struct(r.alias("row"), c.alias("col"))), F.lit(0)))).alias("histogram"))


def centre_mass(cells: DataFrame, bins: int = 16) -> DataFrame:
    """The share of points in the middle third of both axes."""
    low, high = bins // 3, 2 * bins // 3
    inside = F.col("row").between(low, high - 1) & F.col("col").between(low, high - 1)
    return cells.groupBy("recording_id").agg((F.sum(F.when(inside, F.col("n")).otherwise(0)) / F.sum("n")).alias("centre_mass"))


def confidence_histogram(directions: DataFrame) -> DataFrame:
    return directions.groupBy("recording_id", F.least(F.lit(9), (F.col("confidence") * 10).cast("int")).alias("bin")).agg(F.count("*").alias("n"))


def limiting_factors(directions: DataFrame) -> DataFrame:
    return directions.filter("quality is not null").groupBy("recording_id", G.limiting(F.col("quality")).alias("factor")).agg(F.count("*").alias("n"))
