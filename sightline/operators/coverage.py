"""How much of a recording each step could use, and what that implies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .layouts import participants

COUNTS = ("directions", "points", "off_screen", "fixations", "attributions", "events", "not_visible", "face_attempts", "face_hits")


def funnel(projected: DataFrame, fixations: DataFrame, attributions: DataFrame, events: DataFrame, unseen: DataFrame, faces: DataFrame | None = None) -> DataFrame:
    """One row for each participant: counts of each step, those of face detection, and windows without any use. Absent counts are 0.

    events are those of attributions; unseen are the not-visible windows, which totals add to events.
    """
    who = F.col("person_id").alias("participant_id")
    viewer = F.col("viewer_id").alias("participant_id")
    one = lambda df, c, name: df.groupBy("recording_id", c).agg(F.count("*").alias(name))
    steps = [
        projected.groupBy("recording_id", who).agg(
            F.count("*").alias("directions"), F.sum((~F.col("off_screen")).cast("long")).alias("points"),
            F.sum(F.col("off_screen").cast("long")).alias("off_screen"),
        ),
        one(fixations, who, "fixations"), one(attributions, viewer, "attributions"), one(events, viewer, "events"), one(unseen, viewer, "not_visible"),
    ]
    if faces is not None:
        steps.append(faces.groupBy("recording_id", "participant_id").agg(F.count("*").alias("face_attempts"), F.sum(F.col("hit").cast("long")).alias("face_hits")))
    all_ = reduce(lambda a, b: a.join(b, ["recording_id", "participant_id"], "full_outer"), steps)
    have = set(all_.columns)
    return all_.select("recording_id", "participant_id", *[(F.coalesce(F.col(c), F.lit(0)) if c in have else F.lit(0)).cast("long").alias(c) for c in COUNTS])


def totals(per_participant: DataFrame, layouts: DataFrame | None = None, frames: DataFrame | None = None) -> DataFrame:
    """One row for each recording, with rates, numbers of layouts and participants, and the layouts' sources."""
    t = per_participant.groupBy("recording_id").agg(*[F.sum(c).alias(c) for c in COUNTS])
    t = t.withColumn("events", F.col("events") + F.col("not_visible"))
    if layouts is not None:
        ids = F.flatten(F.collect_set(F.transform(participants(F.col("regions")), lambda r: r.participant_id)))
        l = layouts.groupBy("recording_id").agg(
            F.countDistinct("layout_no").alias("layouts"), F.size(F.array_distinct(ids)).alias("participants_detected"),
            F.array_sort(F.collect_set("source")).alias("layout_sources"),
        )
        t = t.join(l, "recording_id", "left")
    if frames is not None:
        t = t.join(frames.groupBy("recording_id").agg(F.count("*").alias("frames")), "recording_id", "left")
    for c in ("layouts", "participants_detected", "frames"):
        t = t.withColumn(c, F.coalesce(F.col(c), F.lit(0)).cast("long") if c in t.columns else F.lit(0).cast("long"))
    if "layout_sources" not in t.columns:
        t = t.withColumn("layout_sources", F.array().cast("array<string>"))
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return t.withColumns(
        {
            "layout_sources": F.coalesce("layout_sources", F.array().cast("array<string>")), "face_hit_rate": rate("face_hits", "face_attempts"),
            "off_screen_rate": rate("off_screen", "directions"),
        }
    )


def unreconciled(per_participant: DataFrame) -> DataFrame:
    """Rows whose counts can't be right: points and off-screen directions are all directions, and hits are attempts."""
    return per_participant.filter("points + off_screen <> directions or face_hits > face_attempts")


#: Limits of the rules; parameters of degradations().
LIMITS = {"face_hit_rate": 0.5, "off_screen_rate": 0.5, "top_share": 0.6, "entropy": 0.4, "centre_mass": 0.5, "self_view": 0.25}


def degradations(metrics: DataFrame, limits: dict | None = None) -> DataFrame:
    """recording_id, stage, code, detail, impact: one row for each rule that a recording's metrics meet, in one pass.

    metrics: totals() joined with shares(), centre_mass, uncalibrated (number of viewers) and no_iris (boolean), as far as known.
    """
    k = LIMITS | (limits or {})
    exact = lambda x: F.round(c(x), 9)  # noqa: E731  # shares are sums in any order: what equals a limit must not pass it by its last bit
    for c, v in (("top_target", None), ("top_target_share", 0.0), ("normalized_entropy", 1.0), ("centre_mass", 0.0), ("self_view_share", 0.0), ("uncalibrated", 0), ("no_iris", False)):
        if c not in metrics.columns:
            metrics = metrics.withColumn(c, F.lit(v).cast("string") if c == "top_target" else F.lit(v))
    c = F.col
    pct = lambda x: F.concat(F.format_string("%.1f", c(x) * 100), F.lit("%"))
    say = F.concat
    shared = F.array_contains("layout_sources", "assumed_shared")
    rules = [
        (c("layouts") == 0, "layout", "no_layout", F.lit("no arrangement of tiles lasted"), "nothing can be attributed"),
        ((c("layouts") > 0) & (c("participants_detected") == 0), "layout", "no_participant_regions", F.lit("layouts hold no participants"), "all targets are unknown"),
        (shared, "layout", "assumed_shared_layout", F.lit("one recorded layout stands for every viewer"), "only the recorded screen's own viewer can be trusted"),
        (
            (c("face_attempts") > 0) & (c("face_hit_rate") < k["face_hit_rate"]), "observation", "low_face_hit_rate",
            say(
                c("face_hits").cast("string"), F.lit(" of "), c("face_attempts").cast("string"), F.lit(" crops ("), pct("face_hit_rate"),
                F.lit(") had a face"),
            ),
            "times are too short",
        ),
        (
            (c("directions") > 0) & (c("off_screen_rate") > k["off_screen_rate"]), "mapping", "high_off_screen_rate",
            say(
                c("off_screen").cast("string"), F.lit(" of "), c("directions").cast("string"), F.lit(" directions ("), pct("off_screen_rate"),
                F.lit(") miss the screen"),
            ),
            "people looked away, or the mapping doesn't fit",
        ),
        ((c("directions") > 0) & (c("events") == 0), "events", "no_events", F.lit("no direction became an event"), "only raw observations are left"),
        (
            exact("top_target_share") > k["top_share"], "results", "concentrated_targets",
            say(c("top_target"), F.lit(" has "), pct("top_target_share"), F.lit(" of all time on participants")), "one target may stand for a bias",
        ),
        (
            c("top_target").isNotNull() & (exact("normalized_entropy") < k["entropy"]), "results", "low_target_entropy",
            say(F.lit("normalised entropy is "), F.format_string("%.2f", c("normalized_entropy"))), "targets hardly differ",
        ),
        (c("centre_mass") > k["centre_mass"], "results", "centre_clustered_gaze", say(pct("centre_mass"), F.lit(" of points lie in the middle")), "estimates may fall back to the centre"),
        (exact("self_view_share") > k["self_view"], "results", "high_self_view", say(pct("self_view_share"), F.lit(" of time is on the viewer's own tile")), "tiles and people may be mixed up"),
        (c("uncalibrated") > 0, "mapping", "uncalibrated_viewers", say(c("uncalibrated").cast("string"), F.lit(" viewers keep the prior mapping")), "their targets rest on assumed geometry"),
        (c("no_iris"), "observation", "no_iris_signal", F.lit("the face observer has no iris"), "eye movements are not seen"),
    ]
    found = F.array(
        *[F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), F.lit(stage).alias("stage"), F.lit(code).alias("code"), detail.alias("detail"), F.lit(impact).alias("impact")) for ok, stage, code, detail, impact in rules]
    )
    return metrics.select("recording_id", F.explode(F.filter(found, lambda r: r.ok)).alias("r")).select("recording_id", "r.stage", "r.code", "r.detail", "r.impact")
