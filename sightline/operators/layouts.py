"""Screen layouts: segmentation of frame arrangements, identities across them, and which one is active."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..schemas import TABLES


def segment_layouts(frames: DataFrame, min_stable: float = 0.5) -> DataFrame:
    """recording_id, interval_no, start_time, end_time (null for the last), tiles: arrangements that lasted.

    Runs of equal arrangements; the first run counts at once, others if they last min_stable seconds. Runs that don't count leave
    what they interrupt whole. Empty arrangements are arrangements too.
    """
    w = Window.partitionBy("recording_id").orderBy("ts")
    f = frames.withColumn("sig", G.signature(F.col("tiles")))
    f = f.withColumn("_new", F.coalesce((~F.col("sig").eqNullSafe(F.lag("sig").over(w))).cast("int"), F.lit(1))).withColumn("_new", F.when(F.row_number().over(w) == 1, 1).otherwise(F.col("_new")))
    f = f.withColumn("run", F.sum("_new").over(w))
    runs = f.groupBy("recording_id", "run").agg(F.min("ts").alias("start_time"), F.max("ts").alias("last"), F.min_by("tiles", "ts").alias("tiles"), F.first("sig").alias("sig"))
    kept = runs.filter((F.col("run") == 1) | (F.col("last") - F.col("start_time") >= min_stable))
    r = Window.partitionBy("recording_id").orderBy("run")
    kept = kept.withColumn("_same", F.coalesce(F.col("sig").eqNullSafe(F.lag("sig").over(r)) & (F.lag("run").over(r).isNotNull()), F.lit(False))).filter("not _same")
    return kept.select("recording_id", (F.row_number().over(r) - 1).cast("int").alias("interval_no"), "start_time", F.lead("start_time").over(r).alias("end_time"), "tiles")


def resolve_names(intervals: DataFrame, names: str = "names") -> DataFrame:
    """names: for each tile a label or null. The first spelling of a label in a recording stands for all; blank ones become null."""
    flat = intervals.select("recording_id", "interval_no", F.posexplode(names).alias("pos", "name")).withColumn("clean", F.trim("name")).withColumn("key", F.lower("clean"))
    w = Window.partitionBy("recording_id", "key").orderBy("interval_no", "pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    named = flat.withColumn("id", F.when(F.coalesce(F.col("key"), F.lit("")) != "", F.first("clean").over(w)))
    back = named.groupBy("recording_id", "interval_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x.id).alias("ids"))
    return intervals.join(back, ["recording_id", "interval_no"], "left")


def build_layout(tiles: Column, ids: Column) -> Column:
    """Regions in the order of tiles: a participant is its id, or slot_ and its place among participants."""
    at = F.transform(tiles, lambda t, i: F.struct(t.alias("t"), i.alias("i"), F.get(ids, i).alias("id")))
    place = lambda x: F.size(F.filter(F.slice(tiles, 1, x.i), lambda t: t.kind == "participant"))
    return F.transform(
        at,
        lambda x: F.struct(
            x.t.kind.alias("kind"), x.t.x.alias("x"), x.t.y.alias("y"), x.t.width.alias("width"), x.t.height.alias("height"),
            F.when(x.t.kind == "participant", F.coalesce(x.id, F.concat(F.lit("slot_"), place(x).cast("string")))).alias("participant_id"),
        ),
    )


def named_layouts(intervals: DataFrame, viewer: str = "recording", source: str = "recording", ids: str = "ids") -> DataFrame:
    return intervals.select(
        "recording_id", F.lit(viewer).alias("viewer_id"), F.col("interval_no").alias("layout_no"), "start_time", "end_time",
        F.lit(source).alias("source"), build_layout(F.col("tiles"), F.col(ids)).alias("regions"),
    )


def _iou(a: dict, b: dict) -> float:
    w = min(a["x"] + a["width"], b["x"] + b["width"]) - max(a["x"], b["x"])
    h = min(a["y"] + a["height"], b["y"] + b["height"]) - max(a["y"], b["y"])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / (a["width"] * a["height"] + b["width"] * b["height"] - w * h)


def carry_identities(intervals: list[list[dict]], threshold: float) -> list[list[dict]]:
    """Regions of successive arrangements. A tile that overlaps one of the arrangement before keeps its id, best overlap first; others get new ids."""
    out, before, minted = [], [], 0
    for tiles in intervals:
        people = [t for t in tiles if t["kind"] == "participant"]
        pairs = sorted(((_iou(p, o), i, o["participant_id"]) for i, p in enumerate(people) for o in before), key=lambda x: -x[0])
        ids: dict[int, str] = {}
        for score, i, name in pairs:
            if score >= threshold and i not in ids and name not in ids.values():
                ids[i] = name
        for i in range(len(people)):
            if i not in ids:
                ids[i] = f"slot_{minted}"
                minted += 1
        before = [p | {"participant_id": ids[i]} for i, p in enumerate(people)]
        out.append(before + [t | {"participant_id": None} for t in tiles if t["kind"] != "participant"])
    return out


def build_layouts(intervals: DataFrame, viewer: str = "recording", source: str = "recording", continuity: float = 0.5) -> DataFrame:
    """Layouts of each recording with identities carried along. Sequential by nature; a recording has few intervals."""

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("interval_no", ignore_index=True)
        regions = carry_identities([[dict(t) for t in tiles] for tiles in pdf["tiles"]], continuity)
        return pd.DataFrame(
            {
                "recording_id": pdf["recording_id"], "viewer_id": viewer, "layout_no": pdf["interval_no"], "start_time": pdf["start_time"],
                "end_time": pdf["end_time"], "source": source, "regions": regions,
            }
        )

    made = intervals.groupBy("recording_id").applyInPandas(work, TABLES["layouts"])
    return made.withColumn("end_time", F.when(~F.isnan("end_time"), F.col("end_time")))


def participants(regions: Column) -> Column:
    return F.filter(regions, lambda r: r.kind == "participant")


def identity_breaks(layouts: DataFrame) -> DataFrame:
    """Where participants came or went between successive layouts; total: none stayed."""
    w = Window.partitionBy("recording_id", "viewer_id").orderBy("layout_no")
    ids = F.array_distinct(F.transform(participants(F.col("regions")), lambda r: r.participant_id))
    pairs = layouts.withColumn("now", ids).withColumn("was", F.lag("now").over(w)).filter("was is not null")
    sets = pairs.select(
        "recording_id", "viewer_id", F.col("start_time").alias("at_time"),
        *[F.array_sort(x).alias(k) for k, x in (("carried", F.array_intersect("was", "now")), ("introduced", F.array_except("now", "was")), ("ended", F.array_except("was", "now")))],
    )
    return sets.filter((F.size("introduced") > 0) | (F.size("ended") > 0)).withColumn("total", F.size("carried") == 0)


def assumed_layouts(viewers: DataFrame, recorded: DataFrame) -> DataFrame:
    """Every recorded layout for every viewer of the recording."""
    return viewers.select("recording_id", "viewer_id").distinct().join(recorded.drop("viewer_id"), "recording_id").withColumn("source", F.lit("assumed_shared"))


def viewer_layouts(viewers: DataFrame, recorded: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """With a manifest, a viewer's own layouts, or none; else the recorded ones, assumed shared."""
    if manifest is None:
        return assumed_layouts(viewers, recorded)
    return viewers.select("recording_id", "viewer_id").distinct().join(manifest, ["recording_id", "viewer_id"])


def in_order(layouts: DataFrame, by: list[str]) -> DataFrame:
    """All layouts of a recording or a viewer as one array, in the order that decides which is met first."""
    cols = F.struct("layout_no", "start_time", "end_time", "source", "regions")
    return layouts.groupBy(*by).agg(F.array_sort(F.collect_list(cols)).alias("layouts"))


def active(layouts: Column, at: Column) -> Column:
    """The first layout whose half-open interval holds a time."""
    return F.get(F.filter(layouts, lambda l: (l.start_time <= at) & (l.end_time.isNull() | (at < l.end_time))), F.lit(0))


def observe(frames: DataFrame, layouts: DataFrame, stage, schema: str) -> DataFrame:
    """Frames with their active layout's participants, one row each, through a gaze stage (a function for mapInPandas).

    The other side of the join is a recording's few layouts, which Spark broadcasts while they are small; the join keeps all frames, so that
    never the frames are broadcast. Pixels go to Python once for each frame and are shared by its participants there.
    """
    joined = frames.join(in_order(layouts, ["recording_id"]), "recording_id", "left")
    people = participants(active(F.col("layouts"), F.col("ts")).regions)
    rows = joined.select("recording_id", "ts", "height", "width", "pixels", people.alias("regions"))

    def crops(batches):
        for pdf in batches:
            n = [0 if r is None else len(r) for r in pdf["regions"]]
            each = pdf.drop(columns="regions").loc[pdf.index.repeat(n)].reset_index(drop=True)
            each["region"] = [x for r in pdf["regions"] if r is not None for x in r]
            if len(each):
                yield each

    return rows.mapInPandas(lambda batches: stage(crops(batches)), schema)
