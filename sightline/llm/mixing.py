"""Mixing sources to target weights by entropy balancing.

Document rates w minimise sum(w log w - w) under one token constraint for each source, sum(w * size) = target, and w <= most. The
convex dual has one multiplier for each source; its solution tilts rates exponentially: w = min(most, exp(lambda * size / scale)).
Newton steps run distributed: each is one aggregation by source over the distinct sizes, whose count is known, so documents
themselves are read once. A bracket keeps every step safe. Rates are then rounded into whole copies, inside small groups of
documents, with the rounding error carried from larger to smaller documents, so that each source's words come near its target.

Sources come in the order of code points, null last, weigh 5, 2, 1 in turn and share all words; a target stops at `most` times its
source's words and the rest is shared anew by weight until none is above.

Defined cases: a null or empty text has size 0 and is never taken; repeated rows are documents of their own; a source without words
has target 0; an empty table gives an empty one; other columns are kept, but for those named like a result, whose place it takes; rows
that share id, text and source are dealt their copies in the order of a hash of all their columns.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, Scratch, carried, quoted, without_results

WEIGHTS = (5, 2, 1)
MOST = 3.0
#: Newton steps at most, and the relative error of a source's tokens at which they stop.
STEPS, CLOSE = 60, 1e-9
#: Documents in a group that is rounded together.
GROUP = 1000
RESULTS = ("__size", "__source_size", "__target", "__copies")


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(F.filter(F.split(text, SPACE), lambda w: w != "")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple = WEIGHTS, most: float = MOST) -> DataFrame:
    """source, source_size -> and target, on one row for each source.

    Sharing anew until none is above its limit ends at the level mu with sum(min(mu * weight, most * size)) = all words, found by
    one pass over the sources in the order of limit / weight: one narrow row for each source, never for each document.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))).withColumn("limit", F.col("source_size") * F.lit(most))
    up = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    s = s.withColumn(
        "full", F.coalesce(F.sum("limit").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
    ).withColumn("open", F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("mu", (F.sum("source_size").over(everything) - F.col("full")) / F.col("open"))
    # the first source, in that order, whose share stays below its limit sets the level
    s = s.withColumn("level", F.min(F.when(F.col("mu") * F.col("weight") <= F.col("limit"), F.struct(F.col("limit") / F.col("weight"), "mu"))).over(everything)["mu"])
    return s.select("source", "source_size", F.least("limit", F.coalesce(F.col("level") * F.col("weight"), F.col("limit"))).alias("target"))


def tilts(sizes: DataFrame, most: float = MOST) -> DataFrame:
    """source, size, n, target, source_size (distinct sizes with counts) -> source, tilt and scale: rates are min(most, exp(tilt * size / scale)).

    The bracket starts at the tilts that give every document 0 or `most`. Sources are few rows, and carried as a table.
    """
    spark, keep = sizes.sparkSession, Scratch(sizes.sparkSession)
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("key")
    sizes = keep.table(sizes.filter("size > 0").select(key, "size", "n", "target", "source_size"))
    state = sizes.groupBy("key").agg(
        F.first("target").alias("target"), F.first("source_size").alias("total"), F.min("size").cast("double").alias("low_size"),
        (F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("scale"), F.lit(0.0).alias("tilt"), F.lit(None).cast("double").alias("lo"),
        F.lit(None).cast("double").alias("hi"), F.lit(False).alias("done")
    ).withColumn("hi", F.log(F.lit(most)) * F.col("scale") / F.col("low_size"))
    state = keep.table(state, 1)
    n = state.count()
    for _ in range(STEPS):
        x = F.col("size") / F.col("scale")
        rate = F.exp(F.col("tilt") * x)
        got = (
            sizes.drop("target").join(state, "key").groupBy("key")
            .agg(F.sum(F.least(rate, F.lit(most)) * F.col("size") * F.col("n")).alias("sum"), F.sum(F.when(rate < most, rate * x * F.col("size") * F.col("n")).otherwise(0.0)).alias("slope"))
        )
        off = F.col("sum") - F.col("target")
        state2 = state.join(got, "key").select(
            "key", "target", "total", "low_size", "scale", F.col("tilt").alias("old"), (F.col("done") | (F.abs(off) <= CLOSE * F.col("target")) | (F.col("target") <= 0) | (F.col("target") >= F.col("total") * most * (1 - 1e-12))).alias("done"),
            F.when(off < 0, F.col("tilt")).otherwise(F.col("lo")).alias("lo"), F.when(off > 0, F.col("tilt")).otherwise(F.col("hi")).alias("hi"),
            (F.col("tilt") - off / F.col("slope")).alias("newton"),
        )
        inside = F.col("newton").isNotNull() & ~F.isnan("newton") & (F.col("lo").isNull() | (F.col("newton") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("newton") < F.col("hi")))
        half = F.when(F.col("lo").isNull(), F.col("hi") - 2 * (F.abs(F.col("hi")) + 1)).when(
            F.col("hi").isNull(), F.col("lo") + 2 * (F.abs(F.col("lo")) + 1),
        ).otherwise((F.col("lo") + F.col("hi")) / 2)
        new = keep.table(state2.withColumn("tilt", F.when(F.col("done"), F.col("old")).when(inside, F.col("newton")).otherwise(half)).drop("old", "newton"), n)
        keep.drop(state)
        state = new
        if state.filter("not done").isEmpty():
            return state.select("key", "tilt", "scale")
    if n:
        raise RuntimeError(f"the dual of some source isn't solved after {STEPS} steps")
    return state.select("key", "tilt", "scale")


def rounded(rate: np.ndarray, size: np.ndarray, most: float) -> np.ndarray:
    """Whole copies near rate * size, larger documents first; what one leaves open the next ones take up. None exceeds most."""
    copies, carry = np.zeros(len(rate), np.int64), 0.0
    for i in np.argsort(-size, kind="stable"):
        want = rate[i] * size[i]
        n = min(int(most), max(0, int(np.floor((carry + want) / size[i] + 0.5))))
        n = min(max(n, int(np.floor(rate[i] + 1e-9))), int(np.ceil(rate[i] - 1e-9)))
        carry += want - n * size[i]
        copies[i] = n
    return copies


def mix(docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id", weights: tuple = WEIGHTS, most: float = MOST, keep_text: bool = True) -> DataFrame:
    """docs with __size, __source_size, __target and __copies (0 up to most). keep_text: False leaves only doc_id beside them."""
    keep = Scratch(docs.sparkSession)
    key = F.coalesce(F.concat(F.lit("s"), quoted(source).cast("string")), F.lit("n"))
    narrow = keep.table(docs.select(quoted(doc_id).cast("long").alias("k1"), F.xxhash64(quoted(text)).alias("k2"), quoted(source).cast("string").alias("source"), n_words(quoted(text)).alias("size")))
    sizes = keep.table(narrow.groupBy("source", "size").agg(F.count("*").alias("n")))
    goal = keep.table(targets(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs")).drop("docs"), weights, most), 1)
    found = sizes.join(goal, sizes["source"].eqNullSafe(goal["source"])).select(sizes["source"], "size", "n", "target", "source_size")
    tilt = tilts(found, most)
    groups = sizes.groupBy("source").agg(F.ceil(F.sum("n") / GROUP).alias("groups"))
    known = goal.join(groups, goal["source"].eqNullSafe(groups["source"])).select(
        F.coalesce(F.concat(F.lit("s"), goal["source"]), F.lit("n")).alias("key"), "source_size", "target", "groups",
    ).join(tilt, "key", "left")
    known = keep.table(known, goal.count())
    rate = F.when(F.col("size") == 0, 0.0).when(
        F.col("target") >= F.col("source_size") * most * (1 - 1e-12), most,
    ).when(F.col("target") <= 0, 0.0).otherwise(F.least(F.lit(most), F.exp(F.col("tilt") * F.col("size") / F.col("scale"))))
    rates = narrow.withColumn("key", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))).drop("source").join(known, "key").select(
        "k1", "k2", "key", "size", "source_size", "target", rate.alias("rate"), F.pmod(F.xxhash64("k1", "k2"), F.col("groups")).alias("g"),
    )

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "k1", "k2"], kind="stable", ignore_index=True)
        has = pdf["size"].to_numpy() > 0
        n = np.zeros(len(pdf), np.int64)
        n[has] = rounded(pdf["rate"].to_numpy()[has], pdf["size"].to_numpy()[has].astype(float), most)
        return pdf[["k1", "k2", "key", "size", "source_size", "target"]].assign(copies=n)

    taken = rates.groupBy("key", "g").applyInPandas(take, "k1 long, k2 long, key string, size long, source_size long, target double, copies long")
    cols = [F.col("size").alias("__size"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("copies").alias("__copies")]
    if not keep_text:
        return taken.select(F.col("k1").alias(doc_id), *cols)
    names = without_results(docs.columns, RESULTS)
    mine, back = carried(docs, names)
    mine = docs.select(*mine, quoted(doc_id).cast("long").alias("m1"), F.xxhash64(quoted(text)).alias("m2"), key.alias("m3"))
    on = F.col("m1").eqNullSafe(F.col("k1")) & (F.col("m2") == F.col("k2")) & (F.col("m3") == F.col("key"))
    taken = taken.select("k1", "k2", "key", "copies", *cols)
    if not narrow.groupBy("k1", "k2", "source").count().filter("count > 1").isEmpty():
        # rows that share id, text and source are told apart by a hash of all columns: their copies are dealt out by number
        every = F.xxhash64(*(F.to_json(F.struct(f"c{i}")) if isinstance(f.dataType, T.MapType) else F.col(f"c{i}") for i, f in enumerate(mine.schema.fields[: len(names)])))
        taken = taken.withColumn("nth", F.row_number().over(Window.partitionBy("k1", "k2", "key").orderBy("copies")))
        mine = mine.withColumn("mth", F.row_number().over(Window.partitionBy("m1", "m2", "m3").orderBy(every)))
        on &= F.col("mth") == F.col("nth")
    return mine.join(taken, on).select(*back, *RESULTS)


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document as many times as it has copies. Columns named like those of mix are left out."""
    made = mix(docs, **how)
    return made.filter("__copies > 0").select(
        *(quoted(c) for c in without_results(docs.columns, RESULTS)),
        F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))).alias("__copies"),
    ).drop("__copies")
