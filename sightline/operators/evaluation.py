"""Scores of events against ground truth, next to what trivial strategies would score."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import DECLINING
from .ranges import first_holding

BINS, RESAMPLES, SEED = 5, 1000, 20260101
#: Samples up to which an interval comes from the fixed stream; more are resampled where they are, by sums.
FEW = 50_000


def samples(truth: DataFrame, step: float | None = None) -> DataFrame:
    """truth with t: the middle of each interval, or every step seconds from half a step on. Steps add up as they would one by one."""
    middle = F.array((F.col("start_time") + F.col("end_time")) / 2.0)
    if not step or step <= 0:
        return truth.withColumns({"t": F.explode(middle), "k": F.lit(0)})
    n = F.ceil((F.col("end_time") - F.col("start_time")) / step).cast("int") + 1
    walk = F.aggregate(
        F.sequence(F.lit(1), n),
        F.struct((F.col("start_time") + step / 2.0).alias("t"), F.array().cast("array<double>").alias("out")),
        lambda s, _: F.struct((s.t + step).alias("t"), F.when(s.t < F.col("end_time"), F.concat(s.out, F.array(s.t))).otherwise(s.out).alias("out")),
    )["out"]
    at = F.when(F.size(walk) > 0, walk).otherwise(middle)
    return truth.select("*", F.posexplode(at).alias("k", "t"))


def predictions(truth: DataFrame, events: DataFrame, step: float | None = None) -> DataFrame:
    """One row for each sample, with the first event (by event_no) of its viewer that holds it, and whether that is a hit."""
    e = events.select(
        "recording_id", "viewer_id", F.col("event_no").alias("n"), F.col("start_time").alias("es"), F.col("end_time").alias("ee"), F.col("target").alias("said"), F.col("confidence").alias("sure")
    )
    rows = first_holding(samples(truth, step), "t", e, ["recording_id", "viewer_id"], "n", "es", "ee", ["said", "sure"], "p")
    rows = rows.withColumns({"predicted": F.col("p.said"), "confidence": F.col("p.sure")}).drop("p")
    answered = F.col("predicted").isNotNull() & ~F.col("predicted").isin(*DECLINING)
    return rows.withColumn("answered", answered).withColumn("hit", answered & (F.col("predicted") == F.col("target")))


def _n(c: Column) -> Column:
    return F.coalesce(F.sum(c.cast("long")), F.lit(0))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def scores(p: DataFrame) -> DataFrame:
    """One row of counts and rates."""
    said, off = F.col("predicted"), F.col("target") == "off_screen"
    out = p.agg(
        F.count("*").alias("total"), _n(F.col("hit")).alias("hits"), _n(said.isNull() | said.isin(*DECLINING)).alias("unknown"),
        _n(said.isNull()).alias("silent"), _n(said == "unknown").alias("explicit_unknown"),
        _n(said == "low_confidence").alias("low_confidence"), _n(said == "not_visible").alias("not_visible"),
        _n(F.col("answered") & ~F.col("hit")).alias("wrong"), _n(off).alias("off_total"), _n(off & F.col("hit")).alias("off_hits"),
    )
    return out.withColumns(
        {
            "hit_rate": ratio(F.col("hits"), F.col("total")), "unknown_rate": ratio(F.col("unknown"), F.col("total")),
            "off_screen_recall": ratio(F.col("off_hits"), F.col("off_total")),
        }
    )


def per_grid(p: DataFrame) -> DataFrame:
    return p.filter("grid is not null").groupBy("grid").agg(_n(F.col("hit")).alias("hits"), F.count("*").alias("total"))


def confusion(p: DataFrame) -> DataFrame:
    return p.groupBy(F.col("target").alias("truth"), F.coalesce("predicted", F.lit("silent")).alias("predicted")).agg(F.count("*").alias("n"))


def order() -> Column:
    """Where a sample stands among all, which decides ties."""
    return F.struct("recording_id", "truth_no", "k")


def baselines(p: DataFrame, candidates: int | None = None) -> DataFrame:
    """strategy, score: always_unknown, uniform_random, majority_truth, model_modal_target. Empty without samples."""
    # samples are read once: all that follows comes from a row for each pair of a target and an answer
    cells = p.groupBy("target", F.when(F.col("answered"), F.col("predicted")).alias("predicted")).agg(F.count("*").alias("n"), F.min(order()).alias("at"))
    by_truth = cells.groupBy("target").agg(F.sum("n").alias("n"))
    truth = by_truth.agg(F.sum("n").alias("total"), F.max("n").alias("most"), F.count(F.when(~F.col("target").isin(*DECLINING, "off_screen"), 1)).alias("targets"))
    modal = cells.filter("predicted is not null").groupBy("predicted").agg(F.sum("n").alias("n"), F.min("at").alias("at"))
    # the most frequent one; of equals the one that came first
    best = modal.agg(F.max("n").alias("n")).join(modal, "n").agg(F.min_by("predicted", "at").alias("best"))
    named = best.join(by_truth, F.col("best") == F.col("target"), "left").select(F.coalesce("n", F.lit(0)).alias("modal"))
    c = F.lit(candidates) if candidates is not None else F.col("targets")
    # one row each
    one = truth.join(named).filter("total > 0")
    rows = F.array(
        *[F.struct(F.lit(k).alias("strategy"), v.cast("double").alias("score")) for k, v in (("always_unknown", F.lit(0.0)), ("uniform_random", F.when(c > 0, 1.0 / c).otherwise(0.0)), ("majority_truth", F.col("most") / F.col("total")), ("model_modal_target", F.col("modal") / F.col("total")))]
    )
    return one.select(F.inline(rows))


def reliability(p: DataFrame) -> DataFrame:
    """bin, count, mean_confidence, hit_rate of answers by stated confidence. Edges are the products i * 0.2 as floating-point numbers."""
    c, width = F.col("confidence"), 1.0 / BINS
    which = F.lit(None).cast("int")
    for i in reversed(range(BINS)):
        last = i == BINS - 1
        inside = (c >= i * width) & ((c < (i + 1) * width) | (c == 1.0) if last else c < (i + 1) * width)
        which = F.when(inside, F.lit(i)).otherwise(which)
    rows = p.filter("answered").withColumn("bin", which).filter("bin is not null")
    return rows.groupBy("bin").agg(F.count("*").alias("count"), F.avg("confidence").alias("mean_confidence"), F.avg(F.col("hit").cast("double")).alias("hit_rate"))


def calibration_error(p: DataFrame) -> DataFrame:
    """One row: the expected calibration error."""
    total = p.filter("answered").agg(F.count("*").alias("all"))
    return reliability(p).join(total).agg(F.coalesce(F.sum(F.col("count") / F.col("all") * F.abs(F.col("mean_confidence") - F.col("hit_rate"))), F.lit(0.0)).alias("ece"))


def bootstrap(p: DataFrame, resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """One row: low, high of the hit rate's 95 % interval, with the reference generator's own stream over the samples in order.

    Only the hits and misses, one bit each, come together; the samples of a truth file are few. For more, see bootstrap_poisson.
    """
    bits = p.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct(order().alias("o"), "hit"))), lambda x: x.hit).alias("hits"))

    def work(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import random

        for pdf in frames:
            out = []
            for hits in pdf["hits"]:
                hits = [bool(h) for h in hits]
                n, rng = len(hits), random.Random(seed)
                rates = sorted(sum(hits[rng.randrange(n)] for _ in range(n)) / n for _ in range(resamples)) if n else []
                out.append((round(rates[int(0.025 * resamples)], 4), round(rates[int(0.975 * resamples)], 4)) if rates else (0.0, 0.0))
            yield pd.DataFrame(out, columns=["low", "high"])

    return bits.mapInPandas(work, "low double, high double")


def bootstrap_of(p: DataFrame) -> DataFrame:
    """One row: low, high, by the fixed stream for FEW samples at most, and by Poisson weights, which are summed where samples are, beyond."""
    return bootstrap(p) if p.count() <= FEW else bootstrap_poisson(p)


def interval(p: DataFrame, total: int) -> tuple[float, float, str]:
    """Low and high of the hit rate's 95 % interval, and how it was found."""
    how, made = ("fixed stream", bootstrap) if total <= FEW else ("poisson weights", bootstrap_poisson)
    row = made(p).first()
    return round(row["low"], 4), round(row["high"], 4), how


def bootstrap_poisson(p: DataFrame, resamples: int = 200, seed: int = SEED) -> DataFrame:
    """The same interval for any number of samples: each gets a Poisson(1) weight in each resample; only sums are kept. Another stream."""
    u = F.pmod(F.xxhash64(F.lit(seed), "recording_id", "truth_no", "k", "b"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    edges, total, term = [], 0.0, 2.718281828459045**-1
    for k in range(8):
        total += term
        edges.append(total)
        term /= k + 1
    weight = sum((F.when(u >= e, 1).otherwise(0) for e in edges), F.lit(0))
    rates = p.select(
        "recording_id", "truth_no", "k", "hit", F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("b"),
    ).withColumn("w", weight).groupBy("b").agg((F.sum(F.col("w") * F.col("hit").cast("int")) / F.sum("w")).alias("rate"))
    return rates.agg(F.percentile("rate", 0.025).alias("low"), F.percentile("rate", 0.975).alias("high"))
