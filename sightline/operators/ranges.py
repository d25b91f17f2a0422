"""Lookups of a moment among intervals, without a product of the two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds of a bin. An interval has a row in each bin that it touches, so an array holds what touches WIDTH seconds and no more.
WIDTH = 10.0


def bin_of(at: Column) -> Column:
    return F.floor(at / F.lit(WIDTH))


def first_holding(moments: DataFrame, at: str, intervals: DataFrame, by: list[str], order: str, start: str, end: str, values: list[str], name: str) -> DataFrame:
    """moments with name: the values of the first interval, by order, of the same keys whose half-open range holds the moment; null if none does.

    Moments are neither multiplied nor grouped. What moves is a row for each moment, and one for each bin and key of the intervals.
    """
    last = F.greatest(F.col(start), F.col(end))
    rows = intervals.filter(F.col(start) < F.col(end)).select(*by, F.explode(F.sequence(bin_of(F.col(start)), bin_of(last))).alias("_bin"), F.struct(order, start, end, *values).alias("_i"))
    bins = rows.groupBy(*by, "_bin").agg(F.array_sort(F.collect_list("_i")).alias("_held"))
    joined = moments.withColumn("_bin", bin_of(F.col(at))).join(bins, [*by, "_bin"], "left")
    found = F.get(F.filter("_held", lambda i: (i[start] <= F.col(at)) & (F.col(at) < i[end])), F.lit(0))
    return joined.withColumn("_f", found).withColumn(name, F.when(F.col("_f").isNotNull(), F.struct(*[F.col(f"_f.{v}").alias(v) for v in values]))).drop("_bin", "_held", "_f")
