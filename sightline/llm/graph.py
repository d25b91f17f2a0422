"""Connected components of links, without gathering them anywhere.

Links are first thinned to spanning forests inside partitions, then alternate large-star and small-star steps (Kiveris et al. 2014) turn
each component into a star around its smallest node. A step joins links with the least neighbour of each node, so a node with very
many links is an ordinary skewed join, which Spark splits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node that isn't the least of its component, and that least one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = list(range(len(nodes)))
    n = len(a)
    for x, y in zip(at[:n].tolist(), at[n:].tolist()):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        while up[y] != y:
            up[y] = up[up[y]]
            y = up[y]
        if x != y:
            up[max(x, y)] = min(x, y)
    for i in range(len(up)):  # parents are smaller, so theirs are known
        up[i] = up[up[i]]
    root = np.array(up, np.int64)
    own = np.flatnonzero(root != np.arange(len(up)))
    return nodes[own], nodes[root[own]]


def _thin(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a = b = np.zeros(0, np.int64)
    for x in batches:
        a, b = np.concatenate([a, x.column(0).to_numpy()]), np.concatenate([b, x.column(1).to_numpy()])
        if len(a) > 400_000:
            a, b = forest(a, b)
            if len(a) > 200_000:  # a partition of many nodes is passed on in pieces
                yield pa.record_batch({"a": a, "b": b})
                a = b = np.zeros(0, np.int64)
    if len(a):
        a, b = forest(a, b)
        yield pa.record_batch({"a": a, "b": b})


def components(links: DataFrame) -> DataFrame:
    """links (a, b: long) -> node, component_id: the smallest node reachable. Nodes that are the smallest themselves are left out."""
    keep = Scratch(links.sparkSession)
    schema = "a long, b long"
    now = keep.table(links.select("a", "b").filter("a != b").mapInArrow(_thin, schema).repartition(F.col("a")).mapInArrow(_thin, schema))
    n, before = now.count(), None  # a round never has more links than the first one
    while True:  # until links stop changing: each is then one to the least node of its component
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        met = large.join(least, "a")
        small = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a != b").distinct()
        new = keep.table(small, n)
        keep.drop(now)
        now = new
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == before:
            break
        before = seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("component_id"))
