"""Line dedup over overlapping windows of three lines.

Three consecutive lines are hashed (128 bits) at every line of every text; windows that occur more than once anywhere are found by
one aggregation with partial sums on the map side, and the lines that later occurrences cover are removed. The first occurrence,
by doc_id, then line, stays. An occurrence that overlaps the first one in the same document is not a later one, so a run of equal
lines keeps three of them.

Defined cases: lines are what stands between \\n; windows without any visible character are ignored; texts of less than three lines,
empty and null texts are unchanged (null stays null); a null doc_id sorts before all others; rows that share doc_id and text are one
document and stay alike; rows that share only doc_id come in the order of a hash of the text; other columns are kept, but for those
named n_lines or n_removed where counts are asked for, whose place these take.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_128_intdigest

from .common import Scratch, carried, coded, mixed, quoted, sliced, without_results

WIDTH = 3


def windows(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of all texts: the text's number, the first line's number, and 128 bits of hash in two halves."""
    lists = pc.split_pattern(pc.fill_null(text.cast(pa.large_string()), ""), "\n")
    flat, starts = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    starts = starts - starts[0]
    ids, vocab = coded(flat)
    each = [xxh3_128_intdigest(x) for x in vocab.to_pylist()]
    halves = [np.fromiter((h >> s & (2**64 - 1) for h in each), np.uint64, len(each))[ids] for s in (64, 0)]
    seen = pc.not_equal(pc.ascii_trim_whitespace(flat), "").to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    n = len(flat) - WIDTH + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 4
    ok = (owner[:n] == owner[WIDTH - 1 :]) & (seen[:n] | seen[1 : n + 1] | seen[2:])
    out = []
    for h in halves:
        k = mixed(h[:n])
        for j in range(1, WIDTH):
            k = mixed(k + h[j : n + j])
        out.append(k.view(np.int64)[ok])
    return owner[:n][ok], (np.arange(n) - starts[owner[:n]])[ok], *out


def _key(docs: DataFrame, doc_id: str, text: str) -> list[Column]:
    return [F.coalesce(quoted(doc_id).cast("long"), F.lit(-(2**63))).alias("k1"), F.xxhash64(quoted(text)).alias("k2")]


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """k1, k2 (a document's key) and starts: first lines of later occurrences."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            owner, line, h1, h2 = windows(b.column(2))
            at = pa.array(owner)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(line.astype(np.int32)), pa.array(h1), pa.array(h2)], names=["k1", "k2", "line", "h1", "h2"])

    at = Scratch(docs.sparkSession).table(docs.select(*_key(docs, doc_id, text), quoted(text).alias("text")).mapInArrow(work, "k1 long, k2 long, line int, h1 long, h2 long"))
    many = at.groupBy("h1", "h2").agg(F.min(F.struct("k1", "k2", "line")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    other = (F.col("k1") != F.col("first.k1")) | (F.col("k2") != F.col("first.k2"))
    later = at.join(many, ["h1", "h2"]).filter(other | (F.col("line") >= F.col("first.line") + WIDTH))
    return later.groupBy("k1", "k2").agg(F.collect_set("line").alias("starts"))


def without(text: str | None, starts: np.ndarray) -> tuple[str | None, int, int]:
    """A text without the lines that windows cover, its number of lines, and how many went."""
    if text is None:
        return None, 0, 0
    lines = text.split("\n")
    keep = np.ones(len(lines), bool)
    for j in range(WIDTH):
        keep[starts + j] = False
    gone = int((~keep).sum())
    return ("\n".join(lines[i] for i in np.flatnonzero(keep)) if gone else text), len(lines), gone


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", counts: bool = False) -> DataFrame:
    """docs with the repeated lines gone; counts adds n_lines and n_removed."""
    names = without_results(docs.columns, ("n_lines", "n_removed") if counts else ())
    mine, back = carried(docs, names)
    starts = repeated_lines(docs, doc_id, text)
    joined = docs.select(*mine, *_key(docs, doc_id, text), quoted(text).alias("text")).join(starts, ["k1", "k2"], "left")
    joined = joined.select(*(f"c{i}" for i in range(len(names)) if names[i] != text), "text", "starts")
    schema = T.StructType(joined.schema.fields[:-2]).add("text", "string")
    if counts:
        schema = schema.add("n_lines", "long").add("n_removed", "long")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            n = b.num_columns - 2
            made = [without(t, np.array(s or [], np.int64)) for t, s in zip(b.column(n).to_pylist(), b.column(n + 1).to_pylist())]
            cols = [*b.columns[:n], pa.array([m[0] for m in made], pa.string())]
            if counts:
                cols += [pa.array([m[k] for m in made], pa.int64()) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    done = joined.mapInArrow(work, schema)
    return done.select(*(F.col("text").alias(text) if c == text else x for c, x in zip(names, back)), *(("n_lines", "n_removed") if counts else ()))
