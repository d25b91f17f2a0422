"""Near-duplicate embeddings by randomised-rotation binary codes (RaBitQ).

Seeded random rotations turn each unit vector into signs: its code, of CODE bits or more. The code is stored once, with its correction
factor (the inner product of the code and what it stands for), the spread of its error, and the rotated vector itself in PLANES planes of
bits, rounded with a fixed dither. One vector's code and another one's planes give an unbiased estimate of their inner product by counting
bits, with a confidence bound: a pair at or above the limit lies so close together that little of either is outside the other's direction.

1. Bands of the signs of further rotations are an index whose bits and number follow from the number of a label's vectors and the wanted
   recall. Codes and planes, not vectors, are dealt out by bands.
2. Inside a bucket, pairs whose upper bound reaches the limit name the vectors that are needed in full: only those are fetched.
3. They are dealt out again with the vectors, and the same pairs are recomputed exactly, in double precision.

A pair counts in the first band that it shares. Equal vectors are one entry with a weight. A bucket of more than BLOCK entries is dealt out
in pairs of blocks, so none is held in one task, and tasks return sums and spanning links, never all pairs.

Defined cases: null labels, null, empty and zero vectors, and vectors with null or non-finite components link with nothing; vectors of
different lengths don't link; components are scaled by the largest one first, so that squares neither overflow nor vanish; a vec_id that
occurs twice is two vectors that share an id; null vec_ids link with nothing; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, quoted, runs
from .graph import components, forest

LIMIT, RECALL, BLOCK, SEED = 0.98, 0.995, 2048, 20240229
#: Bits of a code at least, planes of bits of a rotated vector, and standard deviations of an estimate's error that its bound allows.
CODE, PLANES, SURE = 128, 4, 4.0


def plan(n: int, limit: float = LIMIT, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a band and number of bands: buckets of about 64 of n random vectors, found with the wanted recall at the limit itself."""
    bits = min(24, max(6, math.ceil(math.log2(max(n, 2) / 64))))
    same = (1 - math.acos(limit) / math.pi) ** bits
    return bits, max(2, math.ceil(math.log(1 - recall) / math.log(1 - same)))


@lru_cache(maxsize=16)
def rotations(dim: int, rows: int, seed: int = SEED) -> np.ndarray:
    """The first rows of seeded random rotations, one below the other."""
    r = np.random.default_rng(seed + dim)
    made = [np.linalg.qr(r.standard_normal((dim, dim)))[0] for _ in range(-(-rows // dim))]
    return np.concatenate(made)[:rows]


def unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors / np.abs(vectors).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


class Codes(NamedTuple):
    """Stored codes of some vectors: a row for each in every array."""

    code: np.ndarray  # sign bits, in words of 64
    planes: np.ndarray  # bits of the rounded rotated vector, plane by plane, in words of 64
    low: np.ndarray  # what a rounded 0 stands for
    step: np.ndarray  # what a rounded 1 adds
    total: np.ndarray  # sum of the rounded vector
    factor: np.ndarray  # inner product of the signs (1 or -1) and the rotated vector
    spread: np.ndarray  # variance of the inner product of the signs and a unit vector at right angles

    def take(self, rows) -> Codes:
        return Codes(*(x[rows] for x in self))


def _words(bits: np.ndarray) -> np.ndarray:
    """Bits as words of 64, the last one filled up with zeros."""
    raw = np.packbits(bits, axis=1)
    raw = np.pad(raw, ((0, 0), (0, -raw.shape[1] % 8)))
    return np.ascontiguousarray(raw).view(np.uint64)


def encode(x: np.ndarray) -> Codes:
    """Codes of unit vectors."""
    d = x.shape[1]
    turns = max(1, -(-CODE // d))
    turned = x @ rotations(d, turns * d).T
    size = np.abs(turned).reshape(len(x), turns, d).sum(2)
    low = turned.min(1)
    step = np.maximum((turned.max(1) - low) / (2**PLANES - 1), 1e-12)
    dither = np.random.default_rng(SEED).random(turned.shape[1])
    u = np.clip(np.floor((turned - low[:, None]) / step[:, None] + dither), 0, 2**PLANES - 1).astype(np.uint8)
    planes = np.concatenate([_words(u >> j & 1) for j in range(PLANES)], 1)
    return Codes(_words(turned > 0), planes, low, step, u.sum(1, dtype=np.int64), size.sum(1), ((d - size**2) / max(1, d - 1)).sum(1))


def estimate(a: Codes, b: Codes, bits: int, limit: float = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of coded vectors a (rows) with rounded ones b (columns): unbiased estimates, and the width of their bounds.

    The bound holds for pairs at or above the limit, so that estimate + width < limit rules a pair out. bits: of a code.
    """
    words = a.code.shape[1]
    both = np.zeros((len(a.code), len(b.code)), np.int32)
    for j in range(PLANES):
        for w in range(words):
            both += np.bitwise_count(a.code[:, w, None] & b.planes[None, :, j * words + w]).astype(np.int32) << j
    ones = np.bitwise_count(a.code).sum(1, dtype=np.int64)
    factor = np.maximum(a.factor, 1e-9)[:, None]
    est = (b.low * (2 * ones - bits)[:, None] + b.step * (2 * both - b.total)) / factor
    wide = SURE * np.sqrt((1 - limit * limit) * a.spread[:, None] + bits * (b.step * b.step)[None, :] / 4) / factor
    return est, wide


def candidates(c: Codes, bits: int, keys: np.ndarray, band: int, side: np.ndarray, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a bucket, or between two of its blocks (side 0 and 1), whose upper bound reaches the limit and that share no band before."""
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    within = not len(right)
    right = left if within else right
    for start in range(0, len(left), 256):
        rows = left[start : start + 256]
        for begin in range(start if within else 0, len(right), 4096):
            cols = right[begin : begin + 4096]
            est, wide = estimate(c.take(rows), c.take(cols), bits, limit)
            i, j = np.nonzero(est + wide >= limit)
            if within:
                up = start + i < begin + j
                i, j = i[up], j[up]
            a, b = rows[i], cols[j]
            if band:
                first = np.ones(len(a), bool)
                for k in range(band):
                    first &= keys[a, k] != keys[b, k]
                a, b = a[first], b[first]
            if len(a):
                yield a, b


def linked(pairs: Iterable[tuple[np.ndarray, np.ndarray]], x: np.ndarray, weight: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The exact check of candidate pairs: linked weights of each entry, and spanning links (entries' places)."""
    total, la, lb = np.zeros(len(x), np.int64), [], []
    for a, b in pairs:
        ok = np.concatenate([np.einsum("ij,ij->i", x[a[s : s + 65536]], x[b[s : s + 65536]]) for s in range(0, len(a), 65536)]) >= limit
        a, b = a[ok], b[ok]
        if len(a):
            total += (np.bincount(a, weights=weight[b], minlength=len(x)) + np.bincount(b, weights=weight[a], minlength=len(x))).astype(np.int64)
            u, v = forest(a, b)
            la.append(u)
            lb.append(v)
    if not la:
        return total, np.zeros(0, np.int64), np.zeros(0, np.int64)
    return total, *forest(np.concatenate(la), np.concatenate(lb))


#: How codes are stored, and what a row of a bucket begins with.
STORED = "code binary, planes binary, low double, step double, total long, factor double, spread double, keys array<int>"
BUCKET = "g long, p int, q int, dim int, band int, key int, label string"
WIDTH = len(BUCKET.split(", "))


def names_of(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _encoded(reps: DataFrame, limit: float, recall: float) -> DataFrame:
    """reps (label, h1, h2, rep, weight, v, and n: how many vectors the label has) with dim and the columns of STORED in place of n."""
    schema = f"label string, h1 long, h2 long, rep long, weight long, v array<double>, dim int, {STORED}"

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, n = b.column(5).value_lengths().to_numpy(), b.column(6).to_numpy()
            for dim, count in sorted({*zip(sizes.tolist(), n.tolist())}):
                mine = b.filter(pa.array((sizes == dim) & (n == count)))
                x = unit(mine.column(5).flatten().to_numpy().reshape(-1, dim))
                c, (bits, bands) = encode(x), plan(count, limit, recall)
                # other rotations than those of the codes, so that sharing a bucket says nothing about the error of an estimate
                sign = x @ rotations(dim, bits * bands, SEED + 1_000_003).T > 0
                keys = (sign.reshape(len(x), bands, bits) @ (1 << np.arange(bits))).astype(np.int32)
                at = pa.array(np.arange(0, (len(x) + 1) * bands, bands), pa.int32())
                cols = [mine.column(i) for i in range(6)] + [pa.array(np.full(len(x), dim, np.int32))]
                cols += [pa.array([r.tobytes() for r in y], pa.binary()) for y in (c.code, c.planes)] + [pa.array(y) for y in c[2:]]
                yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(at, pa.array(keys.ravel()))], names=names_of(schema))

    return reps.select("label", "h1", "h2", "rep", "weight", "v", "n").mapInArrow(work, schema)


def _buckets(coded: DataFrame, keep: Scratch) -> DataFrame:
    """BUCKET, side, num, weight and STORED: which codes meet where. A bucket of several blocks is dealt out by pairs of them."""
    bucket = ["label", "dim", "band", "key"]
    hot = coded.select("label", "dim", F.posexplode("keys").alias("band", "key")).groupBy(*bucket).count().filter(F.col("count") > BLOCK)
    hot = keep.table(hot.select(*bucket, F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))  # Spark sees how large it is
    at = coded.select("label", "dim", "num", "weight", *names_of(STORED), F.posexplode("keys").alias("band", "key"))
    at = at.join(hot, bucket, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    at = at.withColumn("own", F.pmod(F.xxhash64("num"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    at = at.withColumns({"p": F.least("own", "other"), "q": F.greatest("own", "other")})
    at = at.withColumns({"g": F.xxhash64(*bucket, "p", "q"), "side": F.when(F.col("own") == F.col("p"), 0).otherwise(1)})
    return at.select(*names_of(BUCKET), "side", "num", "weight", *names_of(STORED))


def _arranged(rows: DataFrame) -> DataFrame:
    return rows.repartition("g").sortWithinPartitions(*names_of(BUCKET))


def _read(b: pa.RecordBatch) -> tuple[Codes, int, np.ndarray, int, np.ndarray]:
    """The codes of a bucket's rows, their bits, keys, the band, and sides."""
    at = WIDTH + 3
    dim, band = b.column(3)[0].as_py(), b.column(4)[0].as_py()
    words = [np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint64).reshape(b.num_rows, -1) for i in (at, at + 1)]
    c = Codes(*words, *(b.column(at + i).to_numpy() for i in range(2, 7)))
    return c, max(1, -(-CODE // dim)) * dim, b.column(at + 7).flatten().to_numpy().reshape(b.num_rows, -1), band, b.column(WIDTH).to_numpy()


def _wanted(dealt: DataFrame, limit: float) -> DataFrame:
    """BUCKET, side, num: the rows of buckets that are needed in full."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runs(batches, WIDTH):
            if b.num_rows < 2:
                continue
            c, bits, keys, band, side = _read(b)
            need = np.zeros(b.num_rows, bool)
            for x, y in candidates(c, bits, keys, band, side, limit):
                need[x] = need[y] = True
            if need.any():
                yield b.select(range(WIDTH + 2)).filter(pa.array(need))

    return dealt.mapInArrow(work, f"{BUCKET}, side int, num long")


def _exact(dealt: DataFrame, limit: float) -> DataFrame:
    """a, n: linked weights of a vector. a, b: spanning links."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runs(batches, WIDTH):
            c, bits, keys, band, side = _read(b)
            ids, weight = (b.column(WIDTH + i).to_numpy() for i in (1, 2))
            x = unit(b.column(b.num_columns - 1).flatten().to_numpy().reshape(b.num_rows, -1))
            total, u, v = linked(candidates(c, bits, keys, band, side, limit), x, weight, limit)
            has = np.flatnonzero(total)
            yield pa.record_batch({
                "a": pa.array(np.concatenate([ids[has], ids[u]])), "b": pa.concat_arrays([pa.nulls(len(has), pa.int64()), pa.array(ids[v])]),
                "n": pa.array(np.concatenate([total[has], np.zeros(len(u), np.int64)])),
            })

    return dealt.mapInArrow(work, "a long, b long, n long")


def near_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", limit: float = LIMIT, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each vector."""
    keep = Scratch(rows.sparkSession)
    total = rows.count()
    base = rows.select(quoted(vec_id).cast("long").alias("id"), quoted(label).cast("string").alias("label"), quoted(vector).cast("array<double>").alias("v"))
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0)
    named = base.withColumn("ok", F.coalesce(sound, F.lit(False))).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(7), "v")})
    # one row for each label; copies count too, which makes buckets smaller and costs no recall
    sizes = keep.table(named.filter("ok").groupBy("label").agg(F.count("*").alias("n")), 1)
    reps = named.filter("ok").groupBy("label", "h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("weight"), F.first("v").alias("v"))
    coded = keep.table(_encoded(reps.join(sizes, "label"), limit, recall).withColumn("num", F.monotonically_increasing_id()))
    wanted = keep.table(_wanted(_arranged(_buckets(coded, keep)), limit))
    full = wanted.join(coded.select("num", "weight", *names_of(STORED), "v"), "num").select(*names_of(BUCKET), "side", "num", "weight", *names_of(STORED), "v")
    found = keep.table(_exact(_arranged(full), limit))
    keep.drop(wanted)
    counts = found.filter("b is null").groupBy(F.col("a").alias("num")).agg(F.sum("n").alias("links"))
    comp = components(found.filter("b is not null").select("a", "b")).withColumnRenamed("node", "num")
    classes = keep.table(coded.select("num", "label", "h1", "h2", "rep", "weight").join(comp, "num", "left").withColumn("cls", F.coalesce("component_id", "num")).drop("component_id"), total)
    first = classes.groupBy("cls").agg(F.min("rep").alias("first"))
    known = keep.table(classes.join(first, "cls").join(counts, "num", "left").select("label", "h1", "h2", "first", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("links")), total)
    joined = named.select("id", "ok", F.when(F.col("ok"), F.col("label")).alias("label"), "h1", "h2").join(known, ["label", "h1", "h2"], "left")
    out = joined.select(
        F.col("id").alias("vec_id"), F.coalesce(F.when(F.col("ok"), F.col("links")), F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(F.when(F.col("ok"), F.col("first")), "id").alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
