"""SentencePiece encoding and decoding, giant documents by a max-plus parallel scan.

A text of more than GIANT characters is cut into chunks at fixed places, in the middle of words too. The state at a cut is the piece that
covers or ends at it. A chunk yields a transfer matrix in the max-plus semiring: entry [i, j] is the best weight of a way from state i at its
left cut to state j at its right cut. Matrices combine associatively, in a tree of tasks with FAN neighbours each: products go up it, the
states at cuts come down, found in each node by forward and backward products, and each chunk is then traced back on its own. For a byte-pair model the weight of a way is 0 where each two neighbouring pieces are what
the model makes of their joined text, and minus infinity otherwise: the encoding of a text is the one way with weight 0. A place whose
two characters stand together in no piece is always a boundary between pieces, so a chunk's inside, from its first to its last such
place, has one way, found by the library; only what is outside is searched. Other texts are one chunk without cuts.

Defined cases: a null text has null ids, and null when decoded; an empty text has none; a text without any boundary is searched
throughout; rows that share doc_id and text are encoded once and all get the result; other columns are kept unless named ids (or
decoded), whose place the result takes; a null doc_id is an id like others.
U+2581 stands for a space in this kind of model and decodes as one; all else comes back exactly.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, carried, modest, quoted, sliced, without_results

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Characters of a giant text and of a chunk, and how many matrices one task combines.
GIANT, CHUNK, FAN = 40_000, 16_384, 64
NO = -np.inf


class Pieces:
    """A byte-pair SentencePiece model that splits at white space, read from its bytes."""

    def __init__(self, data: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.whole = sentencepiece.SentencePieceProcessor(model_proto=data)
        proto = pb.ModelProto()
        proto.ParseFromString(data)
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        proto.normalizer_spec.add_dummy_prefix = False
        self.raw = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.vocab = {p.piece for p in proto.pieces if p.type == 1}
        self.longest = max(map(len, self.vocab))
        self.together = {p[i : i + 2] for p in self.vocab for i in range(len(p) - 1)}
        self._joins: dict[tuple[str, str], bool] = {}
        self._stable: dict[str, bool] = {}

    def normal(self, text: str) -> str:
        return (SPACE + text if self.prefix and text else text).replace(" ", SPACE)

    def stable(self, piece: str) -> bool:
        """The model makes the piece of its own text."""
        if piece not in self._stable:
            if len(self._stable) > 500_000:
                self._stable.clear()
            self._stable[piece] = len(piece) == 1 or (piece in self.vocab and self.raw.encode(piece, out_type=str) == [piece])
        return self._stable[piece]

    def joins(self, a: str, b: str) -> bool:
        """The model makes these two pieces of their joined text."""
        if a[-1] + b[0] not in self.together:
            return True
        if (a, b) not in self._joins:
            if len(self._joins) > 1_000_000:
                self._joins.clear()
            self._joins[a, b] = self.raw.encode(a + b, out_type=str) == [a, b]
        return self._joins[a, b]

    def cut(self, s: str, i: int) -> bool:
        """Between the characters before and at i there is a boundary of pieces, whatever the rest is."""
        return s[i - 1 : i + 1] not in self.together

    def starting(self, s: str, p: int, end: int) -> Iterator[int]:
        """Ends of the pieces that start at p."""
        for q in range(p + 1, min(end, p + self.longest) + 1):
            if q > p + 1 and self.cut(s, q - 1):
                break
            if self.stable(s[p:q]):
                yield q


def cuts(n: int, s: str) -> list[int]:
    """Where a text is cut: every CHUNK characters, but not inside a run of spaces, whose pieces have equal weights."""
    out, at = [0], CHUNK
    while at < n:
        while at < n and s[at] == SPACE and s[at - 1] == SPACE:
            at += 1
        if at < n:
            out.append(at)
        at += CHUNK
    return [*out, n]


def states(m: Pieces, s: str, at: int) -> list[tuple[int, int]]:
    """The pieces that cover or end at a cut, as places from it, in order."""
    out = []
    for p in range(max(0, at - m.longest), at):
        out += [(p - at, q - at) for q in m.starting(s, p, len(s)) if q >= at]
    return out


def ways(m: Pieces, s: str, entries: list[tuple[int, int]], lo: int, hi: int) -> dict[int, list[tuple[int, np.ndarray, dict]]]:
    """Pieces that ways from the entries reach, by their ends: start, weights from each entry, and what came before from each entry.

    Only pieces that start before hi; entries end at lo or later. An entry (lo, lo) is the beginning of a text.
    """
    ends: dict[int, list] = {}
    for i, (p, q) in enumerate(entries):
        w = np.full(len(entries), NO)
        w[i] = 0.0
        ends.setdefault(q, []).append((p, w, {}))
    for p in range(lo, hi):
        before = ends.get(p)
        if not before:
            continue
        for q in m.starting(s, p, len(s)):
            best, came = None, {}
            for k, (o, w, _) in enumerate(before):
                if o == p or m.joins(s[o:p], s[p:q]):
                    better = w > (best if best is not None else np.full(len(w), NO))
                    for i in np.flatnonzero(better):
                        came[int(i)] = k
                    best = w if best is None else np.maximum(best, w)
            if best is not None and best.max() > NO:
                ends.setdefault(q, []).append((p, best, came))
    return ends


def _inside(m: Pieces, s: str, a: int, b: int) -> tuple[int, int] | None:
    """The first and the last place from a on, before b, that is a boundary whatever is around it. b itself would leave its state open."""
    first = next((i for i in range(max(a, 1), b) if m.cut(s, i)), None)
    if first is None:
        return None
    return first, next(i for i in range(b - 1, first - 1, -1) if m.cut(s, i))


def transfer(m: Pieces, s: str, a: int, b: int, head: bool, tail: bool) -> np.ndarray:
    """The matrix of the chunk s[a:b], which has text before and after it in s; head and tail: it begins or ends the whole text."""
    rows = [(a, a)] if head else [(p + a, q + a) for p, q in states(m, s, a)]
    cols = [(b, b)] if tail else [(p + b, q + b) for p, q in states(m, s, b)]
    inside = _inside(m, s, a, b)

    def to(ends: dict, n: int) -> np.ndarray:
        """Weights of the ways from each of n entries to each column."""
        w = np.full((n, len(cols)), NO)
        for j, (p, q) in enumerate(cols):
            for o, x, _ in ends.get(q, ()):
                if o == p or tail:
                    w[:, j] = np.maximum(w[:, j], x)
        return w

    if inside is None:
        return to(ways(m, s, rows, a, b), len(rows))
    first, last = inside
    begin = ways(m, s, rows, a, first)
    left = reduce(np.maximum, (x for _, x, _ in begin.get(first, ())), np.full(len(rows), NO))
    return left[:, None] + to(ways(m, s, [(last, last)], last, b), 1)


def combined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product: of the chunk a followed by the chunk b."""
    return (a[:, :, None] + b[None, :, :]).max(1) if a.shape[1] else np.full((a.shape[0], b.shape[1]), NO)


def chosen(matrices: list[np.ndarray], entry: int = 0, exit_: int = 0) -> list[tuple[int, int]] | None:
    """The states at both cuts of each chunk, from forward and backward products, where those at the ends of all are known. None if not one way leads through."""
    rows, cols = matrices[0].shape[0], matrices[-1].shape[1]
    fore, aft = [np.where(np.arange(rows) == entry, 0.0, NO)[None, :]], [np.where(np.arange(cols) == exit_, 0.0, NO)[:, None]]
    for x in matrices:
        fore.append(combined(fore[-1], x))
    for x in reversed(matrices):
        aft.append(combined(x, aft[-1]))
    total = [f[0] + b[:, 0] for f, b in zip(fore, reversed(aft))]
    if any(not len(x) or x.max() == NO or (x > NO).sum() > 1 for x in total):
        return None
    at = [int(x.argmax()) for x in total]
    return list(zip(at[:-1], at[1:]))


def _trace(s: str, ends: dict, last: tuple[int, int] | None, q: int, entry: int = 0) -> list[str]:
    """The pieces of the way that ends in a piece, or at q in any, from the entry on; the entry itself is left out."""
    k = next(k for k, (p, w, _) in enumerate(ends[q]) if w[entry] > NO and (last is None or p == last[0]))
    out = []
    while True:
        p, _, came = ends[q][k]
        if not came:
            return out[::-1]
        out.append(s[p:q])
        q, k = p, came[entry]


def traced(m: Pieces, s: str, a: int, b: int, head: bool, tail: bool, i: int, j: int) -> list[int]:
    """The ids of a chunk: of the pieces after its entry state up to its exit state."""
    entry = (a, a) if head else [(p + a, q + a) for p, q in states(m, s, a)][i]
    exit_ = None if tail else [(p + b, q + b) for p, q in states(m, s, b)][j]
    end = b if tail else exit_[1]
    inside = _inside(m, s, a, b)
    if inside is None:
        return ids_of(m, _trace(s, ways(m, s, [entry], a, b), exit_, end))
    first, last = inside
    out = ids_of(m, _trace(s, ways(m, s, [entry], a, first), None, first))
    out += m.raw.encode(s[first:last]) if last > first else []
    return out + ids_of(m, _trace(s, ways(m, s, [(last, last)], last, b), exit_, end))


def ids_of(m: Pieces, pieces: list[str]) -> list[int]:
    out = []
    for p in pieces:
        out += [m.raw.piece_to_id(p)] if p in m.vocab else m.raw.encode(p)
    return out


def _matrices(pdf: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(x).reshape(r, c) for x, r, c in zip(pdf["matrix"], pdf["rows"], pdf["cols"])]


NODE, STATE = "k1 long, k2 long, no int, matrix binary, rows int, cols int", "k1 long, k2 long, no int, i int, j int"


def _states_of_all(nodes: DataFrame, keep: Scratch) -> DataFrame:
    """STATE of each chunk, from NODE of each: products of FAN neighbours go up the levels of a tree, states at their cuts come down."""

    def product(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = reduce(combined, _matrices(pdf.sort_values("no")))
        return pd.DataFrame([[*key, x.tobytes(), *x.shape]], columns=["k1", "k2", "no", "matrix", "rows", "cols"])

    def descend(key: tuple, pdf: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("no", ignore_index=True)
        i, j = above["i"].iloc[0], above["j"].iloc[0]
        pairs = (chosen(_matrices(pdf), i, j) if i >= 0 else None) or [(-1, -1)] * len(pdf)
        return pdf[["k1", "k2", "no"]].assign(i=[p[0] for p in pairs], j=[p[1] for p in pairs])

    up = F.expr(f"int(no div {FAN})").alias("up")
    levels, most = [nodes], nodes.agg(F.max("no")).first()[0] or 0
    while most:
        levels.append(keep.table(levels[-1].groupBy("k1", "k2", up).applyInPandas(product, NODE)))
        most //= FAN
    states = levels.pop().select("k1", "k2", "no", F.lit(0).alias("i"), F.lit(0).alias("j"))  # a whole text begins and ends in one state
    for below in reversed(levels):
        above = states.withColumnRenamed("no", "up").groupBy("k1", "k2", "up")
        states = keep.table(below.withColumn("up", up).groupBy("k1", "k2", "up").cogroup(above).applyInPandas(descend, STATE))
    return states


def model_bytes(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _giant_ids(giants: DataFrame, sent) -> DataFrame:
    """k1, k2, ids of long texts."""
    keep = Scratch(giants.sparkSession)
    schema = "k1 long, k2 long, no int, last boolean, body string, before int, after int"

    def chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Pieces(sent.value)
        for b in batches:
            for k1, k2, text in zip(*(b.column(i) for i in range(3))):
                s = m.normal(text.as_py())
                at = cuts(len(s), s)
                for no, (x, y) in enumerate(zip(at[:-1], at[1:])):
                    # so much around a chunk that the pieces at its cuts, and what decides them, are all there
                    lo, hi = max(0, x - m.longest - 1), min(len(s), y + m.longest + 1)
                    yield pa.record_batch(
                        [
                            pa.array([k1.as_py()], pa.int64()), pa.array([k2.as_py()], pa.int64()), pa.array([no], pa.int32()),
                            pa.array([y == len(s)]), pa.array([s[lo:hi]]), pa.array([x - lo], pa.int32()), pa.array([hi - y], pa.int32())
                        ],
                        names=["k1", "k2", "no", "last", "body", "before", "after"],
                    )

    parts = keep.table(giants.mapInArrow(chunks, schema).repartition("k1", "k2", "no"))

    def matrices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Pieces(sent.value)
        for b in batches:
            made = [transfer(m, s, x, len(s) - y, no == 0, last) for no, last, s, x, y in zip(*(b.column(i).to_pylist() for i in range(2, 7)))]
            yield pa.record_batch(
                {
                    "k1": b.column(0), "k2": b.column(1), "no": b.column(2), "matrix": pa.array([x.tobytes() for x in made], pa.binary()),
                    "rows": pa.array([x.shape[0] for x in made], pa.int32()), "cols": pa.array([x.shape[1] for x in made], pa.int32()),
                }
            )

    found = _states_of_all(keep.table(parts.mapInArrow(matrices, NODE)), keep)

    def trace(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Pieces(sent.value)
        for b in batches:
            ids = [traced(m, s, x, len(s) - y, no == 0, last, i, j) if i >= 0 else None for no, last, s, x, y, i, j in zip(*(b.column(c).to_pylist() for c in range(2, 9)))]
            yield pa.record_batch({"k1": b.column(0), "k2": b.column(1), "no": b.column(2), "ids": pa.array(ids, pa.list_(pa.int32()))})

    done = parts.join(found, ["k1", "k2", "no"]).select("k1", "k2", "no", "last", "body", "before", "after", "i", "j").mapInArrow(trace, "k1 long, k2 long, no int, ids array<int>")
    joined = F.array_sort(F.collect_list(F.struct("no", F.col("ids").alias("ids"))))
    made = keep.table(done.groupBy("k1", "k2").agg(F.flatten(F.transform(joined, lambda x: x.ids)).alias("ids")))
    left = made.filter("ids is null")
    if left.isEmpty():
        return made

    # a model whose pieces have equal weights may leave no way, or two: such a text is encoded in one piece
    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Pieces(sent.value)
        for b in batches:
            yield pa.record_batch({"k1": b.column(0), "k2": b.column(1), "ids": pa.array([m.whole.encode(t) for t in b.column(2).to_pylist()], pa.list_(pa.int32()))})

    again = giants.join(left.select("k1", "k2"), ["k1", "k2"]).select("k1", "k2", "__text").mapInArrow(whole, "k1 long, k2 long, ids array<int>")
    return made.filter("ids is not null").unionByName(again)


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str = MODEL, keep: list[str] | None = None) -> DataFrame:
    """docs (or the columns in keep) with ids: array<int>."""
    names = without_results(docs.columns if keep is None else keep, ["ids"])
    mine, back = carried(docs, names)
    modest(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model_bytes(model))  # of a fixed size
    inner = docs.select(*mine, quoted(doc_id).cast("long").alias("id"), quoted(text).alias("text"))
    schema = T.StructType(inner.schema.fields[: len(names)]).add("ids", T.ArrayType(T.IntegerType()))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Pieces(sent.value)
        for b in sliced(batches, "text", 3 << 20):
            t = b.column(len(names))
            ids = m.whole.encode(pc.fill_null(t, "").to_pylist(), num_threads=1)
            flat = np.fromiter(chain.from_iterable(ids), np.int32)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            made = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=t.is_null())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), made], names=schema.names)

    giant = F.coalesce(F.length("text") > GIANT, F.lit(False))
    short = inner.filter(~giant).drop("id").mapInArrow(work, schema)
    long = inner.filter(giant).withColumns({"k1": F.coalesce("id", F.lit(-(2**63))), "k2": F.xxhash64("text")})
    found = _giant_ids(long.select("k1", "k2", F.col("text").alias("__text")).dropDuplicates(["k1", "k2"]), sent)
    got = long.drop("text", "id").join(found, ["k1", "k2"]).select(*schema.names)
    return short.unionByName(got).select(*back, "ids")


def decode(rows: DataFrame, ids: str = "ids", model: str = MODEL) -> DataFrame:
    """rows with decoded: the text of the ids."""
    names = without_results(rows.columns, ["decoded"])
    mine, back = carried(rows, names)
    sent = rows.sparkSession.sparkContext.broadcast(model_bytes(model))
    inner = rows.select(*mine, quoted(ids).alias("ids"))
    schema = T.StructType(inner.schema.fields[: len(names)]).add("decoded", "string")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Pieces(sent.value)
        for b in batches:
            for start in range(0, b.num_rows, 500):
                x = b.slice(start, 500)
                col = x.column(len(names))
                flat, at = col.flatten().to_numpy(zero_copy_only=False).tolist(), np.cumsum(pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)).tolist()
                made = pa.array(m.whole.decode([flat[s:e] for s, e in zip([0, *at], at)], num_threads=1) if at else [], pa.string())
                made = pc.if_else(col.is_null(), None, made)
                yield pa.RecordBatch.from_arrays([*x.columns[: len(names)], made], names=schema.names)

    return inner.mapInArrow(work, schema).select(*back, "decoded")
