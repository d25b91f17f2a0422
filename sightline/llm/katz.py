"""Katz backoff language model: scores of whole texts.

N-grams (ORDER words, ends of texts among them) are counted over the training texts. Counts r up to CUT are discounted by Good-Turing, for
each order by itself; what a context's seen words leave goes to the others in proportion to the model without the context's farthest
word, with a weight that makes each context sum to exactly 1 over the V training words and one unknown word. Below, the unigram model
gives its left mass to the unknown word. A context whose counts are all above CUT leaves 1 of c + 1. Where counts of counts allow no
Good-Turing estimate, 0.5 is taken from each count. A token's probability is found by going up from the unigram, order by order.

How it runs. Texts become blocks of word numbers, written once. Distinct words of blocks meet in ranges of word hashes, which return total
counts and numbers. Each block then sends its distinct n-grams, once each, to the part of the last word of their context: every shorter
context ends in the same word, so one part has all that the recursion needs, lower counts are sums there, and the part's row of the model
table is kept. The n-grams of a hot last word are dealt out by the word before it as well; the counts of its bigrams, and the sums of its
own context, are put together from its parts by tables of their own. Parts answer each block with the probabilities of its n-grams.
Nothing that grows with the input is sent to the driver or to all executors. A trained model is such cells too: `score` lets them meet
the blocks of any other texts.

Defined cases: a null or empty text is the end token alone; a null doc_id counts as the empty text in the held-out rule; repeated rows
are texts of their own and count as often; other columns are ignored; with nothing to train on, all words are unknown: base_score and
score are then 0; an empty table gives an empty one. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, asked, bucket, coded, hashed, mixed, new_name, pack, quoted, sliced, summed_in_parts, unpack, words

ORDER, CUT = 3, 5
#: Characters of text for each part, and parts at least.
PART, LEAST = 6_000_000, 48
END = np.uint64(0x5EED0E4D0F7E8711)
#: Numbers of words: what stands before a text, words that no training text has, and the first of all others.
START, UNKNOWN, KNOWN = 0, 1, 2
#: The block that a trained model's cells say they come from.
MODEL = -1


def discounts(n: np.ndarray, cut: int = CUT) -> np.ndarray:
    """d[r] for r up to cut (and 1 above) from n[r], how many n-grams occur r times. Katz (1987), with a smaller cut where counts are thin."""
    for k in range(cut, 0, -1):
        if all(n[r] > 0 for r in range(1, k + 2)):
            common = (k + 1) * n[k + 1] / n[1]
            d = [((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if common < 1 else 0 for r in range(1, k + 1)]
            if all(0 < x < 1 for x in d):
                return np.array([1.0, *d, *[1.0] * (cut - k + 1)])
    return np.array([1.0, *(1 - 0.5 / r for r in range(1, cut + 1)), 1.0])


class Unigrams:
    def __init__(self, n: np.ndarray, total: int):
        self.d, self.total, self.distinct = discounts(n), total, int(n[1:].sum())
        # what discounts take, over all counts up to CUT
        self.unknown = sum((1 - self.d[r]) * r * int(n[r]) for r in range(1, CUT + 1)) / total if total else 1.0
        self.scale = 1.0
        if self.unknown <= 0:
            self.unknown, self.scale = 1 / (total + 1), total / (total + 1)

    def __call__(self, c: np.ndarray) -> np.ndarray:
        """Probability of a word with training count c; 0 is the unknown word."""
        c = c.astype(np.float64)
        return np.where(c > 0, self.scale * self.d[np.minimum(c, CUT + 1).astype(int)] * c / max(1, self.total), self.unknown)


# N-grams as columns: words of the context from the last one back, then the word itself


def combined(cols: list[np.ndarray]) -> np.ndarray:
    """Whole numbers that order rows as the columns do, and are equal where rows are."""
    key = cols[0].astype(np.int64)
    for c in cols[1:]:
        c = c.astype(np.int64)
        if int(key.max(initial=0)).bit_length() + int(c.max(initial=0)).bit_length() > 63:
            key, c = (np.unique(x, return_inverse=True)[1] for x in (key, c))
        key = key << int(c.max(initial=0)).bit_length() | c
    return key


def fold(context: list[np.ndarray], w: np.ndarray, count: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Sorted distinct n-grams, packed: each context once, and each word with its count once."""
    out, new, before = [], np.zeros(len(w), bool), None
    for j, c in enumerate(context):
        new = new.copy()
        new[:1] = True
        new[1:] |= c[1:] != c[:-1]
        at = np.flatnonzero(new)
        if before is not None:
            out.append(pack(np.diff(np.append(np.searchsorted(at, before), len(at)))))
        out.append(pack(np.diff(c[at], prepend=0) if j == 0 else c[at]))
        before = at
    u, first, index = np.unique(w, return_index=True, return_inverse=True)
    return [*out, pack(np.diff(np.append(before, len(w)))), pack(np.diff(u, prepend=0)), pack(count[first]), pack(index), pack(n)]


def unfold(data: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Context columns, words, their counts, and n."""
    x = [unpack(d).astype(np.int64) for d in data]
    u, count, index, n = np.cumsum(x[-4]), x[-3], x[-2], x[-1]
    context = [np.cumsum(x[0])]
    for j in range(1, len(x) - 4, 2):
        context = [np.repeat(c, x[j]) for c in context]
        if j + 1 < len(x) - 4:
            context.append(x[j + 1])
    return context, u[index], count[index], n


def levels(context: list[np.ndarray], w: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For orders from 2 on: the order, each n-gram's context, its n-gram of that order (by numbers), and the first n-gram of each."""
    for k in range(2, len(context) + 2):
        ctx = np.unique(combined(context[: k - 1]), return_inverse=True)[1]
        if k == len(context) + 1:
            gram = first = np.arange(len(w))
        else:
            first, gram = np.unique(combined([ctx, w]), return_index=True, return_inverse=True)[1:]
        yield k, ctx, gram, first


def probabilities(context, w, count, r, one: Unigrams, d: dict[int, np.ndarray], hot: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Of distinct n-grams with training counts r, in whose part all n-grams of their last context word are.

    hot: bigrams' counts and, for each last word, the sums of its context (see context_sums), where other parts have n-grams of it too.
    """
    p = one(count)
    for k, ctx, gram, first in levels(context, w):
        rk, lower, own = np.bincount(gram, weights=r, minlength=len(first)), p[first], ctx[first]
        if k == 2 and hot is not None:
            rk, sums = hot
        else:
            sums = context_sums(rk, lower, own, int(ctx.max(initial=-1)) + 1)
        r_k, dk = rk.astype(np.int64), d[k]
        times = np.arange(1, CUT + 1)
        c = sums[:, :CUT] @ times + sums[:, CUT]
        few = sums[:, :CUT] @ ((1 - dk[1 : CUT + 1]) * times)
        some = few > 0
        factor = np.where(some | (c == 0), 1.0, c / (c + 1.0))
        left = np.where(some, few / np.maximum(c, 1), 1 / (c + 1.0))
        weight = np.where(c > 0, left / np.maximum(1e-300, 1 - sums[:, CUT + 1]), 1.0)
        seen = factor[own] * dk[np.minimum(r_k, CUT + 1)] * r_k / np.maximum(c[own], 1)
        p = np.where(r_k > 0, seen, weight[own] * lower)[gram]
    return p


def context_sums(r: np.ndarray, lower: np.ndarray, ctx: np.ndarray, n: int, share: np.ndarray | float = 1.0) -> np.ndarray:
    """For each context: how many n-grams have counts 1 to CUT, the sum of larger counts, and the lower model's sum over seen words."""
    cols = [(r == k) * share for k in range(1, CUT + 1)] + [np.where(r > CUT, r, 0) * share, np.where(r > 0, lower, 0.0) * share]
    return np.stack([np.bincount(ctx, weights=x, minlength=n) for x in cols], 1)


# Blocks of texts


def _blocks(docs: DataFrame) -> DataFrame:
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            flat, starts = words(b.column(2), lower=True)
            ids, vocab = coded(flat)
            u, at = np.unique(np.append(hashed(vocab), END), return_inverse=True)
            n, m = np.diff(starts), b.num_rows
            tok, ends = np.empty(len(ids) + m, np.int64), starts[1:] + np.arange(m)
            inner = np.ones(len(tok), bool)
            inner[ends] = False
            tok[inner], tok[ends] = at[:-1][ids], at[-1]
            held = b.column(1).to_numpy(zero_copy_only=False)
            train = np.bincount(tok[np.repeat(~held, n + 1)], minlength=len(u))
            order = np.argsort(-np.bincount(tok, minlength=len(u)), kind="stable")
            rank = np.empty(len(u), np.int64)
            rank[order] = np.arange(len(u))
            yield pa.record_batch({
                "block": pa.array([new_name()], pa.int64()), "ids": pa.array([b.column(0).to_pylist()], pa.list_(pa.int64())),
                "held": pa.array([np.packbits(held).tobytes()], pa.binary()), "sizes": pa.array([pack(n + 1)], pa.binary()),
                "tokens": pa.array([pack(rank[tok])], pa.binary()), "ranks": pa.array([pack(rank)], pa.binary()),
                "keys": pa.array([u.tobytes()], pa.binary()), "train": pa.array([train.astype(np.uint32).tobytes()], pa.binary()),
            })

    return docs.mapInArrow(work, "block long, ids array<long>, held binary, sizes binary, tokens binary, ranks binary, keys binary, train binary")


def _word_cells(blocks: DataFrame, parts: int) -> DataFrame:
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, keys, n in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                yield asked(block, np.frombuffer(keys.as_py(), np.uint64), np.frombuffer(n.as_py(), np.uint32), parts)

    return blocks.select("block", "keys", "train").mapInArrow(work, "block long, part int, keys binary, n binary")


def _numbered(blocks: DataFrame, counts: DataFrame, parts: int, one: Unigrams) -> DataFrame:
    """Blocks with their words' numbers and counts, and what each text's row needs."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:  # a trained model's cells ask nothing
            return empty
        found = sorted(zip(right.column("part").to_pylist(), right.column("total"), right.column("place")), key=lambda x: x[0])
        count = np.concatenate([unpack(t.as_py()) for _, t, _ in found])
        number = np.concatenate([np.uint64(KNOWN) + unpack(p.as_py()) * np.uint64(parts) + np.uint64(part) for part, _, p in found])
        number[count == 0] = UNKNOWN
        rank = unpack(left.column("ranks")[0].as_py()).astype(np.int64)
        by_rank = np.argsort(rank)
        count, number = count[by_rank], number[by_rank]
        tok, size = unpack(left.column("tokens")[0].as_py()).astype(np.int64), unpack(left.column("sizes")[0].as_py()).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        base = np.log10((count + 0.1) / (one.total + 0.1 * (one.distinct + 1))) if one.total else np.zeros(len(count))
        known, score = np.add.reduceat((count > 0)[tok].astype(np.int64), starts), np.add.reduceat(base[tok], starts)
        t = left.select(["block", "ids", "held", "sizes", "tokens"])
        for name, x in (("numbers", pack(number)), ("counts", pack(count)), ("known", pack(known)), ("base", score.tobytes())):
            t = t.append_column(name, pa.array([x], pa.binary()))
        return t

    names = ["held", "sizes", "tokens", "numbers", "counts", "known", "base"]
    empty = pa.table({"block": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), **{n: pa.array([], pa.binary()) for n in names}})
    schema = "block long, ids array<long>, " + ", ".join(f"{n} binary" for n in names)
    # hashes and training counts have done their work, and stay behind
    asking = blocks.select("block", "ids", "held", "sizes", "tokens", "ranks").groupBy("block")
    return asking.cogroup(counts.filter("block is not null").groupBy("block")).applyInArrow(work, schema)


@dataclass(frozen=True)
class Deal:
    """How n-grams are dealt out: parts, how many n-grams one should have, and how many texts were learned from."""

    order: int
    parts: int
    each: float
    trained: int

    def part(self, last: np.ndarray, other: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The part of an n-gram: by its context's last word, and for a hot one, in parts of their own, by another word too."""
        hot = count > self.each / 4
        spread = np.where(hot, np.minimum(self.parts, np.ceil(4 * count / self.each)), 1).astype(np.uint64)
        at = (mixed(last.astype(np.uint64) + np.uint64(1)) + mixed(other.astype(np.uint64) + np.uint64(7)) % spread) % np.uint64(self.parts)
        return at.astype(np.int64) + hot * self.parts

    def grams(self, size: np.ndarray, tok: np.ndarray, number: np.ndarray, count: np.ndarray) -> tuple:
        """A block's distinct n-grams by part: part, columns, counts of words, and each token's n-gram."""
        u, first, code = np.unique(np.append(number, START), return_index=True, return_inverse=True)
        c = np.append(count, self.trained)[first]
        c[u == UNKNOWN] = 0
        tok = code[tok]
        place = np.arange(len(tok)) - np.repeat(np.cumsum(size) - size, size)
        cols = []
        for j in range(1, self.order):
            before = np.full(len(tok), code[-1])
            before[j:] = tok[:-j] if j < len(tok) else 0
            before[place < j] = code[-1]
            cols.append(before)
        cols.append(tok)
        part = self.part(u[cols[0]], u[cols[1]], c[cols[0]])
        first, gram = np.unique(combined([part, *cols]), return_index=True, return_inverse=True)[1:]
        return part[first], [u[x[first]].astype(np.int64) for x in cols], c[tok[first]], gram


CELLS = "block long, part int, data array<binary>"


def _cell(block: int, part: int, data: list[bytes]) -> pa.RecordBatch:
    return pa.record_batch({"block": pa.array([block], pa.int64()), "part": pa.array([part], pa.int32()), "data": pa.array([data], pa.list_(pa.binary()))})


def _gram_cells(numbered: DataFrame, deal: Deal) -> DataFrame:
    """CELLS: the n-grams of a block for each part, with how often training texts have them."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                size, tok, number, count = (unpack(b.column(k)[i].as_py()).astype(np.int64) for k in (2, 3, 4, 5))
                part, cols, counts, gram = deal.grams(size, tok, number, count)
                held = np.unpackbits(np.frombuffer(b.column(1)[i].as_py(), np.uint8))[: len(size)]
                n = np.bincount(gram, weights=np.repeat(1 - held.astype(np.int64), size), minlength=len(part)).astype(np.int64)
                edges = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
                for s, e in zip(edges[:-1], edges[1:]):
                    yield _cell(b.column(0)[i].as_py(), int(part[s]), fold([c[s:e] for c in cols[:-1]], cols[-1][s:e], counts[s:e], n[s:e]))

    return numbered.select("block", "held", "sizes", "tokens", "numbers", "counts").mapInArrow(work, CELLS)


# Parts of the model


def _met(cells: DataFrame) -> DataFrame:
    """The model table. A row for each part: its distinct n-grams with their counts (data), and which of them each block has (blocks, at)."""

    def meet(t: pa.Table) -> pa.Table:
        got = [unfold(x.as_py()) for x in t.column("data")]
        cols = [np.concatenate(x) for x in zip(*([*context, w, count, n] for context, w, count, n in got))]
        cuts = np.cumsum([len(x[1]) for x in got])[:-1]
        del got
        first, index = np.unique(combined(cols[:-2]), return_index=True, return_inverse=True)[1:]
        r = np.bincount(index, weights=cols[-1], minlength=len(first)).astype(np.int64)
        data = fold([c[first] for c in cols[:-3]], cols[-3][first], cols[-2][first], r)
        blocks = t.column("block").to_pylist()
        own = [(b, pack(np.diff(x, prepend=0))) for b, x in zip(blocks, np.split(index, cuts)) if b != MODEL]
        return pa.table({
            "part": pa.array([t.column("part")[0].as_py()], pa.int32()), "data": pa.array([data], pa.list_(pa.binary())),
            "blocks": pa.array([[b for b, _ in own]], pa.list_(pa.int64())), "at": pa.array([[x for _, x in own]], pa.list_(pa.binary())),
        })

    return cells.groupBy("part").applyInArrow(meet, "part int, data array<binary>, blocks array<long>, at array<binary>")


def _counts_of_counts(met: DataFrame, deal: Deal) -> dict[int, np.ndarray]:
    """For each order, how many n-grams occur 1, 2, ... times; the bigrams of hot words are left out."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((deal.order + 1, CUT + 3))
        for b in batches:
            for part, data in zip(b.column(0).to_pylist(), b.column(1)):
                context, w, _, r = unfold(data.as_py())
                for k, _, gram, first in levels(context, w):
                    if k > 2 or part < deal.parts:
                        rk = np.bincount(gram, weights=r, minlength=len(first)).astype(np.int64)
                        seen[k] += np.bincount(np.minimum(rk, CUT + 2), minlength=CUT + 3)
        yield pa.record_batch({"k": pa.array(np.arange(2, deal.order + 1), pa.int32()), "n": pa.array(seen[2:].tolist(), pa.list_(pa.float64()))})

    rows = met.select("part", "data").mapInArrow(work, "k int, n array<double>").groupBy("k")
    rows = rows.agg(*[F.sum(F.get("n", F.lit(i))).alias(f"n{i}") for i in range(CUT + 3)]).collect()  # a row for each order
    return {k: np.zeros(CUT + 3) for k in range(2, deal.order + 1)} | {row["k"]: np.array(row[1:]) for row in rows}


def _bigrams(context: list[np.ndarray], w: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of a part's distinct bigrams, in their order: place of the first n-gram, training count in this part, hash."""
    first, gram = np.unique(combined([context[0], w]), return_index=True, return_inverse=True)[1:]
    key = mixed(mixed(context[0][first].astype(np.uint64) + np.uint64(3)) + w[first].astype(np.uint64))
    return first, np.bincount(gram, weights=r, minlength=len(first)).astype(np.int64), key


def _hot_tables(met: DataFrame, deal: Deal, one: Unigrams, keep: Scratch) -> tuple[DataFrame, np.ndarray]:
    """For parts of hot words (part, no, total, v, sums): bigrams' counts by ranges of their hashes, and words' sums. And counts of bigrams' counts."""

    def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, data in zip(b.column(0).to_pylist(), b.column(1)):
                context, w, count, r = unfold(data.as_py())
                first, n, key = _bigrams(context, w, r)
                order = np.argsort(key)
                cells = asked(part, key[order], n[order], deal.parts)
                cut = np.append(0, np.cumsum([len(unpack(x.as_py())) for x in cells.column(3)]))
                v, c = context[0][first][order], count[first][order]
                more = {k: pa.array([pack(x[s:e]) for s, e in zip(cut[:-1], cut[1:])], pa.binary()) for k, x in (("v", v), ("c", c))}
                yield pa.RecordBatch.from_arrays([*cells.columns, *more.values()], names=[*cells.schema.names, *more])

    hot = met.filter(F.col("part") >= deal.parts).select("part", "data")
    cells = keep.table(hot.mapInArrow(pairs, "block long, part int, keys binary, n binary, v binary, c binary"))
    totals = keep.table(summed_in_parts(cells.select("block", "part", "keys", "n"), ranked=False))

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        """What a part's bigrams add to the sums of their words; a bigram that several parts have counts in shares."""
        given = {p: i for i, p in enumerate(right.column("part").to_pylist())}
        out, block = [], left.column("block")[0].as_py() if left.num_rows else None
        for p, v, c in zip(left.column("part").to_pylist(), left.column("v"), left.column("c")):
            total, many = (unpack(right.column(k)[given[p]].as_py()).astype(np.int64) for k in ("total", "place"))
            u, at = np.unique(unpack(v.as_py()).astype(np.int64), return_inverse=True)
            out.append((u, context_sums(total, one(unpack(c.as_py()).astype(np.int64)), at, len(u), 1.0 / many)))
        u, at = np.unique(np.concatenate([x for x, _ in out]) if out else np.zeros(0, np.int64), return_inverse=True)
        rows = np.concatenate([x for _, x in out]) if out else np.zeros((0, CUT + 2))
        sums = np.zeros((len(u), CUT + 2))
        np.add.at(sums, at, rows)
        return pa.table({"part": pa.array([block] * len(u), pa.int32()), "v": pa.array(u), "x": pa.array(sums.tolist(), pa.list_(pa.float64()))})

    own = cells.select("block", "part", "v", "c").groupBy("block").cogroup(totals.filter("block is not null").groupBy("block"))
    own = keep.table(own.applyInArrow(add, "part int, v long, x array<double>"))
    whole = own.groupBy("v").agg(F.array(*[F.sum(F.get("x", F.lit(i))) for i in range(CUT + 2)]).alias("sums"))
    sums = own.select("part", "v").join(whole, "v")
    empty = F.lit(None)
    side = totals.filter("block is not null").select(
        F.col("block").cast("int").alias("part"), F.col("part").alias("no"), "total", empty.cast("long").alias("v"),
        empty.cast("array<double>").alias("sums"),
    )
    side = keep.table(side.unionByName(sums.select("part", empty.cast("int").alias("no"), empty.cast("binary").alias("total"), "v", "sums")))
    seen = np.zeros(CUT + 3)
    for row in totals.filter("block is null").select("total").toLocalIterator():  # 17 numbers for each part
        n = unpack(row["total"]).astype(float)
        seen[: CUT + 2] += n[: CUT + 2]
    keep.drop(cells, totals, own)
    return side, seen


def _answers(met: DataFrame, side: DataFrame, deal: Deal, one: Unigrams, d: dict[int, np.ndarray]) -> DataFrame:
    """block, part, values, index: the log10 probabilities of the n-grams that a block asked a part for, in their order."""
    schema = "block long, part int, values binary, index binary"

    def reply(part: int, data: list[bytes], blocks: list[int], at: list[bytes], hot) -> pa.Table:
        context, w, count, r = unfold(data)
        p = np.log10(probabilities(context, w, count, r, one, d, hot(context, w, r) if hot else None))
        values, index = [], []
        for x in at:
            v, i = np.unique(p[np.cumsum(unpack(x).astype(np.int64))], return_inverse=True)  # most are alike: few counts, few contexts' counts
            values.append(v.tobytes())
            index.append(pack(i))
        return pa.table({"block": pa.array(blocks, pa.int64()), "part": pa.array([part] * len(blocks), pa.int32()), "values": pa.array(values, pa.binary()), "index": pa.array(index, pa.binary())})

    def cold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in zip(*(b.column(i) for i in range(4))):
                yield from reply(*(x.as_py() for x in row), None).to_batches()

    def hot(left: pa.Table, right: pa.Table) -> pa.Table:
        def known(context, w, r):
            ranges = sorted((no, i) for i, no in enumerate(right.column("no").to_pylist()) if no is not None)
            total = np.concatenate([unpack(right.column("total")[i].as_py()).astype(np.int64) for _, i in ranges])
            key = _bigrams(context, w, r)[2]
            counts = np.empty(len(key), np.int64)
            counts[np.argsort(key)] = total
            sums = sorted((v, i) for i, v in enumerate(right.column("v").to_pylist()) if v is not None)
            sums = np.array([right.column("sums")[i].as_py() for _, i in sums])
            sums[:, : CUT + 1] = np.rint(sums[:, : CUT + 1])
            return counts, sums

        return reply(*(left.column(k)[0].as_py() for k in ("part", "data", "blocks", "at")), known)

    rows = met.filter("size(blocks) > 0").select("part", "data", "blocks", "at")
    out = rows.filter(F.col("part") < deal.parts).mapInArrow(cold, schema)
    asking = rows.filter(F.col("part") >= deal.parts)
    return out.unionByName(asking.groupBy("part").cogroup(side.join(asking.select("part"), "part", "left_semi").groupBy("part")).applyInArrow(hot, schema))


def _scored(numbered: DataFrame, answers: DataFrame, deal: Deal, total: int) -> DataFrame:
    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        size, tok, number, count, known = (unpack(left.column(k)[0].as_py()).astype(np.int64) for k in ("sizes", "tokens", "numbers", "counts", "known"))
        m, gram = len(size), deal.grams(size, tok, number, count)[3]
        got = sorted(zip(right.column("part").to_pylist(), right.column("values"), right.column("index")), key=lambda x: x[0])
        p = np.concatenate([np.frombuffer(v.as_py())[unpack(i.as_py()).astype(np.int64)] for _, v, i in got])
        score = np.add.reduceat(p[gram], np.cumsum(size) - size) if total else np.zeros(m)
        return pa.table({
            "doc_id": pa.array(left.column("ids")[0].as_py(), pa.int64()), "held_out": pa.array(np.unpackbits(np.frombuffer(left.column("held")[0].as_py(), np.uint8))[:m].astype(bool)),
            "n_tokens": pa.array(size), "n_known": pa.array(known), "train_tokens": pa.array(np.full(m, total, np.int64)),
            "base_score": pa.array(np.frombuffer(left.column("base")[0].as_py())), "score": pa.array(score),
        })

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return numbered.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, schema)


@dataclass
class Model:
    """A trained model: tables of words by ranges of hashes and of n-grams by context, and a few numbers."""

    deal: Deal
    one: Unigrams
    d: dict[int, np.ndarray]
    words: DataFrame
    grams: DataFrame


def _word_counts(blocks: DataFrame, parts: int, keep: Scratch, known: DataFrame | None = None) -> DataFrame:
    cells = _word_cells(blocks, parts)
    return keep.table(summed_in_parts(cells if known is None else cells.unionByName(known)))


def _unigrams(counts: DataFrame) -> Unigrams:
    seen, total = np.zeros(17, np.int64), 0
    for row in counts.filter("block is null").select("total", "place").toLocalIterator():  # 18 numbers for each part
        seen += unpack(row["total"]).astype(np.int64)
        total += int(unpack(row["place"])[0])
    return Unigrams(seen, total)


def _rows(docs: DataFrame, doc_id: str, text: str, held) -> DataFrame:
    return docs.select(quoted(doc_id).cast("long").alias("id"), held.alias("held"), quoted(text).alias("text"))


def _parts(rows: DataFrame) -> int:
    return max(LEAST, -(-(rows.agg(F.sum(F.length("text"))).first()[0] or 0) // PART))


def _vocabulary(blocks: DataFrame, parts: int) -> DataFrame:
    """Words and their counts as cells of a trained model, one for each part."""

    def one_row(t: pa.Table) -> pa.Table:
        keys = [np.cumsum(unpack(x.as_py()), dtype=np.uint64) for x in t.column("keys")]
        u, at = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate([unpack(x.as_py()) for x in t.column("n")]), minlength=len(u)).astype(np.int64)
        return pa.table({
            "block": pa.array([MODEL], pa.int64()), "part": pa.array([t.column("part")[0].as_py()], pa.int32()),
            "keys": pa.array([pack(np.diff(u, prepend=np.uint64(0)))], pa.binary()), "n": pa.array([pack(n)], pa.binary()),
        })

    return _word_cells(blocks, parts).groupBy("part").applyInArrow(one_row, "block long, part int, keys binary, n binary")


def _learned(rows: DataFrame, order: int, keep: Scratch, vocabulary: bool = False) -> tuple:
    parts = _parts(rows)
    trained = rows.filter("not held").count()
    blocks = keep.table(_blocks(rows))
    counts = _word_counts(blocks, parts, keep)
    one = _unigrams(counts)
    numbered = keep.table(_numbered(blocks, counts, parts, one))
    known = keep.table(_vocabulary(blocks, parts)) if vocabulary else None
    keep.drop(blocks, counts)
    deal = Deal(order, parts, max(1.0, one.total / parts), trained)
    met = keep.table(_met(_gram_cells(numbered, deal)))
    side, bigrams = _hot_tables(met, deal, one, keep)
    seen = _counts_of_counts(met, deal)
    seen[2] += bigrams
    return known, numbered, deal, one, {k: discounts(n) for k, n in seen.items()}, met, side


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER) -> Model:
    """A model of all texts, in tables of the shared folder."""
    keep = Scratch(docs.sparkSession)
    known, numbered, deal, one, d, met, side = _learned(_rows(docs, doc_id, text, F.lit(False)), order, keep, vocabulary=True)
    grams = keep.table(met.select(F.lit(MODEL).cast("long").alias("block"), "part", "data"))
    keep.drop(numbered, met, side)
    return Model(deal, one, d, known, grams)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """katz_scores of any texts by a trained model; held_out is true for all."""
    keep = Scratch(docs.sparkSession)
    blocks = keep.table(_blocks(_rows(docs, doc_id, text, F.lit(True))))
    counts = _word_counts(blocks, model.deal.parts, keep, model.words)
    numbered = keep.table(_numbered(blocks, counts.filter(F.col("block") != MODEL), model.deal.parts, model.one))
    keep.drop(blocks, counts)
    met = keep.table(_met(_gram_cells(numbered, model.deal).unionByName(model.grams)))
    side, _ = _hot_tables(met, model.deal, model.one, keep)
    answers = keep.table(_answers(met, side, model.deal, model.one, model.d))
    keep.drop(met, side)
    return _scored(numbered, answers, model.deal, model.one.total)


def katz_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 10, held: int = 0, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: log10 of each whole text's probability.

    Learns from the texts whose crc32(doc_id) modulo folds isn't held, and asks the model for all of them in the same pass over n-grams.
    """
    keep = Scratch(docs.sparkSession)
    rows = _rows(docs, doc_id, text, F.coalesce(bucket(quoted(doc_id), folds), F.lit(0)) == held)
    _, numbered, deal, one, d, met, side = _learned(rows, order, keep)
    answers = keep.table(_answers(met, side, deal, one, d))
    keep.drop(met, side)
    return _scored(numbered, answers, deal, one.total)
