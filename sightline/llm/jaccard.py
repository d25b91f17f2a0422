"""Jaccard join of documents on word n-grams: T-occurrence search with DivideSkip.

1. Every text becomes a set of hashed n-grams. Equal sets are one entry from here on.
2. A pair at or above the limit overlaps in at least T = ceil(limit * size) n-grams of either set, so it shares one of the size - T + 1
   n-grams that come first in any global order. In hash order, those of all sets are counted once: a set that shares none is alone.
3. For the sets that are left, all n-grams are counted. A set with less than T shared ones is alone. The others are ordered by rising
   frequency, and sets that share one of their first size - T + 1 n-grams come into one group. Where that joins many sets by n-grams that
   are few but occur by chance, groups fall apart again: n-grams are dealt into so many classes that a pair at the limit must agree on
   all n-grams of some classes, however its differences fall (see `signatures`), and only sets of one group that share the content of a
   class stay together. No link leaves a group.
4. Inside a group, each set is a query against an inverted index of the sets before it, in the order of size. Its L longest lists are
   put aside, the others are merged, and sets that occur T - L times or more in them are probed for in the long lists by binary search
   and kept if they reach the overlap. A set already in the query's component needs no second link, and where few are outside it they are
   compared at once.
5. A group over BLOCK n-grams is dealt out in blocks. Each block also gets a few sets of the whole group (CENTRES), which joins most of
   a cohesive group in one step; sets that are outside the group's largest component then search all its other blocks.

Defined cases: null and empty texts, and texts without words, have an empty set, link with nothing and are their own component; a text
with fewer words than n is one n-gram; rows that share a doc_id are one node, whose texts are all searched; a null doc_id has a null component and links with nothing;
other columns are ignored; an empty table gives an empty one. N-grams are counted and first matched by 64-bit hashes, and compared by
the first 48 bits of those.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, asked, coded, hashed, mixed, new_name, pack, quoted, runs, sliced, split_by_part, summed_in_parts, unpack, words
from .graph import components

#: Bits of an n-gram's hash by which sets are stored and compared after the first pass.
SHORT = 48
#: N-grams in a block of a group, sets that all blocks of a group share, sets that are counted as one block.
BLOCK, CENTRES, SETS = 150_000, 24, 2000
DOCS_A_PART = 1500
#: N-grams that make a class of a signature strong.
STRONG = 2


def needed(size: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The least overlap of a set with a partner: ceil(percent * size / 100)."""
    return -(-percent * size // 100)


def shingle_sets(text: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's n-grams, and where texts begin."""
    flat, starts = words(text, lower=True)
    ids, vocab = coded(flat)
    h = hashed(vocab)[ids] if len(vocab) else np.zeros(0, np.uint64)
    out, sizes = [], np.zeros(len(starts) - 1, np.int64)
    if len(h) >= n:
        key = mixed(h[: len(h) - n + 1])
        for j in range(1, n):
            key = mixed(key + h[j : len(h) - n + 1 + j])
    for i, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
        if b - a >= n:
            s = np.unique(key[a : b - n + 1])
        elif b > a:
            k = np.array([b - a], np.uint64)
            for j in range(a, b):
                k = mixed(k + h[j : j + 1])
            s = k
        else:
            continue
        out.append(s)
        sizes[i] = len(s)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def fingerprints(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, in two halves; 0 for an empty one."""
    full = np.diff(starts) > 0
    out = []
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        f = np.zeros(len(full), np.uint64)
        if len(flat):
            f[full] = np.add.reduceat(mixed(flat ^ np.uint64(salt)), starts[:-1][full])
        out.append(f.view(np.int64))
    return out[0], out[1]


def _first(flat: np.ndarray, starts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the n-grams that come first in each set, and their sets."""
    n = np.diff(starts)
    many = n - needed(n, percent) + (n > 0)
    at = np.arange(len(flat)) - np.repeat(starts[:-1], n)
    keep = at < np.repeat(many, n)
    return np.flatnonzero(keep), np.repeat(np.arange(len(n)), n)[keep]


def _scan(docs: DataFrame, doc_id: str, text: str, n: int, percent: int, parts: int) -> DataFrame:
    """kind 0: a document (id, a hash of its text, size, f1, f2). kind 1: first n-grams of a part's range, with one set each. kind 2: a set (f1) that shares one."""

    def shared(tok: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((fp, tok))
        tok, fp = tok[order], fp[order]
        new = np.ones(len(tok), bool)
        new[1:] = (tok[1:] != tok[:-1]) | (fp[1:] != fp[:-1])
        tok, fp = tok[new], fp[new]
        begin = np.ones(len(tok), bool)
        begin[1:] = tok[1:] != tok[:-1]
        at = np.flatnonzero(begin)
        several = np.diff(np.concatenate([at, [len(tok)]])) > 1
        mine = np.unique(fp[np.repeat(several, np.diff(np.concatenate([at, [len(tok)]])))])
        tok, fp = tok[at], fp[at]  # one set of each n-gram goes on, and whether it has met another
        cut = split_by_part(tok, parts)
        for p in np.flatnonzero(np.diff(cut)):
            s = slice(cut[p], cut[p + 1])
            yield row(1, size=int(p), tok=tok[s].tobytes(), fp=fp[s].tobytes(), met=np.packbits(several[s]).tobytes())
        if len(mine):
            yield pa.record_batch(
                [
                    pa.array(np.full(len(mine), 2, np.int32)), pa.nulls(len(mine), pa.int64()), pa.nulls(len(mine), pa.int64()), pa.array(mine),
                    *(pa.nulls(len(mine), k) for k in (pa.int64(), pa.binary(), pa.binary(), pa.binary())), pa.nulls(len(mine), pa.int64())
                ],
                names=names,
            )

    names = ["kind", "id", "size", "f1", "f2", "tok", "fp", "met", "h"]

    def row(kind: int, size: int, tok: bytes, fp: bytes, met: bytes) -> pa.RecordBatch:
        return pa.record_batch(
            [
                pa.array([kind], pa.int32()), pa.nulls(1, pa.int64()), pa.array([size], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()),
                pa.array([tok], pa.binary()), pa.array([fp], pa.binary()), pa.array([met], pa.binary()), pa.nulls(1, pa.int64())
            ],
            names=names,
        )

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toks, fps, held = [], [], 0
        for b in sliced(batches, "text"):
            flat, starts = shingle_sets(b.column(1), n)
            f1, f2 = fingerprints(flat, starts)
            m = b.num_rows
            yield pa.record_batch(
                [
                    pa.array(np.zeros(m, np.int32)), b.column(0), pa.array(np.diff(starts)), pa.array(f1), pa.array(f2),
                    *(pa.nulls(m, pa.binary()) for _ in range(3)), b.column(2)
                ],
                names=names,
            )
            at, owner = _first(flat, starts, percent)
            toks.append(flat[at])
            fps.append(f1[owner])
            held += len(at)
            if held > 1_000_000:
                yield from shared(np.concatenate(toks), np.concatenate(fps))
                toks, fps, held = [], [], 0
        if held:
            yield from shared(np.concatenate(toks), np.concatenate(fps))

    rows = docs.select(quoted(doc_id).cast("long").alias("id"), quoted(text).alias("text"), F.xxhash64(quoted(text)).alias("h"))
    return rows.mapInArrow(work, "kind int, id long, size long, f1 long, f2 long, tok binary, fp binary, met binary, h long")


def _sharing(scan: DataFrame) -> DataFrame:
    """f1 of every set that shares one of its first n-grams with another set."""

    def meet(t: pa.Table) -> pa.Table:
        tok = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in t.column("tok")])
        fp = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in t.column("fp")])
        met = np.concatenate([np.unpackbits(np.frombuffer(m.as_py(), np.uint8))[: len(x.as_py()) // 8] for x, m in zip(t.column("tok"), t.column("met"))])
        order = np.lexsort((fp, tok))
        tok, fp, met = tok[order], fp[order], met[order]
        begin = np.ones(len(tok), bool)
        begin[1:] = tok[1:] != tok[:-1]
        group = np.cumsum(begin) - 1
        low, high = np.minimum.reduceat(fp, np.flatnonzero(begin)), np.maximum.reduceat(fp, np.flatnonzero(begin))
        ok = (low != high) | (np.bincount(group, weights=met) > 0)
        return pa.table({"f1": np.unique(fp[ok[group]])})

    found = scan.filter("kind = 1").select("size", "tok", "fp", "met").groupBy("size").applyInArrow(meet, "f1 long")
    return found.unionByName(scan.filter("kind = 2").select("f1")).distinct()


def packed_sets(flat: np.ndarray, sizes: np.ndarray) -> bytes:
    """Sorted sets, one after the other, as differences inside each."""
    d = np.diff(flat, prepend=np.uint64(0))
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    d[starts] = flat[starts]
    return pack(d)


def unpacked_sets(data: bytes, sizes: np.ndarray) -> np.ndarray:
    d = unpack(data)
    total = np.cumsum(d, dtype=np.uint64)
    starts = np.cumsum(sizes) - sizes
    before = np.where(starts > 0, total[np.maximum(starts, 1) - 1], np.uint64(0)) if len(total) else np.zeros(len(sizes), np.uint64)
    return total - np.repeat(before, sizes)


def _block_sets(sets: DataFrame, n: int) -> DataFrame:
    """Sets of about SETS documents in one row: block, ids, sizes, tokens."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, toks = [], [], []

        def out() -> pa.RecordBatch:
            i, s, t = np.concatenate(ids), np.concatenate(sizes), np.concatenate(toks)
            return pa.record_batch(
                {
                    "block": pa.array([new_name()], pa.int64()), "ids": pa.array([i.tobytes()], pa.binary()),
                    "sizes": pa.array([s.tobytes()], pa.binary()), "tokens": pa.array([packed_sets(t, s)], pa.binary()),
                }
            )

        for b in sliced(batches, "text"):
            flat, starts = shingle_sets(b.column(2), n)
            same = fingerprints(flat, starts)[0] == b.column(1).to_numpy()  # of rows that share an id and a hash, the one that is meant
            size = np.diff(starts)
            ids.append(b.column(0).to_numpy()[same])
            sizes.append(size[same])
            toks.append(flat[np.repeat(same, size)] >> np.uint64(64 - SHORT))
            if sum(map(len, ids)) >= SETS or sum(map(len, toks)) > 2_000_000:
                if sum(map(len, ids)):
                    yield out()
                ids, sizes, toks = [], [], []
        if sum(map(len, ids)):
            yield out()

    return sets.mapInArrow(work, "block long, ids binary, sizes binary, tokens binary")


def _asked(blocks: DataFrame, parts: int) -> DataFrame:
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, sizes, tokens in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                u, n = np.unique(unpacked_sets(tokens.as_py(), np.frombuffer(sizes.as_py(), np.int64)), return_counts=True)
                yield asked(block, u, n, parts, SHORT)

    return blocks.select("block", "sizes", "tokens").mapInArrow(work, "block long, part int, keys binary, n binary")


def size_classes(most: int, percent: int) -> np.ndarray:
    """Where classes of sizes begin, up to one beyond `most`: partners are of one class or of two next to each other."""
    out = [1]
    while out[-1] <= most or len(out) < 4:
        out.append(100 * out[-1] // percent + 1)
    return np.array([*out, 100 * out[-1] // percent + 1])


def signatures(tokens: np.ndarray, alone: np.ndarray, classes: np.ndarray, percent: int) -> np.ndarray:
    """Hashes of which any two linked sets share one. alone: n-grams that no other set has.

    Two linked sets of sizes a and b differ in k = (a + b)(100 - percent) / (100 + percent) n-grams at most. Dealt into m > k classes by
    their hashes, at least m - k classes agree. A set deals for its own class of sizes and for the next one, so that a pair meets where
    k is bounded by the larger size. A class of less than STRONG n-grams says little, and is only named by a set with m - k such classes
    or more: where all agreeing classes of a pair are weak, both sets have so many.
    """
    own, out = int(np.searchsorted(classes, len(tokens), "right")) - 1, []
    for tag in (own, own + 1):
        k = 2 * (int(classes[tag + 1]) - 1) * (100 - percent) // (100 + percent)
        m = 1 + k + k // 4
        at = (mixed(tokens + np.uint64(tag << 50)) % np.uint64(m)).astype(np.int64)
        content, many, bad = np.zeros(m, np.uint64), np.bincount(at, minlength=m), np.zeros(m, bool)
        np.add.at(content, at, mixed(tokens + np.uint64(1)))
        bad[at[alone]] = True  # a class with an n-gram of its own agrees with nobody
        named = ~bad if (many < STRONG).sum() >= m - k else ~bad & (many >= STRONG)
        out.append(mixed(content[named] ^ mixed(np.flatnonzero(named).astype(np.uint64) + np.uint64(tag << 40))))
    return np.unique(np.concatenate(out)).view(np.int64)


def _candidates(blocks: DataFrame, counts: DataFrame, percent: int) -> DataFrame:
    """id, size, set (only n-grams that occur in other sets), first (those of them that come first by frequency), signs (signatures)."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: dict[str, list] = {"id": [], "size": [], "set": [], "first": [], "signs": []}
        parts = sorted(zip(right.column("part").to_pylist(), right.column("total")), key=lambda x: x[0])
        total = np.concatenate([unpack(t.as_py()) for _, t in parts]) if parts else np.zeros(0, np.uint64)
        for ids, sizes, tokens in zip(left.column("ids"), left.column("sizes"), left.column("tokens")):
            ids, sizes = (np.frombuffer(x.as_py(), np.int64) for x in (ids, sizes))
            tokens = unpacked_sets(tokens.as_py(), sizes)
            df = total[np.unique(tokens, return_inverse=True)[1]]
            starts = np.concatenate([[0], np.cumsum(sizes)])
            enough = np.add.reduceat(df > 1, starts[:-1]) >= needed(sizes, percent)
            classes = size_classes(int(sizes.max(initial=1)), percent)
            for i in np.flatnonzero(enough):
                a, b = starts[i], starts[i + 1]
                d, t = df[a:b], tokens[a:b]
                order = np.lexsort((t, d))[: len(d) - needed(len(d), percent) + 1]
                rows["id"].append(int(ids[i]))
                rows["size"].append(int(sizes[i]))
                rows["set"].append(t[d > 1].tobytes())
                rows["first"].append(t[order][d[order] > 1].view(np.int64))
                rows["signs"].append(signatures(t, d < 2, classes, percent))
        kinds = {"id": pa.int64(), "size": pa.int64(), "set": pa.binary(), "first": pa.list_(pa.int64()), "signs": pa.list_(pa.int64())}
        return pa.table({k: pa.array(v, kinds[k]) for k, v in rows.items()})

    return blocks.groupBy("block").cogroup(
        counts.filter("block is not null").select("block", "part", "total").groupBy("block")
    ).applyInArrow(work, "id long, size long, set binary, first array<long>, signs array<long>")


def search(sizes: np.ndarray, sets: list[np.ndarray], percent: int, root: np.ndarray | None = None, queries: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that span the components of some sets. sizes: of whole sets; sets: their n-grams that others may have.

    root: components known before, which need no link inside. queries: which sets ask (all, where None); others are only found.
    """
    m = len(sets)
    order = np.lexsort((np.arange(m), sizes))
    size = sizes[order]
    flat = np.concatenate([sets[i] for i in order])
    owner = np.repeat(np.arange(m), [len(sets[i]) for i in order])
    u, tok = np.unique(flat, return_inverse=True)
    by = np.lexsort((owner, tok))
    lists, edge = owner[by], np.concatenate([[0], np.cumsum(np.bincount(tok, minlength=len(u)))])
    have = np.bincount(owner, minlength=m)
    begin = np.concatenate([[0], np.cumsum(have)])
    lab = np.arange(m) if root is None else np.unique(root[order], return_inverse=True)[1]
    asks = np.ones(m, bool) if queries is None else queries[order]
    mark, links = np.zeros(len(u), bool), []

    def shared(c: np.ndarray) -> np.ndarray:
        """Overlaps of some sets with the query, whose n-grams are marked."""
        n = have[c]
        ends = np.cumsum(n)
        at = np.arange(int(ends[-1])) - np.repeat(ends - n, n) + np.repeat(begin[c], n)
        total = np.concatenate([[0], np.cumsum(mark[tok[at]])])
        return total[ends] - total[ends - n]

    def join(q: int, c: np.ndarray, got: np.ndarray) -> None:
        """Links the query with those of the sets that are similar enough and not yet in its component."""
        for x in c[100 * got >= percent * (size[q] + size[c] - got)].tolist():
            if lab[x] != lab[q]:
                links.append((int(order[q]), int(order[x])))
                lab[lab == max(lab[x], lab[q])] = min(lab[x], lab[q])

    for q in np.flatnonzero(asks).tolist():
        mine = tok[begin[q] : begin[q + 1]]
        n = int(size[q])
        t = int(needed(n, percent))
        # partners of a size that allows the overlap: before the query, or also after it where those may not ask
        lo = int(np.searchsorted(size, t))
        hi = q if queries is None else int(np.searchsorted(size, n * 100 // percent, "right"))
        if hi <= lo or len(mine) < t or not (lab[lo:hi] != lab[q]).any():
            continue
        mark[mine] = True
        # the last sets before the query are of its size, and in a cohesive group they are likely to link it at once
        near = np.arange(max(lo, min(q, hi) - 8), min(q, hi))
        near = near[lab[near] != lab[q]]
        if len(near):
            join(q, near, shared(near))
        a, b = edge[mine], edge[mine + 1]
        long = np.argsort(a - b, kind="stable")
        most = int(b[long[0]] - a[long[0]])
        aside = min(t - 1, int(t / (0.01 * np.log2(max(2, most)) + 1)))
        short = long[aside:]
        rest = lo + np.flatnonzero(lab[lo:hi] != lab[q])
        if len(rest) and have[rest].sum() <= (b - a)[short].sum():
            join(q, rest, shared(rest))  # fewer entries than the short lists have
        elif len(rest):
            n_short = (b - a)[short]
            ends = np.cumsum(n_short)
            merged = lists[np.arange(int(ends[-1])) - np.repeat(ends - n_short, n_short) + np.repeat(a[short], n_short)]
            times = np.bincount(merged, minlength=m)[lo:hi]  # the merge of the short lists, as counts
            who = lo + np.flatnonzero((times >= t - aside) & (lab[lo:hi] != lab[q]))
            who = who[np.argsort(-times[who - lo], kind="stable")]
            some = 16  # the likeliest first: if one links, others of its component needn't be probed for
            while len(who):
                c, who = who[:some], who[some:]
                got = times[c - lo]
                for k, i in enumerate(long[:aside]):  # probe the long lists; who can't reach the overlap any more is left out
                    at = a[i] + np.searchsorted(lists[a[i] : b[i]], c)
                    got = got + ((at < b[i]) & (lists[np.minimum(at, b[i] - 1)] == c))
                    if k % 8 == 7:
                        left = got + (aside - 1 - k) >= t
                        c, got = c[left], got[left]
                        if not len(c):
                            break
                join(q, c, got)
                who, some = who[lab[who] != lab[q]], len(who)
        mark[mine] = False
    return links


def _links(rows: DataFrame, percent: int, known: bool) -> DataFrame:
    """Rows g, id, size, role, root, set: searches each g. role 1 asks and is found, 0 is only found. The same id may come twice in a g."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, 3):
            ids, at = np.unique(t.column(3).to_numpy(), return_index=True)
            if len(ids) < 2:
                continue
            role = np.zeros(len(ids), np.int64)
            np.maximum.at(role, np.searchsorted(ids, t.column(3).to_numpy()), t.column(5).to_numpy())
            blobs = t.column(7)
            sets = [np.frombuffer(blobs[int(i)].as_py(), np.uint64) for i in at]
            found = search(t.column(4).to_numpy()[at], sets, percent, t.column(6).to_numpy()[at] if known else None, role > 0 if known else None)
            if found:
                x, y = np.array(found).T
                yield pa.record_batch({"a": pa.array(ids[x], pa.int64()), "b": pa.array(ids[y], pa.int64())})

    key = ["grp", "p", "q"]
    return rows.select(*key, "id", "size", "role", "root", "set").repartition(*key).sortWithinPartitions(*key).mapInArrow(work, "a long, b long")


def _grouped(ids: DataFrame, tokens: DataFrame) -> DataFrame:
    """id, grp: sets joined by shared tokens (id, t), each group named by its smallest id."""
    least = tokens.groupBy("t").agg(F.min("id").alias("m"), F.count("*").alias("c")).filter("c > 1").drop("c")
    links = components(tokens.join(least, "t").select(F.col("id").alias("a"), F.col("m").alias("b")).filter("a != b").distinct())
    return ids.join(links.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component_id", "id").alias("grp"))


def text_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """id, h (xxhash64 of the text), size, cls, first: one row for each row. cls numbers the texts that links join, and first is the
    smallest id that one of them has; null where the set is empty. Ids join nothing here. Two texts link when 100 * overlap >= percent * union."""
    keep = Scratch(docs.sparkSession)
    total = docs.count()
    parts = max(48, -(-total // DOCS_A_PART))
    scan = keep.table(_scan(docs, doc_id, text, n, percent, parts))
    known = keep.table(scan.filter("kind = 0").select("id", "h", "size", "f1", "f2"), total)
    # sets have numbers of their own, as rows that share an id may have several
    reps = known.filter("size > 0 and id is not null").groupBy("f1", "f2", "size").agg(F.min(F.struct("id", "h")).alias("rep"))
    reps = keep.table(reps.select("f1", "f2", "size", F.col("rep.id").alias("rep"), F.col("rep.h").alias("rep_h"), F.monotonically_increasing_id().alias("num")), total)
    asking = keep.table(reps.join(_sharing(scan), "f1", "left_semi").select("num", F.col("rep").alias("__id"), F.col("rep_h").alias("__h"), "f1"), total)
    keep.drop(scan)
    texts = docs.select(quoted(doc_id).cast("long").alias("__id"), F.xxhash64(quoted(text)).alias("__h"), quoted(text).alias("text"))
    chosen = asking.join(texts, ["__id", "__h"]).select("num", "f1", "text")
    blocks = keep.table(_block_sets(chosen, n))
    keep.free()
    counts = keep.table(summed_in_parts(_asked(blocks, parts), ranked=False))
    sets = keep.table(_candidates(blocks, counts, percent))
    keep.drop(blocks, counts)
    tokens = keep.table(sets.select("id", F.explode("first").alias("t")))
    by_first = _grouped(sets.select("id"), tokens)
    keep.drop(tokens)
    several = by_first.join(by_first.groupBy("grp").count().filter("count > 1").drop("count"), "grp")
    signs = keep.table(sets.select("id", "signs").join(several, "id").select("id", F.explode("signs").alias("s"), "grp").select("id", F.xxhash64("grp", "s").alias("t")))
    rough = _grouped(several.select("id"), signs)
    keep.drop(signs)
    grouped = keep.table(sets.select("id", "size").join(rough, "id"), total)
    sized = keep.table(
        grouped.groupBy("grp").agg(F.count("*").alias("docs"), F.sum("size").alias("all")).filter("docs > 1").select(
            "grp", F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks"),
        ),
        total,
    )
    names = grouped.join(sized, "grp").select("id", "grp", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("p"))
    dealt = keep.table(sets.select("id", "size", "set").join(names, "id"))
    keep.drop(sets, grouped)
    large = sized.filter("blocks > 1")
    one = dealt.withColumns({"q": F.lit(0), "role": F.lit(1).cast("long"), "root": F.col("id")})
    some_large = not large.isEmpty()
    if some_large:
        # the centres of a large group: least hashes of ids, CENTRES at most; each block gets them all
        hashes = dealt.filter("blocks > 1").select("grp", F.struct(F.xxhash64(F.lit(1), "id").alias("h"), "id").alias("h"))
        centres = _least(hashes, CENTRES)
        more = one.join(centres, ["grp", "id"], "left_semi").withColumn("p", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        one = one.unionByName(more)
    links = keep.table(_links(one, percent, known=False))
    if some_large:
        found = components(links)
        root = keep.table(dealt.filter("blocks > 1").join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("component_id", "id")).drop("component_id"))
        per = root.groupBy("grp", "root").count()
        main = per.groupBy("grp").agg(F.max_by("root", F.struct("count", "root")).alias("main"))
        minor = root.join(main, "grp").filter("root != main").drop("main")
        if not minor.isEmpty():
            # sets outside the largest component, in blocks q, against all blocks p
            qs = minor.groupBy("grp").agg(F.ceil(F.sum("size") / BLOCK).cast("int").alias("qs"))
            ask = minor.join(qs, "grp").withColumn(
                "q", F.pmod(F.xxhash64(F.lit(2), "id"), F.col("qs")).cast("int"),
            ).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("role", F.lit(1).cast("long")).drop("qs")
            index = root.join(qs, "grp").withColumn("q", F.explode(F.sequence(F.lit(0), F.col("qs") - 1))).withColumn("role", F.lit(0).cast("long")).drop("qs")
            links = keep.table(links.unionByName(_links(ask.unionByName(index), percent, known=True)))
    comp = components(links)
    named = keep.table(reps.join(comp.withColumnRenamed("node", "num"), "num", "left").select("f1", "f2", "size", "rep", F.coalesce("component_id", "num").alias("cls")), total)
    keep.drop(dealt)
    first = named.groupBy("cls").agg(F.min("rep").alias("first"))
    named = keep.table(named.join(first, "cls").select("f1", "f2", "size", "cls", "first"), total)
    has = F.col("id").isNotNull()
    return known.join(named, ["f1", "f2", "size"], "left").select("id", "h", "size", F.when(has, F.col("cls")).alias("cls"), F.when(has, F.col("first")).alias("first"))


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each row. Documents link where two of their texts do."""
    keep = Scratch(docs.sparkSession)
    rows = keep.table(text_classes(docs, doc_id, text, n, percent).select("id", "size", "cls", "first"), docs.count())
    # ids whose rows are of several classes, or of a class and without a set
    ids = rows.filter("id is not null").groupBy("id").agg(F.min("cls").alias("m"), F.max("cls").alias("most"), F.count("*").alias("all"), F.count("cls").alias("some"))
    several = keep.table(ids.filter("most > m or (some > 0 and all > some)").select("id", "m"), docs.count())
    if not several.isEmpty():
        joined = components(rows.join(several, "id").filter("cls != m").select(F.col("cls").alias("a"), F.col("m").alias("b")).distinct())
        rows = rows.join(several, "id", "left").withColumn("cls", F.coalesce("cls", "m")).drop("m", "first")
        rows = keep.table(rows.join(joined.withColumnRenamed("node", "cls"), "cls", "left").select("id", "size", F.coalesce("component_id", "cls").alias("cls")), docs.count())
        rows = rows.join(rows.filter("cls is not null").groupBy("cls").agg(F.min("id").alias("first")), "cls", "left")
    return rows.select(F.col("id").alias(doc_id), F.col("size").alias("n_shingles"), F.coalesce("first", "id").alias("component_id"))


def _least(hashes: DataFrame, n: int) -> DataFrame:
    """grp, id of the n least hashes of each group; a limit on hashes, from the group's size, leaves few to sort."""

    # about 4 n hashes are below the limit; should fewer than n be, there are fewer centres, which costs time at most
    sizes = hashes.groupBy("grp").agg(F.count("*").alias("m"))
    low = hashes.join(sizes, "grp").filter((F.shiftrightunsigned(F.col("h.h"), 1) / F.lit(float(2**63))) < F.lit(4.0 * n) / F.col("m")).select("grp", "h")
    return low.groupBy("grp").agg(F.slice(F.array_sort(F.collect_list("h")), 1, n).alias("hs")).select("grp", F.explode("hs").alias("h")).select("grp", F.col("h.id").alias("id"))
