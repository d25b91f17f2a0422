"""Toxicity with a linear-chain conditional random field over words.

Fit: from about `most` toxic and CLEAN * `most` other labelled texts (of `longest` code points at most), chosen by a hash of their ids,
words of toxic texts are labelled by features - the word, its first 4, 5 and 6 letters - that set toxic texts apart beyond chance; all other words are clean. The
field's weights (hashed features of a word, and transitions) are fitted to these word labels by gradient steps on the exact
conditional likelihood. Scoring: forward-backward gives each word its probability; a text's score is the largest, and runs of words
with probability >= THRESHOLD are the offending spans, as offsets in code points.

Defined cases: null and empty texts score 0 and have no spans; with no toxic or no clean text to learn from, all scores are 0; rows are
handled one by one, so ties and repeated rows and ids don't matter; an id labelled twice counts as toxic if any says so; other columns are
kept, but for those named like a result, whose place it takes.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chains import marginals
from .common import carried, coded, hashed, mixed, modest, quoted, sliced, without_results, words

THRESHOLD = 0.3
SAMPLE, CLEAN, LONGEST = 1500, 3, 12_000
SIZE = 1 << 18
#: What is cut from both ends of a word.
EDGES = ".,;:!?\"'()[]{}<>*#$%&|-_/\\"
#: Columns of features: the word, and its first 4 to 6 letters. Those that may label words in training: all.
HEADS, LABELLING = (4, 5, 6), (0, 1, 2, 3)
LEAST, STEPS, RATE, DECAY = 3, 25, 0.6, 1e-3


def features(vocab: pa.Array) -> np.ndarray:
    """For each word a row of hashed features; 0 where the word is too short for one."""
    bare = pc.utf8_trim(pc.utf8_lower(vocab), EDGES)
    n = pc.utf8_length(bare).to_numpy(zero_copy_only=False).astype(np.int64)
    p = np.frombuffer("".join(bare.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.uint64)
    begin = np.cumsum(n) - n
    out = np.zeros((len(bare), 1 + len(HEADS)), np.int64)
    fold = lambda key, col: (mixed(key + np.uint64(col << 56)) % np.uint64(SIZE - 1)).astype(np.int64) + 1
    out[:, 0] = np.where(n > 0, fold(hashed(bare) >> np.uint64(8), 0), 0)
    for c, k in enumerate(HEADS, 1):
        ok = np.flatnonzero(n >= k)
        key = np.zeros(len(ok), np.uint64)
        for j in range(k):
            key = key * np.uint64(1_000_003) + p[begin[ok] + j]
        out[ok, c] = fold(key >> np.uint64(8), c)
    return out


def _markers(ids: np.ndarray, starts: np.ndarray, feats: np.ndarray, toxic: np.ndarray, odds: float) -> np.ndarray:
    """Which features set toxic texts apart: nine of ten texts with one are toxic, and that is beyond chance.

    The one in most texts is taken, what it explains is left out, and so on, while one explains LEAST more: words that only stand next to
    a marker, as in copies of one text, are not taken. odds: how many clean texts each clean one of the sample stands for, next to a toxic one.
    """
    owner = np.repeat(np.arange(len(toxic)), np.diff(starts))
    pair = np.unique(owner * (len(feats) + 1) + ids)
    owner, word = pair // (len(feats) + 1), pair % (len(feats) + 1)
    f = feats[word][:, list(LABELLING)]
    pair = np.unique((owner[:, None] * SIZE + f)[f > 0])
    owner, f = pair // SIZE, pair % SIZE
    clean = np.bincount(f[toxic[owner] == 0], minlength=SIZE)
    owner, f = (x[toxic[owner] > 0] for x in (owner, f))
    rate, out = toxic.mean(), np.zeros(SIZE, bool)
    k = np.bincount(f, minlength=SIZE)
    n = k + clean
    q = np.clip(k / np.maximum(n, 1), 1e-9, 1 - 1e-9)
    beyond = n * (q * np.log(q / rate) + (1 - q) * np.log((1 - q) / (1 - rate)))
    ok = (k >= 0.9 * (k + odds * clean)) & (q > rate) & (beyond >= math.log(100 * max(1, int((k > 1).sum()))))
    while len(f):
        k = np.bincount(f, minlength=SIZE)
        k = np.where(ok & (k >= 0.9 * (k + odds * clean)), k, 0)
        best = int(np.argmax(k))
        if k[best] < LEAST:
            break
        out[best] = True
        rest = ~np.isin(owner, owner[f == best])
        owner, f = owner[rest], f[rest]
    return out


def fit(texts: pa.Array, toxic: np.ndarray, odds: float = 1.0) -> dict | None:
    """Weights from whole texts and their labels (0 or 1)."""
    if not len(toxic) or toxic.min() == toxic.max():
        return None
    flat, starts = words(texts)
    ids, vocab = coded(flat)
    feats = features(vocab)
    marker = _markers(ids, starts, feats, toxic, odds)
    hot = marker[feats].any(1)
    y = hot[ids] & np.repeat(toxic > 0, np.diff(starts))
    theta, grown = np.zeros(SIZE), np.full(SIZE, 1e-6)
    rate = max(y.mean(), 1e-6)
    first = math.log(rate / (1 - rate))
    trans, tgrown = np.log(np.array([[1 - rate, rate], [0.5, 0.5]])), np.full((2, 2), 1e-6)
    nxt = np.ones(len(ids), bool)
    nxt[starts[1:][np.diff(starts) > 0] - 1] = False
    i = np.flatnonzero(nxt)
    seen = np.bincount(y[i] * 2 + y[i + 1], minlength=4).reshape(2, 2)
    for _ in range(STEPS):
        p, pairs = marginals(theta[feats].sum(1)[ids], trans, first, starts)
        word = np.bincount(ids, weights=y - p, minlength=len(vocab))
        g = np.bincount(feats.ravel(), weights=np.repeat(word, feats.shape[1]), minlength=SIZE) - DECAY * theta
        g[0] = 0
        grown += g * g
        theta += RATE * g / np.sqrt(grown)
        t = seen - pairs
        tgrown += t * t
        trans += 0.2 * t / np.sqrt(tgrown)
        trans -= np.log(np.exp(trans).sum(1, keepdims=True))
    return {"theta": theta.astype(np.float32), "trans": trans, "first": first}


def train(docs: DataFrame, labels: DataFrame, usable: Column, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", most: int = SAMPLE, longest: int = LONGEST) -> dict | None:
    known = labels.filter(usable & quoted(label).isNotNull() & quoted(doc_id).isNotNull()).groupBy(quoted(doc_id).alias("id")).agg(F.max(quoted(label).cast("int")).alias("__y"))
    n = {r["__y"]: r["count"] for r in known.groupBy("__y").count().collect()}
    shares = {y: min(1.0, (most if y else CLEAN * most) / c) for y, c in n.items()}
    part = F.coalesce(*[F.when(F.col("__y") == y, x) for y, x in shares.items()], F.lit(0.0)) if n else F.lit(0.0)
    chosen = known.filter(F.pmod(F.xxhash64(F.lit("toxicity"), "id"), F.lit(1_000_000)) < part * 1_000_000)
    # (1 + CLEAN) * most ids at about: a bounded side, and a bounded group, which one task fits so that the driver needn't hold it
    texts = docs.filter(F.length(quoted(text)) <= longest).select(quoted(doc_id).alias("id"), quoted(text).alias("__text"))
    sample = texts.join(F.broadcast(chosen), "id").select(F.lit(0).alias("__g"), "__y", "__text")
    odds = shares.get(1, 1.0) / shares.get(0, 1.0) if n else 1.0

    def work(t: pa.Table) -> pa.Table:
        t = t.sort_by([("__y", "ascending"), ("__text", "ascending")])  # sums come out alike, however the rows come in
        m = fit(t.column("__text").combine_chunks(), t.column("__y").to_numpy(), odds)
        rows = [] if m is None else [m]
        return pa.table(
            {
                "theta": pa.array([m["theta"].tobytes() for m in rows], pa.binary()),
                "trans": pa.array([m["trans"].ravel().tolist() for m in rows], pa.list_(pa.float64())),
                "first": pa.array([m["first"] for m in rows], pa.float64()),
            }
        )

    got = sample.groupBy("__g").applyInArrow(work, "theta binary, trans array<double>, first double").collect()
    return {"theta": np.frombuffer(got[0]["theta"], np.float32), "trans": np.array(got[0]["trans"]).reshape(2, 2), "first": got[0]["first"]} if got else None


def word_scores(text: pa.Array, model: dict | None) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Each word's probability, where texts begin, and all words."""
    flat, starts = words(text)
    if model is None:
        return np.zeros(len(flat)), starts, flat
    ids, vocab = coded(flat)
    score = model["theta"][features(vocab)].sum(1).astype(float) if len(vocab) else np.zeros(0)
    return marginals(score[ids], model["trans"], model["first"], starts)[0], starts, flat


def _spans(text: str, p: np.ndarray) -> list[dict]:
    """Runs of words at or over THRESHOLD: offsets in code points."""
    import re

    out, at = [], np.flatnonzero(p >= THRESHOLD)
    if not len(at):
        return out
    places = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
        out.append({"start": places[run[0]][0], "end": places[run[-1]][1], "p": float(p[run].max())})
    return out


def score(docs: DataFrame, model: dict | None, text: str = "text", spans: bool = True, keep: list[str] | None = None, below: float | None = None) -> DataFrame:
    """docs (or the columns in keep) with toxicity and, if asked, toxic_spans. below: only texts that score less, and no more columns."""
    results = [] if below is not None else ["toxicity", *(["toxic_spans"] if spans else [])]
    names = without_results(docs.columns if keep is None else keep, results)
    mine, back = carried(docs, names)
    modest(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    inner = docs.select(*mine, quoted(text).alias("text"))
    schema = T.StructType(inner.schema.fields[:-1])
    if below is None:
        schema = schema.add("toxicity", "double")
        if spans:
            schema = schema.add("toxic_spans", T.ArrayType(T.StructType().add("start", "long").add("end", "long").add("p", "double")))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            t = b.column(len(names))
            p, starts, _ = word_scores(t, sent.value)
            n = np.diff(starts)
            top = np.zeros(b.num_rows)
            if len(p):
                full = n > 0
                top[full] = np.maximum.reduceat(p, starts[:-1][full])
            cols = [b.column(i) for i in range(len(names))]
            if below is not None:
                yield pa.RecordBatch.from_arrays(cols, names=schema.names).filter(pa.array(top < below))
                continue
            cols.append(pa.array(top))
            if spans:
                found = [_spans(x.as_py(), p[a:z]) if s >= THRESHOLD else [] for x, a, z, s in zip(t, starts[:-1], starts[1:], top)]
                cols.append(pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return inner.mapInArrow(work, schema).select(*back, *results)
