"""Language identification that labels spans of mixed-language text.

Script ranges narrow a word's candidates to the languages that the training texts write in that script; character n-grams of the word
score the candidates; Viterbi with a penalty for each switch labels the words, and runs of a label are spans. A text's language is the
one with most letters, and the score is its share of them.

Learned from about `most` labelled texts, an equal share for each language (all texts of a language that has fewer), chosen by a hash of
their ids; a text whose language is null is never used.
Defined cases: a null text, or one without letters, is `und` with score 0 and has no spans; ties go to the language that sorts first;
with nothing to learn from everything is `und`; rows are handled one by one, so repeated rows and ids don't matter; other columns are kept,
but for those named like a result, whose place it takes.
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

from .chains import viterbi
from .common import carried, coded, mixed, modest, quoted, sliced, without_results, words

#: First and last code points of scripts. What is outside all is script 0; 1 is Latin.
SCRIPTS = (
    (0x0041, 0x024F, 1), (0x1E00, 0x1EFF, 1), (0x0370, 0x03FF, 2), (0x0400, 0x052F, 3), (0x0530, 0x058F, 4), (0x0590, 0x05FF, 5),
    (0x0600, 0x06FF, 6), (0x0900, 0x097F, 7), (0x0E00, 0x0E7F, 8), (0x10A0, 0x10FF, 9), (0x1100, 0x11FF, 10), (0xAC00, 0xD7AF, 10),
    (0x3040, 0x30FF, 11), (0x3400, 0x4DBF, 12), (0x4E00, 0x9FFF, 12),
)
BUCKETS = 1 << 16
SAMPLE = 20_000
PENALTY = 12.0
UNKNOWN = "und"
#: A language writes in a script if so many of its letters are in it.
SHARE = 0.001


def _points(vocab: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, with a space before and after each, and where words begin (one more than words)."""
    flat = " " + "  ".join(vocab.to_pylist()) + " "
    points = np.frombuffer(flat.encode("utf-32-le"), np.uint32)
    n = pc.utf8_length(vocab).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    return points, np.concatenate([[0], np.cumsum(n)])


def _letters(points: np.ndarray) -> np.ndarray:
    u, at = np.unique(points, return_inverse=True)
    return np.fromiter((chr(x).isalpha() for x in u), bool, len(u))[at]


def _scripts(points: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points), np.int64)
    for a, b, k in SCRIPTS:
        out[(points >= a) & (points <= b)] = k
    return out


def _features(points: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of one to three characters that have a letter, and each one's word."""
    owner = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    letter, p = _letters(points), points.astype(np.uint64)
    f, w = [], []
    for n in (1, 2, 3):
        m = len(p) - n + 1
        if m <= 0:
            continue
        key, has = np.full(m, n, np.uint64), np.zeros(m, bool)
        for j in range(n):
            key = key * np.uint64(1_114_112) + p[j : j + m]
            has |= letter[j : j + m]
        ok = has & (owner[:m] == owner[n - 1 : n - 1 + m])
        f.append((mixed(key[ok]) % np.uint64(BUCKETS)).astype(np.int64))
        w.append(owner[:m][ok])
    return (np.concatenate(f), np.concatenate(w)) if f else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _word_facts(text: pa.Array):
    flat, starts = words(text)
    ids, vocab = coded(flat)
    vocab = pc.utf8_lower(vocab)
    points, begin = _points(vocab) if len(vocab) else (np.zeros(0, np.uint32), np.zeros(1, np.int64))
    letter = _letters(points)
    script = np.where(letter, _scripts(points), -1)
    per = np.zeros((len(vocab), 13), np.int64)
    owner = np.repeat(np.arange(len(vocab)), np.diff(begin))
    np.add.at(per, (owner[letter], script[letter]), 1)
    return ids, starts, vocab, points, begin, per


def train(docs: DataFrame, usable: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", most: int = SAMPLE) -> dict:
    """langs, log probabilities (BUCKETS rows, a column for each language) and which languages each script may be in."""
    rows = docs.filter(usable & quoted(lang).isNotNull() & quoted(text).isNotNull())
    rows = rows.select(quoted(text).alias("text"), quoted(lang).cast("string").alias("lang"), quoted(doc_id).alias("id"))
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # a row for each language, as in the model
    part = {name: math.ceil(min(1.0, most / (len(sizes) * n)) * 1_000_000) for name, n in sizes.items()}
    limit = F.create_map(*(F.lit(x) for kv in part.items() for x in kv))[F.col("lang")] if part else F.lit(0)
    sample = rows.filter(F.pmod(F.xxhash64(F.lit("langid"), "id"), F.lit(1_000_000)) < limit).select("text", "lang")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for b in sliced(batches, "text"):
            names = np.array(b.column(1).to_pylist(), object)
            ids, starts, vocab, points, begin, per = _word_facts(b.column(0))
            f, w = _features(points, begin)
            for name in set(names):
                mine = np.repeat(names == name, np.diff(starts))
                times = np.bincount(ids[mine], minlength=len(vocab))
                have = seen.setdefault(name, np.zeros(BUCKETS + 13, np.int64))
                have[:BUCKETS] += np.bincount(f, weights=times[w], minlength=BUCKETS).astype(np.int64)
                have[BUCKETS:] += times @ per
        for name, have in seen.items():
            at = np.flatnonzero(have)
            yield pa.record_batch({"lang": pa.array([name] * len(at), pa.string()), "f": pa.array(at, pa.int32()), "n": pa.array(have[at], pa.int64())})

    got = sample.mapInArrow(count, "lang string, f int, n long").groupBy("lang", "f").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique())
    table = np.zeros((BUCKETS + 13, len(langs)))
    table[got["f"].to_numpy(), got["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy().astype(int)] = got["n"]
    grams, letters = table[:BUCKETS] + 0.5, table[BUCKETS:]
    may = letters > SHARE * np.maximum(1, letters.sum(0))
    may |= ~may.any(1)[:, None]  # a script not seen in training leaves all candidates
    return {"langs": langs, "logp": np.log(grams / grams.sum(0)).astype(np.float32) if langs else np.zeros((BUCKETS, 0), np.float32), "may": may}


def label_words(text: pa.Array, model: dict, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's language, by number (-1 without a model), its letters, and where texts begin."""
    ids, starts, vocab, points, begin, per = _word_facts(text)
    f, w = _features(points, begin)
    k = len(model["langs"])
    scores = np.stack([np.bincount(w, weights=model["logp"][f, j], minlength=len(vocab)) for j in range(k)], 1) if len(vocab) and k else np.zeros((len(vocab), k))
    letters = per.sum(1)
    if k:
        scores = np.where(model["may"][per.argmax(1)] | (letters == 0)[:, None], scores, scores - 1e6)
        state = viterbi(scores[ids].astype(np.float64), starts, penalty)
    else:
        state = np.full(len(ids), -1, np.int32)
    return state, letters[ids], starts


def spans_of(state: np.ndarray, letters: np.ndarray, starts: np.ndarray, langs: list[str]) -> list[list[dict]]:
    """For each text, runs of words of one language: first and past-last word."""
    out = []
    for a, b in zip(starts[:-1], starts[1:]):
        cut = np.flatnonzero(np.diff(state[a:b])) + 1
        edges = np.concatenate([[0], cut, [b - a]]) if b > a else np.zeros(1, np.int64)
        out.append([{"start": int(i), "end": int(j), "lang": langs[state[a + i]]} for i, j in zip(edges[:-1], edges[1:]) if letters[a + i : a + j].any()] if langs else [])
    return out


def identify(docs: DataFrame, model: dict, text: str = "text", spans: bool = True) -> DataFrame:
    """docs with lang_pred, lang_score and, if asked, lang_spans. The model has a fixed number of buckets, and goes out as a broadcast."""
    modest(docs.sparkSession)
    kept = docs.sparkSession.sparkContext.broadcast(model)
    results = ["lang_pred", "lang_score", *(["lang_spans"] if spans else [])]
    names = without_results(docs.columns, results)
    mine, back = carried(docs, names)
    inner = docs.select(*mine, quoted(text).alias("text"))
    schema = T.StructType(inner.schema.fields[:-1]).add("lang_pred", "string").add("lang_score", "double")
    if spans:
        schema = schema.add("lang_spans", T.ArrayType(T.StructType().add("start", "long").add("end", "long").add("lang", "string")))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = kept.value
        langs = m["langs"]
        for b in sliced(batches, "text"):
            state, letters, starts = label_words(b.column(len(names)), m)
            owner = np.repeat(np.arange(b.num_rows), np.diff(starts))
            share = np.stack([np.bincount(owner[state == j], weights=letters[state == j], minlength=b.num_rows) for j in range(len(langs))], 1) if langs else np.zeros((b.num_rows, 1))
            total, top = share.sum(1), share.argmax(1)
            pred = [langs[j] if n else UNKNOWN for j, n in zip(top, total)]
            cols = [b.column(i) for i in range(len(names))] + [pa.array(pred, pa.string()), pa.array(np.where(total > 0, share.max(1) / np.maximum(total, 1), 0.0))]
            if spans:
                cols.append(pa.array(spans_of(state, letters, starts, langs), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return inner.mapInArrow(work, schema).select(*back, *results)
