"""Registered queries over whole small tables, and the pipeline."""

import collections
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from sightline.llm import queries

D = "/root/testdata/sf0.001"
W = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents():
    return pd.read_parquet(f"{D}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    want, got = con.sql(queries.SQL[name]).df(), queries.QUERIES[name](spark, D).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert sorted(map(tuple, got[cols].astype(str).to_numpy())) == sorted(map(tuple, want[cols].astype(str).to_numpy()))


def test_one_query_for_each_operator():
    names = [n for n in queries.QUERIES if n != "pipeline"]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 11))


def test_round_trips(spark, documents):
    got = queries.op1_sentencepiece(spark, D).toPandas()
    assert len(got) == len(documents) and got["round_trip"].all()


def test_language_is_right_where_it_was_not_learned(spark, documents):
    got = queries.op4_language_id(spark, D).toPandas().merge(documents, on="doc_id")
    held = got[got["held_out"]]
    assert (held["held_out"] == (held["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4) == 2)).all()
    assert len(held) > 20 and (held["lang_pred"] == held["lang"]).mean() > 0.9


def test_model_beats_the_base(spark):
    got = queries.op3_katz_backoff(spark, D).toPandas()
    held = got[got["held_out"]]
    assert held["score"].sum() > held["base_score"].sum() and np.isfinite(got["score"]).all()


def test_jaccard_equals_brute_force(spark, documents):
    rows = []
    for i, t in zip(documents["doc_id"], documents["text"]):
        w = W.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        rows.append((i, {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()))
    up = {i: i for i, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (a, s) in enumerate(rows):
        for b, t in rows[:k]:
            if s and t and 85 * max(len(s), len(t)) <= 100 * min(len(s), len(t)) and 100 * len(s & t) >= 85 * len(s | t):
                up[max(top(a), top(b))] = min(top(a), top(b))
    got = queries.op7_ngram_jaccard(spark, D).collect()
    assert sorted(map(tuple, got)) == sorted((i, len(s), top(i)) for i, s in rows) and len({top(i) for i in up}) < len(rows)


def test_vectors_find_links(spark):
    e = pd.read_parquet(f"{D}/embeddings.parquet")
    got = queries.op6_embedding_dedup(spark, D).toPandas().set_index("vec_id")["n_links"]
    x = np.stack(e["embedding"]).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = (x @ x.T >= 0.98) & (e["label"].to_numpy()[:, None] == e["label"].to_numpy())
    np.fill_diagonal(near, False)
    assert got.sum() >= 0.9 * near.sum() and (got.loc[e["vec_id"]].to_numpy() <= near.sum(1)).all()


def test_clean_documents_are_kept(spark, documents):
    labels = pd.read_parquet(f"{D}/labels.parquet")
    got = queries.op8_quality_rules(spark, D).toPandas().merge(labels, on="doc_id")
    good = got[(got["quality"] == 1) & ~got["base_failed"]]
    assert len(got) and good["kept"].mean() > 0.97


def test_low_quality_is_mostly_rejected(spark):
    d = "/root/testdata/sf0.01"
    labels = pd.read_parquet(f"{d}/labels.parquet")
    got = queries.op8_quality_rules(spark, d).toPandas().merge(labels, on="doc_id")
    got = got[~got["base_failed"]]
    low, good = got[got["quality"] == 0], got[got["quality"] == 1]
    assert len(low) > 20 and low["kept"].mean() < 0.3 and good["kept"].mean() > 0.98


def test_toxic_words(spark):
    labels = pd.read_parquet(f"{D}/labels.parquet")
    got = queries.op10_toxicity(spark, D).toPandas().merge(labels, on="doc_id")
    assert got[got["toxic"] == 0]["predicted"].mean() < 0.05


def test_toxic_texts_are_found_where_they_were_not_learned(spark):
    d = "/root/testdata/sf0.1"
    labels = pd.read_parquet(f"{d}/labels.parquet")
    got = queries.op10_toxicity(spark, d).toPandas().merge(labels, on="doc_id")
    held = got[got["held_out"]]
    hits = ((held["predicted"] == 1) & (held["toxic"] == 1)).sum()
    assert hits >= 0.65 * held["toxic"].sum() > 30 and hits >= 0.85 * held["predicted"].sum()


def test_mix_stays_in_bounds(spark, documents):
    got = queries.op9_source_mixing(spark, D).toPandas().merge(documents, on="doc_id")
    assert (got["size"] == got["text"].map(lambda t: len(W.findall(t)))).all() and (got["taken"] <= 3 * got["size"]).all()
    assert got.groupby("source")["target"].first().sum() == pytest.approx(got["size"].sum())
    size, total = got.groupby("source")["size"].sum().to_dict(), float(got["size"].sum())
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size))}
    low, high = 0.0, total  # the level at which min(level * weight, 3 * size) add up to all words
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(mid * weight[s], 3 * size[s]) for s in size) < total else (low, mid)
    for s, g in got.groupby("source"):
        want = min(low * weight[s], 3 * size[s])
        assert g["target"].iloc[0] == pytest.approx(want, rel=1e-9) and abs(g["taken"].sum() - want) <= g["size"].median()


def test_only_copies_of_a_text_are_near_copies(spark):
    texts = [" ".join(f"{k}w{i}" for i in range(40)) for k in "abc"]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[1]), (3, texts[2]), (3, texts[2]), (4, None), (4, None), (4, texts[0]), (None, texts[2])]
    got = corpus_pipeline.remove_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), D).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, texts[0]), (1, texts[1]), (3, texts[2]), (4, None), (None, texts[2])]))


def test_pipeline_on_an_empty_table_and_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, ids int"
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(None, text, None, None, None, 1, 1), (1, None, None, None, None, 2, 2), (2, text, "en", "s", 9, 3, 3), (2, text, "en", "s", 9, 3, 3), (2, "other words " + text[::-1], "en", "s", 9, 4, 4)]
    for data in ([], rows):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, D)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
            if name == "n-gram Jaccard join" and data:
                assert sorted((str(r.doc_id), r["a.b"]) for r in docs.collect()) == [("1", 2), ("2", 3), ("2", 4), ("None", 1)]
        assert docs.columns == ["doc_id", "lang", "source", "ids", "n_tokens"] and (docs.count() > 0) == bool(data)


def test_pipeline(spark, documents):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    seen = collections.OrderedDict()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, D)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        docs = spark.createDataFrame(out.toPandas(), out.schema)
        seen[name] = docs.count()
    assert list(seen) == ["toxicity", "line dedup", "n-gram Jaccard join", "mixing", "SentencePiece"]
    assert seen["toxicity"] == seen["line dedup"] >= seen["n-gram Jaccard join"] and seen["mixing"] == seen["SentencePiece"] > 0
    assert corpus_pipeline.run(spark, D).count() == seen["SentencePiece"]
