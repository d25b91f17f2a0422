"""Operators against brute force, on small tables with hard cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sightline.llm import chains, chat, common, graph, jaccard, katz, langid, lines, mixing, pieces, quality, toxicity, vectors

W = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra map<string,int>"
HARD = [None, "", " ", "\n\n\n", "one", "a b c", "a b c\n" * 5, "x " * 3000, "É é \x85 \xa0 ok", "日本語のテキスト", "\x00 nul", "a\tb\x0bc\x0cd\re"]


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def prose(rng, n, vocab=400):
    return " ".join(rng.choice([".", "\n", ""]) + f"w{rng.randrange(vocab)}" for _ in range(n)).strip()


@pytest.fixture(scope="module")
def corpus():
    """Rows with nulls everywhere, hard texts, exact and near copies, shared lines, a repeated row and a null id."""
    rng = random.Random(1)
    texts = HARD + [prose(rng, rng.randrange(1, 120)) for _ in range(60)]
    base = prose(rng, 200, 5000)
    for k in range(12):
        w = base.split(" ")
        for _ in range(k // 2):
            w[rng.randrange(len(w))] = f"new{rng.randrange(999)}"
        texts.append(" ".join(w))
    block = "\n".join(prose(rng, 8).replace("\n", "") for _ in range(4))
    texts += [f"{prose(rng, 9)}\n{block}\n{prose(rng, 9)}" for _ in range(6)] + [texts[20], texts[20]]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "ü", None]), None if t is None else len(t), None) for i, t in enumerate(texts)]
    return rows + [rows[30], rows[31], (None, "w1 w2 w3 w4 w5", None, None, None, {"k": 1})]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_words_and_slices():
    rng = random.Random(2)
    texts = HARD + [prose(rng, 50).upper() for _ in range(40)]
    b = pa.record_batch({"i": list(range(len(texts))), "text": texts})
    seen = []
    for s in common.sliced([b], "text", 400):
        flat, starts = common.words(s.column(1), lower=True)
        seen += [flat[a:z].to_pylist() for a, z in zip(starts[:-1], starts[1:])]
    assert seen == [W.findall(lower(t or "")) for t in texts]


def test_pack_and_parts():
    x = np.array([0, 1, 255, 256, 2**40, 2**63], np.uint64)
    assert (common.unpack(common.pack(x)) == x).all() and not len(common.unpack(common.pack(np.zeros(0, np.uint64))))
    keys = np.sort(np.random.default_rng(0).integers(0, 2**64, 1000, np.uint64))
    cut = common.split_by_part(keys, 7)
    assert cut[0] == 0 and cut[-1] == 1000 and (np.diff(cut) > 80).all()


CLASHES = ["a.b", "c0", "k1", "k2", "id", "__text", "__k1", "starts", "n_lines", "n_removed", "ids", "decoded", "no", "key", "size", "tilt", "m1", "mth", "part", "block", "n", "held", "lang_pred", "lang_score", "lang_spans",
           "toxicity", "toxic_spans", "__size", "__source_size", "__target", "__copies", "__lang", "mid", "half", "log_ppl", "kept", "perplexity", "base_failed", "n_words", "component_id", "n_shingles", "rep", "num", "cls",
           "vec", "label", "v", "h1", "links", "turn_", "example_no", "formatted", "last", "head", "body", "said", "before", "train", "score", "`x`"]


def test_extra_columns_may_have_any_name(spark):
    words_ = " ".join(f"w{i}" for i in range(60))
    rows = [(1, words_, "en", "s", *range(len(CLASHES))), (2, words_ + "\nx", "de", None, *[None] * len(CLASHES)), (None, None, None, None, *[None] * len(CLASHES))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c.replace('`', '``')}` int" for c in CLASHES))
    labels = spark.createDataFrame([(1, 1, 5), (2, 0, 5)], "doc_id long, toxic int, `a.b` int")
    runs_ = {
        "encode": (pieces.encode(docs), ["ids"]),
        "decode": (pieces.decode(pieces.encode(docs)), ["ids", "decoded"]),
        "lines": (lines.dedup_lines(docs, counts=True), ["n_lines", "n_removed"]),
        "langid": (langid.identify(docs, langid.train(docs, F.lit(True))), ["lang_pred", "lang_score", "lang_spans"]),
        "toxicity": (toxicity.score(docs, toxicity.train(docs, labels, F.lit(True))), ["toxicity", "toxic_spans"]),
        "quality": (quality.judge(docs), list(quality.RESULTS)),
        "mixing": (mixing.mix(docs), list(mixing.RESULTS)),
    }
    for name, (df, results) in runs_.items():
        got = {r["doc_id"]: r for r in df.collect()}
        assert df.columns == [c for c in docs.columns if c not in results] + results, name
        assert len(got) == 3 and all(got[1][c] == i for i, c in enumerate(CLASHES) if c not in results), name
    assert mixing.mixed_rows(docs).count() >= 1
    assert jaccard.jaccard_components(docs).count() == katz.katz_scores(docs).count() == 3
    chats = docs.drop("turn", "role").withColumns({"conv_id": F.col("doc_id"), "turn": F.lit(1), "role": F.lit("assistant")})
    assert chat.digest(chat.format_chats(chats)).count() == 3
    vecs = docs.drop("label").withColumns({"vec_id": F.col("doc_id"), "embedding": F.array(F.lit(1.0), F.lit(2.0)), "label": F.lit(1)})
    assert {r.component_id for r in vectors.near_vectors(vecs).collect()} == {1, None}


# SentencePiece


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(pieces.model_bytes())


def by_chunks(m, text, size):
    s = m.normal(text)
    at = [0, *range(size, len(s), size)]
    at = [i for i in at if not (0 < i < len(s) and s[i] == s[i - 1] == pieces.SPACE)]
    at = [*at, len(s)]
    if len(s) == 0:
        return []
    spans = list(zip(at[:-1], at[1:]))
    mats = [pieces.transfer(m, s, a, b, a == 0, b == len(s)) for a, b in spans]
    found = pieces.chosen(mats)
    assert found is not None
    return [x for (a, b), (i, j) in zip(spans, found) for x in pieces.traced(m, s, a, b, a == 0, b == len(s), i, j)]


@pytest.mark.parametrize("size", [20, 33, 64])
def test_chunks_give_the_librarys_ids(model, size):
    rng = random.Random(size)
    kinds = ["the running international", "donaudampfschifffahrt", "aaaaaaaabababab", "日本語テキスト", "x=1;  y  =  2\n\n\tif", "naïve café Größe", "😀😀 ok", "supercalifragilisticexpialidocious", "0123456789" * 3, "Привет мир"]
    for _ in range(60):
        text = "".join(rng.choice(kinds) + rng.choice(["", " ", "  ", "\n"]) for _ in range(rng.randrange(1, 14)))
        assert by_chunks(model, text, size) == model.whole.encode(text), text


def test_combination_is_associative():
    rng = np.random.default_rng(3)
    a, b, c = (np.where(rng.random((3, 3)) < 0.4, -np.inf, rng.random((3, 3))) for _ in range(3))
    assert np.allclose(pieces.combined(pieces.combined(a, b), c), pieces.combined(a, pieces.combined(b, c)))


def test_states_come_down_a_tree(spark, monkeypatch, model):
    monkeypatch.setattr(pieces, "FAN", 3)
    monkeypatch.setattr(pieces, "CHUNK", 40)
    monkeypatch.setattr(pieces, "GIANT", 50)
    rng = random.Random(31)
    texts = ["".join(rng.choice(["the running", " donaudampf", "日本", "0123", "  ", "aaaaab"]) for _ in range(n)) for n in (20, 60, 300, 500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.ids for r in pieces.encode(df).collect()} == {i: model.whole.encode(t) for i, t in enumerate(texts)}
    rng2 = np.random.default_rng(3)
    mats = [np.where(rng2.random((4, 4)) < 0.9, -np.inf, 0.0) for _ in range(3)]
    assert pieces.chosen([*mats, np.full((4, 1), -np.inf)], 0, 0) is None


def test_encode_and_decode(spark, model, docs, none, monkeypatch):
    long = "international donaudampfschifffahrt 日本 " * 1500 + "q" * 3000
    rows = docs.unionByName(spark.createDataFrame([(900, long, None, None, None, None), (900, long, None, None, None, None), (901, "z" * 50_000, None, None, None, None)], DOCS))
    got = pieces.decode(pieces.encode(rows, keep=["doc_id", "text"])).collect()
    assert len(got) == rows.count()
    for r in got:
        assert (r.ids is None) == (r.text is None) and (r.text is None or r.ids == model.whole.encode(r.text) and r.decoded == r.text)
    assert pieces.encode(none).count() == 0


# Line dedup


def slow_dedup(rows):
    docs_, seen = {}, {}
    for i, t in rows:
        docs_[(-(2**63) if i is None else i, t)] = t
    order = sorted((k for k in docs_ if k[1] is not None), key=lambda k: k[0])
    for k in order:
        ls = k[1].split("\n")
        for p in range(len(ls) - 2):
            w = tuple(ls[p : p + 3])
            if any(x.strip(" \t\n\r\f\v") for x in w):
                seen.setdefault(w, []).append((k, p))
    gone = collections.defaultdict(set)
    for places in seen.values():
        first = places[0]
        for k, p in places[1:]:
            if k != first[0] or p >= first[1] + 3:
                gone[k] |= {p, p + 1, p + 2}
    return {k: t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[k]) for k, t in docs_.items()}


def test_line_dedup(docs, corpus, none):
    want = slow_dedup([(r[0], r[1]) for r in corpus])
    got = lines.dedup_lines(docs.withColumn("old", F.col("text")), counts=True).collect()
    assert len(got) == len(corpus) and sum(r.n_removed for r in got) > 10
    for r in got:
        assert r.text == want[(-(2**63) if r.doc_id is None else r.doc_id, r.old)]
    assert lines.dedup_lines(none).columns == none.columns and lines.dedup_lines(none).count() == 0


def test_a_run_of_equal_lines_keeps_three(spark):
    df = spark.createDataFrame([(1, "\n".join(["x"] * 9))], "doc_id long, text string")
    assert lines.dedup_lines(df).first().text == "x\nx\nx"


# Katz


def slow_katz(rows, order):
    """The model as dictionaries: p(context, word) by plain recursion."""
    train = [W.findall(lower(t or "")) + ["</s>"] for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 10]
    count = {k: collections.Counter() for k in range(1, order + 1)}
    for d in train:
        d = ["<s>"] * (order - 1) + d
        for i in range(order - 1, len(d)):
            for k in range(1, order + 1):
                count[k][tuple(d[i - k + 1 : i + 1])] += 1
    total = sum(count[1].values())
    nr = {k: np.bincount([min(x, 9) for x in c.values()], minlength=10) for k, c in count.items()}
    d = {k: katz.discounts(n) for k, n in nr.items()}
    after = collections.defaultdict(list)
    for k in range(2, order + 1):
        for g, r in count[k].items():
            after[g[:-1]].append((g[-1], r))

    def p(context, w):
        if not context:
            return d[1][min(count[1][w,], 6)] * count[1][w,] / total if count[1][w,] else sum((1 - d[1][r]) * r * nr[1][r] for r in range(1, 6)) / total
        seen, k = after.get(context), len(context) + 1
        if not seen:
            return p(context[1:], w)
        c, few = sum(r for _, r in seen), sum((1 - d[k][min(r, 6)]) * r for _, r in seen)
        factor, left = (1.0, few / c) if few > 0 else (c / (c + 1), 1 / (c + 1))
        r = count[k][(*context, w)]
        if r:
            return factor * d[k][min(r, 6)] * r / c
        if context not in alpha:
            alpha[context] = left / (1 - sum(p(context[1:], x) for x, _ in seen))
        return alpha[context] * p(context[1:], w)

    alpha = {}
    return count, total, after, p


@pytest.mark.parametrize("order, least", [(3, 4), (3, 40), (2, 40), (4, 40)])
def test_katz(docs, corpus, none, order, least, monkeypatch):
    monkeypatch.setattr(katz, "LEAST", least)  # the more parts, the more words are hot
    count, total, after, p = slow_katz([(r[0], r[1]) for r in corpus], order)
    got = katz.katz_scores(docs, order=order).collect()
    assert len(got) == len(corpus)
    by = collections.defaultdict(list)
    for i, t, *_ in corpus:
        ws = W.findall(lower(t or "")) + ["</s>"]
        base = sum(math.log10((count[1][w,] + 0.1) / (total + 0.1 * (len(count[1]) + 1))) for w in ws)
        full = ["<s>"] * (order - 1) + ws
        by[i].append((len(ws), sum((w,) in count[1] for w in ws), base, sum(math.log10(p(tuple(full[k : k + order - 1]), w)) for k, w in enumerate(ws))))
    have = collections.defaultdict(list)
    for r in got:
        assert r.train_tokens == total and r.held_out == (zlib.crc32((str(r.doc_id) if r.doc_id is not None else "").encode()) % 10 == 0)
        have[r.doc_id].append((r.n_tokens, r.n_known, r.base_score, r.score))
    for k in by:
        assert np.allclose(sorted(by[k]), sorted(have[k]), rtol=1e-9, atol=1e-7)
    for a in [*list(after)[:40], *list(after)[-40:], ("never seen",) * (order - 1)]:  # exactly normalised over the known words and the unknown one
        assert sum(p(a, b) for (b,) in count[1]) + p(a, "never seen") == pytest.approx(1.0)
    assert katz.katz_scores(none, order=order).count() == 0


def test_a_trained_model_scores_other_texts(docs, corpus, none, monkeypatch):
    monkeypatch.setattr(katz, "LEAST", 20)
    want = {r.doc_id: r for r in katz.katz_scores(docs.filter("doc_id < 70")).collect()}
    learn = [i for i in want if not want[i].held_out]
    model = katz.train(docs.filter(F.col("doc_id").isin(learn)).select("doc_id", "text"))
    got = katz.score(docs.filter("doc_id < 70"), model).collect()
    assert len(got) == docs.filter("doc_id < 70").count()
    for r in got:
        assert (r.n_tokens, r.n_known, r.train_tokens) == (want[r.doc_id].n_tokens, want[r.doc_id].n_known, want[r.doc_id].train_tokens)
        assert r.score == pytest.approx(want[r.doc_id].score) and r.base_score == pytest.approx(want[r.doc_id].base_score)
    assert katz.score(none, model).count() == 0 and {r.score for r in katz.score(docs, katz.train(none)).collect()} == {0.0}


def test_discounts_follow_good_turing():
    n = np.array([0, 1000, 400, 200, 120, 80, 60, 0, 0, 0])
    d = katz.discounts(n)
    common_ = 6 * 60 / 1000
    assert d[1] == pytest.approx((2 * 400 / 1000 - common_) / (1 - common_)) and d[6] == 1.0
    assert list(katz.discounts(np.array([0, 5, 0, 0, 0, 0, 0, 0]))[1:3]) == [0.5, 0.75]


# Language ID


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(0)
    starts = np.array([0, 4, 4, 5, 11])
    s = rng.normal(size=(11, 3))
    got = chains.viterbi(s, starts, 0.7)
    import itertools

    for a, b in zip(starts[:-1], starts[1:]):
        if b > a:
            best = max(itertools.product(range(3), repeat=b - a), key=lambda q: sum(s[a + i, k] for i, k in enumerate(q)) - 0.7 * sum(x != y for x, y in zip(q, q[1:])))
            assert tuple(got[a:b]) == best


def test_more_than_256_states_and_languages(spark):
    rng = np.random.default_rng(1)
    s = rng.normal(size=(40, 300))
    s[:, 299] += 9
    assert (chains.viterbi(s, np.array([0, 40]), 0.5) == 299).all()
    rows = [(i, " ".join(f"{chr(0x4E00 + 3 * i + k)}{chr(0x4E00 + 3 * i)}" for k in range(3)) * 4, f"l{i:03}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(2)
    got = langid.identify(df, langid.train(df, F.lit(True)), spans=False)
    assert got.filter("lang = lang_pred").count() >= 297


def test_language(spark, docs, none):
    en, de, ru = "the of and with this that from there where nothing", "der die das und nicht auch eine werden schon über", "это все также когда потому язык слово"
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(t.split()) for _ in range(30)), k) for i, (k, t) in enumerate([("en", en), ("de", de), ("ru", ru)] * 20)]
    m = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    test = spark.createDataFrame([(0, "there where nothing über schon nicht werden auch eine"), (1, None), (2, "123 !"), (3, "слово язык"), (4, "nothing from there")], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify(test, m).collect()}
    assert [(s.start, s.end, s.lang) for s in got[0].lang_spans] == [(0, 3, "en"), (3, 9, "de")]
    assert (got[1].lang_pred, got[2].lang_pred, got[3].lang_pred, got[4].lang_pred) == ("und", "und", "ru", "en") and got[1].lang_score == 0
    assert not m["may"][3][m["langs"].index("en")]
    hard = langid.identify(docs, m).collect()
    assert len(hard) == docs.count() and all(0 <= r.lang_score <= 1 for r in hard) and langid.identify(none, m).count() == 0
    empty = langid.train(none, F.lit(True))
    assert {r.lang_pred for r in langid.identify(docs, empty).collect()} == {"und"}


def slow_language(text, model):
    """The prediction for one text, by plain loops."""
    mask = 2**64 - 1

    def bucket(g):
        x = len(g)
        for c in g:
            x = (x * 1_114_112 + ord(c)) & mask
        for shift, k in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = ((x ^ x >> shift) * k) & mask
        return (x ^ x >> 31) % langid.BUCKETS

    def script(c):
        return next((k for a, b, k in langid.SCRIPTS if a <= ord(c) <= b), 0)

    langs, ws, rows, letters = model["langs"], W.findall(text or ""), [], []
    for w in ws:
        s = " " + w.lower() + " "
        grams = [s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)]
        score = [sum(float(model["logp"][bucket(g), j]) for g in grams if any(c.isalpha() for c in g)) for j in range(len(langs))]
        own = collections.Counter(script(c) for c in s if c.isalpha())
        letters.append(sum(own.values()))
        if own:
            top = min(k for k in own if own[k] == max(own.values()))
            score = [x if model["may"][top][j] else x - 1e6 for j, x in enumerate(score)]
        rows.append(score)
    if not sum(letters):
        return "und", 0.0
    best, back = rows[0], []
    for row in rows[1:]:
        change = max(best) - langid.PENALTY
        back.append([j if best[j] >= change else best.index(max(best)) for j in range(len(langs))])
        best = [max(best[j], change) + row[j] for j in range(len(langs))]
    state = [best.index(max(best))]
    for b in reversed(back):
        state.append(b[state[-1]])
    total = collections.Counter()
    for j, n in zip(reversed(state), letters):
        total[j] += n
    top = min(j for j in total if total[j] == max(total.values()))
    return langs[top], total[top] / sum(total.values())


def test_language_equals_plain_loops(spark, docs, corpus):
    en, de, ru = "the of and with this that from there where nothing", "der die das und nicht auch eine werden schon über", "это все также когда потому язык слово"
    rng = random.Random(14)
    rows = [(i, " ".join(rng.choice(t.split()) for _ in range(30)), k) for i, (k, t) in enumerate([("en", en), ("de", de), ("ru", ru)] * 20)]
    m = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    mixed_ = [(500 + k, " ".join(rng.choice((en + " " + de + " " + ru + " 12 -- x9").split()) for _ in range(rng.randrange(1, 60)))) for k in range(30)]
    texts = {(r[0], r[1]) for r in corpus} | set(mixed_)
    got = langid.identify(spark.createDataFrame(list(texts), "doc_id long, text string"), m, spans=False).collect()
    assert len(got) == len(texts)
    for r in got:
        want = slow_language(r.text, m)
        assert r.lang_pred == want[0] and r.lang_score == pytest.approx(want[1]), r.text


def test_rare_language_is_learned(spark):
    rows = [(i, "the of and with this that", "en") for i in range(3000)] + [(9000 + i, "og ikke det som en av", "no") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = langid.train(docs, F.lit(True), most=20)
    assert m["langs"] == ["en", "no"]
    assert langid.identify(docs.filter("lang = 'no'"), m).select("lang_pred").distinct().collect() == [("no",)]


# Chat


def test_chat(spark):
    rows = [(1, 0, "system", "be <b>&amp; [x]"), (1, 1, "user", "</s>[INST] <|end|> hi"), (1, 2, "assistant", "a|>b"), (1, 3, "user", "é日"), (1, 4, "assistant", None), (2, 0, "user", "only"), (3, 0, "assistant", "x"), (3, 1, "user", "tail"), (None, 0, None, None), (4, 0, "assistant", "p"), (4, 0, "assistant", "p")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    ex = chat.format_chats(df)
    assert {(r.conv_id, r.n) for r in ex.groupBy("conv_id").agg(F.count("*").alias("n")).collect()} == {(1, 2), (2, 1), (3, 2), (None, 1), (4, 2)}
    for r in ex.collect():
        assert not re.search(r"</s>|\[INST\]|<b>", r.formatted)
    got = {r.conv_id: r for r in chat.digest(ex).collect()}
    for c in (1, 2, 3, None, 4):
        mine = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == c))
        loss = "".join(t for _, r, t in mine if r == "assistant")
        g = got[c]
        assert g.n_turns == len(mine) and g.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in mine).encode()).hexdigest()
        assert g.loss_chars == len(loss) and g.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.digest(chat.format_chats(df.limit(0))).count() == 0
    plan = chat.digest(ex)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# Embeddings


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 40)
    rng = np.random.default_rng(5)
    rows, n = [], 0
    for label in (0, 1):
        centre = rng.normal(size=32)
        for _ in range(90):
            rows.append((n, (centre + rng.normal(0, 0.12, 32)).astype(np.float32).tolist(), label))
            n += 1
        for _ in range(60):
            rows.append((n, rng.normal(size=32).astype(np.float32).tolist(), label))
            n += 1
    rows += [(n + k, rows[3][1], 0) for k in range(5)] + [(n + 10, rows[3][1], None), (n + 11, None, 0), (n + 12, [0.0] * 32, 0), (n + 13, [float("nan")] + [1.0] * 31, 0), (n + 14, [], 0), (n + 15, [None] + [1.0] * 31, 0), (n + 16, [1.0, 2.0], 0), (n + 17, [2.0, 4.0], 0), (n + 18, [float("inf")] * 32, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in vectors.near_vectors(df).collect()}
    ok = [r for r in rows if r[1] and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    links, up = collections.Counter(), {r[0]: r[0] for r in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(ok):
        for b in ok[:i]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                u, v = np.array(a[1], float), np.array(b[1], float)
                if u @ v / math.sqrt((u @ u) * (v @ v)) >= 0.98:
                    links[a[0]] += 1
                    links[b[0]] += 1
                    up[max(top(a[0]), top(b[0]))] = min(top(a[0]), top(b[0]))
    assert len(got) == len(rows) and all(got[i].n_links <= links[i] for i in got)
    assert sum(r.n_links for r in got.values()) >= 0.95 * sum(links.values()) > 1000
    assert sum(r.component_id == top(i) for i, r in got.items()) >= 0.98 * len(rows)
    assert got[n + 11].n_links == 0 and got[n + 11].kept and not got[n + 17].kept
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(6)
    x = vectors.unit(rng.normal(size=(300, 64)))
    y = vectors.unit(x + rng.normal(0, 0.02, x.shape))
    a, b = vectors.encode(x), vectors.encode(y)
    assert a.code.nbytes + a.planes.nbytes <= x.nbytes / 4
    est, wide = vectors.estimate(a, b, 128)
    off = est - x @ y.T
    assert abs(off.mean()) < 0.003
    near = np.diag(x @ y.T) >= 0.98
    assert near.mean() > 0.5 and (np.diag(est + wide)[near] >= 0.98).all() and ((est + wide >= 0.98).mean()) < 0.01


def test_null_labels_and_ids(spark):
    rows = [(None, [1.0, 0.0], None), (None, [1.0, 0.0], 1), (1, [1.0, 0.0], None), (2, [1.0, 0.0], 1), (3, [1.0, 0.0], 1)]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(None, 0, None, True), (None, 0, None, True), (1, 0, 1, True), (2, 1, 2, True), (3, 1, 2, False)]))


def test_large_and_small_components_are_scaled(spark):
    rows = [(1, [1e200, 2e200], 0), (2, [1.0, 2.0], 0), (3, [1e-200, 2e-200], 0), (4, [-1.0, 2.0], 0)]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True)]


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(0, k) for k in range(300, 340)] + [(k, k + 1) for k in range(400, 460)]
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[max(top(a), top(b))] = min(top(a), top(b))
    got = {r.node: r.component_id for r in graph.components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()}
    assert got == {x: top(x) for x in up if top(x) != x}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_are_whole_after_any_number_of_rounds(spark, monkeypatch):
    monkeypatch.setattr(graph, "ROUNDS", 1, raising=False)
    monkeypatch.setattr(graph, "_thin", lambda batches: batches)
    chain = [(k, k + 1) for k in range(100)]
    assert {r.component_id for r in graph.components(spark.createDataFrame(chain, "a long, b long").repartition(6)).collect()} == {0}


# Jaccard


def slow_jaccard(rows, n, percent):
    sets, up = {}, {}
    for i, t in rows:
        w = W.findall(lower(t or ""))
        sets.setdefault(i, []).append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
        up[i] = i

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    flat = [(i, s) for i, ss in sets.items() for s in ss if i is not None]
    for k, (a, s) in enumerate(flat):
        for b, t in flat[:k]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                up[max(top(a), top(b))] = min(top(a), top(b))
    return {i: ([len(s) for s in sets[i]], top(i)) for i in sets}


@pytest.mark.parametrize("n, percent, block", [(4, 85, 600_000), (5, 80, 600_000), (3, 60, 500)])
def test_jaccard(docs, corpus, none, n, percent, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "CENTRES", 2)
    want = slow_jaccard([(r[0], r[1]) for r in corpus], n, percent)
    got = jaccard.jaccard_components(docs, n=n, percent=percent).collect()
    assert len(got) == len(corpus)
    for r in got:
        assert r.n_shingles in want[r.doc_id][0] and r.component_id == want[r.doc_id][1]
    assert jaccard.jaccard_components(none, n=n, percent=percent).count() == 0


def test_rows_that_share_an_id_are_all_searched(spark):
    rng = random.Random(13)
    a, b, c, d = (prose(rng, 60, 5000) for _ in range(4))
    rows = [(5, a), (5, b), (7, a), (8, b), (5, None), (9, c), (9, d), (10, d), (10, d), (11, None), (11, None), (3, b), (None, c)]
    want = slow_jaccard(rows, 5, 80)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n=5, percent=80).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id) == sorted((i, want[i][1]) for i, _ in rows if i)


def test_search_loses_no_component():
    rng = np.random.default_rng(9)
    for _ in range(40):
        m, percent = int(rng.integers(2, 30)), int(rng.choice([50, 80, 85]))
        base = rng.choice(10_000, 60, replace=False)
        sets = []
        for _ in range(m):
            s = base.copy()
            k = int(rng.integers(0, 12))
            s[rng.choice(60, k, replace=False)] = rng.integers(10_000, 99_999, k)
            sets.append(np.unique(s[: int(rng.integers(40, 61))]).astype(np.uint64))
        links = jaccard.search(np.array([len(s) for s in sets]), sets, percent)

        def comps(edges):
            up = list(range(m))

            def top(x):
                while up[x] != x:
                    x = up[x]
                return x

            for a, b in edges:
                up[max(top(a), top(b))] = min(top(a), top(b))
            return [top(i) for i in range(m)]

        every = [(a, b) for a in range(m) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= percent * len(np.union1d(sets[a], sets[b]))]
        assert comps(links) == comps(every) and set(map(frozenset, links)) <= set(map(frozenset, every))


@pytest.mark.parametrize("percent", [50, 80, 85, 95])
def test_linked_sets_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    classes = jaccard.size_classes(400, percent)
    for _ in range(400):
        n = int(rng.integers(1, 200))
        a = rng.choice(1 << 48, n, replace=False).astype(np.uint64)
        b = np.concatenate([a[int(rng.integers(0, n // 4 + 1)) :], rng.choice(1 << 48, int(rng.integers(0, n // 4 + 1))).astype(np.uint64)])
        if 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b)):
            x, y = (jaccard.signatures(np.unique(s), ~np.isin(np.unique(s), o), classes, percent) for s, o in ((a, b), (b, a)))
            assert len(np.intersect1d(x, y))


# Quality


def test_rule_counts():
    rng = random.Random(10)
    texts = HARD + [prose(rng, 60, 12) + "\n#$x\n#$x" for _ in range(30)]
    s = quality.rule_stats(pa.array(texts), *common.words(pa.array(texts)))
    for k, t in enumerate(texts):
        t = t or ""
        w, seen, dup = W.findall(t), set(), 0
        for line in t.split("\n"):
            if W.search(line):
                dup += line in seen
                seen.add(line)
        c = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        cover = {i + j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in range(3)}
        assert [int(s[x][k]) for x in quality.STATS] == [len(w), sum(map(len, w)), sum(ch in quality.MARKS for ch in t), dup, len(cover)]


def slow_kneser_ney(texts, size):
    """Dictionaries of one language: p(context, symbol), with n-grams below a share 1 / size left to backoff."""
    seqs = [w + "\0" for t in texts for w in W.findall(t)]
    top = collections.Counter(("\0" * 3 + s)[i : i + 4] for s in seqs for i in range(len(s)))
    count = {4: top}
    for o in (3, 2, 1):
        count[o] = collections.Counter(g[1:] for g in count[o + 1])
    cut, after = {}, collections.defaultdict(list)
    for o, c in count.items():
        n = collections.Counter(c.values())
        d = [0.5] * 3
        if n[1] and n[2]:
            y = n[1] / (n[1] + 2 * n[2])
            d = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 1.5]
            d = [min(max(x, 0.05), i + 0.95) for i, x in enumerate(d)]
        rare = sum(c.values()) / size
        for g, r in c.items():
            cut[g] = r if r < rare else d[min(r, 3) - 1]
            after[g[:-1]].append((r, cut[g]))

    def p(g):
        if not g:
            return 1 / 65536
        o, lower = len(g), p(g[1:])
        seen = after.get(g[:-1])
        if not seen:
            return lower
        total = sum(r for r, _ in seen)
        weight = sum(d for _, d in seen) / total
        return max(0, count[o].get(g, 0) - cut.get(g, 0)) / total + weight * lower

    return p, count


@pytest.mark.parametrize("size", [1 << 23, 1 << 10])
def test_quality_equals_dictionaries(spark, size, monkeypatch):
    monkeypatch.setattr(quality.kneser_ney, "__defaults__", (size,))
    rng = random.Random(21)
    vocab = {"en": [prose(rng, 1, 900) + rng.choice(["ing", "ed", "Straße", "."]) for _ in range(300)], "ja": ["".join(rng.choice("日本語のテキストをよむ") for _ in range(rng.randrange(1, 6))) for _ in range(200)], None: ["alpha", "beta\0", "𝒳y"]}
    rows = [(i, " ".join(rng.choice(vocab[k]) for _ in range(rng.randrange(30, 140))), k) for i, k in enumerate(["en"] * 60 + ["ja"] * 40 + [None] * 10)]
    rows += [(200, None, "en"), (201, "few", "xx"), (202, " ".join("".join(rng.choice("日本語") for _ in range(9)) + str(k) for k in range(80)), "ja"), (203, rows[0][1], "en"), (203, rows[0][1], "en"), (204, rows[1][1].replace(" ", "### "), "en")]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()
    assert len(got) == len(rows)
    for r in got:
        w = W.findall(r.text or "")
        c = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = len({i + j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in range(3)})
        assert r.base_failed == (len(w) < 50 or 100 * again > 50 * len(w))
    ppl = collections.defaultdict(list)
    for k in ("en", "ja", None):
        learned = lambda r: not r.base_failed and 100 * sum(c in quality.MARKS for c in r.text) <= sum(map(len, W.findall(r.text)))
        p, count = slow_kneser_ney([r.text for r in got if r.lang == k and learned(r)], size / len({r.lang for r in got if learned(r)}))
        for c in [*list(count[3])[:8], "", *list(count[1])[:4]]:  # sums to one over all symbols: those not seen share one probability
            seen = [g for g in count[1]]
            assert sum(p(c + x) for x in seen) + (65536 - len(seen)) * p(c + "\u2603") == pytest.approx(1.0)
        for r in got:
            if r.lang == k and r.text:
                seqs = [w + "\0" for w in W.findall(r.text)]
                want = -sum(math.log(p(("\0" * 3 + s)[i : i + 4])) for s in seqs for i in range(len(s))) / sum(map(len, seqs))
                assert math.log(r.perplexity) == pytest.approx(want, rel=1e-5)
                if not r.base_failed:
                    ppl[k].append((want, r.kept))
    for k, x in ppl.items():
        low, mid, high = np.quantile([v for v, _ in x], [0.25, 0.5, 0.75])
        half = quality.WIDE * max(0.02, (high - low) / 1.349)
        for v, kept in x:
            if abs(abs(v - mid) - half) > 0.01:
                assert kept == (abs(v - mid) <= half)
    assert sum(r.kept for r in got) > 60
    if size > 1 << 20:  # noise of the language's own characters, and symbols
        assert not any(r.kept for r in got if r.doc_id in (202, 204))


def test_the_model_is_whole_and_slices_change_nothing(spark, docs, monkeypatch):
    """No n-gram is left out, whatever the number of them is; smaller slices give the same results."""
    rows = docs.filter("length(text) > 400").limit(300).select("doc_id", "text", "lang").collect()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    held = common.Scratch(spark)
    stored, _ = quality.kneser_ney(held.table(quality.count_grams(df.withColumn("lang", F.coalesce("lang", F.lit("n"))), 4)), held)
    assert quality.kneser_ney.__defaults__ == (None,) and len(quality.slices(stored)) == 1 and len(quality.slices(stored, 500)) > 3
    whole = {r.doc_id: (r.perplexity, r.kept) for r in quality.judge(df).collect()}
    monkeypatch.setattr(quality, "SIZE", 500)
    monkeypatch.setattr(quality.slices, "__defaults__", (500,))
    assert {r.doc_id: (r.perplexity, r.kept) for r in quality.judge(df).collect()} == whole


def test_bands_reject_noise(spark, docs, none):
    rng = random.Random(12)
    good = [(i, " ".join(rng.choice(["the", "people", "river", "mountain", "walks", "slowly", "under", "green", "trees", "and", "with", "morning"]) + rng.choice(["", "s", "ly"]) for _ in range(200)), "en") for i in range(80)]
    bad = [(100, " ".join("".join(rng.choice("qxzjkvw") for _ in range(7)) for _ in range(120)), "en"), (101, "few words", "en"), (102, None, None)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(good + bad, "doc_id long, text string, lang string")).collect()}
    assert sum(got[i].kept for i in range(80)) >= 78 and not any(got[i].kept for i in (100, 101, 102)) and got[101].base_failed and not got[100].base_failed
    assert quality.judge(docs, keep=["doc_id"]).count() == docs.count() and quality.judge(none).count() == 0


# Mixing


def slow_targets(sizes, weights=(5, 2, 1), most=3.0):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > most * sizes[s]}
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(most * sizes[s] for s in over)
        open_ -= over
    return out


def test_mixing(spark, docs, corpus, none):
    rng = random.Random(13)
    rows = [(i, "w " * rng.randrange(0, 200), rng.choice(["a"] * 20 + ["b", "c", "d", None])) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = slow_targets(sizes)
    got = mixing.mix(df, keep_text=False).toPandas()
    again = mixing.mix(df.repartition(7), keep_text=False).toPandas()
    assert got.sort_values("doc_id")["__copies"].tolist() == again.sort_values("doc_id")["__copies"].tolist()
    got["source"] = got["doc_id"].map({i: s for i, _, s in rows})
    for s, g in got.groupby("source", dropna=False):
        s = None if pd.isna(s) else s
        assert g["__target"].iloc[0] == pytest.approx(want[s]) and g["__source_size"].iloc[0] == sizes[s]
        assert (g["__copies"] * g["__size"]).sum() == pytest.approx(want[s], rel=0.02)
    assert got["__copies"].max() <= 3
    mixed = mixing.mixed_rows(df)
    assert mixed.columns == df.columns and mixed.count() == got["__copies"].sum()
    hard = mixing.mix(docs)
    assert hard.count() == len(corpus) and set(docs.columns) < set(hard.columns) and mixing.mix(none).count() == 0


def test_an_unsolved_dual_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STEPS", 1)
    sizes = spark.createDataFrame([("a", s, 3, 900.0, 5310) for s in range(1, 60)], "source string, size long, n long, target double, source_size long")
    with pytest.raises(RuntimeError):
        mixing.tilts(sizes)


def test_rates_solve_the_dual(spark):
    sizes = spark.createDataFrame([("a", s, 3) for s in range(1, 60)] + [("b", 5, 2)], "source string, size long, n long")
    for goal in (0.2, 0.9, 1.0, 1.7, 2.9):
        total = {"a": 3 * sum(range(1, 60)), "b": 10}
        t = mixing.tilts(sizes.withColumn("source_size", F.when(F.col("source") == "a", total["a"]).otherwise(10)).withColumn("target", F.col("source_size") * F.lit(goal)))
        for r in t.collect():
            rows = [(s, 3) for s in range(1, 60)] if r.key == "sa" else [(5, 2)]
            got = sum(min(3.0, math.exp(r.tilt * s / r.scale)) * s * n for s, n in rows)
            assert got == pytest.approx(goal * total[r.key[1:]], rel=1e-6)


# Toxicity


def test_marginals_equal_enumeration():
    import itertools

    rng = np.random.default_rng(14)
    starts, s, trans, first = np.array([0, 3, 3, 8]), rng.normal(size=8), rng.normal(size=(2, 2)), 0.3
    p, pairs = chains.marginals(s, trans, first, starts)
    want, both = np.zeros(8), np.zeros((2, 2))
    for a, b in ((0, 3), (3, 8)):
        z = 0
        m, mm = np.zeros(b - a), np.zeros((2, 2))
        for q in itertools.product((0, 1), repeat=b - a):
            w = math.exp(first * q[0] + sum(s[a + i] * k for i, k in enumerate(q)) + sum(trans[x, y] for x, y in zip(q, q[1:])))
            z += w
            m += w * np.array(q)
            for x, y in zip(q, q[1:]):
                mm[x, y] += w
        want[a:b] = m / z
        both += mm / z
    assert np.allclose(p, want) and np.allclose(pairs, both)


def test_toxicity_scores_equal_plain_loops(docs, corpus):
    rng = np.random.default_rng(5)
    model = {"theta": rng.normal(size=toxicity.SIZE).astype(np.float32), "trans": np.log(np.array([[0.9, 0.1], [0.4, 0.6]])), "first": -1.5}
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(corpus)
    for r in got:
        ws = W.findall(r.text or "")[:400]
        if not ws or len(W.findall(r.text)) > 400:
            assert r.toxicity == 0 or len(W.findall(r.text)) > 400
            continue
        odds = [float(model["theta"][toxicity.features(pa.array([w], pa.large_string()))[0]].astype(float).sum()) for w in ws]
        t = np.exp(model["trans"])
        e = [np.array([1.0, math.exp(min(30, max(-30, x)))]) for x in odds]
        fore = [e[0] * [1.0, math.exp(model["first"])]]
        for x in e[1:]:
            v = (fore[-1] @ t) * x
            fore.append(v / v.sum())
        aft = [np.ones(2)]
        for x in reversed(e[1:]):
            v = t @ (x * aft[-1])
            aft.append(v / v.sum())
        p = [(f * b)[1] / (f * b).sum() for f, b in zip(fore, reversed(aft))]
        assert r.toxicity == pytest.approx(max(p), abs=1e-6)
        covered = {i for i, m in enumerate(re.finditer(W, r.text)) for s in r.toxic_spans if s.start <= m.start() and m.end() <= s.end}
        assert all(abs(x - toxicity.THRESHOLD) < 1e-6 or (i in covered) == (x >= toxicity.THRESHOLD) for i, x in enumerate(p))


def test_very_long_texts(spark):
    rng = random.Random(8)
    long = "\n".join(prose(rng, 40, 3000).replace("\n", " ") for _ in range(3000))
    rows = [(1, long, "en", "a"), (2, long + "\nend", "en", "b"), (3, "short text", "en", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert len(long) > 500_000
    got = {r.doc_id: r for r in lines.dedup_lines(df, counts=True).collect()}
    assert got[1].text == long and got[2].n_removed == 3000 and got[2].text == "end"
    m = langid.train(df, F.lit(True))
    assert {r.lang_pred for r in langid.identify(df, m, spans=False).collect()} == {"en"}
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(df).collect()} == {1: 1, 2: 1, 3: 3}
    assert {r.doc_id: r.base_failed for r in quality.judge(df).collect()} == {1: False, 2: False, 3: True}
    assert all(0 <= r.toxicity <= 1 for r in toxicity.score(df, {"theta": np.zeros(toxicity.SIZE, np.float32), "trans": np.zeros((2, 2)), "first": 0.0}).collect())
    assert katz.katz_scores(df).filter("score < 0").count() == 3
    assert pieces.decode(pieces.encode(df)).filter("text = decoded").count() == 3
    assert mixing.mix(df, keep_text=False).count() == 3


def test_toxicity(spark, docs, none):
    rng = random.Random(15)
    words = [f"word{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        toxic = rng.random() < 0.3
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(["Nastything!", "nastystuff", "horridone,"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (5000, 1), labels[0]], "doc_id long, toxic int")
    m = toxicity.train(df, lab, F.col("doc_id") < 400)
    got = {r.doc_id: r for r in toxicity.score(df, m).collect()}
    truth = dict(labels)
    assert all((got[i].toxicity >= 0.3) == bool(truth[i]) for i in range(600))
    for i, t in rows:
        assert [t[s.start : s.end] for s in got[i].toxic_spans] == [x for x in t.split(" ") if re.match("(?i)nasty|horrid", x)]
    hard = toxicity.score(docs, m, keep=["doc_id"]).collect()
    assert len(hard) == docs.count() and all(0 <= r.toxicity <= 1 for r in hard) and toxicity.score(none, m).count() == 0
    assert toxicity.train(df, lab.filter("toxic = 0"), F.lit(True)) is None
    assert {r.toxicity for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.score(df, m, below=0.3).count() == sum(not v for v in truth.values())
