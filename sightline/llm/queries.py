"""One query for each operator, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, jaccard, katz, langid, lines, mixing, pieces, quality, toxicity, vectors
from .common import bucket, table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = docs.select("doc_id", "text", F.sha2(F.replace(F.coalesce("text", F.lit("")), F.lit(pieces.SPACE), F.lit(" ")), 256).alias("sha"))
    made = pieces.decode(pieces.encode(kept, keep=["doc_id", "sha"]))
    return made.select(
        "doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"),
        (F.sha2(F.coalesce("decoded", F.lit("")), 256) == F.col("sha")).alias("round_trip"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    return made.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op3_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.katz_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _held_out() -> F.Column:
    return F.coalesce(bucket(F.col("doc_id"), 4) == 2, F.lit(False))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs, ~_held_out())
    made = langid.identify(docs.select("doc_id", "text", _held_out().alias("held_out")), model, spans=False)
    return made.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digest(chat.format_chats(turns.unionByName(probe)))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), n=4, percent=85)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), keep=["doc_id"])


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep_text=False)
    return made.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__copies") * F.col("__size")).alias("taken"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~_held_out())
    made = toxicity.score(docs.withColumn("held_out", _held_out()), model, spans=False, keep=["doc_id", "held_out"])
    return made.select("doc_id", "held_out", F.col("toxicity").alias("score"), (F.col("toxicity") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_line_dedup": op2_line_dedup,
    "op3_katz_backoff": op3_katz_backoff,
    "op4_language_id": op4_language_id,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_quality_rules": op8_quality_rules,
    "op9_source_mixing": op9_source_mixing,
    "op10_toxicity": op10_toxicity,
    "pipeline": pipeline,
}

LINE_DEDUP_SQL = r"""
with l as (select doc_id, string_split(text, chr(10)) as ls from documents),
s as (select doc_id, ls, unnest(range(1, len(ls) - 1)) as i from l where len(ls) >= 3),
w as (select doc_id, i, ls[i] || chr(10) || ls[i+1] || chr(10) || ls[i+2] as win from s),
v as (select * from w where regexp_replace(win, '[ \t\n\r\f\v]+', '', 'g') <> ''),
f as (select win, min({'d': doc_id, 'i': i}) as first from v group by win having count(*) > 1),
c as (select distinct doc_id, i + k as i from v join f using (win), (values (0), (1), (2)) t(k) where doc_id <> first.d or i >= first.i + 3),
g as (select doc_id, list(i) as gone, count(*) as n from c group by doc_id)
select l.doc_id, coalesce(len(ls), 0)::bigint as n_lines, coalesce(n, 0)::bigint as n_removed,
  sha256(case when gone is null then d.text else array_to_string([ls[x] for x in range(1, len(ls) + 1) if not list_contains(gone, x)], chr(10)) end) as text_sha256
from l join documents d using (doc_id) left join g using (doc_id)
"""

CHAT_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select * from (values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) p(conv_id, turn, role, text)),
e as (
  select *, row_number() over w as n, lead(1) over w is null as last,
    length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '[', '&#91;'))
    + length(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '[', '&#91;')) + 11 as chars
  from t window w as (partition by conv_id order by turn, role, text)),
x as (select *, sum(chars) over (partition by conv_id order by n) as upto from e)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by n)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by n) filter (role = 'assistant'), '')) as loss_sha256,
  sum(case when role = 'assistant' or last then upto else 0 end)::bigint as formatted_chars
from x group by conv_id
"""

SQL = {"op2_line_dedup": LINE_DEDUP_SQL, "op5_chat_formatting": CHAT_SQL}
