"""Documents through five stages: toxic ones go, repeated lines go, near copies go, sources are mixed, the rest is encoded.

Each stage reads what its predecessor wrote, and all but the last return the columns of documents.

Defined cases: a null text isn't toxic, has no lines to lose and is nobody's copy, but has no words, so the mix never takes it; a null
doc_id is an id of its own for lines, and such rows are kept by the near-copy stage; of rows that share an id, those with different texts
are different documents, and those with the same text one, of which the near-copy stage keeps one; an empty table stays empty, with the same
columns; columns beyond those of documents are carried along, whatever their names are, until the last stage, which returns doc_id, lang,
source, ids and n_tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import jaccard, lines, mixing, pieces, toxicity
from sightline.llm.common import Scratch, bucket, carried, quoted, table


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; learns from labels outside the held-out fold."""
    usable = ~F.coalesce(bucket(F.col("doc_id"), 4) == 2, F.lit(False))
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), usable)
    return toxicity.score(docs, model, below=toxicity.THRESHOLD)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that later occurrences of a three-line window cover are gone; n_chars follows."""
    made = lines.dedup_lines(docs)
    return made.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else made


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of texts that five-word shingles join at 0.8 or more; rows that repeat an id and its text go too."""
    found = jaccard.text_classes(docs.select("doc_id", "text"), n=5, percent=80).filter("id is not null")
    one = found.filter("cls is not null and id = first").groupBy("cls").agg(F.min(F.struct("id", "h")).alias("k")).select(F.col("k.id").alias("id"), F.col("k.h").alias("h"))
    first = one.unionByName(found.filter("cls is null").select("id", "h").distinct())
    mine, back = carried(docs, docs.columns)
    rows = docs.select(*mine, F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"))
    return rows.join(first, ["id", "h"]).dropDuplicates(["id", "h"]).select(*back).unionByName(docs.filter("doc_id is null").select(*(quoted(c) for c in docs.columns)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_rows(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and their number, for each document."""
    return pieces.encode(docs, keep=["doc_id", "lang", "source"]).withColumn("n_tokens", F.coalesce(F.size("ids"), F.lit(0)).cast("long"))


STAGES = [
    ("toxicity", remove_toxic),
    ("line dedup", remove_repeated_lines),
    ("n-gram Jaccard join", remove_near_copies),
    ("mixing", mix_sources),
    ("SentencePiece", encode_pieces),
]

#: SQL can't express the learned first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, keep = table(spark, sf_dir, "documents"), Scratch(spark)
    for _, stage in STAGES:
        docs = keep.table(stage(spark, docs, sf_dir))
    return docs
