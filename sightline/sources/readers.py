"""Readers of the stored entities. Schemas are declared; nothing is inferred."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import RECORD_KIND, RECORD_VERSION, REGION, STORE_KIND, STORE_READABLE, schema


def _json(spark: SparkSession, path: str, name: str, recording_id: int | None, number: str | None = None) -> DataFrame:
    """Rows of one recording, numbered as they come; with recording_id None, of many recordings that name themselves and keep their numbers."""
    if recording_id is None:
        return spark.read.schema(schema(name)).option("mode", "FAILFAST").json(path)
    fields = [f for f in schema(name) if f.name not in ("recording_id", number)]
    s = type(schema(name))(fields)
    df = spark.read.schema(s).option("mode", "FAILFAST").json(path)
    if number:
        df = df.withColumn(number, F.monotonically_increasing_id())  # rises with a file's lines, which is all that order means
    return df.withColumn("recording_id", F.lit(recording_id).cast("long")).select(*[c.name for c in schema(name)])


def read_gaze(spark: SparkSession, path: str, recording_id: int = 0) -> DataFrame:
    """Raw directions: a header that names the schema and a readable version, and one object a line. A missing quality is null.

    Appended files come in any order, so the header may be in any of them; one that isn't readable is an error wherever it is.
    obs_no rises inside a file.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "")
    kind, version = F.get_json_object("value", "$.schema"), F.get_json_object("value", "$.version").cast("int")
    readable = F.coalesce(kind.endswith(STORE_KIND) & version.isin(*STORE_READABLE), F.lit(False))
    problem = f"{path} isn't a readable store of gaze directions"
    head = lines.filter(kind.isNotNull()).select(readable.alias("ok")).limit(1).collect()
    if not head or not head[0]["ok"]:
        raise ValueError(problem)
    isbody = F.when(kind.isNull(), True).when(readable, False).otherwise(F.raise_error(F.lit(problem)).cast("boolean"))
    body = lines.filter(isbody).withColumn("obs_no", F.monotonically_increasing_id())
    s = type(schema("gaze_directions"))([f for f in schema("gaze_directions") if f.name not in ("recording_id", "obs_no")])
    rows = body.select("obs_no", F.from_json("value", s, {"mode": "FAILFAST"}).alias("r")).select("obs_no", "r.*")
    return rows.withColumn("recording_id", F.lit(recording_id).cast("long")).select(*[c.name for c in schema("gaze_directions")])


def read_layouts(spark: SparkSession, path: str, recording_id: int | None = 0) -> DataFrame:
    return _json(spark, path, "layouts", recording_id, "layout_no").withColumn("layout_no", F.col("layout_no").cast("int"))


def read_points(spark: SparkSession, path: str, recording_id: int | None = 0) -> DataFrame:
    return _json(spark, path, "gaze_points", recording_id, "obs_no")


def read_attributions(spark: SparkSession, path: str, recording_id: int | None = 0) -> DataFrame:
    return _json(spark, path, "attributions", recording_id)


def read_events(spark: SparkSession, path: str, recording_id: int | None = 0) -> DataFrame:
    return _json(spark, path, "gaze_events", recording_id, "event_no").withColumn("reason", F.coalesce("reason", F.lit("")))


def read_speaker_segments(spark: SparkSession, path: str, recording_id: int | None = 0) -> DataFrame:
    return _json(spark, path, "speaker_segments", recording_id, "segment_no")


def read_truth(spark: SparkSession, path: str, recording_id: int | None = 0) -> DataFrame:
    return _json(spark, path, "truth", recording_id, "truth_no")


def read_manifest(spark: SparkSession, path: str, recording_id: int = 0) -> DataFrame:
    """Layouts of each viewer, in the document's order, tagged manifest."""
    doc = spark.read.schema(
        f"viewers map<string, array<struct<start:double, end:double, start_time:double, end_time:double, regions:array<{REGION}>>>>"
    ).option("multiLine", True).option("mode", "FAILFAST").json(path)
    rows = doc.select(F.explode("viewers").alias("viewer_id", "ls")).select("viewer_id", F.posexplode("ls").alias("layout_no", "l"))
    return rows.select(
        F.lit(recording_id).cast("long").alias("recording_id"), "viewer_id", "layout_no",
        F.coalesce("l.start_time", "l.start", F.lit(0.0)).alias("start_time"), F.coalesce("l.end_time", "l.end").alias("end_time"),
        F.lit("manifest").alias("source"), "l.regions"
    )


def read_record(spark: SparkSession, path: str) -> dict:
    """A run record: one document, read where the path's file system is."""
    text = "".join(r["value"] + "\n" for r in spark.read.option("wholetext", True).text(path).collect())
    doc = json.loads(text)
    if not str(doc.get("schema")).endswith(RECORD_KIND) or doc.get("version") != RECORD_VERSION:
        raise ValueError(f"{path} isn't a readable run record")
    return {k: doc.get(k) for k in ("schema", "version", "provenance", "config", "coverage", "diagnostics", "degradations", "identity_breaks", "timing", "results", "evaluation", "calibrations")}


#: Bytes up to which a file is read as one value; larger ones are read in pieces of PIECE bytes.
WHOLE, PIECE = 1 << 30, 8 << 20


def _streamed(batches):
    """path, length -> path, length, sha256, of files of any size."""
    import hashlib
    import re

    from pyarrow import fs

    for pdf in batches:
        found = []
        for path in pdf["path"]:
            where, name = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
            digest = hashlib.sha256()
            with where.open_input_stream(name) as f:
                while piece := f.read(PIECE):
                    digest.update(piece)
            found.append(digest.hexdigest())
        yield pdf[["path", "length"]].assign(sha256=found)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of files. One value holds 2 GB at most, so the content of larger files is streamed. Spark doesn't list empty ones."""
    files = spark.read.format("binaryFile").load(path)
    small = files.filter(F.col("length") <= WHOLE).select("path", "length", F.sha2("content", 256).alias("sha256"))
    return small.unionByName(files.filter(F.col("length") > WHOLE).select("path", "length").mapInPandas(_streamed, "path string, length bigint, sha256 string"))
