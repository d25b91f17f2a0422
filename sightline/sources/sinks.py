"""Sinks: Parquet as the native form, JSON lines and CSV for exchange."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import STORE_SCHEMA, STORE_VERSION


def scratch(spark: SparkSession) -> str:
    """A new folder that all machines share: under spark.checkpoint.dir, or on this machine where it is the only one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="sightline-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def write_table(df: DataFrame, path: str, append: bool = False) -> None:
    """Parquet, partitioned by recording, so that a reader of one recording reads no other."""
    df.write.mode("append" if append else "overwrite").partitionBy("recording_id").parquet(path)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """One object a line, nulls kept."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", False).json(path)


def write_gaze(df: DataFrame, path: str) -> None:
    """The raw store of one recording as lines: a header, then directions in order."""
    rows = df.select("obs_no", F.to_json(F.struct("ts", "person_id", "yaw", "pitch", "head_pose", "confidence", "quality"), {"ignoreNullFields": "false"}).alias("value"))
    head = df.sparkSession.createDataFrame([(-1, json.dumps({"schema": STORE_SCHEMA, "version": STORE_VERSION}))], "obs_no bigint, value string")
    head.unionByName(rows).orderBy("obs_no").select("value").coalesce(1).write.mode("overwrite").text(path)


def append_gaze(df: DataFrame, path: str) -> None:
    """More directions for a store that is there; a header comes only with the first ones."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return write_gaze(df, path)
    df.select(F.to_json(F.struct("ts", "person_id", "yaw", "pitch", "head_pose", "confidence", "quality"), {"ignoreNullFields": "false"}).alias("value")).write.mode("append").text(path)


def manifest_document(layouts: DataFrame) -> DataFrame:
    """One row, value: the manifest of all viewers' layouts as JSON."""
    per = layouts.groupBy("viewer_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("layout_no", "start_time", "end_time", "regions"))),
            lambda l: F.struct(l.start_time.alias("start_time"), l.end_time.alias("end_time"), l.regions.alias("regions")),
        ).alias("ls")
    )
    doc = per.groupBy().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("viewer_id", "ls")))).alias("viewers"))
    return doc.select(F.to_json(F.struct("viewers"), {"ignoreNullFields": "false"}).alias("value"))


def save_manifest(layouts: DataFrame, path: str) -> None:
    manifest_document(layouts).coalesce(1).write.mode("overwrite").text(path)


def event_rows(events: DataFrame, keep: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """The seven columns of the CSV, numbers as text with three decimals, after the columns in keep."""
    three = lambda c: F.format_string("%.3f", c)
    return events.orderBy(*keep, "viewer_id", "start_time").select(
        *keep, F.col("viewer_id").alias("viewer"), "target", three(F.col("start_time")).alias("start"), three(F.col("end_time")).alias("end"),
        three(F.col("end_time") - F.col("start_time")).alias("duration"), three(F.col("confidence")).alias("confidence"), "reason"
    )


def write_csv(events: DataFrame, path: str) -> None:
    event_rows(events).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_record(record: dict, path: str, spark) -> None:
    spark.createDataFrame([(json.dumps(record, indent=2),)], "value string").coalesce(1).write.mode("overwrite").text(path)
