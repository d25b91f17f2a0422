"""Gaze data derived from the driver's tables, by SQL that Spark and DuckDB both run.

Numbers with an exponent are doubles in both; DIV and JSON stand for what the two write differently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIRECTIONS = """
select DIV(user_id, 9) as recording_id, concat('slot_', cast(user_id % 9 as string)) as person_id, event_id as obs_no, rn, ts, tile,
  radians(-16e0) + (case when event_id % 41 = 0 then 1.9e0 else tx end) * (radians(16e0) - radians(-16e0)) as yaw,
  0e0 - ty * (0e0 - radians(-19e0)) as pitch,
  0.5e0 + (k % 10) / 20e0 as confidence,
  least(1e0, 0.5e0 + (k % 10) / 20e0) as q_detection, least(1e0, 0.4e0 + (k % 7) / 10e0) as q_size,
  least(1e0, 0.6e0 + (k % 5) / 10e0) as q_openness, least(1e0, 0.7e0 + (k % 4) / 10e0) as q_head
from (select *,
    (tile % 3 + 0.5e0) / 3e0 + ((k % 11) - 5) * 0.008e0 + case when event_id % 29 = 0 then 0.11e0 else 0e0 end as tx,
    (DIV(tile, 3) + 0.5e0) / 3e0 + ((event_id % 13) - 6) * 0.006e0 + case when DIV(event_id, 200) % 5 = 0 then 0.12e0 else 0e0 end as ty
  from (select *, (rn * 2 + DIV(rn, 25) * 6) / 10e0 as ts, (DIV(rn, 7) + user_id) % 9 as tile
    from (select event_id, user_id, cast(JSON(props, '$.k') as int) as k,
            cast(row_number() over (partition by user_id order by event_id) - 1 as bigint) as rn from events) e0) e1) e2
"""

#: A: a gallery of nine for 12 seconds. B: shared content and three participants, from then on.
REGIONS = """
select recording_id, 0 as layout_no, 0e0 as start_time, 12e0 as end_time, cast(i as int) as region_no, 'participant' as kind,
  (i % 3) / 3e0 as x, DIV(i, 3) / 3e0 as y, 1e0 / 3e0 as width, 1e0 / 3e0 as height, concat('slot_', cast(i as string)) as participant_id
from (select distinct DIV(user_id, 9) as recording_id from events) r cross join (values (0), (1), (2), (3), (4), (5), (6), (7), (8)) t(i)
union all
select recording_id, 1, 12e0, cast(null as double), cast(i as int), case when i = 0 then 'shared_content' else 'participant' end,
  case when i = 0 then 0e0 else 0.8e0 end, case when i = 0 then 0e0 else 0.3e0 + 0.2e0 * (i - 1) end,
  case when i = 0 then 0.8e0 else 0.2e0 end, case when i = 0 then 1e0 else 0.2e0 end,
  case when i = 0 then null else concat('slot_', cast(8 + i as string)) end
from (select distinct DIV(user_id, 9) as recording_id from events) r cross join (values (0), (1), (2), (3)) t(i)
"""

TRUTH = """
select recording_id, person_id as viewer_id, d as truth_no, min(ts) as start_time, max(ts) + 0.2e0 as end_time,
  case when d % 6 = 5 then 'off_screen' when d % 7 = 6 then concat('slot_', cast((min(tile) + 1) % 9 as string)) else concat('slot_', cast(min(tile) as string)) end as target,
  case when recording_id % 2 = 0 then '3x3' end as grid
from (select *, DIV(rn, 7) as d from directions) g group by recording_id, person_id, d
"""

SPEAKER_FLAGS = """
select conv_id as recording_id, turn * 1.2e0 + j * 0.2e0 as start_time, turn * 1.2e0 + j * 0.2e0 + 0.2e0 as end_time,
  concat('slot_', cast((conv_id * 7 + DIV(turn, 2)) % 9 as string)) as participant_id, case when role = 'user' then 0.8e0 else 0.6e0 end as confidence
from conversations cross join (values (0), (1), (2), (3), (4)) t(j) where (conv_id + turn + j) % 11 <> 0
"""


def spark_text(sql: str) -> str:
    return re.sub(r"\bDIV\(", "div(", re.sub(r"\bJSON\(", "get_json_object(", sql))


def duck_text(sql: str) -> str:
    sql = re.sub(r"\bJSON\(", "json_extract_string(", sql)
    return re.sub(r"\bDIV\(([^,()]+), (\d+)\)", r"((\1) // \2)", sql)


def _sql(spark: SparkSession, sf_dir: str, sql: str, **tables: DataFrame) -> DataFrame:
    text = spark_text(sql)
    frames = dict(tables)
    for name in ("events", "conversations"):
        if re.search(rf"\bfrom {name}\b", text) and name not in frames:
            frames[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = re.sub(r"\bfrom (" + "|".join(frames) + r")\b", r"from {\1}", text)
    return spark.sql(text, **frames)


def directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _sql(spark, sf_dir, DIRECTIONS)
    q = F.struct(*[F.col(f"q_{k}").alias(k) for k in ("detection", "size", "openness", "head")])
    return d.withColumn("quality", q).drop("q_detection", "q_size", "q_openness", "q_head")


def layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _sql(spark, sf_dir, REGIONS)
    region = F.struct("region_no", "kind", "x", "y", "width", "height", "participant_id")
    made = r.groupBy("recording_id", "layout_no").agg(F.min("start_time").alias("start_time"), F.min("end_time").alias("end_time"), F.array_sort(F.collect_list(region)).alias("rs"))
    parts = F.transform("rs", lambda x: F.struct(x.kind.alias("kind"), x.x.alias("x"), x.y.alias("y"), x.width.alias("width"), x.height.alias("height"), x.participant_id.alias("participant_id")))
    return made.select("recording_id", F.lit("recording").alias("viewer_id"), "layout_no", "start_time", "end_time", F.lit("recording").alias("source"), parts.alias("regions"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, TRUTH, directions=directions(spark, sf_dir))


def speaker_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, SPEAKER_FLAGS)


#: Frames of ten recordings at 5 a second. 8 tiles (C) from 50 to 54, none at 20, 41 and 42, B from 60, else A.
TILES = """
select r as recording_id, k, k / 5e0 as ts, i as tile_no, kind, case when x > 0 then x + ((k * (r + 1)) % 3) * 0.001e0 else x end as x, y, width, height
from (select cast(r as bigint) as r, cast(k as bigint) as k from (RANGE10) a cross join (RANGE100) b) f
join (select 'A' as arr, i, 'participant' as kind, (i % 3) / 3e0 as x, DIV(i, 3) / 3e0 as y, 1e0 / 3e0 - 0.004e0 as width, 1e0 / 3e0 - 0.004e0 as height from (values (0), (1), (2), (3), (4), (5), (6), (7), (8)) t(i)
  union all select 'C', i, 'participant', (i % 3) / 3e0, DIV(i, 3) / 3e0, 1e0 / 3e0 - 0.004e0, 1e0 / 3e0 - 0.004e0 from (values (0), (1), (2), (3), (4), (5), (6), (7)) t(i)
  union all select 'B', i, case when i = 0 then 'shared_content' else 'participant' end, case when i = 0 then 0e0 else 0.8e0 end, case when i = 0 then 0e0 else 0.3e0 + 0.2e0 * (i - 1) end,
    case when i = 0 then 0.8e0 else 0.196e0 end, case when i = 0 then 1e0 else 0.196e0 end from (values (0), (1), (2), (3)) t(i)) t
on t.arr = case when k in (20, 41, 42) then '' when k between 50 and 54 then 'C' when k >= 60 then 'B' else 'A' end
"""


def _tiles_text(spark_: bool) -> str:
    a, b = ("select id as r from range(10)", "select id as k from range(100)") if spark_ else ("select range as r from range(10)", "select range as k from range(100)")
    return TILES.replace("RANGE100", b).replace("RANGE10", a)


def duck_tiles() -> str:
    return duck_text(_tiles_text(False))


def frame_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.sql(spark_text(_tiles_text(True)))
    tile = F.struct("tile_no", "kind", "x", "y", "width", "height")
    made = t.groupBy("recording_id", "k").agg(F.array_sort(F.collect_list(tile)).alias("ts_"))
    frames = spark.sql("select cast(r.id as bigint) as recording_id, cast(k.id as bigint) as k, k.id / 5e0 as ts from range(10) r cross join range(100) k")
    parts = F.transform("ts_", lambda x: F.struct(x.kind.alias("kind"), x.x.alias("x"), x.y.alias("y"), x.width.alias("width"), x.height.alias("height")))
    return frames.join(made, ["recording_id", "k"], "left").select(
        "recording_id", "ts",
        F.coalesce(parts, F.array().cast("array<struct<kind:string,x:double,y:double,width:double,height:double>>")).alias("tiles"),
    )


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Face attempts: one for each direction, and one without a face for every seventh."""
    d = directions(spark, sf_dir).select("recording_id", F.col("person_id").alias("participant_id"), "obs_no")
    return d.select("recording_id", "participant_id", F.lit(True).alias("hit")).unionByName(d.filter("obs_no % 7 = 0").select("recording_id", "participant_id", F.lit(False).alias("hit")))


#: Height and width of rendered frames, and the gutter on each side of a tile, as a share of the frame.
RENDERED, GUTTER = (600, 900), 0.01
#: Rendered frames handed on at once.
FRAMES = 16


def undrawn_frames(layouts: DataFrame) -> DataFrame:
    """What draw_frame makes a frame of, for the start of each layout: recording_id, ts, regions; dealt out to all tasks."""
    # layouts are small and lie in few parts, frames are large
    rows = layouts.select("recording_id", F.col("start_time").cast("double").alias("ts"), "regions")
    return rows.repartition(4 * layouts.sparkSession.sparkContext.defaultParallelism, "recording_id", "ts")


def draw_frame(row: dict):
    """Regions on a dark ground, the n-th one of level 60 + 10 n.

    The border of one participant is bright: the one whose place is the recording's number, modulo 4; 3 stands for none.
    """
    import numpy as np

    (height, width), place = RENDERED, 0
    image = np.full((height, width, 3), 20, np.uint8)
    for i, r in enumerate(row["regions"]):
        y0, y1 = round((r["y"] + GUTTER) * height), round((r["y"] + r["height"] - GUTTER) * height)
        x0, x1 = round((r["x"] + GUTTER) * width), round((r["x"] + r["width"] - GUTTER) * width)
        if r["kind"] == "participant":
            edge = max(1, round(0.06 * min(y1 - y0, x1 - x0)))
            if place == row["recording_id"] % 4 and place < 3:
                image[y0:y1, x0:x1] = 250
                y0, y1, x0, x1 = y0 + edge, y1 - edge, x0 + edge, x1 - edge
            place += 1
        image[y0:y1, x0:x1] = 60 + 10 * i
    return image


def rendered_frames(layouts: DataFrame) -> DataFrame:
    """A frame at the start of each layout, with its pixels."""
    import pandas as pd

    def draw(batches):
        for pdf in batches:
            for k in range(0, len(pdf), FRAMES):  # a frame is large, and a batch of binaries ends at 2 GiB
                some = pdf.iloc[k : k + FRAMES]
                images = [draw_frame(row) for row in some.to_dict("records")]
                sizes = {"height": [i.shape[0] for i in images], "width": [i.shape[1] for i in images]}
                yield pd.DataFrame({"recording_id": some["recording_id"].array, "ts": some["ts"].array} | sizes | {"pixels": [i.tobytes() for i in images]})

    return undrawn_frames(layouts).mapInPandas(draw, "recording_id bigint, ts double, height int, width int, pixels binary")
