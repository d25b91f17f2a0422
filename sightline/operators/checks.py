"""Rules that rows must keep, as a filter or as an error."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import finite, unit
from ..schemas import LAYOUT_SOURCES, REGION_KINDS



def _region(r: Column) -> Column:
    inside = unit(r.x) & unit(r.y) & (r.width > 0) & unit(r.width) & (r.height > 0) & unit(r.height) & (r.x + r.width <= 1 + 1e-9) & (r.y + r.height <= 1 + 1e-9)
    return r.kind.isin(*REGION_KINDS) & inside & ((r.kind == "participant") == r.participant_id.isNotNull())


def rules(name: str) -> dict[str, Column]:
    """What must hold in each row of an entity."""
    c = F.col
    time = lambda k: finite(c(k)) & (c(k) >= 0)
    if name == "gaze_directions":
        quality = reduce(lambda a, b: a & b, [unit(c(f"quality.{k}")) for k in ("detection", "size", "openness", "head")])
        return {"ts": time("ts"), "yaw": finite(c("yaw")), "pitch": finite(c("pitch")), "confidence": unit(c("confidence")), "quality": c("quality").isNull() | quality}
    if name == "gaze_points":
        return {"ts": time("ts"), "x": unit(c("x")), "y": unit(c("y")), "confidence": unit(c("confidence"))}
    if name == "layouts":
        return {
            "start_time": time("start_time"), "end_time": c("end_time").isNull() | (c("end_time") > c("start_time")),
            "source": c("source").isin(*LAYOUT_SOURCES), "regions": F.forall("regions", _region),
        }
    if name in ("gaze_events", "attributions"):
        return {
            "start_time": time("start_time"), "end_time": finite(c("end_time")) & (c("end_time") >= c("start_time")),
            "confidence": unit(c("confidence")), "target": c("target").isNotNull() & (c("target") != ""),
        }
    if name in ("speaker_segments", "truth"):
        return {"start_time": time("start_time"), "end_time": finite(c("end_time")) & (c("end_time") > c("start_time"))}
    raise KeyError(name)


def broken(df: DataFrame, name: str) -> DataFrame:
    """Rows that break rules, with the names of those."""
    found = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(k)) for k, ok in rules(name).items()]))
    return df.withColumn("broken", found).filter(F.size("broken") > 0)


def checked(df: DataFrame, name: str) -> DataFrame:
    """df; reading a row that breaks a rule is an error."""
    all_ok = reduce(lambda a, b: a & b, [F.coalesce(ok, F.lit(False)) for ok in rules(name).values()])
    return df.filter(F.when(all_ok, F.lit(True)).otherwise(F.raise_error(F.lit(f"a row of {name} breaks its rules")).cast("boolean")))
