"""Frame sampling, smoothing and fixations."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..schemas import Config, Screen

BY = ("recording_id", "person_id")


def sample_frames(frames: DataFrame, fps: float = 5.0) -> DataFrame:
    """The first frame of each step of 1 / fps seconds."""
    if fps <= 0:
        raise ValueError("fps must be positive")
    step = F.floor((F.col("ts") + 1e-9) / F.lit(1.0 / fps))
    w = Window.partitionBy("recording_id", step).orderBy("ts")
    return frames.withColumn("_first", F.row_number().over(w)).filter("_first = 1").drop("_first")


def project(directions: DataFrame, screen: Screen = Screen()) -> DataFrame:
    """Screen points of directions, with off_screen; those on the screen are clamped to it."""
    x, y = G.screen_x(F.col("yaw"), screen), G.screen_y(F.col("pitch"), screen)
    return directions.withColumns({"_x": x, "_y": y}).withColumn("off_screen", G.off_screen(F.col("_x"), F.col("_y"), screen.margin)).withColumns(
        {"x": G.clamp(F.col("_x"), 0.0, 1.0), "y": G.clamp(F.col("_y"), 0.0, 1.0)}
    ).drop("_x", "_y")


def median_smooth(points: DataFrame, window: int = 3) -> DataFrame:
    """Centred median of x and of y over rows, cut at both ends."""
    if window % 2 == 0 or window < 0:
        raise ValueError("the window must be odd")
    if window <= 1:
        return points
    w = Window.partitionBy(*BY).orderBy("ts", "obs_no")
    if window > 3:
        around = w.rowsBetween(-(window // 2), window // 2)
        return points.withColumns({k: F.percentile(k, 0.5).over(around) for k in ("x", "y")})

    def middle(k: str):
        a, b, c = F.lag(k).over(w), F.col(k), F.lead(k).over(w)
        return F.when(a.isNull() & c.isNull(), b).when(a.isNull(), (b + c) / 2.0).when(c.isNull(), (a + b) / 2.0).otherwise(F.greatest(F.least(a, b), F.least(F.greatest(a, b), c)))

    return points.withColumns({k: middle(k) for k in ("x", "y")})


def fixations_of(ts: np.ndarray, x: np.ndarray, y: np.ndarray, dispersion: float, least: float, gap: float) -> list[tuple[int, int]]:
    """First and last samples of fixations (dispersion threshold), in one pass: extremes of the open window are kept in monotone queues."""
    found, i, n = [], 0, len(ts)
    ends = [deque() for _ in range(4)]  # candidates for the greatest x, least x, greatest y, least y
    values = (x, -x, y, -y)

    def push(j: int) -> None:
        for q, v in zip(ends, values):
            while q and v[q[-1]] <= v[j]:
                q.pop()
            q.append(j)

    def spread(start: int) -> float:
        for q in ends:
            while q[0] < start:
                q.popleft()
        return float((x[ends[0][0]] - x[ends[1][0]]) + (y[ends[2][0]] - y[ends[3][0]]))

    j = -1
    while i < n:
        if j < i:
            j = i
            for q in ends:
                q.clear()
            push(j)
        stopped = False
        while ts[j] - ts[i] < least:
            if j + 1 >= n or ts[j + 1] - ts[j] > gap:
                stopped = True
                break
            j += 1
            push(j)
        if stopped or spread(i) > dispersion:
            # samples beyond what the next start needs stay queued; that start grows to at least as far
            i += 1
            continue
        while j + 1 < n and ts[j + 1] - ts[j] <= gap:
            push(j + 1)
            if spread(i) > dispersion:
                break
            j += 1
        found.append((i, j))
        i = j + 1
        j = -1
    return found


def _mean(v: np.ndarray) -> float:
    """The mean, summed one by one from the last value: confidences meet edges unrounded, and the last bit depends on the order."""
    return float(np.cumsum(v[::-1])[-1] / len(v))


def detect_fixations(points: DataFrame, dispersion: float = 0.12, least: float = 0.15, gap: float = 0.3, arranged: bool = False) -> DataFrame:
    """Fixations of each person's points. arranged: rows already stand by person and time, as a window leaves them, so nothing is moved."""
    schema = "recording_id bigint, person_id string, x double, y double, start_time double, end_time double, confidence double, dispersion double"
    cols = ["recording_id", "person_id", "ts", "x", "y", "confidence"]
    rows = points if arranged else points.repartition(*[F.col(k) for k in BY]).sortWithinPartitions(*BY, "ts", "obs_no")

    def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        ts, x, y, c = (t.column(k).to_numpy() for k in ("ts", "x", "y", "confidence"))
        spans = fixations_of(ts, x, y, dispersion, least, gap)
        m = len(spans)
        return pa.record_batch([
            pa.array([t.column(0)[0].as_py()] * m, pa.int64()), pa.array([t.column(1)[0].as_py()] * m, pa.string()),
            *(pa.array([float(v[a : b + 1].sum() / (b + 1 - a)) for a, b in spans], pa.float64()) for v in (x, y)),
            pa.array([ts[a] for a, _ in spans], pa.float64()), pa.array([ts[b] for _, b in spans], pa.float64()), pa.array([_mean(c[a : b + 1]) for a, b in spans], pa.float64()),
            pa.array([float(np.ptp(x[a : b + 1]) + np.ptp(y[a : b + 1])) for a, b in spans], pa.float64()),
        ], names=["recording_id", "person_id", "x", "y", "start_time", "end_time", "confidence", "dispersion"])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a person's rows are cut at every pause longer than gap: no fixation crosses one, so no more than one stretch is held
        held: list[pa.RecordBatch] = []
        last: tuple | None = None
        for b in batches:
            if not b.num_rows:
                continue
            rec, person, ts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).dictionary_encode(), b.column(2).to_numpy()
            code = person.indices.to_numpy(zero_copy_only=False)
            cut = np.flatnonzero((rec[1:] != rec[:-1]) | (code[1:] != code[:-1]) | (ts[1:] - ts[:-1] > gap)) + 1
            edges = [0, *cut.tolist(), b.num_rows]
            for s, e in zip(edges[:-1], edges[1:]):
                key = (rec[s], person.dictionary[int(code[s])].as_py())
                if held and (key != last[0] or ts[s] - last[1] > gap):
                    yield out(held)
                    held = []
                held.append(b.slice(s, e - s))
                last = (key, ts[e - 1])
        if held:
            yield out(held)

    return rows.select(*cols).mapInArrow(work, schema)


def smoothed_fixations(directions: DataFrame, config: Config = Config()) -> DataFrame:
    """Directions to fixations: what is off screen goes before smoothing. One exchange, by person."""
    points = project(directions, config.screen).filter("not off_screen")
    smooth = median_smooth(points, config.smoothing_window)
    return detect_fixations(smooth, config.dispersion, config.min_fixation, config.max_gap, arranged=config.smoothing_window > 1)
