"""Structured Streaming forms of sampling, layout segmentation, fixations, and event and speaker merging.

Input needs an event time `at` with a watermark; rows of a person must come in order within what the watermark allows. What is open
when a person falls silent is given out when the watermark passes max_gap after their last row; later rows then start anew.
State is what is still open: the samples of a fixation that may grow, one event or segment, or an arrangement and the run that may follow it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import geometry as G
from ..operators.temporal import fixations_of
from ..schemas import Config

FIXATION = "recording_id bigint, person_id string, x double, y double, start_time double, end_time double, confidence double, dispersion double"
EVENT = "recording_id bigint, viewer_id string, target string, start_time double, end_time double, confidence double, layout_source string, reason string"


#: Event time of a recording's start, in ms: above 0, where watermarks begin and what is not later is late.
START_MS = 86_400_000


def with_event_time(df: DataFrame, seconds: str, delay: str = "5 seconds") -> DataFrame:
    """at: a timestamp for a column of seconds since a recording's start."""
    return df.withColumn("at", F.timestamp_micros((F.col(seconds) * 1_000_000).cast("long") + START_MS * 1000)).withWatermark("at", delay)


def first_frames(frames: DataFrame, fps: float = 5.0) -> DataFrame:
    """The first frame that comes of each step; equal to sampling a table where frames come in order."""
    step = F.floor((F.col("ts") + 1e-9) / F.lit(1.0 / fps))
    return frames.withColumn("bucket", step).dropDuplicatesWithinWatermark(["recording_id", "bucket"])


def median3(v: np.ndarray, before: bool, after: bool) -> np.ndarray:
    """Centred medians; before and after: the first and last value are only neighbours, and left out."""
    out = v.copy()
    if len(v) > 1:
        out[0], out[-1] = (v[0] + v[1]) / 2, (v[-2] + v[-1]) / 2
    if len(v) > 2:
        out[1:-1] = np.maximum(np.minimum(v[:-2], v[1:-1]), np.minimum(np.maximum(v[:-2], v[1:-1]), v[2:]))
    return out[int(before) : len(out) - int(after)]


def settled(ts: np.ndarray, x: np.ndarray, y: np.ndarray, c: Config) -> tuple[list[tuple[int, int]], int]:
    """Fixations that later samples can't change, and the first sample that still matters."""
    found = [f for f in fixations_of(ts, x, y, c.dispersion, c.min_fixation, c.max_gap) if f[1] < len(ts) - 1]
    i = found[-1][1] + 1 if found else 0
    while i < len(ts):
        j = i
        while j < len(ts) - 1 and ts[j] - ts[i] < c.min_fixation and ts[j + 1] - ts[j] <= c.max_gap:
            j += 1
        whole = ts[j] - ts[i] >= c.min_fixation
        if whole and np.ptp(x[i : j + 1]) + np.ptp(y[i : j + 1]) <= c.dispersion or not whole and j == len(ts) - 1:
            break
        i += 1
    return found, i


def fixations(points: DataFrame, config: Config = Config()) -> DataFrame:
    """Fixations of a stream of on-screen points (recording_id, person_id, ts, x, y, confidence, at), smoothed by medians of three."""

    def rows(key: tuple, ts, x, y, c, spans) -> pd.DataFrame:
        mean = lambda v, a, b: float(v[a : b + 1].sum() / (b + 1 - a))
        return pd.DataFrame(
            [[*key, mean(x, a, b), mean(y, a, b), ts[a], ts[b], mean(c, a, b), float(np.ptp(x[a : b + 1]) + np.ptp(y[a : b + 1]))] for a, b in spans],
            columns=[f.split()[0] for f in FIXATION.split(", ")],
        )

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, before = ([np.array(v) for v in state.get[:4]], bool(state.get[4])) if state.exists else ([np.zeros(0)] * 4, False)
        over = state.hasTimedOut
        new = pd.concat(list(batches)) if not over else None
        if new is not None and len(new):
            new = new.sort_values("ts", kind="stable")
            held = [np.concatenate([h, new[k].to_numpy(float)]) for h, k in zip(held, ("ts", "x", "y", "confidence"))]
        ts, x, y, c = held
        # the last sample waits for its right neighbour, unless there will be none
        last = 0 if over else 1
        sx, sy = median3(x, before, bool(last)), median3(y, before, bool(last))
        t, k = ts[int(before) : len(ts) - last], c[int(before) : len(ts) - last]
        spans, keep = settled(t, sx, sy, config)
        if over:
            spans = fixations_of(t, sx, sy, config.dispersion, config.min_fixation, config.max_gap)
            state.remove()
        else:
            start = keep + int(before)  # in held
            lead = start > 0
            state.update(([*ts[start - lead :].tolist()], [*x[start - lead :].tolist()], [*y[start - lead :].tolist()], [*c[start - lead :].tolist()], int(lead)))
            state.setTimeoutTimestamp(max(START_MS + int(ts[-1] * 1000), state.getCurrentWatermarkMs()) + int(config.max_gap * 1000) + 1)
        if len(spans):
            yield rows(key, t, sx, sy, k, spans)

    group = points.groupBy("recording_id", "person_id")
    return group.applyInPandasWithState(step, FIXATION, "ts array<double>, x array<double>, y array<double>, c array<double>, before int", "append", GroupStateTimeout.EventTimeTimeout)


def gaze_events(attributions: DataFrame, config: Config = Config()) -> DataFrame:
    """Events of a stream of attributions (as a table's columns, with at)."""
    cols = [f.split()[0] for f in EVENT.split(", ")]

    def close(key: tuple, s: dict) -> list:
        if s["end"] - s["start"] < config.event_min_duration:
            return []
        reason = max(range(len(s["reasons"])), key=lambda i: (s["weights"][i], -i))
        return [[*key, s["target"], s["start"], s["end"], s["wc"] / s["w"], s["source"], s["reasons"][reason]]]

    names = ("target", "start", "end", "w", "wc", "source", "reasons", "weights")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = dict(zip(names, state.get)) if state.exists else None
        if s:
            s["reasons"], s["weights"] = list(s["reasons"]), list(s["weights"])
        out: list = []
        if state.hasTimedOut:
            out = close(key, s) if s else []
            state.remove()
        else:
            for r in pd.concat(list(batches)).sort_values(["start_time", "end_time", "reason", "confidence", "target"], kind="stable").itertuples():
                w = max(r.end_time - r.start_time, 1e-9)
                if s and s["target"] == r.target and r.start_time - s["end"] <= config.max_gap:
                    s["end"], s["w"], s["wc"] = max(s["end"], r.end_time), s["w"] + w, s["wc"] + w * r.confidence
                else:
                    out += close(key, s) if s else []
                    s = {"target": r.target, "start": r.start_time, "end": r.end_time, "w": w, "wc": w * r.confidence, "source": r.layout_source, "reasons": [], "weights": []}
                if r.reason not in s["reasons"]:
                    s["reasons"].append(r.reason)
                    s["weights"].append(0.0)
                s["weights"][s["reasons"].index(r.reason)] += w
            state.update(tuple(s[n] for n in names))
            state.setTimeoutTimestamp(max(START_MS + int(s["end"] * 1000), state.getCurrentWatermarkMs()) + int(config.max_gap * 1000) + 1)
        if out:
            yield pd.DataFrame(out, columns=cols)

    group = attributions.groupBy("recording_id", "viewer_id")
    return group.applyInPandasWithState(
        step, EVENT, "target string, start double, end double, w double, wc double, source string, reasons array<string>, weights array<double>",
        "append", GroupStateTimeout.EventTimeTimeout,
    )


def layouts(frames: DataFrame, min_stable: float = 0.5, silence: float = 5.0) -> DataFrame:
    """Arrangements of a stream of frames (recording_id, ts, tiles, at) that lasted, as segment_layouts finds them.

    An arrangement is given out when the next one has lasted, and the last one, without an end, after `silence` seconds without frames.
    """
    tiles = dict((f.name, f.dataType) for f in frames.schema.fields)["tiles"].simpleString()
    cols = ["recording_id", "interval_no", "start_time", "end_time", "tiles"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # the arrangement that counts (number, signature, start, tiles), and the run of equal frames at the end (signature, start, tiles)
        no, sig, start, held, run, began, shown = state.get if state.exists else (-1, None, None, None, None, None, None)
        out: list = []
        if state.hasTimedOut:
            out = [[*key, no, start, None, held]] if no >= 0 else []
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
            for ts, s, t in zip(rows["ts"], rows["sig"], rows["tiles"]):
                if s != run or began is None:
                    run, began, shown = s, ts, t
                if no < 0 or (run != sig and ts - began >= min_stable):
                    out += [[*key, no, start, began, held]] if no >= 0 else []
                    no, sig, start, held = no + 1, run, began, shown
            state.update((no, sig, start, held, run, began, shown))
            state.setTimeoutTimestamp(max(START_MS + int(rows["ts"].iloc[-1] * 1000), state.getCurrentWatermarkMs()) + int(silence * 1000) + 1)
        if out:
            made = pd.DataFrame(out, columns=cols)
            yield made.assign(end_time=made["end_time"].astype(float))

    flat = frames.select("recording_id", "ts", "at", F.to_json(G.signature(F.col("tiles"))).alias("sig"), F.to_json("tiles").alias("tiles"))
    schema, kept = "recording_id bigint, interval_no int, start_time double, end_time double, tiles string", "no int, sig string, start double, held string, run string, began double, shown string"
    made = flat.groupBy("recording_id").applyInPandasWithState(step, schema, kept, "append", GroupStateTimeout.EventTimeTimeout)
    return made.withColumns({"end_time": F.when(~F.isnan("end_time"), F.col("end_time")), "tiles": F.from_json("tiles", tiles)})


def speaker_segments(flags: DataFrame, least: float = 0.4, gap: float = 0.5) -> DataFrame:
    """Segments of a stream of moments of speech (recording_id, participant_id, start_time, end_time, confidence, at)."""
    cols = ["recording_id", "participant_id", "start_time", "end_time", "confidence"]

    def close(key: tuple, s: tuple) -> list:
        who, start, end, w, wc = s
        return [[*key, who, start, end, wc / w]] if end - start >= least else []

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s, out = (tuple(state.get) if state.exists else None), []
        if state.hasTimedOut:
            out = close(key, s) if s else []
            state.remove()
        else:
            for r in pd.concat(list(batches)).sort_values(["start_time", "end_time", "participant_id", "confidence"], kind="stable").itertuples():
                w = max(r.end_time - r.start_time, 1e-9)
                if s and s[0] == r.participant_id and r.start_time - s[2] <= gap:
                    s = (s[0], s[1], max(s[2], r.end_time), s[3] + w, s[4] + w * r.confidence)
                else:
                    out += close(key, s) if s else []
                    s = (r.participant_id, r.start_time, r.end_time, w, w * r.confidence)
            state.update(s)
            state.setTimeoutTimestamp(max(START_MS + int(s[2] * 1000), state.getCurrentWatermarkMs()) + int(gap * 1000) + 1)
        if out:
            yield pd.DataFrame(out, columns=cols)

    schema = "recording_id bigint, participant_id string, start_time double, end_time double, confidence double"
    return flags.groupBy("recording_id").applyInPandasWithState(step, schema, "who string, start double, end double, w double, wc double", "append", GroupStateTimeout.EventTimeTimeout)


def windowed_looks(events: DataFrame, window: str = "1 minute") -> DataFrame:
    """Seconds by viewer and target in windows of event time; late rows beyond the watermark are left out."""
    return events.groupBy(F.window("at", window), "recording_id", "viewer_id", "target").agg(F.sum(F.col("end_time") - F.col("start_time")).alias("seconds"))
