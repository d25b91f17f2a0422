"""Streams give what tables give."""

import numpy as np

from sightline.operators import events, temporal
from sightline.schemas import schema
from sightline.streaming import stateful


def run(df, spark, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def files(spark, df, path, order, n):
    """The table in n files, in order; the last file only moves the watermark."""
    rows = df.orderBy(order).collect()
    for i, part in enumerate(np.array_split(np.arange(len(rows)), n)):
        spark.createDataFrame([rows[j] for j in part], df.schema).coalesce(1).write.mode("append").parquet(path)
    last = [r if not isinstance(r, tuple) else r for r in rows[-1:]]
    for k in (1, 2, 3):
        d = last[0].asDict() | {order: last[0][order] + 1000.0 * k}
        for key in ("person_id", "viewer_id"):
            if key in d:
                d[key] = "other"
        if "end_time" in d:
            d["end_time"] = d["start_time"] + 0.1
        spark.createDataFrame([tuple(d[f] for f in df.columns)], df.schema).coalesce(1).write.mode("append").parquet(path)


def stream(spark, df, path, column):
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return stateful.with_event_time(s, column, "1 second")


def test_fixations(spark, tmp_path):
    rng, rows, n = np.random.default_rng(2), [], 0
    for person in ("a", "b"):
        t = 0.0
        for _ in range(12):
            x, y = rng.random(2)
            for _ in range(rng.integers(1, 8)):
                rows.append((0, n, round(t, 3), person, float(x + rng.normal(0, 0.01)), float(y + rng.normal(0, 0.01)), 0.9))
                t, n = t + 0.1, n + 1
            t += float(rng.choice([0.0, 0.5]))
    df = spark.createDataFrame(rows, schema("gaze_points"))
    files(spark, df, str(tmp_path / "p"), "ts", 6)
    want = temporal.detect_fixations(temporal.median_smooth(df)).collect()
    got = [r for r in run(stateful.fixations(stream(spark, df, str(tmp_path / "p"), "ts")), spark, "fix") if r.person_id != "other"]
    key = lambda r: (r.person_id, round(r.start_time, 6), round(r.end_time, 6), round(r.x, 6), round(r.y, 6))
    assert sorted(map(key, got)) == sorted(map(key, want)) and len(want) > 8


def test_events(spark, tmp_path):
    rng, rows, t = np.random.default_rng(3), [], 0.0
    for _ in range(60):
        rows.append((0, "v", round(t, 3), round(t + float(rng.choice([0.1, 0.3])), 3), str(rng.choice(["a", "b"])), 0.8, str(rng.choice(["x", "y"])), None, "assumed_shared"))
        t += float(rng.choice([0.1, 0.3, 0.9]))
    df = spark.createDataFrame(rows, schema("attributions"))
    files(spark, df, str(tmp_path / "a"), "start_time", 5)
    got = [r for r in run(stateful.gaze_events(stream(spark, df, str(tmp_path / "a"), "start_time")), spark, "ev") if r.viewer_id != "other"]
    key = lambda r: (r.target, round(r.start_time, 6), round(r.end_time, 6), round(r.confidence, 6))
    assert sorted(map(key, got)) == sorted(map(key, events.gaze_events(df).collect()))


def test_first_frames(spark, tmp_path):
    df = spark.createDataFrame([(0, k / 30.0) for k in range(30)], "recording_id bigint, ts double")
    df.coalesce(1).write.parquet(str(tmp_path / "f"))
    got = run(stateful.first_frames(stream(spark, df, str(tmp_path / "f"), "ts")).select("recording_id", "bucket"), spark, "ff")
    assert sorted(r.bucket for r in got) == [0, 1, 2, 3, 4]


def test_layouts(spark, tmp_path):
    from sightline.operators import layouts
    from sightline.schemas import TILE

    rng, rows, t = np.random.default_rng(6), [], 0.0
    kinds = [[("participant", x / 4, 0.0, 0.25, 0.5) for x in range(n)] for n in (0, 2, 3, 4)]
    for _ in range(25):
        arrangement = kinds[rng.integers(0, 4)]
        for _ in range(rng.integers(1, 9)):
            rows.append((0, round(t, 3), arrangement))
            t += 0.2
    df = spark.createDataFrame(rows, f"recording_id bigint, ts double, tiles array<{TILE}>")
    for k, part in enumerate(np.array_split(np.arange(len(rows)), 6)):
        spark.createDataFrame([rows[i] for i in part], df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "l"))
    for k in (1, 2, 3):
        spark.createDataFrame([(9, t + 1000.0 * k, [])], df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "l"))
    got = [r for r in run(stateful.layouts(stream(spark, df, str(tmp_path / "l"), "ts"), 0.5), spark, "lay") if r.recording_id == 0]
    key = lambda r: (r.interval_no, round(r.start_time, 6), r.end_time and round(r.end_time, 6), len(r.tiles))
    want = sorted(map(key, layouts.segment_layouts(df, 0.5).collect()))
    assert sorted(map(key, got)) == want and len(want) > 6 and want[-1][2] is None


def test_speakers(spark, tmp_path):
    rng, rows, t = np.random.default_rng(7), [], 0.0
    for _ in range(80):
        rows.append((0, round(t, 3), round(t + 0.2, 3), str(rng.choice(["a", "b"], p=[0.8, 0.2])), float(rng.choice([0.6, 1.0]))))
        t += float(rng.choice([0.2, 0.6, 0.9]))
    df = spark.createDataFrame(rows, "recording_id bigint, start_time double, end_time double, participant_id string, confidence double")
    for part in np.array_split(np.arange(len(rows)), 5):
        spark.createDataFrame([rows[i] for i in part], df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    for k in (1, 2, 3):
        spark.createDataFrame([(9, t + 1000.0 * k, t + 1000.0 * k + 0.2, "a", 1.0)], df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    got = [r for r in run(stateful.speaker_segments(stream(spark, df, str(tmp_path / "s"), "start_time")), spark, "sp") if r.recording_id == 0]
    key = lambda r: (r.participant_id, round(r.start_time, 6), round(r.end_time, 6), round(r.confidence, 6))
    want = events.speaker_segments(df).collect()
    assert sorted(map(key, got)) == sorted(map(key, want)) and len(want) > 8


def test_median3():
    v = np.array([1.0, 9.0, 2.0, 3.0])
    assert stateful.median3(v, False, False).tolist() == [5.0, 2.0, 3.0, 2.5]
    assert stateful.median3(v, True, True).tolist() == [2.0, 3.0]
