"""One operator at a time, on small tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.functions import geometry as G
from sightline.operators import attribution, calibration, checks, comparison, coverage, diagnostics, evaluation, events, layouts, reid, temporal
from sightline.schemas import Config, Screen, schema


def points(spark, rows, person="p"):
    return spark.createDataFrame([(0, i, float(t), person, float(x), float(y), 0.9) for i, (t, x, y) in enumerate(rows)], schema("gaze_points"))


def events_of(spark, rows, least=0.2, gap=0.3):
    a = spark.createDataFrame([(0, "v", float(s), float(e), t, float(c), r, None, "assumed_shared") for s, e, t, c, r in rows], schema("attributions"))
    got = events.gaze_events(a, least, gap).orderBy("start_time").collect()
    return [(r.target, round(r.start_time, 6), round(r.end_time, 6), round(r.confidence, 6), r.reason) for r in got]


def layout(spark, regions, end=None, viewer="recording", no=0, start=0.0, source="recording"):
    return spark.createDataFrame([(0, viewer, no, start, end, source, regions)], schema("layouts"))


def tile(name, x, y, w, h, kind="participant"):
    return (kind, x, y, w, h, name)


def test_smoothing_takes_a_spike_out(spark):
    got = temporal.median_smooth(points(spark, [(0.0, 0.5, 0.5), (0.1, 0.9, 0.5), (0.2, 0.5, 0.5)])).orderBy("ts").collect()
    assert got[1].x == 0.5 and [r.ts for r in got] == [0.0, 0.1, 0.2]
    assert got[0].x == pytest.approx(0.7)
    with pytest.raises(ValueError):
        temporal.median_smooth(points(spark, [(0, 0, 0)]), 2)


@pytest.mark.parametrize(
    "rows, spans",
    [
        ([(k / 10, 0.5 + 0.005 * (k % 2), 0.5) for k in range(6)], [(0.0, 0.5)]),
        ([(k / 10, x, 0.5) for k, x in enumerate([0.2] * 4 + [0.6] + [0.8] * 4)], [(0.0, 0.3), (0.5, 0.8)]),
        ([(t, 0.5, 0.5) for t in (0, 0.1, 0.2, 1.2, 1.3, 1.4)], [(0.0, 0.2), (1.2, 1.4)]),
        ([(0.0, 0.5, 0.5)], []),
    ],
)
def test_fixations(spark, rows, spans):
    got = temporal.detect_fixations(points(spark, rows)).orderBy("start_time").collect()
    assert [(round(r.start_time, 6), round(r.end_time, 6)) for r in got] == spans


def slow_fixations(ts, x, y, d, least, gap):
    out, i = [], 0
    while i < len(ts):
        j = i
        while j < len(ts) and ts[j] - ts[i] < least:
            j = j + 1 if j + 1 < len(ts) and ts[j + 1] - ts[j] <= gap else len(ts)
        spread = lambda b: (max(x[i : b + 1]) - min(x[i : b + 1])) + (max(y[i : b + 1]) - min(y[i : b + 1]))
        if j >= len(ts) or spread(j) > d:
            i += 1
            continue
        while j + 1 < len(ts) and ts[j + 1] - ts[j] <= gap and spread(j + 1) <= d:
            j += 1
        out.append((i, j))
        i = j + 1
    return out


def test_fixations_equal_a_plain_loop():
    rng = random.Random(5)
    for _ in range(400):
        n, t, ts, x, y = rng.randrange(0, 40), 0.0, [], [], []
        for _ in range(n):
            t += rng.choice([0.05, 0.1, 0.1, 0.2, 0.5])
            ts.append(round(t, 3))
            x.append(rng.choice([0.2, 0.21, 0.25, 0.3, 0.7]))
            y.append(rng.choice([0.5, 0.52, 0.6]))
        got = temporal.fixations_of(*(np.array(v, float) for v in (ts, x, y)), 0.12, 0.15, 0.3)
        assert got == slow_fixations(ts, x, y, 0.12, 0.15, 0.3)


def test_sampling_takes_the_first_frame_of_each_step(spark):
    f = spark.createDataFrame([(0, k / 30.0) for k in range(60)], "recording_id bigint, ts double")
    assert [r.ts for r in temporal.sample_frames(f, 5.0).orderBy("ts").collect()] == pytest.approx([0.2 * k for k in range(10)])
    with pytest.raises(ValueError):
        temporal.sample_frames(f, 0)


def test_projection(spark):
    s = Screen()
    d = spark.createDataFrame([(0.0, (s.top + s.bottom) / 2), (s.left, s.top), (s.right * 1.2, -0.1), (s.right * 1.05, -0.1)], "yaw double, pitch double")
    got = temporal.project(d).collect()
    assert (got[0].x, got[0].y) == pytest.approx((0.5, 0.5)) and (got[1].x, got[1].y) == (0.0, 0.0)
    assert got[2].off_screen and not got[3].off_screen and got[3].x == 1.0
    with pytest.raises(ValueError):
        Screen(left=1.0, right=0.0)


def test_events_merge(spark):
    assert events_of(spark, [(0, 0.3, "alice", 0.8, "a"), (0.3, 0.6, "alice", 0.6, "b")]) == [("alice", 0.0, 0.6, 0.7, "a")]
    assert events_of(spark, [(0, 0.3, "a", 1, "r"), (0.3, 0.35, "c", 1, "r"), (0.35, 0.7, "a", 1, "r")]) == [("a", 0.0, 0.3, 1.0, "r"), ("a", 0.35, 0.7, 1.0, "r")]
    assert len(events_of(spark, [(0, 0.3, "a", 1, "r"), (1.5, 1.8, "a", 1, "r")])) == 2


def test_events_equal_a_plain_fold(spark):
    rng, rows = random.Random(3), []
    for v in range(40):
        t = 0.0
        for _ in range(rng.randrange(1, 14)):
            t += rng.choice([0.0, 0.1, 0.2, 0.5])
            rows.append((v, f"v{v}", t, t + rng.choice([0.0, 0.1, 0.3]), rng.choice("ab"), rng.choice([0.2, 0.5, 0.9]), rng.choice("xyz"), None, "assumed_shared"))
            t += rng.choice([0.0, 0.1, 0.3])
    want = []
    for v in range(40):
        mine, cur = sorted((r for r in rows if r[0] == v), key=lambda r: (r[2], r[3], r[6], r[5], r[4])), None
        done = []
        for r in mine:
            if cur and cur[0][4] == r[4] and r[2] - max(c[3] for c in cur) <= 0.3:
                cur.append(r)
            else:
                cur = [r]
                done.append(cur)
        for c in done:
            s, e = min(r[2] for r in c), max(r[3] for r in c)
            if e - s >= 0.2:
                w = [max(r[3] - r[2], 1e-9) for r in c]
                by = {}
                for r, x in zip(c, w):
                    by[r[6]] = by.get(r[6], 0) + x
                want.append((v, c[0][4], round(s, 6), round(e, 6), round(sum(a * r[5] for a, r in zip(w, c)) / sum(w), 6), max(by.values())))
    got = events.gaze_events(spark.createDataFrame(rows, schema("attributions"))).collect()
    assert sorted((r.recording_id, r.target, round(r.start_time, 6), round(r.end_time, 6), round(r.confidence, 6)) for r in got) == sorted(x[:5] for x in want)


@pytest.mark.parametrize(
    "x, y, want",
    [(0.25, 0.5, ("left", "center hit")), (0.495, 0.5, ("low_confidence", "near border: left")), (0.5, 0.5, ("unknown", "ambiguous overlap")), (0.75, 0.5, ("me", "self"))],
)
def test_attribution(spark, x, y, want):
    l = layout(spark, [tile("left", 0.0, 0.0, 0.5, 1.0), tile("me", 0.5, 0.0, 0.5, 1.0)])
    f = spark.createDataFrame([(0, "me", x, y, 0.0, 0.5, 0.9, 0.0)], schema("fixations"))
    r = attribution.attribute_fixations(f, l).first()
    assert (r.target, r.reason) == want


def test_attribution_without_a_region_and_with_shared_content(spark):
    f = spark.createDataFrame([(0, "v", 0.9, 0.9, 0.0, 0.5, 0.8, 0.0)], schema("fixations"))
    r = attribution.attribute_fixations(f, layout(spark, [tile("a", 0.0, 0.0, 0.4, 0.4)])).first()
    assert (r.target, r.reason, r.confidence, r.margin_ratio) == ("unknown", "no region", 0.8, None)
    r = attribution.attribute_fixations(f, layout(spark, [tile(None, 0.0, 0.0, 1.0, 1.0, "shared_content")])).first()
    assert r.target == "shared_content"
    assert attribution.attribute_fixations(f.withColumn("start_time", F.lit(9.0)), layout(spark, [tile("a", 0.0, 0.0, 1.0, 1.0)], end=5.0)).count() == 0


def test_first_layout_wins_and_a_viewers_own_layouts_are_used(spark):
    two = layout(spark, [tile("a", 0.0, 0.0, 1.0, 1.0)], no=0).unionByName(layout(spark, [tile("b", 0.0, 0.0, 1.0, 1.0)], no=1))
    f = spark.createDataFrame([(0, "v", 0.5, 0.5, 1.0, 1.5, 0.9, 0.0)], schema("fixations"))
    assert attribution.attribute_fixations(f, two).first().target == "a"
    own = layout(spark, [tile("c", 0.0, 0.0, 1.0, 1.0)], viewer="v", source="manifest")
    r = attribution.attribute_fixations(f, own, per_viewer=True).first()
    assert (r.target, r.layout_source) == ("c", "manifest")
    assert attribution.attribute_fixations(f, own.withColumn("viewer_id", F.lit("w")), per_viewer=True).count() == 0


def test_not_visible(spark):
    l = layout(spark, [tile(f"slot_{i}", (i % 2) / 2, i // 2 / 2, 0.5, 0.5) for i in range(4)])
    e = spark.createDataFrame([(0, 0, "slot_0", "slot_1", 0.0, 1.0, 0.9, "assumed_shared", "center hit")], schema("gaze_events"))
    d = spark.createDataFrame([(0, 0, 5.0, "slot_0", 0.0, 0.0, None, 0.9, None)], schema("gaze_directions"))
    got = attribution.not_visible(l, e, d).orderBy("viewer_id").collect()
    assert [(r.viewer_id, r.start_time, r.end_time) for r in got] == [(f"slot_{i}", 0.0, 5.0) for i in (1, 2, 3)]


def frames(spark, arrangements):
    cell = lambda i: ("participant", (i % 3) / 3, 0.1, 0.3, 0.3)
    return spark.createDataFrame([(0, t, [cell(i) for i in a]) for t, a in arrangements], schema("frame_tiles"))


def test_flicker_leaves_the_layout(spark):
    seen = [(k / 10, [0, 1]) for k in range(10)] + [(1.0, [])] + [(1.1 + k / 10, [0, 1]) for k in range(9)] + [(2.0 + k / 10, [2]) for k in range(10)]
    got = layouts.segment_layouts(frames(spark, seen), 0.5).orderBy("interval_no").collect()
    assert [(r.start_time, r.end_time, len(r.tiles)) for r in got] == [(0.0, 2.0, 2), (2.0, None, 1)]


def test_segmentation_equals_a_state_machine(spark):
    rng, rows, want = random.Random(11), [], {}
    for rec in range(30):
        t, seq = 0.0, []
        for _ in range(rng.randrange(1, 8)):
            a = rng.choice([[0], [1], [0, 1], []])
            for _ in range(rng.randrange(1, 9)):
                seq.append((round(t, 3), a))
                t += 0.1
        rows += [(rec, x, [("participant", i / 3, 0.1, 0.3, 0.3) for i in a]) for x, a in seq]
        now = pending = None
        out = []
        for x, a in seq:
            if now is None:
                now, out = a, [x]
            elif a == now:
                pending = None
            else:
                pending = pending if pending and pending[0] == a else (a, x)
                if x - pending[1] >= 0.35:
                    now, pending = a, out.append(pending[1])
        want[rec] = out
    got = layouts.segment_layouts(spark.createDataFrame(rows, schema("frame_tiles")), 0.35).collect()
    for rec in want:
        assert sorted(r.start_time for r in got if r.recording_id == rec) == pytest.approx(want[rec])


def t_(x, y, w=0.3, h=0.3, kind="participant"):
    return {"kind": kind, "x": x, "y": y, "width": w, "height": h}


def test_identities_are_carried():
    two, three = [t_(0.0, 0.0), t_(0.4, 0.0)], [t_(0.0, 0.0), t_(0.4, 0.0), t_(0.0, 0.5)]
    names = lambda rs: [r["participant_id"] for r in rs]
    assert [names(x) for x in layouts.carry_identities([two, three], 0.5)] == [["slot_0", "slot_1"], ["slot_0", "slot_1", "slot_2"]]
    assert names(layouts.carry_identities([three, [three[0], three[2]]], 0.5)[1]) == ["slot_0", "slot_2"]
    gallery = [t_(i % 3 / 3, i // 3 / 3) for i in range(9)]
    strip = [t_(0.0, 0.0, 0.8, 1.0, "shared_content")] + [t_(0.85, 0.25 * i, 0.15, 0.2) for i in range(4)]
    a, b = layouts.carry_identities([gallery, strip], 0.5)
    ids = [n for n in names(a) + names(b) if n]
    assert len(set(ids)) == 13 and b[-1]["kind"] == "shared_content"


def test_breaks(spark):
    l = layout(spark, [tile("a", 0.0, 0.0, 0.5, 0.5), tile("b", 0.5, 0.0, 0.5, 0.5)], end=5.0).unionByName(layout(spark, [tile("c", 0.0, 0.0, 0.5, 0.5)], no=1, start=5.0))
    r = layouts.identity_breaks(l).first()
    assert (r.at_time, r.carried, r.introduced, r.ended, r.total) == (5.0, [], ["c"], ["a", "b"], True)


def test_names_take_their_first_spelling(spark):
    i = spark.createDataFrame([(0, 0, 0.0, 1.0, [t_(0.0, 0.0), t_(0.4, 0.0)], [" Ann ", ""]), (0, 1, 1.0, None, [t_(0.0, 0.0)], ["ANN"])], "recording_id bigint, interval_no int, start_time double, end_time double, tiles array<struct<kind:string,x:double,y:double,width:double,height:double>>, names array<string>")
    got = layouts.named_layouts(layouts.resolve_names(i)).orderBy("layout_no").collect()
    assert [[r.participant_id for r in g.regions] for g in got] == [["Ann", "slot_1"], ["Ann"]]


def test_ransac_and_calibration():
    x = np.arange(20.0)
    y = 2 * x + 0.5
    y[[3, 7, 11, 15]] += 5
    assert calibration.fit_ransac(x, y, 0.1) == pytest.approx((2.0, 0.5))
    for bad in (([1.0], [1.0]), ([1.0, 1.0], [1.0, 2.0]), ([1.0, 2.0], [1.0])):
        with pytest.raises(ValueError):
            calibration.fit_ransac(*map(np.array, bad), 0.1)
    yaw, pitch = np.linspace(-0.3, 0.3, 30), np.linspace(-0.3, 0.0, 30)
    s = calibration.calibrate(yaw, pitch, 0.5 + yaw, -3 * pitch)
    assert (s.left, s.right, s.top, s.bottom) == pytest.approx((-0.5, 0.5, 0.0, -1 / 3), abs=1e-9)
    with pytest.raises(ValueError):
        calibration.calibrate(yaw, pitch, 0.5 - yaw, -3 * pitch)


def test_weak_labels_and_reasons(spark):
    seg = spark.createDataFrame([(0, 1, "alice", 0.0, 2.0, 1.0, "highlight"), (0, 2, "bob", 4.0, 6.0, 1.0, "highlight")], schema("speaker_segments"))
    l = layout(spark, [tile("alice", 0.0, 0.0, 0.5, 1.0), tile("bob", 0.5, 0.0, 0.5, 1.0)])
    d = spark.createDataFrame([(0, i, t, "bob", 0.1, -0.1, None, 0.9, None) for i, t in enumerate((1.0, 5.0))], schema("gaze_directions"))
    got = calibration.weak_labels(d, seg, l)
    assert [(r.x, r.y) for r in got.collect()] == [(0.25, 0.5)]
    viewers = d.select("recording_id", F.col("person_id").alias("viewer_id"))
    assert calibration.calibrations(got, viewers, 20, seg, l).first().reason == "too few weak labels"
    assert calibration.calibrations(got, viewers, 20, seg, l.limit(0)).first().reason == "no layout"
    assert calibration.calibrations(got, viewers, 20, seg.limit(0), l).first().reason == "no speaker segments"


def scored(spark, truth, said, step=None):
    t = spark.createDataFrame([(0, i, "v", float(s), float(e), x, g) for i, (s, e, x, g) in enumerate(truth)], schema("truth"))
    e = spark.createDataFrame([(0, i, "v", x, float(a), float(b), float(c), "assumed_shared", "r") for i, (a, b, x, c) in enumerate(said)], schema("gaze_events"))
    return evaluation.predictions(t, e, step)


def test_scores(spark):
    p = scored(spark, [(0, 1, "alice", "2x2"), (1, 2, "carol", "2x2"), (2, 3, "alice", None), (3, 4, "off_screen", None)], [(0, 1, "alice", 0.9), (1, 2, "unknown", 0.9), (3, 4, "off_screen", 0.9)])
    s = evaluation.scores(p).first()
    assert (s.hit_rate, s.unknown_rate, s.off_screen_recall, s.silent, s.explicit_unknown) == (0.5, 0.5, 1.0, 1, 1)
    assert [tuple(r) for r in evaluation.per_grid(p).collect()] == [("2x2", 1, 2)]
    assert {tuple(r) for r in evaluation.confusion(p).collect()} == {("alice", "alice", 1), ("carol", "unknown", 1), ("alice", "silent", 1), ("off_screen", "off_screen", 1)}


def test_a_constant_estimator_is_its_own_baseline(spark):
    p = scored(spark, [(i, i + 1, x, None) for i, x in enumerate(["s4", "s4", "s4", "s1"])], [(0, 4, "s4", 0.9)])
    b = {r.strategy: r.score for r in evaluation.baselines(p).collect()}
    assert b == {"always_unknown": 0.0, "uniform_random": 0.5, "majority_truth": 0.75, "model_modal_target": 0.75}
    assert evaluation.scores(p).first().hit_rate == 0.75
    assert evaluation.baselines(p.limit(0)).count() == 0


def test_reliability_and_bins(spark):
    p = scored(spark, [(0, 1, "a", None), (1, 2, "a", None)], [(0, 1, "a", 0.9), (1, 2, "b", 0.9)])
    r = evaluation.reliability(p).first()
    assert (r["bin"], r["count"], r["hit_rate"]) == (4, 2, 0.5) and evaluation.calibration_error(p).first().ece == pytest.approx(0.4)
    edges = scored(spark, [(0, 1, "a", None)], [(0, 1, "a", 0.6)])
    assert evaluation.reliability(edges).first()["bin"] == 2  # 3 * 0.2 is a little more than 0.6


def test_first_holding_equals_a_product(spark):
    from sightline.operators.ranges import first_holding

    rng = random.Random(3)
    spans = [(rng.randrange(3), k, a := rng.uniform(-30, 60), a + rng.choice([0.0, 0.4, 9.0, 45.0]), f"v{k}") for k in range(60)]
    moments = [(rng.randrange(4), k, rng.choice([rng.uniform(-40, 120), spans[k % 60][2], spans[k % 60][3], 10.0])) for k in range(200)]
    i = spark.createDataFrame(spans, "g long, n long, s double, e double, v string")
    got = first_holding(spark.createDataFrame(moments, "g long, k long, t double"), "t", i, ["g"], "n", "s", "e", ["v"], "x").collect()
    assert len(got) == len(moments)
    for r in got:
        held = [v for g, _, s, e, v in spans if g == r.g and s <= r.t < e]
        assert (r.x.v if r.x else None) == (held[0] if held else None)


def test_samples_and_events_meet_without_a_product(spark):
    n = 300
    truth = spark.createDataFrame([(0, "v", k, float(k), k + 1.0, "a", None) for k in range(n)], "recording_id long, viewer_id string, truth_no long, start_time double, end_time double, target string, grid string")
    e = spark.createDataFrame([(0, "v", k, "a" if k % 2 else "unknown", float(k), k + 1.0, 0.9) for k in range(n)], "recording_id long, viewer_id string, event_no long, target string, start_time double, end_time double, confidence double")
    p = evaluation.predictions(truth, e)
    plan = p._jdf.queryExecution().executedPlan().toString()
    assert "_bin" in plan and "CartesianProduct" not in plan and p.count() == n and p.filter("hit").count() == n // 2


def test_similar_pairs_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(k % 2, float(k), rng.normal(size=4).tolist()) for k in range(60)], "recording_id long, ts double, vec array<double>")
    want = sorted(map(tuple, reid.similar_pairs(df, 0.5).collect()))
    monkeypatch.setattr(reid, "BLOCK", 7)
    assert sorted(map(tuple, reid.similar_pairs(df, 0.5).collect())) == want and len(want) > 20


def test_dense_samples(spark):
    truth, said = [(0, 10, "a", None)], [(4.5, 5.5, "a", 0.9)]
    assert evaluation.scores(scored(spark, truth, said)).first().hit_rate == 1.0
    assert evaluation.scores(scored(spark, truth, said, 1.0)).first().hit_rate < 0.2


def test_bootstrap_stream(spark):
    p = scored(spark, [(i, i + 1, "a", None) for i in range(20)], [(0, 14, "a", 0.9)])
    rng, hits = random.Random(20260101), [True] * 14 + [False] * 6
    rates = sorted(sum(hits[rng.randrange(20)] for _ in range(20)) / 20 for _ in range(1000))
    assert tuple(evaluation.bootstrap(p).first()) == (rates[25], rates[975])
    low, high = evaluation.bootstrap_poisson(p).first()
    assert low < 0.7 < high


def test_shape(spark):
    e = spark.createDataFrame([(0, i, "v", t, 0.0, float(n), 0.9, "s", r) for i, (t, n, r) in enumerate([("a", 2, "x"), ("b", 2, ""), ("v", 1, "self"), ("unknown", 5, "no region")])], schema("gaze_events"))
    s = diagnostics.shares(e).first()
    assert (s.top_target, s.top_target_share, s.self_view_share, s.unresolved_share) == ("a", 0.4, 0.1, 0.5)
    only = e.filter("target in ('a', 'b')")
    assert diagnostics.shares(only).first().normalized_entropy == pytest.approx(1.0)
    few = spark.createDataFrame([(0, 9)], "recording_id bigint, participants int")
    assert diagnostics.shares(only, few).first().normalized_entropy == pytest.approx(math.log(2) / math.log(9))
    assert {r.reason for r in diagnostics.by_reason(e).collect()} == {"x", "unrecorded", "self", "no region"}


def test_histogram_corners(spark):
    p = points(spark, [(0, 0.0, 0.0), (1, 1.0, 1.0)])
    cells = diagnostics.screen_histogram(p, 4)
    assert {(r.row, r.col, r.n) for r in cells.collect()} == {(0, 0, 1), (3, 3, 1)}
    h = diagnostics.dense_histogram(cells, 4).first().histogram
    assert h[0][0] == h[3][3] == 1 and sum(map(sum, h)) == 2


def test_rules(spark):
    base = {"recording_id": 0, "layouts": 1, "participants_detected": 4, "layout_sources": ["recording"], "face_attempts": 10, "face_hits": 9, "face_hit_rate": 0.9, "directions": 10, "off_screen": 1, "off_screen_rate": 0.1, "events": 3}
    codes = lambda **k: {r.code for r in coverage.degradations(spark.createDataFrame([base | k])).collect()}
    assert codes() == set()
    assert codes(layouts=0, participants_detected=0) == {"no_layout"}
    assert codes(participants_detected=0) == {"no_participant_regions"}
    assert codes(layout_sources=["assumed_shared"], face_hit_rate=0.2, off_screen_rate=0.6, events=0) == {"assumed_shared_layout", "low_face_hit_rate", "high_off_screen_rate", "no_events"}
    assert codes(top_target="a", top_target_share=0.7, normalized_entropy=0.3, centre_mass=0.6, self_view_share=0.3, uncalibrated=2, no_iris=True) == {"concentrated_targets", "low_target_entropy", "centre_clustered_gaze", "high_self_view", "uncalibrated_viewers", "no_iris_signal"}


def test_compare():
    a = {"provenance": {"video": {"sha256": "1", "path": "a"}, "adapters": [{"role": "gaze", "implementation": "x"}]}, "config": {"fps": 5, "d": {"k": 1}}, "coverage": {"frames": 5, "face_hit_rate": 0.5}, "evaluation": {"hit_rate": 0.5, "hit_rate_ci95": [0.4, 0.6]}}
    assert comparison.compare(a, a)["comparable"]
    b = a | {"provenance": {"video": {"sha256": "2", "path": "b"}, "adapters": []}, "config": {"fps": 5, "d": {"k": 2}}, "coverage": {"frames": 6, "face_hit_rate": 0.5}, "evaluation": {"hit_rate": 0.7, "hit_rate_ci95": [0.65, 0.8]}}
    got = comparison.compare(a, b)
    assert not got["comparable"] and [f for f, *_ in got["blockers"]] == ["video", "adapter.gaze"]
    assert got["configuration"] == [("config.d.k", 1, 2)] and got["coverage"] == [("coverage.frames", 5, 6)] and any("disjoint" in n for n in got["notes"])


def test_rows_that_break_rules(spark):
    good = (0, 0, 1.0, "p", 0.0, 0.0, None, 0.5, None)
    df = spark.createDataFrame([good, (0, 1, -1.0, "p", float("nan"), 0.0, None, 1.5, None)], schema("gaze_directions"))
    assert checks.broken(df, "gaze_directions").first().broken == ["ts", "yaw", "confidence"]
    assert checks.checked(df.limit(1), "gaze_directions").count() == 1
    with pytest.raises(Exception, match="breaks its rules"):
        checks.checked(df, "gaze_directions").collect()
    wide = layout(spark, [tile("a", 0.8, 0.0, 0.5, 0.5)])
    assert checks.broken(wide, "layouts").count() == 1


def test_gallery():
    g = reid.Gallery()
    assert [g.identify(v) for v in ([1, 0], [0, 1], [0.9, 0.1], [0.1, 0.95])] == ["person_0", "person_1", "person_0", "person_1"]


def test_quality_and_pose(spark):
    row = spark.range(1).select(G.quality(F.lit(0.9), F.lit(0.125), F.lit(0.4), F.lit(0.0), F.lit(math.pi / 4)).alias("q"), G.head_pose(F.array(*[F.lit(float(x)) for x in (1, 0, 0, 0, 1, 0, 0, 0, 1)])).alias("h"))
    r = row.select("q", "h", G.combined(F.col("q")).alias("c"), G.limiting(F.col("q")).alias("l")).first()
    assert r.q.size == 0.5 and r.q.head == 0.5 and r.c == pytest.approx(0.9 * 0.25) and r.l == "size" and tuple(r.h) == (0.0, 0.0, 0.0)


def test_mouth(spark):
    p = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    none = F.lit(None).cast("double")
    m = lambda *a: spark.range(1).select(G.mouth_open(*a).alias("m")).first().m
    zero = p(0.0, 0.0)
    assert m(F.lit(0.3), zero, zero, zero, zero, F.lit(0.0)) == 0.3
    assert m(none, p(0.5, 0.5), p(0.5, 0.6), zero, zero, F.lit(0.2)) == pytest.approx(0.5)
    assert m(none, zero, zero, p(0.4, 0.5), p(0.6, 0.5), F.lit(0.2)) == pytest.approx(1.0)
    assert m(none, zero, zero, zero, zero, F.lit(0.2)) is None


def test_noiseless_tour_scores_everything(spark):
    """A viewer looks at slots 1, 2, 3 and 0 for three seconds each; directions are the exact inverse of the projection."""
    from sightline.plans.attribute import attribute

    s, rows, truth = Screen(), [], []
    for d, slot in enumerate((1, 2, 3, 0)):
        x, y = 0.25 + 0.5 * (slot % 2), 0.25 + 0.5 * (slot // 2)
        truth.append((0, d, "slot_0", 3.0 * d, 3.0 * d + 3.0, f"slot_{slot}", "2x2"))
        rows += [(0, d * 15 + k, 3.0 * d + k / 5, "slot_0", s.left + x * (s.right - s.left), s.top - y * (s.top - s.bottom), None, 0.9, None) for k in range(15)]
    out = attribute(spark.createDataFrame(rows, schema("gaze_directions")), layout(spark, [tile(f"slot_{i}", i % 2 / 2, i // 2 / 2, 0.5, 0.5) for i in range(4)]), Config(min_fixation=0.3, max_gap=0.4, event_min_duration=0.4))
    assert evaluation.scores(evaluation.predictions(spark.createDataFrame(truth, schema("truth")), out.events)).first().hit_rate == 1.0
    assert coverage.unreconciled(out.per_participant()).count() == 0


def test_plan_moves_samples_once(spark):
    """One exchange for all of smoothing and fixations."""
    df = points(spark, [(k / 10, 0.5, 0.5) for k in range(5)]).withColumn("yaw", F.lit(0.0)).withColumn("pitch", F.lit(-0.1))
    plan = temporal.smoothed_fixations(df.drop("x", "y"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1




def test_equal_times_go_to_the_target_met_first(spark):
    """0.1 + 0.2 is more than 0.3 only by its last bit."""
    from sightline.operators import diagnostics

    rows = [(0, "v", "early", 0.0, 0.3, 1), (0, "v", "late", 1.0, 1.1, 2), (0, "v", "late", 0.0, 0.2, 3)]
    made = diagnostics.shares(spark.createDataFrame(rows, "recording_id long, viewer_id string, target string, start_time double, end_time double, event_no long"))
    assert (1.1 - 1.0) + 0.2 > 0.3 and made.first().top_target == "early"


def test_a_share_that_equals_a_limit_does_not_pass_it(spark):
    from sightline.operators import coverage

    row = "select 0L as recording_id, 2 as layouts, 12 as participants_detected, array('manifest') as layout_sources, 0 as face_attempts, 0 as face_hits, 0D as face_hit_rate, 9 as directions, 0 as off_screen, 0D as off_screen_rate, 7 as events"
    m = spark.sql(row + ", 'a' as top_target, 0.1D + 0.2D as top_target_share, 1D as normalized_entropy, 0.1D + 0.2D as self_view_share")
    assert 0.1 + 0.2 > 0.3 and coverage.degradations(m, {"top_share": 0.3, "self_view": 0.3}).count() == 0


def test_confidences_are_summed_in_one_order(spark):
    """Fixations from the last sample to the first, events from the first fixation to the last, whatever the reasons are."""
    v = [0.1, 0.7, 0.3, 0.2, 0.6, 0.9, 0.4, 0.3, 0.1, 0.8]
    rows = [(0, "v", i * 1.0, i * 1.0 + 0.9, "t", c, f"near border: {i % 3}", "m") for i, c in enumerate(v)]
    made = events.gaze_events(spark.createDataFrame(rows, "recording_id long, viewer_id string, start_time double, end_time double, target string, confidence double, reason string, layout_source string"))
    w = wc = 0.0
    for r in rows:
        w, wc = w + (r[3] - r[2]), wc + (r[3] - r[2]) * r[5]
    assert [r.confidence for r in made.collect()] == [wc / w]
    points = [(0, "v", i, i / 10, 0.5, 0.5, c) for i, c in enumerate(v)]
    found = temporal.detect_fixations(spark.createDataFrame(points, "recording_id long, person_id string, obs_no long, ts double, x double, y double, confidence double"))
    back = 0.0
    for c in reversed(v):
        back += c
    assert [r.confidence for r in found.collect()] == [back / len(v)]
