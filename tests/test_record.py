"""Stores, records and reports."""

import json

import pytest
from pyspark.sql import functions as F

from sightline.plans import record as R
from sightline.plans.attribute import attribute
from sightline.schemas import Config, schema
from sightline.sources import fixtures, readers, sinks

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outcome(spark):
    return attribute(fixtures.directions(spark, D), fixtures.layouts(spark, D), faces=fixtures.faces(spark, D))


def lines(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows) + "\n")
    return str(path)


def test_gaze_store(spark, tmp_path):
    d = fixtures.directions(spark, D).filter("recording_id = 0").limit(20).withColumn("head_pose", F.lit(None).cast("struct<yaw:double,pitch:double,roll:double>")).select(*schema("gaze_directions").names)
    sinks.write_gaze(d, str(tmp_path / "g"))
    got = readers.read_gaze(spark, str(tmp_path / "g"))
    assert got.count() == 20 and got.drop("recording_id", "obs_no").exceptAll(d.drop("recording_id", "obs_no")).count() == 0
    sinks.append_gaze(d, str(tmp_path / "g"))
    assert readers.read_gaze(spark, str(tmp_path / "g")).count() == 40
    sinks.write_gaze(d.limit(1), str(tmp_path / "small"))
    sinks.append_gaze(d, str(tmp_path / "small"))  # Spark reads the larger file, without a header, first
    assert readers.read_gaze(spark, str(tmp_path / "small")).count() == 21
    old = lines(tmp_path / "v1.jsonl", [{"schema": "other.gaze", "version": 1}, {"ts": 1.0, "person_id": "p", "yaw": 0.1, "pitch": 0.2, "confidence": 0.5}])
    assert readers.read_gaze(spark, old).first().quality is None
    for bad in ([{"schema": "other.gaze", "version": 3}], [{"ts": 1}], [{"schema": "other.thing", "version": 1}]):
        with pytest.raises(ValueError):
            readers.read_gaze(spark, lines(tmp_path / "bad.jsonl", bad))


def test_tables_and_manifest(spark, tmp_path, outcome):
    events = outcome.events.drop("recording_id")
    sinks.write_jsonl(events, str(tmp_path / "e"))
    got = readers.read_events(spark, str(tmp_path / "e"))
    assert got.count() == outcome.events.count() and got.filter("reason is null").count() == 0
    l = fixtures.layouts(spark, D).filter("recording_id = 0")
    sinks.save_manifest(l, str(tmp_path / "m"))
    back = readers.read_manifest(spark, str(tmp_path / "m"))
    assert back.select("viewer_id", "start_time", "end_time", "regions").collect() == l.orderBy("layout_no").select("viewer_id", "start_time", "end_time", "regions").collect()
    assert back.first().source == "manifest"
    sinks.write_table(outcome.points, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).filter("recording_id = 1").count() == outcome.points.filter("recording_id = 1").count()
    sinks.write_csv(outcome.events.filter("recording_id = 0"), str(tmp_path / "c"))
    c = spark.read.option("header", True).csv(str(tmp_path / "c"))
    assert c.columns == ["viewer", "target", "start", "end", "duration", "confidence", "reason"] and len(c.first()["start"].split(".")[1]) == 3


def test_other_readers(spark, tmp_path):
    t = readers.read_truth(spark, lines(tmp_path / "t", [{"viewer_id": "v", "start_time": 0.0, "end_time": 1.0, "target": "a"}]))
    assert t.first().grid is None
    s = readers.read_speaker_segments(spark, lines(tmp_path / "s", [{"participant_id": "a", "start_time": 0.0, "end_time": 1.0, "confidence": 1.0, "cue": "highlight"}]))
    assert s.first().cue == "highlight"
    p = readers.read_points(spark, lines(tmp_path / "p", [{"ts": 0.0, "person_id": "a", "x": 0.1, "y": 0.2, "confidence": 1.0}]))
    assert p.first().x == 0.1
    assert len(readers.file_digests(spark, str(tmp_path / "t")).first().sha256) == 64


def test_record_and_renderings(spark, tmp_path, outcome):
    watch = R.Stopwatch()
    with watch.stage("attribute"):
        doc = R.run_record(outcome, 0, truth=fixtures.truth(spark, D), timing=None)
    doc["timing"] = watch.report(60.0)
    assert doc["coverage"]["directions"] == doc["coverage"]["points"] + doc["coverage"]["off_screen"]
    assert doc["identity_breaks"][0]["total"] and doc["timing"]["stages"][0]["calls"] == 1
    codes = {d["code"] for d in doc["degradations"]}
    assert "assumed_shared_layout" in codes and doc["evaluation"]["hit_rate_ci95"][0] <= doc["evaluation"]["hit_rate"] <= doc["evaluation"]["hit_rate_ci95"][1]
    sinks.write_record(doc, str(tmp_path / "r"), spark)
    assert readers.read_record(spark, str(tmp_path / "r"))["coverage"] == json.loads(json.dumps(doc["coverage"]))
    sinks.write_record(doc | {"version": 9}, str(tmp_path / "r9"), spark)
    with pytest.raises(ValueError):
        readers.read_record(spark, str(tmp_path / "r9"))
    text = R.render_markdown(doc)
    heads = [line for line in text.split("\n") if line.startswith("## ")]
    assert heads == ["## Limits", "## Degradations", "## Coverage", "## Participants", "## Who looked at whom", "## Shape", "## Evaluation", "## Provenance"]
    page = R.render_html(doc | {"results": {"viewers": {"<b>": {"events": 1, "duration_by_target": {"x": 1.0}}}}}, [{"viewer_id": "<b>", "target": "x", "start_time": 0.0, "end_time": 1.0}])
    assert "<b>" not in page and "&lt;b&gt;" in page and "<svg" in page
    assert R.verdict(doc | {"evaluation": None})[0] == "unscored"
    plain = doc | {"evaluation": None}
    assert "accuracy" not in R.render_markdown(plain).lower() and any("not scored" in x for x in R.limitations(plain))


def test_config():
    from dataclasses import replace

    c = replace(Config(), max_gap=0.5)
    assert R.overrides(c) == ["max_gap"] and R.config_hash(c) != R.config_hash(Config()) and len(R.config_hash(c)) == 64


def test_limits_follow_the_record():
    good = {"evaluation": {"hit_rate": 1.0}, "coverage": {"face_attempts": 10, "face_hits": 10, "face_hit_rate": 1.0, "layout_sources": ["manifest"]}}
    assert R.limitations(good) == []
    bad = {
        "coverage": {"face_attempts": 10, "face_hits": 4, "face_hit_rate": 0.4, "layout_sources": ["assumed_shared"], "per_participant": [{"participant_id": "b", "face_attempts": 3, "directions": 0}, {"participant_id": "a", "face_attempts": 3, "directions": 0}]},
        "identity_breaks": [{"at_time": 12.4, "total": True}, {"at_time": 20.0, "total": False}], "diagnostics": {"unresolved_share": 0.3}, "provenance": {"adapters": [{"role": "gaze", "implementation": "geometric"}]},
    }
    said = R.limitations(bad)
    assert len(said) == 7 and said[2].startswith("6 of 10 crops") and "a, b" in said[3] and "12 s" in said[4] and "20 s" not in said[4] and "30.0%" in said[5] and "geometric" in said[6]


def test_compare_records():
    from sightline.operators.comparison import compare, leaves

    assert leaves({"a": {"b": 1, "c": [1, 2]}, "d": None}) == {"a.b": 1, "a.c": [1, 2], "d": None}
    left = {
        "provenance": {"video": {"sha256": "x", "path": "l.mp4"}, "adapters": [{"role": "gaze", "implementation": "geometric"}]}, "config": {"fps": 5, "screen": {"left": 1.0}},
        "coverage": {"frames": 10, "face_hit_rate": 0.90001}, "diagnostics": {"top_target": "a"}, "results": {"viewers": {"v": {"duration_by_target": {"a": 1.01, "b": 2.0}}, "w": {"duration_by_target": {"a": 1.0}}}},
        "evaluation": {"hit_rate": 0.5, "hit_rate_ci95": [0.4, 0.6]},
    }
    same = compare(left, left)
    assert same["comparable"] and same["notes"] == ["hit-rate intervals overlap: the difference is inconclusive"] and not any(same[k] for k in ("blockers", "configuration", "coverage", "results", "evaluation"))
    right = {
        "provenance": {"video": {"sha256": "y", "path": "r.mp4"}, "adapters": [{"role": "tiles", "implementation": "own"}]}, "config": {"fps": 5, "screen": {"left": 2.0}, "extra": True},
        "coverage": {"frames": 11, "face_hit_rate": 0.90002}, "diagnostics": {"top_target": "b"}, "results": {"viewers": {"v": {"duration_by_target": {"a": 2.04, "c": 0.3}}}},
        "evaluation": {"hit_rate": 0.9, "hit_rate_ci95": [0.61, 0.95]},
    }
    got = compare(left, right)
    assert not got["comparable"] and got["blockers"] == [("video", "l.mp4", "r.mp4"), ("adapter.gaze", "geometric", "none"), ("adapter.tiles", "none", "own")]
    assert got["configuration"] == [("config.extra", None, True), ("config.screen.left", 1.0, 2.0)] and got["coverage"] == [("coverage.frames", 10, 11)]
    assert got["results"] == [("distribution.top_target", "a", "b"), ("duration.b", 2.0, 0.0), ("duration.c", 0.0, 0.3)] and got["evaluation"] == [("evaluation.hit_rate", 0.5, 0.9)]
    assert len(got["notes"]) == 3 and got["notes"][1] == "hit-rate intervals are disjoint"
    alone = compare(left, right | {"evaluation": None})
    assert alone["evaluation"] == [("evaluation", True, False)] and "only one run has scores" in alone["notes"]
    assert compare({}, {})["comparable"]


def test_digests_of_files_of_any_size(spark, tmp_path, monkeypatch):
    import hashlib

    for k, n in enumerate((1, 10, 5000, 100_000)):
        (tmp_path / f"f{k}").write_bytes(bytes(range(256)) * (n // 256) + b"x" * (n % 256))
    monkeypatch.setattr(readers, "WHOLE", 1000)
    got = {r.path.split("/")[-1]: (r.length, r.sha256) for r in readers.file_digests(spark, str(tmp_path)).collect()}
    assert got == {f"f{k}": (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for k in range(4) for p in [tmp_path / f"f{k}"]}
