"""python -m sightline.plans.cli: analyze, attribute, report, compare and evaluate over run folders of Parquet tables."""

from __future__ import annotations

import argparse
import json
from dataclasses import replace

from pyspark.sql import SparkSession

from ..operators import adapters, comparison, evaluation
from ..schemas import Config
from ..sources import readers, sinks, video
from . import record as R
from .attribute import analyze, attribute


def _stage(a: argparse.Namespace, config: Config) -> tuple:
    """The gaze stage that the arguments name, and what the record says of it."""
    if a.stage:
        from importlib import import_module

        module, _, name = a.stage.partition(":")
        return getattr(import_module(module), name)(), [{"role": "gaze", "implementation": a.stage, "model_path": None}]
    observer = {"role": "observer", "implementation": a.observer, "model_path": a.model}
    return adapters.stage_of(a.gaze, a.observer, a.model, a.weights, config.gaze), [observer, {"role": "gaze", "implementation": a.gaze, "model_path": a.weights}]


def _save(out, folder: str, watch: R.Stopwatch) -> None:
    for name in ("points", "fixations", "attributions", "events"):
        with watch.stage(name):
            sinks.write_table(getattr(out, name), f"{folder}/{name}")


def _report(spark: SparkSession, out, folder: str, config: Config, recording: int, truth, made: dict | None, watch: R.Stopwatch) -> None:
    with watch.stage("record"):
        doc = R.run_record(out, recording, config, truth, made=made)
    doc["timing"] = watch.report()
    sinks.write_record(doc, f"{folder}/report.json", spark)
    rows = [r.asDict() for r in out.events.filter(f"recording_id = {recording}").collect()]
    for ext, text in (("md", R.render_markdown(doc)), ("html", R.render_html(doc, rows))):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/report.{ext}")
    sinks.write_csv(out.events.filter(f"recording_id = {recording}"), f"{folder}/events.csv")
    print(json.dumps({k: doc["coverage"].get(k, 0) for k in R.STEPS}))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sightline")
    sub = p.add_subparsers(dest="verb", required=True)
    for verb in ("analyze", "attribute", "report", "evaluate"):
        s = sub.add_parser(verb)
        s.add_argument("folder")
        s.add_argument("--recording", type=int, default=0)
        s.add_argument("--fps", type=float, default=5.0)
        s.add_argument("--truth")
        s.add_argument("--step", type=float)
        s.add_argument("--manifest")
        s.add_argument("--calibrate", action="store_true")
        s.add_argument("--video")
        s.add_argument("--stage", help="module:function that makes a gaze stage of your own")
        s.add_argument("--gaze", choices=("geometric", "appearance"), default="geometric")
        s.add_argument("--observer", choices=("mesh", "five-point"), default="mesh")
        s.add_argument("--model", help="the observer's model file")
        s.add_argument("--weights", help="weights of the appearance model")
    c = sub.add_parser("compare")
    c.add_argument("left")
    c.add_argument("right")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.verb == "compare":
        print(json.dumps(comparison.compare(*(readers.read_record(spark, f"{x}/report.json") for x in (a.left, a.right))), indent=2))
        return 0
    config = replace(Config(), target_fps=a.fps)
    truth = readers.read_truth(spark, a.truth, a.recording) if a.truth else None
    if a.verb == "evaluate":
        print(json.dumps(R.evaluation_summary(evaluation.predictions(truth, spark.read.parquet(f"{a.folder}/events"), a.step)), indent=2))
        return 0
    manifest = readers.read_manifest(spark, a.manifest, a.recording) if a.manifest else None
    made, watch = None, R.Stopwatch()
    if a.verb == "analyze":
        stage, adapters_ = _stage(a, config)
        out = analyze(video.decode_video(spark, a.video), stage, config, manifest, a.calibrate)
        made = R.provenance(config, video.probe_video(spark, a.video), adapters_)
        for name, table in (("layouts", out.layouts), ("directions", out.directions), ("speaker_segments", out.segments)):
            with watch.stage(name):  # tables are lazy: what is timed is their writing
                sinks.write_table(table, f"{a.folder}/{name}")
    else:
        tables = {n: spark.read.parquet(f"{a.folder}/{n}") for n in ("directions", "layouts")}
        segments = spark.read.parquet(f"{a.folder}/speaker_segments") if a.calibrate else None
        out = attribute(tables["directions"], tables["layouts"], config, manifest, segments, a.calibrate)
    if a.verb != "report":
        _save(out, a.folder, watch)
    _report(spark, out, a.folder, config, a.recording, truth, made, watch)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
