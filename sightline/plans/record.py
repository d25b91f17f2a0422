"""The document that describes a run, and its renderings. Small results only reach the driver."""

from __future__ import annotations

import hashlib
import html
import json
import subprocess
import time
from contextlib import contextmanager
from dataclasses import asdict
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import coverage, diagnostics, evaluation, layouts
from ..schemas import RECORD_SCHEMA, RECORD_VERSION, Config
from .attribute import Outcome

STEPS = ("frames", "face_attempts", "face_hits", "directions", "points", "fixations", "attributions", "events", "not_visible")


class Stopwatch:
    """Seconds and calls of named stages."""

    def __init__(self):
        self.seconds: dict[str, float] = {}
        self.calls: dict[str, int] = {}

    @contextmanager
    def stage(self, name: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began
            self.calls[name] = self.calls.get(name, 0) + 1

    def report(self, video_seconds: float | None = None) -> dict:
        total = sum(self.seconds.values())
        rows = [{"stage": k, "seconds": round(s, 3), "calls": self.calls[k], "share": round(s / total, 4) if total else 0.0} for k, s in sorted(self.seconds.items(), key=lambda x: -x[1])]
        return {"wall_seconds": round(total, 3), "video_seconds": video_seconds, "realtime_factor": round(video_seconds / total, 3) if video_seconds and total else None, "stages": rows}


def config_tree(config: Config) -> dict:
    return json.loads(json.dumps(asdict(config)))


def overrides(config: Config) -> list[str]:
    """Dotted names of settings that differ from the defaults."""
    from ..operators.comparison import leaves

    a, b = leaves(config_tree(config)), leaves(config_tree(Config()))
    return sorted(k for k in a if a[k] != b.get(k))


def config_hash(config: Config) -> str:
    return hashlib.sha256(json.dumps(config_tree(config), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def provenance(config: Config, video: dict | None = None, adapters: list[dict] | None = None) -> dict:
    try:
        commit = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, timeout=5).stdout.strip() or None
    except OSError:
        commit = None
    return {
        "created_at": datetime.now(timezone.utc).isoformat(timespec="seconds"), "git_commit": commit, "config_hash": config_hash(config),
        "overrides": overrides(config), "video": video, "adapters": adapters or [],
    }


def _one(df: DataFrame, recording_id: int) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.filter(F.col("recording_id") == recording_id).collect()]


def run_record(out: Outcome, recording_id: int, config: Config = Config(), truth: DataFrame | None = None, step: float | None = None, made: dict | None = None, timing: dict | None = None) -> dict:
    """The record of one recording of a run. Its size follows the number of participants, not of samples."""
    out = out.of(recording_id)
    try:
        return _record(out, recording_id, config, truth, step, made, timing)
    finally:
        out.forget()


def _record(out: Outcome, recording_id: int, config: Config, truth: DataFrame | None, step: float | None, made: dict | None, timing: dict | None) -> dict:
    metrics = out.metrics()
    row = _one(metrics, recording_id)
    cover = {k: v for k, v in row[0].items() if k != "recording_id"} if row else {}
    shape_keys = ("top_target", "top_target_share", "normalized_entropy", "self_view_share", "unresolved_share", "centre_mass")
    shape = {k: (round(v, 4) if isinstance(v, float) else v) for k in shape_keys if (v := cover.pop(k, None)) is not None or k == "top_target"}
    cover["per_participant"] = sorted(_one(out.per_participant(), recording_id), key=lambda r: r["participant_id"])
    shape["target_duration"] = {r["target"]: round(r["seconds"], 3) for r in sorted(_one(diagnostics.by_target(out.events), recording_id), key=lambda r: r["target"])}
    shape["reason_duration"] = {r["reason"]: round(r["seconds"], 3) for r in sorted(_one(diagnostics.by_reason(out.events), recording_id), key=lambda r: r["reason"])}
    cells = {(r["row"], r["col"]): r["n"] for r in _one(diagnostics.screen_histogram(out.points), recording_id)}
    shape["screen_histogram"] = [[cells.get((i, j), 0) for j in range(16)] for i in range(16)]
    viewers: dict = {}
    for r in _one(diagnostics.matrix(out.events), recording_id):
        v = viewers.setdefault(r["viewer_id"], {"events": 0, "duration_by_target": {}})
        v["events"] += r["events"]
        v["duration_by_target"][r["target"]] = round(r["seconds"], 3)
    breaks = [
        {k: v for k, v in r.items() if k not in ("recording_id", "viewer_id")} for r in _one(
            layouts.identity_breaks(out.layouts.filter(F.col("viewer_id") == F.lit(min(viewers, default="")))), recording_id,
        )
    ]
    scored = None
    if truth is not None:
        scored = evaluation_summary(evaluation.predictions(truth.filter(F.col("recording_id") == recording_id), out.events, step))
    return {
        "schema": RECORD_SCHEMA, "version": RECORD_VERSION, "provenance": made or provenance(config), "config": config_tree(config), "coverage": cover, "diagnostics": shape,
        "degradations": [{k: r[k] for k in ("stage", "code", "detail", "impact")} for r in _one(coverage.degradations(metrics), recording_id)], "identity_breaks": breaks,
        "calibrations": _one(out.calibrations, recording_id) if out.calibrations is not None else [], "timing": timing, "results": {"viewers": dict(sorted(viewers.items())), "total_events": sum(v["events"] for v in viewers.values())}, "evaluation": scored,
    }


def evaluation_summary(p: DataFrame) -> dict:
    s = evaluation.scores(p).first().asDict()
    base = {r["strategy"]: r["score"] for r in evaluation.baselines(p).collect()}
    low, high, how = evaluation.interval(p, s["total"])
    best = max(base.values(), default=0.0)
    four = lambda d: {k: round(v, 4) if isinstance(v, float) else v for k, v in d.items()}
    return four(s) | {
        "baselines": four(base), "best_baseline": round(best, 4), "beats_baseline": s["hit_rate"] > best, "hit_rate_ci95": [low, high], "interval": how, "ece": round(evaluation.calibration_error(p).first()["ece"], 4),
        "per_grid": {r["grid"]: [r["hits"], r["total"]] for r in evaluation.per_grid(p).collect()}, "reliability": [four(r.asDict()) for r in evaluation.reliability(p).orderBy("bin").collect()],
        "confusion": [r.asDict() for r in evaluation.confusion(p).orderBy("truth", "predicted").collect()],
    }


def verdict(record: dict) -> tuple[str, str]:
    """unscored, scored or warning, and why. Exact comparison with the best baseline is what the record stores."""
    e = record.get("evaluation")
    if not e:
        return "unscored", "No ground truth was given: nothing here says how often a target is right."
    rate = f"{e['hit_rate']:.1%} of {e['total']} samples match the ground truth; the best trivial strategy reaches {e['best_baseline']:.1%}."
    return ("scored", rate) if e["beats_baseline"] else ("warning", f"{rate} The estimates say nothing that a constant would not.")


def facts(record: dict) -> dict:
    """What the rules of LIMITS look at, as flat values."""
    c, d = record.get("coverage") or {}, record.get("diagnostics") or {}
    attempts, hits = c.get("face_attempts") or 0, c.get("face_hits") or 0
    adapters = (record.get("provenance") or {}).get("adapters", [])
    return {
        "scored": bool(record.get("evaluation")),
        "sources": set(c.get("layout_sources") or []),
        "attempts": attempts, "missed": attempts - hits, "hit_rate": c.get("face_hit_rate", 1.0) if attempts else 1.0,
        "never": ", ".join(sorted(p["participant_id"] for p in c.get("per_participant", []) if p["face_attempts"] and not p["directions"])),
        "changes": ", ".join(f"{b['at_time']:.0f} s" for b in record.get("identity_breaks") or [] if b["total"]),
        "unresolved": d.get("unresolved_share") or 0.0,
        "untrained": ", ".join(a["implementation"] for a in adapters if a.get("role") == "gaze" and not a.get("model_path")),
    }


#: Limits of a run: when each holds, and what it says.
LIMITS = (
    (lambda f: not f["scored"], "The run was not scored against ground truth."),
    (lambda f: "assumed_shared" in f["sources"], "All viewers were judged by one recorded layout, which only its own viewer is known to have seen."),
    (lambda f: f["hit_rate"] < 0.9, "{missed} of {attempts} crops gave no face; times are too short by an unknown amount."),
    (lambda f: f["never"], "Never resolved, and listed as not visible: {never}."),
    (lambda f: f["changes"], "At {changes} all participants changed; people on both sides are counted twice."),
    (lambda f: f["unresolved"] > 0.25, "{unresolved:.1%} of all time has no target."),
    (lambda f: f["untrained"], "Gaze comes from {untrained}, which is no trained model; neighbouring tiles are hard to tell apart."),
)


def limitations(record: dict) -> list[str]:
    """What this run can't support, from its own state."""
    f = facts(record)
    return [text.format(**f) for holds, text in LIMITS if holds(f)]


def outcome(p: dict) -> str:
    if p["directions"] or p["face_hits"]:
        return "observed"
    return "present, not resolvable" if p["face_attempts"] else "not present in this layout"


def render_markdown(record: dict) -> str:
    """Verdict, limits, degradations, funnel, participants, who looked at whom, shape, evaluation, provenance."""
    c, d = record.get("coverage") or {}, record.get("diagnostics") or {}
    kind, why = verdict(record)
    lines = ["# Gaze report", "", "All results are estimates.", "", f"**{kind}**: {why}", "", "## Limits", "", *(f"- {x}" for x in limitations(record)), "", "## Degradations", ""]
    lines += [f"- `{x['code']}` ({x['stage']}): {x['detail']}; {x['impact']}" for x in record.get("degradations") or []] or ["none"]
    lines += [
        "", "## Coverage", "", "| step | count |", "| --- | --- |", *(f"| {k} | {c.get(k, 0)} |" for k in STEPS), "", "## Participants", "",
        "| participant | outcome | directions | events |", "| --- | --- | --- | --- |"
    ]
    lines += [f"| {p['participant_id']} | {outcome(p)} | {p['directions']} | {p['events']} |" for p in c.get("per_participant", [])]
    lines += ["", "## Who looked at whom", "", "| viewer | target | seconds |", "| --- | --- | --- |"]
    lines += [f"| {v} | {t} | {s:.3f} |" for v, x in record["results"]["viewers"].items() for t, s in sorted(x["duration_by_target"].items())]
    lines += ["", "## Shape", "", *(f"- {k}: {d[k]}" for k in ("top_target", "top_target_share", "normalized_entropy", "self_view_share", "unresolved_share", "centre_mass") if k in d)]
    e = record.get("evaluation")
    if e:
        lines += ["", "## Evaluation", "", *(f"- {k}: {e[k]}" for k in ("hit_rate", "hit_rate_ci95", "unknown_rate", "off_screen_recall", "best_baseline", "ece"))]
    p = record.get("provenance") or {}
    return "\n".join([*lines, "", "## Provenance", "", f"- created: {p.get('created_at')}", f"- configuration: {p.get('config_hash')}", ""])


def heatmap(histogram: list[list[int]], cell: int = 12) -> str:
    """SVG of the screen; a cell's opacity follows its share of the fullest one."""
    peak = max((n for r in histogram for n in r), default=0)
    rects = [f'<rect x="{j * cell}" y="{i * cell}" width="{cell}" height="{cell}" fill="#06c" fill-opacity="{0.12 + 0.88 * n / peak:.3f}"/>' for i, r in enumerate(histogram) for j, n in enumerate(r) if n]
    size = cell * len(histogram)
    return f'<svg width="{size}" height="{size}" role="img" aria-label="gaze on the screen">{"".join(rects)}</svg>'


def timeline(events: list[dict]) -> str:
    end = max((e["end_time"] for e in events), default=0.0)
    rows = []
    for v in sorted({e["viewer_id"] for e in events}):
        bars = "".join(
            f'<i title="{html.escape(e["target"])}" style="left:{100 * e["start_time"] / end:.2f}%;width:{100 * (e["end_time"] - e["start_time"]) / end:.2f}%"></i>' for e in events if e["viewer_id"] == v
        ) if end else ""
        rows.append(f"<tr><th>{html.escape(v)}</th><td><div>{bars}</div></td></tr>")
    return "<table class=t>" + "".join(rows) + "</table>"


def render_html(record: dict, events: list[dict] = ()) -> str:
    """One page without outside files; every value is escaped."""
    body = []
    for line in render_markdown(record).split("\n"):
        text = html.escape(line)
        if line.startswith("#"):
            n = len(line) - len(line.lstrip("#"))
            body.append(f"<h{n}>{text.lstrip('# ')}</h{n}>")
        elif line.startswith("| ---"):
            continue
        elif line.startswith("|"):
            body.append("<pre>" + text + "</pre>")
        elif line:
            body.append(f"<p>{text}</p>")
    style = "body{font:14px sans-serif;max-width:60em;margin:auto}pre{margin:0}.t div{position:relative;height:1em;width:40em}.t i{position:absolute;height:1em;background:#06c}"
    shape = (record.get("diagnostics") or {}).get("screen_histogram") or []
    return f"<!doctype html><html><head><meta charset=utf-8><title>Gaze report</title><style>{style}</style></head><body>{''.join(body)}{heatmap(shape)}{timeline(list(events))}</body></html>"
