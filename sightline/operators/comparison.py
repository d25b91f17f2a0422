"""What differs between two runs, by what it means."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fields that are compared, in order.
COVERAGE = ("frames", "participants_detected", "face_attempts", "face_hits", "directions", "points", "off_screen", "fixations", "attributions", "events", "not_visible")
RATES = ("face_hit_rate", "off_screen_rate")
SHAPE = ("top_target", "top_target_share", "normalized_entropy", "self_view_share", "unresolved_share", "centre_mass")
SCORES = ("hit_rate", "unknown_rate", "off_screen_recall", "beats_baseline")


def run_diff(left: DataFrame, right: DataFrame, by: tuple[str, ...] = ("group", "field")) -> DataFrame:
    """by, left, right: fields (field, value: string) that two runs don't have alike; one that a run lacks is null there."""
    l, r = left.select(*by, F.col("value").alias("left")), right.select(*by, F.col("value").alias("right"))
    return l.join(r, list(by), "full_outer").filter(~F.col("left").eqNullSafe(F.col("right")))


def leaves(tree) -> dict:
    """What nested dictionaries hold, by dotted paths; a list is one value."""
    out, todo = {}, [((), tree)]
    while todo:
        path, x = todo.pop()
        if isinstance(x, dict):
            todo += [((*path, str(k)), v) for k, v in x.items()]
        else:
            out[".".join(path)] = x
    return out


class Field(NamedTuple):
    """A field of a record: what decides whether two are alike, and what is shown."""

    same: object
    shown: object


def plain(values: dict, under: str, digits: int | None = None, names: Iterable[str] | None = None) -> dict[str, Field]:
    """Fields that are shown as they are, rounded where asked for; names: only these, null where missing."""
    out = {}
    for name in values if names is None else names:
        x = values.get(name)
        x = round(float(x or 0.0), digits) if digits is not None else x
        out[f"{under}.{name}"] = Field(x, x)
    return out


def _part(record: dict, name: str) -> dict:
    return record.get(name) or {}


def _video(r: dict) -> dict[str, Field] | None:
    v = _part(r, "provenance").get("video")
    return {"video": Field(v.get("sha256"), v.get("path"))} if v else None


def _adapters(r: dict) -> dict[str, Field]:
    return plain({a["role"]: a["implementation"] for a in _part(r, "provenance").get("adapters", [])}, "adapter")


def _coverage(r: dict) -> dict[str, Field] | None:
    c = _part(r, "coverage")
    return plain(c, "coverage", names=COVERAGE) | plain(c, "coverage", 4, RATES) if c else None


def _durations(r: dict) -> dict[str, Field]:
    """Seconds of each target over all viewers, to a tenth."""
    viewers = _part(r, "results").get("viewers")
    total: Counter = Counter()
    for v in viewers.values() if isinstance(viewers, dict) else ():
        total.update({k: float(x) for k, x in (v.get("duration_by_target", {}) if isinstance(v, dict) else {}).items()})
    return plain(total, "duration", 1)


#: The groups of fields, in order: which group, how a record's fields are read (null: the record has none, and nothing is compared), and
#: what a field is that only one of two records has.
SECTIONS: tuple[tuple[str, Callable[[dict], dict[str, Field] | None], object], ...] = (
    ("blockers", _video, None),
    ("blockers", _adapters, "none"),
    ("configuration", lambda r: plain(leaves(_part(r, "config")), "config"), None),
    ("coverage", _coverage, None),
    ("results", lambda r: plain(d, "distribution", names=SHAPE) if (d := _part(r, "diagnostics")) else None, None),
    ("results", _durations, 0.0),
    ("evaluation", lambda r: {"evaluation": Field(bool(r.get("evaluation")), bool(r.get("evaluation")))}, None),
    ("evaluation", lambda r: plain(e, "evaluation", names=SCORES) if (e := _part(r, "evaluation")) else None, None),
)


def field_diff(left: dict[str, Field] | None, right: dict[str, Field] | None, missing: object) -> list[tuple]:
    """field, left, right of the fields that differ: those of the left record in its order, then the others; run_diff for two documents."""
    if left is None or right is None:
        return []
    none = Field(missing, missing)
    pairs = ((f, left.get(f, none), right.get(f, none)) for f in dict.fromkeys([*left, *right]))
    return [(f, a.shown, b.shown) for f, a, b in pairs if a.same != b.same]


def intervals_meet(left: dict, right: dict) -> bool | None:
    """Whether the hit rates' intervals have a value in common; null where one is missing."""
    x, y = (_part(r, "evaluation").get("hit_rate_ci95") for r in (left, right))
    return max(x[0], y[0]) <= min(x[1], y[1]) if x and y else None


#: What is said about a comparison, and when.
NOTES = (
    ("not directly comparable: another recording, or another source of observations", lambda d, meet: bool(d["blockers"])),
    ("hit-rate intervals overlap: the difference is inconclusive", lambda d, meet: meet is True),
    ("hit-rate intervals are disjoint", lambda d, meet: meet is False),
    ("only one run has scores", lambda d, meet: any(f == "evaluation" for f, *_ in d["evaluation"])),
    ("the runs cover different amounts of recording", lambda d, meet: any(f == "coverage.frames" for f, *_ in d["coverage"])),
)


def compare(left: dict, right: dict) -> dict:
    """Two run records (documents): comparable, and differences as (field, left, right) in groups, with notes."""
    found: dict[str, list] = {group: [] for group, _, _ in SECTIONS}
    for group, read, missing in SECTIONS:
        made = field_diff(read(left), read(right), missing)
        found[group] += sorted(made, key=lambda x: x[0]) if group in ("blockers", "configuration") or read is _durations else made
    meet = intervals_meet(left, right)
    return {"comparable": not found["blockers"], **found, "notes": [text for text, holds in NOTES if holds(found, meet)]}
