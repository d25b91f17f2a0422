"""Named queries over the driver's tables, with DuckDB SQL for the same results.

The SQL is built from shared parts: WITH names the common tables that a query's text asks for. Doubles are rounded to 6 places on both
sides; centroids of fixations are rounded to 9 before they meet rectangle edges, so that both engines see the same numbers.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import attribution, calibration, checks, comparison, coverage, diagnostics, evaluation, events, layouts, reid, temporal, vision
from ..schemas import Config, Screen, schema
from ..sources import fixtures as X
from ..sources import readers, sinks
from ..streaming import stateful
from .attribute import Outcome, speaker_flags

C = Config()
QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Common tables, in an order in which each only needs those before it.
PARTS = {
    "directions": X.duck_text(X.DIRECTIONS),
    "regions": X.duck_text(X.REGIONS),
    "truth": X.duck_text(X.TRUTH),
    "flags": X.duck_text(X.SPEAKER_FLAGS),
    "tiles": X.duck_tiles(),
    "raw": "select *, (yaw - radians(-16e0)) / (radians(16e0) - radians(-16e0)) as px, (0e0 - pitch) / (0e0 - radians(-19e0)) as py from directions",
    "projected": "select *, not (px between -0.05e0 and 1.05e0 and py between -0.05e0 and 1.05e0) as off_screen, least(1e0, greatest(0e0, px)) as x, least(1e0, greatest(0e0, py)) as y from raw",
    "around": "select *, lag(x) over w as xa, lead(x) over w as xc, lag(y) over w as ya, lead(y) over w as yc from projected where not off_screen window w as (partition by recording_id, person_id order by ts, obs_no)",
    "smooth": """select * exclude (x, y),
        case when xa is null and xc is null then x when xa is null then (x + xc) / 2e0 when xc is null then (xa + x) / 2e0 else greatest(least(xa, x), least(greatest(xa, x), xc)) end as x,
        case when ya is null and yc is null then y when ya is null then (y + yc) / 2e0 when yc is null then (ya + y) / 2e0 else greatest(least(ya, y), least(greatest(ya, y), yc)) end as y from around""",
    "gaps": "select *, case when ts - lag(ts) over (partition by recording_id, person_id order by ts, obs_no) > 0.3e0 then 1 else 0 end as g from smooth",
    "segs": "select *, sum(g) over (partition by recording_id, person_id order by ts, obs_no) as seg from gaps",
    "s": "select *, row_number() over (partition by recording_id, person_id, seg order by ts, obs_no) - 1 as i from segs",
    "pairs": """select a.recording_id, a.person_id, a.seg, a.i, b.i as j, b.ts - a.ts as d, max(b.x) over w - min(b.x) over w + (max(b.y) over w - min(b.y) over w) as disp
        from s a join s b on a.recording_id = b.recording_id and a.person_id = b.person_id and a.seg = b.seg and b.i >= a.i
        window w as (partition by a.recording_id, a.person_id, a.seg, a.i order by b.i rows between unbounded preceding and current row)""",
    "firsts": "select *, min(case when d >= 0.15e0 then j end) over (partition by recording_id, person_id, seg, i) as j0 from pairs",
    "nexts": "select recording_id, person_id, seg, i, max(case when j >= j0 and disp <= 0.12e0 then j end) as j1 from firsts group by all",
    "walk": """select recording_id, person_id, seg, i, j1 from nexts where i = 0 union all
        select n.recording_id, n.person_id, n.seg, n.i, n.j1 from walk w join nexts n on n.recording_id = w.recording_id and n.person_id = w.person_id and n.seg = w.seg and n.i = coalesce(w.j1, w.i) + 1""",
    "fixations": """select w.recording_id, w.person_id, avg(x) as x, avg(y) as y, min(ts) as start_time, max(ts) as end_time, avg(confidence) as confidence, max(x) - min(x) + (max(y) - min(y)) as dispersion
        from walk w join s on s.recording_id = w.recording_id and s.person_id = w.person_id and s.seg = w.seg and s.i between w.i and w.j1
        where w.j1 is not null group by w.recording_id, w.person_id, w.seg, w.i""",
    "fixed": "select recording_id, person_id as viewer_id, round(x, 9) as x, round(y, 9) as y, start_time, end_time, confidence from fixations",
    "layouts": "select recording_id, layout_no, min(start_time) as start_time, min(end_time) as end_time from regions group by all",
    "active": "select f.*, min(l.layout_no) as layout_no from fixed f join layouts l on f.recording_id = l.recording_id and l.start_time <= f.start_time and (l.end_time is null or f.start_time < l.end_time) group by all",
    "hits": """select a.*, r.region_no, r.kind, r.participant_id, r.width as w, r.height as h, least(a.x - r.x, r.x + r.width - a.x, a.y - r.y, r.y + r.height - a.y) as edge
        from active a left join regions r on r.recording_id = a.recording_id and r.layout_no = a.layout_no and a.x between r.x and r.x + r.width and a.y between r.y and r.y + r.height""",
    "counted": """select recording_id, viewer_id, start_time, end_time, confidence as sure, count(region_no) as n, min(coalesce(participant_id, kind)) as t,
        least(1e0, greatest(0e0, min(edge) / (least(min(w), min(h)) / 2e0))) as ratio from hits group by all""",
    "attributions": """select recording_id, viewer_id, start_time, end_time, case when n <> 1 then 'unknown' when sure * ratio < 0.15e0 then 'low_confidence' else t end as target,
        case when n <> 1 then sure else sure * ratio end as confidence,
        case when n = 0 then 'no region' when n > 1 then 'ambiguous overlap' when sure * ratio < 0.15e0 then concat('near border: ', t) when t = viewer_id then 'self' else 'center hit' end as reason,
        case when n = 1 then ratio end as margin_ratio from counted""",
    "changes": "select *, case when target = lag(target) over w then 0 else 1 end as c, row_number() over w as pos from attributions window w as (partition by recording_id, viewer_id order by start_time, end_time, reason, confidence, target)",
    "runs": "select *, sum(c) over (partition by recording_id, viewer_id order by pos) as run from changes",
    "splits": "select *, case when start_time - max(end_time) over (partition by recording_id, viewer_id, run order by pos rows between unbounded preceding and 1 preceding) > 0.3e0 then 1 else 0 end as sp from runs",
    "islands": "select *, sum(sp) over (partition by recording_id, viewer_id, run order by pos) as isl, greatest(end_time - start_time, 1e-9) as wt from splits",
    "reasons": "select recording_id, viewer_id, run, isl, reason, sum(wt) as w, min(pos) as p from islands group by all",
    "best": "select recording_id, viewer_id, run, isl, arg_max(reason, {'w': w, 'p': -p}) as reason from reasons group by all",
    "gaze": """select i.recording_id, i.viewer_id, min(i.target) as target, min(start_time) as start_time, max(end_time) as end_time, sum(wt * confidence) / sum(wt) as confidence, min(b.reason) as reason
        from islands i join best b on b.recording_id = i.recording_id and b.viewer_id = i.viewer_id and b.run = i.run and b.isl = i.isl
        group by i.recording_id, i.viewer_id, i.run, i.isl having max(end_time) - min(start_time) >= 0.2e0""",
    "horizon": "select recording_id, max(ts) as horizon from directions group by all",
    "unseen": """select w.recording_id, w.viewer_id, w.start_time, w.end_time from (
          select r.recording_id, r.participant_id as viewer_id, r.start_time, coalesce(r.end_time, h.horizon, 0e0) as end_time from regions r left join horizon h using (recording_id) where r.kind = 'participant') w
        where w.end_time > w.start_time and not exists (select 1 from gaze e where e.recording_id = w.recording_id and e.viewer_id = w.viewer_id and e.end_time > w.start_time and e.start_time < w.end_time)""",
    "unnumbered": "select recording_id, viewer_id, target, start_time, end_time, confidence, reason from gaze union all select recording_id, viewer_id, 'not_visible', start_time, end_time, 1e0, 'no usable observation' from unseen",
    "events_": "select *, row_number() over (partition by recording_id order by case when target = 'not_visible' then 1 else 0 end, viewer_id, start_time, end_time, target) as event_no from unnumbered",
    "samples": "select *, (start_time + end_time) / 2e0 as t from truth",
    "predicted": """select s.recording_id, s.viewer_id, s.truth_no, s.target, s.grid, arg_min(e.target, e.event_no) as predicted, arg_min(e.confidence, e.event_no) as confidence
        from samples s left join events_ e on e.recording_id = s.recording_id and e.viewer_id = s.viewer_id and e.start_time <= s.t and s.t < e.end_time group by all""",
    "steps": "select *, start_time + 0.4e0 / 2e0 as t from truth where start_time + 0.4e0 / 2e0 < end_time union all select * replace (t + 0.4e0 as t) from steps where t + 0.4e0 < end_time",
    "dense": "select * from steps union all select *, (start_time + end_time) / 2e0 as t from truth where not start_time + 0.4e0 / 2e0 < end_time",
    "dense_predicted": """select s.recording_id, s.viewer_id, s.truth_no, s.t, s.target, arg_min(e.target, e.event_no) as predicted
        from dense s left join events_ e on e.recording_id = s.recording_id and e.viewer_id = s.viewer_id and e.start_time <= s.t and s.t < e.end_time group by all""",
    "dense_p": "select *, predicted is not null and predicted not in ('unknown', 'low_confidence', 'not_visible') as answered, coalesce(predicted is not null and predicted not in ('unknown', 'low_confidence', 'not_visible') and predicted = target, false) as hit from dense_predicted",
    "p": "select *, predicted is not null and predicted not in ('unknown', 'low_confidence', 'not_visible') as answered, coalesce(predicted is not null and predicted not in ('unknown', 'low_confidence', 'not_visible') and predicted = target, false) as hit from predicted",
    "fch": "select *, case when participant_id = lag(participant_id) over w then 0 else 1 end as c, row_number() over w as pos from flags window w as (partition by recording_id order by start_time, end_time, participant_id, confidence)",
    "frun": "select *, sum(c) over (partition by recording_id order by pos) as run from fch",
    "fsp": "select *, case when start_time - max(end_time) over (partition by recording_id, run order by pos rows between unbounded preceding and 1 preceding) > 0.5e0 then 1 else 0 end as sp from frun",
    "fis": "select *, sum(sp) over (partition by recording_id, run order by pos) as isl, greatest(end_time - start_time, 1e-9) as wt from fsp",
    "speech": "select recording_id, row_number() over (partition by recording_id order by run, isl) as segment_no, * exclude (recording_id, run, isl) from (select recording_id, run, isl, min(participant_id) as participant_id, min(start_time) as start_time, max(end_time) as end_time, sum(wt * confidence) / sum(wt) as confidence from fis group by recording_id, run, isl having max(end_time) - min(start_time) >= 0.4e0)",
    "spoke": "select d.recording_id, d.person_id as viewer_id, d.obs_no, d.ts, d.yaw, d.pitch, arg_min(g.participant_id, g.segment_no) as speaker from directions d join speech g on g.recording_id = d.recording_id and g.start_time <= d.ts and d.ts < g.end_time group by all",
    "labels_": "select s.recording_id, s.viewer_id, s.obs_no, s.ts, s.yaw, s.pitch, r.x + r.width / 2e0 as x, r.y + r.height / 2e0 as y from spoke s join regions r on r.recording_id = s.recording_id and r.layout_no = 0 and r.participant_id = s.speaker where s.speaker <> s.viewer_id",
    "sigs": "select recording_id, k, min(ts) as ts, coalesce(string_agg(sig, ';' order by sig), '') as sig from (select recording_id, k, ts, concat_ws(',', kind, cast(round_even(x * 50, 0) as int), cast(round_even(y * 50, 0) as int), cast(round_even(width * 50, 0) as int), cast(round_even(height * 50, 0) as int)) as sig from tiles) group by recording_id, k",
    "frames": "select r.range as recording_id, k.range as k, k.range / 5e0 as ts, coalesce(g.sig, '') as sig from range(10) r cross join range(100) k left join sigs g on g.recording_id = r.range and g.k = k.range",
    "fchg": "select *, case when sig = lag(sig) over w then 0 else 1 end as c from frames window w as (partition by recording_id order by ts)",
    "frn": "select *, sum(c) over (partition by recording_id order by ts) as run from fchg",
    "fgr": "select recording_id, run, min(ts) as start_time, max(ts) as last, min(sig) as sig, min(k) as k from frn group by all",
    "fkept": "select * from fgr where run = 1 or last - start_time >= 2e0",
    "flag": "select *, sig is not distinct from lag(sig) over (partition by recording_id order by run) and row_number() over (partition by recording_id order by run) > 1 as same from fkept",
    "intervals": "select recording_id, row_number() over w - 1 as interval_no, start_time, lead(start_time) over w as end_time, k from flag where not same window w as (partition by recording_id order by run)",
    "cells": "select recording_id, least(15, trunc(y * 16)::int) as row, least(15, trunc(x * 16)::int) as col, count(*) as n from projected where not off_screen group by all",
}
BASE = {"events", "conversations", "embeddings"}


def nudged(text: str) -> str:
    """round(x, n) becomes round(x + NUDGE, n)."""
    out, at = "", 0
    for m in re.finditer(r"\bround\(", text):
        depth, i = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(text[i], 0)
            i += 1
        cut = text.rindex(",", m.end(), i)
        out += text[at:cut] + f" + {NUDGE}"
        at = cut
    return out + text[at:]


def with_parts(final: str) -> str:
    """The text of a query with the common tables it names, directly or by others."""
    final = nudged(final)
    need: set[str] = set()

    def ask(text: str) -> None:
        for name in re.findall(r"\b(?:from|join)\s+(\w+)", text):
            if name in PARTS and name not in need:
                need.add(name)
                ask(PARTS[name])

    ask(final)
    if not need:
        return final
    return "with recursive " + ",\n".join(f"{n} as ({PARTS[n]})" for n in PARTS if n in need) + "\n" + final


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_parts(sql)
        return f

    return add


#: Added before rounding, so that values midway between two results go up in both engines whatever their last bits are.
NUDGE = 1e-9


def r6(name: str, col=None, places: int = 6):
    return F.round((F.col(name) if col is None else col) + NUDGE, places).alias(name)


def _steady(fixed: DataFrame) -> DataFrame:
    return fixed.withColumns({"x": F.round("x", 9), "y": F.round("y", 9)})


def _outcome(spark: SparkSession, d: str) -> Outcome:
    """A run over the derived directions, layouts and faces."""
    directions, recorded = X.directions(spark, d), X.layouts(spark, d)
    projected = temporal.project(directions)
    fixed = _steady(temporal.smoothed_fixations(directions))
    judged = attribution.attribute_fixations(fixed, recorded)
    merged = events.gaze_events(judged)
    unseen = attribution.not_visible(recorded, merged, directions)
    shown = layouts.assumed_layouts(directions.select("recording_id", F.col("person_id").alias("viewer_id")), recorded)
    return Outcome(projected, fixed, judged, events.numbered(merged.unionByName(unseen)), unseen, shown, faces=X.faces(spark, d))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return _outcome(spark, d).events


@query("select recording_id, obs_no, person_id, off_screen, round(x, 6) as x, round(y, 6) as y from projected")
def project_points(spark, d):
    return temporal.project(X.directions(spark, d)).select("recording_id", "obs_no", "person_id", "off_screen", r6("x"), r6("y"))


@query("select recording_id, person_id, count(*) as directions, sum(off_screen::int)::bigint as off_screen, round(sum(off_screen::int) / count(*), 6) as rate from projected group by recording_id, person_id")
def offscreen_rate(spark, d):
    p = temporal.project(X.directions(spark, d))
    off = F.sum(F.col("off_screen").cast("long"))
    return p.groupBy("recording_id", "person_id").agg(F.count("*").alias("directions"), off.alias("off_screen"), r6("rate", off / F.count("*")))


@query("select recording_id, person_id, obs_no, round(x, 6) as x, round(y, 6) as y from smooth")
def median_smooth(spark, d):
    p = temporal.project(X.directions(spark, d)).filter("not off_screen")
    return temporal.median_smooth(p).select("recording_id", "person_id", "obs_no", r6("x"), r6("y"))


@query("""select recording_id, person_id, obs_no, round(quantile_cont(x, 0.5) over w, 6) as x, round(quantile_cont(y, 0.5) over w, 6) as y from projected where not off_screen
    window w as (partition by recording_id, person_id order by ts, obs_no rows between 2 preceding and 2 following)""")
def median_smooth_wide(spark, d):
    p = temporal.project(X.directions(spark, d)).filter("not off_screen")
    return temporal.median_smooth(p, 5).select("recording_id", "person_id", "obs_no", r6("x"), r6("y"))


@query("select recording_id, person_id, round(start_time, 6) as start_time, round(end_time, 6) as end_time, round(x, 6) as x, round(y, 6) as y, round(confidence, 6) as confidence, round(dispersion, 6) as dispersion from fixations")
def fixations(spark, d):
    f = temporal.smoothed_fixations(X.directions(spark, d))
    return f.select("recording_id", "person_id", *[r6(c) for c in ("start_time", "end_time", "x", "y", "confidence", "dispersion")])


@query("select recording_id, viewer_id, round(start_time, 6) as start_time, layout_no from active")
def active_layout_join(spark, d):
    f = temporal.smoothed_fixations(X.directions(spark, d))
    rows = f.join(layouts.in_order(X.layouts(spark, d), ["recording_id"]), "recording_id").withColumn("l", layouts.active(F.col("layouts"), F.col("start_time"))).filter("l is not null")
    return rows.select("recording_id", F.col("person_id").alias("viewer_id"), r6("start_time"), "l.layout_no")


@query("select recording_id, viewer_id, round(start_time, 6) as start_time, target, reason, round(confidence, 6) as confidence, round(margin_ratio, 6) as margin_ratio from attributions")
def attribute_points(spark, d):
    return _outcome(spark, d).attributions.select("recording_id", "viewer_id", r6("start_time"), "target", "reason", r6("confidence"), r6("margin_ratio"))


@query("select recording_id, viewer_id, target, round(start_time, 6) as start_time, round(end_time, 6) as end_time, round(confidence, 6) as confidence, reason from gaze")
def gaze_events(spark, d):
    return _events(spark, d).filter("target <> 'not_visible'").select("recording_id", "viewer_id", "target", r6("start_time"), r6("end_time"), r6("confidence"), "reason")


@query("select recording_id, viewer_id, target, count(*) as events, round(sum(end_time - start_time), 6) as seconds from gaze group by recording_id, viewer_id, target")
def gaze_matrix(spark, d):
    """Flagship: who looked at whom, and for how long. Samples move once, fixations once."""
    judged = attribution.attribute_fixations(_steady(temporal.smoothed_fixations(X.directions(spark, d))), X.layouts(spark, d))
    return diagnostics.matrix(events.gaze_events(judged)).select("recording_id", "viewer_id", "target", "events", r6("seconds"))


@query("select recording_id, viewer_id, round(start_time, 6) as start_time, round(end_time, 6) as end_time from unseen")
def not_visible(spark, d):
    return _outcome(spark, d).not_visible.select("recording_id", "viewer_id", r6("start_time"), r6("end_time"))


_FUNNEL = """select coalesce(a.recording_id, u.recording_id) as recording_id, coalesce(a.id, u.id) as participant_id, coalesce(directions, 0) as directions, coalesce(points, 0) as points, coalesce(off_screen, 0) as off_screen,
      coalesce(fixations, 0) as fixations, coalesce(attributions, 0) as attributions, coalesce(events, 0) as events, coalesce(n, 0) as not_visible, coalesce(attempts, 0)::bigint as face_attempts, coalesce(directions, 0) as face_hits
    from (select d.recording_id, d.person_id as id, count(*) as directions, sum((not off_screen)::int)::bigint as points, sum(off_screen::int)::bigint as off_screen, count(*) + sum((obs_no % 7 = 0)::int) as attempts,
        (select count(*) from fixations f where f.recording_id = d.recording_id and f.person_id = d.person_id) as fixations,
        (select count(*) from attributions f where f.recording_id = d.recording_id and f.viewer_id = d.person_id) as attributions,
        (select count(*) from gaze f where f.recording_id = d.recording_id and f.viewer_id = d.person_id) as events
      from projected d group by d.recording_id, d.person_id) a
    full join (select recording_id, viewer_id as id, count(*) as n from unseen group by all) u on u.recording_id = a.recording_id and u.id = a.id"""


@query(_FUNNEL)
def coverage_funnel(spark, d):
    return _outcome(spark, d).per_participant()


@query(f"""select recording_id, sum(directions)::bigint as directions, sum(points)::bigint as points, sum(off_screen)::bigint as off_screen, (sum(events) + sum(not_visible))::bigint as events, sum(not_visible)::bigint as not_visible,
      2 as layouts, 12 as participants_detected, round(sum(off_screen) / sum(directions), 6) as off_screen_rate, round(sum(face_hits) / sum(face_attempts), 6) as face_hit_rate from ({_FUNNEL}) group by recording_id""")
def coverage_totals(spark, d):
    o = _outcome(spark, d)
    t = coverage.totals(o.per_participant(), o.layouts)
    return t.select(
        "recording_id", "directions", "points", "off_screen", "events", "not_visible", F.col("layouts").cast("int").alias("layouts"),
        F.col("participants_detected").cast("int").alias("participants_detected"), r6("off_screen_rate"), r6("face_hit_rate"),
    )


@query("select i.recording_id, i.interval_no::int as interval_no, round(i.start_time, 6) as start_time, round(i.end_time, 6) as end_time, (select count(*) from tiles t where t.recording_id = i.recording_id and t.k = i.k)::int as n_tiles from intervals i")
def layout_segments(spark, d):
    s = layouts.segment_layouts(X.frame_tiles(spark, d), C.layout_debounce)
    return s.select("recording_id", "interval_no", r6("start_time"), r6("end_time"), F.size("tiles").alias("n_tiles"))


_IDS = "select recording_id, layout_no, start_time, list_sort(list(participant_id)) as ids from regions where kind = 'participant' group by all"


@query(f"""select b.recording_id, b.start_time as at_time, array_to_string(list_sort(list_intersect(a.ids, b.ids)), ',') as carried, array_to_string(list_sort(list_filter(b.ids, lambda x: not list_contains(a.ids, x))), ',') as introduced,
      array_to_string(list_sort(list_filter(a.ids, lambda x: not list_contains(b.ids, x))), ',') as ended, len(list_intersect(a.ids, b.ids)) = 0 as total
    from ({_IDS}) a join ({_IDS}) b on a.recording_id = b.recording_id and b.layout_no = a.layout_no + 1""")
def layout_breaks(spark, d):
    b = layouts.identity_breaks(X.layouts(spark, d))
    return b.select("recording_id", "at_time", *[F.array_join(k, ",").alias(k) for k in ("carried", "introduced", "ended")], "total")


@query()
def carried_ids(spark, d):
    made = layouts.build_layouts(layouts.segment_layouts(X.frame_tiles(spark, d), C.layout_debounce), continuity=C.continuity)
    return made.select("recording_id", "layout_no", F.posexplode("regions").alias("region_no", "r")).select("recording_id", "layout_no", "region_no", "r.kind", "r.participant_id")


@query("select recording_id, interval_no::int as layout_no, t.tile_no as region_no, t.kind, case when t.kind = 'participant' then concat('slot_', cast(count(*) filter (t.kind = 'participant') over (partition by recording_id, interval_no order by t.tile_no) - 1 as varchar)) end as participant_id from intervals i join tiles t using (recording_id, k)")
def named_slots(spark, d):
    s = layouts.segment_layouts(X.frame_tiles(spark, d), C.layout_debounce).withColumn("names", F.transform("tiles", lambda t: F.lit(None).cast("string")))
    made = layouts.named_layouts(layouts.resolve_names(s))
    return made.select("recording_id", "layout_no", F.posexplode("regions").alias("region_no", "r")).select("recording_id", "layout_no", "region_no", "r.kind", "r.participant_id")


@query("select recording_id, segment_no, participant_id, round(start_time, 6) as start_time, round(end_time, 6) as end_time, round(confidence, 6) as confidence from speech")
def speaker_segments(spark, d):
    s = events.speaker_segments(X.speaker_flags(spark, d))
    return s.select("recording_id", "segment_no", "participant_id", r6("start_time"), r6("end_time"), r6("confidence"))


def _labels(spark, d):
    return calibration.weak_labels(X.directions(spark, d), events.speaker_segments(X.speaker_flags(spark, d)), X.layouts(spark, d))


@query("select recording_id, viewer_id, obs_no, round(yaw, 6) as yaw, round(pitch, 6) as pitch, round(x, 6) as x, round(y, 6) as y from labels_")
def weak_labels(spark, d):
    return _labels(spark, d).select("recording_id", "viewer_id", "obs_no", *[r6(c) for c in ("yaw", "pitch", "x", "y")])


@query("""select recording_id, viewer_id, count(*) as labels, round(regr_slope(x, yaw), 4) as x_slope, round(regr_intercept(x, yaw), 4) as x_intercept, round(regr_slope(y, pitch), 4) as y_slope, round(regr_intercept(y, pitch), 4) as y_intercept
    from labels_ group by recording_id, viewer_id having count(*) >= 5""")
def calibration_fit(spark, d):
    f = calibration.least_squares(_labels(spark, d)).filter("labels >= 5")
    return f.select("recording_id", "viewer_id", "labels", *[r6(c, places=4) for c in ("x_slope", "x_intercept", "y_slope", "y_intercept")])


@query()
def calibration_ransac(spark, d):
    dirs, segs, lays = X.directions(spark, d), events.speaker_segments(X.speaker_flags(spark, d)), X.layouts(spark, d)
    viewers = dirs.select("recording_id", F.col("person_id").alias("viewer_id"))
    return calibration.calibrations(calibration.weak_labels(dirs, segs, lays), viewers, 5, segs, lays)


@query("select recording_id, target, round(sum(end_time - start_time), 6) as seconds from events_ group by recording_id, target")
def target_durations(spark, d):
    return diagnostics.by_target(_events(spark, d)).select("recording_id", "target", r6("seconds"))


@query("select recording_id, reason, round(sum(end_time - start_time), 6) as seconds from events_ group by recording_id, reason")
def reason_durations(spark, d):
    return diagnostics.by_reason(_events(spark, d)).select("recording_id", "reason", r6("seconds"))


_SHARES = """(select *, case when target in ('unknown', 'off_screen', 'not_visible', 'low_confidence') then 0 else d end as named from (
      select recording_id, target, sum(end_time - start_time) as d, min(event_no) as f, sum(case when target = viewer_id then end_time - start_time else 0e0 end) as own from events_ group by recording_id, target))"""


@query(f"""select recording_id, arg_max(target, {{'d': round(named, 9), 'f': -f}}) filter (named > 0) as top_target, round(max(named) / sum(named), 4) as top_target_share, round(sum(own) / sum(d), 4) as self_view_share, round(1 - sum(named) / sum(d), 4) as unresolved_share from {_SHARES} group by recording_id""")
def target_shares(spark, d):
    s = diagnostics.shares(_events(spark, d).withColumn("end_time", F.col("end_time")))
    return s.select("recording_id", "top_target", *[r6(c, places=4) for c in ("top_target_share", "self_view_share", "unresolved_share")])


@query(f"""select recording_id, round(-sum(case when named > 0 then named / t * ln(named / t) else 0e0 end) / ln(greatest(12, count(*) filter (named > 0))), 4) as normalized_entropy
    from (select *, sum(named) over (partition by recording_id) as t from {_SHARES}) group by recording_id""")
def normalized_entropy(spark, d):
    e = _events(spark, d)
    s = diagnostics.shares(e, e.select("recording_id").distinct().withColumn("participants", F.lit(12)))
    return s.select("recording_id", r6("normalized_entropy", places=4))


@query("select recording_id, row, col, n from cells")
def screen_histogram(spark, d):
    return diagnostics.screen_histogram(temporal.project(X.directions(spark, d)).filter("not off_screen"))


@query("select recording_id, round(sum(case when row between 5 and 9 and col between 5 and 9 then n else 0 end) / sum(n), 6) as centre_mass from cells group by recording_id")
def centre_mass(spark, d):
    return diagnostics.centre_mass(diagnostics.screen_histogram(temporal.project(X.directions(spark, d)).filter("not off_screen"))).select("recording_id", r6("centre_mass"))


@query("select recording_id, least(9, trunc(confidence * 10)::int) as bin, count(*) as n from directions group by all")
def confidence_histogram(spark, d):
    return diagnostics.confidence_histogram(X.directions(spark, d))


@query("""select recording_id, case when q_detection <= least(q_size, q_openness, q_head) then 'detection' when q_size <= least(q_openness, q_head) then 'size' when q_openness <= q_head then 'openness' else 'head' end as factor, count(*) as n from directions group by all""")
def limiting_factor(spark, d):
    return diagnostics.limiting_factors(X.directions(spark, d))


def _predictions(spark, d, step=None):
    return evaluation.predictions(X.truth(spark, d), _events(spark, d), step)


@query("""select count(*) as total, sum(hit::int)::bigint as hits, sum((predicted is null or predicted in ('unknown', 'low_confidence', 'not_visible'))::int)::bigint as unknown, sum((predicted is null)::int)::bigint as silent,
      coalesce(sum((predicted = 'low_confidence')::int), 0)::bigint as low_confidence, sum((answered and not hit)::int)::bigint as wrong, sum((target = 'off_screen')::int)::bigint as off_total, round(sum(hit::int) / count(*), 6) as hit_rate from p""")
def eval_scores(spark, d):
    return evaluation.scores(_predictions(spark, d)).select("total", "hits", "unknown", "silent", "low_confidence", "wrong", "off_total", r6("hit_rate"))


@query("select grid, sum(hit::int)::bigint as hits, count(*) as total from p where grid is not null group by grid")
def eval_per_grid(spark, d):
    return evaluation.per_grid(_predictions(spark, d))


@query("select target as truth, coalesce(predicted, 'silent') as predicted, count(*) as n from p group by all")
def eval_confusion(spark, d):
    return evaluation.confusion(_predictions(spark, d))


@query("""with m as (select predicted, count(*) as n, min({'r': recording_id, 't': truth_no}) as f from p where answered group by predicted),
    b as (select predicted from m order by n desc, f limit 1), t as (select count(*) as total, (select max(c) from (select count(*) as c from p group by target)) as most, (select count(distinct target) from p where target not in ('unknown', 'low_confidence', 'not_visible', 'off_screen')) as k, (select count(*) from p where target = (select predicted from b)) as modal from p)
    select unnest(['always_unknown', 'uniform_random', 'majority_truth', 'model_modal_target']) as strategy, round(unnest([0e0, 1e0 / k, most / total, modal / total]), 6) as score from t""".replace("with m as", "select * from (with m as") + ")")
def eval_baselines(spark, d):
    return evaluation.baselines(_predictions(spark, d)).select("strategy", r6("score"))


@query("""select case when confidence >= 4 * 0.2e0 then 4 when confidence >= 3 * 0.2e0 then 3 when confidence >= 2 * 0.2e0 then 2 when confidence >= 1 * 0.2e0 then 1 else 0 end as bin, count(*) as count, round(avg(confidence), 4) as mean_confidence, round(avg(hit::int), 4) as hit_rate from p where answered group by all""")
def eval_reliability(spark, d):
    r = evaluation.reliability(_predictions(spark, d))
    return r.select("bin", "count", r6("mean_confidence", places=4), r6("hit_rate", places=4))


@query("""select count(*) as total, sum(hit::int)::bigint as hits, sum((predicted is null or predicted in ('unknown', 'low_confidence', 'not_visible'))::int)::bigint as unknown, sum((predicted is null)::int)::bigint as silent,
      sum((answered and not hit)::int)::bigint as wrong, sum((target = 'off_screen')::int)::bigint as off_total, round(sum(hit::int) / count(*), 6) as hit_rate from dense_p""")
def eval_dense(spark, d):
    return evaluation.scores(_predictions(spark, d, 0.4)).select("total", "hits", "unknown", "silent", "wrong", "off_total", r6("hit_rate"))


@query()
def eval_bootstrap(spark, d):
    return evaluation.bootstrap_of(_predictions(spark, d))


@query("select recording_id, ts, bucket from (select recording_id, ts, floor((ts + 1e-9) / (1e0 / 2e0))::bigint as bucket, row_number() over (partition by recording_id, floor((ts + 1e-9) / (1e0 / 2e0)) order by ts) as n from frames) where n = 1")
def frame_sampling(spark, d):
    f = temporal.sample_frames(X.frame_tiles(spark, d), 2.0)
    return f.select("recording_id", "ts", F.floor((F.col("ts") + 1e-9) / F.lit(1.0 / 2.0)).cast("long").alias("bucket"))


#: A rotation for each direction: about the y axis by yaw, after one about the x axis by pitch.
@query("""select obs_no, round(atan2(sin(yaw) * cos(pitch), cos(yaw) * cos(pitch)), 6) as yaw, round(atan2(sin(pitch), sqrt(pow(sin(yaw) * cos(pitch), 2) + pow(cos(yaw) * cos(pitch), 2))), 6) as pitch, round(atan2(-(sin(yaw) * sin(pitch)), cos(pitch)), 6) as roll from directions""")
def head_pose(spark, d):
    y, p = F.col("yaw"), F.col("pitch")
    zero = F.lit(0.0)
    m = F.array(F.cos(y), F.sin(y) * F.sin(p), F.sin(y) * F.cos(p), zero, F.cos(p), -F.sin(p), -F.sin(y), F.cos(y) * F.sin(p), F.cos(y) * F.cos(p))
    h = X.directions(spark, d).select("obs_no", G.head_pose(m).alias("h"))
    return h.select("obs_no", *[r6(k, F.col(f"h.{k}")) for k in ("yaw", "pitch", "roll")])


@query("""select obs_no, round(least(1e0, greatest(-1e0, ((0.4e0 + q_size / 10e0) - 0.45e0) / 0.05e0)), 6) as h, round(least(1e0, greatest(-1e0, (0.31e0 - (0.3e0 + q_head / 50e0)) / 0.01e0)), 6) as v, round(0.02e0 / 0.1e0, 6) as openness from directions""")
def eye_offsets(spark, d):
    pt = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    iris = F.struct((0.4 + F.col("quality.size") / 10.0).alias("x"), (0.3 + F.col("quality.head") / 50.0).alias("y"))
    e = X.directions(spark, d).select("obs_no", G.eye(pt(0.4, 0.31), pt(0.5, 0.31), pt(0.45, 0.3), pt(0.45, 0.32), iris).alias("e"))
    return e.select("obs_no", *[r6(k, F.col(f"e.{k}")) for k in ("h", "v", "openness")])


@query("""select obs_no, round(least(1e0, q_size) * q_detection * least(1e0, greatest(0e0, (q_openness / 2 - 0.15e0) / (0.4e0 - 0.15e0))) * least(1e0, greatest(0e0, 1e0 - greatest(abs(yaw), abs(pitch)) / (pi() / 2e0))), 6) as confidence,
      round(yaw + 0.5e0 * radians(25e0), 6) as yaw, round(pitch - 0.25e0 * radians(20e0), 6) as pitch from directions""")
def geometric_gaze(spark, d):
    q = G.quality(F.col("quality.detection"), F.col("quality.size") * 0.25, F.col("quality.openness") / 2, F.col("yaw"), F.col("pitch"))
    yaw, pitch = G.gaze_angles(F.col("yaw"), F.col("pitch"), F.lit(0.5), F.lit(-0.25))
    return X.directions(spark, d).withColumn("q", q).select("obs_no", r6("confidence", G.combined(F.col("q"))), r6("yaw", yaw), r6("pitch", pitch))


@query("""select a.recording_id, a.region_no as a, b.region_no as b, round(case when w > 0 and h > 0 then w * h / (a.width * a.height + b.width * b.height - w * h) else 0e0 end, 6) as iou
    from (select r.recording_id, r.region_no, r.width, r.height, q.region_no as o, least(r.x + r.width, q.x + q.width) - greatest(r.x, q.x) as w, least(r.y + r.height, q.y + q.height) - greatest(r.y, q.y) as h from regions r join regions q on q.recording_id = r.recording_id and q.layout_no = 1 where r.layout_no = 0) a
    join regions b on b.recording_id = a.recording_id and b.layout_no = 1 and b.region_no = a.o""")
def region_overlap(spark, d):
    l = X.layouts(spark, d)
    side = lambda n, k: l.filter(F.col("layout_no") == n).select("recording_id", F.posexplode("regions").alias(k, f"r{k}"))
    return side(0, "a").join(side(1, "b"), "recording_id").select("recording_id", "a", "b", r6("iou", G.overlap(F.col("ra"), F.col("rb"))))


@query(f"""select t.recording_id, c.code from (select f.recording_id, f.off_rate, f.hit_rate, s.top, s.own, s.h from
      (select recording_id, sum(off_screen) / sum(directions) as off_rate, sum(face_hits) / sum(face_attempts) as hit_rate from ({_FUNNEL}) group by recording_id) f join
      (select recording_id, max(named) / sum(named) as top, sum(own) / sum(d) as own, -sum(case when named > 0 then named / t * ln(named / t) else 0e0 end) / ln(greatest(12, count(*) filter (named > 0))) as h from (select *, sum(named) over (partition by recording_id) as t from {_SHARES}) group by recording_id) s using (recording_id)) t
    join (select recording_id, sum(case when row between 5 and 9 and col between 5 and 9 then n else 0 end) / sum(n) as m from cells group by recording_id) k using (recording_id)
    join (values ('assumed_shared_layout'), ('low_face_hit_rate'), ('high_off_screen_rate'), ('concentrated_targets'), ('low_target_entropy'), ('centre_clustered_gaze'), ('high_self_view')) c(code)
    on c.code = 'assumed_shared_layout' or c.code = 'low_face_hit_rate' and hit_rate < 0.9 or c.code = 'high_off_screen_rate' and off_rate > 0.02 or c.code = 'concentrated_targets' and top > 0.15 or c.code = 'low_target_entropy' and h < 0.95 or c.code = 'centre_clustered_gaze' and m > 0.1 or c.code = 'high_self_view' and own > 0.1""")
def degradations(spark, d):
    """Rules with limits near this data's values, so that each one decides something."""
    limits = {"face_hit_rate": 0.9, "off_screen_rate": 0.02, "top_share": 0.15, "entropy": 0.95, "centre_mass": 0.1, "self_view": 0.1}
    return coverage.degradations(_outcome(spark, d).metrics(), limits).select("recording_id", "code")


_FIELDS = "select recording_id % 2 as side, 'recording_' || (recording_id // 2) as grp, 'directions.' || person_id as field, cast(count(*) as varchar) as value from directions group by all"


@query(f"select coalesce(l.grp, r.grp) as grp, coalesce(l.field, r.field) as field, l.value as left, r.value as right from (select * from ({_FIELDS}) where side = 0) l full join (select * from ({_FIELDS}) where side = 1) r on l.grp = r.grp and l.field = r.field where l.value is distinct from r.value")
def run_compare(spark, d):
    """Recordings of even and of odd number as two runs."""
    c = X.directions(spark, d).groupBy("recording_id", "person_id").agg(F.count("*").cast("string").alias("value"))
    f = c.select(
        (F.col("recording_id") % 2).alias("side"), F.concat(F.lit("recording_"), F.floor(F.col("recording_id") / 2).cast("string")).alias("grp"),
        F.concat(F.lit("directions."), "person_id").alias("field"), "value",
    )
    return comparison.run_diff(f.filter("side = 0"), f.filter("side = 1"), ("grp", "field"))


def _faces(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select(F.floor(F.col("vec_id") / 50).cast("long").alias("recording_id"), F.col("vec_id").cast("double").alias("ts"), F.col("embedding").alias("vec"))


@query("""select a.vec_id // 50 as recording_id, a.vec_id::double as a, b.vec_id::double as b, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as score
    from embeddings a join embeddings b on a.vec_id // 50 = b.vec_id // 50 and a.vec_id < b.vec_id where list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= 0.3""")
def reid_similarity(spark, d):
    return reid.similar_pairs(_faces(spark, d), 0.3).select("recording_id", "a", "b", r6("score"))


@query("""select recording_id, ts, person_id from (with recursive faces as (select vec_id // 50 as recording_id, vec_id::double as ts, embedding::double[] as v, row_number() over (partition by vec_id // 50 order by vec_id) as i from embeddings),
    walk as (select recording_id, ts, i, [v] as leaders, 0 as who from faces where i = 1
      union all select recording_id, ts, i, case when who < len(leaders) then leaders else list_append(leaders, v) end, who from (
        select *, case when list_max(sims) >= 0.3e0 then len(sims) - list_position(list_reverse(sims), list_max(sims)) else len(sims) end as who from (
          select f.recording_id, f.ts, f.i, f.v, w.leaders, list_transform(w.leaders, lambda l: list_cosine_similarity(l, f.v)) as sims from walk w join faces f on f.recording_id = w.recording_id and f.i = w.i + 1)))
    select recording_id, ts, concat('person_', cast(who as varchar)) as person_id from walk)""")
def reid_identify(spark, d):
    return reid.identify(_faces(spark, d), 0.3)


@query("select recording_id, viewer_id, count(*)::bigint as events, round(sum(end_time - start_time), 3) as seconds from events_ group by recording_id, viewer_id")
def viewer_summary(spark, d):
    s = diagnostics.summary(_events(spark, d))
    total = F.aggregate(F.map_values("duration_by_target"), F.lit(0.0), lambda a, x: a + x)
    m = diagnostics.matrix(_events(spark, d)).groupBy("recording_id", "viewer_id").agg(F.sum("seconds").alias("seconds"))
    return s.withColumn("t", total).join(m, ["recording_id", "viewer_id"]).select("recording_id", "viewer_id", "events", r6("seconds", places=3))


@query("select recording_id, viewer_id as viewer, target, printf('%.3f', start_time) as start, printf('%.3f', end_time) as \"end\", reason from events_")
def event_csv(spark, d):
    """The CSV sink's rows, of all recordings."""
    from ..sources.sinks import event_rows

    return event_rows(_events(spark, d), ["recording_id"]).select("recording_id", "viewer", "target", "start", "end", "reason")


@query("select recording_id, 'assumed_shared' as layout_sources, 2::bigint as layouts, 12::bigint as participants_detected from directions group by recording_id")
def layout_sources(spark, d):
    o = _outcome(spark, d)
    t = coverage.totals(o.per_participant(), o.layouts)
    return t.select("recording_id", F.array_join("layout_sources", ",").alias("layout_sources"), "layouts", "participants_detected")


@query("""select m.recording_id, c.code from (select recording_id, count(*) as n, sum(case when abs(yaw) > 0.3e0 then 1 else 0 end) as far from directions group by recording_id) m
    join (values ('no_layout', 0), ('no_participant_regions', 1), ('no_events', 2), ('uncalibrated_viewers', 3), ('no_iris_signal', 4)) c(code, k) on m.recording_id % 5 = c.k
    union all select recording_id, 'high_off_screen_rate' from (select recording_id, count(*) as n, sum(case when abs(yaw) > 0.2e0 then 1 else 0 end) as far from directions group by recording_id) where far > 0.5e0 * n""")
def degradations_rare(spark, d):
    """The rules that a sound run never meets: each recording lacks something else."""
    k = F.col("recording_id") % 5
    far = F.sum((F.abs("yaw") > 0.2).cast("long"))
    m = X.directions(spark, d).groupBy("recording_id").agg(F.count("*").alias("directions"), far.alias("off_screen")).withColumns({
        "off_screen_rate": F.col("off_screen") / F.col("directions"), "layouts": F.when(k == 0, 0).otherwise(2), "participants_detected": F.when(k == 1, 0).otherwise(12), "events": F.when(k == 2, 0).otherwise(7),
        "uncalibrated": F.when(k == 3, 4).otherwise(0), "no_iris": k == 4, "layout_sources": F.array(F.lit("manifest")), "face_attempts": F.lit(0), "face_hits": F.lit(0), "face_hit_rate": F.lit(0.0),
    })
    return coverage.degradations(m).select("recording_id", "code")


@query("""select v.recording_id, v.viewer_id, l.layout_no, 'manifest' as source, l.n as n_regions from (select distinct recording_id, person_id as viewer_id from directions) v
    join (select recording_id, layout_no, count(*) as n from regions group by all) l on l.recording_id = v.recording_id where cast(right(v.viewer_id, 1) as int) % 2 = l.layout_no""")
def manifest_layouts(spark, d):
    """Viewers of even number had the first layout, the others the second one; nobody else's counts for them."""
    viewers = X.directions(spark, d).select("recording_id", F.col("person_id").alias("viewer_id")).distinct()
    own = X.layouts(spark, d).drop("viewer_id").join(viewers, "recording_id").filter(F.substring("viewer_id", -1, 1).cast("int") % 2 == F.col("layout_no")).withColumn("source", F.lit("manifest"))
    made = layouts.viewer_layouts(viewers, X.layouts(spark, d), own)
    return made.select("recording_id", "viewer_id", F.col("layout_no").cast("int").alias("layout_no"), "source", F.size("regions").cast("long").alias("n_regions"))


@query("""select obs_no, round(case when obs_no % 3 = 0 then q_detection when q_size <= 0.5e0 then null when obs_no % 3 = 1 then abs(0.7e0 + q_head / 10e0 - 0.7e0) / q_size else sqrt(0.3e0 * 0.3e0 + (q_openness / 10e0) * (q_openness / 10e0)) / q_size end, 6) as mouth_open from directions""")
def mouth_cue(spark, d):
    """The jaw's coefficient, else the gap of the lips, else the width of the mouth, by eye distances; null where none can be told."""
    k, q = F.col("obs_no") % 3, F.col("quality")
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    lip = lambda y: pt(F.when(k == 1, 0.5).otherwise(0.0), F.when(k == 1, y).otherwise(0.0))
    iod = F.when(q["size"] <= 0.5, 0.0).otherwise(q["size"])
    corner = pt(F.lit(0.35), F.lit(0.7)), pt(F.lit(0.65), 0.7 + q["openness"] / 10.0)
    m = G.mouth_open(F.when(k == 0, q["detection"]), lip(F.lit(0.7)), lip(0.7 + q["head"] / 10.0), *corner, iod)
    return X.directions(spark, d).select("obs_no", r6("mouth_open", m))


@query("""select f.recording_id, round(f.ts, 6) as start_time, round(f.ts + 0.2e0, 6) as end_time, r.participant_id, 1e0 as confidence from frames f
    join regions r on r.recording_id = f.recording_id and r.layout_no = case when f.ts < 12e0 then 0 else 1 end and r.region_no = f.k % 3 + case when f.ts < 12e0 then 0 else 1 end where f.k % 4 <> 3""")
def highlight_flags(spark, d):
    """A highlighted tile's place among the frame's participants names who speaks in the active layout."""
    k = F.round(F.col("ts") * 5).cast("int")
    tiles = X.frame_tiles(spark, d).withColumn("highlight", F.when(k % 4 != 3, k % 3))
    return speaker_flags(tiles, X.layouts(spark, d)).select("recording_id", r6("start_time"), r6("end_time"), "participant_id", "confidence")


@query("""select recording_id, person_id, obs_no, round(x, 6) as x, round(y, 6) as y from (select *, (yaw - radians(-20e0)) / (radians(20e0) - radians(-20e0)) as x, (radians(2e0) - pitch) / (radians(2e0) - radians(-22e0)) as y from directions) where x between 0 and 1 and y between 0 and 1""")
def project_other_screen(spark, d):
    import math

    s = Screen(math.radians(-20.0), math.radians(20.0), math.radians(2.0), math.radians(-22.0), 0.0)
    p = temporal.project(X.directions(spark, d), s).filter("not off_screen")
    return p.select("recording_id", "person_id", "obs_no", r6("x"), r6("y"))


# What is written is read back, by the sinks and readers themselves.


def _written(spark, df, name: str) -> str:
    """A table as JSON lines, with the columns of its entity."""
    path = sinks.scratch(spark)
    have = set(df.columns)
    sinks.write_jsonl(df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(name)]), path)
    return path


@query("""select recording_id, event_no, viewer_id, target, reason, 'assumed_shared' as layout_source, round(start_time, 6) as start_time, round(end_time, 6) as end_time, round(confidence, 6) as confidence from events_""")
def stored_events(spark, d):
    got = readers.read_events(spark, _written(spark, _events(spark, d), "gaze_events"), None)
    return got.select("recording_id", "event_no", "viewer_id", "target", "reason", "layout_source", *[r6(c) for c in ("start_time", "end_time", "confidence")])


@query("""select recording_id, viewer_id, target, reason, round(start_time, 6) as start_time, round(confidence, 6) as confidence, round(margin_ratio, 6) as margin_ratio from attributions""")
def stored_attributions(spark, d):
    got = readers.read_attributions(spark, _written(spark, _outcome(spark, d).attributions, "attributions"), None)
    return got.select("recording_id", "viewer_id", "target", "reason", *[r6(c) for c in ("start_time", "confidence", "margin_ratio")])


@query("""select recording_id, layout_no, region_no, kind, participant_id, round(start_time, 6) as start_time, round(end_time, 6) as end_time, round(x, 6) as x, round(y, 6) as y, round(width, 6) as width, round(height, 6) as height from regions""")
def stored_layouts(spark, d):
    got = readers.read_layouts(spark, _written(spark, X.layouts(spark, d), "layouts"), None)
    rows = got.select("recording_id", "layout_no", "start_time", "end_time", F.posexplode("regions").alias("region_no", "r"))
    return rows.select("recording_id", "layout_no", "region_no", "r.kind", "r.participant_id", r6("start_time"), r6("end_time"), *[r6(c, F.col(f"r.{c}")) for c in ("x", "y", "width", "height")])


@query("""select recording_id, obs_no, person_id, round(ts, 6) as ts, round(x, 6) as x, round(y, 6) as y, round(confidence, 6) as confidence from projected where not off_screen""")
def stored_points(spark, d):
    p = temporal.project(X.directions(spark, d)).filter("not off_screen")
    got = readers.read_points(spark, _written(spark, p, "gaze_points"), None)
    return got.select("recording_id", "obs_no", "person_id", *[r6(c) for c in ("ts", "x", "y", "confidence")])


@query("""select recording_id, segment_no, participant_id, 'highlight' as cue, round(start_time, 6) as start_time, round(end_time, 6) as end_time, round(confidence, 6) as confidence from speech""")
def stored_segments(spark, d):
    got = readers.read_speaker_segments(spark, _written(spark, events.speaker_segments(X.speaker_flags(spark, d)), "speaker_segments"), None)
    return got.select("recording_id", "segment_no", "participant_id", "cue", *[r6(c) for c in ("start_time", "end_time", "confidence")])


@query("""select recording_id, truth_no, viewer_id, target, grid, round(start_time, 6) as start_time, round(end_time, 6) as end_time from truth""")
def stored_truth(spark, d):
    got = readers.read_truth(spark, _written(spark, X.truth(spark, d), "truth"), None)
    return got.select("recording_id", "truth_no", "viewer_id", "target", "grid", *[r6(c) for c in ("start_time", "end_time")])


@query("""select concat(cast(recording_id as varchar), '/all') as viewer_id, layout_no, 'manifest' as source, round(start_time, 6) as start_time, round(min(end_time), 6) as end_time, count(*)::int as n_regions from regions group by recording_id, layout_no, start_time""")
def stored_manifest(spark, d):
    """A viewer for each recording, in one manifest."""
    path = sinks.scratch(spark)
    sinks.save_manifest(X.layouts(spark, d).withColumn("viewer_id", F.concat(F.col("recording_id").cast("string"), F.lit("/all"))), path)
    got = readers.read_manifest(spark, path)
    return got.select("viewer_id", "layout_no", "source", r6("start_time"), r6("end_time"), F.size("regions").alias("n_regions"))


@query("""select recording_id, person_id, obs_no, round(yaw, 6) as yaw, round(pitch, 6) as pitch, round(confidence, 6) as confidence, round(q_size, 6) as q_size from directions""")
def stored_directions(spark, d):
    """The native form: Parquet by recording, in two appends."""
    path, rows = sinks.scratch(spark), X.directions(spark, d)
    sinks.write_table(rows.filter("obs_no % 2 = 0"), path)
    sinks.write_table(rows.filter("obs_no % 2 = 1"), path, append=True)
    got = spark.read.schema(rows.schema).parquet(path)
    return got.select("recording_id", "person_id", "obs_no", r6("yaw"), r6("pitch"), r6("confidence"), r6("q_size", F.col("quality.size")))


@query("""select recording_id, obs_no, array_to_string(list_filter([case when obs_no % 23 = 0 then 'ts' end, case when obs_no % 17 = 0 then 'yaw' end, case when obs_no % 19 = 0 then 'confidence' end, case when obs_no % 29 = 0 then 'quality' end], lambda x: x is not null), ',') as broken
    from directions where obs_no % 23 = 0 or obs_no % 17 = 0 or obs_no % 19 = 0 or obs_no % 29 = 0""")
def broken_directions(spark, d):
    """Directions of which some break a rule, or several, by construction."""
    n, c = F.col("obs_no"), F.col
    bad = X.directions(spark, d).withColumns({
        "ts": F.when(n % 23 == 0, -1.0 - c("ts")).otherwise(c("ts")), "yaw": F.when(n % 17 == 0, F.lit(float("nan"))).otherwise(c("yaw")), "confidence": F.when(n % 19 == 0, c("confidence") + 1).otherwise(c("confidence")),
        "quality": F.when(n % 29 == 0, c("quality").withField("size", F.lit(-0.5))).otherwise(c("quality")),
    })
    return checks.broken(bad, "gaze_directions").select("recording_id", "obs_no", F.array_join("broken", ",").alias("broken"))


@query("""select recording_id, person_id as viewer_id, obs_no, 'off_screen' as target, round(confidence, 6) as confidence, 'off_screen' as reason, cast(null as double) as margin_ratio from projected where off_screen""")
def sentinel_verdicts(spark, d):
    """Off-screen directions as verdicts that need no layout."""
    p = temporal.project(X.directions(spark, d)).filter("off_screen").withColumn("v", attribution.sentinel("off_screen", F.col("confidence")))
    return p.select("recording_id", F.col("person_id").alias("viewer_id"), "obs_no", "v.target", r6("confidence", F.col("v.confidence")), "v.reason", "v.margin_ratio")


@query("""select v.recording_id, v.viewer_id, case when s.recording_id is null then 0 else count(l.obs_no) end as labels, case when s.recording_id is null then 'no speaker segments' when count(l.obs_no) < 5 then 'too few weak labels' else 'tried' end as reason
    from (select distinct recording_id, person_id as viewer_id from directions) v left join (select distinct recording_id from speech) s on s.recording_id = v.recording_id
    left join labels_ l on l.recording_id = v.recording_id and l.viewer_id = v.viewer_id group by v.recording_id, v.viewer_id, s.recording_id""")
def calibration_reasons(spark, d):
    """Why a viewer's prior stays; whether a fit that is tried succeeds depends on a random stream."""
    few = F.col("reason").isin("no layout", "no speaker segments", "too few weak labels")
    return calibration_ransac(spark, d).select("recording_id", "viewer_id", "labels", F.when(few, F.col("reason")).otherwise("tried").alias("reason"))


@query("""select recording_id, round(start_time, 6) as ts, region_no as tile_no, kind, round(x + 0.01e0, 4) as x, round(y + 0.01e0, 4) as y, round(width - 0.02e0, 4) as width, round(height - 0.02e0, 4) as height, case when recording_id % 4 < 3 then (recording_id % 4)::int end as highlight from regions""")
def rendered_tiles(spark, d):
    """Tiles and highlights that detection finds in frames drawn from known layouts."""
    found = vision.frame_tiles(X.undrawn_frames(X.layouts(spark, d)), draw=X.draw_frame)
    rows = found.select("recording_id", "ts", "highlight", F.posexplode("tiles").alias("tile_no", "t"))
    return rows.select("recording_id", r6("ts"), "tile_no", "t.kind", *[r6(c, F.col(f"t.{c}"), 4) for c in ("x", "y", "width", "height")], "highlight")


@query("""select recording_id, round(start_time, 6) as ts, participant_id as person_id, region_no % 5 <> 4 as hit, case when region_no % 5 <> 4 then (60 + 10 * region_no) / 100e0 end as yaw from regions where kind = 'participant'""")
def observed_crops(spark, d):
    """Every participant's crop of the active layout, by a stage that reads the level at its middle and declines two levels."""

    def look(crop, person, ts):
        level = int(crop[crop.shape[0] // 2, crop.shape[1] // 2, 0])
        return None if level in (100, 150) else {"yaw": level / 100, "pitch": 0.0, "confidence": 1.0}

    lays = X.layouts(spark, d)
    seen = layouts.observe(X.rendered_frames(lays), lays, vision.gaze_stage(look), vision.STAGE)
    return seen.select("recording_id", r6("ts"), "person_id", "hit", "yaw")


# Streams over a stored table give what the table gives. The state of what is still open is given out by a last row, of a recording of its own, that moves the watermark.


def _streamed(spark, df, time: str, op):
    """op over df as a stream; its result, as a table."""
    path = sinks.scratch(spark)
    last = df.limit(1).withColumns({"recording_id": F.lit(-1).cast("long"), time: F.lit(1e7)})
    df.unionByName(last).write.parquet(f"{path}/in")
    made = op(stateful.with_event_time(spark.readStream.schema(df.schema).parquet(f"{path}/in"), time, "1 second"))
    to = made.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append")
    to.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{path}/out").filter("recording_id >= 0")


@query("select recording_id, person_id, round(start_time, 6) as start_time, round(end_time, 6) as end_time, round(x, 6) as x, round(y, 6) as y, round(confidence, 6) as confidence from fixations")
def stream_fixations(spark, d):
    p = temporal.project(X.directions(spark, d)).filter("not off_screen").select("recording_id", "person_id", "ts", "x", "y", "confidence")
    return _streamed(spark, p, "ts", stateful.fixations).select("recording_id", "person_id", *[r6(c) for c in ("start_time", "end_time", "x", "y", "confidence")])


@query("select recording_id, viewer_id, target, reason, round(start_time, 6) as start_time, round(end_time, 6) as end_time, round(confidence, 6) as confidence from gaze")
def stream_events(spark, d):
    a = _outcome(spark, d).attributions.select("recording_id", "viewer_id", "start_time", "end_time", "target", "confidence", "reason", "layout_source")
    return _streamed(spark, a, "start_time", stateful.gaze_events).select("recording_id", "viewer_id", "target", "reason", *[r6(c) for c in ("start_time", "end_time", "confidence")])


@query("select i.recording_id, i.interval_no::int as interval_no, round(i.start_time, 6) as start_time, round(i.end_time, 6) as end_time, (select count(*) from tiles t where t.recording_id = i.recording_id and t.k = i.k)::int as n_tiles from intervals i")
def stream_layouts(spark, d):
    got = _streamed(spark, X.frame_tiles(spark, d), "ts", lambda s: stateful.layouts(s, C.layout_debounce))
    return got.select("recording_id", "interval_no", r6("start_time"), r6("end_time"), F.size("tiles").alias("n_tiles"))


@query("select recording_id, participant_id, round(start_time, 6) as start_time, round(end_time, 6) as end_time, round(confidence, 6) as confidence from speech")
def stream_speakers(spark, d):
    return _streamed(spark, X.speaker_flags(spark, d), "start_time", stateful.speaker_segments).select("recording_id", "participant_id", *[r6(c) for c in ("start_time", "end_time", "confidence")])


@query("select distinct recording_id, floor((ts + 1e-9) / (1e0 / 2e0))::bigint as bucket from frames")
def stream_first_frames(spark, d):
    """Steps of which a first frame came; which one it is depends on the order of arrival."""
    got = _streamed(spark, X.frame_tiles(spark, d).select("recording_id", "ts"), "ts", lambda s: stateful.first_frames(s, 2.0))
    return got.select("recording_id", "bucket")
