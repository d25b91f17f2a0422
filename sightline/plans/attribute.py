"""From stored directions to events: the part of a run that can be repeated."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import attribution, calibration, coverage, diagnostics, events, layouts, temporal
from ..schemas import Config


@dataclass
class Outcome:
    """Tables of one run; all are lazy."""

    projected: DataFrame
    fixations: DataFrame
    attributions: DataFrame
    events: DataFrame
    not_visible: DataFrame
    layouts: DataFrame
    calibrations: DataFrame | None = None
    faces: DataFrame | None = None
    segments: DataFrame | None = None
    directions: DataFrame | None = None
    iris: bool = True

    @property
    def points(self) -> DataFrame:
        """What is on the screen, before smoothing."""
        return self.projected.filter("not off_screen").select("recording_id", "obs_no", "ts", "person_id", "x", "y", "confidence")

    def per_participant(self) -> DataFrame:
        return coverage.funnel(self.projected, self.fixations, self.attributions, self.events.filter("target <> 'not_visible'"), self.not_visible, self.faces)

    def metrics(self) -> DataFrame:
        """One row for each recording: coverage, shape, and what the rules look at."""
        t = coverage.totals(self.per_participant(), self.layouts)
        t = t.join(diagnostics.shares(self.events, t.select("recording_id", F.col("participants_detected").alias("participants"))), "recording_id", "left")
        t = t.join(diagnostics.centre_mass(diagnostics.screen_histogram(self.points)), "recording_id", "left")
        if self.calibrations is not None:
            t = t.join(self.calibrations.groupBy("recording_id").agg(F.sum((~F.col("calibrated")).cast("int")).alias("uncalibrated")), "recording_id", "left")
        return t.withColumn("no_iris", F.lit(not self.iris))

    def of(self, recording_id: int) -> Outcome:
        """The run's rows of one recording, kept once they are computed: a record asks for them many times. What is lost is computed again."""
        mine = lambda df: None if df is None else df.filter(F.col("recording_id") == recording_id).persist()
        return replace(self, **{f.name: mine(getattr(self, f.name)) for f in fields(self) if f.name != "iris"})

    def forget(self) -> None:
        """Frees what of() kept."""
        for f in fields(self):
            if isinstance(df := getattr(self, f.name), DataFrame):
                df.unpersist()


def attribute(
    directions: DataFrame, recorded: DataFrame, config: Config = Config(), manifest: DataFrame | None = None, segments: DataFrame | None = None,
    calibrate: bool = False, faces: DataFrame | None = None,
) -> Outcome:
    """Directions and layouts to events.

    manifest: viewers' own layouts; without it the recorded ones are assumed to be shared by all. calibrate: fit each viewer's mapping
    from speaker segments first. A person's samples move once, fixations once more.
    """
    fits = None
    if calibrate:
        viewers = directions.select("recording_id", F.col("person_id").alias("viewer_id"))
        labels = calibration.weak_labels(directions, segments, recorded)
        fits = calibration.calibrations(labels, viewers, config.min_calibration_labels, segments, recorded)
        projected = calibration.project_calibrated(directions, fits, config.screen)
    else:
        projected = temporal.project(directions, config.screen)
    smooth = temporal.median_smooth(projected.filter("not off_screen"), config.smoothing_window)
    fixed = temporal.detect_fixations(smooth, config.dispersion, config.min_fixation, config.max_gap, arranged=config.smoothing_window > 1)
    used = recorded if manifest is None else manifest
    judged = attribution.attribute_fixations(fixed, used, per_viewer=manifest is not None, floor=config.confidence_floor)
    merged = events.gaze_events(judged, config.event_min_duration, config.max_gap)
    unseen = attribution.not_visible(used, merged, directions, own_source=manifest is not None)
    both = events.numbered(merged.unionByName(unseen))
    shown = layouts.viewer_layouts(directions.select("recording_id", F.col("person_id").alias("viewer_id")), recorded, manifest)
    return Outcome(projected, fixed, judged, both, unseen, shown, fits, faces, segments, directions)


def analyze(frames: DataFrame, stage, config: Config = Config(), manifest: DataFrame | None = None, calibrate: bool = False) -> Outcome:
    """Frames (recording_id, ts, height, width, pixels) and a stage to events. Pixels are read twice and never shuffled with results.

    stage: a vision.Stage, or only its function. What the models find is kept, as they are the costly part; what is lost is found again.
    Highlighted tiles become speaker segments, which calibrate uses.
    """
    from ..operators import vision

    stage = stage if isinstance(stage, vision.Stage) else vision.Stage(stage)
    sampled = temporal.sample_frames(frames, config.target_fps)
    tiles = vision.frame_tiles(sampled, config.detection).persist()
    recorded = layouts.build_layouts(layouts.segment_layouts(tiles, config.layout_debounce), continuity=config.continuity)
    seen = layouts.observe(sampled, recorded, stage.run, stage.schema).persist()
    faces = seen.select("recording_id", F.col("person_id").alias("participant_id"), "hit")
    hits = seen.filter("hit").withColumn("obs_no", F.row_number().over(Window.partitionBy("recording_id", "person_id").orderBy("ts")).cast("long"))
    found = stage.directions(hits) if stage.directions else hits
    found = found.select("recording_id", "obs_no", "ts", "person_id", "yaw", "pitch", "head_pose", "confidence", "quality")
    segments = events.speaker_segments(speaker_flags(tiles, recorded, config.target_fps))
    return replace(attribute(found, recorded, config, manifest, segments, calibrate, faces), iris=stage.iris)


def speaker_flags(tiles: DataFrame, recorded: DataFrame, fps: float = 5.0) -> DataFrame:
    """Highlighted tiles as moments of speech: the place among the frame's participants is looked up in the active layout's."""
    rows = tiles.filter("highlight is not null").join(layouts.in_order(recorded, ["recording_id"]), "recording_id")
    people = layouts.participants(layouts.active(F.col("layouts"), F.col("ts")).regions)
    who = F.get(people, F.col("highlight"))["participant_id"]
    return rows.select(
        "recording_id", F.col("ts").alias("start_time"), (F.col("ts") + 1.0 / fps).alias("end_time"), who.alias("participant_id"),
        F.lit(1.0).alias("confidence"),
    ).filter("participant_id is not null")
