"""Tables, fixed vocabularies and settings."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import types as T

# Names that are part of the data's contract.
SENTINELS = ("unknown", "off_screen", "not_visible", "low_confidence")
DECLINING = ("unknown", "low_confidence", "not_visible")
REGION_KINDS = ("participant", "shared_content", "ui", "unknown")
LAYOUT_SOURCES = ("recording", "assumed_shared", "manifest", "inferred")
STORE_KIND, STORE_VERSION, STORE_READABLE = ".gaze", 2, (1, 2)
RECORD_KIND, RECORD_VERSION = ".report", 1
FACTORS = ("detection", "size", "openness", "head")

#: What this engine writes; stores and records of any producer are read if the name ends with the kind.
STORE_SCHEMA, RECORD_SCHEMA = "sightline" + STORE_KIND, "sightline" + RECORD_KIND

HEAD_POSE = "struct<yaw:double,pitch:double,roll:double>"
QUALITY = "struct<detection:double,size:double,openness:double,head:double>"
TILE = "struct<kind:string,x:double,y:double,width:double,height:double>"
REGION = "struct<kind:string,x:double,y:double,width:double,height:double,participant_id:string>"

#: DDL of each entity. recording_id leads all of them.
TABLES = {
    "gaze_directions": f"recording_id bigint, obs_no bigint, ts double, person_id string, yaw double, pitch double, head_pose {HEAD_POSE}, confidence double, quality {QUALITY}",
    "gaze_points": "recording_id bigint, obs_no bigint, ts double, person_id string, x double, y double, confidence double",
    "layouts": f"recording_id bigint, viewer_id string, layout_no int, start_time double, end_time double, source string, regions array<{REGION}>",
    "frame_tiles": f"recording_id bigint, ts double, tiles array<{TILE}>",
    "fixations": "recording_id bigint, person_id string, x double, y double, start_time double, end_time double, confidence double, dispersion double",
    "attributions": "recording_id bigint, viewer_id string, start_time double, end_time double, target string, confidence double, reason string, margin_ratio double, layout_source string",
    "gaze_events": "recording_id bigint, event_no bigint, viewer_id string, target string, start_time double, end_time double, confidence double, layout_source string, reason string",
    "speaker_segments": "recording_id bigint, segment_no bigint, participant_id string, start_time double, end_time double, confidence double, cue string",
    "truth": "recording_id bigint, truth_no bigint, viewer_id string, start_time double, end_time double, target string, grid string",
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])


@dataclass(frozen=True)
class Screen:
    """Angles of the screen's edges, in radians, and how far outside still counts as on it."""

    left: float = math.radians(-16.0)
    right: float = math.radians(16.0)
    top: float = 0.0
    bottom: float = math.radians(-19.0)
    margin: float = 0.05

    def __post_init__(self):
        if not (self.right > self.left and self.top > self.bottom):
            raise ValueError("the screen's right must exceed its left, and its top its bottom")


@dataclass(frozen=True)
class Detection:
    """Thresholds of tile detection."""

    background_diff: int = 18
    min_area: float = 0.01
    fill: float = 0.6
    aspects: tuple[float, ...] = (16 / 9, 4 / 3, 1.0)
    aspect_tolerance: float = 0.25
    shared_area: float = 0.45
    consistency: float = 0.5
    prominence: float = 6.0
    min_cell: float = 0.12
    uniformity: float = 0.15
    flat: float = 6.0
    strip_most: float = 0.3
    strip_least: float = 0.05


@dataclass(frozen=True)
class Gaze:
    """Eye-to-angle settings: gain at full deflection, in radians, and scales of the quality factors."""

    yaw_gain: float = math.radians(25.0)
    pitch_gain: float = math.radians(20.0)
    yaw_sign: float = 1.0
    pitch_sign: float = 1.0
    reference_iod: float = 0.25
    min_openness: float = 0.15
    full_openness: float = 0.40


@dataclass(frozen=True)
class Config:
    """Settings of a run; the defaults are part of the contract."""

    target_fps: float = 5.0
    smoothing_window: int = 3
    dispersion: float = 0.12
    min_fixation: float = 0.15
    max_gap: float = 0.3
    event_min_duration: float = 0.2
    min_layout_seconds: float = 2.0
    min_calibration_labels: int = 20
    confidence_floor: float = 0.15
    continuity: float = 0.5
    screen: Screen = field(default_factory=Screen)
    detection: Detection = field(default_factory=Detection)
    gaze: Gaze = field(default_factory=Gaze)

    @property
    def layout_debounce(self) -> float:
        return max(self.min_layout_seconds, 2.0 / self.target_fps)
