"""Optional models behind the protocols of vision.py. Nothing is imported, or downloaded, before one is made; none is installed here."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd

from ..schemas import Gaze
from . import faces, vision


class MeshFaces:
    """478 landmarks, head pose and jaw coefficient from a face-landmarker model file."""

    def __init__(self, model_path: str):
        from mediapipe.tasks.python import BaseOptions, vision as mp

        options = mp.FaceLandmarkerOptions(base_options=BaseOptions(model_asset_path=model_path), output_face_blendshapes=True, output_facial_transformation_matrixes=True, num_faces=1)
        self.model = mp.FaceLandmarker.create_from_options(options)

    def observe(self, crop: np.ndarray) -> dict | None:
        import mediapipe

        got = self.model.detect(mediapipe.Image(image_format=mediapipe.ImageFormat.SRGB, data=np.ascontiguousarray(crop[..., ::-1])))
        if not got.face_landmarks:
            return None
        pose = (0.0, 0.0, 0.0)
        if got.facial_transformation_matrixes:
            m = np.asarray(got.facial_transformation_matrixes[0])
            f, u = m[:3, 2], m[:3, 1]
            pose = (np.arctan2(f[0], f[2]), np.arctan2(-f[1], np.hypot(f[0], f[2])), np.arctan2(-u[0], u[1]))
        shapes = {c.category_name: float(c.score) for c in (got.face_blendshapes[0] if got.face_blendshapes else [])}
        known = [d.score for d in getattr(got, "face_detections", None) or [] if getattr(d, "score", None) is not None]
        return {
            "lm": [float(v) for q in got.face_landmarks[0] for v in (q.x, q.y, q.z)],
            "head_pose": dict(zip(("yaw", "pitch", "roll"), map(float, pose))), "jaw": shapes.get("jawOpen"),
            "detection": float(max(known, default=1.0)),
        }


class FivePointFaces:
    """The largest face of an ONNX five-point detector, as its row of 15 numbers."""

    def __init__(self, model_path: str, score: float = 0.55):
        import cv2

        self.model = cv2.FaceDetectorYN.create(model_path, "", (320, 320), score, 0.3, 5000)

    def observe(self, crop: np.ndarray) -> dict | None:
        height, width = crop.shape[:2]
        if min(height, width) < 2:
            return None
        self.model.setInputSize((width, height))
        found = self.model.detect(crop)[1]
        if found is None or not len(found):
            return None
        best = found[np.argmax(found[:, 2] * found[:, 3])]
        return {"det": [float(x) for x in best], "width": width, "height": height}


class GazeNet:
    """Yaw and pitch from trained appearance weights."""

    def __init__(self, weights: str, arch: str = "ResNet50", device: str = "cpu"):
        from pathlib import Path

        import torch
        from l2cs import Pipeline

        self.model = Pipeline(weights=Path(weights), arch=arch, device=torch.device(device))

    def estimate(self, crop: np.ndarray) -> tuple[float, float]:
        got = self.model.step(crop)
        return float(got.yaw[0]), float(got.pitch[0])


class LineReader:
    """Text of one line by a local OCR engine."""

    def __init__(self, lang: str = "eng"):
        self.lang = lang

    def read(self, strip: np.ndarray) -> str:
        import pytesseract

        return pytesseract.image_to_string(strip, lang=self.lang, config="--psm 7").strip()


def landmark_stage(make: Callable[[], vision.FaceObserver], gaze: Gaze = Gaze()) -> vision.Stage:
    """Directions from landmarks of an observer that is made once in each task."""
    return vision.Stage(face_stage(make), faces.LANDMARKS, lambda hits: faces.geometric(hits, gaze))


def five_point_stage(make: Callable[[], vision.FaceObserver], gaze: Gaze = Gaze()) -> vision.Stage:
    """Directions from five points; such an observer sees no iris."""
    return vision.Stage(face_stage(make, ("det", "width", "height")), faces.FIVE_POINTS, lambda hits: faces.five_point(hits, gaze), iris=False)


def stage_of(gaze: str, observer: str, model: str | None, weights: str | None, settings: Gaze = Gaze()) -> vision.Stage:
    """The stage that a name for the gaze (geometric, appearance) and one for the observer (mesh, five-point) stand for."""
    if gaze not in ("geometric", "appearance") or observer not in ("mesh", "five-point"):
        raise ValueError("gaze is geometric or appearance, and an observer is mesh or five-point")
    if not model or (gaze == "appearance" and not weights):
        raise ValueError("an observer needs a model file, and an appearance model its weights")
    make = (lambda: MeshFaces(model)) if observer == "mesh" else (lambda: FivePointFaces(model))
    if gaze == "geometric":
        return (landmark_stage if observer == "mesh" else five_point_stage)(make, settings)

    def run(batches):  # models are made where they run
        return vision.appearance(GazeNet(weights), observer=make())(batches)

    return vision.Stage(run, iris=observer == "mesh")


def face_stage(make: Callable[[], vision.FaceObserver], fields: tuple[str, ...] = ("lm", "head_pose", "jaw", "detection")) -> Callable:
    """A function for mapInPandas over observed crops; the model is made once in each task. See faces.LANDMARKS for its schema."""

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in batches:
            rows = []
            for rec, ts, h, w, px, region in zip(*(pdf[k] for k in ("recording_id", "ts", "height", "width", "pixels", "region"))):
                got = model.observe(vision.crop(vision.image_of(px, h, w), region))
                rows.append([rec, ts, region["participant_id"], got is not None, *((got or {}).get(f) for f in fields)])
            yield pd.DataFrame(rows, columns=["recording_id", "ts", "person_id", "hit", *fields])

    return work
