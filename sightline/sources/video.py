"""Frames of a video as a Spark data source. Decoding needs OpenCV, which is imported when a frame is read."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Video(InputPartition):
    def __init__(self, path: str, recording_id: int):
        super().__init__(path)
        self.path, self.recording_id = path, recording_id


class VideoReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("path", "").split(",") if p]

    def partitions(self) -> list[Video]:
        return [Video(p, i) for i, p in enumerate(self.paths)]

    def read(self, part: Video) -> Iterator[tuple]:
        import cv2

        video = cv2.VideoCapture(part.path)
        if not video.isOpened():
            raise FileNotFoundError(part.path)
        fps, n = video.get(cv2.CAP_PROP_FPS), 0
        while True:
            ms = video.get(cv2.CAP_PROP_POS_MSEC)
            ok, image = video.read()
            if not ok:
                return
            yield part.recording_id, n / fps if fps > 0 else ms / 1000.0, image.shape[0], image.shape[1], image.tobytes()
            n += 1


class VideoSource(DataSource):
    """spark.read.format("frames").load("a.mp4,b.mp4"): one partition for each video."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return "recording_id bigint, ts double, height int, width int, pixels binary"

    def reader(self, schema) -> VideoReader:
        return VideoReader(self.options)


def decode_video(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(VideoSource)
    return spark.read.format("frames").load(path)


def read_video(spark: SparkSession, path: str, fps: float = 5.0) -> DataFrame:
    from ..operators.temporal import sample_frames

    return sample_frames(decode_video(spark, path), fps)


def probe_video(spark: SparkSession, path: str) -> dict:
    """Digest, and size, rate and length where OpenCV is there."""
    from .readers import file_digests

    try:
        found = file_digests(spark, path).first()
        info = {"path": path, "sha256": found["sha256"] if found else None}
    except Exception:  # unreadable: the digest is unknown, which is all this says
        info = {"path": path, "sha256": None}
    try:
        import cv2
    except ImportError:
        return info | {"duration": None, "width": None, "height": None, "fps": None}
    video = cv2.VideoCapture(path)
    fps = video.get(cv2.CAP_PROP_FPS)
    return info | {
        "duration": round(video.get(cv2.CAP_PROP_FRAME_COUNT) / fps, 3) if fps > 0 else None, "width": int(video.get(cv2.CAP_PROP_FRAME_WIDTH)),
        "height": int(video.get(cv2.CAP_PROP_FRAME_HEIGHT)), "fps": fps,
    }
