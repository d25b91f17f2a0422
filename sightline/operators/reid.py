"""Re-identification of faces by embeddings. Opt-in; embeddings must not be stored."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import cosine

SAME, BLOCK = 0.6, 2000


class Gallery:
    """Leader clustering: the most similar leader, the later of equals, if it is similar enough; else a new one."""

    def __init__(self, threshold: float = SAME):
        self.threshold, self.names, self.vectors = threshold, [], []

    def identify(self, vector) -> str:
        v = np.asarray(vector, float)
        n = float(np.linalg.norm(v))
        v = v / n if n > 0 else v
        best, name = self.threshold, None
        for who, known in zip(self.names, self.vectors):
            s = float(known @ v)
            if s >= best:
                best, name = s, who
        if name is None:
            name = f"person_{len(self.names)}"
            self.names.append(name)
            self.vectors.append(v)
        return name


def identify(rows: DataFrame, threshold: float = SAME) -> DataFrame:
    """recording_id, ts, person_id: faces in the order of time, one gallery for each recording."""

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        g, pdf = Gallery(threshold), pdf.sort_values("ts", kind="stable")
        return pd.DataFrame({"recording_id": pdf["recording_id"], "ts": pdf["ts"], "person_id": [g.identify(v) for v in pdf["vec"]]})

    return rows.groupBy("recording_id").applyInPandas(work, "recording_id bigint, ts double, person_id string")


def similar_pairs(rows: DataFrame, threshold: float = SAME) -> DataFrame:
    """Pairs of a recording's faces at or above the threshold: a, b (a < b), score.

    Every pair is compared, as the threshold is low and all pairs are asked for. A recording of more than BLOCK faces is dealt out in pairs
    of blocks, so that no task holds more than two.
    """
    blocks = rows.groupBy("recording_id").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = rows.join(blocks, "recording_id").withColumn("own", F.pmod(F.xxhash64("ts"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    left = own.select("recording_id", F.col("own").alias("p"), F.explode(every).alias("q"), F.col("ts").alias("a"), F.col("vec").alias("u"))
    right = own.select("recording_id", F.explode(every).alias("p"), F.col("own").alias("q"), F.col("ts").alias("b"), F.col("vec").alias("v"))
    scored = left.join(right, ["recording_id", "p", "q"]).filter("a < b").withColumn("score", cosine(F.col("u"), F.col("v")))
    return scored.filter(F.col("score") >= threshold).select("recording_id", "a", "b", "score")
