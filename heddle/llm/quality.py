"""Quality classifier: random Fourier features, ridge scores from partition-summed normal equations, isotonic calibration.

The statistics of a text (standardised over the training rows) go through `features` random cosines, which approximate a
Gaussian kernel. Each partition of the training rows sums its part of the normal equations; the sums are added by Spark and
one system of features + 1 unknowns is solved on the driver. One training row in four (by hash) stays out of the regression
and calibrates the scores: they are summed in bins of 1/1000 and pooled isotonically. All labelled training rows count; the
driver holds sums alone, whose size depends on `features` only.

Edge cases: a null or empty text has zero statistics and a score like any other; null ids or null labels never teach; a
document that is labelled several times teaches once, by its largest label; without any training row every score is 0.5.
Ties and repeated rows score alike; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.calibration import Isotonic
from heddle.llm.common import held_out, training_rows, written
from heddle.llm.statistics import NAMES, with_statistics

#: Statistics that speak of quality; those of abuse are left out.
USED = [k for k, name in enumerate(NAMES) if "abuse" not in name and "second" not in name]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    weights: np.ndarray
    isotonic: Isotonic | None = None

    def cosines(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x[:, USED] - self.mean) / self.scale, -8, 8)
        return np.c_[np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b)), np.ones(len(x))]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.cosines(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.isotonic(self.raw(x))


def matrix(col: pa.Array) -> np.ndarray:
    """An array<float> column whose rows have one length, as a matrix."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return np.asarray(col.flatten()).reshape(len(col), -1).astype(np.float64)


def teaching(labels: DataFrame, label: str, modulus: int, held: int) -> DataFrame:
    """(doc_id, y) of the labelled documents that may teach, once each."""
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{label}`").cast("double").alias("y")).where("y is not null").where(training_rows("doc_id", modulus, held))
    return y.groupBy("doc_id").agg(F.max("y").alias("y"))


def labelled(stats: DataFrame, taught: DataFrame) -> DataFrame:
    """Training rows (doc_id, x, y, calibrates): those of stats whose document is among `taught`."""
    return stats.join(taught, "doc_id").select("doc_id", "x", "y", F.expr("pmod(xxhash64(doc_id), 4) = 0").alias("calibrates"))


def fit(train: DataFrame, features: int = 192, gamma: float = 0.05, ridge: float = 1e-3, seed: int = 7) -> Model | None:
    rows = train.where("not calibrates")
    moments = rows.select(F.posexplode("x").alias("k", "v"), "y").groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("k").collect()
    if not moments:
        return None
    rng = np.random.default_rng(seed)
    w = rng.normal(0, np.sqrt(2 * gamma), (len(USED), features))
    model = Model(np.array([moments[k].m for k in USED]), np.array([moments[k].s or 1.0 for k in USED]), w, rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1))
    model.scale[model.scale < 1e-9] = 1.0
    n = features + 1
    schema = pa.schema([("i", pa.int32()), ("v", pa.list_(pa.float64()))])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n + 1))
        for b in batches:
            if b.num_rows:
                z = model.cosines(matrix(b.column(0)))
                total += z.T @ np.c_[z, np.asarray(b.column(1))]
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * (n + 1), total.ravel())], schema=schema)

    parts = rows.select("x", "y").mapInArrow(sums, "i int, v array<double>")
    cells = parts.select("i", F.posexplode("v").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    total = np.zeros((n, n + 1))
    total[np.asarray(cells["i"]), np.asarray(cells["j"])] = np.asarray(cells["v"])
    a, y = total[:, :n], total[:, n]
    model.weights = np.linalg.solve(a + ridge * max(a[-1, -1], 1.0) * np.eye(n) / n, y)
    model.isotonic = calibrated(train, model.raw)
    return model


def calibrated(train: DataFrame, raw) -> Isotonic:
    """Isotonic map of raw scores, from sums over the calibration rows in bins of 1/1000 (over all training rows if fewer than 20 calibrate, too few to pool)."""
    schema = pa.schema([("calibrates", pa.bool_()), ("bin", pa.int64()), ("y", pa.float64())])

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(2), pa.array(np.floor(np.clip(raw(matrix(b.column(0))), -50, 50) * 1000).astype(np.int64)), b.column(1)], schema=schema)

    found = train.select("x", "y", "calibrates").mapInArrow(bins, "calibrates boolean, bin long, y double").groupBy("calibrates", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p")).collect()
    own = [r for r in found if r.calibrates] if sum(r.n for r in found if r.calibrates) >= 20 else found
    return Isotonic(*(np.array(c, float) for c in ([(r.bin + 0.5) / 1000 for r in own], [r.n for r in own], [r.p for r in own])))


def applied(stats: DataFrame, score) -> DataFrame:
    """(doc_id, score) of every row of stats."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.clip(score(matrix(b.column(1))), 0, 1))], schema=schema)

    return stats.mapInArrow(run, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", modulus: int = 3, held: int = 1) -> DataFrame:
    """Per row of docs: doc_id, held_out, score (0 to 1, higher: better)."""
    stats = written(with_statistics(docs, id_col, text_col), "quality-statistics")
    model = fit(written(labelled(stats, teaching(labels, label, modulus, held)), "quality-training"))
    scored = applied(stats, model.score) if model else stats.select("doc_id", F.lit(0.5).alias("score"))
    return scored.select("doc_id", held_out("doc_id", modulus, held).alias("held_out"), "score")
