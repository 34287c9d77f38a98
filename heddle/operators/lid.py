"""Trained language identification: hashed character n-grams and a multinomial linear model.

A text's features are the 1- to 4-grams of its words, a blank on either side, hashed into BUCKETS cells, as square roots of
counts, to length one. The model has a weight for each cell and label and is fitted by summed gradients over all training
rows (`fitting`); features are written once and read in every round.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.operators.fitting import fit

BUCKETS, LONGEST, L2 = 1 << 14, 4, 1e-5
#: Characters of a text that are worked on at once; the cells' counts are added up over them, so whole texts count.
PIECE = 1 << 20


def cells(text: str, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(cell, weight) of a text's n-grams, cells rising; empty for a text without letters or digits."""
    total = np.zeros(buckets, np.int64)
    for k in range(0, len(text), PIECE):
        own = "".join(c if c.isalnum() else " " for c in text[k : k + PIECE].lower())
        if not (words := own.split()):
            continue
        code = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
        blank = code == 32
        h = np.zeros(len(code), np.uint64)
        for n in range(1, LONGEST + 1):
            h = h[: len(code) - n + 1] * np.uint64(0x100000001B3) + code[n - 1 :]
            # blanks stand only at either end of an n-gram
            inner = np.zeros(len(h), bool)
            for j in range(1, n - 1):
                inner |= blank[j : j + len(h)]
            kept = h[~inner & ~(blank[: len(h)] & (n == 1))]
            mixed = (kept ^ kept >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
            total += np.bincount((mixed >> np.uint64(20)).astype(np.int64) % buckets, minlength=buckets)
    at = np.flatnonzero(total)
    weight = np.sqrt(total[at])
    return at, weight / max(np.sqrt((weight * weight).sum()), 1e-12)


def featured(docs: DataFrame, buckets: int = BUCKETS, text_col: str = "text") -> DataFrame:
    """docs' other columns with `cell` and `weight`; a null text has none."""
    others = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                b = whole.slice(k, 500)
                found = [cells(t or "", buckets) for t in b.column(len(others)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(others))), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float32()))], names=[*others, "cell", "weight"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text_col)
    return docs.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text_col}`").cast("string").alias("__text")).mapInArrow(run, f"{kinds}, cell array<int>, weight array<float>")


def _scores(w: np.ndarray, cell: pa.Array, weight: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(scores by row and label, row of each entry, cells, weights)."""
    size = np.asarray(cell.value_lengths())
    row = np.repeat(np.arange(len(size)), size)
    at, x = np.asarray(cell.flatten()), np.asarray(weight.flatten(), float)
    s = np.stack([np.bincount(row, x * w[at, k], len(size)) for k in range(w.shape[1])], 1)
    return s, row, at, x


def log_loss(w: np.ndarray, cell: pa.Array, weight: pa.Array, label: np.ndarray) -> tuple[float, np.ndarray]:
    """The summed loss of rows and its gradient."""
    s, row, at, x = _scores(w, cell, weight)
    s = s - s.max(1, keepdims=True)
    p = np.exp(s)
    z = p.sum(1, keepdims=True)
    loss = float((np.log(z[:, 0]) - s[np.arange(len(s)), label]).sum())
    p /= z
    p[np.arange(len(s)), label] -= 1
    return loss, np.stack([np.bincount(at, x * p[row, k], len(w)) for k in range(w.shape[1])], 1)


@dataclass(frozen=True)
class Identifier:
    labels: list[str]
    weights: np.ndarray


def train(features: DataFrame, label_col: str, labels_at_most: int = 200, rounds: int = 40, l2: float = L2, buckets: int = BUCKETS) -> Identifier:
    """Fits rows (cell, weight, label); rows without a label do not teach. The number of labels is checked, as the model has their size."""
    taught = features.where(F.col(label_col).isNotNull())
    labels = sorted(r[0] for r in taught.select(label_col).distinct().limit(labels_at_most + 1).collect())
    if len(labels) > labels_at_most:
        raise ValueError(f"more than {labels_at_most} labels")
    shape = (buckets, len(labels))
    index = {x: k for k, x in enumerate(labels)}

    def loss(x: np.ndarray):
        def of(b: pa.RecordBatch) -> np.ndarray:
            value, g = log_loss(x.reshape(shape), b.column(0), b.column(1), np.array([index[v] for v in b.column(2).to_pylist()]))
            return np.r_[b.num_rows, value, g.ravel()]

        return of

    return Identifier(labels, fit(taught.select("cell", "weight", label_col), loss, buckets * len(labels), l2, rounds).reshape(shape))


def identified(features: DataFrame, model: Identifier) -> DataFrame:
    """features' other columns with `predicted` and its probability, `confidence`; texts without features have neither."""
    others = [c for c in features.columns if c not in ("cell", "weight")]
    held = features.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            best = p = [None] * b.num_rows
            if b.num_rows and m.labels:
                s, row, _, _ = _scores(m.weights, b.column(len(others)), b.column(len(others) + 1))
                there = np.bincount(row, minlength=b.num_rows) > 0
                e = np.exp(s - s.max(1, keepdims=True))
                best = [m.labels[k] if t else None for k, t in zip(s.argmax(1), there, strict=True)]
                p = [float(x) if t else None for x, t in zip(e.max(1) / e.sum(1), there, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(others))), pa.array(best, pa.string()), pa.array(p, pa.float64())], names=[*others, "predicted", "confidence"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in features.schema if f.name in others)
    return features.select(*[F.col(f"`{c}`") for c in others], "cell", "weight").mapInArrow(run, f"{kinds}predicted string, confidence double")
