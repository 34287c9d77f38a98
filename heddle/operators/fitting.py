"""Fitting of smooth convex models whose loss and gradient are sums over rows: sums per task, then over tasks, a quasi-Newton step on the driver.

A model is one vector of fixed size; only it and sums of its size travel, in `PARTS` parts, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PARTS = 8


def summed(df: DataFrame, f: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray | None:
    """The sum of f(batch), vectors of one size, over all batches of df; None without rows."""

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                total = f(b) if total is None else total + f(b)
        if total is not None:
            parts = np.array_split(total, PARTS)
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["part", "sums"])

    def of_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for part, sums in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[part] = total.get(part, 0) + np.frombuffer(sums)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["part", "sums"])

    rows = df.mapInArrow(of_task, "part int, sums binary").repartition(PARTS, "part").mapInArrow(of_part, "part int, sums binary").collect()
    return np.concatenate([np.frombuffer(r.sums) for r in sorted(rows, key=lambda r: r.part)]) if rows else None


def minimised(f: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, rounds: int = 30, memory: int = 7, enough: float = 1e-4) -> np.ndarray:
    """A minimum of f(x) = (value, gradient) by limited-memory quasi-Newton steps with halving; `rounds` evaluations at most."""
    x, (value, g) = start, f(start)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    left = rounds - 1
    while left > 0 and np.abs(g).max(initial=0.0) > enough:
        d, back = -g, []
        for s, y in reversed(past):
            a = (s @ d) / (s @ y)
            back.append(a)
            d = d - a * y
        d = d * ((past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(np.sqrt(g @ g), 1e-12))
        for (s, y), a in zip(past, reversed(back), strict=True):
            d = d + s * (a - (y @ d) / (s @ y))
        step = 1.0
        while left > 0:
            new = x + step * d
            new_value, new_g = f(new)
            left -= 1
            if new_value <= value + 1e-4 * step * (g @ d):
                break
            step /= 2
        else:
            return x
        s, y = new - x, new_g - g
        if s @ y > 1e-12:
            past = [*past, (s, y)][-memory:]
        x, value, g = new, new_value, new_g
    return x


def fit(df: DataFrame, loss: Callable[[np.ndarray], Callable[[pa.RecordBatch], np.ndarray]], size: int, l2: float, rounds: int = 30) -> np.ndarray:
    """The vector of `size` numbers with the least mean loss over the rows of df, plus l2 / 2 times its square.

    loss(x) gives a function of a batch: an array of the number of rows, the summed loss, and the summed gradient.
    """
    spark = df.sparkSession

    def f(x: np.ndarray) -> tuple[float, np.ndarray]:
        held = spark.sparkContext.broadcast(x)
        total = summed(df, lambda b: loss(held.value)(b))
        held.unpersist()
        n = total[0] if total is not None else 1
        mean, g = (total[1] / n, total[2:] / n) if total is not None else (0.0, np.zeros(size))
        return mean + l2 / 2 * float(x @ x), g + l2 * x

    return minimised(f, np.zeros(size), rounds)
