"""Isotonic calibration from summed bins: pool adjacent violators, then straight lines between the pools."""

from __future__ import annotations

import numpy as np


class Isotonic:
    """A monotone map from raw scores to probabilities, fitted on (score, rows, positives) sums."""

    def __init__(self, score: np.ndarray, rows: np.ndarray, positives: np.ndarray):
        pools: list[list[float]] = []  # score sum, rows, positives
        for s, n, y in sorted(zip(score, rows, positives, strict=True)):
            pools.append([s * n, n, y])
            while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
        self.at = np.array([p[0] / p[1] for p in pools]) if pools else np.zeros(1)
        # half a row of either class more keeps a pool off 0 and 1
        self.value = np.array([(p[2] + 0.5) / (p[1] + 1) for p in pools]) if pools else np.full(1, 0.5)
        self.value = np.maximum.accumulate(self.value)

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.at, self.value)
