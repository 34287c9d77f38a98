"""Syllable boundaries by a linear-chain conditional random field over letters.

Each letter starts a syllable or goes on with one. Features are the letters around a place, hashed into CELLS cells for each
tag, and a weight for each pair of tags. Fitting sums forward-backward expectations per task and over tasks (`fitting`);
segmentation takes the best path. Words of one length are worked on together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.operators.fitting import fit

CELLS, L2 = 1 << 13, 1e-4
#: Letter windows around a place: first and last offset.
WINDOWS = ((0, 0), (-1, -1), (1, 1), (-2, -2), (2, 2), (-1, 0), (0, 1), (-2, 0), (-1, 1), (0, 2), (1, 2), (-2, -1))
SIZE = CELLS * 2 + 4


def cells(code: np.ndarray) -> np.ndarray:
    """Cells of the features at each place of words of one length: (words, places, windows)."""
    n, size = code.shape
    wide = np.zeros((n, size + 4), np.uint64)  # places outside the word count as letter 0
    wide[:, 2 : size + 2] = code
    out = np.empty((n, size, len(WINDOWS)), np.int64)
    for k, (low, high) in enumerate(WINDOWS):
        h = np.full((n, size), np.uint64(k + 1))
        for d in range(low, high + 1):
            h = h * np.uint64(0x9E3779B97F4A7C15) + wide[:, 2 + d : 2 + d + size] + np.uint64(1)
            h ^= h >> np.uint64(31)
        out[:, :, k] = (h * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) % CELLS
    return out


def _codes(words: list[str]) -> np.ndarray:
    return np.array([[ord(c) for c in w] for w in words], np.uint64)


def _potentials(x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores of each tag at each place, scores of tag pairs); a word starts with a syllable."""
    score = x[: CELLS * 2].reshape(CELLS, 2)[cell].sum(2)
    score[:, 0, 0] = -np.inf
    return score, x[CELLS * 2 :].reshape(2, 2)


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis, keepdims=True))).squeeze(axis)


def expectations(x: np.ndarray, words: list[str], tags: np.ndarray) -> np.ndarray:
    """(1 a word, minus log likelihood, its gradient) summed over words of one length with tags (1 starts a syllable)."""
    cell = cells(_codes(words))
    score, pair = _potentials(x, cell)
    n, size, _ = score.shape
    ahead, back = np.empty_like(score), np.zeros_like(score)
    ahead[:, 0] = score[:, 0]
    for t in range(1, size):
        ahead[:, t] = score[:, t] + _log_sum(ahead[:, t - 1, :, None] + pair, 1)
    for t in range(size - 2, -1, -1):
        back[:, t] = _log_sum(pair + (score[:, t + 1] + back[:, t + 1])[:, None, :], 2)
    total = _log_sum(ahead[:, -1], 1)
    own = np.arange(n)[:, None], np.arange(size)[None, :], tags
    path = score[own].sum(1) + pair[tags[:, :-1], tags[:, 1:]].sum(1)
    share = np.exp(ahead + back - total[:, None, None])
    share[own] -= 1
    g = np.zeros((CELLS, 2))
    for k in range(2):
        g[:, k] = np.bincount(cell.ravel(), np.repeat(share[:, :, k].ravel(), cell.shape[2]), CELLS)
    pairs = np.zeros((2, 2))
    for t in range(1, size):
        pairs += np.exp(ahead[:, t - 1, :, None] + pair + (score[:, t] + back[:, t])[:, None, :] - total[:, None, None]).sum(0)
    np.subtract.at(pairs, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
    return np.r_[n, float((total - path).sum()), g.ravel(), pairs.ravel()]


def best_tags(x: np.ndarray, words: list[str]) -> np.ndarray:
    """The best tags of words of one length; of equal paths the one with fewer starts at the end."""
    score, pair = _potentials(x, cells(_codes(words)))
    n, size, _ = score.shape
    best, came = score[:, 0], np.zeros((n, size, 2), np.int64)
    for t in range(1, size):
        way = best[:, :, None] + pair
        came[:, t] = way.argmax(1)
        best = way.max(1) + score[:, t]
    tags = np.empty((n, size), np.int64)
    tags[:, -1] = best.argmax(1)
    for t in range(size - 1, 0, -1):
        tags[:, t - 1] = came[np.arange(n), t, tags[:, t]]
    return tags


@dataclass(frozen=True)
class Segmenter:
    weights: np.ndarray


def _by_length(words: list[str], most: int = 1 << 16) -> Iterator[np.ndarray]:
    size = np.array([len(w) for w in words])
    for s in np.unique(size[size > 0]):
        at = np.flatnonzero(size == s)
        for k in range(0, len(at), max(1, most // int(s))):
            yield at[k : k + max(1, most // int(s))]


def train(gold: DataFrame, rounds: int = 30, l2: float = L2) -> Segmenter:
    """Fits rows (word, syllables); rows whose syllables do not spell the word do not teach."""
    g = gold.select(F.lower("word").alias("word"), F.col("syllables")).where(F.lower(F.array_join("syllables", "")) == F.col("word")).where("word <> ''")

    def loss(x: np.ndarray):
        def of(b: pa.RecordBatch) -> np.ndarray:
            words, syllables = b.column(0).to_pylist(), b.column(1).to_pylist()
            total = np.zeros(SIZE + 2)
            for at in _by_length(words):
                own = [words[k] for k in at]
                tags = np.array([[int(j == 0) for s in syllables[k] for j in range(len(s))] for k in at])
                total += expectations(x, own, tags)
            return total

        return of

    return Segmenter(fit(g, loss, SIZE, l2, rounds))


def segmented(words: DataFrame, model: Segmenter, word_col: str = "word") -> DataFrame:
    """words with `syllables`; of an empty word none, of a null word null."""
    held = words.sparkSession.sparkContext.broadcast(model.weights)

    @F.arrow_udf("array<string>")
    def split(col: pa.Array) -> pa.Array:
        low = [None if w is None else w.lower() for w in col.to_pylist()]
        out = [None if w is None else [] for w in low]
        some = [w or "" for w in low]
        for at in _by_length(some):
            for k, tags in zip(at, best_tags(held.value, [some[k] for k in at]), strict=True):
                cut = [*np.flatnonzero(tags).tolist(), len(some[k])]
                out[k] = [some[k][i:j] for i, j in zip(cut, cut[1:], strict=False)]
        return pa.array(out, pa.list_(pa.string()))

    return words.withColumn("syllables", split(F.col(word_col).cast("string")))


def boundary_scores(found: DataFrame, gold_col: str = "gold", col: str = "syllables") -> DataFrame:
    """One row: precision, recall and F1 of inner boundaries, and the share of words that are right."""

    def ends(c: str) -> str:
        return f"transform(sequence(1, size({c}) - 1), i -> aggregate(slice({c}, 1, i), 0, (a, s) -> a + length(s)))"

    e = found.select(F.expr(f"if(size({col}) > 1, {ends(col)}, array())").alias("a"), F.expr(f"if(size({gold_col}) > 1, {ends(gold_col)}, array())").alias("b"))
    n = e.agg(F.sum(F.size(F.array_intersect("a", "b"))).alias("hit"), F.sum(F.size("a")).alias("said"), F.sum(F.size("b")).alias("true"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("whole"))
    return n.select((F.col("hit") / F.col("said")).alias("precision"), (F.col("hit") / F.col("true")).alias("recall"), (2 * F.col("hit") / (F.col("said") + F.col("true"))).alias("f1"), "whole")
