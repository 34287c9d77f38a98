"""Toxicity: gradient-boosted trees over dense statistics of the text, with isotonic calibration.

Statistics: densities of a lexicon that is learnt from the teaching rows (words and word beginnings, out of fold; see
lexicon.py) and of a short list of words of abuse (as written, and with look-alike signs read as letters), their nearness
to words that address the reader, capitals, punctuation and mixed words, and the general shape of the text. The trees are fitted on
the driver on a bounded sample of labelled rows (`sample`, chosen by hash of the id, all rows if there are fewer), as the
boosting rounds need the rows in memory; one training row in four stays out of it and calibrates the scores, over all
labelled training rows. Every document is scored.

Edge cases: a null or empty text has zero statistics and a score like any other; null ids or null labels never teach; a
document that is labelled several times teaches once, by its largest label; without any training row every score is 0.
Ties and repeated rows score alike; other columns are never read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import held_out, keyed, small_side, training_sql, without_ids, written
from heddle.llm.lexicon import FOLDS, fold_of, learn
from heddle.llm.quality import applied, calibrated, labelled, matrix, teaching
from heddle.llm.statistics import with_statistics

SAMPLE = 60_000
THRESHOLD = 0.3


class Boosted:
    """Binary logistic boosting with histograms of at most `bins` values per statistic."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, least: float = 4.0, smooth: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least, self.smooth = trees, depth, rate, bins, least, smooth

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(self.edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = []
        for col in x.T:
            values = np.unique(col)
            if len(values) > self.bins:
                rest = col[col != 0]
                values = np.unique(np.r_[0.0, np.quantile(rest, np.linspace(0, 1, self.bins - 1))])
            self.edges.append((values[1:] + values[:-1]) / 2)
        q, n, f = self._binned(x), len(y), x.shape[1]
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(p / (1 - p)))
        raw, width = np.full(n, self.start), max(map(len, self.edges)) + 1
        self.forest = []
        cell = q + np.arange(f) * width
        for _ in range(self.trees):
            prob = 1 / (1 + np.exp(-raw))
            g, h = prob - y, prob * (1 - prob)
            node, tree = np.zeros(n, np.int64), []
            for level in range(self.depth):
                k = 1 << level
                at = (node[:, None] * (f * width) + cell).ravel()
                gs = np.bincount(at, np.repeat(g, f), k * f * width).reshape(k, f, width).cumsum(2)
                hs = np.bincount(at, np.repeat(h, f), k * f * width).reshape(k, f, width).cumsum(2)
                gt, ht = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs**2 / (hs + self.smooth) + (gt - gs) ** 2 / (ht - hs + self.smooth) - gt**2 / (ht + self.smooth)
                gain[(hs < self.least) | (ht - hs < self.least)] = 0
                best = gain.reshape(k, -1).argmax(1)
                feature, cut = best // width, best % width
                cut = np.where(gain.reshape(k, -1).max(1) > 1e-9, cut, width)
                tree.append((feature, cut))
                node = node * 2 + (q[np.arange(n), feature[node]] > cut[node])
            leaf = -np.bincount(node, g, 1 << self.depth) / (np.bincount(node, h, 1 << self.depth) + self.smooth) * self.rate
            self.forest.append((tree, leaf))
            raw += leaf[node]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        q, rows = self._binned(x), np.arange(len(x))
        out = np.full(len(x), self.start)
        for tree, leaf in self.forest:
            node = np.zeros(len(x), np.int64)
            for feature, cut in tree:
                node = node * 2 + (q[rows, feature[node]] > cut[node])
            out += leaf[node]
        return out


def fit(train: DataFrame, sample: int = SAMPLE):
    """A scoring function from training rows (x, y, calibrates), or None without any."""
    rows = train.where("not calibrates")
    n = rows.count()
    if not n:
        return None
    if n > sample:
        rows = rows.where(f"pmod(xxhash64(doc_id, 17), {n}) < {sample + sample // 10}").orderBy(F.expr(f"pmod(xxhash64(doc_id, 17), {n})"), "doc_id").limit(sample)
    got = rows.orderBy("doc_id").select("x", "y").toArrow()
    trees = Boosted().fit(matrix(got["x"]), np.asarray(got["y"]))
    isotonic = calibrated(train, trees.raw)
    return lambda x: isotonic(trees.raw(x))


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", modulus: int = 4, held: int = 2, sample: int = SAMPLE) -> DataFrame:
    """Per row of docs: doc_id, held_out, score (0 to 1, higher: more likely toxic)."""
    d = keyed(docs, id_col, text_col)
    taught = written(teaching(labels, label, modulus, held), "toxicity-labels")
    lexicon = docs.sparkSession.sparkContext.broadcast(learn(d.join(small_side(taught, "doc_id"), "doc_id")))
    row = f"if({training_sql('doc_id', modulus, held)}, {fold_of('doc_id')}, {FOLDS})"
    stats = with_statistics(docs, id_col, text_col, row, lambda raw, offsets, fold: lexicon.value.features(raw, offsets, fold))
    stats = written(stats, "toxicity-statistics")
    score = fit(written(labelled(stats, taught), "toxicity-training"), sample)
    scored = applied(stats, score) if score else stats.select("doc_id", F.lit(0.0).alias("score"))
    return scored.select("doc_id", held_out("doc_id", modulus, held).alias("held_out"), "score")


def not_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns. Rows with one id fall together."""
    bad = toxicity_scores(docs, labels, id_col, text_col).where(F.col("score") >= threshold).select("doc_id").distinct()
    return without_ids(docs, id_col, bad)
