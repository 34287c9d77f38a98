"""A lexicon of words and word beginnings that mark a label, learnt from labelled texts by document frequency.

A gram is a whole word or the first `LENGTHS` bytes of one, lower-case, with look-alike signs read as letters. Each
labelled text counts once for each of its grams; Spark sums the counts by gram, label and fold. A gram enters the
lexicon if it stands in at least `least` texts with the label and its smoothed log odds are at least `odds`; the `size`
grams with the most evidence (count times log odds) stay, so what is sent to the tasks is bounded by `size`.

The weights are out of fold: a text that may teach is weighed by counts without its own fold (a hash of its id), so the
densities of a training text never rest on its own label; all other texts are weighed by all counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import pieces, text_bytes
from heddle.llm.statistics import folded_words, word_starts

LENGTHS = (4, 5, 6, 7)
FOLDS = 4
SIZE, LEAST, ODDS = 8192, 4, 1.5
FEATURES = ("lexicon_density", "log_lexicon_hits", "largest_weight", "strong_hits")
_WHOLE = np.uint64(0xA0761D6478BD642F)


def fold_of(id_sql: str) -> str:
    return f"cast(pmod(xxhash64({id_sql}, 5), {FOLDS}) as int)"


def grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text of each word): one row of hashes per word, a column per length and one for the whole; 0 where too short."""
    starts, doc = word_starts(raw, offsets)
    h, whole = folded_words(raw, starts, LENGTHS)
    return np.c_[h, np.where(whole > 0, whole ^ _WHOLE, np.uint64(0))], doc


@dataclass
class Lexicon:
    """Sorted gram hashes and their weights: one row per fold without that fold's counts, then one with all."""

    hashes: np.ndarray
    weights: np.ndarray

    def __post_init__(self):
        self.flag = np.zeros(1 << 20, bool)
        self.flag[self.hashes >> np.uint64(44)] = True

    def features(self, raw: np.ndarray, offsets: np.ndarray, fold: np.ndarray) -> np.ndarray:
        """FEATURES of each text; `fold` is the row of weights to use for it."""
        n = len(offsets) - 1
        out = np.zeros((n, len(FEATURES)))
        h, doc = grams(raw, offsets)
        if not len(doc) or not len(self.hashes):
            return out
        word, col = np.nonzero(self.flag[h >> np.uint64(44)])
        value = h[word, col]
        at = np.minimum(np.searchsorted(self.hashes, value), len(self.hashes) - 1)
        hit = (self.hashes[at] == value) & (value > 0)
        word, at = word[hit], at[hit]
        best = np.zeros(len(doc))
        np.maximum.at(best, word, self.weights[fold[doc[word]], at])
        words = np.maximum(np.bincount(doc, minlength=n), 1)
        hits = np.bincount(doc[best > 0], minlength=n)
        out[:, 0] = np.bincount(doc, best, n) / words
        out[:, 1] = np.log1p(hits)
        np.maximum.at(out[:, 2], doc, best)
        out[:, 3] = np.log1p(np.bincount(doc[best >= 3], minlength=n))
        return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, cell, n) of labelled texts (fold, y, text), summed over large pieces; cell is fold * 2 + y."""
    held: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        both = np.concatenate(held)
        both = both[np.lexsort((both[:, 1], both[:, 0]))]
        new = np.flatnonzero(np.r_[True, (both[1:] != both[:-1]).any(1)])
        return pa.RecordBatch.from_arrays([pa.array(both[new, 0].view(np.int64)), pa.array(both[new, 1].astype(np.int32)), pa.array(np.diff(np.r_[new, len(both)]).astype(np.int64))], names=["gram", "cell", "n"])

    for b in pieces(batches, 1 << 20):
        h, doc = grams(*text_bytes(b.column(2)))
        cell = (np.asarray(b.column(0)) * 2 + np.asarray(b.column(1))).astype(np.uint64)
        for k in range(h.shape[1]):
            gram, of = _distinct(h[:, k], doc)
            held.append(np.c_[gram, cell[of]])
            size += len(gram)
        if size > 2_000_000:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


def _distinct(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (hash, text) pairs with a hash above 0."""
    some = h > 0
    h, doc = h[some], doc[some]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])] if len(h) else np.zeros(0, bool)
    return h[new], doc[new]


def learn(labelled: DataFrame, size: int = SIZE, least: int = LEAST, odds: float = ODDS) -> Lexicon:
    """A lexicon from labelled rows (doc_id, text, y): y is 0 or 1."""
    rows = labelled.select(F.expr(fold_of("doc_id")).alias("fold"), F.expr("cast(y > 0 as int)").alias("y"), F.coalesce("text", F.lit("")).alias("text"))
    totals = np.zeros((FOLDS, 2))
    for r in labelled.groupBy(F.expr(fold_of("doc_id")).alias("fold"), F.expr("cast(y > 0 as int)").alias("y")).count().collect():
        totals[r.fold, r.y] = r["count"]
    counted = rows.mapInArrow(_counted, "gram long, cell int, n long")
    cells = [F.sum(F.when(F.col("cell") == c, F.col("n")).otherwise(0)).alias(f"c{c}") for c in range(2 * FOLDS)]
    by_gram = counted.groupBy("gram").agg(*cells)
    ones, zeros = (" + ".join(f"c{2 * f + y}" for f in range(FOLDS)) for y in (1, 0))
    whole = totals.sum(0)
    log_odds = f"ln(({ones} + 0.5) / {whole[1] + 1}) - ln(({zeros} + 0.5) / {whole[0] + 1})"
    found = by_gram.where(f"{ones} >= {least}").withColumn("w", F.expr(log_odds)).where(F.col("w") >= odds)
    top = found.orderBy(F.expr(f"({ones}) * w").desc(), "gram").limit(size).toArrow()
    gram = np.asarray(top["gram"]).view(np.uint64)
    order = np.argsort(gram)
    c = np.stack([np.asarray(top[f"c{k}"]) for k in range(2 * FOLDS)]).astype(float)[:, order].reshape(FOLDS, 2, -1)
    left = np.concatenate([c.sum(0)[None] - c, c.sum(0)[None]])
    n = np.concatenate([whole[None] - totals, whole[None]])
    weights = np.log((left[:, 1] + 0.5) / (n[:, 1, None] + 1)) - np.log((left[:, 0] + 0.5) / (n[:, 0, None] + 1))
    weights[(left[:, 1] < least - 1) | (weights < odds)] = 0
    return Lexicon(gram[order], weights)
