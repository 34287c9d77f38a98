"""Language gates and guesses by marker words; lexicons are parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.functions import text as T


def by_markers(docs: DataFrame, lexicons: dict[str, list[str]]) -> DataFrame:
    """(doc_id, guess): the language with most marker words, the earlier of equals, unknown without any."""
    t = docs.select("doc_id", T.tokens(F.col("text")).alias("t"))

    def hits_of(words: list[str]):
        return F.size(F.filter("t", lambda x: x.isin(words)))

    hits = {name: hits_of(words) for name, words in lexicons.items()}
    most = F.greatest(*hits.values())
    guess = F.when(most == 0, "unknown")
    for name, n in hits.items():
        guess = guess.when(n == most, name)
    return t.select("doc_id", guess.alias("guess"))


def gate(docs: DataFrame, markers: list[str], least: int = 2, long_share: float = 0.009, short_share: float = 0.012) -> DataFrame:
    """Rows with `least` different markers and enough of them: a smaller share suffices above 300 characters."""
    t = T.tokens(F.col("text"))
    kinds = F.size(F.array_distinct(F.filter(t, lambda x: x.isin(markers))))
    return docs.where((kinds >= least) & (T.hit_share(t, markers) >= F.when(F.length("text") > 300, long_share).otherwise(short_share)))


def purity_band(score):
    """Bands of a purity score from 0 to 100."""
    return F.when(score >= 99, "PURE").when(score >= 90, "MOSTLY").when(score >= 70, "MIXED").otherwise("CONTAMINATED")
