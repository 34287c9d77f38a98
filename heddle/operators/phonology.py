"""Phonology and word analysis as column expressions: syllable structure, tones with ordered rewriting, phonotactics, stress, affixes.

Sound classes, tone rules and affixes are parameters of small fixed size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.operators.rows import first_per_key


@dataclass(frozen=True)
class Sounds:
    """vowels: letters that make a nucleus; onsets, nuclei, codas: those that are allowed; marks: letters of a syllable that tell a tone other than the first."""

    vowels: str
    onsets: tuple[str, ...]
    nuclei: tuple[str, ...]
    codas: tuple[str, ...]
    marks: tuple[tuple[str, str], ...] = ()
    longest: int = 2


def syllables(word: Column, sounds: Sounds) -> Column:
    """Cuts before the consonants that lead to the next vowel; the last syllable takes what is left. A word without vowels is one syllable."""
    v = sounds.vowels
    found = F.regexp_extract_all(word, F.lit(f"[^{v}]*[{v}]+(?:[^{v}]+$)?"), F.lit(0))
    return F.when(word == "", F.array().cast("array<string>")).when(F.size(found) == 0, F.array(word)).otherwise(found)


def structures(parts: Column, sounds: Sounds) -> Column:
    """(syllable, onset, nucleus, coda, valid) of each syllable."""
    v = sounds.vowels

    def one(s: Column) -> Column:
        onset, nucleus, coda = (F.regexp_extract(s, f"^([^{v}]*)([{v}]*)(.*)$", k) for k in (1, 2, 3))
        valid = onset.isin(list(sounds.onsets)) & nucleus.isin(list(sounds.nuclei)) & coda.isin(list(sounds.codas))
        return F.struct(s.alias("syllable"), onset.alias("onset"), nucleus.alias("nucleus"), coda.alias("coda"), valid.alias("valid"))

    return F.transform(parts, one)


def tones(parts: Column, sounds: Sounds) -> Column:
    """The tone that a mark in the syllable tells, the first mark of the list that is there, else T1."""

    def one(s: Column) -> Column:
        out = F.lit("T1")
        for letters, tone in reversed(sounds.marks):
            out = F.when(s.rlike(f"[{letters}]"), tone).otherwise(out)
        return out

    return F.transform(parts, one)


def sandhi(tone: Column, rules: dict[tuple[str, str], tuple[str, str]]) -> Column:
    """Tones after rewriting pairs from left to right: a transducer whose state is the tone last written, so that a rule sees what the one before made."""
    if not rules:
        return tone
    known = F.create_map(*[F.lit(x) for (a, b), new in rules.items() for x in (f"{a} {b}", " ".join(new))])
    first = F.slice(tone, 1, 1)

    def step(done: Column, t: Column) -> Column:
        last = F.element_at(done, -1)
        pair = F.split(F.coalesce(known[F.concat_ws(" ", last, t)], F.concat_ws(" ", last, t)), " ")
        return F.concat(F.slice(done, 1, F.size(done) - 1), pair)

    return F.when(F.size(tone) < 2, tone).otherwise(F.aggregate(F.slice(tone, 2, F.greatest(F.size(tone) - 1, F.lit(1))), first, step))


def violations(structure: Column, sounds: Sounds) -> Column:
    """What is wrong with a word: a text for each syllable that is not allowed, and each cluster that is too long. An empty word has no syllable, which is one violation."""
    none = F.array().cast("array<string>")

    def one(s: Column) -> Column:
        bad = F.when(~s["valid"], F.array(F.concat(F.lit("structure "), F.concat_ws("|", s["onset"], s["nucleus"], s["coda"])))).otherwise(none)
        long = [F.when(F.length(s[c]) > sounds.longest, F.array(F.concat(F.lit(f"{c} "), s[c]))).otherwise(none) for c in ("onset", "coda")]
        return F.concat(bad, *long)

    return F.when(F.size(structure) == 0, F.array(F.lit("empty"))).otherwise(F.flatten(F.transform(structure, one)))


def stress(parts: Column) -> Column:
    """The first syllable has primary stress, the last of three or more secondary stress."""
    n = F.size(parts)
    return F.transform(parts, lambda _, i: F.when(i == 0, "primary").when((i == n - 1) & (n > 2), "secondary").otherwise("unstressed"))


def phonology(words: DataFrame, sounds: Sounds, rules: dict, word_col: str = "word") -> DataFrame:
    """words with syllables, structures, tones, sandhi, violations, valid and stress; all null for a null word."""
    w = F.lower(word_col)
    out = words.withColumn("syllables", syllables(w, sounds)).withColumn("structures", structures(F.col("syllables"), sounds)).withColumn("tones", tones(F.col("syllables"), sounds))
    out = out.withColumn("sandhi", sandhi(F.col("tones"), rules)).withColumn("violations", violations(F.col("structures"), sounds))
    return out.withColumn("valid", F.size("violations") == 0).withColumn("stress", stress(F.col("syllables")))


def roots(words: DataFrame, affixes: list[tuple[str, str, str]], least: int = 3) -> DataFrame:
    """(word, root, affix, tag): words without an affix that leaves another of the words; of several the longest affix, then the first in the list.

    affixes: (text, "prefix" or "suffix", tag). A word without one is its own root, its tag null. Candidates are a few a word and join the words.
    """
    tried = []
    for k, (text, kind, tag) in enumerate(affixes):
        has = F.col("word").startswith(text) if kind == "prefix" else F.col("word").endswith(text)
        root = F.substr(F.col("word"), F.lit(len(text) + 1)) if kind == "prefix" else F.expr(f"left(word, length(word) - {len(text)})")
        tried.append(F.when(has & (F.length("word") - len(text) >= least), F.struct(root.alias("root"), F.lit(text).alias("affix"), F.lit(tag).alias("tag"), F.lit(-len(text)).alias("shorter"), F.lit(k).alias("at"))))
    each = words.select("word", F.explode(F.filter(F.array(*tried), lambda x: x.isNotNull())).alias("x")).select("word", "x.*")
    real = each.join(words.select(F.col("word").alias("root")), "root")
    best = first_per_key(real, ["word"], ["shorter", "at"]).select("word", "root", "affix", "tag")
    return words.select("word").join(best, "word", "left").withColumn("root", F.coalesce("root", "word"))


def analysed(words: DataFrame, sounds: Sounds, affixes: list[tuple[str, str, str]], lexicon: DataFrame, senses: DataFrame, most: int = 3) -> DataFrame:
    """One row a word (word, n): syllables, root, affix, part of speech (the lexicon's (word, tag), else that of the root, else the affix's tag, else X) and the first `most` senses of (word, sense)."""
    tagged = roots(words.select("word"), affixes)
    own = lexicon.select("word", F.col("tag").alias("own"))
    of_root = lexicon.select(F.col("word").alias("root"), F.col("tag").alias("of_root"))
    listed = first_per_key(senses.select("word", "sense").distinct(), ["word"], ["sense"], most).groupBy("word").agg(F.array_sort(F.collect_list("sense")).alias("senses"))
    j = words.select("word", "n").join(tagged, "word").join(own, "word", "left").join(of_root, "root", "left").join(listed, "word", "left")
    pos = F.coalesce("own", F.when(F.col("affix").isNull(), F.col("of_root")), "tag", "of_root", F.lit("X"))
    return j.select("word", "n", syllables(F.col("word"), sounds).alias("syllables"), "root", "affix", pos.alias("pos"), F.coalesce("senses", F.array().cast("array<string>")).alias("senses"))
