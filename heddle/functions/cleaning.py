"""Cleaners as column expressions: ordered rewrites, content trims, script removal, masking, cells, JSON values, heading chunks.

Tables of rewrites, labels and words are parameters; their order is the order of application.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from heddle.functions import text as T

#: Blocks of scripts that a Latin corpus does not use (Thai, Myanmar).
FOREIGN = "[฀-๿က-႟]"


def corrected(c: Column, table: list[tuple[str, str]]) -> Column:
    """Regular-expression rewrites, one after the other."""
    for pattern, to in table:
        c = F.regexp_replace(c, pattern, to)
    return c


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Canonical composition; null stays null."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def respelled(c: Column, table: list[tuple[str, str]]) -> Column:
    """Whole-word spelling rewrites, a blank between a sentence end and a capital, white space collapsed."""
    out = corrected(c, [(rf"\b{a}\b", b) for a, b in table])
    return T.collapse(F.regexp_replace(out, r"([.!?])([A-Z])", "$1 $2"))


def trimmed_content(c: Column, least: int = 10) -> Column:
    """White space collapsed within lines; lines of `least` characters or fewer go."""
    return F.array_join(F.filter(F.transform(F.split(c, "\n"), T.collapse), lambda x: F.length(x) > least), "\n")


def without_foreign(c: Column) -> Column:
    return F.regexp_replace(c, FOREIGN, "")


def joined_compounds(c: Column, pairs: list[tuple[str, str]]) -> Column:
    """Two words that belong together become one."""
    return corrected(c, [(rf"\b{a} {b}\b", a + b) for a, b in pairs])


def masked(c: Column, labels: dict[str, list[str]]) -> Column:
    """Each listed word becomes its label in brackets."""
    return corrected(c, [(r"\b(" + "|".join(map(re.escape, words)) + r")\b", f"[{label}]") for label, words in labels.items()])


def cleaned_cell(c: Column, table: list[tuple[str, str]]) -> Column:
    """A struct (value, markup, blanks, spelling): the cleaned cell and which steps changed it: tags, white space, orthography."""
    plain = F.regexp_replace(c, "<[^>]*>", "")
    even = T.collapse(plain)
    spelt = corrected(even, [(rf"\b{a}\b", b) for a, b in table])
    return F.struct(spelt.alias("value"), (plain != c).alias("markup"), (even != plain).alias("blanks"), (spelt != even).alias("spelling"))


def cleaned_json(c: Column, keys: list[str]) -> Column:
    """A JSON object whose text values under the listed keys are trimmed and collapsed; others stay, no JSON object gives null."""
    m = F.from_json(c, "map<string,string>")
    return F.to_json(F.transform_values(m, lambda k, v: F.when(k.isin(*keys), T.collapse(v)).otherwise(v)))


#: A heading (#) or a blank line; white space as the SQL's regular expressions have it.
HEADINGS = r"\n(?=#)|\n[ \t\n\f\r]*\n"


def heading_chunks(c: Column, most: int = 1200, least: int = 60, cuts: str = HEADINGS) -> Column:
    """Chunks that begin at a heading (#) or behind a blank line, without spaces of any kind (Zs) at the ends; those below `least` go, longer ones are cut at `most` characters."""
    parts = F.transform(F.split(c, cuts), lambda x: F.regexp_replace(x, r"\A\p{Zs}+|\p{Zs}+\z", ""))
    cut = F.transform(F.filter(parts, lambda x: F.length(x) >= least), lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.length(x) - 1) / most).cast("int")), lambda i: F.substring(x, i * most + 1, F.lit(most))))
    return F.flatten(cut)


def allowed_url(c: Column, deny: list[str], allow: list[str]) -> Column:
    """A denied part of the address wins; else any allowed part."""
    any_of = lambda parts: F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(c, p))
    return ~any_of(deny) & any_of(allow)


def pure(tokens: Column, own: list[str], other: list[str], most: int = 1) -> Column:
    """No word of the other group and at most `most` distinct words of the marked own group."""
    n = lambda words: F.size(F.array_intersect(tokens, F.array(*map(F.lit, words))))
    return (n(other) == 0) & (n(own) <= most)


def pattern_id(kind: Column, pattern: Column) -> Column:
    """Kind and the first ten digits of the SHA-1 of the pattern."""
    return F.concat(kind, F.lit("_"), F.substring(F.sha1(pattern), 1, 10))


# References are written BOOK CHAPTER:VERSE.
_REF = r"^([1-3]?[A-Z][A-Z0-9]{1,3}) ([0-9]+):([0-9]+)$"


def is_book_code(c: Column) -> Column:
    """Three or four capitals or digits with a letter among them."""
    return c.rlike("^[A-Z0-9]{3,4}$") & c.rlike("[A-Z]")


def is_reference(c: Column) -> Column:
    return c.rlike(_REF) & is_book_code(F.split(c, " ")[0])


def reference(book: Column, chapter: Column, verse: Column) -> Column:
    return F.concat(book, F.lit(" "), chapter.cast("string"), F.lit(":"), verse.cast("string"))


def parsed_reference(c: Column) -> Column:
    """(book, chapter, verse), null where it is no reference."""
    part = lambda k: F.regexp_extract(c, _REF, k)
    return F.when(is_reference(c), F.struct(part(1).alias("book"), part(2).cast("int").alias("chapter"), part(3).cast("int").alias("verse")))


def repaired_reference(c: Column, books: dict[str, str]) -> Column:
    """Dots become colons and old book codes new ones."""
    dotted = F.regexp_replace(F.trim(c), r"([0-9])\.([0-9])", "$1:$2")
    head, rest = F.split(dotted, " ", 2)[0], F.split(dotted, " ", 2)[1]
    table = F.create_map(*[F.lit(x) for kv in books.items() for x in kv])
    return F.concat(F.coalesce(F.try_element_at(table, head), head), F.lit(" "), rest)


def parsed_timestamp(c: Column) -> Column:
    """Z as +00:00, the first blank as T, no zone as UTC; null where it is no timestamp."""
    iso = F.regexp_replace(F.regexp_replace(F.trim(c), r"^(\S+) ", "$1T"), "Z$", "+00:00")
    return F.try_to_timestamp(F.when(iso.rlike(r"[+-][0-9]{2}:[0-9]{2}$"), iso).otherwise(F.concat(iso, F.lit("+00:00"))))


def restamped(c: Column) -> Column:
    """The canonical form of a timestamp; dates alone and other texts stay."""
    at = parsed_timestamp(c)
    return F.when(c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") | at.isNull(), c).otherwise(F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")))


def record_kind(keys: Column) -> Column:
    """Where a record belongs by its keys: dictionary, parallel, instruction, sentence or skip."""
    has = lambda *k: F.size(F.array_intersect(keys, F.array(*map(F.lit, k)))) == len(k)
    return F.when(has("word", "meaning"), "dictionary").when(has("source", "target"), "parallel").when(has("instruction", "output"), "instruction").when(has("text"), "sentence").otherwise("skip")


def error_score(errors: Column, warnings: Column) -> Column:
    """1 less .2 an error and .05 a warning, 0 at least."""
    return F.greatest(F.lit(0.0), 1 - 0.2 * errors - 0.05 * warnings)


def context(c: Column, scripture: list[str], historical: list[str]) -> Column:
    """scripture where a pattern of references is met, else historical where a pattern of old phrases is, else modern; without case, null is modern."""
    met = lambda patterns: F.coalesce(F.lower(c).rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False)) if patterns else F.lit(False)
    return F.when(met(scripture), "scripture").when(met(historical), "historical").otherwise("modern")


#: Marks of headings and list items at the beginning of lines.
LINE_MARKS = r"(?m)^#{1,6}\s+|^\s*[-*•]\s+"
#: Signs that a wrong reading of UTF-8 leaves.
MISREAD = "[â€™Ã\\x{80}-\\x{9f}]"


def bilingual(df: DataFrame, own: str, other: str, forbidden: str, labels: dict[str, list[str]] | None = None) -> DataFrame:
    """df with both sides of pairs cleaned; rows with an empty side, or a forbidden pattern in the own one, are left out.

    Own side: composed letters, no marks of headings and list items, no misread signs. Other side: no links, mail addresses and
    phone numbers, no marks; listed names become labels. White space is collapsed on both.
    """
    clean = T.collapse(F.regexp_replace(F.regexp_replace(nfc(F.col(own)), LINE_MARKS, ""), MISREAD, ""))
    there = T.without_contacts(F.regexp_replace(F.col(other), LINE_MARKS, ""))
    out = df.withColumns({own: clean, other: masked(there, labels) if labels else there})
    return out.where((F.col(own) != "") & (F.col(other) != "") & ~F.lower(own).rlike(forbidden))
