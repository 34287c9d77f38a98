"""Small operators over tables of texts: conditional columns, distributions, rules and exceptions, bands, tags, word forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The universal part-of-speech tags.
UNIVERSAL = "ADJ ADP ADV AUX CCONJ DET INTJ NOUN NUM PART PRON PROPN PUNCT SCONJ SYM VERB X".split()


def conditional_columns(df: DataFrame, key: str, columns: list[tuple[str, str, str | None]]) -> DataFrame:
    """(key, column_name, kind, value): a row for each (column, kind, condition) whose condition holds, in one pass."""
    cells = [F.when(F.expr(only) if only else F.lit(True), F.struct(F.lit(c).alias("column_name"), F.lit(kind).alias("kind"), F.col(c).cast("string").alias("value"))) for c, kind, only in columns]
    return df.select(key, F.explode(F.filter(F.array(*cells), lambda x: x.isNotNull())).alias("x")).select(key, "x.*")


def field_distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value, n): how often each value of each column occurs, in one pass."""
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(cells).alias("x")).groupBy("x.field", "x.value").agg(F.count(F.lit(1)).alias("n"))


def rule_hits(df: DataFrame, text: str, rules: dict[str, str]) -> DataFrame:
    """(rule, docs, hits): rows and places that each pattern matches, in one pass."""
    n = {name: F.size(F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0))) for name, p in rules.items()}
    one = df.agg(*[F.struct(F.lit(name).alias("rule"), F.count_if(c > 0).alias("docs"), F.coalesce(F.sum(c), F.lit(0)).alias("hits")).alias(f"r{k}") for k, (name, c) in enumerate(n.items())])
    return one.select(F.explode(F.array(*[F.col(f"r{k}") for k in range(len(n))])).alias("x")).select("x.*")


def without_exceptions(findings: DataFrame, exceptions: list[str]) -> DataFrame:
    """Findings that no exception (a condition) covers."""
    for e in exceptions:
        findings = findings.where(~F.expr(e))
    return findings


def band(value: Column, green: float, amber: float, larger_is_better: bool = True) -> Column:
    """green, amber or red by two limits, in either direction."""
    reaches = (lambda x: value >= x) if larger_is_better else (lambda x: value <= x)
    return F.when(reaches(green), "green").when(reaches(amber), "amber").otherwise("red")


def threshold_status(value: Column, direction: Column, green: Column, amber: Column) -> Column:
    """green, amber or red of a measured value: "lower" (also where no direction is given): the smaller the better, "higher": the larger.

    "info" is only reported; a null value is absent; without an amber limit nothing is red; without a green one nothing is green.
    """
    higher = F.coalesce(F.nullif(direction, F.lit("")), F.lit("lower")) == "higher"
    reaches = lambda limit: F.coalesce(F.when(higher, value >= limit).otherwise(value <= limit), F.lit(False))
    return F.when(direction == "info", "info").when(value.isNull(), "absent").when(reaches(green), "green").when(amber.isNull() | reaches(amber), "amber").otherwise("red")


def normal_tag(raw: Column, table: dict[str, str]) -> Column:
    """A tag as written in a dictionary: split at separators, looked up without case. An unknown part makes it `unknown`; one tag stands; several are `candidates`."""
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    parts = F.filter(F.transform(F.split(F.lower(raw), r"[/,;.\s]+"), F.trim), lambda x: x != "")
    tags = F.array_distinct(F.transform(parts, lambda x: F.coalesce(F.try_element_at(known, x), F.lit("?"))))
    return F.when((F.size(tags) == 0) | F.array_contains(tags, "?"), "unknown").when(F.size(tags) == 1, F.try_element_at(tags, F.lit(1))).otherwise("candidates")


def bridged_tag(tag: Column, table: dict[str, str]) -> Column:
    """A universal tag: the tag itself, its entry in the table, else X."""
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.when(F.upper(tag).isin(*UNIVERSAL), F.upper(tag)).otherwise(F.coalesce(F.try_element_at(known, F.lower(tag)), F.lit("X")))


def generated_forms(df: DataFrame, root: str, prefixes: list[str], suffixes: list[str]) -> DataFrame:
    """df with `form`: a row for each prefix, root and suffix put together."""
    made = F.array(*[F.concat(F.lit(p), F.col(root), F.lit(s)) for p in prefixes for s in suffixes])
    return df.withColumn("form", F.explode(made))
