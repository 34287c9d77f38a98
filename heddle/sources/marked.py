"""Marked-up texts in document order: XML files as a stream of tags with the text behind each, and verses with the state that holds at their place.

Files are split at "<", so that a large file is read by many tasks. What stands before a place (book, chapter, an open comment) is
carried within a block of a file by a window and from block to block by a table of one row a block. Comments are left out. CDATA
sections are not read, and the text of a file outside UTF-8 is not converted. A file that is not well formed gives the verses it marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heddle.functions import text as T
from heddle.operators.rows import first_per_key

_BODY = r"""^((?:[^>"']|"[^"]*"|'[^']*')*)>"""


def attribute(body: Column, name: str) -> Column:
    """An attribute of a tag, without its quotes; null where it has none."""
    found = F.regexp_extract(body, rf"""\s{name}\s*=\s*("[^"]*"|'[^']*')""", 1)
    return F.when(found != "", entities(F.regexp_replace(found, r"""^["']|["']$""", "")))


def entities(c: Column) -> Column:
    """The text with the five named entities and numbered ones read, each once; others stay."""
    named = F.create_map(*[F.lit(x) for kv in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")) for x in kv])

    def one(x: Column) -> Column:
        digits = F.regexp_extract(x, r"^&#([0-9]{1,7});$", 1)
        hexes = F.regexp_extract(x, r"^&#[xX]([0-9A-Fa-f]{1,6});$", 1)
        code = F.when(digits != "", digits.cast("int")).when(hexes != "", F.conv(hexes, 16, 10).cast("int"))
        fits = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code <= 0x10FFFF))
        sign = F.decode(F.unhex(F.lpad(F.hex(F.when(fits, code).otherwise(F.lit(0xFFFD))), 8, "0")), "UTF-32")
        return F.coalesce(F.try_element_at(named, x), F.when(code.isNotNull(), sign), x)

    parts = F.regexp_extract_all(c, F.lit(r"&#?[A-Za-z0-9]+;|[^&]+|&"), F.lit(0))
    return F.when(c.contains("&"), F.array_join(F.transform(parts, one), "")).otherwise(c)


def carried(df: DataFrame, states: dict[str, Column], ahead: bool = False, itself: bool = False) -> DataFrame:
    """df (file, block, at, ...) with, by name, the last value that is not null before each row in its file, or the next one after it (`ahead`); `itself`: or that of the row."""
    # frames that end at the row are summed up as they grow; "ahead" reads the rows backwards
    way = F.desc if ahead else F.asc
    before = lambda key, at, near: Window.partitionBy(*key).orderBy(way(at)).rowsBetween(Window.unboundedPreceding, near)
    df = df.withColumns({f"__{n}": c for n, c in states.items()})
    pick_by = F.min_by if ahead else F.max_by
    ends = df.groupBy("file", "block").agg(*[pick_by(f"__{n}", F.when(F.col(f"__{n}").isNotNull(), F.col("at"))).alias(f"__of_{n}") for n in states])
    ends = ends.select("file", "block", *[F.last(f"__of_{n}", True).over(before(["file"], "block", -1)).alias(f"__far_{n}") for n in states])
    inside = before(["file", "block"], "at", 0 if itself else -1)
    near = df.withColumns({f"__near_{n}": F.last(f"__{n}", True).over(inside) for n in states}).join(ends, ["file", "block"])
    return near.withColumns({n: F.coalesce(f"__near_{n}", f"__far_{n}") for n in states}).drop(*[f"{p}{n}" for n in states for p in ("__", "__near_", "__far_")])


def tags(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(file, block, at, name, closing, empty, body, tail): every tag in document order (file, block, at); names without prefixes, tail is the text up to the next tag."""
    read = spark.read.option("lineSep", "<").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path)
    # names of the file are taken where the rows are read
    v = read.select(F.input_file_name().alias("file"), F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    c = F.col("value")
    v = carried(v, {"within": F.when(c.startswith("!--") & ~c.contains("-->"), True).when(c.contains("-->"), False)})
    body = F.regexp_extract("value", _BODY, 1)
    v = v.where(~F.coalesce("within", F.lit(False)) & ~c.startswith("!") & ~c.startswith("?") & c.rlike(_BODY)).select("file", "block", "at", body.alias("body"), F.substring(c, F.length(body) + 2, F.length(c)).alias("tail"))
    name = F.regexp_extract("body", r"^/?\s*(?:[\w.-]+:)?([\w.-]+)", 1)
    return v.select("file", "block", "at", name.alias("name"), F.col("body").startswith("/").alias("closing"), F.col("body").endswith("/").alias("empty"), "body", entities(F.col("tail")).alias("tail"))


def _opens(name: str) -> Column:
    return (F.col("name") == name) & ~F.col("closing")


def _whole(c: Column) -> Column:
    return F.when(c.rlike("^[0-9]{1,9}$"), c.cast("int")).otherwise(0)


def _last(df: DataFrame) -> DataFrame:
    """One row a reference, the last one in the order of files and places; rows without a text are left out."""
    kept = df.withColumn("text", T.collapse(F.col("text"))).where(F.col("text") != "")
    return first_per_key(kept, ["book", "chapter", "verse"], [F.desc("file"), F.desc("block"), F.desc("at")]).select("book", "chapter", "verse", "text")


def milestone_verses(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(book, chapter, verse, text) where empty tags mark where books (code), chapters and verses (number) begin.

    A verse's text is what stands right behind its tag, or, if that is blank, behind its closing tag. Numbers that are none are 0.
    """
    t = tags(spark, path, pattern).where(F.col("name").isin("book", "chapter", "verse"))
    number = F.coalesce(attribute(F.col("body"), "number"), F.lit("0"))
    t = carried(t, {"book": F.when(_opens("book"), F.coalesce(attribute(F.col("body"), "code"), F.lit(""))), "chapter": F.when(_opens("chapter"), _whole(number))})
    t = carried(t, {"behind": F.when((F.col("name") == "verse") & F.col("closing"), F.col("tail"))}, ahead=True)
    v = t.where(_opens("verse")).withColumn("text", F.when(T.is_blank(F.col("tail")) & ~F.col("empty"), F.col("behind")).otherwise(F.col("tail")))
    return _last(v.select("file", "block", "at", F.coalesce("book", F.lit("")).alias("book"), F.coalesce("chapter", F.lit(0)).alias("chapter"), _whole(number).alias("verse"), "text"))


def nested_verses(spark: SparkSession, path: str, codes: dict[str, str] | None = None, pattern: str = "*") -> DataFrame:
    """(book, chapter, verse, text) where verses stand in chapters and these in books (name); all text inside a verse counts, other tags in it do not.

    A book that `codes` does not name is known by the first three letters of its name, in capitals.
    """
    t = tags(spark, path, pattern)
    number = F.coalesce(attribute(F.col("body"), "number"), F.lit("0"))
    mark = F.struct("block", "at", _whole(number).alias("verse"))
    closed = F.struct(F.lit(-1).cast("long").alias("block"), F.lit(-1).cast("long").alias("at"), F.lit(0).alias("verse"))
    t = carried(t, {"book": F.when(_opens("book"), F.coalesce(attribute(F.col("body"), "name"), F.lit(""))), "chapter": F.when(_opens("chapter"), _whole(number)),
                    "open": F.when(_opens("verse") & ~F.col("empty"), mark).when(F.col("name").isin("verse", "chapter", "book"), closed)}, itself=True)
    g = t.where("open.at >= 0").groupBy("file", "book", "chapter", "open").agg(F.array_sort(F.collect_list(F.struct("block", "at", "tail"))).alias("parts"))
    known = F.coalesce(*([F.try_element_at(F.create_map(*[F.lit(x) for kv in codes.items() for x in kv]), F.col("book"))] if codes else []), F.upper(F.substring("book", 1, 3)))
    return _last(g.select("file", "open.block", "open.at", known.alias("book"), F.coalesce("chapter", F.lit(0)).alias("chapter"), "open.verse", F.array_join("parts.tail", "").alias("text")))


def segment_verses(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(book, chapter, verse, text) of segments whose id names set, book, chapter and verse with dots between; the text before any inner tag."""
    ids = F.split(F.coalesce(attribute(F.col("body"), "id"), F.lit("")), r"\.")
    s = tags(spark, path, pattern).where(_opens("seg") & ~F.col("empty")).where(F.size(ids) >= 4)
    return _last(s.select("file", "block", "at", ids[1].alias("book"), _whole(ids[2]).alias("chapter"), _whole(ids[3]).alias("verse"), F.col("tail").alias("text")))
