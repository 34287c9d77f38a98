"""Queries of the readers and writers: fixture tables written in each format, read again, and compared with themselves."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from heddle.plans.folders import checkpoints
from heddle.plans.registry import query
from heddle.sources import marked as M
from heddle.sources import readers as R
from heddle.sources import writers as W
from heddle.tables import load


def place(spark, name):
    """A fresh path in the shared folder."""
    return f"{checkpoints(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def docs(spark, sf, *columns):
    return load(spark, sf, "documents").select(*columns)


@query("SELECT text, source, lang, n_chars::DOUBLE AS quality FROM documents WHERE doc_id % 10 <> 0")
def jsonl_typed_scan(spark, sf):
    """Every tenth line is broken, some are blank: both are dropped."""
    at = place(spark, "typed")
    line = F.to_json(F.struct("text", "source", "lang", F.col("n_chars").alias("quality")))
    d = load(spark, sf, "documents")
    d.select(F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit('{"text": '), F.col("source"))).otherwise(line)).write.text(at)
    return R.jsonl_records(spark, at, "text string, source string, lang string, quality double").where("text is not null or source is not null")


@query("SELECT doc_id, text, lang FROM documents")
def jsonl_dict_scan(spark, sf):
    at = place(spark, "dicts")
    W.write_jsonl(docs(spark, sf, "doc_id", "text", "lang"), at)
    return R.jsonl(spark, at).select("doc_id", "text", "lang")


@query("SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS line_number, doc_id % 7 = 0 AS broken FROM documents")
def jsonl_error_report(spark, sf):
    """Broken lines with the number of each line in its file: one file a source."""
    at = place(spark, "errors")
    d = load(spark, sf, "documents")
    line = F.when(F.col("doc_id") % 7 == 0, F.lit("[broken")).otherwise(F.to_json(F.struct("doc_id", "lang")))
    d.repartition("source").sortWithinPartitions("source", "doc_id").select("source", line.alias("value")).write.partitionBy("source").text(at)
    found = R.jsonl_with_errors(spark, at, "doc_id long, lang string")
    return found.select(F.regexp_extract("file", "source=([^/]+)/", 1).alias("source"), "line_number", "broken")


@query("SELECT sum(len(string_split(text, chr(10))))::BIGINT AS lines FROM documents")
def line_count(spark, sf):
    at = place(spark, "lines")
    docs(spark, sf, F.explode(F.split("text", "\n")).alias("line")).write.text(at)
    return spark.createDataFrame([(R.line_count(spark, at),)], "lines long")


@query("SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1")
def directory_scan(spark, sf):
    """All JSON line files below a folder of folders."""
    at = place(spark, "folders")
    load(spark, sf, "documents").select("source", "n_chars").withColumn("folder", F.col("source")).write.partitionBy("folder").json(at)
    return R.jsonl(spark, at, "*.json", recursive=True).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT DISTINCT p_name AS a, p_type AS b FROM part WHERE lower(p_name) NOT IN ('word', 'headword', 'source')")
def tsv_dictionary(spark, sf):
    at = place(spark, "tsv")
    p = load(spark, sf, "part")
    p.select(F.concat("p_name", F.lit("\t"), "p_type").alias("value")).unionByName(spark.createDataFrame([("word\tmeaning",), ("alone",)], "value string")).write.text(at)
    return R.tsv_pairs(spark, at)


@query("SELECT 'P' || p_partkey AS ref, p_name AS text FROM part")
def xml_verses(spark, sf):
    at = place(spark, "xml")
    load(spark, sf, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("_ref"), F.col("p_name").alias("_VALUE")).write.format("xml").option("rowTag", "verse").option("rootTag", "book").save(at)
    return R.xml_rows(spark, at, "verse", F.col("_ref"), F.col("_VALUE"))


_VERSES = "SELECT 'B' || strftime(o_orderdate, '%Y%m') AS book, l_orderkey::INTEGER AS chapter, l_linenumber::INTEGER AS verse, max(l_returnflag || ' & ' || l_shipdate::DATE) AS text FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2, 3"


def _verses(spark, sf):
    o = load(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("B"), F.date_format("o_orderdate", "yyyyMM")).alias("book"))
    text = F.concat("l_returnflag", F.lit(" & "), F.to_date("l_shipdate").cast("string"))
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.alias("text")).join(o, "l_orderkey").groupBy("book", F.col("l_orderkey").cast("int").alias("chapter"), F.col("l_linenumber").cast("int").alias("verse")).agg(F.max("text").alias("text"))


def _marked(spark, sf, at: str, verse, chapter, book) -> None:
    """Lines of a marked text in order: each book's first line, each chapter's, then its verses, as three expressions over (book, chapter, verse, text) say."""
    v = _verses(spark, sf).withColumn("text", F.replace("text", F.lit("&"), F.lit("&amp;")))
    none = F.lit(-1).alias
    heads = v.select("book").distinct().select("book", none("chapter"), none("verse"), book.alias("value"))
    starts = v.select("book", "chapter").distinct().select("book", "chapter", none("verse"), chapter.alias("value"))
    lines = v.select("book", "chapter", "verse", verse.alias("value")).unionByName(heads).unionByName(starts)
    lines.repartition("book").sortWithinPartitions("book", "chapter", "verse").select("value").write.text(at)


@query(_VERSES)
def xml_milestones(spark, sf):
    """Verses behind empty tags; book and chapter are what the last such tag said, wherever the file is split."""
    at = place(spark, "usx")
    _marked(spark, sf, at, F.format_string('<verse number="%d" style="v"/>%s', "verse", "text"), F.format_string('<!-- <verse number="9"/> of no chapter --><chapter number="%d"/>', "chapter"), F.format_string('<book code="%s"/>', "book"))
    return M.milestone_verses(spark, at)


@query(_VERSES.replace("'B' || strftime(o_orderdate, '%Y%m')", "strftime(o_orderdate, '%Y')[2:]").replace("GROUP BY 1, 2, 3", "GROUP BY ALL"))
def xml_nested(spark, sf):
    """Verses as elements with other tags in them; a book is known by the first three signs of its name, here the end of the year."""
    at = place(spark, "nested-xml")
    first, rest = F.split("text", " ")[0], F.expr("substring(text, instr(text, ' '))")
    _marked(spark, sf, at, F.format_string('<verse number="%d">%s<note/><i>%s</i></verse> margin', "verse", first, rest), F.format_string('</chapter><chapter number="%d">', "chapter"), F.format_string("</book><book name='%sb of %s'>", F.substring("book", 3, 3), "book"))
    return M.nested_verses(spark, at)


@query(_VERSES)
def xml_segments(spark, sf):
    at = place(spark, "ces")
    _marked(spark, sf, at, F.format_string('<seg id="b.%s.%d.%d" type="verse">%s</seg>', "book", "chapter", "verse", "text"), F.lit("</div><div type='chapter'>"), F.lit("</div></div><div type='book'><div>"))
    return M.segment_verses(spark, at)


@query("SELECT l_returnflag AS book, l_orderkey::VARCHAR AS chapter, l_linenumber::VARCHAR AS verse, max(l_shipdate)::DATE::VARCHAR AS text FROM lineitem WHERE l_orderkey % 50 = 0 GROUP BY 1, 2, 3".replace(" WHERE l_orderkey % 50 = 0", ""))
def nested_json_verses(spark, sf):
    """Book, chapter, verse and text as nested objects, one file a book and chapter range."""
    at = place(spark, "nested")
    v = load(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("book"), F.col("l_orderkey").cast("string").alias("chapter"), F.col("l_linenumber").cast("string").alias("verse")).agg(F.to_date(F.max("l_shipdate")).cast("string").alias("text"))
    c = v.groupBy("book", "chapter").agg(F.map_from_entries(F.collect_list(F.struct("verse", "text"))).alias("verses"))
    b = c.groupBy("book", F.expr("pmod(xxhash64(chapter), 64)").alias("part")).agg(F.map_from_entries(F.collect_list(F.struct("chapter", "verses"))).alias("chapters"))
    b.select(F.to_json(F.create_map("book", "chapters")).alias("value"), F.concat("book", F.col("part").cast("string")).alias("file")).repartition("file").write.partitionBy("file").text(at)
    return R.nested_json_rows(spark, at)


@query("SELECT o_orderkey, o_orderstatus, o_custkey FROM orders")
def csv_round_trip(spark, sf):
    at = place(spark, "csv")
    load(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_custkey").write.option("header", True).csv(at)
    return spark.read.option("header", True).schema("o_orderkey long, o_orderstatus string, o_custkey long").csv(at)


_TABLES = "('region', 'nation', 'orders', 'benchmark')"


@query(f"SELECT table_name, column_name, ordinal_position - 1 AS at FROM information_schema.columns WHERE table_name IN {_TABLES}")
def catalog_columns(spark, sf):
    """Columns of each table, in their order, from the schemas alone."""
    rows = [(t, f.name, k) for t in ("region", "nation", "orders", "benchmark") for k, f in enumerate(load(spark, sf, t).schema)]
    return spark.createDataFrame(rows, "table_name string, column_name string, at int")


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, true AS there, count(*) AS n FROM {t}" for t in ("region", "orders", "benchmark")) + " UNION ALL SELECT 'psalms', false, 0)")
def source_availability(spark, sf):
    """Which of the wanted tables are there, and their rows."""
    return R.availability(spark, sf, ["region", "orders", "benchmark", "psalms"])


@query("SELECT l_orderkey, count(*) AS n, string_agg(l_linenumber || l_returnflag, ' ' ORDER BY l_linenumber, l_returnflag) AS verses FROM lineitem GROUP BY 1")
def grouped_lines(spark, sf):
    g = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("l"))
    return g.select("l_orderkey", F.size("l").cast("long").alias("n"), F.array_join(F.transform("l", lambda x: F.concat(x.l_linenumber.cast("string"), x.l_returnflag)), " ").alias("verses"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey > 100 ORDER BY c_custkey LIMIT 50")
def keyset_page(spark, sf):
    """One page behind a key: the scan starts there."""
    return load(spark, sf, "customer").where("c_custkey > 100").orderBy("c_custkey").limit(50).select("c_custkey", "c_name")


@query("""SELECT '{"metric":"' || event_type || '","n":' || count(*) || '}' AS line FROM events GROUP BY event_type""")
def metrics_json(spark, sf):
    at = place(spark, "metrics")
    m = load(spark, sf, "events").groupBy(F.col("event_type").alias("metric")).agg(F.count(F.lit(1)).alias("n"))
    W.write_jsonl(m, at)
    return spark.read.text(at).select(F.col("value").alias("line"))


@query("SELECT event_type || ',' || count(*) AS line FROM events GROUP BY event_type")
def metrics_csv(spark, sf):
    at = place(spark, "metrics")
    load(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).write.csv(at)
    return spark.read.text(at).select(F.col("value").alias("line"))


@query("""SELECT lang, count(*) AS n, sum(doc_id)::BIGINT AS ids, sum(('0x' || substr(md5(doc_id || ':' || coalesce(text, '')), 1, 8))::BIGINT)::BIGINT AS content FROM documents GROUP BY 1""")
def parquet_dataset_export(spark, sf):
    """A dataset in folders by language, with sums that tell what each holds, whatever the order."""
    at = place(spark, "dataset")
    load(spark, sf, "documents").select("doc_id", "lang", "text").write.partitionBy("lang").parquet(at)
    digest = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")))), 1, 8), 16, 10).cast("long")
    return spark.read.parquet(at).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"), F.sum(digest).alias("content"))


@query("SELECT instruction, input, output FROM (SELECT 'Continue' AS instruction, left(text, 150) AS input, text AS output FROM documents)")
def instruction_export(spark, sf):
    at = place(spark, "instruct")
    W.write_jsonl(W.instruction_record(load(spark, sf, "documents"), "Continue"), at)
    return R.jsonl(spark, at).select("instruction", "input", "output")
