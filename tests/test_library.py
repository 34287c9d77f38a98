"""Operators on small tables with hand-made results, readers and writers, streams against batches."""

import datetime as dt
import json

from pyspark.sql import functions as F

from heddle.functions import linguistic as L
from heddle.functions import text as T
from heddle.functions.arrow import chrf, html_blocks, markdown_blocks, packed, sentence_bleu
from heddle.operators import consensus, corpus, datasets, dedup, evaluation, graph, rows, search, series
from heddle.sources import readers, writers
from heddle.streaming import live


def one(spark, column, *values):
    """Values of a column expression over a one-column table `c`."""
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "c string").select(column).collect()]


def test_text_functions(spark):
    assert one(spark, T.tokens(F.col("c")), "The 'quick' well-known --fox, Été!", None)[0] == ["the", "quick", "well-known", "fox", "été"]
    assert one(spark, T.is_blank(F.col("c")), None, "", "  ", "x") == [True, True, True, False]
    assert one(spark, T.duration_seconds(F.col("c")), "5m", "30s", "1d", "x") == [300, 30, 86400, None]
    assert one(spark, T.timestamp_kind(F.col("c")), "2024-01-01T00:00:00+00:00", "2024-01-01 00:00:00", "2024-01-01T00:00:00Z", "2024-01-01T00:00:00+02:00", "2024-01-01T00:00:00", "x") == ["canonical", "space", "zulu", "other-offset", "naive", "unknown"]
    assert one(spark, T.shared_prefix(F.col("c"), F.lit("house")), "hours", "mouse", "house", "") == [3, 0, 5, 0]
    assert one(spark, T.slug(F.col("c")), " A b!c ") == ["a_b_c"]
    assert one(spark, T.sentences(F.col("c")), "One. Two! Three") == [["One.", "Two!", "Three"]]
    assert one(spark, T.visible_text(F.col("c")), "<p>a &amp; b</p><script>x<y</script><!-- c --> d") == ["a & b d"]
    assert one(spark, T.without_contacts(F.col("c")), "see https://a.b/c or me@x.org, +49 170 1234567 ok") == ["see or , ok"]
    assert one(spark, T.ngrams(F.split("c", " "), 2), "a b c", "a") == [["a b", "b c"], []]


def test_rows(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", ""), (3, "b", None), (4, "b", "y")], "id int, k string, v string")
    assert sorted(r.id for r in rows.most_complete(df, ["k"], ["v"], [F.asc("id")]).collect()) == [1, 4]
    assert sorted(r.id for r in rows.collapse_identical(df, ["k"], ["v"], "id").collect()) == [1, 2, 3, 4]
    assert {r.column_name: r.blank for r in rows.null_counts(df, ["k", "v"]).collect()} == {"k": 0, "v": 2}
    new = spark.createDataFrame([(2, "a", "z"), (9, "c", "q")], "id int, k string, v string")
    kinds = {r.id: r.change for r in rows.changes(df, new, "id", ["k", "v"]).collect()}
    assert kinds == {1: "removed", 2: "changed", 3: "removed", 4: "removed", 9: "new"}
    up = rows.upsert(df.withColumn("version", F.lit(3)), new, ["id"])
    assert {r.id: r.version for r in up.collect()} == {1: 3, 2: 4, 3: 3, 4: 3, 9: 1}
    again = rows.upsert(up, new, ["id"])
    assert again.count() == up.count()
    assert rows.fingerprint(df, "t").first() == rows.fingerprint(df.repartition(3), "t").first()
    assert rows.orphans(df, "id", new, "id").count() == 3


def test_collocations_by_hand(spark):
    docs = spark.createDataFrame([(k, "s", ["a", "b", "x"]) for k in range(6)] + [(9, "s", ["x"] * 12)], "doc_id int, source string, tokens array<string>")
    pairs = {(r.a, r.b): r.n for r in corpus.pair_counts(docs).collect()}
    assert pairs == {("a", "b"): 6, ("b", "x"): 6, ("a", "x"): 6}
    pmi = {(r.word, r.partner): r.pmi for r in corpus.collocations(docs).collect()}
    assert pmi[("a", "b")] == 2.3219 and ("b", "a") in pmi  # log2(6 * 30 / 36)
    stats = {r.word: (r.frequency, r.doc_freq, r.diversity) for r in corpus.word_stats(docs).collect()}
    assert stats["x"] == (18, 7, 1.0) and stats["a"] == (6, 6, 0.8571)
    assert corpus.collocations(docs.repartition(5)).count() == len(pmi)


def test_dedup_and_datasets(spark):
    df = spark.createDataFrame([(1, "Hello  World"), (2, "hello world"), (3, "other"), (4, None)], "id int, text string")
    assert sorted(r.id for r in dedup.exact(df, "id", "text").collect()) == [1, 3, 4]
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a int, b int")
    ids = spark.createDataFrame([(k,) for k in range(1, 6)], "id int")
    assert sorted(r.id for r in dedup.keep_first(ids, "id", links).collect()) == [1, 3, 5]
    turns = spark.createDataFrame([(c, t) for c in range(40) for t in range(1 + c % 4)], "conv_id int, turn int")
    parts = datasets.group_split(turns, "conv_id")
    assert parts.count() == 40 and {r.split for r in parts.collect()} == {"train", "val", "test"}
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, datasets.group_split(turns.repartition(7), "conv_id").collect()))


def test_search_consensus_graph_evaluation(spark):
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "a", "c"]), (3, ["d"])], "doc_id int, tokens array<string>")
    hits = search.bm25(docs, spark.createDataFrame([(1, "a"), (1, "c")], "query_id int, term string")).collect()
    assert [r.doc_id for r in sorted(hits, key=lambda r: -r.score)] == [2, 1]
    ev = spark.createDataFrame([("k", "x", "T1", 0.9), ("k", "x", "T2", 0.8), ("k", "y", "T1", 0.4)], "key string, value string, tier string, confidence double")
    assert consensus.majority(ev, 0.6).first()["value"] == "x"
    w = consensus.weighted(ev, F.lit(1.0), 0.8).first()
    assert w.value == "x" and w.accepted and w.share == 0.8095
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    assert {r.node: r.depth for r in graph.reach(e, spark.createDataFrame([("a",)], "node string"), 3).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    seg = spark.createDataFrame([(1, ["ab", "c"], ["a", "bc"]), (2, ["x"], ["x"])], "id int, gold array<string>, pred array<string>")
    assert {r.id: (r.precision, r.recall, r.exact) for r in evaluation.boundary_scores(seg).collect()} == {1: (0.5, 0.5, False), 2: (1.0, 1.0, True)}
    assert sentence_bleu("a b c d", "a b c d") == 1.0 and sentence_bleu("", "a") == 0.0
    assert chrf("abcdef", "abcdef") == 1.0 and chrf("abc", "abc") == 0.5  # orders without n-grams count as 0


def test_series_and_streams(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    data = [(k, t + dt.timedelta(minutes=17 * k), k % 3, "error" if k % 4 == 0 else "view", float(k)) for k in range(300)]
    e = spark.createDataFrame(data, "event_id long, ts timestamp, user_id int, event_type string, value double")
    e.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = live.event_stream(spark, f"{tmp_path}/in", e.schema)
    got = live.drained(live.windowed(stream, "1 hour"), "w", f"{tmp_path}/c1").collect()
    batch = series.window_stats(e, "1 hour").drop("total").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch))
    twice = stream.union(live.event_stream(spark, f"{tmp_path}/in", e.schema))
    assert live.drained(live.deduplicated(twice, ["event_id"]), "d", f"{tmp_path}/c2", "append").count() == 300
    seen = []
    live.each_batch(stream, lambda df, k: seen.append(df.count()), f"{tmp_path}/c3")
    assert sum(seen) == 300
    runs = {(r.start.day, r.days) for r in series.streaks(e, "user_id").collect()}
    assert runs == {(1, 4)}
    fold = series.review_fold(e.withColumn("q", F.lit(5)), ["user_id"], ["ts"], "q").first()
    assert fold.repetition == 100 and fold.ease > 2.5


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "x", "source": "s"}\n\nnot json\n{"text": "y", "more": 1}\n')
    p = f"{tmp_path}/a.jsonl"
    assert readers.jsonl_records(spark, p).count() == 2 and "more" in readers.jsonl(spark, p).columns and readers.line_count(spark, p) == 4
    assert [r.broken for r in readers.jsonl_with_errors(spark, p, "text string, source string").collect()] == [False, True, False]
    (tmp_path / "d.tsv").write_text('word\tgloss\n"Ka"\tone\nka  ONE\nkb\ttwo\n')
    assert sorted(map(tuple, readers.tsv_pairs(spark, f"{tmp_path}/d.tsv").collect())) == [("Ka", "one"), ("kb", "two")]
    (tmp_path / "b.json").write_text(json.dumps({"GEN": {"1": {"1": "t1", "2": "t2"}}}))
    assert readers.nested_json_rows(spark, f"{tmp_path}/b.json").count() == 2
    (tmp_path / "v.xml").write_text("<r><v id='1'>one</v><v id='2'>two</v></r>")
    assert sorted(r.text for r in readers.xml_rows(spark, f"{tmp_path}/v.xml", "v", F.col("_id"), F.col("_VALUE")).collect()) == ["one", "two"]
    (tmp_path / "l.log").write_text("2024-01-01 10:00:00 ERROR x\nplain\n")
    assert [(str(r.ts), r.level) for r in readers.log_lines(spark, f"{tmp_path}/l.log").collect()] == [("2024-01-01 10:00:00", "error"), ("None", "info")]
    df = spark.createDataFrame([(1, 'a "q"', None), (2, "é", "z")], "id int, text string, extra string")
    assert writers.verified_round_trip(df, f"{tmp_path}/j")
    writers.write_csv(df, f"{tmp_path}/c")
    assert spark.read.option("header", "true").option("escape", '"').csv(f"{tmp_path}/c").where("id = 1").first().text == 'a "q"'
    m = writers.artifact({"t": df}, f"{tmp_path}/art", "v1", spark).first()
    assert (m.version, m.table_name, m.n) == ("v1", "t", 2)


def test_plain_functions():
    assert html_blocks("<nav>x</nav><p>a <b>b</b></p><li>c</li><script>z</script>") == ["a b", "c"]
    assert markdown_blocks("# T one two\n\n```\ncode\n```\n\n- see [the link](u) now\n\nshort") == ["T one two", "see the link now"]
    assert packed(["aaa", "bbb", "c" * 25], 10) and all(len(x) <= 10 for x in packed(["aaa", "bbb", "c" * 25], 10))
    s = L.Syllables(frozenset(["", "k", "l"]), frozenset("aiu"), frozenset(["", "n"]), {"kalu": ("ka", "lu")})
    assert s.split("kanli") == ["kan", "li"] and s.split("kalu") == ["ka", "lu"]
    m = L.Morphology(frozenset(["work", "play"]), ("re",), ("ed", "er"), frozenset(["the"]))
    assert m.analyse("reworked") == {"kind": "word", "prefix": "re", "root": "work", "suffix": "ed"}
    assert m.compound("workplay") == ["work", "play"] and m.compound("work") is None and m.analyse("playplay")["kind"] == "reduplication"
    assert L.folded_tones(["1", "2", "3"], {("1", "2"): ("1", "1"), ("1", "3"): ("1", "9")}) == ["1", "1", "9"]
    assert L.rewritten("Colour COLOUR colour", {"colour": "color"}) == "Color COLOR color"
    assert [x["label"] for x in L.entities("New York and York", {"New York": "P", "York": "Q"})] == ["P", "Q"]
    assert L.tagged(["the", "Dog", "running"], {"the": "DET"}, {}, {"ing": "VERB"})[0] == ("DET", 0.95)
    assert L.summarised("A b. C key. D.", ["key"], 2) == "A b. C key." and L.without_tones("áb") == "ab"


def test_every_query_has_columns_alike(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert len(names) > 80 and set(entry.oracle_sql()) <= set(names)
    assert entry.entry(spark).columns == ["word", "partner", "n", "pmi"]
