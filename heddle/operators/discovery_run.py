"""Discovery as one run: one scan of the texts counts what five capabilities need; their hypotheses meet a stored table by id.

The counts, one row a word, pair, sentence pattern or marker, are written once and read by each capability. A capability that
fails is named in the summary and does not stop the others. The stored table changes by one commit, and only if a hypothesis is
new or has other numbers, so that a second run over the same texts changes nothing. Stored hypotheses that a run does not find stay.

Edge cases: null and empty texts give no counts; an empty table gives no hypotheses and no commit; equal rows are counted each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.operators import discovery as V
from heddle.operators import hierarchy as H
from heddle.operators import word_tallies as W
from heddle.operators.rows import first_per_key
from heddle.sources.versions import Versions

CAPABILITIES = ("pos", "morphology", "collocation", "sentence_patterns", "grammar")
COLUMNS = ("id", "kind", "subject", "predicate", "object", "n", "confidence")


@dataclass(frozen=True)
class Rules:
    """What the capabilities look for; small lists."""

    closed: dict[str, str]
    suffixes: dict[str, str]
    dictionary: tuple[tuple[str, str], ...] = ()
    affixes: tuple[tuple[str, ...], tuple[str, ...]] = ((), ())
    markers: dict[str, list[str]] = field(default_factory=dict)
    clauses: H.Markers = H.Markers()
    least_pair: int = 5
    least_pmi: float = 1.0
    least_marker: int = 3
    patterns: int = 50


_COUNTS = "kind string, a string, b string, n long"


def _tallied(markers: list[tuple[str, str]]):
    """Rows (kind, a, b, n) of sentences (tokens, clause, pattern), added up in the task and sent once they are many."""
    schema = pa.schema([("kind", pa.string()), ("a", pa.string()), ("b", pa.string()), ("n", pa.int64())])

    def rows(kind: str, a: pa.Array, b: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(n), pa.string()), a, b, pa.array(n, pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def clear() -> tuple:
            return {}, [np.zeros(0, np.int64)] * 2, [np.zeros(0, np.int64)] * 2, [], [], 0

        codes, words, pairs, seen, near, held = clear()
        patterns, marked = Counter(), Counter()

        def fold() -> None:
            for into, raw in ((words, seen), (pairs, near)):
                new = np.concatenate([np.zeros(0, np.int64), *raw])
                into[:] = W.summed(np.r_[into[0], new], np.r_[into[1], np.ones(len(new), np.int64)])
                raw.clear()

        def sent() -> Iterator[pa.RecordBatch]:
            fold()
            names = pa.array(list(codes), pa.string())
            for s in range(0, len(words[0]), W.ROWS):
                at, n = (x[s : s + W.ROWS] for x in words)
                yield rows("word", names.take(pa.array(at)), pa.array([""] * len(n), pa.string()), n)
            for s in range(0, len(pairs[0]), W.ROWS):
                at, n = (x[s : s + W.ROWS] for x in pairs)
                yield rows("pair", names.take(pa.array(at >> 32)), names.take(pa.array(at & W.LOW)), n)

        for b in batches:
            if not b.num_rows:
                continue
            said = b.column(0).flatten().dictionary_encode()
            code = np.array([codes.setdefault(w, len(codes)) for w in said.dictionary.to_pylist()], np.int64)[said.indices.to_numpy()]
            row = np.repeat(np.arange(b.num_rows), np.diff(b.column(0).offsets.to_numpy()))
            seen.append(code)
            same = row[1:] == row[:-1]
            near.append(code[:-1][same] << 32 | code[1:][same])
            for kind, marker in markers:
                if marker in codes:
                    marked[kind, marker] += len(np.unique(row[code == codes[marker]]))
            for r in pa.table({"c": b.column(1), "p": b.column(2)}).group_by(["c", "p"]).aggregate([([], "count_all")]).to_pylist():
                patterns[r["c"], r["p"]] += r["count_all"]
            held += len(code)
            if held > W.RAW_PAIRS:
                fold()
                held = 0
                if len(codes) > W.WORDS or len(pairs[0]) > W.PAIRS:
                    yield from sent()
                    codes, words, pairs, seen, near, held = clear()
        yield from sent()
        for kind, found in (("pattern", patterns), ("marker", Counter({k: n for k, n in marked.items() if n}))):
            if found:
                yield rows(kind, pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), np.array(list(found.values()), np.int64))

    return run


def counts(docs: DataFrame, rules: Rules) -> DataFrame:
    """(kind, a, b, n) of (doc_id, text): words, neighbours within a sentence, patterns of sentences by clause, and markers (sentences that hold them)."""
    t = F.col("tokens")
    s = H.sentences(docs).withColumn("clause", H.clause(F.col("s"), t, rules.clauses))
    size = F.when(F.size(t) < 5, "short").when(F.size(t) < 12, "middle").otherwise("long")
    prefixed = F.when(F.exists(t, lambda x: x.startswith("un") | x.startswith("re")), "prefixed").otherwise("plain")
    pattern = F.concat_ws("/", H.structure(F.col("clause"), F.size(t)), size, prefixed)
    known = [(k, m) for k, ms in rules.markers.items() for m in dict.fromkeys(ms)]
    # each task adds up its sentences: a row a token and a row a pair are never made
    rows = s.select("tokens", "clause", pattern.alias("pattern")).mapInArrow(_tallied(known), _COUNTS)
    return rows.groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))


def _words(c: DataFrame) -> DataFrame:
    return c.where("kind = 'word'").select(F.col("a").alias("word"), "n")


def _rows(df: DataFrame, kind: str, subject: Column, predicate: Column, object_: Column, n: Column, confidence: Column) -> DataFrame:
    key = F.sha1(F.concat_ws("|", F.lit(kind), subject, predicate, F.coalesce(object_, F.lit(""))).cast("binary"))
    return df.select(key.alias("id"), F.lit(kind).alias("kind"), subject.alias("subject"), predicate.alias("predicate"), object_.cast("string").alias("object"), n.cast("long").alias("n"), F.round(confidence, 4).cast("double").alias("confidence"))


def pos(c: DataFrame, rules: Rules) -> DataFrame:
    spark = c.sparkSession
    h = V.pos_hypotheses(V.rule_tags(_words(c), rules.closed, rules.suffixes), spark.createDataFrame(list(rules.dictionary), "word string, tag string"))
    return _rows(h, "pos", F.concat(F.lit("word:"), "word"), F.concat(F.lit("pos:"), "tag"), F.lit(None), F.col("votes"), F.col("confidence"))


def morphology(c: DataFrame, rules: Rules) -> DataFrame:
    h = V.morphology(_words(c), *map(list, rules.affixes)).join(_words(c), "word")
    return _rows(h, "morph_relation", F.concat(F.lit("word:"), "word"), F.concat(F.lit("morph:"), "relation", F.lit(":"), "part"), F.concat(F.lit("root:"), "root"), F.col("n"), F.least(F.lit(1.0), F.col("n") / 10))


def collocation(c: DataFrame, rules: Rules) -> DataFrame:
    words = _words(c)
    z = words.agg(F.sum("n").alias("z"))
    side = lambda name: words.select(F.col("word").alias(name), F.col("n").alias(f"n_{name}"))
    p = c.where("kind = 'pair'").select(F.col("a").alias("first"), F.col("b").alias("second"), "n").join(side("first"), "first").join(side("second"), "second").join(F.broadcast(z))  # one row
    pmi = F.log2(F.col("n") * F.col("z") / (F.col("n_first") * F.col("n_second")))
    g = p.groupBy(F.least("first", "second").alias("a"), F.greatest("first", "second").alias("b")).agg(F.sum("n").alias("n"), F.max(pmi).alias("pmi")).where((F.col("n") >= rules.least_pair) & (F.round("pmi", 4) >= rules.least_pmi))
    return _rows(g, "collocation", F.concat(F.lit("word:"), "a"), F.lit("collocates"), F.concat(F.lit("word:"), "b"), F.col("n"), F.least(F.lit(1.0), F.col("pmi") / 10))


def sentence_patterns(c: DataFrame, rules: Rules) -> DataFrame:
    p = c.where("kind = 'pattern'").select(F.col("a").alias("clause"), F.col("b").alias("pattern"), "n")
    best = first_per_key(p, ["clause"], [F.desc("n"), F.asc("pattern")], rules.patterns).join(p.groupBy("clause").agg(F.sum("n").alias("every")), "clause")
    return _rows(best, "sentence_pattern", F.col("clause"), F.lit("pattern"), F.col("pattern"), F.col("n"), F.col("n") / F.col("every"))


def grammar(c: DataFrame, rules: Rules) -> DataFrame:
    m = c.where("kind = 'marker'").where(F.col("n") >= rules.least_marker)
    return _rows(m, "grammar", F.col("a"), F.lit("marker"), F.col("b"), F.col("n"), F.least(F.lit(1.0), F.col("n") / 10))


MAKERS = {"pos": pos, "morphology": morphology, "collocation": collocation, "sentence_patterns": sentence_patterns, "grammar": grammar}


def compared(new: DataFrame, old: DataFrame | None) -> DataFrame:
    """new with `status`: inserted, updated (other numbers) or unchanged."""
    if old is None:
        return new.withColumn("status", F.lit("inserted"))
    was = old.select("id", F.col("n").alias("__n"), F.col("confidence").alias("__c"))
    status = F.when(F.col("__n").isNull(), "inserted").when((F.col("n") != F.col("__n")) | (F.col("confidence") != F.col("__c")), "updated").otherwise("unchanged")
    return new.join(was, "id", "left").select(*COLUMNS, status.alias("status"))


def run(store: Versions, docs: DataFrame, rules: Rules, capabilities: list[str] | None = None, caps: dict[str, int] | None = None, dry_run: bool = False, name: str = "hypotheses") -> dict:
    """Hypotheses of (doc_id, text) into the store's table `name`; a summary: version, status counts by kind, failed capabilities.

    `caps` keeps a capability's rows with the largest counts, ties by id. With `dry_run` nothing is stored.
    """
    wanted = list(CAPABILITIES) if capabilities is None else list(capabilities)
    if wrong := [c for c in [*wanted, *(caps or {})] if c not in CAPABILITIES]:
        raise ValueError(f"unknown capabilities: {', '.join(wrong)}")
    spark, base, work = store.spark, store.manifest(), store.new_work()
    counts(docs, rules).write.parquet(f"{work}/counts")
    c, made, failed = spark.read.parquet(f"{work}/counts"), [], {}
    for capability in dict.fromkeys(wanted):
        at = f"{work}/{capability}"
        try:
            found = MAKERS[capability](c, rules)
            if caps and capability in caps:
                found = found.orderBy(F.desc("n"), "id").limit(caps[capability])
            found.write.parquet(at)
            made.append(at)
        except Exception as error:  # named in the summary; the others go on
            failed[capability] = type(error).__name__
    status, version = {}, base.version if base else 0
    if made:
        old = store.read(name)
        new = spark.read.parquet(*made)
        for r in compared(new, old).groupBy("kind", "status").count().collect():  # fifteen rows at most
            status.setdefault(r["kind"], {})[r["status"]] = r["count"]
        if not dry_run and any(s != "unchanged" for of in status.values() for s in of):
            merged = new if old is None else old.join(new.select("id"), "id", "left_anti").select(*COLUMNS).unionByName(new)
            version = store.commit({name: merged}, {"status": status, "failed": failed}, base=version or None).version
    store.drop_work(work)
    return {"version": version, "status": status, "failed": failed, "dry_run": dry_run}


#: Kinds that become claims, and the type of claim.
CLAIMS = {"pos": "lexicon", "morph_relation": "morphology", "collocation": "lexicon"}


def claims(hypotheses: DataFrame) -> DataFrame:
    """hypotheses (kind, subject, predicate, object, extras: map) as claims: type, subject, predicate, object replace them; rows that say no claim are left out.

    Subjects carry one "word:". A missing predicate of a part of speech or a relation is made from the extras pos, upos or type,
    a missing root from root. Parts of speech have no object; collocations need both slots.
    """
    said = lambda c: F.nullif(F.trim(c), F.lit(""))
    extra = lambda k: said(F.try_element_at("extras", F.lit(k)))
    kind, predicate, object_ = F.col("kind"), said(F.col("predicate")), said(F.col("object"))
    made = F.when(kind == "pos", F.concat(F.lit("pos:"), F.coalesce(extra("pos"), extra("upos")))).when(kind == "morph_relation", F.concat(F.lit("morph:"), extra("type")))
    root = F.coalesce(object_, extra("root"))
    target = F.when(kind == "morph_relation", F.when(root.startswith("root:"), root).otherwise(F.concat(F.lit("root:"), root))).when(kind == "collocation", object_)
    kinds = F.create_map(*[F.lit(x) for kv in CLAIMS.items() for x in kv])
    rest = [c for c in hypotheses.columns if c not in ("kind", "subject", "predicate", "object", "extras")]
    out = hypotheses.select(*rest, F.try_element_at(kinds, kind).alias("type"), F.regexp_replace(said(F.col("subject")), "^(word:)+", "word:").alias("subject"), F.coalesce(predicate, made).alias("predicate"), target.alias("object"), (kind == "pos").alias("__alone"))
    return out.where("type is not null and subject is not null and predicate is not null and (__alone or object is not null)").drop("__alone")
