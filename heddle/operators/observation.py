"""Observation build: sentences become observation rows and word statistics, committed together.

One scan tokenises the sources and writes the observations where the store publishes them later. One pass over these feeds every
statistic (`word_tallies`): counts of a task's sentences are added up there, and meet once, word by word; the lists that a word
keeps are cut to k as soon as its counts are complete.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.functions import text as T
from heddle.operators import word_tallies as W
from heddle.operators.rows import first_per_key
from heddle.sources.versions import Versions

SNIPPET = 200
#: Documents whose sizes are sent to all tasks; of more they are joined.
BROADCAST = 1_000_000


@dataclass(frozen=True)
class Settings:
    """window: tokens to either side; top: entries kept of each list; least: counts from which a pair can be a collocation."""

    window: int = 2
    top: int = 10
    least: int = 5
    #: Spelling variants to their normal form; a small fixed list.
    variants: tuple[tuple[str, str], ...] = ()


def sentences(docs: DataFrame, source: str = "source", ends: str = "[.!?\\n]+") -> DataFrame:
    """(source_id, document_id, sentence_id, source_ref, text) of each sentence of (doc_id, source, text)."""
    at = docs.select(F.coalesce(F.col(source), F.lit("")).alias("source_id"), F.col("doc_id").cast("string").alias("document_id"), F.posexplode(F.split("text", ends)).alias("sentence_id", "text"))
    return at.select("source_id", "document_id", "sentence_id", F.concat_ws(":", "source_id", "document_id", F.col("sentence_id").cast("string")).alias("source_ref"), F.trim("text").alias("text"))


def tokenised(sentences: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The sentences that hold tokens, with `surfaces` as written in lower case, `tokens` after spelling variants, and whether any was changed."""
    # exploded, as a filter on the tokens would compute them twice
    rows = sentences.select("*", F.explode(F.filter(F.array(T.tokens(F.col("text"))), lambda x: F.size(x) > 0)).alias("surfaces"))
    tokens = F.col("surfaces")
    if settings.variants:
        known = F.create_map(*[F.lit(x) for pair in settings.variants for x in pair])
        held = F.arrays_overlap("surfaces", F.array(*[F.lit(a) for a, _ in settings.variants]))
        tokens = F.when(held, F.transform("surfaces", lambda t: F.coalesce(known[t], t))).otherwise(tokens)
    return rows.withColumn("tokens", tokens).withColumn("corrected", F.col("tokens") != F.col("surfaces"))


def once(rows: DataFrame) -> DataFrame | None:
    """One row for each source_ref, the first by text; None if all are there once. Only rows whose source_ref comes again are compared."""
    h = F.xxhash64("source_ref").alias("__h")
    again = rows.groupBy(h).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__h")
    if again.isEmpty():
        return None
    rows = rows.withColumn("__h", h)
    few = first_per_key(rows.join(again, "__h", "left_semi"), ["source_ref"], [F.asc("text")], 1)
    return rows.join(again, "__h", "left_anti").unionByName(few).drop("__h")


def summed(found: DataFrame, sizes: DataFrame, documents: int, settings: Settings) -> DataFrame:
    """Rows SUMS of the observations; sizes: (document_id, sentences)."""
    d = F.col("document_id").eqNullSafe(F.col("__id"))
    s = sizes.select(F.col("document_id").alias("__id"), "sentences")
    text = F.when(F.length("text") > SNIPPET, F.concat(F.substring("text", 1, SNIPPET - 1), F.lit("…"))).otherwise(F.col("text"))
    rows = found.join(F.broadcast(s) if documents <= BROADCAST else s, d)
    rows = rows.select("source_id", "document_id", F.col("sentence_id").cast("long"), text.alias("text"), F.when(F.col("corrected"), F.col("surfaces")).alias("surfaces"), "tokens", "sentences")
    tallies = rows.mapInArrow(W.tallies(settings.window), W.TALLY)
    return tallies.select(F.xxhash64("word").alias("h"), "*").repartition("h").sortWithinPartitions("h").mapInArrow(W.sums(settings.top, settings.least), W.SUMS)


def collocations(sums: DataFrame, tokens: int, settings: Settings) -> DataFrame:
    """(word, rank, key, n, pmi): partners by positive PMI, where the pair and both words are frequent enough."""
    often = sums.where(F.col("partner").isNull() & (F.col("frequency") >= settings.least)).select(F.col("word").alias("key"), F.col("frequency").alias("of_key"))
    pairs = sums.where("partner is not null").select("word", "frequency", F.col("partner").alias("key"), F.col("partner_n").alias("n"))
    j = pairs.join(often, "key")
    j = j.withColumn("pmi", F.log2(F.col("n").cast("double") * tokens / (F.col("frequency").cast("double") * F.col("of_key")))).where("pmi > 0").withColumn("pmi", F.round("pmi", 4))
    return first_per_key(j.select("word", "key", "n", "pmi"), ["word"], [F.desc("pmi"), F.asc("key")], settings.top, rank="rank")


def statistics(sums: DataFrame, documents: int, tokens: int, settings: Settings = Settings(), attestations: DataFrame | None = None) -> DataFrame:
    """One row a word: scalars, surface_forms, contexts, neighbours, collocations, and the attestation given for it (word, attestation), if any."""
    # at most `top` entries a word
    c = collocations(sums, tokens, settings).groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "key", "pmi", "n"))), lambda x: F.struct(*[x[f].alias(f) for f in ("key", "pmi", "n")])).alias("collocations"))
    words = sums.where("partner is null").withColumn("diversity", F.round(F.col("doc_freq") / (documents or 1), 4))
    words = words.select("word", "frequency", "doc_freq", "sent_freq", "source_count", "diversity", "surface_forms", "left", "right", "neighbours", "snippet")
    out = words.join(c, "word", "left").select(*words.columns[:-1], "collocations", "snippet")
    return out.join(attestations.select("word", "attestation"), "word", "left") if attestations is not None else out.withColumn("attestation", F.lit(None).cast("string"))


def build(store: Versions, sentences: DataFrame, settings: Settings = Settings(), run: str = "", attestations: DataFrame | None = None) -> dict:
    """Adds new observations and renews the statistics; both tables appear together in one version of the store.

    Rows whose source_ref is there already are left as they are. Statistics are those of the run's sentences; words that the run does not
    hold keep their row, first_run stays, last_run is `run`. A run that changes nothing commits nothing. Returns counts and the version.
    """
    spark, work = store.spark, store.new_work()
    staged, found = store.stage("observations", tokenised(sentences, settings).withColumn("run", F.lit(run)))  # the scan of the sources
    if (fewer := once(found)) is not None:
        before, (staged, found) = staged, store.stage("observations", fewer)
        store.drop_staged(before)
    found.groupBy("source_id", "document_id").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{work}/documents")
    placed = spark.read.schema("source_id string, document_id string, n long").parquet(f"{work}/documents")
    totals = placed.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("source_id").isNotNull() & F.col("document_id").isNotNull()).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("sentences")).first()
    sums = summed(found, placed.groupBy("document_id").agg(F.sum("n").alias("sentences")), totals.rows, settings)
    sums.write.option("compression", "zstd").parquet(f"{work}/sums")
    sums = spark.read.schema(sums.schema).parquet(f"{work}/sums")
    base = store.manifest()
    old, old_stats = store.read("observations"), store.read("word_stats")
    new = found if old is None else found.join(old.select("source_ref"), "source_ref", "left_anti").select(*found.columns)
    n_new = totals.sentences if old is None else new.count()
    count = sums.where("partner is null").agg(F.count(F.lit(1)).alias("words"), F.coalesce(F.sum("frequency"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs")).first()
    stats, n_words = statistics(sums, totals.documents, count.tokens, settings, attestations), count.words
    kept = stats.columns
    if old_stats is None:
        merged, changed = stats.withColumns({"first_run": F.lit(run), "last_run": F.lit(run)}), n_words
    else:
        stats.write.option("compression", "zstd").parquet(f"{work}/stats")
        stats = spark.read.schema(stats.schema).parquet(f"{work}/stats")
        as_text = F.to_json(F.struct(*kept)).alias("row")
        changed = stats.select("word", as_text).join(old_stats.select("word", as_text), ["word", "row"], "left_anti").count()
        before = old_stats.select("word", F.col("first_run").alias("since"))
        merged = stats.join(before, "word", "left").select(*kept, F.coalesce("since", F.lit(run)).alias("first_run"), F.lit(run).alias("last_run"))
        merged = merged.unionByName(old_stats.join(stats.select("word"), "word", "left_anti").select(*merged.columns))
    out = {"sentences": totals.sentences, "inserted": n_new, "words": n_words, "changed_words": changed, "tokens": count.tokens, "pair_occurrences": count.pairs // 2}
    whole = n_new == totals.sentences  # the rows lie in the store already
    if n_new or changed or base is None:
        tables = {"word_stats": merged} if changed or base is None else {}
        base = store.commit(tables, {"run": run, **out}, base.version if base else None, append={"observations": staged if whole else new})
    if not whole or base.tables["observations"]["paths"][-1] != staged.path:
        store.drop_staged(staged)
    store.drop_work(work)
    return {**out, "version": base.version}
