"""Phrase collocation mining with depth-limited count tries.

1. Each task reads its texts in shards of about `shard` bytes a language. A shard's trie holds every phrase of one and two
   words that stands within a piece (no phrase crosses `[.,;:!?\\x0A-\\x0D]`), with its count; its root, the empty phrase, counts
   all words. It is serialised in the order of its words: parents before children.
2. The serialised tries are merged by ranges of prefixes: one range-partitioned sort, then one pass that adds equal entries.
   A range is cut anywhere between two phrases, so that a word with very many phrases spreads over tasks.
3. Phrases of `min_count` and more go into a bit filter of fixed size. The next depth's tries hold only phrases whose first
   and last words, one fewer, pass it: every part of a candidate is as frequent as the candidate. A full filter lets more
   through and changes no result. The frequent phrases so far join the merge of the next depth.
4. The last merge walks the trie in order and gives each phrase the counts of its left parts, its ancestors. Ancestors that
   stand in an earlier range are looked up by a join. Right parts come along suffix links: a phrase joins the phrase
   without its first word, which brings its own right parts with it.
5. Each cut after k words scores floor(1000000 a a / (l r)) in exact decimals (a below 10^15); the lowest cut counts. Phrases
   that lie in a longer candidate with at least `inside` percent of their count go; each language's first `top` are ranked
   within 64 salted parts, then among the parts' winners.

Edge cases: a null text has no words; a null language is `und`; an empty language is one of its own. A language whose texts
hold no words has no rows. Repeated rows count as often as they stand there. Ties rank by a, then by the phrase's UTF-8
bytes; a phrase's lowest cut with equal scores is the earliest. A text is cut between pieces where it is longer than a shard, so
only a single piece without punctuation is held whole. An empty table has no rows. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heddle.llm.common import small_batches, written

MIN_COUNT, MOST_WORDS, INSIDE, TOP = 10, 3, 50, 2000
#: Bytes of text in one shard's trie.
SHARD = 1 << 23
#: Bits of the filter of frequent phrases, and the parts it is built in.
FILTER_BITS, PARTS = 1 << 26, 64
SALT = 64
_ENTRY = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)  # 0: of a word, 1: between words, 2: between pieces
_KIND[[9, 32]] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
_VALUE = np.random.default_rng(19930901).integers(1, 2**63, 256, dtype=np.uint64)
_STEP, _WORD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of a shard: the distinct ones in byte order, the number of each word in turn, and whether the next one stands in the same piece."""

    def __init__(self, raw: np.ndarray):
        low = _LOWER[raw]
        kind = _KIND[low]
        inner = kind == 0
        start = np.flatnonzero(inner & np.r_[True, ~inner[:-1]][: len(raw)])
        stop = np.flatnonzero(inner & np.r_[~inner[1:], True][-len(raw) :]) + 1 if len(raw) else start
        piece = np.searchsorted(np.flatnonzero(kind == 2), start)
        self.joined = piece[1:] == piece[:-1]
        offsets = np.r_[0, np.cumsum(stop - start)]
        each = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(low[inner])])
        coded = each.dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        self.distinct = coded.dictionary.take(order)
        self.number = rank[coded.indices.to_numpy()] if len(start) else np.zeros(0, np.int64)

    def whole(self, depth: int) -> np.ndarray:
        """Where a phrase of `depth` words starts."""
        at = np.arange(max(len(self.number) - depth + 1, 0))
        for k in range(depth - 1):
            at = at[self.joined[at + k]]
        return at

    def nodes(self, at: np.ndarray, depth: int) -> tuple[pa.Array, np.ndarray]:
        """The trie's phrases of `depth` words that start at `at`, in order, and their counts."""
        node, first = self.number[at], at
        for k in range(1, depth):
            _, first, node = np.unique(node << 32 | self.number[at + k], return_index=True, return_inverse=True)
            first = at[first]
        if depth == 1:
            _, first, node = np.unique(node, return_index=True, return_inverse=True)
            first = at[first]
        words = [self.distinct.take(pa.array(self.number[first + k])) for k in range(depth)]
        return (pc.binary_join_element_wise(*words, pa.scalar(" ", pa.large_string())) if depth > 1 else words[0]), np.bincount(node, minlength=len(first))

    def hashes(self, depth: int, seed: int) -> np.ndarray:
        """A hash of the `depth` words from each place on; meaningless where they cross pieces."""
        _, offsets, data = self.distinct.buffers()
        n = len(self.distinct)
        offsets = np.frombuffer(offsets, np.int64, n + 1, self.distinct.offset * 8)
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
        size, begin = np.diff(offsets), offsets[:-1] - offsets[0]
        place = np.arange(len(raw)) - np.repeat(begin, size)
        powers = np.cumprod(np.full(int(size.max()), _STEP))
        word = _mix(np.add.reduceat(_VALUE[raw] * powers[place], begin))[self.number]
        h = np.full(max(len(word) - depth + 1, 0), np.uint64(seed))
        for k in range(depth):
            h = h * _WORD + word[k : k + len(h)]
        return _mix(h)


def _seed(lang: str) -> int:
    h = 0xCBF29CE484222325
    for b in lang.encode():
        h = ((h ^ b) * 0x100000001B3) & (2**64 - 1)
    return h


def _cut(raw: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """raw in runs of about `most` bytes that end between pieces."""
    start = 0
    while start < len(raw):
        stop, wide = min(start + most, len(raw)), 1 << 16
        while stop < len(raw):
            found = np.flatnonzero(_KIND[raw[stop : stop + wide]] == 2)
            if len(found):
                stop += int(found[0]) + 1
                break
            stop, wide = min(stop + wide, len(raw)), wide * 2
        yield raw[start:stop]
        start = stop


def shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[str, Words]]:
    """(lang, words) of about `most` bytes of text of one language each; batches hold (lang, text)."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}

    def all_of(lang: str) -> Iterator[tuple[str, Words]]:
        size.pop(lang)
        for part in _cut(np.frombuffer(b"\n".join(held.pop(lang)), np.uint8), most):
            yield lang, Words(part)

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()), strict=True):
            if not text.is_valid:
                continue
            held.setdefault(lang, []).append(raw := text.as_py())
            size[lang] = size.get(lang, 0) + len(raw) + 1
            if size[lang] >= most:
                yield from all_of(lang)
        while sum(size.values()) >= most:  # many small languages
            yield from all_of(max(size, key=size.get))
    for lang in list(held):
        yield from all_of(lang)


def _rows(lang: str, phrases: pa.Array, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(n), 50_000):
        part = phrases.slice(k, 50_000)
        yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(part), np.int64))), part.cast(pa.string()), pa.array(n[k : k + 50_000], pa.int64())], schema=_ENTRY)


def _first_tries(shard: int):
    """The root, words and pairs of each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words in shards(batches, shard):
            if len(words.number):
                yield from _rows(lang, pa.array([""], pa.large_string()), np.array([len(words.number)]))
                for depth in (1, 2):
                    yield from _rows(lang, *words.nodes(words.whole(depth), depth))

    return run


def _next_tries(depth: int, shard: int, kept):
    """The phrases of `depth` words of each shard whose first and last depth - 1 words may be frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = kept.value
        for lang, words in shards(batches, shard):
            at = words.whole(depth)
            if len(at):
                place = words.hashes(depth - 1, _seed(lang)) & np.uint64(FILTER_BITS - 1)
                may = (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                at = at[may[at] & may[at + 1]]
                yield from _rows(lang, *words.nodes(at, depth))

    return run


def _places(depth: int):
    """The filter's bit of each frequent phrase (lang, phrase)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang in set(b.column(0).to_pylist()):
                t = b.filter(pc.equal(b.column(0), lang))
                words = Words(np.frombuffer("\n".join(t.column(1).to_pylist()).encode(), np.uint8))
                place = words.hashes(depth, _seed(lang))[words.whole(depth)] & np.uint64(FILTER_BITS - 1)
                yield pa.RecordBatch.from_arrays([pa.array((place // np.uint64(FILTER_BITS // PARTS)).astype(np.int32)), pa.array((place % np.uint64(FILTER_BITS // PARTS)).astype(np.int32))], names=["part", "bit"])

    return run


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits: dict[int, np.ndarray] = {}
    for b in batches:
        part, bit = b.column(0).to_numpy(), b.column(1).to_numpy()
        for p in np.unique(part).tolist():
            own = bits.setdefault(p, np.zeros(FILTER_BITS // PARTS, bool))
            own[bit[part == p]] = True
    yield pa.RecordBatch.from_arrays([pa.array(list(bits), pa.int32()), pa.array([np.packbits(v, bitorder="little").tobytes() for v in bits.values()], pa.binary())], names=["part", "bits"])


def _filter(frequent: DataFrame, depth: int) -> np.ndarray:
    """FILTER_BITS bits: those of all phrases of `depth` words are set. Fixed size, built in parts."""
    places = frequent.where(F.col("depth") == depth).select("lang", "phrase").mapInArrow(_places(depth), "part int, bit int")
    found = np.zeros((PARTS, FILTER_BITS // PARTS // 8), np.uint8)
    for r in places.distinct().repartition(PARTS, "part").mapInArrow(_bitmaps, "part int, bits binary").collect():
        found[r.part] = np.frombuffer(r.bits, np.uint8)
    return found.ravel()


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """Equal entries of sorted rows (lang, phrase, n) added up, whole batches at a time."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        lang, phrase, n = b.column(0), b.column(1), b.column(2).to_numpy()
        same = pc.and_(pc.equal(lang[1:], lang[:-1]), pc.equal(phrase[1:], phrase[:-1])).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.r_[True, ~same])
        total = np.add.reduceat(n, first)
        at = pa.array(first)
        lang, phrase = lang.take(at), phrase.take(at)
        if last is not None:
            if last[0] == lang[0].as_py() and last[1] == phrase[0].as_py():
                total[0] += last[2]
            else:
                yield pa.array([last[0]]), pa.array([last[1]]), np.array([last[2]])
        last = (lang[-1].as_py(), phrase[-1].as_py(), int(total[-1]))
        yield lang[:-1], phrase[:-1], total[:-1]
    if last is not None:
        yield pa.array([last[0]]), pa.array([last[1]]), np.array([last[2]])


def _merged(min_count: int):
    """(lang, phrase, depth, n, lefts) of the frequent phrases and the roots; lefts are the counts of the first 1, 2, ... words, null where they stand in another range."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("depth", pa.int32()), ("n", pa.int64()), ("lefts", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path: list[tuple[str, int]] = []  # of each depth the latest phrase and its count
        at = None
        for langs, phrases, n in _summed(batches):
            kept = pa.array((n >= min_count) | pc.equal(phrases, "").to_numpy(zero_copy_only=False))
            langs, phrases, n = langs.filter(kept).to_pylist(), phrases.filter(kept).to_pylist(), n[np.asarray(kept)].tolist()
            depths, lefts = [], []
            for lang, phrase, count in zip(langs, phrases, n, strict=True):
                if lang != at:
                    at, path = lang, []
                depth = phrase.count(" ") + 1 if phrase else 0
                own: list[int | None] = []
                end = -1
                for k in range(depth - 1):
                    end = phrase.find(" ", end + 1)
                    own.append(path[k][1] if k < len(path) and path[k][0] == phrase[:end] else None)
                if depth:
                    path[depth - 1 :] = [(phrase, count)]
                    if len(path) < depth:
                        path[:] = [("", 0)] * (depth - 1) + [(phrase, count)]
                depths.append(depth)
                lefts.append(own)
            if depths:
                yield pa.RecordBatch.from_arrays([pa.array(langs), pa.array(phrases), pa.array(depths, pa.int32()), pa.array(n, pa.int64()), pa.array(lefts, pa.list_(pa.int64()))], schema=schema)

    return run


def _merge(tries: DataFrame, min_count: int, name: str) -> DataFrame:
    """The k-way merge: shards' sorted entries, dealt by ranges of prefixes, sorted and added."""
    ordered = tries.repartitionByRange("lang", "phrase").sortWithinPartitions("lang", "phrase")
    return written(ordered.mapInArrow(_merged(min_count), "lang string, phrase string, depth int, n long, lefts array<long>"), name)


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, most_words: int = MOST_WORDS, shard: int = SHARD) -> DataFrame:
    """(lang, phrase, depth, n, lefts, rights): every phrase of at most `most_words` words that occurs `min_count` times, with the counts of its first and of its last words at each cut; the empty phrase of each language has the number of all words."""
    if most_words < 2 or min_count < 1:
        raise ValueError("phrases have two words or more, and occur once or more")
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    entry = "lang string, phrase string, n long"
    nodes = _merge(written(texts.mapInArrow(_first_tries(shard), entry), "tries-1-2"), min_count, "phrases-2")
    for depth in range(3, most_words + 1):
        kept = spark.sparkContext.broadcast(_filter(nodes, depth - 1))
        tries = written(texts.mapInArrow(_next_tries(depth, shard, kept), entry), f"tries-{depth}")
        nodes = _merge(nodes.select("lang", "phrase", "n").unionByName(tries), min_count, f"phrases-{depth}")
        kept.unpersist()
    # parts that stand in an earlier range
    open_ = F.exists("lefts", F.isnull)
    mended = nodes.where(open_)
    for k in range(1, most_words):
        part = nodes.where(F.col("depth") == k).select(F.col("lang").alias("of"), F.col("phrase").alias("part"), F.col("n").alias("found"))
        first = F.substring_index("phrase", " ", k)
        mended = mended.join(part, (F.col("lang") == F.col("of")) & (first == F.col("part")), "left")
        mended = mended.select("lang", "phrase", "depth", "n", F.expr(f"transform(lefts, (x, i) -> if(i = {k - 1}, coalesce(x, found), x))").alias("lefts"))
    nodes = nodes.where(~open_).unionByName(mended)
    # suffix links, one depth after the other
    below = nodes.where("depth = 1").withColumn("rights", F.expr("array()").cast("array<bigint>"))
    done = nodes.where("depth = 0").withColumn("rights", F.expr("array()").cast("array<bigint>")).unionByName(below)
    for depth in range(2, most_words + 1):
        link = below.select(F.col("lang").alias("of"), F.col("phrase").alias("suffix"), F.concat(F.array("n"), "rights").alias("rights"))
        own = nodes.where(F.col("depth") == depth).withColumn("to", F.expr("substring(phrase, instr(phrase, ' ') + 1)"))
        below = written(own.join(link, (F.col("lang") == F.col("of")) & (F.col("to") == F.col("suffix"))).select("lang", "phrase", "depth", "n", "lefts", "rights"), f"suffix-links-{depth}")
        done = done.unionByName(below)
    return done


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, most_words: int = MOST_WORDS, inside: int = INSIDE, top: int = TOP, shard: int = SHARD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of each language."""
    nodes = frequent_phrases(docs, text_col, lang_col, min_count, most_words, shard)
    total = nodes.where("depth = 0").select(F.col("lang").alias("of"), F.col("n").alias("words"))
    found = nodes.where("depth >= 2")
    if most_words > 2:
        parts = "flatten(transform(sequence(2, depth - 1), d -> transform(sequence(1, depth - d + 1), s -> array_join(slice(split(phrase, ' '), s, d), ' '))))"
        held = found.where("depth >= 3").select(F.col("lang").alias("in_lang"), F.col("n").alias("longer"), F.explode(F.expr(parts)).alias("part"))
        most = held.groupBy("in_lang", "part").agg(F.max("longer").alias("longer"))
        found = found.join(most, (F.col("lang") == F.col("in_lang")) & (F.col("phrase") == F.col("part")), "left").where(F.coalesce(F.expr(f"100 * longer < {inside} * n"), F.lit(True)))
    wide = "cast({} as decimal(15, 0))"
    score = f"cast((cast(1000000 as decimal(7, 0)) * {wide.format('n')} * {wide.format('n')}) div ({wide.format('lefts[k - 1]')} * {wide.format('rights[k - 1]')}) as long)"
    cut = F.expr(f"array_min(transform(sequence(1, depth - 1), k -> struct({score} as score, k as k, lefts[k - 1] as l, rights[k - 1] as r)))")
    scored = found.select("lang", "phrase", F.col("n").alias("a"), cut.alias("cut")).select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = scored.withColumn("salt", F.expr(f"pmod(xxhash64(phrase), {SALT})"))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(total, F.col("lang") == F.col("of")).select("lang", "rank", "phrase", "a", "l", "r", F.col("words").alias("n"), "score")
