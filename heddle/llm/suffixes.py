"""Suffix-array deduplication: removes each byte covered by a string of `width` bytes that also starts anywhere else.

Suffixes are dealt out so that all starts of one `width`-byte string meet in one place, and are sorted there by the
difference-cover algorithm:

1. One pass finds for each start its anchor, the smallest hash of `gram` bytes in its string (winnowing). Equal strings have
   equal anchors at equal distances. Starts that share an anchor are consecutive: a segment, at most 2 * width bytes.
2. Segments are counted by (anchor hash, 128 bits of their content). An anchor met once has no repeats. If all its segments
   are equal, all are repeats, and so are all starts of a segment that occurs twice: groups of copies end here, summed
   before the shuffle.
3. One copy of each distinct segment of the other anchors is cut from the texts and sent to the task of its anchor. There
   the difference-cover algorithm sorts the suffixes: triples at two of three positions are sorted and named, the names
   are sorted by the same algorithm, the remaining suffixes are merged in, and the prefixes of neighbours are compared
   byte by byte. Names that cover `width` bytes need no further levels.
4. An anchor with more than `crowd` distinct segments would load one task: its strings are dealt out again, one by one, by
   128 bits of their content, and counted.
5. Starts found become spans of each text; their bytes are removed.

Edge cases: a null or empty text, or one below `width` bytes, keeps all bytes. Repeated rows are repeats of each other. Rows
are told apart by id and text hash; rows equal in both fare alike. Texts of any length are handled whole. Other columns are
never read by repeats(); removal passes them through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heddle.llm.common import free_name, pieces, small_batches, text_bytes, written

WIDTH, GRAM, CROWD = 400, 32, 4000
_VALUE = np.random.default_rng(19730612).integers(1, 2**63, 256, dtype=np.uint64)
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i : i + w]) for each i, from running minima of blocks of w."""
    n = len(x)
    blocks = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = x
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def anchored(raw: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, first start, last start, anchor, anchor hash) of each segment, positions within the batch."""
    n = len(raw)
    if n < width:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    sums = np.r_[np.uint64(0), np.cumsum(_VALUE[raw] * _powers(_STEP, n))]
    h = (sums[gram:] - sums[:-gram]) * _powers(_BACK, n - gram + 1)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    low = np.uint64((1 << max(24, n.bit_length())) - 1)
    least = _sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), width - gram + 1)
    size = np.diff(offsets)
    text = np.repeat(np.arange(len(size)), size)[: len(least)]
    start = np.flatnonzero(np.arange(len(least)) + width <= offsets[1:][text])
    at = (least[start] & low).astype(np.int64)
    new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
    last = np.r_[new[1:], len(at)] - 1 if len(at) else new
    return text[start[new]], start[new], start[last], at[new], h[at[new]]


def suffix_order(s: np.ndarray, covers: int) -> np.ndarray:
    """The suffixes of s (positive numbers) in order, as far as their first `covers` numbers tell; ties in any order."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.r_[s, 0, 0, 0].astype(np.int64)
    ones = np.arange(1, n + (n % 3 == 1), 3)
    sampled = np.r_[ones, np.arange(2, n, 3)]
    bits, tops = max(n + 3, 2).bit_length(), max(int(t.max()), 1).bit_length()
    if 3 * tops + bits <= 63:  # the place itself fits behind the triple: one sort of numbers
        packed = np.sort((((t[sampled] << tops | t[sampled + 1]) << tops | t[sampled + 2]) << bits) | np.arange(len(sampled)))
        order, packed = packed & ((1 << bits) - 1), packed >> bits
    elif 3 * tops <= 63:
        packed = (t[sampled] << tops | t[sampled + 1]) << tops | t[sampled + 2]
        order = np.argsort(packed)
        packed = packed[order]
    else:
        order = np.lexsort((t[sampled + 2], t[sampled + 1], t[sampled]))
        packed = np.cumsum(np.r_[True, np.any([t[sampled + k][order][1:] != t[sampled + k][order][:-1] for k in range(3)], 0)])
    name = np.empty(len(sampled), np.int64)
    name[order] = np.cumsum(np.r_[True, packed[1:] != packed[:-1]])
    if covers <= 3 or name.max() == len(sampled):
        ranked = order
    else:
        ranked = suffix_order(name, -(-covers // 3))
    rank = np.zeros(n + 3, np.int64)
    rank[sampled[ranked]] = np.arange(1, len(sampled) + 1)
    sample = sampled[ranked]
    sample = sample[sample < n]
    rest = np.arange(0, n, 3)
    rest = rest[_order((t[rest], rank[rest + 1]), (tops, bits))]
    # merge: each remaining suffix finds its place among the sampled ones of either remainder by (number, rank behind)
    one, two = sample[sample % 3 == 1], sample[sample % 3 == 2]
    behind_one = _place((t[one], rank[one + 1]), (t[rest], rank[rest + 1]), (tops, bits))
    behind_two = _place((t[two], t[two + 1], rank[two + 2]), (t[rest], t[rest + 1], rank[rest + 2]), (tops, tops, bits))
    # suffixes that agree in `covers` numbers may be ranked either way; their places must rise all the same
    where = np.maximum.accumulate(behind_one + behind_two) + np.arange(len(rest))
    out = np.full(n, -1, np.int64)
    out[where] = rest
    out[out < 0] = sample
    return out


def _packed(keys: tuple[np.ndarray, ...], bits: tuple[int, ...]) -> np.ndarray:
    out = keys[0]
    for k, b in zip(keys[1:], bits[1:], strict=True):
        out = out << b | k
    return out


def _order(keys: tuple[np.ndarray, ...], bits: tuple[int, ...]) -> np.ndarray:
    return np.argsort(_packed(keys, bits)) if sum(bits) <= 63 else np.lexsort(keys[::-1])


def _place(sorted_keys: tuple[np.ndarray, ...], keys: tuple[np.ndarray, ...], bits: tuple[int, ...]) -> np.ndarray:
    """For each of keys the number of sorted_keys that come before it; both are in order."""
    if sum(bits) <= 63:
        return np.searchsorted(_packed(sorted_keys, bits), _packed(keys, bits))
    m = len(sorted_keys[0])
    both = np.lexsort((np.r_[np.ones(m, np.int8), np.zeros(len(keys[0]), np.int8)], *(np.r_[a, b] for a, b in reversed(list(zip(sorted_keys, keys, strict=True))))))
    mine = both >= m
    out = np.empty(len(keys[0]), np.int64)
    out[both[mine] - m] = np.cumsum(~mine)[mine]
    return out


def repeated_starts(parts: list[bytes], width: int) -> list[np.ndarray]:
    """For each of the distinct parts the starts of strings of `width` bytes that start anywhere else in them."""
    raw = np.frombuffer(b"".join(p + b"\0" for p in parts), np.uint8)
    ends = np.cumsum([len(p) + 1 for p in parts])
    order = suffix_order(raw.astype(np.int64) + 1, width)
    part = np.searchsorted(ends, order, "right")
    order = order[order + width < ends[part]]
    sums = np.r_[np.uint64(0), np.cumsum(_VALUE[raw] * _powers(_STEP, len(raw)))]
    prefix = (sums[order + width] - sums[order]) * _powers(_BACK, len(raw))[order]
    again = np.zeros(len(order), bool)
    near = np.flatnonzero(prefix[1:] == prefix[:-1])
    for k in range(0, len(near), 20_000):
        i = near[k : k + 20_000]
        window = np.arange(width)
        same = (raw[order[i][:, None] + window] == raw[order[i + 1][:, None] + window]).all(1)
        again[i[same]] = again[i[same] + 1] = True
    found = np.sort(order[again])
    of = np.searchsorted(ends, found, "right")
    begin = np.r_[0, ends[:-1]]
    return [found[of == k] - begin[k] for k in range(len(parts))] if len(parts) < 64 else [g - begin[k] for k, g in enumerate(np.split(found, np.searchsorted(of, np.arange(1, len(parts)))))]


def _runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """Consecutive starts as (first, last)."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.r_[0, cut + 1]].tolist(), starts[np.r_[cut, len(starts) - 1]].tolist(), strict=True))


def _segments(width: int, gram: int):
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("anchor", pa.int64()), ("seg", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1 << 20):
            raw, offsets = text_bytes(b.column(2))
            text, lo, hi, at, h = anchored(raw, offsets, width, gram)
            if len(text):
                view = memoryview(np.ascontiguousarray(raw))
                seg = [hashlib.blake2b(view[i : j + width], digest_size=16, salt=int(a - i).to_bytes(8, "little")).digest() for i, j, a in zip(lo, hi, at, strict=True)]
                pick = pa.array(text)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pick), b.column(1).take(pick), pa.array(lo - offsets[text]), pa.array(hi - offsets[text]), pa.array(h.astype(np.int64)), pa.array(seg, pa.binary())], schema=schema)

    return run


_CUT = pa.schema([("anchor", pa.int64()), ("seg", pa.binary()), ("n", pa.int64()), ("crowded", pa.bool_()), ("part", pa.binary())])


def _cut_out(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = text.encode("utf-8", "replace")
                rows += [(w["anchor"], w["seg"], w["n"], w["crowded"], raw[w["lo"] : w["hi"] + width]) for w in wanted]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _CUT, strict=True)], schema=_CUT)

    return run


def _sorted_groups(width: int, most: int = 1 << 20):
    """Suffix-sorts the segments of whole anchors, some at a time; rows arrive sorted by anchor."""
    schema = pa.schema([("anchor", pa.int64()), ("seg", pa.binary()), ("first", pa.int64()), ("last", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            found = repeated_starts([r[2] for r in held], width)
            rows = [(a, s, i, j) for (a, s, _), starts in zip(held, found, strict=True) for i, j in _runs(starts)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for b in batches:
            for a, s, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if size >= most and a != held[-1][0]:
                    yield from flush()
                    held, size = [], 0
                held.append((a, s, p))
                size += len(p)
        if held:
            yield from flush()

    return run


def _strings(width: int):
    schema = pa.schema([("anchor", pa.int64()), ("seg", pa.binary()), ("first", pa.int64()), ("h", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(a, s, i, hashlib.blake2b(p[i : i + width], digest_size=16).digest()) for a, s, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True) for i in range(len(p) - width + 1)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """(doc_id, mark, spans): the byte spans [start, stop) to remove, maximal and sorted, of each text that has any; mark is xxhash64 of the text."""
    small_batches(docs.sparkSession)
    text = F.col(f"`{text_col}`").cast("string")
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text")).where(F.octet_length("text") >= width)
    found = written(d.mapInArrow(_segments(width, gram), "doc_id long, mark long, lo long, hi long, anchor long, seg binary"), "segments")
    by_seg = found.groupBy("anchor", "seg").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "mark", "lo", "hi")).alias("one"))
    by_anchor = by_seg.groupBy("anchor").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds")).where("all > 1")
    groups = written(by_seg.join(by_anchor, "anchor"), "repeated-segments")

    mixed = groups.where("kinds > 1")
    wanted = mixed.select("one.doc_id", "one.mark", F.struct(F.col("one.lo").alias("lo"), F.col("one.hi").alias("hi"), "anchor", "seg", "n", (F.col("kinds") > crowd).alias("crowded")).alias("w")).groupBy("doc_id", "mark").agg(F.collect_list("w").alias("wanted"), F.count(F.lit(1)).alias("size"))
    wanted = written(wanted, "wanted-segments").withColumnsRenamed({"doc_id": "__doc", "mark": "__mark"})
    cut = d.join(wanted, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("mark") == F.col("__mark"))).select("text", "wanted")
    cut = written(cut.mapInArrow(_cut_out(width), "anchor long, seg binary, n long, crowded boolean, part binary"), "cut-segments").dropDuplicates(["anchor", "seg"])
    usual = cut.where("not crowded").select("anchor", "seg", "part").repartition("anchor").sortWithinPartitions("anchor")
    some = usual.mapInArrow(_sorted_groups(width), "anchor long, seg binary, first long, last long")
    strings = cut.where("crowded").select("anchor", "seg", "part").mapInArrow(_strings(width), "anchor long, seg binary, first long, h binary")
    twice = strings.groupBy("h").count().where("count > 1").select("h")
    some = some.unionByName(strings.join(twice, "h", "left_semi").select("anchor", "seg", "first", F.col("first").alias("last")))
    some = some.join(groups.where("kinds > 1 and n = 1").select("anchor", "seg"), ["anchor", "seg"], "left_semi").groupBy("anchor", "seg").agg(F.collect_list(F.struct("first", "last")).alias("parts"))

    whole = groups.where("n > 1").select("anchor", "seg", F.lit(None).cast("array<struct<first:long,last:long>>").alias("parts"))
    hit = found.join(whole.unionByName(some), ["anchor", "seg"])
    spans = hit.select("doc_id", "mark", F.explode(F.expr(f"if(parts is null, array(struct(lo as start, hi + {width} as stop)), transform(parts, p -> struct(lo + p.first as start, lo + p.last + {width} as stop)))")).alias("s"))
    # maximal spans: a span begins where no earlier one reaches
    ahead = Window.partitionBy("doc_id", "mark").orderBy("s.start", "s.stop").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("doc_id", "mark").orderBy("s.start", "s.stop")
    runs = spans.withColumn("new", F.coalesce((F.max("s.stop").over(ahead) < F.col("s.start")).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(upto))
    runs = runs.groupBy("doc_id", "mark", "run").agg(F.struct(F.min("s.start").alias("start"), F.max("s.stop").alias("stop")).alias("s"))
    return written(runs.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_list("s")).alias("spans")), "repeat-spans")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """docs with __spans (byte spans that repeat) and __kept (the remaining bytes of the text, binary); other columns unchanged. Where docs has these names, the two last columns bear longer ones."""
    doc, mark, spans_name, kept_name, raw_name = (free_name(docs, n) for n in ("__doc", "__mark", "__spans", "__kept", "__raw"))
    spans = repeats(docs, id_col, text_col, width, gram, crowd).toDF(doc, mark, spans_name)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    joined = docs.join(spans, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(F.col(f"`{text_col}`").cast("string")) == F.col(mark)), "left")
    gaps = f"transform(sequence(0, size({spans_name})), i -> substring({raw_name}, cast(if(i = 0, 0L, {spans_name}[i - 1].stop) + 1 as int), cast(if(i = size({spans_name}), length({raw_name}), {spans_name}[i].start) - if(i = 0, 0L, {spans_name}[i - 1].stop) as int)))"
    # the parts are joined as hexadecimal text, which is linear in their number
    kept = f"if({spans_name} is null, {raw_name}, unhex(array_join(transform({gaps}, g -> hex(g)), '')))"
    none = F.expr("cast(array() as array<struct<start:bigint,stop:bigint>>)")
    return joined.withColumn(raw_name, text.cast("binary")).withColumn(kept_name, F.expr(kept)).select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce(spans_name, none).alias(spans_name), kept_name)
