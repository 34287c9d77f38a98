"""LM scoring by context-tree weighting over bytes.

A text is its bytes with A-Z lower-cased, closed by an end sign (byte 0). Each byte is eight binary decisions; a decision is
made at a node, the bits before it in the byte, below a context, the last `depth` bytes. Each node of each context from
order 0 to `depth` keeps a Krichevsky-Trofimov estimate of its training counts; weighting mixes the orders: with P_e the
estimate's probability of the training bits of a node and P_w = (P_e + product of the children's P_w) / 2, the share of an
order is the posterior P_e / 2 P_w. Where a longer context has no training counts, the path ends at the order before.

1. Each task cuts its texts into pieces of about `PIECE` bytes. Of each piece it keeps the texts, compressed, and its
   distinct (context, byte) keys with their training counts, dealt into parts by the last `SPLIT` context bytes and packed
   as sorted differences (one to two bytes a key). Spark moves these packed rows alone.
2. Each part adds up its pieces' counts and weights its subtrees bottom-up, whole subtrees at a time. The nodes of order
   `SPLIT` are summed by Spark to orders 2 and 1; what is left for the driver are the 256 contexts of order 1.
3. Top-down, each part gives each key the log probability of its byte, and each piece the values of its keys.
4. Each piece's texts meet the values of their keys and are scored. A task holds one piece or one part; no table of the model is sent to
   all tasks, and one plan serves every size.

The unigram base model goes the same way, with 64-bit hashes of words as keys and training counts as values.

Edge cases: a null or empty text is its end sign alone; a null id is neither held out nor learnt from. Texts of any length
are scored whole. Repeated rows count and score each for itself; ties have no effect. An empty table has no rows; without
any training row the estimates are 1/2 for each bit. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import held_out, keyed, pieces, small_batches, text_bytes, training_rows, written

#: Context bytes: at most 6, so that a key of context and byte, and whether it is learnt from, fit in 64 bits.
DEPTH = 5
SPLIT = 3
PIECE, STEP = 8 << 20, 1 << 19
#: Bytes of text for each part of the model.
PART = 8 << 20
#: Keys of one part that are worked on at once; a subtree is never cut.
CHUNK = 1 << 18
_BYTES, _WORDS, _TEXTS = 0, 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_SEED = np.random.default_rng(19950501)
_VALUE = _SEED.integers(1, 2**63, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_END = np.uint64(1)
_U8 = np.uint64(8)


def byte_keys(raw: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The key (context bytes, latest first, then the byte) of each byte and end sign, and its text's number."""
    n = len(offsets) - 1
    at = offsets[:-1] + np.arange(n) * (depth + 1) + depth
    size = np.diff(offsets)
    doc = np.repeat(np.arange(n), size + 1)
    place = np.arange(len(raw) + n) + (doc + 1) * depth
    line = np.zeros(len(raw) + n * (depth + 1), np.uint64)
    line[np.repeat(at - offsets[:-1], size) + np.arange(len(raw))] = _LOWER[raw]
    whole = np.zeros(len(line) + 1, np.uint64)
    for k in range(1, depth + 1):
        whole[k:-1] |= line[: len(line) - k] << np.uint64(8 * (depth - k + 1))
    return whole[place] | line[place], doc


def word_keys(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word and of each end, and its text's number."""
    n = len(offsets) - 1
    low = _LOWER[raw]
    blank = _BLANK[low]
    doc_of = np.repeat(np.arange(n), np.diff(offsets))
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets[:-1]] = True
    begins = ~blank & (np.r_[True, blank[:-1]][: len(raw)] | edge[:-1])
    starts = np.flatnonzero(begins)
    ends = np.full(n, _END)
    if not len(starts):
        return ends, np.arange(n)
    first = np.repeat(starts, np.diff(np.r_[starts, len(raw)]))
    place = np.arange(starts[0], len(raw)) - first
    powers = np.cumprod(np.full(int(place.max()) + 1, _STEP))
    value = np.where(blank, np.uint64(0), _VALUE[low])[starts[0] :] * powers[place]
    h = np.add.reduceat(value, starts - starts[0])
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.r_[h, ends], np.r_[doc_of[starts], np.arange(n)]


def _keys(kind: int, raw: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of 63 bits at most, and their texts' numbers."""
    if kind == _BYTES:
        return byte_keys(raw, offsets, depth)
    key, doc = word_keys(raw, offsets)
    return key >> np.uint64(1), doc


def _packed(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values).tobytes(), "zstd", asbytes=True)


def _unpacked(blob: bytes, n: int, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, n * np.dtype(kind).itemsize, "zstd", asbytes=True), kind)


def _packed_keys(key: np.ndarray) -> bytes:
    return _packed(np.diff(key, prepend=np.uint64(0)))


def _unpacked_keys(blob: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unpacked(blob, n, np.uint64), dtype=np.uint64)


def _packed_floats(x: np.ndarray) -> bytes:
    """Doubles to 37 bits of mantissa, byte by byte, so that they compress."""
    bits = x.astype(np.float64).view(np.uint64) & ~np.uint64(0x7FFF)
    return _packed(bits.view(np.uint8).reshape(-1, 8).T)


def _unpacked_floats(blob: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(_unpacked(blob, 8 * n, np.uint8).reshape(8, n).T).view(np.float64).ravel()


_PIECES = pa.schema([("piece", pa.int64()), ("kind", pa.int32()), ("part", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("data", pa.binary())])
_PIECES_SQL = "piece long, kind int, part long, n long, keys binary, data binary"


def _parts_of(kind: int, key: np.ndarray, depth: int, parts: int) -> np.ndarray:
    """The part of each key: byte keys by their last context bytes, words by their hash."""
    h = key >> np.uint64(8 * (depth - min(SPLIT, depth) + 1)) if kind == _BYTES else key
    h = (h ^ (h >> np.uint64(15))) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def _in_pieces(depth: int, parts: int):
    """Rows of texts and of packed keys and training counts, for each piece of a task's texts."""

    def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys and training counts of sorted (key << 1 | learnt)."""
        new = np.ones(len(key), bool)
        for i in range(1, len(key), 1 << 20):  # by and by: temporary arrays stay small
            new[i : i + (1 << 20)] = key[i : i + (1 << 20)] ^ key[i - 1 : min(i + (1 << 20), len(key)) - 1] > 1
        new = np.flatnonzero(new)
        n = np.add.reduceat((key & np.uint64(1)).astype(np.uint8), new, dtype=np.int64)
        return key[new] >> np.uint64(1), n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, task, k = [], 0, TaskContext.get().partitionId() << 32, 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = []
            texts = pa.Table.from_batches(held)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, texts.schema) as out:
                out.write_table(texts)
            raw = sink.getvalue()
            rows.append((task + k, _TEXTS, -1, raw.size, b"", pa.compress(raw, "zstd", asbytes=True)))
            for kind in (_BYTES, _WORDS):
                found, upto = np.empty(sum(b.column(1).nbytes + b.num_rows for b in held), np.uint64), 0  # room for the largest number of keys
                for b in pieces(iter(held), STEP):
                    key, doc = _keys(kind, *text_bytes(b.column(1)), depth)
                    learnt = np.asarray(b.column(2).to_numpy(zero_copy_only=False), np.uint64)[doc]
                    found[upto : upto + len(key)] = key << np.uint64(1) | learnt
                    upto += len(key)
                key = found[:upto]
                key.sort()
                key, n = distinct(key)
                part = _parts_of(kind, key, depth, parts)
                order = np.argsort(part.astype(np.uint16) if parts < 1 << 16 else part, kind="stable")
                part, key, n = part[order], key[order], n[order]
                new = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                for i, j in zip(new, np.r_[new[1:], len(part)], strict=True):
                    rows.append((task + k, kind, int(part[i]), int(j - i), _packed_keys(key[i:j]), _packed(n[i:j])))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES)

        for b in pieces(batches, 1 << 20):
            held.append(b)
            size += b.column(1).nbytes
            if size >= PIECE:
                yield from flush()
                held, size, k = [], 0, k + 1
        if held:
            yield from flush()

    return run


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x > 0, by Stirling's series after moving x up to 8 or more."""
    x = np.asarray(x, float)
    shift = np.ones_like(x)
    y = x.copy()
    while (low := y < 8).any():
        shift[low] *= y[low]
        y[low] += 1
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - (1 / 360 - 1 / (1260 * y * y)) / (y * y)) / y - np.log(shift)


def _log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _lgamma(a + 0.5) + _lgamma(b + 0.5) - _lgamma(a + b + 1) - np.log(np.pi)


class _Order:
    """The nodes of one order, sorted by id (context, node): counts, log of the weighted probability, own share, nodes one order up."""

    def __init__(self, ids: np.ndarray, ones: np.ndarray, zeros: np.ndarray, below: np.ndarray | None):
        self.ids, self.ones, self.zeros, self.up = ids, ones, zeros, None
        own = _log_kt(zeros, ones)
        self.log_w = own if below is None else np.logaddexp(own, below) - np.log(2)
        self.share = np.ones(len(ids)) if below is None else np.exp(own - np.log(2) - self.log_w)
        self.p = (ones + 0.5) / (ones + zeros + 1)
        self.seen = ones + zeros > 0

    def shorter(self) -> _Order:
        """The nodes of the order one less than this, from these."""
        up = _shorter(self.ids)
        order = np.argsort(up, kind="stable")
        new = np.flatnonzero(np.r_[True, up[order][1:] != up[order][:-1]])
        self.up = np.empty(len(up), np.int64)
        self.up[order] = np.repeat(np.arange(len(new)), np.diff(np.r_[new, len(up)]))
        add = lambda v: np.add.reduceat(v[order], new)
        return _Order(up[order][new], add(self.ones), add(self.zeros), add(self.log_w))

    def lines(self, fixed: np.ndarray, left: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(1) as fixed + left * P of the next order, and alone where that is unseen, from these numbers of the order above."""
        return (
            np.where(self.seen, fixed + left * self.share * self.p, fixed),
            np.where(self.seen, left * (1 - self.share), left),
            np.where(self.seen, fixed + left * self.p, alone),
        )


def _shorter(ids):
    """Ids without the oldest context byte."""
    return (ids >> np.uint64(16)) << _U8 | (ids & np.uint64(255))


def _deepest(key: np.ndarray, n: np.ndarray) -> tuple[_Order, np.ndarray]:
    """The nodes of full order of sorted keys, and the node of each decision: one row per key, one column per bit."""
    ids, ones, both, at, base = [], [], [], np.empty((len(key), 8), np.int64), 0
    for k in range(8):
        prefix = key >> np.uint64(8 - k)
        new = np.r_[True, prefix[1:] != prefix[:-1]]
        first = np.flatnonzero(new)
        bit = (key >> np.uint64(7 - k)) & np.uint64(1)
        ids.append((key[first] & ~np.uint64(255)) | (np.uint64(1 << k) | ((key[first] & np.uint64(255)) >> np.uint64(8 - k))))
        ones.append(np.add.reduceat(n * bit, first))
        both.append(np.add.reduceat(n, first))
        at[:, k] = base + np.cumsum(new) - 1
        base += len(first)
    ones, both = np.concatenate(ones), np.concatenate(both)
    return _Order(np.concatenate(ids), ones, both - ones, None), at


def _orders(key: np.ndarray, n: np.ndarray, depth: int, least: int) -> tuple[list[_Order], np.ndarray]:
    """Orders depth, depth - 1, ... least of the subtrees that the keys make up, and the deepest node of each decision."""
    first, at = _deepest(key, n)
    found = [first]
    for _ in range(depth - least):
        found.append(found[-1].shorter())
    return found, at


def _chunks(key: np.ndarray, depth: int, split: int) -> Iterator[tuple[int, int]]:
    """Ranges of sorted keys of about CHUNK keys that hold whole subtrees."""
    group = key >> np.uint64(8 * (depth - split + 1))
    cuts = np.r_[np.flatnonzero(group[1:] != group[:-1]) + 1, len(key)]
    start = 0
    while start < len(key):
        stop = int(cuts[min(np.searchsorted(cuts, start + CHUNK), len(cuts) - 1)])
        yield start, stop
        start = stop


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, n = (np.concatenate(c) for c in zip(*held, strict=True))
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[new], np.add.reduceat(n[order], new)


def _merged_parts(depth: int, split: int):
    """Of each part: its keys and counts, and for bytes the nodes of order `split`; rows (kind, part, n, keys, data) arrive by part."""
    schema = pa.schema([("kind", pa.int32()), ("part", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("data", pa.binary()), ("total", pa.int64()), ("known", pa.int64()), *[(c, pa.list_(t)) for c, t in (("ids", pa.int64()), ("ones", pa.int64()), ("zeros", pa.int64()), ("log_w", pa.float64()))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size = None, [], 0

        def flush() -> pa.RecordBatch:
            key, n = _summed(held)
            nodes = [[], [], [], []]
            if at[0] == _BYTES:
                for i, j in _chunks(key, depth, split):
                    top = _orders(key[i:j], n[i:j], depth, split)[0][-1]
                    for to, v in zip(nodes, (top.ids.astype(np.int64), top.ones, top.zeros, top.log_w), strict=True):
                        to.append(v)
            lists = [np.concatenate(v) if v else np.zeros(0) for v in nodes]
            row = [*at, len(key), _packed_keys(key), _packed(n), int(n.sum()), int((n > 0).sum()), *lists]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for b in batches:
            for kind, part, n, keys, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (kind, part) != at:
                    if held:
                        yield flush()
                    at, held, size = (kind, part), [], 0
                held.append((_unpacked_keys(keys, n), _unpacked(data, n, np.int64)))
                size += n
                if size > 1 << 22:
                    held = [_summed(held)]
                    size = len(held[0][0]) // 2
        if held:
            yield flush()

    return run


def _valued(depth: int, split: int):
    """Packed values of each piece's keys. Rows arrive by (kind, part, step): a part's counts, its lines, then its pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = value = None
        for b in batches:
            rows = []
            for kind, part, step, piece, n, keys, data, *lines in zip(*(c.to_pylist() if k < 7 else c for k, c in enumerate(b.columns)), strict=True):
                if step == 0:
                    key, value = _unpacked_keys(keys, n), _unpacked(data, n, np.int64)
                elif step == 1:
                    value = _log_probabilities(key, value, depth, split, *(np.asarray(v.values) for v in lines))
                else:
                    mine = _unpacked_keys(keys, n)
                    got = value[np.searchsorted(key, mine)]
                    rows.append((piece, kind, part, n, None, _packed_floats(got) if kind == _BYTES else _packed(got)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES)

    return run


def _log_probabilities(key, n, depth, split, ids, fixed, left, alone) -> np.ndarray:
    """log10 P of each of the sorted keys; the lines are those of the order above `split`, at the nodes `ids` of order `split`."""
    order = np.argsort(ids)
    ids, above = ids[order].astype(np.uint64), [v[order] for v in (fixed, left, alone)]
    out = np.empty(len(key))
    for i, j in _chunks(key, depth, split):
        orders, at = _orders(key[i:j], n[i:j], depth, split)
        place = np.searchsorted(ids, orders[-1].ids)
        line = orders[-1].lines(*(v[place] for v in above))
        for o in reversed(orders[:-1]):
            line = o.lines(*(v[o.up] for v in line))
        p = line[2][at]
        bit = (key[i:j, None] >> np.arange(7, -1, -1, dtype=np.uint64)) & np.uint64(1)
        out[i:j] = np.log10(np.where(bit == 1, p, 1 - p)).sum(1)
    return out


def _above(nodes: DataFrame, split: int) -> DataFrame:
    """Nodes (part, id, ones, zeros, log_w) of order `split` with the lines (fixed, left, alone) of the order above."""
    if split == 0:
        return nodes.select("part", "id", F.lit(0.0).alias("fixed"), F.lit(1.0).alias("left"), F.lit(0.5).alias("alone"))
    up = F.expr("shiftleft(shiftright(id, 16), 8) | (id & 255)")
    sums = [F.sum(c).alias(c) for c in ("ones", "zeros", "log_w")]
    levels, now = [], nodes
    for _ in range(split - 1):  # orders split - 1 to 1
        now = now.withColumn("id", up).groupBy("id").agg(*sums)
        now = written(now.mapInArrow(_weighted_nodes, "id long, ones long, zeros long, log_w double, below double"), "lm-nodes")
        levels.append(now)
    got = now.select("id", "ones", "zeros", "log_w").toArrow() if levels else now.groupBy("id").agg(*sums).toArrow()
    # at most 256 contexts of 255 nodes are left: orders 1 and 0 on the driver
    order = np.argsort(np.asarray(got["id"]))
    last = _Order.__new__(_Order)
    last.ids, last.ones, last.zeros, last.log_w = (np.asarray(got[c])[order] for c in ("id", "ones", "zeros", "log_w"))
    last.ids = last.ids.astype(np.uint64)
    if not len(last.ids):
        return nodes.select("part", "id", F.lit(0.0).alias("fixed"), F.lit(1.0).alias("left"), F.lit(0.5).alias("alone"))
    root = last.shorter()
    line = root.lines(np.zeros(len(root.ids)), np.ones(len(root.ids)), np.full(len(root.ids), 0.5))
    spark = nodes.sparkSession
    above = spark.createDataFrame(pa.table({"id": pa.array(last.ids.astype(np.int64)), **{c: pa.array(v[last.up]) for c, v in zip(("fixed", "left", "alone"), line, strict=True)}}))
    for k in range(len(levels) - 1, -1, -1):  # lines of the order itself, then given to the nodes one order down
        own = levels[k].join(above, "id").mapInArrow(_own_lines, "up long, fixed double, left double, alone double")
        below = levels[k - 1] if k else nodes
        above = below.withColumn("up", up).join(own, "up").select("id", *(["part"] if below is nodes else []), "fixed", "left", "alone")
    return above if levels else nodes.join(above, "id").select("part", "id", "fixed", "left", "alone")


def _weighted_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, ones, zeros, log_w of the children together) with the nodes' own log_w, and the children's."""
    for b in batches:
        ids, ones, zeros, below = (np.asarray(c) for c in b.columns)
        if len(ids):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (ids, ones, zeros, _Order(ids, ones, zeros, below).log_w, below)], names=["id", "ones", "zeros", "log_w", "below"])


def _own_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        c = {n: np.asarray(b.column(n)) for n in b.schema.names}
        if b.num_rows:
            line = _Order(c["id"], c["ones"], c["zeros"], c["below"]).lines(c["fixed"], c["left"], c["alone"])
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (c["id"], *line)], names=["up", "fixed", "left", "alone"])


_SCORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("words", pa.float64()), ("score", pa.float64())])


def _scored(depth: int, parts: int):
    """Scores of each piece's texts; rows (piece, kind, part, n, data) arrive by piece, the values in order of parts before the texts.

    The keys are not sent along: the piece's texts give the same distinct keys, in the same order, once more.
    """

    def table(kind: int, texts: list[pa.RecordBatch], held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        key = np.concatenate([_keys(kind, *text_bytes(b.column(1)), depth)[0] for b in pieces(iter(texts), STEP)])
        key.sort()
        key = key[np.r_[True, key[1:] != key[:-1]]]
        value = np.empty(len(key), held[0].dtype)
        value[np.argsort(_parts_of(kind, key, depth, parts), kind="stable")] = np.concatenate(held)
        return key, value

    def values(known: tuple[np.ndarray, np.ndarray], key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        out = np.empty(len(key), known[1].dtype)
        out[order] = known[1][np.searchsorted(known[0], key[order])]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {_BYTES: [], _WORDS: []}
        for b in batches:
            for kind, n, data in zip(*(b.column(c).to_pylist() for c in (1, 3, 4)), strict=True):
                if kind != _TEXTS:
                    held[kind].append(_unpacked_floats(data, n) if kind == _BYTES else _unpacked(data, n, np.int64))
                    continue
                texts = pa.ipc.open_stream(pa.decompress(data, n, "zstd")).read_all().to_batches()
                of_bytes, of_words = table(_BYTES, texts, held[_BYTES]), table(_WORDS, texts, held[_WORDS])
                held = {_BYTES: [], _WORDS: []}
                for t in pieces(iter(texts), STEP):
                    raw, offsets = text_bytes(t.column(1))
                    m = t.num_rows
                    key, doc = _keys(_BYTES, raw, offsets, depth)
                    score = np.bincount(doc, values(of_bytes, key), m)
                    key, doc = _keys(_WORDS, raw, offsets, depth)
                    count = values(of_words, key)
                    cols = [t.column(0), np.diff(offsets), np.bincount(doc, minlength=m), np.bincount(doc[count > 0], minlength=m), np.bincount(doc, np.log10(count + 1.0), m), score]
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, _SCORED, strict=True)], schema=_SCORED)

    return run


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, held: int = 2, depth: int = DEPTH, part: int = PART) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte (code length)."""
    small_batches(docs.sparkSession)
    split = min(SPLIT, depth)
    d = keyed(docs, id_col, text_col)
    parts = -(-(d.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // part) or 1
    found = d.select("doc_id", "text", training_rows("doc_id", modulus, held).alias("t")).mapInArrow(_in_pieces(depth, parts), _PIECES_SQL)
    found = written(found, "lm-pieces")
    packed = found.where(f"kind <> {_TEXTS}")
    merged = packed.select("kind", "part", "n", "keys", "data").repartition("kind", "part").sortWithinPartitions("kind", "part")
    merged = written(merged.mapInArrow(_merged_parts(depth, split), "kind int, part long, n long, keys binary, data binary, total long, known long, ids array<long>, ones array<long>, zeros array<long>, log_w array<double>"), "lm-parts")
    total, distinct = merged.where(f"kind = {_WORDS}").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("known"), F.lit(0))).first()
    floor = float(np.log10(total + distinct + 1.0))

    nodes = merged.where(f"kind = {_BYTES}").select("part", F.explode(F.arrays_zip("ids", "ones", "zeros", "log_w")).alias("x")).select("part", F.col("x.ids").alias("id"), "x.ones", "x.zeros", "x.log_w")
    lines = _above(nodes, split).groupBy("part").agg(F.collect_list(F.struct("id", "fixed", "left", "alone")).alias("x")).select(F.lit(_BYTES).alias("kind"), "part", *[F.expr(f"x.{c}").alias(c) for c in ("id", "fixed", "left", "alone")])
    none = {c: F.lit(None).cast(t).alias(c) for c, t in (("piece", "long"), ("n", "long"), ("keys", "binary"), ("data", "binary"), ("id", "array<long>"), ("fixed", "array<double>"), ("left", "array<double>"), ("alone", "array<double>"))}
    sent = ["kind", "part", "step", *none]
    row = lambda df, step: df.withColumn("step", F.lit(step)).select(*[c if c in df.columns or c == "step" else none[c] for c in sent])
    every = row(merged.drop("ids", "ones", "zeros", "log_w", "total", "known"), 0).unionByName(row(lines, 1)).unionByName(row(packed.drop("data"), 2))
    valued = every.repartition("kind", "part").sortWithinPartitions("kind", "part", "step").mapInArrow(_valued(depth, split), _PIECES_SQL)
    both = valued.unionByName(found.where(f"kind = {_TEXTS}")).select("piece", "kind", "part", "n", "data")
    scored = both.repartition("piece").sortWithinPartitions("piece", "kind", "part").mapInArrow(_scored(depth, parts), "doc_id long, n_bytes long, n_tokens long, n_known long, words double, score double")
    return scored.select("doc_id", held_out("doc_id", modulus, held).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), (F.col("words") - F.col("n_tokens") * F.lit(floor)).alias("base_score"), "score", "n_bytes", (-F.col("score") * F.lit(float(np.log2(10))) / (F.col("n_bytes") + 1)).alias("bits_per_byte"))
