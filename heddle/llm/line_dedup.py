"""Line deduplication by winnowing over line hashes.

A text is cut at line feeds; lines are compared without surrounding blanks, and blank lines are passed over. From each line
starts a window: the fewest consecutive non-blank lines that hold `min_words` words. Winnowing selects in each window the
line with the smallest hash (the last of equals). Equal windows select the same line, so two runs that share at least
`min_words` words of whole lines share a selected line hash: the guarantee.

With `extended`, the fewest lines that END at each line and hold `min_words` words are windows too. A common run of at least
`min_words` words is then covered to its last line: where fewer words than that are left of it, the window that ends at its
last line lies in it. Without, lines at the end of a run that hold fewer words stay.

1. One pass emits each window with its selected line: (row, first line, last line, selected hash, window hash).
2. Selected lines that occur at one position only cannot repeat; their windows go. Counts are summed before the shuffle.
3. Positions of one selected line join. A pair of positions is never made: every window that selects the line is one way
   to extend it to both sides, and positions whose extension agrees (128 bits of its content) meet. Windows that overlap
   chain to the whole run, whichever earlier text each of them comes from. The first position (doc_id, line) of each window stays: a
   minimum that is also summed before the shuffle, so that no list of positions and no pair of positions is ever made.
4. Lines of all other occurrences are deleted from their texts, with the line feed behind them.

Edge cases: a null or empty text stays as it is; fewer words than `min_words` never repeat. A line of any length counts as
one line; very long texts are handled one at a time. Ties cannot occur: positions are distinct, but for rows with the same
id and the same text, which count as one row and keep their text alike. Rows with one id and different texts are told
apart by the hash of the text; the order between them is by that hash. A null id sorts first. Other columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import free_name, small_batches, written

MIN_WORDS = 20
_WINDOWS = "doc_id long, mark long, first int, last int, at int, fingerprint long, key binary"


def line_windows(text: str, min_words: int, extended: bool = False) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(first line, last line, selected line, its hash, hash of the content) of each window of a text."""
    kept, hashes, words, whole = [], [], [], []
    for k, line in enumerate(text.split("\n")):
        if line := line.strip():
            digest = hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=16).digest()
            kept.append(k)
            whole.append(digest)
            hashes.append(int.from_bytes(digest[:8], "little", signed=True))
            words.append(len(line.split()))

    def window(start: int, stop: int) -> tuple[int, int, int, int, bytes]:
        at = min(range(start, stop), key=lambda i: (hashes[i], -i))
        key = whole[start] if stop - start == 1 else hashlib.blake2b(b"".join(whole[start:stop]), digest_size=16).digest()
        return kept[start], kept[stop - 1], kept[at], hashes[at], key

    stop, held, n = 0, 0, len(kept)
    for start in range(n):
        while stop < n and held < min_words:
            held += words[stop]
            stop += 1
        if held < min_words:
            break
        yield window(start, stop)
        held -= words[start]
    start, held = 0, 0
    for end in range(n if extended else 0):
        held += words[end]
        while held - words[start] >= min_words:
            held -= words[start]
            start += 1
        if held >= min_words and held - words[end] >= min_words:  # else it is met above, or too short
            yield window(start, end + 1)


def _emit(min_words: int, extended: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("at", pa.int32()), ("fingerprint", pa.int64()), ("key", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, m, *w) for i, m, t in zip(*(c.to_pylist() for c in b.columns), strict=True) for w in line_windows(t, min_words, extended)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _without(text: str, spans: list) -> str:
    lines = text.split("\n")
    gone = {k for s in spans for k in range(s["first"], s["last"] + 1)}
    return "\n".join(x for k, x in enumerate(lines) if k not in gone or not x.strip())


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, extended: bool = False) -> DataFrame:
    """(doc_id, mark, spans): lines to delete per text, as sorted spans (first, last); mark is xxhash64 of the text."""
    small_batches(docs.sparkSession)
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("mark"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null")
    windows = written(d.mapInArrow(_emit(min_words, extended), _WINDOWS), "line-windows")
    place = F.struct("doc_id", "mark", "at")
    several = windows.groupBy("fingerprint").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("fingerprint")
    left = windows.join(several, "fingerprint", "left_semi")
    where = F.struct("doc_id", "mark", "first")
    first = left.groupBy("key").agg(F.min(where).alias("kept"), F.max(where).alias("other")).where("kept <> other").select("key", "kept")
    later = left.join(first, "key").where(where != F.col("kept")).select("doc_id", "mark", "first", "last").distinct()
    return later.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, extended: bool = False) -> DataFrame:
    """docs with later repeated runs deleted from the text, plus __n_deleted (lines; under a longer name where docs has that one, always the last column); other columns unchanged."""
    doc, mark, spans, deleted = (free_name(docs, n) for n in ("__doc", "__mark", "__spans", "__n_deleted"))
    runs = repeated_runs(docs, id_col, text_col, min_words, extended).toDF(doc, mark, spans)
    text = F.col(f"`{text_col}`").cast("string")

    @F.arrow_udf("string")
    def cut(texts: pa.Array, runs: pa.Array) -> pa.Array:
        return pa.array([None if r is None else _without(t, r) for t, r in zip(texts.to_pylist(), runs.to_pylist(), strict=True)], pa.string())

    joined = docs.join(runs, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(text) == F.col(mark)), "left")
    gone = F.coalesce(F.expr(f"aggregate({spans}, struct(0 as n, -1 as upto), (a, s) -> struct(a.n + greatest(s.last - greatest(s.first - 1, a.upto), 0) as n, greatest(a.upto, s.last) as upto), a -> a.n)"), F.lit(0))
    changed = F.when(F.col(spans).isNotNull(), text)
    new = [F.coalesce(cut(changed, F.col(spans)), text).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*new, gone.alias(deleted))
