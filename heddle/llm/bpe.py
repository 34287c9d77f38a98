"""Byte-level BPE encoding and decoding with a given vocabulary file.

A text is split at special tokens, then by the byte-level pattern into words; each word is merged on its own. For a short
word, one contiguous array holds the part boundaries and a second one the rank of each adjacent pair of parts: the smallest
rank is found by scanning, its boundary is deleted, and the two neighbouring ranks are looked up anew. Words longer than
`SCAN` bytes take a heap over a linked list instead, as scanning grows with the square of the length; both give the same
parts. Words recur, so each task keeps a bounded table of the words that it has merged; texts are taken in pieces of 1 MB.

The result equals the tokenizers library's encode (no special tokens added) and decode (none skipped). Edge cases: null and
empty texts have no ids; a special token's string in a text is that token, as in the library; rows are independent, so
ties, repeated rows, empty tables and other columns have no effect.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from heddle.llm.common import keyed, pieces, small_batches

#: The split pattern of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SCAN = 256
#: Words that a task keeps at most; then it starts anew. About 100 MB.
KEPT_WORDS = 400_000
#: Bytes of text that are worked on at once.
PIECE = 1 << 20


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the file: bytes that print stand for themselves, the rest follow 255 in order."""
    prints = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


class Codec:
    """Encodes and decodes; made once in each worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in enumerate(byte_letters())}
        raw = lambda token: bytes(back[c] for c in token)
        model = spec["model"]
        self.ids = {raw(t): k for t, k in model["vocab"].items()}
        self.pairs: dict[tuple[bytes, bytes], int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs[raw(a), raw(b)] = rank
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {k: t for t, k in self.ids.items()} | {k: t.encode() for t, k in self.special.items()}
        self.split = regex.compile(PATTERN)
        self.at_special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.known: dict[str, tuple[int, ...]] = {}

    def parts(self, word: bytes) -> list[bytes]:
        """The parts of a word after all merges."""
        if len(word) > SCAN:
            return self._long(word)
        none, rank_of = len(self.pairs), self.pairs.get
        bounds = list(range(len(word) + 1))
        ranks = [rank_of((word[i : i + 1], word[i + 1 : i + 2]), none) for i in range(len(word) - 1)]
        while ranks:
            low = min(ranks)
            if low == none:
                break
            k = ranks.index(low)
            del bounds[k + 1], ranks[k]
            part = word[bounds[k] : bounds[k + 1]]
            if k:
                ranks[k - 1] = rank_of((word[bounds[k - 1] : bounds[k]], part), none)
            if k < len(ranks):
                ranks[k] = rank_of((part, word[bounds[k + 1] : bounds[k + 2]]), none)
        return [word[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def _long(self, word: bytes) -> list[bytes]:
        n, rank_of = len(word), self.pairs.get
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank_of((word[i : i + 1], word[i + 1 : i + 2]))) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\1") * n
        while heap:
            _, i, j, stop = heapq.heappop(heap)
            if not alive[i] or end[i] != j or j >= n or not alive[j] or end[j] != stop:
                continue
            alive[j], end[i] = 0, stop
            if stop < n:
                before[stop] = i
                if (r := rank_of((word[i:stop], word[stop : end[stop]]))) is not None:
                    heapq.heappush(heap, (r, i, stop, end[stop]))
            if (p := before[i]) >= 0 and (r := rank_of((word[p:i], word[i:stop]))) is not None:
                heapq.heappush(heap, (r, p, i, stop))
        out, i = [], 0
        while i < n:
            out.append(word[i : end[i]])
            i = end[i]
        return out

    def _word(self, word: str) -> tuple[int, ...]:
        found = tuple(self.ids[p] for p in self.parts(word.encode("utf-8", "replace")))
        if len(word) <= 64:
            if len(self.known) >= KEPT_WORDS:
                self.known.clear()
            self.known[word] = found
        return found

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        known = self.known
        for piece in self.at_special.split(text) if self.at_special else [text]:
            if piece in self.special:
                ids.append(self.special[piece])
            else:
                for word in self.split.findall(piece):
                    ids += known.get(word) or self._word(word)
        return ids

    def decode(self, ids: list[int]) -> str:
        of = self.bytes_of
        return b"".join([of[k] for k in ids]).decode("utf-8", "replace")


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, digests: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids and the decoded text; with digests, their SHA-256 in their place. The vocabulary's path must exist on every executor."""
    small_batches(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), *([("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] if digests else [("ids", pa.list_(pa.int32())), ("decoded", pa.string())])]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        sha = lambda s: hashlib.sha256(s).hexdigest()
        try:
            for b in pieces(batches, PIECE):
                rows = []
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    ids = c.encode(text)
                    back = c.decode(ids)
                    rows.append((doc, len(ids), sha(str(ids)[1:-1].replace(" ", "").encode()), sha(back.encode())) if digests else (doc, len(ids), ids, back))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, schema, strict=True)], schema=schema)
        finally:
            c.known.clear()  # the worker lives on for other stages

    kinds = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")
    return keyed(docs, id_col, text_col).mapInArrow(run, kinds)
