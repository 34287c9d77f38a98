"""What words are counted with, in two steps: tallies of a task's sentences, and their sums word by word.

A task keeps the counts of the sentences that it reads under small numbers and sends a row a word, with all neighbours of the
word and their counts in it (a row a pair took four times the bytes). The rows of a word meet in one task, which adds them, keeps
the first `top` entries of each list and lets go of the rest. Both steps hold a bounded number of bytes; a word with more has its
rows added up as they come.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Kinds of rows: a word's totals with its first sentence and its neighbours, another surface, a source, a document whose sentences do not lie together.
TOTAL, SURFACE, SOURCE, DOCUMENT = range(4)
#: near: neighbours in order, behind line feeds, which no token holds; counts: for each how often it stands behind and before the word.
TALLY = "word string, kind int, key string, n long, m long, docs long, source_id string, document_id string, sentence_id long, near string, counts binary"
_TALLY = pa.schema([("word", pa.string()), ("kind", pa.int32()), ("key", pa.string()), ("n", pa.int64()), ("m", pa.int64()), ("docs", pa.int64()), ("source_id", pa.string()), ("document_id", pa.string()), ("sentence_id", pa.int64()), ("near", pa.string()), ("counts", pa.binary())])
LIST = "array<struct<key: string, n: long>>"
SUMS = f"word string, frequency long, doc_freq long, sent_freq long, source_count long, surface_forms {LIST}, left {LIST}, right {LIST}, neighbours {LIST}, snippet string, pairs long, partner string, partner_n long"
_LIST = pa.list_(pa.struct([("key", pa.string()), ("n", pa.int64())]))
_SUMS = pa.schema([("word", pa.string()), *[(c, pa.int64()) for c in ("frequency", "doc_freq", "sent_freq", "source_count")], *[(c, _LIST) for c in ("surface_forms", "left", "right", "neighbours")], ("snippet", pa.string()), ("pairs", pa.int64()), ("partner", pa.string()), ("partner_n", pa.int64())])
#: Rows that are held before they are added up or sent.
RAW_PAIRS, PAIRS, WORDS, CHUNK, ROWS = 2_000_000, 3_000_000, 300_000, 16 << 20, 20_000
LOW = (1 << 32) - 1


def _rows(schema: pa.Schema, rows: int, /, **columns) -> Iterator[pa.RecordBatch]:
    """Batches of so many rows; columns that are not given are null."""
    made = [columns.get(f.name, pa.nulls(rows, f.type)) for f in schema]
    made = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(made, schema, strict=True)]
    yield from pa.Table.from_arrays(made, schema=schema).to_batches(ROWS)


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their sums."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(n, at) if len(at) else n


def _packed(w: np.ndarray, key: pa.Array, n: np.ndarray, m: np.ndarray, words: int) -> tuple[pa.Array, pa.Array]:
    """(near, counts) of each word; w in order."""
    ends = np.searchsorted(w, np.arange(words + 1))
    near = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), key), "\n")
    counts = np.stack([n, m], 1).astype(np.uint32)
    return near, pa.Array.from_buffers(pa.binary(), words, [None, pa.py_buffer((ends * 8).astype(np.int32)), pa.py_buffer(counts)])


def _flat(w: np.ndarray, near: pa.Array, counts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(w, key, n, m) of all neighbours of rows."""
    held = pc.greater(pc.binary_length(near), 0)
    near, w = near.filter(held), w[held.to_numpy(zero_copy_only=False)]
    keys = pc.split_pattern(near, "\n")
    flat = counts.filter(held)
    both = np.frombuffer(b"".join(flat.to_pylist()), np.uint32).reshape(-1, 2).astype(np.int64)
    return np.repeat(w, pc.list_value_length(keys).to_numpy()), keys.flatten(), both[:, 0], both[:, 1]


def _added(w: np.ndarray, key: pa.Array, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """The same with each (w, key) once, in order of w."""
    coded = key.dictionary_encode()
    v = max(len(coded.dictionary), 1)
    both, inverse = np.unique(w * v + coded.indices.to_numpy(), return_inverse=True)
    n, m = (np.bincount(inverse, x, len(both)).astype(np.int64) for x in (n, m))
    return both // v, coded.dictionary.take(pa.array(both % v)), n, m


class _Tally:
    """Counts of a task's sentences until they are sent."""

    def __init__(self, window: int):
        self.window = window
        #: The document whose sentences are being read: id, sentences seen, sentences it has, its words.
        self.open: tuple | None = None
        self.clear()

    def clear(self) -> None:
        kept = [self.names[c] for c in self.open[3]] if self.open else []
        self.codes: dict[str, int] = {w: k for k, w in enumerate(kept)}
        self.names: list[str] = list(kept)
        self.count = np.zeros((3, 1024), np.int64)  # occurrences, sentences, documents that lie together
        self.first: dict[int, tuple] = {}
        self.surfaces: Counter = Counter()
        self.sources: dict[str, list] = {}
        self.scattered: list[tuple] = []
        self.raw: list[np.ndarray] = []
        self.pairs = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if self.open:
            self.open = (*self.open[:3], np.arange(len(kept)))

    def _coded(self, words: list[str]) -> np.ndarray:
        out = np.empty(len(words), np.int64)
        for k, w in enumerate(words):
            c = self.codes.get(w)
            if c is None:
                c = self.codes[w] = len(self.names)
                self.names.append(w)
            out[k] = c
        if len(self.names) > self.count.shape[1]:
            self.count = np.concatenate([self.count, np.zeros((3, len(self.names)), np.int64)], 1)
        return out

    def add(self, b: pa.RecordBatch) -> None:
        source, document, sentence, text, surfaces, tokens, n_doc = b.columns
        said = tokens.flatten().dictionary_encode()
        lens = np.diff(tokens.offsets.to_numpy())
        code = self._coded(said.dictionary.to_pylist())[said.indices.to_numpy()]
        row = np.repeat(np.arange(b.num_rows), lens)
        self.count[0] += np.bincount(code, minlength=self.count.shape[1])
        once = np.unique(row << 32 | code)
        at, word = once >> 32, once & LOW
        self.count[1] += np.bincount(word, minlength=self.count.shape[1])
        for d in range(1, self.window + 1):
            near = row[d:] == row[:-d]
            self.raw.append(code[:-d][near] << 32 | code[d:][near])
        if sum(map(len, self.raw)) > RAW_PAIRS:
            self._fold()
        for k in np.flatnonzero(surfaces.is_valid().to_numpy(zero_copy_only=False)).tolist():
            self.surfaces.update((t, s) for t, s in zip(tokens[k].as_py(), surfaces[k].as_py(), strict=True) if s != t)
        named = source.dictionary_encode()
        both = np.unique(named.indices.to_numpy(zero_copy_only=False)[at].astype(np.int64) << 32 | word)
        for k, name in enumerate(named.dictionary.to_pylist()):
            lo, hi = np.searchsorted(both, [k << 32, (k + 1) << 32])
            self.sources.setdefault(name, []).append(both[lo:hi] & LOW)
        self._documents(document, n_doc, at, word)
        # of the batch's sentences the first one of each word, by place
        order = pc.sort_indices(pa.table({"a": source, "b": document, "c": sentence}), sort_keys=[("a", "ascending"), ("b", "ascending"), ("c", "ascending")], null_placement="at_start").to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        by = np.lexsort((rank[at], word))
        lead = np.flatnonzero(np.r_[True, word[by][1:] != word[by][:-1]]) if len(by) else by
        sources, documents, sentences = source.to_pylist(), document.to_pylist(), sentence.to_pylist()
        texts = text.to_pylist()
        for c, k in zip(word[by][lead].tolist(), at[by][lead].tolist(), strict=True):
            # an absent id stands before all others
            place = (sources[k], documents[k] is not None, documents[k] or "", sentences[k])
            if c not in self.first or place < self.first[c][0]:
                self.first[c] = (place, texts[k])

    def _documents(self, document: pa.Array, n_doc: pa.Array, at: np.ndarray, word: np.ndarray) -> None:
        """Documents of one run of sentences are counted; the words of others are kept with their ids."""
        named = document.dictionary_encode(null_encoding="encode")
        index, names, sizes = named.indices.to_numpy(), named.dictionary.to_pylist(), n_doc.to_numpy()
        starts = np.flatnonzero(np.r_[True, index[1:] != index[:-1]])
        run = np.cumsum(np.r_[0, (index[1:] != index[:-1]).astype(np.int64)])
        runs = [[names[index[s]], n, int(sizes[s])] for s, n in zip(starts.tolist(), np.bincount(run).tolist(), strict=True)]
        own = run[at]
        if self.open:
            name, seen, size, words = self.open
            if name == runs[0][0]:
                runs[0][1] += seen
            else:
                runs.insert(0, [name, seen, size])
                own = own + 1
            own, word = np.r_[np.zeros(len(words), np.int64), own], np.r_[words, word]
        once = np.unique(own << 32 | word)
        ends = np.searchsorted(once, np.arange(len(runs) + 1) << 32)
        together = np.array([seen == size for _, seen, size in runs])
        together[-1] = False  # may go on
        self.count[2] += np.bincount((once & LOW)[together[once >> 32]], minlength=self.count.shape[1])
        for k in np.flatnonzero(~together[:-1]).tolist():
            self.scattered.append((runs[k][0], once[ends[k] : ends[k + 1]] & LOW))
        self.open = (*runs[-1], once[ends[-2] : ends[-1]] & LOW)

    def close(self) -> None:
        if self.open:
            name, seen, size, words = self.open
            if seen == size:
                self.count[2, words] += 1
            else:
                self.scattered.append((name, words))
            self.open = None

    def _fold(self) -> None:
        if self.raw:
            new = np.concatenate(self.raw)
            self.pairs = summed(np.r_[self.pairs[0], new], np.r_[self.pairs[1], np.ones(len(new), np.int64)])
            self.raw = []

    def full(self) -> bool:
        return len(self.names) > WORDS or len(self.pairs[0]) > PAIRS

    def sent(self) -> Iterator[pa.RecordBatch]:
        self._fold()
        names = pa.array(self.names, pa.string())
        places = [self.first.get(k) for k in range(len(self.names))]
        at = lambda k: [p and p[0][k] for p in places]
        v = len(self.names)
        documents = [p[0][2] if p and p[0][1] else None for p in places]
        keys, n = self.pairs
        a, b, none = keys >> 32, keys & LOW, np.zeros(len(keys), np.int64)
        both, n = np.r_[keys, b << 32 | a], (np.r_[n, none], np.r_[none, n])
        order = np.argsort(both, kind="stable")
        # those that stand on both sides are one
        new = np.flatnonzero(np.r_[True, np.diff(both[order]) != 0]) if len(order) else order
        both, (after, before) = both[order][new], (np.add.reduceat(x[order], new) if len(new) else x for x in n)
        ends = np.searchsorted(both >> 32, np.arange(0, v + ROWS, ROWS))
        total = dict(word=names, key=pa.array([p and p[1] for p in places], pa.string()), n=self.count[0, :v], m=self.count[1, :v], docs=self.count[2, :v], source_id=pa.array(at(0), pa.string()), document_id=pa.array(documents, pa.string()), sentence_id=pa.array(at(3), pa.int64()))
        for k, s in enumerate(range(0, v, ROWS)):
            cut, rows = slice(ends[k], ends[k + 1]), min(ROWS, v - s)
            near, counts = _packed((both[cut] >> 32) - s, names.take(pa.array(both[cut] & LOW)), after[cut], before[cut], rows)
            yield from _rows(_TALLY, rows, kind=np.full(rows, TOTAL, np.int32), near=near, counts=counts, **{c: x[s : s + rows] for c, x in total.items()})
        if self.surfaces:
            yield from _rows(_TALLY, len(self.surfaces), word=[t for t, _ in self.surfaces], kind=np.full(len(self.surfaces), SURFACE, np.int32), key=[s for _, s in self.surfaces], n=list(self.surfaces.values()))
        for name, found in self.sources.items():
            words = np.unique(np.concatenate(found))
            yield from _rows(_TALLY, len(words), word=names.take(pa.array(words)), kind=np.full(len(words), SOURCE, np.int32), key=[name] * len(words))
        for name, words in self.scattered:
            yield from _rows(_TALLY, len(words), word=names.take(pa.array(words)), kind=np.full(len(words), DOCUMENT, np.int32), key=[name] * len(words))
        self.clear()


def tallies(window: int):
    """Rows TALLY of sentences (source_id, document_id, sentence_id, text, surfaces or null if they are the tokens, tokens, sentences of the document)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally(window)
        for b in batches:
            if b.num_rows:
                tally.add(b)
                if tally.full():
                    yield from tally.sent()
        tally.close()
        yield from tally.sent()

    return run


def _top(w: np.ndarray, key: pa.Array, n: np.ndarray, words: int, k: int) -> pa.Array:
    """For each word the k keys with the largest n, ties by key; null without any."""
    coded = key.dictionary_encode()
    rank = np.empty(len(coded.dictionary), np.int64)
    rank[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(rank))
    order = np.lexsort((rank[coded.indices.to_numpy()], -n, w))
    w = w[order]
    place = np.arange(len(w)) - np.searchsorted(w, w)
    order, w = order[place < k], w[place < k]
    values = pa.StructArray.from_arrays([key.take(pa.array(order)), pa.array(n[order])], fields=list(_LIST.value_type))
    ends = np.searchsorted(w, np.arange(words + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), values, type=_LIST, mask=pa.array(ends[1:] == ends[:-1]))


def _fewer(t: pa.Table) -> pa.Table:
    """Rows of one hash with the same sums: the first sentence, counts and neighbours of each word in one row, other rows once each."""
    total, rest = t.filter(pc.equal(t["kind"], TOTAL)), t.filter(pc.not_equal(t["kind"], TOTAL))
    g = rest.group_by(["h", "word", "kind", "key"]).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})
    made = [g.select([f for f in ("h", "word", "kind", "key", "n")])]
    for word in pc.unique(total["word"]).to_pylist():
        own = total.filter(pc.equal(total["word"], word))
        first = own.filter(pc.greater(own["n"], 0))
        first = first.take(pc.sort_indices(first, sort_keys=[(c, "ascending") for c in ("source_id", "document_id", "sentence_id")], null_placement="at_start")).slice(0, 1)
        if not first.num_rows:
            first = own.slice(0, 1)
        near, counts = _packed(*_added(*_flat(np.zeros(own.num_rows, np.int64), own["near"].combine_chunks(), own["counts"].combine_chunks())), 1)
        for name, c in {**{c: pa.array([pc.sum(own[c]).as_py()], pa.int64()) for c in ("n", "m", "docs")}, "near": near, "counts": counts}.items():
            first = first.set_column(first.schema.get_field_index(name), name, c)
        made.append(first)
    return pa.concat_tables(made, promote_options="default").select(t.schema.names)


def sums(top: int, least: int):
    """Rows SUMS of the tallies (h, and TALLY) sorted by h, a hash of the word: one for each word, and one for each partner with `least` pairs."""

    def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
        coded = t["word"].combine_chunks().dictionary_encode()
        names, words = coded.dictionary, len(coded.dictionary)
        t = t.append_column("w", pa.array(coded.indices.to_numpy(), pa.int64()))
        kind = t["kind"].to_numpy()
        part = {k: t.filter(pa.array(kind == k)) for k in (TOTAL, SURFACE, SOURCE, DOCUMENT)}
        total = part[TOTAL]
        w = total["w"].to_numpy()
        frequency, sentences, documents = (np.bincount(w, total[c].to_numpy(), words).astype(np.int64) for c in ("n", "m", "docs"))
        firsts = total.filter(pc.greater(total["n"], 0))
        firsts = firsts.take(pc.sort_indices(firsts, sort_keys=[(c, "ascending") for c in ("w", "source_id", "document_id", "sentence_id")], null_placement="at_start"))
        snippet = firsts["key"].combine_chunks().take(pa.array(np.searchsorted(firsts["w"].to_numpy(), np.arange(words))))
        kinds = {}
        for k in (SOURCE, DOCUMENT):
            seen = part[k].group_by(["w", "key"]).aggregate([])
            kinds[k] = np.bincount(seen["w"].to_numpy(), minlength=words)
        other = part[SURFACE].group_by(["word", "key"]).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})
        if not other.num_rows:
            keys, of, n = names, np.arange(words), frequency
        else:
            of_other = pc.index_in(other["word"].combine_chunks(), names).to_numpy().astype(np.int64)
            own = frequency - np.bincount(of_other, other["n"].to_numpy(), words).astype(np.int64)
            keys, of, n = pa.concat_arrays([names, other["key"].combine_chunks()]), np.r_[np.arange(words), of_other], np.r_[own, other["n"].to_numpy()]
            keys, of, n = keys.filter(pa.array(n > 0)), of[n > 0], n[n > 0]
        surfaces = _top(of, keys, n, words, top)
        w, key, right, left = _added(*_flat(total["w"].to_numpy(), total["near"].combine_chunks(), total["counts"].combine_chunks()))
        # a word is no partner of itself
        coded = key.dictionary_encode()
        apart = pc.index_in(coded.dictionary, names).fill_null(-1).to_numpy()[coded.indices.to_numpy()] != w
        sides = [_top(w[x], key.filter(pa.array(x)), n[x], words, top) for n, x in ((left, left > 0), (right, right > 0), (left + right, apart))]
        partners = np.where(apart, left + right, 0)
        pairs = np.bincount(w, partners, words).astype(np.int64)
        yield from _rows(_SUMS, words, word=names, frequency=frequency, doc_freq=documents + kinds[DOCUMENT], sent_freq=sentences, source_count=kinds[SOURCE], surface_forms=surfaces, left=sides[0], right=sides[1], neighbours=sides[2], snippet=snippet, pairs=pairs)
        often = np.flatnonzero((partners >= max(least, 1)) & (frequency[w] >= least))
        if len(often):
            yield from _rows(_SUMS, len(often), word=names.take(pa.array(w[often])), frequency=frequency[w[often]], partner=key.take(pa.array(often)), partner_n=partners[often])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, held, most = [], 0, CHUNK
        for b in batches:
            if not b.num_rows:
                continue
            rest.append(pa.Table.from_batches([b]))
            held += b.nbytes
            if held < most:
                continue
            t = pa.concat_tables(rest)
            h = t["h"].to_numpy()
            cut = int(np.flatnonzero(np.r_[True, h[1:] != h[:-1]])[-1])
            if cut:
                yield from done(t.slice(0, cut))
                t = t.slice(cut)
            else:  # one word in very many rows
                t = _fewer(t)
            rest, held = [t], t.nbytes
            most = max(CHUNK, 2 * held)
        if held:
            yield from done(pa.concat_tables(rest))

    return run
