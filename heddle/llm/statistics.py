"""Dense statistics of whole texts for the classifiers, counted over all bytes of a batch at once.

Words are runs of bytes other than blanks (0x20, 0x09-0x0D), lines end at line feeds. Every statistic is defined for an
empty text (zeros). The columns follow `NAMES`; shares are of bytes or of words, sizes are logarithms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import keyed, pieces, small_batches, text_bytes

#: Bytes of text that are worked on at once; a longer text is a piece of its own.
PIECE = 1 << 18

#: Words of abuse, lower case without accents, and words that address the reader.
ABUSE = (
    "idiot idiots stupid moron morons loser losers scum trash pathetic worthless disgusting clown clowns dumb fool fools jerk garbage hate "
    "ugly vermin imbecile filth filthy disgrace crap shit bitch bastard asshole fuck fucking retard slut whore kill die dumbass degenerate "
    "subhuman parasite cretin imbecil idiota estupido basura asco imbeciles connard salope merde debile ordure abruti arschloch dumm trottel "
    "abschaum widerlich dreck hurensohn scheisse"
).split()
SECOND_PERSON = "you your yours yourself youre u ur ya tu te toi ton vous votre du dich dir dein deine ihr euch usted tus ustedes".split()

NAMES = (
    "log_bytes log_words log_lines upper digit blank non_ascii exclaim question pipe symbol stop other_punct words_per_line bytes_per_word "
    "long_words capital_words repeated_words distinct_words repeated_lines all_caps_words mixed_words abuse log_abuse abuse_leet near_second second"
).split()

_of = lambda letters: np.isin(np.arange(256), list(letters))
_BLANK = _of(b" \t\n\x0b\x0c\r")
_UPPER, _DIGIT, _LETTER = _of(range(65, 91)), _of(range(48, 58)), _of([*range(65, 91), *range(97, 123), *range(128, 256)])
_CLASSES = [_UPPER, _DIGIT, _BLANK, _of(range(128, 256)), _of(b"!"), _of(b"?"), _of(b"|"), _of(b"#$%&*@~^_=<>+\\/"), _of(b".,;:"), _of(b"\"'()[]{}-`")]
_CLASS_OF = np.zeros(256, np.uint8)
for _k, _c in enumerate(_CLASSES):
    _CLASS_OF[_c] = _k + 1
_SEED = np.random.default_rng(20240229)
_VALUE = _SEED.integers(1, 2**63, 256, dtype=np.uint64)
_PLACE = _SEED.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_LEET = _LOWER.copy()
for _a, _b in zip(b"013457@$!", b"oieastasi", strict=True):
    _LEET[_a] = _b
_PLAIN_VALUE = np.where(_LETTER, _VALUE[_LOWER], np.uint64(0))
_LEET_LETTER = _LETTER | _of(b"013457@$!")
_LEET_VALUE = np.where(_LEET_LETTER, _VALUE[_LEET], np.uint64(0))


def _hash_word(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int((_PLAIN_VALUE[raw] * _PLACE[np.arange(len(raw)) % 64]).sum(dtype=np.uint64))


_ABUSE = np.sort(np.array([_hash_word(w) for w in ABUSE], np.uint64))
_SECOND = np.sort(np.array([_hash_word(w) for w in SECOND_PERSON], np.uint64))


def _known(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def _letter_hash(raw: np.ndarray, starts: np.ndarray, word_of: np.ndarray, letter: np.ndarray, value: np.ndarray) -> np.ndarray:
    """A hash of each word's letters alone, by their places among the letters of the word."""
    at = np.flatnonzero(letter[raw])
    out = np.zeros(len(starts), np.uint64)
    if len(at):
        w = word_of[at]
        new = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        first = np.repeat(new, np.diff(np.r_[new, len(at)]))
        out[w[new]] = np.add.reduceat(value[raw[at]] * _PLACE[(np.arange(len(at)) - first) % 64], new)
    return out


def word_starts(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins, and its text's number."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    blank, size = _BLANK[raw], np.diff(offsets)
    edge = np.zeros(len(raw), bool)
    edge[offsets[:-1][size > 0]] = True
    starts = np.flatnonzero(~blank & (np.r_[True, blank[:-1]] | edge))
    return starts, np.repeat(np.arange(len(size)), size)[starts]


def folded_words(raw: np.ndarray, starts: np.ndarray, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first `lengths` letters of each word and of all its letters, look-alike signs read as letters; 0 where there are fewer."""
    if not len(starts):
        return np.zeros((0, len(lengths)), np.uint64), np.zeros(0, np.uint64)
    at = np.flatnonzero(_LEET_LETTER[raw] & ~_BLANK[raw])
    word = np.searchsorted(starts, at, "right") - 1
    new = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(at) else np.zeros(0, np.int64)
    begin = np.full(len(starts), len(at))
    count = np.zeros(len(starts), np.int64)
    begin[word[new]] = new
    count[word[new]] = np.diff(np.r_[new, len(at)])
    value = np.r_[_LEET_VALUE[raw[at]], np.zeros(max(lengths), np.uint64)]
    out, h = np.zeros((len(starts), len(lengths)), np.uint64), np.zeros(len(starts), np.uint64)
    for k in range(max(lengths)):
        h = h + value[begin + k] * _PLACE[k]
        if k + 1 in lengths:
            c = lengths.index(k + 1)
            out[:, c] = np.where(count > k, _spread(h), np.uint64(0))
    whole = np.zeros(len(starts), np.uint64)
    if len(at):
        place = (np.arange(len(at)) - np.repeat(new, np.diff(np.r_[new, len(at)]))) % 64
        whole[word[new]] = np.add.reduceat(value[: len(at)] * _PLACE[place], new)
    return out, np.where(count > 0, _spread(whole), np.uint64(0))


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of NAMES for each text of a batch; at most 65,536 texts at a time."""
    n = len(offsets) - 1
    out = np.zeros((n, len(NAMES)), np.float64)
    size = np.diff(offsets)
    if not len(raw):
        return out
    doc_of = np.repeat(np.arange(n), size)
    per = np.bincount(doc_of * 16 + _CLASS_OF[raw], minlength=n * 16).reshape(n, 16)[:, 1 : len(_CLASSES) + 1]
    blank = _BLANK[raw]
    edge = np.zeros(len(raw), bool)
    edge[offsets[:-1][size > 0]] = True
    begins = ~blank & (np.r_[True, blank[:-1]] | edge)
    starts = np.flatnonzero(begins)
    lines = np.bincount(doc_of[raw == 10], minlength=n) + (size > 0)
    some = np.maximum(size, 1)
    out[:, 0] = np.log1p(size)
    out[:, 2] = np.log1p(lines)
    out[:, 3:13] = per / some[:, None]
    if not len(starts):
        return out
    word_of = np.cumsum(begins) - 1
    in_word = np.where(blank, len(starts), word_of)
    length = np.bincount(in_word, minlength=len(starts) + 1)[: len(starts)]
    doc = doc_of[starts]
    words = np.bincount(doc, minlength=n)
    many = np.maximum(words, 1)
    upper = np.bincount(in_word[_UPPER[raw]], minlength=len(starts))[: len(starts)]
    letters = np.bincount(in_word[_LETTER[raw]], minlength=len(starts))[: len(starts)]
    word_of = np.where(blank, 0, word_of)
    plain = _letter_hash(raw, starts, word_of, _LETTER & ~_BLANK, _PLAIN_VALUE)
    leet = _letter_hash(raw, starts, word_of, _LEET_LETTER, _LEET_VALUE)
    same_doc = np.r_[False, doc[1:] == doc[:-1]]
    count = lambda mask: np.bincount(doc[mask], minlength=n)
    out[:, 1] = np.log1p(words)
    out[:, 13] = np.log1p(words / np.maximum(lines, 1))
    out[:, 14] = np.bincount(doc, length, minlength=n) / many
    out[:, 15] = count(length >= 14) / many
    out[:, 16] = count(_UPPER[raw[starts]]) / many
    out[:, 17] = count(same_doc & np.r_[False, plain[1:] == plain[:-1]]) / many
    distinct = np.unique((doc.astype(np.uint64) << np.uint64(48)) | (plain >> np.uint64(16)))
    out[:, 18] = np.bincount((distinct >> np.uint64(48)).astype(np.int64), minlength=n) / many
    line_of = np.cumsum((raw == 10) | edge)[starts]
    first = np.flatnonzero(np.r_[True, line_of[1:] != line_of[:-1]])
    place = np.arange(len(starts)) - np.repeat(first, np.diff(np.r_[first, len(starts)]))
    line_hash = np.add.reduceat(plain * _PLACE[place % 64], first)
    held = np.bincount(doc[first], minlength=n)
    distinct = np.unique((doc[first].astype(np.uint64) << np.uint64(48)) | (line_hash >> np.uint64(16)))
    out[:, 19] = (held - np.bincount((distinct >> np.uint64(48)).astype(np.int64), minlength=n)) / np.maximum(held, 1)
    out[:, 20] = count((upper == letters) & (letters >= 2)) / many
    out[:, 21] = count((letters > 0) & (letters < length - 3)) / many
    bad, odd = _known(_ABUSE, plain), _known(_ABUSE, leet)
    second = _known(_SECOND, plain)
    hits = count(bad | odd)
    out[:, 22] = hits / many
    out[:, 23] = np.log1p(hits)
    out[:, 24] = count(odd & ~bad) / many
    if (at := np.flatnonzero(bad | odd)).size and (you := np.flatnonzero(second)).size:
        k = np.searchsorted(you, at)
        near = np.zeros(len(at), bool)
        for j in (np.maximum(k - 1, 0), np.minimum(k, len(you) - 1)):
            near |= (np.abs(you[j] - at) <= 5) & (doc[you[j]] == doc[at])
        out[:, 25] = np.bincount(doc[at[near]], minlength=n) / many
    out[:, 26] = count(second) / many
    return out


def with_statistics(docs: DataFrame, id_col: str, text_col: str, row_sql: str = "0", more=None) -> DataFrame:
    """(doc_id, x): the statistics of each row's whole text as array<float>, then more(raw, offsets, row): a matrix, with row from `row_sql` over doc_id."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, PIECE):
            raw, offsets = text_bytes(b.column(1))
            x = statistics(raw, offsets)
            if more is not None:
                x = np.c_[x, more(raw, offsets, np.asarray(b.column(2)))]
            x = x.astype(np.float32)
            ends = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, x.ravel())], schema=schema)

    d = keyed(docs, id_col, text_col)
    return d.select("doc_id", "text", F.expr(row_sql).cast("int").alias("row")).mapInArrow(run, "doc_id long, x array<float>")
