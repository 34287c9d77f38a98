"""Secret scans with a recursive decoding worklist.

Each text is scanned for three kinds of secrets. Then nested encodings are unwrapped: percent escapes, \\u and \\x escapes,
base64 (usual and URL alphabet), and gzip, zlib, bzip2 or xz data inside base64. Each decoded layer goes on a worklist, is
scanned for the same kinds and searched for further encodings, until nothing new comes out. A layer is not entered again if
the same content was met at the same place of the text before, which ends cycles; at another place it is. Escapes inside
escapes are a layer each down to LEVELS of them; what lies deeper is resolved to its fixpoint in one pass, which is the next layer. A match in a layer is mapped back to the span of the
original text that it was decoded from: character by character for escapes, the whole encoded run for base64.

Base matches of a text always stay; layers add spans. Positions are code points, ends exclusive.

Edge cases: null and empty texts have no spans. Whole texts are scanned, one at a time, whatever their length. All members of
compressed layers are read, and what stands behind them. Content above WINDOW bytes is read in windows that overlap by OVERLAP bytes
and is never held whole, so a decompression bomb takes time in proportion to its content, but no memory; encoded runs inside such
content that are longer than OVERLAP are read in parts. Rows are independent: ties, repeated rows, empty tables and other columns
have no effect.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from heddle.llm.common import keyed, small_batches

KINDS = ("assign", "access", "hex")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_CUES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|(?:\\u[0-9A-Fa-f]{4})+|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_ODD = re.compile("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f\ufffd]+")
#: Levels of escapes in escapes that are layers of their own.
LEVELS = 8
#: Bytes of compressed content that are one text; longer content is read in windows of this size, which overlap.
WINDOW = 4 << 20
OVERLAP = 1 << 20
#: Bytes that a decompressor gives at once, and the most that an xz dictionary may take.
CHUNK = 1 << 18
DICTIONARY = 128 << 20
#: Layers of compression, each longer than a window, that are read through one another at once.
STREAMS = 64
_HEX_SIGNS = frozenset("0123456789abcdefABCDEF")
_TAIL = re.compile(r"(?:\\x([0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\u\{([0-9A-Fa-f]{1,6})\})$")
_GLUE = re.compile(r"[/_-]")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/])(?:[A-Za-z0-9+/]{16,}\r?\n)+[A-Za-z0-9+/]+={0,2}")
_flags = lambda letters: bytes(49 if b in letters else 48 for b in range(256))
_IS_HEX = _flags(b"0123456789abcdef")
_IS_64 = _flags(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of all base matches of a text, sorted."""
    found = []
    low = text.lower()
    if any(c in low for c in _CUES):
        found += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"1" * 24 in text.encode("utf-8", "replace").translate(_IS_HEX):
        found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(found)


class _Layer:
    """A decoded text and where each part of it came from: pieces (start here, start and end in the original)."""

    def __init__(self, text: str, at: list[int], origin: list[tuple[int, int]], exact: list[bool], level: int = 0):
        self.text, self.at, self.origin, self.exact, self.level = text, at, origin, exact, level

    def back(self, start: int, end: int) -> tuple[int, int]:
        """The span of the original text that holds [start, end) of this layer."""
        a, b = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        first = self.origin[a][0] + (start - self.at[a] if self.exact[a] else 0)
        last = self.origin[b][0] + (end - self.at[b]) if self.exact[b] else self.origin[b][1]
        return first, last


def _rewritten(layer: _Layer, pattern: re.Pattern, decode) -> _Layer | None:
    """The layer with each match replaced by what decode() makes of it: a list of (text, start, end in the match), or None."""
    return _replaced(layer, ((m.start(), m.end(), decode(m)) for m in pattern.finditer(layer.text)))


def _replaced(layer: _Layer, regions) -> _Layer | None:
    """The layer with regions (start, end, parts) replaced; parts as of decode(). None if nothing changes."""
    parts, at, origin, exact, upto, size, changed = [], [], [], [], 0, 0, False

    def copy(stop: int) -> None:
        nonlocal upto, size
        while upto < stop:
            k = bisect_right(layer.at, upto) - 1
            end = min(stop, layer.at[k + 1] if k + 1 < len(layer.at) else len(layer.text))
            at.append(size)
            origin.append(layer.back(upto, end))
            exact.append(layer.exact[k])
            parts.append(layer.text[upto:end])
            size += end - upto
            upto = end

    for start, end, made in regions:
        if made is None:
            continue
        copy(start)
        for text, a, b in made:
            at.append(size)
            origin.append(layer.back(start + a, start + b))
            exact.append(False)
            parts.append(text)
            size += len(text)
        upto, changed = end, True
    copy(len(layer.text))
    text = "".join(parts)
    return _Layer(text, at, origin, exact, layer.level + 1) if changed and text != layer.text else None


def _fixpoint(layer: _Layer) -> _Layer | None:
    """The layer with all percent, \\x, \\u and \\U escapes resolved, however deep, in one pass: a sign that completes an escape is taken
    back with it, and what it stands for may complete another. Bytes of a sequence that is no UTF-8 stay as they are written."""
    signs: list[str | tuple] = []  # a tuple is a byte above 0x7F, how it is written, and where each of the three signs stands
    starts: list[int] = []
    ends: list[int] = []
    marks: list[int] = []  # where backslashes stand in signs
    for place, c in enumerate(layer.text):
        start, end = place, place + 1
        while True:
            if c == "\\":
                marks.append(len(signs))
            signs.append(c)
            starts.append(start)
            ends.append(end)
            if c in _HEX_SIGNS and len(signs) > 2 and signs[-3] == "%" and signs[-2] in _HEX_SIGNS:
                n, value, byte, shown = 3, int(signs[-2] + c, 16), True, (f"%{signs[-2]}{c}", [*zip(starts[-3:], ends[-3:], strict=True)])
            else:
                if not marks or len(signs) - marks[-1] > 10 or not (c == "}" or c in _HEX_SIGNS):
                    break
                m = _TAIL.match("".join(map(str, signs[marks[-1] :])))
                if m is None or (value := int(next(g for g in m.groups() if g), 16)) > 0x10FFFF or 0xD800 <= value < 0xE000:
                    break
                n, byte = len(signs) - marks[-1], False
            start, end = starts[-n], ends[-1]
            del signs[-n:], starts[-n:], ends[-n:]
            while marks and marks[-1] >= len(signs):
                marks.pop()
            if byte and value > 0x7F:
                signs.append((value, *shown))
                starts.append(start)
                ends.append(end)
                break
            c = chr(value)

    def regions() -> Iterator[tuple[int, int, list]]:
        k = 0
        while k < len(signs):
            n = 1
            if isinstance(signs[k], tuple):
                run = [x for x in signs[k : k + 4] if isinstance(x, tuple)]
                n = next((n for n in range(1, len(run) + 1) if all(isinstance(x, tuple) for x in signs[k : k + n]) and _utf8(bytes(x[0] for x in signs[k : k + n]))), 0)
                end, first = ends[k + (n or 1) - 1], starts[k]
                yield first, end, [(bytes(x[0] for x in signs[k : k + n]).decode(), 0, end - first)] if n else [(x, a - first, b - first) for x, (a, b) in zip(signs[k][1], signs[k][2], strict=True)]
            elif ends[k] - starts[k] > 1:
                yield starts[k], ends[k], [(signs[k], 0, ends[k] - starts[k])]
            k += n or 1

    return _replaced(layer, regions())


def _percent(m: re.Match):
    raw, out, k = bytes.fromhex(m[0].replace("%", "")), [], 0
    while k < len(raw):
        n = next((n for n in (1, 2, 3, 4) if _utf8(raw[k : k + n])), 0)
        # a byte that is no UTF-8 stays as it is written; the rest of the run is read
        out.append((raw[k : k + n].decode() if n else m[0][3 * k : 3 * k + 3], 3 * k, 3 * (k + (n or 1))))
        k += n or 1
    return out


def _utf8(raw: bytes) -> bool:
    try:
        return len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


def _escape(m: re.Match):
    s = m[0]
    if s.startswith("\\u") and not s.startswith("\\u{"):
        units, out, k = [int(s[i + 2 : i + 6], 16) for i in range(0, len(s), 6)], [], 0
        while k < len(units):
            u = units[k]
            if 0xD800 <= u < 0xDC00 and k + 1 < len(units) and 0xDC00 <= units[k + 1] < 0xE000:
                out.append((chr(0x10000 + ((u - 0xD800) << 10) + units[k + 1] - 0xDC00), 6 * k, 6 * k + 12))
                k += 2
            else:
                out.append(("�" if 0xD800 <= u < 0xE000 else chr(u), 6 * k, 6 * k + 6))
                k += 1
        return out
    code = int(next(g for g in m.groups() if g), 16)
    return None if code > 0x10FFFF or 0xD800 <= code < 0xE000 else [(chr(code), 0, len(s))]


def _opened(head: bytes):
    """A decompressor for data that begin so; None if they are not compressed."""
    if head[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if head[:1] == b"\x78" and len(head) > 1 and (head[0] * 256 + head[1]) % 31 == 0:
        return zlib.decompressobj()
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor(memlimit=DICTIONARY)
    return None


def _drained(d, data: bytes, source: Iterator[bytes]) -> Iterator[bytes]:
    """The content of one member in pieces of at most CHUNK; data and then source feed it."""
    while not d.eof:
        out = d.decompress(data, CHUNK)
        if out:
            yield out
        if isinstance(d, bz2.BZ2Decompressor | lzma.LZMADecompressor):
            data, hungry = b"", d.needs_input
        else:
            data = d.unconsumed_tail
            hungry = not data and len(out) < CHUNK
        if hungry and not d.eof:
            data = next(source, None)
            if data is None:  # cut short: what came before counts
                return


def _inflated(source: Iterator[bytes], broken: list) -> Iterator[bytes]:
    """What all compressed members of a stream hold, in pieces, and what stands behind them; broken gets an entry if they end in an error."""
    data, first = b"", True
    while True:
        while len(data) < 6 and (more := next(source, None)) is not None:
            data = (data + more).lstrip(b"\0") if not first else data + more  # members may be padded
        if (d := _opened(data)) is None:
            if data and not first:
                yield b"\n"
                yield data
                yield from source
            return
        try:
            yield from _drained(d, data, source)
        except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
            broken.append(True)
            return
        data, first = d.unused_data.lstrip(b"\0"), False


def _windows(source: Iterator[bytes]) -> Iterator[bytes]:
    """A stream in windows of WINDOW bytes, each beginning with the last OVERLAP bytes of the one before."""
    held = b""
    for part in source:
        held += part
        while len(held) > WINDOW:
            yield held[:WINDOW]
            held = held[WINDOW - OVERLAP :]
    if held:
        yield held


def _texts(raw: bytes, head: bytes | None = None) -> list[str]:
    """What bytes say: as UTF-16 where a mark or the zero bytes of the head show it, and as UTF-8; parts that are no text become signs of their own."""
    some, found = (raw if head is None else head)[:512], []
    if some[:2] in (b"\xff\xfe", b"\xfe\xff") or (len(some) > 7 and 3 * max(some[::2].count(0), some[1::2].count(0)) > len(some)):
        big = some[:2] == b"\xfe\xff" or (some[:2] != b"\xff\xfe" and some[::2].count(0) > some[1::2].count(0))
        found.append(raw.decode("utf-16-be" if big else "utf-16-le", "replace"))
    return [*found, raw.decode("utf-8", "replace")]


def _unpacked(run: str) -> Iterator[str]:
    """The texts inside a base64 run, through any layers of compression.

    Content of at most WINDOW bytes is one text. Longer content is never held whole: it is read again from its last short
    layer, once for a digest that ends cycles and once in overlapping windows, each a text of its own.
    """
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        body = body[:-1]  # a letter too many: what stands before it is read
    raw = base64.b64decode(body + "=" * (-len(body) % 4))
    if _opened(raw) is None:
        yield from _texts(raw)
        return
    seen, met = set(), set()
    short, layers = raw, 0  # the stream: short data, unpacked this many times

    def stream(times: int, broken: list) -> Iterator[bytes]:
        made = iter([short])
        for _ in range(times):
            made = _inflated(made, broken)
        return made

    def texts(times: int) -> Iterator[str]:
        head = None
        for window in _windows(stream(times, [])):
            head = window[:512] if head is None else head
            mark = hashlib.blake2b(window).digest()
            if mark not in met:
                met.add(mark)
                yield from _texts(window, head)

    while True:
        digest, size, kept, broken = hashlib.blake2b(), 0, [], []
        for part in stream(layers + 1, broken):
            digest.update(part)
            size += len(part)
            if size <= WINDOW:
                kept.append(part)
            elif kept:
                kept = kept[:1]
        if broken or size == 0:  # perhaps not compressed at all: its own bytes are read too
            yield from texts(layers)
        if size == 0 or digest.digest() in seen:
            return
        seen.add(digest.digest())
        head = b"".join(kept)
        short, layers = (head, 0) if size <= WINDOW else (short, layers + 1)
        if _opened(head) is None or layers > STREAMS:
            yield from texts(layers)
            return


def _runs(text: str) -> Iterator[tuple[str, int, int]]:
    """Runs that may be base64, with their places: whole runs, their parts between / _ - and their ends behind one to three
    letters (a run may be glued to a path or a word) where these begin like a text or compressed data, and wrapped lines."""
    for m in _BASE64.finditer(text):
        yield m[0], m.start(), m.end()
        if _begins(m[0]):
            continue
        for k in (1, 2, 3):
            if len(m[0]) - k >= 16 and _begins(m[0][k : k + 64]):
                yield m[0][k:], m.start() + k, m.end()
        at = m.start()
        for part in _GLUE.split(m[0]):
            if 16 <= len(part) < len(m[0]) and _begins(part[:64]):
                yield part, at, at + len(part)
            at += len(part) + 1
    for m in _WRAPPED.finditer(text):
        yield re.sub(r"\s", "", m[0]), m.start(), m.end()


def _next_layers(layer: _Layer) -> Iterator[_Layer]:
    text = layer.text
    if layer.level >= LEVELS and ("%" in text or "\\" in text):
        if new := _fixpoint(layer):
            yield new
    elif "%" in text and (new := _rewritten(layer, _PERCENT, _percent)):
        yield new
    if layer.level < LEVELS and "\\" in text and (new := _rewritten(layer, _ESCAPE, _escape)):
        yield new
    if b"1" * 16 in text.encode("utf-8", "replace").translate(_IS_64):
        for run, start, end in _runs(text):
            for inner in _unpacked(run):
                if inner and _worth(inner):
                    yield _Layer(inner, [0], [layer.back(start, end)], [False])


def _plain(text: str) -> bool:
    """Nine signs in ten, or more, are those of a text."""
    return 10 * len(_ODD.sub("", text)) >= 9 * len(text)


def _begins(run: str) -> bool:
    """Whether a run, decoded from its first letter, begins like a text or like compressed data: it is aligned there."""
    body = run[:64].rstrip("=").replace("-", "+").replace("_", "/")
    raw = base64.b64decode(body[: len(body) // 4 * 4])
    return raw[:2] == b"\x1f\x8b" or raw[:3] == b"BZh" or raw[:6] == b"\xfd7zXZ\x00" or any(map(_plain, _texts(raw)))


def _worth(text: str) -> bool:
    """Whether a decoded text is entered: it reads as a text, or a secret or a run that begins like an encoded text stands in it."""
    return _plain(text) or bool(base_spans(text)) or (b"1" * 16 in text.encode("utf-8", "replace").translate(_IS_64) and any(_begins(run) for run, _, _ in _runs(text)))


def _mark(layer: _Layer) -> bytes:
    """A digest of the content of a layer and of where each part of it stands in the original text."""
    return hashlib.blake2b(repr((layer.at, layer.origin, layer.exact)).encode() + layer.text.encode("utf-8", "surrogatepass")).digest()


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) of a text, each as sorted (start, end, kind number)."""
    base = base_spans(text)
    every = set(base)
    work = _Layer(text, [0], [(0, len(text))], [True])
    seen = {_mark(work)}
    open_layers = [_next_layers(work)]  # depth first: a layer is let go before the next one beside it is made
    while open_layers:
        new = next(open_layers[-1], None)
        if new is None:
            open_layers.pop()
            continue
        if not new.text or (mark := _mark(new)) in seen:
            continue
        seen.add(mark)
        every.update((*new.back(a, b), k) for a, b, k in base_spans(new.text))
        open_layers.append(_next_layers(new))
    return base, sorted(every, key=lambda s: (s[0], s[2], s[1]))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex (base matches), base and spans as joined text (kind:start:end)."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base", pa.string()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                base, every = scan(text)
                rows.append((doc, *(sum(k == n for *_, k in base) for n in range(3)), joined(base), joined(every)))
            cols = list(zip(*rows, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, schema, strict=True)], schema=schema)

    return keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base string, spans string")
