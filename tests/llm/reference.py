"""Brute-force versions of the corpus operators, over lists of (id, text)."""

import hashlib
import re

BLANK = r"[^\x20\x09-\x0D]+"


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def shingle_set(text):
    w = re.findall(BLANK, low(text))
    if 0 < len(w) < 5:
        return {tuple(w)}
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def jaccard_components(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(i, least.get(root(k), i))
    return {i: (len(sets[k]), least[root(k)]) for k, (i, _) in enumerate(rows)}


def repeats(texts, width):
    """(bytes, removed, spans, digest of the rest) per text."""
    seen = {}
    raws = [(t or "").encode() for t in texts]
    for d, raw in enumerate(raws):
        for i in range(len(raw) - width + 1):
            seen.setdefault(raw[i : i + width], []).append((d, i))
    gone = [bytearray(len(r)) for r in raws]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i : i + width] = b"\1" * width
    out = []
    for raw, g in zip(raws, gone, strict=True):
        kept = bytes(b for b, x in zip(raw, g, strict=True) if not x)
        out.append((len(raw), len(raw) - len(kept), sum(1 for k in range(len(g)) if g[k] and (k == 0 or not g[k - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def line_dedup(rows, min_words):
    """Texts after deleting later repeated runs: each window of the fewest lines with min_words words, first by (id, line)."""
    first, windows = {}, []
    for i, text in sorted(rows, key=lambda r: r[0]):
        lines = [(k, x.strip()) for k, x in enumerate((text or "").split("\n")) if x.strip()]
        for s in range(len(lines)):
            n, e = 0, s
            while e < len(lines) and n < min_words:
                n += len(lines[e][1].split())
                e += 1
            if n >= min_words:
                key = tuple(x for _, x in lines[s:e])
                windows.append((i, lines[s][0], lines[e - 1][0], key))
                first.setdefault(key, (i, lines[s][0]))
    gone = {}
    for i, a, b, key in windows:
        if first[key] != (i, a):
            gone.setdefault(i, set()).update(range(a, b + 1))
    return {i: text if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone.get(i, ()) or not x.strip()) for i, text in rows}


def contamination(docs, items, width=13):
    """(n_words, n_hit, sorted item ids) per document."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(width, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(item)
    out = {}
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])]
        out[d] = (len(w), len(hit), sorted(map(str, found)))
    return out
