"""Linguistic scalar operators as plain functions over parameters, with Arrow-batched wrappers.

Lexicons, affixes, tags and rules are arguments: nothing here knows a language.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import functions as F


def without_tones(text: str) -> str:
    """The text without combining marks."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


@dataclass(frozen=True)
class Syllables:
    """Longest-match segmentation: known compounds first, then the longest onset, nucleus and coda up to `longest` letters."""

    onsets: frozenset[str]
    nuclei: frozenset[str]
    codas: frozenset[str]
    compounds: dict[str, tuple[str, ...]] = field(default_factory=dict)
    longest: int = 6

    def valid(self, s: str) -> bool:
        return any(s[:i] in self.onsets and s[i:j] in self.nuclei and s[j:] in self.codas for i in range(len(s)) for j in range(i + 1, len(s) + 1))

    def split(self, word: str) -> list[str]:
        low = word.lower()
        if low in self.compounds:
            return list(self.compounds[low])
        out, at = [], 0
        while at < len(low):
            stop = next((j for j in range(min(len(low), at + self.longest), at, -1) if self.valid(low[at:j])), at + 1)
            out.append(low[at:stop])
            at = stop
        return out


@dataclass(frozen=True)
class Morphology:
    """Prefix, root and suffix of a word; the longest affixes that leave a known root."""

    roots: frozenset[str]
    prefixes: tuple[str, ...] = ()
    suffixes: tuple[str, ...] = ()
    particles: frozenset[str] = frozenset()

    def analyse(self, word: str) -> dict[str, str | None]:
        low = word.lower()
        if low in self.particles:
            return {"kind": "particle", "prefix": None, "root": low, "suffix": None}
        half = low[: len(low) // 2]
        if half and low == half * 2 and half in self.roots:
            return {"kind": "reduplication", "prefix": None, "root": half, "suffix": None}
        by_length = lambda affixes: ["", *sorted(affixes, key=len, reverse=True)]
        for p in by_length(self.prefixes):
            for s in by_length(self.suffixes):
                root = low[len(p) : len(low) - len(s) if s else None]
                if low.startswith(p) and low.endswith(s) and root in self.roots:
                    return {"kind": "word", "prefix": p or None, "root": root, "suffix": s or None}
        return {"kind": "unknown", "prefix": None, "root": low, "suffix": None}

    def compound(self, word: str) -> list[str] | None:
        """Two or more roots, the longest first, or None."""
        parts, at, low = [], 0, word.lower()
        while at < len(low):
            stop = next((j for j in range(len(low), at, -1) if low[at:j] in self.roots), 0)
            if not stop:
                return None
            parts.append(low[at:stop])
            at = stop
        return parts if len(parts) > 1 else None


def folded_tones(tones: list[str], rules: dict[tuple[str, str], tuple[str, str]]) -> list[str]:
    """Left to right, each pair of neighbours rewritten by the rules; a rewrite is seen by the next pair."""
    out = list(tones)
    for i in range(len(out) - 1):
        out[i], out[i + 1] = rules.get((out[i], out[i + 1]), (out[i], out[i + 1]))
    return out


def tagged(tokens: list[str], closed: dict[str, str], lexicon: dict[str, str], suffixes: dict[str, str], default: str = "NOUN") -> list[tuple[str, float]]:
    """(tag, confidence): closed classes, the lexicon, capitals inside a sentence, suffixes, else the default."""
    out = []
    for k, token in enumerate(tokens):
        low = token.lower()
        tail = next((t for s, t in sorted(suffixes.items(), key=lambda x: -len(x[0])) if low.endswith(s)), None)
        if low in closed:
            out.append((closed[low], 0.95))
        elif low in lexicon:
            out.append((lexicon[low], 0.9))
        elif k and token[:1].isupper():
            out.append(("PROPN", 0.8))
        else:
            out.append((tail, 0.6) if tail else (default, 0.3))
    return out


def entities(text: str, gazetteer: dict[str, str]) -> list[dict]:
    """Longest entries of a gazetteer at word boundaries, left to right without overlap."""
    if not gazetteer:
        return []
    rx = re.compile(r"(?<!\w)(?:" + "|".join(re.escape(e) for e in sorted(gazetteer, key=len, reverse=True)) + r")(?!\w)")
    return [{"label": gazetteer[m[0]], "start": m.start(), "end": m.end(), "text": m[0]} for m in rx.finditer(text)]


def rule_matches(text: str, rules: dict[str, str], around: int = 30) -> list[dict]:
    """Every match of every named pattern with its span and context."""
    return [{"rule": name, "start": m.start(), "end": m.end(), "context": text[max(0, m.start() - around) : m.end() + around]} for name, pattern in rules.items() for m in re.finditer(pattern, text)]


def rewritten(text: str, preferred: dict[str, str]) -> str:
    """Preferred forms for whole words, from the end, keeping the shape (upper, title) of what they replace."""
    if not preferred:
        return text
    rx = re.compile(r"\b(?:" + "|".join(map(re.escape, sorted(preferred, key=len, reverse=True))) + r")\b", re.IGNORECASE)

    def shaped(m: re.Match) -> str:
        new = preferred.get(m[0].lower(), m[0])
        return new.upper() if m[0].isupper() and len(m[0]) > 1 else new[:1].upper() + new[1:] if m[0][:1].isupper() else new

    return rx.sub(shaped, text)


def summarised(text: str, key_words: list[str], most: int = 3) -> str:
    """The first sentence and those with most key words, in their order."""
    s = [x for x in re.split(r"(?<=[.!?])\s+", text.strip()) if x]
    ranked = sorted(range(1, len(s)), key=lambda k: (-sum(w in s[k].lower() for w in key_words), k))[: max(most - 1, 0)]
    return " ".join(s[k] for k in sorted([0, *ranked])) if s else ""


def over_texts(f, kind: str):
    """UDF of one text column from a plain function; null gives null."""

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else f(x))

    return run
