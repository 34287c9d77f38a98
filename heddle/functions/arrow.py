"""Functions that no built-in expresses, as Arrow-batched UDFs: Unicode forms, HTML and Markdown blocks, chunks, BLEU, chrF."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F


def normal_form(form: str):
    """UDF: the Unicode normal form of a text; null stays null."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize(form, x))

    return run


def casefolded():
    """UDF: full case folding; null stays null."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else x.casefold())

    return run


class _Blocks(HTMLParser):
    """Text of block elements; what stands in scripts, styles and page furniture is passed over."""

    HIDDEN = {"script", "style", "noscript", "nav", "header", "footer", "aside"}
    BLOCK = {"p", "li", "blockquote", "h1", "h2", "h3", "div", "article", "section", "td", "br"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.now, self.hidden = [], [], 0

    def cut(self):
        text = " ".join("".join(self.now).split())
        if text:
            self.blocks.append(text)
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag in self.HIDDEN:
            self.hidden += 1
        if tag in self.BLOCK:
            self.cut()

    def handle_endtag(self, tag):
        if tag in self.HIDDEN and self.hidden:
            self.hidden -= 1
        if tag in self.BLOCK:
            self.cut()

    def handle_data(self, data):
        if not self.hidden:
            self.now.append(data)


def html_blocks(html: str) -> list[str]:
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser.cut()
    return parser.blocks


def paragraphs():
    """UDF: text blocks of a page in order; none for null."""

    @F.pandas_udf("array<string>")
    def run(html: pd.Series) -> pd.Series:
        return html.map(lambda x: [] if x is None else html_blocks(x))

    return run


def markdown_blocks(text: str, least: int = 3) -> list[str]:
    """Paragraphs of Markdown without code, heading marks and link targets; `least` words or more."""
    text = re.sub(r"```.*?```", "\n\n", text, flags=re.S)
    text = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", text)
    out = []
    for block in re.split(r"\n\s*\n", text):
        block = " ".join(re.sub(r"^\s*(?:#+|[-*+>]|\d+\.)\s*", "", line) for line in block.splitlines())
        block = " ".join(re.sub(r"[*_`]+", "", block).split())
        if len(block.split()) >= least:
            out.append(block)
    return out


def packed(parts: list[str], most: int, joint: str = "\n\n") -> list[str]:
    """Parts packed in order into chunks of `most` characters; a longer part is cut at its last blank past the middle."""
    chunks: list[str] = []
    now = ""
    for part in parts:
        while len(part) > most:
            if now:
                chunks.append(now)
                now = ""
            at = max(part.rfind(sign, most // 2, most) for sign in "\n ,")
            at = most if at < 0 else at + 1
            chunks.append(part[:at].strip())
            part = part[at:].lstrip()
        if now and len(now) + len(joint) + len(part) > most:
            chunks.append(now)
            now = part
        else:
            now = f"{now}{joint}{part}" if now and part else now or part
    return [*chunks, now] if now else chunks


def chunker(most: int = 1200):
    """UDF: a text's paragraphs packed into chunks."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [] if x is None else packed([p.strip() for p in re.split(r"\n\s*\n", x) if p.strip()], most))

    return run


def sentence_bleu(hypothesis: str, reference: str, orders: int = 4) -> float:
    """Clipped n-gram precisions of lower-cased words with one added in every order, brevity penalty; orders without n-grams count as 1."""
    h, r = hypothesis.lower().split(), reference.lower().split()
    if not h:
        return 0.0
    total = 0.0
    for n in range(1, orders + 1):
        a, b = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (h, r))
        seen = sum(a.values())
        if not seen:
            continue
        met = sum(min(c, b[g]) for g, c in a.items())
        total += math.log((met + 1) / (seen + 1))
    return math.exp(total / orders) * min(1.0, math.exp(1 - len(r) / len(h)))


def chrf(hypothesis: str, reference: str, orders: int = 6, beta: float = 3.0) -> float:
    """F-beta of the mean precision and recall of lower-cased character n-grams, blanks included; an order without n-grams counts as 0."""
    h, r = hypothesis.lower(), reference.lower()
    precision, recall = [], []
    for n in range(1, orders + 1):
        a, b = (Counter(x[i : i + n] for i in range(len(x) - n + 1)) for x in (h, r))
        met = sum((a & b).values())
        precision.append(met / sum(a.values()) if a else 0.0)
        recall.append(met / sum(b.values()) if a and b else 0.0)
    p, q = sum(precision) / len(precision), sum(recall) / len(recall)
    return 0.0 if p + q == 0 else (1 + beta**2) * p * q / (beta**2 * p + q)


def pair_metric(f):
    """UDF of two text columns from a function of two texts; null counts as empty."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([round(f(x or "", y or ""), 4) for x, y in zip(a, b, strict=True)])

    return run
