"""Line deduplication covers each common run to its ends: brute force over all runs of whole lines."""

import random

import pytest

from heddle.llm import line_dedup
from tests.llm.test_operators import frame, words


def brute(rows, min_words):
    """Texts without the lines of every run of at least min_words words that stood before, by (id, line)."""
    texts = {i: t.split("\n") for i, t in rows}
    first, runs = {}, []
    for i in sorted(texts):
        lines = [(k, x.strip()) for k, x in enumerate(texts[i]) if x.strip()]
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                key = tuple(x for _, x in lines[a : b + 1])
                if sum(len(x.split()) for x in key) >= min_words:
                    first.setdefault(key, (i, a))
                    runs.append((i, a, [k for k, _ in lines[a : b + 1]], key))
    gone = {i: set() for i in texts}
    for i, a, held, key in runs:
        if first[key] != (i, a):
            gone[i].update(held)
    return {i: "\n".join(x for k, x in enumerate(t) if k not in gone[i]) for i, t in texts.items()}


def test_runs_are_deleted_to_their_ends(spark):
    rnd = random.Random(9)
    w = lambda n: words(rnd, n, "abcdefghij")
    a, b, c = w(30), w(15), "\n".join([w(20), w(20), w(12)])
    rows = [(1, f"{a}\n{b}"), (2, f"{a}\n{b}"), (3, f"{w(3)}\n{c}\n{w(4)}"), (4, f"{w(5)}\n{c}\n{w(6)}")]
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(frame(spark, rows), extended=True).collect()}
    assert got == brute(rows, 20) and got[2] == "" and got[4].split("\n") == [rows[3][1].split("\n")[k] for k in (0, 4)]


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force_over_all_runs(spark, seed):
    rnd = random.Random(seed)
    lines = [words(rnd, rnd.choice([1, 3, 8, 15, 25])) for _ in range(12)]
    rows = [(k, "\n".join(rnd.choice([*lines, "", words(rnd, 6)]) for _ in range(rnd.randrange(1, 14)))) for k in range(50)]
    rows = [(i, "\n".join(x for x in t.split("\n") if x)) for i, t in rows]
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(frame(spark, rows), extended=True).collect()}
    assert got == brute(rows, 20)
    assert got != {r.doc_id: r.text for r in line_dedup.line_dedup(frame(spark, rows)).collect()}
