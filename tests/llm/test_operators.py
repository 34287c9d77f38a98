"""Each corpus operator against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import base64
import gzip
import hashlib
import math
import random
import re
import urllib.parse
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.llm import bpe, ctw, hamming, line_dedup, quality, secrets, suffixes, toxicity
from heddle.llm.components import components
from heddle.llm.decontaminate import contamination, decontaminated, is_contaminated
from heddle.llm.jaccard import jaccard_components, one_of_each
from tests.llm import reference as R

#: Column names that the operators use inside, as extra columns of the input.
CLASH = "row long, mark long, n long, w long, token string, at long, key long, seg string, block long, cls long, x long, score double, spans string, h string, size long, first long"


def frame(spark, rows, schema="doc_id long, text string"):
    df = spark.createDataFrame(rows, schema)
    for field in CLASH.split(", "):
        name, kind = field.split(" ")
        df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def words(rnd, n, letters="abcdé"):
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def mixed():
    """Documents with copies, near copies, shared passages and odd texts."""
    rnd = random.Random(11)
    base = [words(rnd, rnd.choice([4, 30, 60])) for _ in range(10)]
    rows = []
    for k in range(90):
        w = rnd.choice(base).split(" ")
        for _ in range(rnd.choice([0, 0, 1, 2])):
            w[rnd.randrange(len(w))] = words(rnd, 1)
        if rnd.random() < 0.3:
            w += rnd.choice(base).split(" ")
        rows.append((k * 2, " ".join(w)))
    return [*rows, (1001, None), (1003, ""), (1005, " \n\t "), (1007, "x" * 30_000), (1009, "One two"), (1011, "one TWO")]


def test_jaccard_equals_brute_force(spark, mixed):
    for most in (4000, 3):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(frame(spark, mixed), most=most).collect()}
        assert got == R.jaccard_components(mixed)


def test_jaccard_edges(spark):
    assert jaccard_components(frame(spark, [])).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (7, None)]
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard_components(frame(spark, rows)).collect())
    assert got == [("1", 2, 1), ("1", 2, 1), ("7", 0, 7), ("None", 2, 1)]
    kept = one_of_each(frame(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (3, "q")]))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3] and kept.columns == frame(spark, []).columns


def test_components_of_a_long_chain(spark):
    edges = [(k, k + 1) for k in range(200)] + [(500, 501)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(201)} | {500: 500, 501: 500}


def test_suffix_array_order():
    rnd = random.Random(2)
    for _ in range(150):
        s = np.array([rnd.randrange(1, rnd.choice([2, 3, 5]) + 1) for _ in range(rnd.randrange(1, 120))])
        if rnd.random() < 0.5:
            s = np.r_[s, s]
        whole = suffixes.suffix_order(s, 10**6).tolist()
        assert whole == sorted(range(len(s)), key=lambda i: s[i:].tolist())
        part = suffixes.suffix_order(s, 7)
        keys = [tuple(s[i : i + 7]) for i in part]
        assert keys == sorted(keys) and sorted(part.tolist()) == list(range(len(s)))


def test_suffix_dedup_equals_brute_force(spark, mixed):
    rows = [*mixed, (2001, "ab" * 100), (2003, "a" * 39), (2005, mixed[3][1])]
    ref = dict(zip((i for i, _ in rows), R.repeats([t for _, t in rows], 40), strict=True))
    for crowd in (4000, 2):
        done = suffixes.without_repeats(frame(spark, rows), width=40, gram=8, crowd=crowd)
        got = {r.doc_id: (r.a, r.a - r.b, r.c, r.d) for r in done.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("a"), F.length("__kept").alias("b"), F.size("__spans").alias("c"), F.sha2("__kept", 256).alias("d")).collect()}
        assert got == ref


def test_suffix_dedup_edges(spark):
    assert suffixes.without_repeats(frame(spark, [])).count() == 0
    rows = [(1, "z" * 450), (1, "z" * 450), (None, "q" * 399), (2, None)]
    got = sorted((str(r.doc_id), len(r["__kept"])) for r in suffixes.without_repeats(frame(spark, rows)).collect())
    assert got == [("1", 0), ("1", 0), ("2", 0), ("None", 399)]


def test_line_dedup_equals_brute_force(spark):
    rnd = random.Random(4)
    lines = [words(rnd, rnd.choice([1, 3, 8, 25])) for _ in range(30)]
    rows = [(k, "\n".join(rnd.choice([*lines, "", words(rnd, 6)]) for _ in range(rnd.randrange(0, 14)))) for k in range(60)] + [(90, None), (91, "")]
    ref = R.line_dedup(rows, 20)
    done = line_dedup.line_dedup(frame(spark, rows))
    assert {r.doc_id: r.text for r in done.collect()} == ref
    assert sum(r["__n_deleted"] for r in done.collect()) > 0 and done.columns == [*frame(spark, []).columns, "__n_deleted"]


def test_line_dedup_edges(spark):
    long = " ".join(map(str, range(30)))
    rows = [(2, long), (1, long), (1, long), (None, "x\n" + long), (3, "  " + long + "\nend\n")]
    got = sorted((str(r.doc_id), r.text) for r in line_dedup.line_dedup(frame(spark, rows)).collect())
    assert got == [("1", ""), ("1", ""), ("2", ""), ("3", "end\n"), ("None", "x\n" + long)]
    assert line_dedup.line_dedup(frame(spark, [])).count() == 0


def test_decontamination_equals_brute_force(spark):
    rnd = random.Random(6)
    items = [(k, words(rnd, n)) for k, n in enumerate([1, 2, 3, 12, 13, 14, 40, 40])] + [(50, None), (51, ""), (52, "..."), (53, "Same words here")] + [(54, "same WORDS here")]
    docs = []
    for k in range(60):
        text = words(rnd, rnd.randrange(0, 40))
        for _ in range(rnd.choice([0, 1, 2])):
            w = (rnd.choice(items)[1] or "").split(" ")
            cut = rnd.randrange(0, len(w))
            text += ", " + " ".join(w[cut:] if rnd.random() < 0.5 else w).upper()
        docs.append((k, text + " " + words(rnd, 3)))
    docs += [(100, None), (101, ""), (102, "same words here"), (103, "y " * 20_000)]
    ref = R.contamination(docs, items)
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in contamination(frame(spark, docs), frame(spark, items, "item_id long, text string")).collect()}
    assert got == ref
    bad = {d for d, (n, hit, _) in ref.items() if hit and 20 * hit >= n}
    kept = decontaminated(frame(spark, docs), frame(spark, items, "item_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - bad


def test_decontamination_edges(spark):
    none = frame(spark, [], "item_id long, text string")
    got = contamination(frame(spark, [(1, "a b"), (1, "a b")]), none).withColumn("c", is_contaminated()).collect()
    assert [(r.n_words, r.n_hit, r.c) for r in got] == [(2, 0, False)] * 2
    assert contamination(frame(spark, []), frame(spark, [(1, "a")], "item_id long, text string")).count() == 0


def test_native_main_path_runs_no_python(spark, mixed):
    df = contamination(frame(spark, mixed), frame(spark, [(1, "a b c d")], "item_id long, text string"))
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_vocabulary())
    rnd = random.Random(8)
    odd = ["", None, "<|endoftext|>a <|endoftext|>", "a" * 4000, " \n\n  x　y", "é½²Ⅷ一二 नमस्ते 🙂👩‍👩‍👧", "ab" * 600, "I'm can't WE'LL 123 12ab", "\x00\x01\x85\x1c z"]
    texts = odd + ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0x80, 0x3000), rnd.randrange(0x4E00, 0x9FFF), rnd.randrange(0x1F300, 0x1F700)])) for _ in range(80)) for _ in range(60)]
    got = {r.doc_id: r for r in bpe.encoded(frame(spark, list(enumerate(texts)))).collect()}
    digest = {r.doc_id: r for r in bpe.encoded(frame(spark, list(enumerate(texts))), digests=True).collect()}
    for k, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[k].ids == ids and got[k].decoded == t.decode(ids, skip_special_tokens=False)
        assert digest[k].ids_sha256 == R.sha(",".join(map(str, ids))) and digest[k].decoded_sha256 == R.sha(got[k].decoded)
    assert bpe.encoded(frame(spark, [])).count() == 0


def test_bpe_short_and_long_words_agree():
    c = bpe.Codec(bpe.default_vocabulary())
    rnd = random.Random(1)
    for _ in range(100):
        word = "".join(rnd.choice("aehinrst ") for _ in range(rnd.randrange(1, 120))).encode()
        assert c._long(word) == c.parts(word)


def plain_secrets(text):
    found = [(m.start(), m.end(), 0) for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), 1) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), m.end(), 2) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def test_secrets_base_matches():
    rnd = random.Random(3)
    bits = ["password", "PassWd", "token", "api_key", "APIKEY", "secret", " ", "=", ":", '"', "'", "abc123", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "é", "ſecret", "x", "\n", "%41", "."]
    for _ in range(500):
        text = "".join(rnd.choice(bits) for _ in range(25))
        base, every = secrets.scan(text)
        assert base == plain_secrets(text) and set(base) <= set(every)


def test_secrets_in_layers():
    inner = "my token: abcdef123456 ok"
    b64 = lambda b: base64.b64encode(b).decode()
    for hidden in (b64(inner.encode()), b64(gzip.compress(inner.encode())), b64(zlib.compress(inner.encode())), b64(b64(inner.encode()).encode()), base64.urlsafe_b64encode(inner.encode()).decode()):
        base, every = secrets.scan(f"say é {hidden} end")
        assert base == [] and every == [(6, 6 + len(hidden), 0)]
    quoted = urllib.parse.quote('é password="abcdef12"')
    assert secrets.scan(f"x {quoted}")[1] == [(2 + len("%C3%A9%20"), 2 + len(quoted) - 3, 0)]
    once = "".join(f"\\u{ord(c):04x}" for c in "token=abcdefgh")
    assert secrets.scan(once)[1] == [(0, len(once), 0)]
    assert secrets.scan("pass%2577ord=abcdef99")[1] == [(0, 21, 0)]
    assert secrets.scan("%25" * 50 + b64(b"A" * 30)) is not None  # ends


def test_secrets_rows(spark):
    rows = [(1, None), (2, ""), (3, "token = abcdef1"), (3, "token = abcdef1"), (None, "x" * 50_000)]
    got = sorted((str(r.doc_id), r.n_assign, r.spans) for r in secrets.secrets(frame(spark, rows)).collect())
    assert got == [("1", 0, ""), ("2", 0, ""), ("3", 1, "assign:0:15"), ("3", 1, "assign:0:15"), ("None", 0, "")]
    assert secrets.secrets(frame(spark, [])).count() == 0


def brute_top_k(rows, asked, k):
    code = lambda v: sum(1 << b for b, x in enumerate(v[:64]) if x is not None and x > 0)
    every = {(i, code(v)) for i, v in rows if i is not None and v is not None}
    out = {}
    for i in asked:
        best = {}
        for j, c in every:
            if j != i:
                d = min((c ^ q).bit_count() for a, q in every if a == i)
                best[j] = min(d, best.get(j, 99))
        out[i] = [(j, d) for d, j in sorted((d, j) for j, d in best.items())][:k]
    return out


def test_hamming_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(6, 64))
    rows = [(k, (centre[k % 6] + 0.5 * rng.normal(size=64)).tolist()) for k in range(300)] + [(400 + k, [1.0] * 64) for k in range(40)] + [(500, None), (501, []), (None, [1.0]), (502, [None, 2.0])]
    rows += [(0, rows[0][1])]
    df = frame(spark, rows, "vec_id long, embedding array<double>")
    for shard, block in ((32768, 2048), (50, 4)):
        got = {}
        for r in hamming.top_k(df, df.where("vec_id % 20 = 0"), 7, shard=shard, block=block).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.neighbour_id, r.distance))
        assert got == brute_top_k(rows, sorted({i for i, v in rows if i is not None and v is not None and i % 20 == 0}), 7)
    assert hamming.top_k(df.limit(0), df.limit(0)).count() == 0
    assert hamming.top_k(df, df.limit(0)).count() == 0


def test_ctw_is_a_distribution_and_parts_of_any_size_agree(spark, mixed):
    rows = [(i, (t or None) and t[:400]) for i, t in mixed]
    few = {r.doc_id: r for r in ctw.scores(frame(spark, rows), depth=3).collect()}
    apart = {r.doc_id: r for r in ctw.scores(frame(spark, rows), depth=3, part=500).collect()}
    learnt = [t or "" for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    tokens = lambda t: [*re.findall(R.BLANK, R.low(t)), None]
    count = Counter(w for t in learnt for w in tokens(t))
    n, v = sum(count.values()), len(count)
    for i, t in rows:
        a, b = few[i], apart[i]
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens(t or ""))
        for r in (a, b):
            assert r.held_out == (zlib.crc32(str(i).encode()) % 7 == 2) and r.n_tokens == len(tokens(t or "")) and r.train_tokens == n
            assert r.n_known == sum(count[w] > 0 for w in tokens(t or "")) and abs(r.base_score - base) < 1e-6 and r.score < 0
        assert abs(a.score - b.score) < 1e-6


def test_ctw_sums_to_one_and_equals_a_small_model(spark):
    """Order 1 over few letters against the definition, node by node."""
    texts = ["abab", "ba", "aab"]
    rows = [(k, t) for k, t in zip((i for i in range(100) if zlib.crc32(str(i).encode()) % 7 != 2), texts, strict=False)]
    got = {r.doc_id: r.score for r in ctw.scores(frame(spark, rows), depth=1).collect()}
    counts = {}
    for t in texts:
        for c, s in zip(b"\0" + t.encode(), t.encode() + b"\0", strict=True):
            for k in range(8):
                node, bit = (1 << k) | (s >> (8 - k)), (s >> (7 - k)) & 1
                for ctx in ((), (c,)):
                    counts.setdefault((ctx, node), [0, 0])[bit] += 1
    kt = lambda z, o: math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi)
    for i, t in rows:
        total = 0.0
        for c, s in zip(b"\0" + t.encode(), t.encode() + b"\0", strict=True):
            for k in range(8):
                node, bit = (1 << k) | (s >> (8 - k)), (s >> (7 - k)) & 1
                own = kt(*counts[(), node])
                below = sum(kt(*v) for (ctx, m), v in counts.items() if ctx and m == node)
                share = 1 / (1 + math.exp(below - own))
                p = lambda v: (v[bit] + 0.5) / (sum(v) + 1)  # noqa: E731, B023
                total += math.log10(share * p(counts[(), node]) + (1 - share) * p(counts[(c,), node]))
        assert abs(got[i] - total) < 1e-9


def test_ctw_of_order_four_equals_the_definition(spark):
    """All orders, seen and unseen contexts, held-out texts: against nodes kept in a dictionary."""
    rnd, depth = random.Random(4), 4
    rows = [(k, words(rnd, rnd.randrange(0, 30), "abc")) for k in range(40)]
    counts = {}

    def decisions(t):
        line = b"\0" * depth + t.encode() + b"\0"
        for at in range(depth, len(line)):
            for k in range(8):
                yield [(line[at - d : at], (1 << k) | (line[at] >> (8 - k))) for d in range(depth + 1)], (line[at] >> (7 - k)) & 1

    for i, t in rows:
        for path, bit in decisions(t):
            for node in path:
                counts.setdefault(node, [0, 0])[bit] += zlib.crc32(str(i).encode()) % 7 != 2
    kt = lambda z, o: math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi)
    below, log_w = {}, {}
    for d in range(depth, -1, -1):
        for node in [n for n in counts if len(n[0]) == d]:
            own = kt(*counts[node])
            log_w[node] = own if d == depth else math.log((math.exp(own) + math.exp(below[node])) / 2)
            if d:
                up = (node[0][1:], node[1])
                below[up] = below.get(up, 0.0) + log_w[node]
    got = {r.doc_id: r.score for r in ctw.scores(frame(spark, rows), depth=depth, part=300).collect()}
    for i, t in rows:
        total = 0.0
        for path, bit in decisions(t):
            seen = [n for n in path if sum(counts[n])]
            p = None
            for node in reversed(seen):
                own = (counts[node][bit] + 0.5) / (sum(counts[node]) + 1)
                share = math.exp(kt(*counts[node]) - math.log(2) - log_w[node])
                p = own if p is None else share * own + (1 - share) * p
            total += math.log10(p)
        assert abs(got[i] - total) < 1e-8


def test_ctw_edges(spark):
    assert ctw.scores(frame(spark, [])).count() == 0
    got = ctw.scores(frame(spark, [(None, "a"), (None, None), (1, ""), (1, "")])).collect()
    assert len(got) == 4 and not any(r.held_out for r in got if r.doc_id is None)


@pytest.mark.parametrize("which", ["quality", "toxicity"])
def test_classifiers_learn_and_hold_out(spark, which):
    rnd = random.Random(9)
    rows, labels = [], []
    for k in range(900):
        bad = rnd.random() < 0.3
        text = words(rnd, rnd.randrange(20, 60), "abcdefgh")
        if bad:
            text = text.replace(" ", " | ").upper() if which == "quality" else text + " you stupid idiot " + words(rnd, 5)
        rows.append((k, text))
        labels.append((k, int(bad) if which == "toxicity" else int(not bad)))
    labels += [(None, 1), (5, None), (2000, 1)]
    rows += [(None, "x"), (3000, None), (3001, ""), (0, rows[0][1])]
    label = {"quality": "quality", "toxicity": "toxic"}[which]
    f = quality.quality_scores if which == "quality" else toxicity.toxicity_scores
    m, h = (3, 1) if which == "quality" else (4, 2)
    got = f(frame(spark, rows), frame(spark, labels, f"doc_id long, {label} int")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    truth = dict(labels)
    held = [(r.score, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth and truth[r.doc_id] is not None]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % m == h) for r in got if r.doc_id is not None)
    cut = 0.5 if which == "quality" else 0.3
    assert len(held) > 100 and sum((s >= cut) == bool(y) for s, y in held) / len(held) > 0.95
    assert len({r.score for r in got if r.doc_id == 0}) == 1


def test_classifiers_without_labels(spark):
    rows = frame(spark, [(1, "a b"), (2, None)])
    none = frame(spark, [], "doc_id long, quality int, toxic int")
    assert [r.score for r in quality.quality_scores(rows, none).collect()] == [0.5, 0.5]
    assert [r.score for r in toxicity.toxicity_scores(rows, none).collect()] == [0.0, 0.0]
    assert toxicity.not_toxic(rows, none).count() == 2 and quality.quality_scores(frame(spark, []), none).count() == 0


def test_obfuscated_abuse_is_counted():
    from heddle.llm.statistics import NAMES, statistics

    texts = [b"you 1d10t here", b"an idiot### here", b"plain words here", b""]
    x = statistics(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    at = NAMES.index("log_abuse")
    assert x[0, at] > 0 and x[1, at] > 0 and x[2, at] == 0 and not x[3].any()
    assert x[0, NAMES.index("abuse_leet")] > 0 and x[0, NAMES.index("near_second")] > 0


def test_written_tables_can_be_dropped(spark):
    from heddle.llm import common

    common.drop_written(spark)
    df = common.written(spark.range(3), "some")
    assert df.count() == 3 and common.drop_written(spark) == 1 and common.drop_written(spark) == 0


def test_digest_of_kept_text():
    assert hashlib.sha256(b"").hexdigest() == R.sha("")


def test_jaccard_of_growing_snapshots(spark):
    """Each text is one word longer than the last: a tree as deep as there are texts, one component, counted links."""
    base = [f"w{k}" for k in range(1, 1300)]
    rows = [(k, " ".join(base[: 600 + k])) for k in range(600)]
    got = {r.doc_id: r for r in jaccard_components(frame(spark, rows)).collect()}
    assert all(r.component_id == 0 and r.n_shingles == 596 + r.doc_id for r in got.values())
    size = {k: 596 + k for k in range(600)}
    for k in (0, 10, 300, 599):
        assert got[k].n_links == sum(j != k and 100 * min(size[k], size[j]) >= 80 * max(size[k], size[j]) for j in size)


def test_jaccard_counts_links(spark, mixed):
    sets = {i: R.shingle_set(t) for i, t in mixed}
    want = {i: sum(j != i and bool(s) and bool(t) and 100 * len(s & t) >= 80 * len(s | t) for j, t in sets.items()) for i, s in sets.items()}
    for most in (4000, 3):
        got = {r.doc_id: r.n_links for r in jaccard_components(frame(spark, mixed), most=most).collect()}
        assert got == want


NAMES = "__doc __mark __spans __n_deleted __gone __kept __raw __bad".split()


def test_inner_names_may_clash(spark):
    """Extra columns under the names that operators use inside pass through unchanged."""
    long = " ".join(map(str, range(30)))
    df = frame(spark, [(1, long), (2, long), (3, None)])
    for n in NAMES:
        df = df.withColumn(n, F.lit(n))
    labels = frame(spark, [(1, 0), (2, 1)], "doc_id long, toxic int")
    items = frame(spark, [(1, long)], "item_id long, text string")
    for done in (line_dedup.line_dedup(df), suffixes.without_repeats(df, width=40), one_of_each(df), decontaminated(df, items), toxicity.not_toxic(df, labels)):
        assert done.columns[: len(df.columns)] == df.columns
        assert all(r[n] == n for r in done.collect() for n in NAMES)
