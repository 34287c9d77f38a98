"""The stages of the pipeline, each against brute force on its own input, and the whole run."""

import random

from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm import reference as R
from tests.llm.test_operators import words


def test_stages_and_run(spark, tmp_path):
    rnd = random.Random(21)
    passage = words(rnd, 60)
    item = words(rnd, 30)
    rows, labels = [], []
    for k in range(300):
        toxic = k % 5 == 0
        text = "\n".join(words(rnd, 12, "abcdefgh") for _ in range(4))
        if toxic:
            text += "\nyou stupid idiot, scum"
        if k % 7 == 1:
            text += "\n" + passage
        if k % 31 == 2:
            text = item + "\n" + text
        if k % 13 == 3 and rows:
            text = rows[-1][1]
        rows.append((k, text, "en", "src1", len(text)))
        labels.append((k, 1, int(toxic)))
    rows += [(900, None, None, None, None), (901, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "BPE encoding and decoding"]

    kept = P.toxicity(spark, docs, str(tmp_path)).collect()
    ids = {r.doc_id for r in kept}
    assert {900, 901} <= ids and not any("idiot" in (r.text or "") for r in kept) and all(r[0] in ids for r in rows if "idiot" not in (r[1] or ""))
    stage = spark.createDataFrame(kept, docs.schema)

    ref = R.line_dedup([(r.doc_id, r.text) for r in kept], 20)
    lined = P.dedup_lines(spark, stage, str(tmp_path)).collect()
    before = {r.doc_id: r.text for r in kept}
    assert {r.doc_id: r.text for r in lined} == {i: t for i, t in ref.items() if t == before[i] or t.strip()}
    assert all(r.n_chars == len(r.text) for r in lined if r.text != before[r.doc_id])
    stage = spark.createDataFrame(lined, docs.schema)

    found = R.jaccard_components([(r.doc_id, r.text) for r in lined])
    single = P.dedup_documents(spark, stage, str(tmp_path)).collect()
    assert {r.doc_id for r in single} == {i for i, (_, c) in found.items() if c == i}
    stage = spark.createDataFrame(single, docs.schema)

    dirty = R.contamination([(r.doc_id, r.text) for r in single], [(1, item)])
    clean = P.decontaminate(spark, stage, str(tmp_path))
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {i for i, (n, h, _) in dirty.items() if not (h and 20 * h >= n)}

    out = P.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in clean.collect()}
    assert out.where(F.size("ids") != F.col("n_tokens")).count() == 0
