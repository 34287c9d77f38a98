"""Marked-up texts in document order: against a parser of whole trees, with files split anywhere."""

import random
import xml.etree.ElementTree as ET

import pytest

from heddle.sources import marked as M


def usx(seed):
    r = random.Random(seed)
    lines = ["<?xml version='1.0'?>", "<usx>"]
    for b in range(3):
        lines.append(f'<book code="B{seed}{b}" style="id">Title &lt;{b}&gt;</book>')
        for c in range(1, 4):
            lines.append(f'<chapter number="{c if c < 3 else "x"}"/><!-- a comment with <verse number="7"/> in it -->')
            for v in range(1, r.randint(2, 9)):
                text = r.choice(["In the beginning &amp; after", "&#233;t&#xe9; a&#38;lt;b", "  ", "", "many\n  lines  here", "a > b"])
                lines.append(r.choice([f'<para style="p"><verse number="{v}" style=\'v > w\'/>{text}<note>n</note> rest</para>', f'<verse number="{v}">{text}</verse> behind {v}', f"<verse number='{v}'><w>x</w></verse>{text}"]))
    return "\n".join([*lines, "</usx>"])


def by_tree(text):
    book, chapter, found = "", 0, {}
    for e in ET.fromstring(text).iter():
        n = e.get("number", "0")
        n = int(n) if n.isdigit() else 0
        if e.tag == "book":
            book = e.get("code", "")
        elif e.tag == "chapter":
            chapter = n
        elif e.tag == "verse":
            said = e.text if (e.text or "").strip() else (e.tail or "")
            if said.strip():
                found[book, chapter, n] = " ".join(said.split())
    return found


@pytest.fixture
def small_blocks(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def verses(df):
    rows = df.collect()
    assert len(rows) == len({r[:3] for r in rows})
    return {tuple(r[:3]): r[3] for r in rows}


def test_milestones_equal_a_tree_walk_over_split_files(spark, tmp_path, small_blocks):
    want = {}
    for k in range(3):
        text = usx(k)
        (tmp_path / f"{k}.usx").write_text(text, encoding="utf-8")
        want.update(by_tree(text))
    assert M.tags(spark, str(tmp_path)).select("block").distinct().count() > 5
    assert verses(M.milestone_verses(spark, str(tmp_path), "*.usx")) == want


def test_nested_verses_and_segments(spark, tmp_path, small_blocks):
    (tmp_path / "a.xml").write_text("<bible>" + "".join(f'<book name="Genesis {b}"><chapter number="{c}">' + "".join(f'<verse number="{v}">He <i>said</i><n/> &quot;{v}&quot;</verse> margin' for v in range(1, 9)) + '<verse number="10"/>no verse</chapter>' for b, c in ((1, 1), (1, 2))) + "</book></bible>")
    want = {("GEN", c, v): f'He said "{v}"' for c in (1, 2) for v in range(1, 9)}
    assert verses(M.nested_verses(spark, str(tmp_path))) == want
    assert set(verses(M.nested_verses(spark, str(tmp_path), {"Genesis 1": "G1"}))) == {("G1", c, v) for _, c, v in want}
    (tmp_path / "b.ces").write_text("<body>" + "".join(f'<seg id="b.GEN.1.{v}" type="verse">\n text {v % 5} </seg>' for v in range(1, 30)) + '<seg id="b.GEN">short</seg><seg>none</seg><seg id="b.GEN.1.1">again</seg></body>')
    assert verses(M.segment_verses(spark, str(tmp_path), "*.ces")) == {("GEN", 1, v): f"text {v % 5}" if v > 1 else "again" for v in range(1, 30)}


def test_empty_and_broken_files(spark, tmp_path):
    (tmp_path / "empty.usx").write_text("")
    assert verses(M.milestone_verses(spark, str(tmp_path))) == {}
    (tmp_path / "broken.usx").write_text('<book code="B"/><verse number="2"/>kept <para <verse number=')
    assert verses(M.milestone_verses(spark, str(tmp_path))) == {("B", 0, 2): "kept"}
