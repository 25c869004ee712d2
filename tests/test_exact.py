"""Exact passages: maps back to the original, blocks and tokens with places, and an index made of them."""

import random
import re

import pytest

from verbatlas.engine import Engine
from verbatlas.functions import normalise as N
from verbatlas.functions.text import unicode_spans, unicode_words
from verbatlas.operators import concord
from verbatlas.sources.markdown import blocks, file_lines

PARTS = ["a", " ", "b c", "&amp;", "&amp;amp;", "&lt;b&gt;", "<b>", "</b>", "<br>", "**", "*", "__", "[x y](u)", "https://z.org/q ", "“", "’", "é", "e\u0301", "\n", "_w_", "3.14", "😀", "Ad x\n", "&#233;"]


def slow(text, boilerplate=()):
    """The text after all stages with a place a character, kept one by one."""
    places = {}

    class Plain:
        def __init__(self, text):
            self.text, self.at = text, [(i, i + 1) for i in range(len(text))]

        def replace(self, pattern, by):
            out, last, done = [], 0, False
            for m in pattern.finditer(self.text):
                new = by(m)
                if new is None:
                    continue
                out += zip(self.text[last : m.start()], self.at[last : m.start()], strict=True)
                if isinstance(new, tuple):
                    out += zip(self.text[slice(*new)], self.at[slice(*new)], strict=True)
                else:
                    out += [(c, (self.at[m.start()][0], self.at[m.end() - 1][1])) for c in new]
                last, done = m.end(), True
            out += zip(self.text[last:], self.at[last:], strict=True)
            if done:
                self.text, self.at = "".join(c for c, _ in out), [p for _, p in out]
            return done

    kept, N.Mapped = N.Mapped, Plain
    try:
        m = N.normalise(text, boilerplate)
    finally:
        N.Mapped = kept
    return m.text, m.at or list(places)


def test_runs_equal_a_place_a_character():
    draw = random.Random(5)
    for _ in range(1500):
        text = "".join(draw.choice(PARTS) for _ in range(draw.randrange(0, 18)))
        rules = ("Ad .*",) if draw.random() < 0.3 else ()
        m = N.normalise(text, rules)
        assert (m.text, m.at) == slow(text, rules), text
        assert m.begins == sorted(set(m.begins)) and (not m.text or m.begins[0] == 0)
    long = "word " * 50_000
    assert N.normalise(long).runs == [(0, 0, None)]  # a copied text is one run
    assert len(N.normalise("a “b” " * 1000).runs) <= 4 * 1000 + 1


def test_spans_of_words():
    text = "_Well_-known a:b __x__ don't 3.14 ... it’s _ 😀"
    assert [w for w, _, _ in unicode_spans(text)] == unicode_words(text)
    assert all(text[a:b].lower() == w for w, a, b in unicode_spans(text)) and list(unicode_spans(None)) == []


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, extra int")


MARKED = [
    (1, "# Head *one*\n\nHe sw**a**m &amp; <i>swa</i>m\non.\n- item [link](u)\n---\n\n***\n“Don’t”", "en", "s", 1),
    (2, "﻿café caf&eacute; café 😀 swam\r\nnext", None, None, 2),
    (3, None, "en", "s", 3),
    (4, "", "en", "s", 4),
    (5, "... \n\n<br>\n", "en", "s", 5),
    (6, "swam " * 30_000, "en", "hot", 6),
]


def test_blocks_equal_brute_force(spark):
    got = {(r.doc_id, r.line_start): r for r in N.block_passages(docs(spark, MARKED)).collect()}
    want = {}
    for doc, text, lang, source, _ in MARKED:
        for first, last, block in blocks(file_lines(text)):
            if words := unicode_words(slow(block)[0]):
                want[doc, first] = (last, block, words, lang, source)
    assert {k: (r.line_end, r.line, r.toks, r.lang, r.source) for k, r in got.items()} == want
    assert {k[0] for k in want} == {1, 2, 6} and got[6, 1].n_tok == 30_000
    for r in got.values():
        assert len(r.starts) == len(r.ends) == r.n_tok and all(0 <= a < b <= len(r.line) for a, b in zip(r.starts, r.ends, strict=True))
    shown = [got[1, 3].line[a:b] for a, b in zip(got[1, 3].starts, got[1, 3].ends, strict=True)]
    assert got[1, 3].toks == ["he", "swam", "swam", "on"] and shown == ["He", "sw**a**m", "swa</i>m", "on"]
    assert got[2, 1].toks[:3] == ["café"] * 3
    assert N.block_passages(docs(spark, [])).count() == 0


def test_exact_index_shows_the_original(spark, tmp_path):
    spark.conf.set("spark.verbatlas.index.dir", str(tmp_path / "index"))
    try:
        docs(spark, MARKED[:5]).write.parquet(str(tmp_path / "documents.parquet"))
        e = Engine(spark, str(tmp_path), exact=True)
        rows = {(r.doc_id, r.line_start, r.i): r for r in e.kwic(["swam"], width=2).collect()}
        blocks_ = {(r.doc_id, r.line_start): r.line for r in e.passages().collect()}
        assert set(rows) == {(1, 3, 1), (1, 3, 2), (2, 1, 3)}
        for (doc, line, _), r in rows.items():
            assert r.node == blocks_[doc, line][r.start : r.end] and re.sub(r"[*<>/i]", "", r.node) == "swam"
            assert r.left in blocks_[doc, line] and r.right in blocks_[doc, line]
        assert (rows[1, 3, 1].left, rows[1, 3, 1].right) == ("He", "&amp; <i>swa</i>m\non")
        assert [r.total for r in concord.kwic_totals(e.index, ["swam"]).collect()] == [3]
        assert e.kwic(["he", "swam"]).first().node == "He sw**a**m" and e.search("café").count() == 1
        assert e.kwic(["don't"]).first().node == "Don’t"
        docs(spark, [(7, "sw_a_m swam", "en", "s", 7)]).write.mode("append").parquet(str(tmp_path / "documents.parquet"))
        e.rebuild()  # an increment is exact as well
        assert len(e.index.state.segments) == 2 and e.kwic(["swam"]).count() == 4
        plain = Engine(spark, str(tmp_path))
        assert plain.index.folder != e.index.folder and "starts" not in plain.passages().columns
    finally:
        spark.conf.unset("spark.verbatlas.index.dir")


@pytest.mark.parametrize("width", [1, 3])
def test_contexts_are_cut_by_places(spark, width):
    line = "One, two: three — four; five!"
    rows = N.exact_passages(spark.createDataFrame([(1, 1, line)], "doc_id long, line_start long, line string"))
    found = concord.kwic_original(concord.occurrences(rows, ["three"]), width).first()
    assert (found.left, found.node, found.right) == (("two:", "three", "— four") if width == 1 else ("One, two:", "three", "— four; five"))


def test_an_unlimited_concordance_sends_no_passages(spark, tmp_path):
    spark.conf.set("spark.verbatlas.index.dir", str(tmp_path / "index"))
    try:
        spark.createDataFrame([(1, "and **And** x &amp; and", "en", "s"), (2, "no\n\nx and", "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
        index = Engine(spark, str(tmp_path), exact=True).index
        found = concord.kwic(index, ["and"], extra=["node"], cut=lambda rows: concord.kwic_original(rows, 1))
        assert [(r.doc_id, r.line_start, r.i, r.node) for r in found.orderBy("doc_id", "line_start", "i").collect()] == [(1, 1, 0, "and"), (1, 1, 1, "And"), (1, 1, 3, "and"), (2, 3, 1, "and")]
        by_lang = concord.kwic(index, ["and"], sort="lang", extra=["node"], cut=lambda rows: concord.kwic_original(rows, 1))
        assert sorted(map(tuple, by_lang.collect())) == sorted(map(tuple, found.collect()))
        plan = found._jdf.queryExecution().optimizedPlan()
        assert "Join" not in plan.toString()
        while plan.nodeName() != "Sort":
            plan = plan.children().head()
        assert {a.name() for a in [plan.output().apply(k) for k in range(plan.output().size())]} <= {"doc_id", "line_start", "i", "l1", "r1", "node"}
    finally:
        spark.conf.unset("spark.verbatlas.index.dir")
