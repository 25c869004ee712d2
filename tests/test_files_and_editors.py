"""Sources of files, normalisation, filters, editors, tagger rules and the engine object."""

import json
import os

import pytest
from pyspark.sql import functions as F

from verbatlas.engine import Engine
from verbatlas.functions import normalise as N
from verbatlas.functions.text import fnv1a
from verbatlas.operators import concord, editors, filters, search, tagger
from verbatlas.plans.fixtures import LIBRARY, RECORDS
from verbatlas.sources import files, store
from verbatlas.sources.corpus import passages

WORK = "---\ntitle: \"A: b\"\nauthors: [Ada, 'B, C']\ntopics:\n  - one\n  - 'two'\nurl: https://example.org/x:1\nempty:\n---\n# Head\n\nBody\n"


def test_files(spark, tmp_path):
    for name, data in {"a/x.md": WORK.encode(), "a/.hidden/y.md": b"no", "a/z.txt": b"no", "b/bad.md": b"\xef\xbb\xbf---\r\ntitle: T\r\n...\r\nbo\xffdy\r\n", "b/skip.md": b"# H"}.items():
        os.makedirs(os.path.dirname(tmp_path / name), exist_ok=True)
        (tmp_path / name).write_bytes(data)
    found = files.discover(spark, str(tmp_path), exclude=("**/skip*",))
    assert [r.path for r in found.collect()] == ["a/x.md", "b/bad.md"]
    docs = files.documents(files.parsed(found))
    a, b = docs.orderBy("path").collect()
    assert (a.title, a.author, a.topics, a.public_url) == ("A: b", "Ada", ["one", "two"], "https://example.org/x:1")
    assert b.title == "T" and b.topics == [] and b.public_url is None
    assert files.documents(files.parsed(found), required=("topics",)).count() == 1 and files.documents(files.parsed(found), required=("empty",)).count() == 0
    fields, first, body = files.front_matter(WORK)
    assert fields["authors"] == ["Ada", "B, C"] and first == 10 and body[0] == "# Head"
    assert files.front_matter("---\nnever ends") == ({}, 1, ["---", "never ends"])


def test_json_lines(spark):
    lines = ['{"key":"a","themes":["x"],"entities_typed":[{"name":"Ada ","type":"person"}]}', '{"key":"a","ai_related":true}', '{"key":"b","themes":"x"}', '{"key":" "}', "", "not json", '{"key":"c","ai_related":1}', '{"key":"d","month":"2016-06"}', '{"key":"e', json.dumps({"key": "f", "path": "x" * (1 << 20)})]
    rows, report = files.tag_rows(spark.createDataFrame(list(enumerate(lines)), "line long, text string"))
    got = {r.key: r for r in rows.collect()}
    assert set(got) == {"a", "d"} and got["a"].ai_related is True and got["a"].themes is None and got["d"].month == "2016-06"
    assert tuple(report.first()) == (3, 6)


def test_records_briefings_themes(spark):
    good = "---\nid: fair\nname: Fair\naliases: [Big, Small]\nstart: 2016-06-01\nmembers: [2016-06/E01]\n---\nText.\n"
    rows = files.event_records(spark.createDataFrame([("e/fair.md", good), ("e/other.md", good), ("e/bad.md", good.replace("fair\n", "bad\n").replace("2016-06-01", "June")), ("e/ctl.md", "\x01"), ("e/none.md", "x")], "path string, text string")).collect()
    assert {r.path: r.why for r in rows} == {"e/fair.md": None, "e/other.md": "id is not the file's name", "e/bad.md": "start is no date", "e/ctl.md": "control characters", "e/none.md": "no id"}
    assert rows[0].aliases == ["Big", "Small"] and rows[0].description == "Text."
    text = json.dumps({"overview": "o", "events": [{"id": "E01", "name": "Fair", "date": "2016-06-01"}, {"id": "E02", "name": "X"}]})
    found = files.briefings(spark.createDataFrame([("2016-06-briefing.json", text), ("2016-Q3-briefing.json", text), ("x.json", text), ("2016-07-briefing.json", "{}")], "path string, text string"))
    assert [r.period for r in found.collect()] == ["2016-Q3", "2016-06"]
    held = spark.createDataFrame([("2016-06/E01", "fair")], "member string, record string")
    assert {(r.member, r.record) for r in files.briefing_events(found, held).collect()} == {("2016-06/E01", "fair"), ("2016-06/E02", None), ("2016-Q3/E01", None), ("2016-Q3/E02", None)}
    assert [t["name"] for t in files.theme_list('{"themes":[{"name":"Work"},{"name":" work "},{"name":"Play","definition":"d"}]}')] == ["Work", "Play"]
    with pytest.raises(ValueError):
        files.theme_list('{"themes":[{"name":""}]}')


def test_archive_round_trip(spark, tmp_path):
    records = [{"text": "one\ntwo", "saved_at": "2016-06-23", "tags": ["a", "b c"], "color": "blue"}, {"text": "> odd ---", "saved_at": None, "tags": [], "color": None}]
    text = files.render_work({"title": 'A: "b"\nc', "author": "Ada"}, records)
    assert files.front_matter(text)[0] == {"title": ['A: "b"\nc'], "author": ["Ada"]}
    assert [{k: h[k] for k in records[0]} for h in files.highlights_of(text)] == records
    df = spark.createDataFrame([("w", "T", "Ada", records)], "slug string, title string, author string, records array<struct<text: string, saved_at: string, tags: array<string>, color: string>>")
    assert [r.path for r in files.write_archive(df, str(tmp_path / "out")).collect()] == ["w.md"]
    back = files.highlights(files.discover(spark, str(tmp_path / "out")).select("path", "text")).collect()
    assert [h.text for h in back] == ["one\ntwo", "> odd ---"]


def test_normaliser():
    assert N.exact_tokens("*He <u>sw**a**m</u>.*") == ["he", "swam"]
    assert N.exact_tokens("P*1 and P*2") == ["p", "1", "and", "p", "2"]
    assert N.normalise("a &amp;amp; b").text == "a & b"
    assert N.normalise("see [it](https://x.org/y) at https://z.org now").text == "see it at   now"
    assert N.normalise("<p>a</p><br>b “c”").text == ' a  b "c"'
    text = "x <b>sw**a**m</b> &eacute; café [l](u) end"
    m = N.normalise(text)
    assert len(m.at) == len(m.text) and all(a < b <= len(text) for a, b in m.at)
    at = m.text.index("swam")
    assert text[m.at[at][0] : m.at[at + 3][1]] == "sw**a**m" and "é" in m.text and m.text.endswith("café l end")
    assert N.normalise("Ad line\nreal", boilerplate=("Ad .*",)).text == "real"
    assert N.normalise("**a**", without=("emphasis",)).text == "**a**" and set(N.traced("x")) == set(N.STAGES)
    assert N.multiset_minus(["a", "b", "a"], ["a"]) == ["b", "a"]


def test_sentences_and_citations():
    text = "- Dr. Who came. He left! Did A. Byron see? yes"
    assert [text[a:b] for a, b in N.sentence_spans(text)] == ["Dr. Who came.", "He left!", "Did A. Byron see?", "yes"]
    assert text[slice(*N.best_sentence(text, ["he", "left", "byron"]))] == "He left!" and N.best_sentence(text, ["zz"]) is None
    assert N.citation("writing", "Ada", "Looms", "23 June 2016", "https://e.org") == "[Ada, *Looms*, 23 June 2016](https://e.org)"
    assert N.split_passage_id(N.passage_id("w", "a:b.md", 7)) == ("w", "a:b.md", 7) and N.split_passage_id("w:7") is None


def test_clean_report_and_exact_passages(spark):
    rows = spark.createDataFrame([(1, 1, "a &amp;amp; b"), (1, 2, "sw**a**m"), (2, 1, "sw**a**m fast"), (2, 2, "plain")], "doc_id long, line_start long, line string")
    got = {r.stage: r for r in N.cleaning(rows).collect()}
    assert (got["emphasis"].passages, got["emphasis"].difference, got["emphasis"]["count"], got["emphasis"].doc_id) == (2, "sw a m > swam", 2, 1)
    assert [r.toks for r in N.exact_passages(rows).orderBy("doc_id", "line_start").collect()] == [["a", "b"], ["swam"], ["swam", "fast"], ["plain"]]


def test_filters():
    with pytest.raises(ValueError):
        filters.DocFilter(after="June").validate()
    with pytest.raises(ValueError):
        filters.DocFilter(months=["2016-13"]).validate()
    assert filters.from_query({"date": "2003-2005"}).before == "2006-01-01" and filters.from_query({"date": "2016"}).year == 2016
    with pytest.raises(ValueError):
        filters.from_query({"date": "2003-2005", "after": "2004"})
    corpora, f = filters.parse_slice('writing lang:en author:"Ada B" theme:Work theme:Play', ("writing", "posts"))
    assert corpora == ["writing"] and f.author == "Ada B" and f.themes == ["Work", "Play"]
    assert filters.parse_slice(filters.to_slice(corpora, f), ("writing",)) == (corpora, f)
    for bad in ("loom", "writing -x", "writing tag:a"):
        with pytest.raises(ValueError):
            filters.parse_slice(bad, ("writing",))


def test_event_editor():
    of = lambda r: editors.Record(r[0], r[1], tuple(r[2]), r[3], r[4], tuple(r[5]), "model", None, r[6], r[7])
    e = editors.EventEditor({r[0]: of(r) for r in RECORDS.rows}, today="2018-02-02")
    assert e.set("2004-01-play", name="P", drop_aliases=("THE PLAY",), add_aliases=("x", "X")).aliases == ("x",)
    for refused in (lambda: e.set("2004-01-play", end="2003-01-01"), lambda: e.set("2004-01-play", drop_aliases=("zz",)), lambda: e.remove("2016-07-fair"), lambda: e.merge("2016-07-fair", "2004-01-play"), lambda: e.merge("gone", "2004-01-play"), lambda: e.merge("2016-08-end", "2016-06-fair"), lambda: e.merge("2004-01-play", "2016-06-fair", "model"), lambda: e.unmerge("m000001")):
        before = dict(e.records)
        with pytest.raises(editors.Refused):
            refused()
        assert e.records == before
    assert e.create("Ďábel fair!", "2019-01-02").id == "2019-01-dabel-fair" and e.create("Ďábel fair", "2019-01-03").id == "2019-01-dabel-fair-2"
    line = e.merge("2019-01-dabel-fair-2", "2019-01-dabel-fair")
    assert line["id"] == "m000001" and e.in_effect(line) and e.root("2019-01-dabel-fair-2") == "2019-01-dabel-fair"
    e.unmerge("m000001")
    assert not e.in_effect(line) and e.records["2019-01-dabel-fair-2"].merged_into is None
    assert "2016-07-fair: merged without a line" in e.check()
    pairs = [{"a": "2019-01-dabel-fair", "b": "2019-01-dabel-fair-2", "verdict": "same", "confidence": "confident"}, {"a": "nobody", "b": "gone", "verdict": "same", "confidence": "confident"}, {"a": "2019-01-dabel-fair-2", "b": "2019-01-dabel-fair", "verdict": "same", "confidence": "confident"}]
    dry = e.apply_proposals(pairs, {}, apply=False)
    assert dry == [(pairs[0]["a"], pairs[0]["b"], "2019-01-dabel-fair-2 into 2019-01-dabel-fair"), ("nobody", "gone", "no-record"), (pairs[2]["a"], pairs[2]["b"], "already-one-event")]
    assert e.records["2019-01-dabel-fair-2"].merged_into is None and e.apply_proposals(pairs, {}, apply=True) == dry and e.records["2019-01-dabel-fair-2"].merged_into


def test_unmerge_is_refused_where_two_would_claim_a_member():
    of = lambda ident, *members, into=None: editors.Record(ident, ident, members=members, merged_into=into)
    e = editors.EventEditor({r.id: r for r in (of("a", "2016-06/E01", "A"), of("b", "2016-06/e01", "2016-07/E02"), of("c", "2016-07/E02", into="a"), of("d", "x"))})
    line = e.merge("a", "b")
    assert e.unmerge_faults("a") == ["2016-06/e01 would be claimed by a and b", "2016-07/e02 would be claimed by a and b"]
    with pytest.raises(editors.Refused):
        e.unmerge(line["id"])
    assert e.in_effect(line) and e.unmerge_faults("d") == []
    e.records["a"], e.records["c"] = editors.Record("a", "a", merged_into="b"), editors.Record("c", "c", merged_into="a")
    e.unmerge(line["id"])
    assert e.records["a"].merged_into is None and e.root("c") == "a"


def test_corrections_log_registry_capture(tmp_path):
    c = editors.CorrectionEditor({"a": ["Work"], "b": []})
    assert c.change("a", "add", "Play")["id"] == "c000001" and c.state()["a"] == ["Work", "Play"]
    with pytest.raises(editors.Refused):
        c.change("a", "add", "PLAY")
    c.change("a", "remove", "play")
    with pytest.raises(editors.Refused):
        c.undo("c000001")
    c.undo("c000002")
    assert c.state() == {"a": ["Work", "Play"], "b": []}
    log = editors.Log(str(tmp_path / "log.jsonl"))
    log.append({"a": 1}, 0)
    with pytest.raises(editors.Refused):
        log.append({"a": 2}, 0)
    assert log.read() == [{"a": 1}]
    os.symlink(log.path, tmp_path / "link")
    with pytest.raises(editors.Refused):
        editors.Log(str(tmp_path / "link")).ready()
    r = editors.Registry.parse('[[corpus]]\nid = "w"\npath = "/x"\ninclude = ["**/*.md"]\n')
    assert editors.Registry.parse(r.render()).corpora == r.corpora
    with pytest.raises(editors.Refused):
        r.add("w", path="/y")
    r.remove("w")
    receipt = editors.capture(str(tmp_path), "note", "user", "Über uns", "text", "2018-01-01")
    assert receipt["file"] == "2018-01-01-uber-uns.md" and editors.captured(str(tmp_path), {receipt["file"]: "n.md"})[0]["file"] == "n.md"


def test_tagger_rules(spark):
    assert sorted(tagger.shuffled(50, 7)) == list(range(50)) and tagger.shuffled(50, 7) == tagger.shuffled(50, 7) != tagger.shuffled(50, 8)
    assert tagger.packed([10, 10, 15, 30, 1], 2, 30) == [[0, 1], [2], [3], [4]]
    assert tagger.run_cost(300_000, 1000, 2.0, 10.0, 200_000, 2.0, batch=True) == pytest.approx(0.61)
    assert tagger.structural_problem(100, 3, 0) and tagger.structural_problem(100, 1, 20) and not tagger.structural_problem(100, 2, 15)
    assert tagger.extension_problems(["A", "B"], ["A", "B", "C"]) == [] and tagger.extension_problems(["A", "B"], ["B", "A", "a"]) == ["the order of old names changed", "repeated: a"]
    assert tagger.gist_length(spark.createDataFrame([("x" * 200,)] * 10, "gist string"), 650) == 60
    assert tagger.qa_sample([f"k{i}" for i in range(300)], ["k1", "zz"], most=101)[-1] in ("k1", "zz")


def test_search_rules(spark):
    assert search.mode_of("auto", True, "current") == "hybrid" and search.mode_of("auto", True, "stale") == "fts"
    with pytest.raises(ValueError):
        search.mode_of("semantic", True, "missing")
    meta = {"model": "m", "generation": 3, "scheme": "s"}
    assert [search.vector_freshness(x, "m", 3, "s") for x in (None, meta, meta | {"generation": 2})] == ["missing", "current", "stale"]
    df = spark.createDataFrame([([["a", "b"], ["b", "c", "b"], ["c", "b"]],)], "s array<array<string>>")
    assert df.select(search.locate(F.col("s"), ["b", "c"])).first()[0] == 1
    assert [int(h) for h in fnv1a(["foobar", "", "a"])] == [0x85944171F73967E8, 0xCBF29CE484222325, 0xAF63DC4C8601EC8C]
    v = spark.createDataFrame([(["a", "b"],), ([],), (None,)], "toks array<string>").select(search.hash_embedding(F.col("toks"), 8)).collect()
    assert abs(sum(x * x for x in v[0][0]) - 1) < 1e-9 and v[1][0] == [0.0] * 8 and v[2][0] is None
    assert concord.kwic_command("a", "it's", 5, {"lang": "en"}) == "kwic a --near 'it'\\''s' --window 5 --lang en"


def test_pairs_are_capped_as_a_greedy_pass_does(spark):
    import random

    r = random.Random(2)
    for most in (1, 3, 6):
        pairs = [(a, b, r.randrange(4)) for a in range(40) for b in range(a + 1, 40) if r.random() < 0.4]
        used, want = dict.fromkeys(range(40), 0), []
        for a, b, score in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
            if used[a] < most and used[b] < most:
                want.append((a, b, score))
                used[a], used[b] = used[a] + 1, used[b] + 1
        df = spark.createDataFrame(pairs, "a long, b long, score int")
        assert sorted(map(tuple, tagger.capped_pairs(df, [F.desc("score")], most).collect())) == sorted(want)
    assert tagger.capped_pairs(df.limit(0), [F.desc("score")]).count() == 0


def test_quotes_in_every_form_of_marks(spark):
    docs = spark.createDataFrame([(1, 'He said\n“don’t panic”, don\'t, ok.\nV’s point'), (2, 'say "don\'t panic"'), (3, None)], "doc_id long, text string")
    quotes = spark.createDataFrame([("a", "don't panic"), ("b", ' "don‘t panic" '), ("c", "don’t"), ("d", "dont"), ("e", " "), ("f", None), ("g", "V's point"), ("h", "don’t panic”, don't, ok.\nV's")], "item_id string, text string")
    found = sorted(tuple(x) for x in search.verify_quotes(docs, quotes).collect())
    assert found == [
        ("a", 1, 10, 2, "don’t panic"), ("a", 2, 6, 1, "don't panic"), ("b", 1, 9, 2, "“don’t panic”"), ("b", 2, 5, 1, '"don\'t panic"'), ("c", 1, 10, 2, "don’t"), ("c", 1, 24, 2, "don't"), ("c", 2, 6, 1, "don't"),
        ("g", 1, 35, 3, "V’s point"), ("h", 1, 10, 2, "don’t panic”, don't, ok.\nV’s"),
    ]


def test_engine_and_index(spark, tmp_path):
    rows = [(1, "The cat, and the dog.\nAnd the end!", "en", "s1"), (2, "a cat\nThe THE dog cat", "en", "s2"), (3, "le chat", "fr", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.verbatlas.index.dir", str(tmp_path / "index"))
    try:
        names = {"corpus": "lang", "title": "CASE doc_id WHEN 1 THEN 'First piece' WHEN 2 THEN 'Second' ELSE 'Third piece' END", "date": "concat(2000 + doc_id * 3, '-02')"}
        e = Engine(spark, str(tmp_path), names)
        lines = e.kwic(["the"]).collect()
        assert len(lines) == 5 and e.kwic_totals(["the"]).first().total == 5
        assert {(x.left, x.node, x.right) for x in lines if x.doc_id == 1} == {("", "The", " cat, and the dog."), ("The cat, and ", "the", " dog."), ("And ", "the", " end!")}
        assert e.status().first().tokens == 16 and e.dist(["the"]).first().hits == 5
        assert e.passages(filters.DocFilter(lang=["FR"])).count() == 1
        assert sorted(r.doc_id for r in e.search("dog").collect()) == [1, 2] and e.search("chat lang:fr").first().doc_id == 3
        with pytest.raises(ValueError):
            e.search(" ")
        assert e.cite(1, 1, ["dog"])["sentence"] == "The cat, and the dog." and e.cite(9, 9) is None
        assert [(r.doc_id, r.line_start, r.terms, r.closest) for r in e.similar([(1, 1)]).collect()] == [(2, 2, "dog cat", 0)]
        assert json.loads(e.to_json(e.facets("cat", {"langs": "lang"}))) == [{"facet": "langs", "value": "en", "count": 2}]
        # sort, filters, fields and modes
        ids = lambda *a, **b: [r.doc_id for r in e.search(*a, **b).filter("passage = 1").collect()]
        assert ids("cat", sort="newest") == [2, 1] and ids("cat", sort="oldest") == [1, 2] and ids("cat after:2005") == [2] and ids("cat source:S1") == [1]
        assert ids("end title:first") == [1] and ids("cat AND first") == [1] and ids("/^a cat/") == [2] and sorted(ids("dog -end")) == [1, 2]
        assert e.search("cat in:fr").count() == 0 and e.search("chat in:fr").first().title == "Third piece"
        for wrong in ("cat nothing:1 after:x", "tag:x cat"):
            with pytest.raises(ValueError):
                e.search(wrong)
        for how in ({"mode": "semantic"}, {"mode": "hybrid"}, {"sort": "newest", "mode": "semantic"}, {"sort": "best"}):
            with pytest.raises(ValueError):
                e.search("cat", **how)
        assert e.build_vectors() == 1 and e.build_vectors() == 0
        assert e.search("the cat and the dog", mode="semantic").first().doc_id in (1, 2)
        assert {r.doc_id for r in e.search("dog").collect()} == {1, 2} and e.search("dog lang:fr", mode="hybrid").count() == 0
        assert e.cite(3, 1)["citation"] and e.cite(3, 1)["path"] == "3"
        with pytest.raises(ValueError):
            e.to_json(e.index.passages, most=2)
        # what changes is indexed, and vectors of the rest stay
        later = spark.createDataFrame([(1, "new text here and now again", "en", "s1"), (3, "le chat", "fr", "s1"), (4, "added one", "en", "s3")], docs.schema)
        later.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        e.rebuild()
        assert e.status().first().docs == 3 and e.kwic(["the"]).count() == 0
        with pytest.raises(ValueError):
            e.search("cat", mode="semantic")
        assert e.build_vectors() == 1 and e.search("again", mode="semantic").first().doc_id == 1
        fields = store.field_rows(LIBRARY.df(spark).withColumnsRenamed({"doc": "doc_id", "themes": "topics"}).withColumn("summary", F.lit(None).cast("string")))
        assert fields.filter("field = 'topic'").count() == 8
    finally:
        spark.conf.unset("spark.verbatlas.index.dir")
