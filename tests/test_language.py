"""The search language, partial dates, ids and word borders against worked-out values."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from verbatlas.functions import dates, ids, strings
from verbatlas.functions.stem import stems_of
from verbatlas.functions.text import STOPWORDS, unicode_tokens, unicode_words
from verbatlas.operators import index2, search
from verbatlas.plans.grammar import BLANKS, Term, date_range, only_corpus, parse, quote, scan
from verbatlas.sources.corpus import passages


def test_scan():
    assert len(set(BLANKS)) == 25 and list(STOPWORDS) == sorted(STOPWORDS)
    assert scan('-"a \\"b\\" c"d /x y\\/z/im au:"J S" odd:x "open') == [("phrase", True, 'a "b" c'), ("term", "d"), ("pattern", "x y\\/z", "im"), ("field", "au", "J S"), ("term", "odd:x"), ("term", '"open')]
    assert scan("/a/B /unclosed a b “q„") == [("term", "/a/B"), ("term", "/unclosed"), ("term", "a"), ("term", "b"), ("phrase", False, "q")]
    for value in ("plain", "two words", 'a "quoted" \\ one', "", "“x”"):
        assert scan("theme:" + quote(value)) == [("field", "theme", value)]


def test_parse():
    q = parse('the generative metaph* -dull "at once" theme:a theme:"b c" tw:karpathy y:2016')
    assert q.any_of == [[Term("generative", "word"), Term("metaph", "prefix"), Term("at once", "phrase"), Term("karpathy", "word")]]
    assert q.without == [Term("dull", "word")] and q.repeated == {"theme": ["a", "b c"]}
    assert q.fields == {"theme": "b c", "type": "tweets", "date": "2016"}
    assert q.fts == '("generative" OR metaph* OR "at once" OR "karpathy") NOT "dull"'
    assert [[t.text for t in g] for g in parse("a1 b1 OR c1 | or").any_of] == [["a1", "b1"], ["c1"]]
    assert parse("a1 b1 OR c1 |").fts == '"a1" "b1" OR "c1"' and parse("a1 OR | b1").fts == '"a1" "b1"' and parse("OR a1 AND b1").fts == '"a1" "b1"'
    assert parse("the of").positive_terms == ["the", "of"] and parse("met", partial=True).fts == "met*"
    assert only_corpus("in:a  in:b") and only_corpus(" ") and not only_corpus("in:a i:") and parse("source:MyZotero").zotero


def test_date_range():
    want = {"2016": ("2016-01-01", "2017-01-01"), "2010-2015": ("2010-01-01", "2016-01-01"), "2016-": ("2016-01-01", None), "-2016": (None, "2017-01-01"), "2016-12": ("2016-12-01", "2017-01-01")}
    want |= {"2016-02-30": ("2016-02-30", "2016-03-02"), "2015-2010": None, "2016-13": None, "20162017": None, "-": None, "": None, "2016-1": None}
    assert {k: date_range(k) for k in want} == want


def test_search_text(spark):
    docs = [(1, "red apples fall\nthe apple is green"), (2, "green pears"), (3, "red pears and apples"), (4, None), (5, "")]
    rows = passages(spark.createDataFrame([(i, t, "en", "s") for i, t in docs], "doc_id long, text string, lang string, source string"))
    found = lambda q, **k: {r.doc_id: (r.line_start, r.cover) for r in search.search_text(rows, q, {"lang": "lang"}, **k).collect()}
    assert found("red apple") == {1: (1, 1.0), 3: (1, 1.0)}
    assert found("apple -red") == {1: (2, 1.0)} and found("green OR red pears") == {1: (2, 1.0), 2: (1, 1.0), 3: (1, 1.0)}
    assert found('"apples fall" lang:EN') == {1: (1, 1.0)} and found("apple lang:fr") == {} and found("apple /IS Green/i") == {1: (2, 1.0)}
    titles = spark.createDataFrame([(2, ["apple"]), (2, ["x"])], "doc_id long, toks array<string>")
    assert found("green apple", titles=titles) == {1: (2, 1.0), 2: (1, 0.5)}
    for bad in ("lang:en", "apple author:x"):
        with pytest.raises(ValueError):
            found(bad)


def shown(spark, f, *values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(f(F.col("v"))).collect()]


def test_dates(spark):
    assert shown(spark, dates.british_date, "2016-06-23", "2016-6", "2016", "2016-13", "2016-01-40", "1-2", None) == ["23 June 2016", "June 2016", "2016", None, None, None, None]
    assert shown(spark, dates.snowflake_time, "1939901126326764018", " 12 ", "x", None) == ["2025-07-01T04:17:24Z", None, None, None]
    assert shown(spark, dates.reference_date, "2003-03-00 3/2003", "2003-00-01", "2001-02-03 x", "0000-01-01", "x", "2003-a") == ["2003-03", "2003", "2001-02-03", None, None, "2003"]
    assert shown(spark, dates.is_date, "2024-02-29", "2023-02-29", "2024-2-1", None) == [True, False, False, False]
    assert shown(spark, dates.valid_month, " 2016 ", "2016-12", "2016-13", None) == [True, True, False, False]
    assert shown(spark, lambda v: dates.month_of(v, F.lit("2020-01")), "2016-06-23", "junk", None) == ["2016-06", "2020-01", "2020-01"]
    assert shown(spark, lambda v: dates.day_of(v, F.lit("2016-06")), "2016-06-23T1", "2016-07-01", "2016-06-31") == ["2016-06-23", None, None]
    assert shown(spark, dates.period_span, "2024-02", "2022-Q2", "2022-Q5") == [("2024-02-01", "2024-02-29"), ("2022-04-01", "2022-06-30"), None]


def test_ids(spark):
    assert shown(spark, lambda v: ids.numbered_id("c", v.cast("long")), "1", "1000000") == ["c000001", "c1000000"]
    assert shown(spark, lambda v: ids.number_of("c", v), "c000001", "c0000001", "c1000000", "c000000", "d000001") == [1, None, 1000000, None, None]
    assert shown(spark, ids.monthly_id, " 2026-09/e21 ", "2022-Q2/E01", "2022-Q5/E1") == ["2026-09/E21", "2022-Q2/E01", None]
    df = spark.createDataFrame([("2026-09/E10",), ("2026-09/E9",), ("2026-08/E99",)], "v string")
    assert [r.v for r in df.orderBy(ids.monthly_order(F.col("v"))).collect()] == ["2026-08/E99", "2026-09/E9", "2026-09/E10"]
    assert shown(spark, ids.doi_url, "10.1/x", "DOI: 10.1/x", "http://dx.doi.org/10.1/x", "x") == ["https://doi.org/10.1/x"] * 3 + [None]
    assert shown(spark, ids.status_handle, "https://x.com/a/status/1", "https://www.twitter.com/b/statuses/2", "https://y.com/a/status/1", "https://x.com/a") == ["a", "b", None, None]
    assert shown(spark, ids.percent, "a b*c~/é+") == ["a%20b%2Ac~%2F%C3%A9%2B"] and shown(spark, ids.file_url, "/a b/c") == ["file:///a%20b/c"]
    assert shown(spark, ids.slug, "  Crème Brûlée: 2nd!", "日本", None) == ["creme-brulee-2nd", "", ""]


def test_unicode_words(spark):
    assert unicode_words("Well-known a:b _x_ don't 3.14 ... it’s") == ["well", "known", "a:b", "x", "don't", "3.14", "it’s"]
    assert unicode_words(None) == [] and shown(spark, unicode_tokens, "A b", None) == [["a", "b"], []]


def test_stems_as_sqlite_has_them():
    texts = ["Running runners ran; relational conditionally", "žluťoučký kůň, café naïve", "generalizations oscillators' agreed hopping filing", "sky enjoys cries ties as is", "x" * 70 + "ing"]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(t, tokenize='porter unicode61')")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(f, 'instance')")
    db.executemany("INSERT INTO f(rowid, t) VALUES (?, ?)", enumerate(texts))
    found = [[t for (t,) in db.execute("SELECT term FROM v WHERE doc = ? ORDER BY offset", (k,))] for k in range(len(texts))]
    assert [stems_of(t) for t in texts] == found and stems_of(None) == stems_of("") == []


def test_fulltext_by_stems(spark):
    rows = spark.createDataFrame([(1, "Weaving looms", None), (2, "the loom", "weaves"), (3, None, None), (4, "loom of weavers", "x")], "id int, text string, note string")
    held = lambda *groups: [r.id for r in index2.matching(rows, list(groups), ("text", "note")).orderBy("id").collect()]
    assert held([("word", "weave")]) == [1, 2] and held([("prefix", "weav")]) == [1, 2, 4]
    assert held([("word", "weave")], [("word", "THE"), ("word", "x")]) == [2]
    assert held([("phrase", "loom weaves")]) == [] and held([("phrase", "weave loom")]) == [1]
    assert held([("word", "...")]) == [1, 2, 3, 4] and held([("word", "none")]) == []


def test_texts_on_their_way_out(spark):
    assert shown(spark, strings.terminal, "a\x1b[0m\nb\tc\u200d\u202e", None) == ["a\ufffd[0m\ufffdb\tc\u200d\ufffd", None]
    assert shown(spark, strings.terminal_lines, "a\nb\r") == ["a\nb\ufffd"] and shown(spark, strings.quoted, 'a"\\b') == ['"a\\"\\\\b"']
    assert shown(spark, strings.one_line, " a \n\u3000b ", "") == ["a b", ""] and shown(spark, strings.body_text, " a\r\nb\rc\u2028d\x00\ufeff\te \n") == ["a\r\nb\nc\nd\te"]
    assert shown(spark, strings.yaml_value, "a", 'a: "b"') == ["a", '"a: \\"b\\""'] and shown(spark, strings.like_escaped, "5%_\\") == ["5\\%\\_\\\\"]
    assert shown(spark, lambda v: strings.cut(v, 3), "ab😀c", "abcd", None) == ["ab", "abc", ""] and shown(spark, lambda v: strings.clip(v, 4), "ab😀c", "abcd", "a😀bc") == ["ab…", "abcd", "a😀…"]


def test_exact_terms_are_words_not_stems(spark):
    rows = spark.createDataFrame([(1, "of thes"), (2, "Of  thé x"), (3, "of\nthe"), (4, "off the")], "id long, text string")
    held = lambda *terms: [r.id for r in index2.matching(rows, [list(terms)], ("text",)).orderBy("id").collect()]
    assert held(("exact", "of the")) == [2, 3]
    assert held(("phrase", "of the")) == [1, 2, 3]
    assert held(("exact", "of the"), ("word", "offs")) == [2, 3, 4]
