"""The engine against its SQL twins, and the invariants that tie its views together."""

import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from verbatlas.functions.stats import log_dice, log_likelihood, mutual_information
from verbatlas.functions.text import date_floor, fold
from verbatlas.operators import concord, layers, search, topics
from verbatlas.plans import catalogue
from verbatlas.sources.corpus import frontmatter, passages

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(DIR):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{DIR}/{name}')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_sql(spark, db, name):
    df = catalogue.QUERIES[name](spark, DIR)
    found = db.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in found.description]
    theirs = sorted(tuple(repr(dict(zip(columns, r, strict=True))[c]) for c in sorted(columns)) for r in found.fetchall())
    assert sorted(columns) == sorted(df.columns)
    assert sorted(tuple(repr(r[c]) for c in sorted(columns)) for r in df.collect()) == theirs


def rows_of(spark, *texts):
    return passages(spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string"))


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_counts_agree(spark):
    p = rows_of(spark, "the cat and the dog\nand the end", "a cat\n\nThe THE", "")
    hits = concord.kwic(p, ["the"]).count()
    assert hits == 5
    assert concord.distribution(p, ["the"], "lang").first().hits == hits
    assert concord.row_distribution(p, ["the"]).agg(F.sum("hits")).first()[0] == hits
    assert concord.collocates(p, "the", least=1, keep_stopwords=True).filter("word = 'and'").first()["count"] == concord.kwic(p, ["the"], near="and", width=4).count()


def test_collocate_scores(spark):
    one = spark.range(1)
    n = lambda x: F.lit(float(x))
    got = one.select(log_dice(n(3), n(3), n(3)), log_dice(n(1), n(3), n(1)), log_likelihood(n(10), n(5), n(1000), n(2000)), log_likelihood(n(0), n(6), n(100), n(100))).first()
    assert list(got) == [14.0, 13.0, 6.931, 8.318]
    assert one.select(mutual_information(n(3), n(3), n(3), n(8), 2)).first()[0] == 0.415


def test_scalars(spark):
    df = spark.createDataFrame([("2004",), ("2003-5",), ("2016-06-23T10:00",), ("soon",)], "d string")
    assert [r[0] for r in df.select(date_floor(F.col("d"))).collect()] == ["2004-01-01", "2003-05-01", "2016-06-23", None]
    assert spark.createDataFrame([("  A ‘B’\n c ",)], "t string").select(fold(F.col("t"))).first()[0] == "a 'b' c"


def test_frontmatter(spark):
    df = spark.createDataFrame([("a.md", "---\r\ntitle: 'T: x'\r\nlang: en\r\n---\r\nbody\r\n"), ("b.md", "no head")], "path string, text string")
    a, b = frontmatter(df).orderBy("path").collect()
    assert a.fields == {"title": "T: x", "lang": "en"} and a.body == "body\n"
    assert b.fields == {} and b.body == "no head"


def test_logs(spark):
    log = spark.createDataFrame([(1, "k", None, "a"), (2, "k", 1, None), (3, "k", None, "b"), (4, "other", 3, None)], "id long, key string, undoes long, value string")
    assert [r.value for r in topics.undone(log).collect()] == ["b"]
    base = spark.createDataFrame([("k", "a"), ("k", "b")], "key string, value string")
    ops = spark.createDataFrame([("k", 2, "add", "c"), ("k", 1, "remove", "a"), ("k", 3, "add", "b")], "key string, line long, op string, value string")
    assert sorted(r.value for r in layers.fold_sets(base, ops).collect()) == ["b", "c"]
    links = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 5), (5, 4), (6, 9)], "id long, into long")
    assert {r.id: r.root for r in layers.resolve_chains(links).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}


def test_quotes_at_every_place(spark):
    text = 'He said "the quick brown fox" (and the lazy dog, too) at the end. 漢字 the quick brown fox'
    quotes = ["the quick brown fox", "quick brown", "the lazy dog", "and the lazy", "dog", "ick brown fo", "(and the lazy dog, too)", "the end.", "no such words in here", "", "漢字 the quick brown fox", "the slow dog"]
    docs = spark.createDataFrame([(1, text), (None, "the lazy dog"), (2, "aaaa" * 10), (3, None), (4, "")], "doc_id long, text string")
    frame = spark.createDataFrame([*enumerate(quotes), (50, "aaaa" * 4), (51, "aaa"), (52, None)], "item_id long, text string")
    want = set()
    for item, quote in [*enumerate(quotes), (50, "aaaa" * 4), (51, "aaa")]:
        for doc, whole in [(1, text), (None, "the lazy dog"), (2, "aaaa" * 10)]:
            at = -len(quote)
            while quote and (at := whole.find(quote, at + len(quote) if at >= 0 else 0)) >= 0:
                want.add((item, doc, at + 1))
    assert {tuple(x)[:3] for x in search.verify_quotes(docs, frame).collect()} == want
    assert len(want) == 29
    least = {}
    for item, doc, at in want:
        least[item, doc] = min(at, least.get((item, doc), at))
    assert {(x.item_id, x.doc_id): x["at"] for x in search.verify_quotes(docs, frame, first=True).collect()} == least


def test_what_is_blank_around_a_quote(spark):
    docs = spark.createDataFrame([(1, "an end.\nand"), (2, "an end. and")], "doc_id long, text string")
    quotes = spark.createDataFrame([(7, " end.\n"), (8, " an end of this place\n "), (9, "end.\n\n")], "item_id long, text string")
    found = lambda **how: sorted((r.item_id, r.doc_id, r.original) for r in search.verify_quotes(docs, quotes, **how).collect())
    assert found(blank=r"\p{Zs}") == [(7, 1, "end.\n")]
    assert found() == [(7, 1, "end."), (7, 2, "end."), (9, 1, "end."), (9, 2, "end.")]


def test_names_are_compared_as_classes(spark):
    names = ["red bolt", "Bolt  red", "red ring", "red", "blue ring", "x", None, "red bolt"]
    found = topics.name_pairs(spark.createDataFrame(list(enumerate(names)), "id long, name string"))
    own = {i: set(n.lower().split()) for i, n in enumerate(names) if n}
    share = {(i, j): len(a & b) / len(a | b) for i, a in own.items() for j, b in own.items() if i < j}
    assert {(r.id, r.id2): r.jaccard for r in found.collect()} == {p: round(s, 3) for p, s in share.items() if s >= 0.5}
    compared = [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "array_intersect" in x]
    assert compared and not any("id2#" in x or "id#" in x for x in compared)


def test_pairs_of_names_are_opened_out_of_tiles(spark, monkeypatch):
    monkeypatch.setattr(topics, "TILE", 5, raising=False)
    names = ["red bolt"] * 33 + ["red bolt gear"] * 12 + ["blue rod"] * 2 + ["blue"] + [None, None, "", ""]
    found = topics.name_pairs(spark.createDataFrame(list(enumerate(names)), "id long, name string").repartition(3))
    own = {i: set(n.split(" ")) for i, n in enumerate(names) if n is not None}
    share = {(i, j): len(a & b) / len(a | b) for i, a in own.items() for j, b in own.items() if i < j}
    assert sorted((r.id, r.id2, r.jaccard) for r in found.collect()) == sorted((*p, round(s, 3)) for p, s in share.items() if s >= 0.5)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert [x for x in re.findall(r"Join|Generate", plan)][:3] == ["Generate", "Generate", "Join"]  # no join makes a row a pair


@pytest.mark.parametrize("frequent, named", [(2, 4), (2, 50), (3, 3), (500, 2000)])
def test_ngrams_of_frequent_words_are_all(spark, monkeypatch, frequent, named):
    monkeypatch.setattr(concord, "FREQUENT", frequent)
    monkeypatch.setattr(concord, "NAMED", named)
    texts = ["the cat of the dog", "rare words stand here", "rare words stand here", "the the of cat", "rare words", "x y z rare words"]
    rows = rows_of(spark, *texts)
    for sizes, strict in (((1, 2, 3), False), ((2, 3), True), ((3,), False)):
        every = {}
        for k, t in enumerate(texts):
            ws = t.split()
            for n in sizes:
                for i in range(len(ws) - n + 1):
                    if sum(w in concord.STOPWORDS for w in ws[i : i + n]) < (max(n - 1, 1) if strict else n):
                        every.setdefault((n, " ".join(ws[i : i + n])), []).append(k)
        for top in (1, 3, 40):
            best = sorted(((n, g, len(ks), len(set(ks))) for (n, g), ks in every.items()), key=lambda r: (-r[2], r[1]))[:top]
            assert [tuple(r) for r in concord.ngrams(rows, sizes, top, strict).collect()] == best


def test_events_meet_once_a_shared_signal(spark):
    from verbatlas.operators import tagger

    spans = [(1, 1, 9, "ab"), (2, 3, 4, "abc"), (3, 9, 20, "b"), (4, 14, 14, "a"), (5, 15, 16, "abc"), (6, 1, 30, "c")]
    day = lambda k: f"2024-01-{k:02}"
    events = spark.createDataFrame([(i, day(s), day(e), list(w)) for i, s, e, w in spans], "id long, start string, end string, signals array<string>")
    expected = {(i, j): (max(0, max(s, s2) - min(e, e2)), len(set(w) & set(w2))) for i, s, e, w in spans for j, s2, e2, w2 in spans if i < j and set(w) & set(w2) and max(s, s2) - min(e, e2) <= 5}
    found = tagger.merge_candidates(events, gap=5)
    assert {(r.a, r.b): (r.gap_days, r.shared) for r in found.collect()} == expected


@pytest.mark.parametrize("signals, most_batches", [(20, 9), (70, 9), (2000, 9)])
def test_merge_candidates_go_in_batches(spark, monkeypatch, signals, most_batches):
    import random

    from verbatlas.operators import tagger

    r, tables = random.Random(signals), []
    write = tagger.written
    monkeypatch.setattr(tagger, "written", lambda df: tables.append(1) or write(df))
    monkeypatch.setattr(tagger, "BATCH", 300, raising=False)
    spans = [(i, s, s + r.randrange(9), {r.randrange(signals) for _ in range(signals // 2 if signals < 99 else 60)}) for i in range(120) for s in [1 + r.randrange(15)]]
    spans += [(i, s, e, w) for i, (s, e, w) in enumerate([(3, 5, {0, 1, 2})] * 40, 200)]  # ties: the order of ids decides
    day = lambda k: f"2024-01-{k:02}"
    events = spark.createDataFrame([(i, day(s), day(e), [f"w{x}" for x in w] + [None]) for i, s, e, w in spans], "id long, start string, end string, signals array<string>")
    pairs = [(-len(w & w2), max(0, max(s, s2) - min(e, e2)), i, j) for i, s, e, w in spans for j, s2, e2, w2 in spans if i < j and w & w2 and max(s, s2) - min(e, e2) <= 5]
    used, want = {}, []
    for shared, away, a, b in sorted(pairs):
        if used.get(a, 0) < 6 and used.get(b, 0) < 6:
            want.append((a, b, away, -shared))
            used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
    assert sorted(map(tuple, tagger.merge_candidates(events, gap=5).collect())) == sorted(want)
    assert len(pairs) > 3 * 300 and len(tables) <= 3 + 2 * most_batches  # a round of the best pairs at both ends took two tables each
