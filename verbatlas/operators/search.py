"""Ranked search over passages, similar passages, vector and hybrid ranking, quotation checks."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbatlas.functions.stats import round6
from verbatlas.functions.text import PLAIN_QUOTES, QUOTES, STOPWORDS, TOKEN, date_floor, fnv1a, fold
from verbatlas.plans.grammar import Query, parse
from verbatlas.sources.store import similarity_weights, swept

K1, B = 1.2, 0.75


def _held(kind: str, value: str) -> Column:
    """How often a passage holds a term."""
    if kind == "phrase":
        words = value.split()
        node = F.array(*map(F.lit, words))
        return F.size(F.filter(F.sequence(F.lit(1), F.size("toks")), lambda i: F.slice("toks", i, len(words)) == node))
    if kind == "prefix":
        return F.size(F.filter("toks", lambda t: F.startswith(t, F.lit(value))))
    return F.size(F.filter("toks", lambda t: t == F.lit(value)))


def term_counts(rows: DataFrame, terms: list[tuple[str, str]]) -> DataFrame:
    """Per passage and term that it holds: doc_id, line_start, n_tok, term (number), tf.

    A term is ("word", w), ("prefix", w) or ("phrase", "w1 w2 ...")."""
    counts = [_held(kind, value).cast("long") for kind, value in terms]
    found = rows.select("doc_id", "line_start", "n_tok", F.posexplode(F.array(*counts)).alias("term", "tf"))
    return found.filter("tf > 0")


def posted(index, terms: list[tuple[str, str]], table: str = "postings", keys: tuple[str, ...] = ("doc_id", "line_start")) -> DataFrame:
    """``term_counts`` read from the postings of a stored index: the row groups of the terms' words, phrases by their places; n_tok of fields only."""
    from verbatlas.operators.concord import postings_of, shifted

    parts, every, sized = [], getattr(index, table), ["n_tok"] if table == "fields" else []
    for k, (kind, value) in enumerate(terms):
        own = F.lit(k).alias("term")
        if kind == "phrase" and table == "postings":
            parts.append(postings_of(index, value.split(), beside=False).select(*keys, own, F.size("starts").cast("long").alias("tf")))
        elif kind == "phrase":
            words = value.split()
            at = every.filter(F.col("word") == words[0]).select(*keys, *sized, "at")
            for j, word in enumerate(words[1:], 1):
                more = every.filter(F.col("word") == word).select(*keys, shifted("at", j).alias("at2"))
                at = at.join(more, [*keys]).withColumn("at", F.array_intersect("at", "at2")).drop("at2").filter(F.size("at") > 0)
            parts.append(at.select(*keys, *sized, own, F.size("at").cast("long").alias("tf")))
        elif kind == "prefix":
            hit = every.filter(F.startswith("word", F.lit(value)) & (F.col("word") >= value))
            parts.append(hit.groupBy(*keys, *sized).agg(F.sum("tf").alias("tf")).select(*keys, *sized, own, "tf"))
        else:
            parts.append(every.filter(F.col("word") == value).select(*keys, *sized, own, "tf"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _idf(n: Column, df: Column) -> Column:
    idf = F.ln((n - df + 0.5) / (df + 0.5))
    return F.when(idf > 0, idf).otherwise(1e-6)


def weighed(index, terms: list[tuple[str, str]], table: str = "postings", keys: tuple[str, ...] = ("doc_id", "line_start"), stats: DataFrame | None = None) -> DataFrame:
    """keys, score (BM25, not rounded), mask (bit k: holds term k) and held of what holds a term.

    Each term's postings are read once: they meet in one exchange, on which the document frequencies and the scores rest.
    ``stats``: one row with N and avgdl."""
    tf = lambda k: F.max(F.when(F.col("term") == k, F.col("tf")))
    size = [F.max("n_tok").alias("n_tok")] if table == "fields" else []
    met = posted(index, terms, table, keys).groupBy(*keys).agg(*size, F.array(*[tf(k) for k in range(len(terms))]).alias("tf"))
    if stats is None:
        stats = index.totals.select(F.col("passages").alias("N"), (F.col("tokens") / F.col("passages")).alias("avgdl"))
    df = met.agg(F.array(*[F.count(F.get("tf", F.lit(k))) for k in range(len(terms))]).alias("df")).crossJoin(stats)  # one row
    met = met if size else met.join(index.sizes, [*keys])

    def weight(k: int) -> Column:
        n = F.get("tf", F.lit(k))
        return F.coalesce(_idf(F.col("N"), F.get("df", F.lit(k))) * n * (K1 + 1) / (n + K1 * (1 - B + B * F.col("n_tok") / F.col("avgdl"))), F.lit(0.0))

    bits = [F.when(F.get("tf", F.lit(k)).isNotNull(), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k in range(len(terms))]
    mask = bits[0]
    for bit in bits[1:]:
        mask = mask.bitwiseOR(bit)
    return met.crossJoin(F.broadcast(df)).select(*keys, sum((weight(k) for k in range(1, len(terms))), weight(0)).alias("score"), mask.alias("mask"), F.bit_count(mask).cast("long").alias("held"))


def bm25(rows: DataFrame, terms: list[tuple[str, str]]) -> DataFrame:
    """Score and number of terms held of each passage: doc_id, line_start, score, held.

    ``rows`` are passages, or a stored index, whose postings are looked up then."""
    if not isinstance(rows, DataFrame):
        return weighed(rows, terms).select("doc_id", "line_start", round6(F.col("score")).alias("score"), "held")
    hits, stats = term_counts(rows, terms), rows.agg(F.count(F.lit(1)).alias("N"), F.avg("n_tok").alias("avgdl"))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # a row for each term of the query
    known = df.crossJoin(stats).select("term", "avgdl", _idf(F.col("N"), F.col("df")).alias("idf"))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n_tok") / F.col("avgdl")))
    scored = hits.join(F.broadcast(known), "term").groupBy("doc_id", "line_start").agg(F.sum(F.col("idf") * tf).alias("s"), F.count(F.lit(1)).alias("held"))
    return scored.select("doc_id", "line_start", round6(F.col("s")).alias("score"), "held")


def search(rows: DataFrame, terms: list[tuple[str, str]], without: list[str] = (), limit: int = 20) -> DataFrame:
    """Documents by their best passage: cover (share of terms held) first, then score, then line."""
    hits = bm25(rows, terms)
    if without:
        if isinstance(rows, DataFrame):
            out = rows.filter(F.arrays_overlap("toks", F.array(*map(F.lit, without)))).select("doc_id", "line_start")
        else:
            out = rows.postings.filter(F.col("word").isin(*without)).select("doc_id", "line_start")
        hits = hits.join(out, ["doc_id", "line_start"], "left_anti")
    hits = hits.withColumn("cover", F.col("held") / len(terms))
    best = hits.groupBy("doc_id").agg(F.max(F.struct("cover", "score", (-F.col("line_start")).alias("up"))).alias("b"), F.count(F.lit(1)).alias("passages"))
    out = best.select("doc_id", (-F.col("b.up")).alias("line_start"), F.col("b.cover").alias("cover"), round6(F.col("b.score") * F.col("b.cover")).alias("score"), "passages")
    return out.orderBy(F.desc("score"), "doc_id").limit(limit)


def search_hits(index, terms: list[tuple[str, str]], titles: DataFrame | None = None, limit: int = 20, hits_per_doc: int = 3, order: str = "score", dates: DataFrame | None = None) -> DataFrame:
    """Passages of the best documents: rank of the document (from 1), doc_id, score, line_start, cover, passage.

    A document's score is its best passage's score times cover, plus its title's own BM25 score.  Passages come by cover, then
    score, then line, ``hits_per_doc`` of them.  ``order``: score, newest or oldest (by ``dates``: doc_id, date; undated last both ways).
    titles: doc_id, toks, n_tok."""
    hits = bm25(index, terms).withColumn("cover", F.col("held") / len(terms))
    key = F.struct((-F.col("cover")).alias("c"), (-F.col("score")).alias("s"), "line_start")
    best = hits.groupBy("doc_id").agg(F.min(key).alias("b")).select("doc_id", round6(F.col("b.c") * F.col("b.s")).alias("own"))
    if titles is not None:
        named = bm25(titles.withColumn("line_start", F.lit(0).cast("long")), terms).select("doc_id", F.col("score").alias("title"))
        best = best.join(named, "doc_id", "left").withColumn("own", round6(F.col("own") + F.coalesce("title", F.lit(0.0)))).drop("title")
    by = [F.desc("own"), F.asc("doc_id")]
    if order != "score":
        best = best.join(dates, "doc_id", "left")
        by = [F.desc_nulls_last("date") if order == "newest" else F.asc_nulls_last("date"), F.asc("doc_id")]
    top = best.orderBy(*by).limit(limit)
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(*by))).select("rank", "doc_id", F.col("own").alias("doc_score"))  # ``limit`` rows
    inside = Window.partitionBy("doc_id").orderBy(F.desc("cover"), F.desc("score"), "line_start")
    shown = hits.join(F.broadcast(top), "doc_id").withColumn("passage", F.row_number().over(inside)).filter(F.col("passage") <= hits_per_doc)
    return shown.select("rank", "doc_id", "doc_score", "line_start", "cover", "passage").orderBy("rank", "passage")


def semantic_documents(vectors: DataFrame, seed: int, doc: str, limit: int = 20, keep=None) -> DataFrame:
    """Documents by their best passage's cosine with one vector: doc, vec_id (ties: the smallest), score.  ``keep`` filters passages first."""
    rows = vectors if keep is None else vectors.filter(keep | (F.col("vec_id") == seed))
    q = vectors.filter(F.col("vec_id") == seed).select(F.col("embedding").alias("q"))  # one row
    scored = rows.crossJoin(F.broadcast(q)).select(F.col(doc).alias("doc"), "vec_id", round6(_cosine("embedding", "q")).alias("score"))
    best = scored.groupBy("doc").agg(F.min(F.struct((-F.col("score")).alias("less"), "vec_id")).alias("b"))
    return best.select("doc", F.col("b.vec_id").alias("vec_id"), (-F.col("b.less")).alias("score")).orderBy(F.desc("score"), "doc").limit(limit)


def hybrid(text: DataFrame, meaning: DataFrame, key: str, corpus: str | None = None, pool: int = 100, limit: int = 20) -> DataFrame:
    """Full-text and semantic rankings (key, score) by reciprocal ranks.

    Without ``corpus`` ranks are positions.  With it scores of full text compare only inside a corpus, so each votes by its
    competition rank there, and meaning by its rank over all; equal scores share a rank."""
    if corpus is None:
        return fuse(text, meaning, key, pool).orderBy(F.desc("score"), key).limit(limit)
    top = lambda df, w: df.withColumn("r", F.rank().over(w)).filter(F.col("r") <= pool)
    votes = top(text, Window.partitionBy(corpus).orderBy(F.desc("score"))).select(corpus, key, (1.0 / (60 + F.col("r"))).alias("v1"))
    near = meaning.orderBy(F.desc("score"), key).limit(pool)
    near = near.withColumn("r", F.rank().over(Window.orderBy(F.desc("score")))).select(corpus, key, (1.0 / (60 + F.col("r"))).alias("v2"))  # ``pool`` rows
    both = votes.join(near, [corpus, key], "full").select(corpus, key, round6(F.coalesce("v1", F.lit(0.0)) + F.coalesce("v2", F.lit(0.0))).alias("score"))
    return both.orderBy(F.desc("score"), corpus, key).limit(limit)


def mode_of(wanted: str, words: bool, freshness: str) -> str:
    """The search mode of one corpus: what is wanted, where its vectors and the query's words allow it; auto takes the most that they do."""
    if wanted not in ("auto", "fts", "semantic", "hybrid"):
        raise ValueError(f"no mode {wanted}")
    current = freshness == "current"
    if wanted in ("semantic", "hybrid") and not current:
        raise ValueError(f"vectors are {freshness}")
    if wanted == "auto":
        return "hybrid" if current and words else "fts"
    return wanted


def vector_freshness(meta: dict | None, model: str, generation: int, scheme: str) -> str:
    """missing, stale or current: stored vectors count only for the same model, scheme and content."""
    if meta is None:
        return "missing"
    return "current" if (meta.get("model"), meta.get("generation"), meta.get("scheme")) == (model, generation, scheme) else "stale"


def query_text(query: Query) -> str:
    """The words of a query as one text for an embedder; stopwords stay."""
    return " ".join(t.text for group in query.any_of for t in group)


def hash_embedding(toks: Column, dim: int = 64) -> Column:
    """A unit vector of ``dim`` buckets: each token adds 1, or -1 if its hash's top bit is set, to the bucket of its FNV-1a hash.

    Arrow batches, as Spark has no wrapping product.  Tokens that cancel out, and no tokens, give zeros; null stays null."""

    def of(batch: pd.Series) -> pd.Series:
        rows = [() if t is None else t for t in batch]
        number, words = pd.factorize(np.array([w for t in rows for w in t], dtype=object))
        hashes = fnv1a(list(words))
        cell = np.repeat(np.arange(len(rows), dtype=np.int64) * dim, [len(t) for t in rows]) + (hashes % np.uint64(dim)).astype(np.int64)[number]
        sign = np.where(hashes >> np.uint64(63), -1.0, 1.0)[number]
        sums = np.bincount(cell, sign, len(rows) * dim).reshape(len(rows), dim)
        length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        made = sums / np.where(length > 0, length, 1.0)
        return pd.Series([None if t is None else v for t, v in zip(batch, made, strict=True)], dtype=object)

    return F.pandas_udf(of, "array<double>")(toks)


def vectors_to_make(passages: DataFrame, stored: DataFrame, least: int = 5) -> DataFrame:
    """What a vector build does: id, hash, action (keep, move, embed), from; passages under ``least`` tokens have no vector; stored ids that go are "remove".

    passages: id, hash, n_tok; stored: id, hash.  The same id and text keep their vector, and the same text elsewhere lends its own."""
    wanted = passages.filter(F.col("n_tok") >= least).select("id", "hash")
    same = stored.select("id", "hash", F.lit(True).alias("same"))
    texts = stored.groupBy("hash").agg(F.min("id").alias("from"))
    made = wanted.join(same, ["id", "hash"], "left").join(texts, "hash", "left")
    action = F.when(F.col("same"), "keep").when(F.col("from").isNotNull(), "move").otherwise("embed")
    made = made.select("id", "hash", action.alias("action"), F.when(~F.coalesce("same", F.lit(False)), F.col("from")).alias("from"))
    gone = stored.join(wanted, "id", "left_anti").select("id", "hash", F.lit("remove").alias("action"), F.lit(None).cast(stored.schema["id"].dataType).alias("from"))
    return made.unionByName(gone)


def locate(sentences: Column, terms: list[str]) -> Column:
    """Number (from 0) of the sentence, an array of token arrays, that holds most different terms; the earliest of those."""
    wanted = F.array(*map(F.lit, terms))
    held = F.transform(sentences, lambda s: F.size(F.array_intersect(wanted, s)))
    return F.array_position(held, F.array_max(held)) - 1


def query_terms(query: Query) -> tuple[list[list[tuple[str, str]]], list[tuple[str, str]]]:
    """The AND groups and the excluded terms of a parsed query, as terms over index tokens.

    Words and prefixes match the beginnings of tokens, each token of a word by itself; stopwords go unless all are."""

    def of(term) -> list[tuple[str, str]]:
        tokens = regex.findall(TOKEN, term.text.lower())
        if term.form == "phrase":
            return [("phrase", " ".join(tokens))] if tokens else []
        return [("prefix", t) for t in tokens]

    stop = lambda t: t[0] == "prefix" and t[1] in STOPWORDS
    groups = [list(dict.fromkeys(t for term in g for t in of(term))) for g in query.any_of]
    if not all(stop(t) for g in groups for t in g):
        groups = [[t for t in g if not stop(t)] for g in groups]
    return [g for g in groups if g], [t for term in query.without for t in of(term)]


def search_text(rows: DataFrame, text: str, columns: dict[str, str], titles: DataFrame | None = None, limit: int = 20) -> DataFrame:
    """Documents by their best passage for a query in the search language.

    A passage counts if it holds a term of an AND group and it or its document's ``titles`` (doc_id, toks) hold the
    others; its cover is the best share that it holds itself.  ``columns`` names the column behind each field.
    Statistics are those of all ``rows``, whatever the fields select: one row, the only thing broadcast."""
    query = parse(text)
    groups, without = query_terms(query)
    if not groups:
        raise ValueError("the query has no positive term")
    if unknown := set(query.fields) - set(columns) - {"in"}:
        raise ValueError(f"this table has no field {', '.join(sorted(unknown))}")
    terms = [t for g in groups for t in g]  # a term of several groups counts in each
    counts, barred = F.array(*[_held(*t).cast("long") for t in terms]), F.array(F.lit(0), *[_held(*t) for t in without])
    # made by a generator, below which no filter moves, the counts are taken once a passage
    once = F.inline(F.array(F.struct(counts.alias("tf"), F.array_max(barred).alias("barred"))))
    counted = rows.select(*rows.columns, once)
    every = lambda of: F.array(*[of(k) for k in range(len(terms))])
    stats = counted.agg(F.count(F.lit(1)).alias("N"), F.avg("n_tok").alias("avgdl"), every(lambda k: F.count_if(F.col("tf")[k] > 0)).alias("df"))
    kept = counted.filter(F.exists("tf", lambda n: n > 0))
    for name, value in query.fields.items():
        if name != "in":
            kept = kept.filter(fold(F.col(columns[name])) == fold(F.lit(value)))
    for source, flags in query.patterns:
        kept = kept.filter(F.col("line").rlike("".join(f"(?{f})" for f in "ims" if f in flags) + source))
    kept = kept.filter("barred = 0")
    held = lambda k: F.col("tf")[k] > 0
    near = held
    if titles is not None:
        named = titles.groupBy("doc_id").agg(every(lambda k: F.max(_held(*terms[k]) > 0)).alias("named"))
        kept = kept.join(named, "doc_id", "left")
        near = lambda k: held(k) | F.coalesce(F.col("named")[k], F.lit(False))
    shares, at = [], 0
    for g in groups:
        own = range(at, at := at + len(g))
        n = sum(held(k).cast("int") for k in own)
        shares.append(F.when((n > 0) & F.forall(F.array(*map(near, own)), lambda x: x), n / len(g)))
    kept = kept.withColumn("cover", F.array_max(F.array(*shares))).filter("cover IS NOT NULL")

    def weight(k: int) -> Column:
        tf, df = F.col("tf")[k], F.col("df")[k]
        idf = F.ln((F.col("N") - df + 0.5) / (df + 0.5))
        return F.when(tf > 0, F.when(idf > 0, idf).otherwise(1e-6) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("n_tok") / F.col("avgdl")))).otherwise(0.0)

    scored = kept.crossJoin(F.broadcast(stats)).select("doc_id", "line_start", "cover", round6(sum(weight(k) for k in range(len(terms)))).alias("score"))
    best = scored.groupBy("doc_id").agg(F.max(F.struct("cover", "score", (-F.col("line_start")).alias("up"))).alias("b"), F.count(F.lit(1)).alias("passages"))
    out = best.select("doc_id", (-F.col("b.up")).alias("line_start"), F.col("b.cover").alias("cover"), round6(F.col("b.score") * F.col("b.cover")).alias("score"), "passages")
    return out.orderBy(F.desc("score"), "doc_id").limit(limit)


def _masks(groups: list[list]) -> list[tuple[int, int]]:
    """(bits, size) of each AND group, whose terms are numbered one after the other."""
    out, at = [], 0
    for g in groups:
        out.append((((1 << len(g)) - 1) << at, len(g)))
        at += len(g)
    return out


def compiled(text: str, corpora: list[str] | None = None):
    """A query text as (query, AND groups, excluded terms, document filter, corpora); unknown document fields are refused."""
    from verbatlas.operators.filters import from_query

    query = parse(text)
    groups, without = query_terms(query)
    if sum(map(len, groups)) > 62:
        raise ValueError("more than 62 terms")
    named = {**query.fields, **query.repeated}
    inside = named.pop("in", None)
    return query, groups, without, from_query(named), [inside] if inside else corpora


def in_scope(index, scope, corpora: list[str] | None = None) -> DataFrame | None:
    """Documents (doc_id) that a filter takes, in some corpora; null if that is all of them."""
    from verbatlas.operators.filters import DocFilter, predicate

    if not corpora and scope == DocFilter():
        return None
    docs = index.docs.filter(predicate(scope))
    if corpora:
        docs = docs.filter(fold(F.col("corpus")).isin(*[c.strip().lower() for c in corpora]))
    return docs.select("doc_id")


def matching(index, text: str, corpora: list[str] | None = None, scope=None) -> DataFrame:
    """Every passage that a query in the search language takes: doc_id, line_start, cover, score, without any order.

    A passage counts if it holds a term of an AND group, and it or its document's fields (title, topics, summary) hold the
    others; its cover is the best share that it holds itself.  A query of patterns alone takes the passages that they match.
    All comes from postings; texts are read for patterns only.  Statistics are those of all documents.  ``scope``: a document
    filter in place of the query's own."""
    query, groups, without, own, corpora = compiled(text, corpora)
    scope = own if scope is None else scope
    if not groups and not query.patterns:
        raise ValueError("the query has no positive term")
    keys = ["doc_id", "line_start"]
    kept = in_scope(index, scope, corpora)
    if groups:
        terms = [t for g in groups for t in g]
        hits = weighed(index, terms)
        if kept is not None:
            hits = hits.join(kept, "doc_id", "left_semi")
        if len(terms) > len(groups):  # some group has several terms, of which fields may hold some
            fields = posted(index, terms, "fields", ("doc_id", "field", "nth"))
            named = fields.groupBy("doc_id").agg(F.bit_or(F.expr("shiftleft(CAST(1 AS BIGINT), term)")).alias("named"))
            hits = hits.join(named, "doc_id", "left").withColumn("named", F.coalesce("named", F.lit(0).cast("long")))
        else:
            hits = hits.withColumn("named", F.lit(0).cast("long"))
        shares = []
        for bits, size in _masks(groups):
            m = F.lit(bits).cast("long")
            own = F.bit_count(F.col("mask").bitwiseAND(m))
            shares.append(F.when((own > 0) & (F.col("mask").bitwiseOR(F.col("named")).bitwiseAND(m) == m), own / size))
        cover = shares[0] if len(shares) == 1 else F.greatest(*shares)
        hits = hits.select(*keys, cover.alias("cover"), round6(F.col("score")).alias("score")).filter("cover IS NOT NULL")
    if query.patterns:
        rows = index.lines if kept is None else index.lines.join(kept, "doc_id", "left_semi")
        for source, flags in query.patterns:
            rows = rows.filter(F.col("line").rlike("".join(f"(?{f})" for f in "ims" if f in flags) + source))
        hits = hits.join(rows.select(*keys), keys, "left_semi") if groups else rows.select(*keys, F.lit(1.0).alias("cover"), F.lit(0.0).alias("score"))
    return hits.join(posted(index, without).select(*keys), keys, "left_anti") if without else hits


def title_scores(index, text: str) -> DataFrame | None:
    """(doc_id, title): BM25 of the titles that hold a positive term of a query; null if it has none."""
    terms = [t for g in compiled(text)[1] for t in g]
    if not terms:
        return None
    n, size = index.state.total("titles"), index.state.total("title_tokens")
    stats = index.spark.range(1).select(F.lit(n).alias("N"), F.lit(size / max(1, n)).alias("avgdl"))
    titles = _Table(index.fields.filter("field = 'title'"))
    return weighed(titles, terms, "fields", ("doc_id",), stats).select("doc_id", round6(F.col("score")).alias("title"))


@dataclass
class _Table:
    fields: DataFrame


def ranked(index, text: str, limit: int = 20, sort: str = "score", corpora: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The best documents (rank, doc_id, doc_score) and all passages that match.

    A document's score is its best passage's score times cover, and its title's own.  ``sort``: score, newest or oldest
    (undated last); ties go by path, then id."""
    hits = matching(index, text, corpora)
    key = F.struct((-F.col("cover")).alias("c"), (-F.col("score")).alias("s"), "line_start")
    best = hits.groupBy("doc_id").agg(F.min(key).alias("b"), F.count(F.lit(1)).alias("passages")).select("doc_id", "passages", (F.col("b.c") * F.col("b.s")).alias("own"))
    if (titles := title_scores(index, text)) is not None:
        best = best.join(titles, "doc_id", "left").withColumn("own", F.col("own") + F.coalesce("title", F.lit(0.0))).drop("title")
    best = best.withColumn("own", round6(F.col("own"))).join(index.docs.select("doc_id", "path", "date"), "doc_id")
    last = [F.asc_nulls_last("path"), F.asc("doc_id")]
    by = [F.desc("own") if sort == "score" else F.desc_nulls_last(date_floor(F.col("date"))) if sort == "newest" else F.asc_nulls_last(date_floor(F.col("date"))), *last]
    top = best.orderBy(*by).limit(limit)
    return top.select(F.row_number().over(Window.orderBy(*by)).alias("rank"), "doc_id", F.col("own").alias("doc_score"), "passages"), hits  # ``limit`` rows


def search_index(index, text: str, limit: int = 20, hits_per_doc: int = 3, sort: str = "score", corpora: list[str] | None = None) -> DataFrame:
    """``ranked`` documents with their best passages: rank, doc_id, corpus, path, title, date, doc_score, passages, passage (from 1), line_start, cover, score."""
    top, hits = ranked(index, text, limit, sort, corpora)
    inside = Window.partitionBy("doc_id").orderBy(F.desc("cover"), F.desc("score"), "line_start")
    shown = hits.join(F.broadcast(top), "doc_id").withColumn("passage", F.row_number().over(inside)).filter(F.col("passage") <= hits_per_doc)
    meta = index.docs.select("doc_id", "corpus", "path", "title", "date")
    return shown.join(meta, "doc_id").select("rank", "doc_id", "corpus", "path", "title", "date", "doc_score", "passages", "passage", "line_start", "cover", "score").orderBy("rank", "passage")


def facets(index, text: str | None, values: dict[str, Column], top: int = 20, corpora: list[str] | None = None) -> DataFrame:
    """Facet values of the documents that a query finds, or of all: facet, value, count; the ``top`` of each facet.

    The facet "months" disregards the query's months, and "ai" its ai, so that a choice does not hide the others.  A document is
    marked once with the variants of the query that it passes, and all facets come from one aggregate over one reading.
    Values that are the same under fold are one, in the spelling of most documents.  ``values``: array columns of docs."""
    from verbatlas.operators.filters import DocFilter, predicate

    scope = compiled(text)[3] if text else DocFilter()
    docs = index.docs
    if text and (query := compiled(text, corpora)):
        if query[1] or query[0].patterns:
            docs = docs.join(matching(index, text, corpora, replace(scope, months=[], ai=None)).select("doc_id").distinct(), "doc_id", "left_semi")
        corpora = query[4]
    if corpora:
        docs = docs.filter(fold(F.col("corpus")).isin(*[c.strip().lower() for c in corpora]))
    passes = {"months": predicate(replace(scope, months=[])), "ai": predicate(replace(scope, ai=None))}
    whole = predicate(scope)
    each = [_named(name, v, passes.get(name, whole)) for name, v in values.items()]
    rows = docs.select("doc_id", F.inline(F.concat(*each))).withColumn("v", fold(F.col("spelling"))).filter("v <> ''")
    one = rows.groupBy("facet", "v", "doc_id").agg(F.min(F.trim("spelling")).alias("spelling"))
    forms = one.groupBy("facet", "v", "spelling").agg(F.count(F.lit(1)).alias("n"))
    best = forms.groupBy("facet", "v").agg(F.sum("n").alias("count"), F.min(F.struct((-F.col("n")).alias("less"), "spelling")).alias("b"))
    best = best.select("facet", F.col("b.spelling").alias("value"), "count")
    order = Window.partitionBy("facet").orderBy(F.desc("count"), "value")
    return best.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= top).drop("r")


def _named(name: str, values: Column, passes: Column) -> Column:
    """Values as (facet, spelling), none where the document does not pass."""
    kind = "array<struct<facet:string,spelling:string>>"
    made = F.transform(values, lambda x: F.struct(F.lit(name).alias("facet"), x.cast("string").alias("spelling"))).cast(kind)
    return F.when(passes & values.isNotNull(), made).otherwise(F.array().cast(kind))


def merge_ranks(results: DataFrame, by: str) -> DataFrame:
    """Scores of several corpora made comparable: each by its corpus's best, a row a corpus."""
    best = results.groupBy(by).agg(F.max("score").alias("_best"))
    return results.join(F.broadcast(best), by).withColumn("rank", round6(F.col("score") / F.col("_best"))).drop("_best")


def similar(index, seeds: list[tuple[int, int]], limit: int = 20, explain: int = 0) -> DataFrame:
    """Passages like one to ten seed passages (doc_id, line_start): cosine of tf-idf vectors with the seeds' mean, two shared terms at least.

    The seeds' words are looked up in the postings; lengths of vectors are stored.  With ``explain`` the terms that
    add most, so many, and the closest seed are given too."""
    if not 1 <= len(seeds) <= 10:
        raise ValueError("one to ten seeds")
    spark = index.postings.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(k, d, n) for k, (d, n) in enumerate(seeds)], "seed int, doc_id long, line_start long"))
    n = index.totals.select(F.col("passages").alias("N"))
    weigh = lambda postings, words: similarity_weights(postings, words, n)
    ids = sorted({d for d, _ in seeds})
    own = index.passages.filter(F.col("doc_id").isin(*ids)).join(wanted, ["doc_id", "line_start"]).join(index.norms.filter(F.col("doc_id").isin(*ids)), ["doc_id", "line_start"])
    own = own.select("seed", "doc_id", "line_start", "norm", F.explode("toks").alias("word")).groupBy("seed", "doc_id", "line_start", "norm", "word").agg(F.count(F.lit(1)).alias("tf"))
    # ten passages' words at most, with their idf: collected, so that the postings are pruned by them
    with swept(spark):
        vector = weigh(own, index.words).select("seed", "word", "norm", "w").collect()
    centre: dict[str, float] = {}
    for r in vector:
        centre[r.word] = centre.get(r.word, 0.0) + r.w / r.norm / len(seeds)
    length = math.sqrt(sum(v * v for v in centre.values()))
    terms = F.broadcast(spark.createDataFrame(sorted(centre.items()) or [("", 0.0)], "word string, cw double"))
    hits = weigh(index.postings.filter(F.col("word").isin(*centre)), index.words.filter(F.col("word").isin(*centre))).join(terms, "word")
    hits = hits.join(wanted, ["doc_id", "line_start"], "left_anti")
    dots = hits.groupBy("doc_id", "line_start").agg(F.sum(F.col("w") * F.col("cw")).alias("dot"), F.count(F.lit(1)).alias("shared")).filter("shared >= 2")
    scored = dots.join(index.norms, ["doc_id", "line_start"])
    out = scored.select("doc_id", "line_start", "shared", round6(F.col("dot") / (F.col("norm") * length)).alias("score")).orderBy(F.desc("score"), "doc_id", "line_start").limit(limit)
    if not explain:
        return out
    top = hits.join(F.broadcast(out.select("doc_id", "line_start")), ["doc_id", "line_start"])
    best = top.groupBy("doc_id", "line_start").agg(F.array_sort(F.collect_list(F.struct((-F.col("w") * F.col("cw")).alias("less"), "word"))).alias("t"))
    each = F.broadcast(spark.createDataFrame([(r.seed, r.word, r.w / r.norm) for r in vector], "seed int, word string, sw double"))
    close = top.select("doc_id", "line_start", "word", "w").join(each, "word").groupBy("doc_id", "line_start", "seed").agg(F.sum(F.col("w") * F.col("sw")).alias("d"))
    close = close.groupBy("doc_id", "line_start").agg(F.min_by("seed", F.struct((-F.round(F.col("d"), 9)).alias("less"), "seed")).alias("closest"))
    named = best.select("doc_id", "line_start", F.array_join(F.transform(F.slice("t", 1, explain), lambda x: x["word"]), " ").alias("terms"))
    return out.join(named, ["doc_id", "line_start"]).join(close, ["doc_id", "line_start"]).orderBy(F.desc("score"), "doc_id", "line_start")


def _cosine(a: str, b: str) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def nearest(vectors: DataFrame, vec_id: int, limit: int = 20) -> DataFrame:
    """Exact cosine ranking of all vectors against one; ties by id."""
    seed = vectors.filter(F.col("vec_id") == vec_id).select(F.col("embedding").alias("q"))  # one row
    return vectors.crossJoin(F.broadcast(seed)).select("vec_id", "label", round6(_cosine("embedding", "q")).alias("score")).orderBy(F.desc("score"), "vec_id").limit(limit)


def fuse(first: DataFrame, second: DataFrame, key: str, pool: int = 100, k: int = 60, shared: bool = False) -> DataFrame:
    """Reciprocal rank fusion of two (key, score) lists; ``shared`` gives equal scores equal ranks."""
    order = [F.desc("score")] if shared else [F.desc("score"), F.col(key)]
    rank = F.rank() if shared else F.row_number()

    def vote(df: DataFrame, name: str) -> DataFrame:
        top = df.orderBy(F.desc("score"), key).limit(pool)
        return top.select(key, (1.0 / (k + rank.over(Window.orderBy(*order)))).alias(name))  # at most ``pool`` rows

    both = vote(first, "v1").join(vote(second, "v2"), key, "full")
    return both.select(key, round6(F.coalesce("v1", F.lit(0.0)) + F.coalesce("v2", F.lit(0.0))).alias("score"))


#: Characters of the piece of a quote that texts are looked through for; shorter quotes go into an automaton as they are.
GRAM = 12

#: Pieces (8 bytes each) and short quotes that are sent to the tasks of one pass over the texts; more quotes take more passes.
SENT_PIECES, SENT_SHORT = 1_000_000, 100_000


def gram_hashes(text: str) -> np.ndarray:
    """A hash of the ``GRAM`` characters at each place of a text."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = max(0, len(c) - GRAM + 1)
    h = np.zeros(n, np.uint64)
    for k in range(GRAM if n else 0):
        h = h * np.uint64(0x9E3779B97F4A7C15) + c[k : k + n]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def verify_quotes(docs: DataFrame, quotes: DataFrame, first: bool = False, blank: str = r"\s") -> DataFrame:
    """(item_id, doc_id, at, line, original) of every place, or only the first in each text, where a text holds a quote.

    Quotation marks and apostrophes of all forms are the same on both sides; else it is character for character.  ``original``
    is what the text has there, ``line`` its line.  ``quotes``: item_id and text; what ``blank`` matches around them is no part of them, and
    null and empty ones are nowhere.  Places are counted in characters from 1 and do not overlap.

    In one pass over the texts, long quotes are looked for by the piece of theirs that has the least hash, wherever words
    begin, and short ones by one automaton of all; the texts that hold such a piece are compared in full."""
    doc, item = docs.schema["doc_id"].dataType.simpleString(), quotes.schema["item_id"].dataType.simpleString()
    table = str.maketrans(QUOTES, PLAIN_QUOTES)

    def key_of(quote: str) -> int:
        h = gram_hashes(quote)
        return int(h.min()) if len(h) else int.from_bytes(hashlib.blake2b(quote.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py() for x in batch.column(1)]
            short = [x if len(x) < GRAM else None for x in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([key_of(x) for x in texts], pa.int64()), pa.array(short, pa.string())], names=["item_id", "quote", "k", "short"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at, line, original = [], [], [], []
            for i, (text, quote) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                text, quote, here, counted, lines = text.as_py(), quote.as_py(), 0, 0, 1
                plain = text.translate(table)  # character for character, so places are the original's
                while (here := plain.find(quote, here)) >= 0:
                    lines += text.count("\n", counted, here)
                    counted = here
                    row.append(i)
                    at.append(here + 1)
                    line.append(lines)
                    original.append(text[here : here + len(quote)])
                    if first:
                        break
                    here += len(quote)
            ids = [batch.column(c).take(pa.array(row, pa.int64())) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(at, pa.int64()), pa.array(line, pa.int64()), pa.array(original, pa.string())], names=["item_id", "doc_id", "at", "line", "original"])

    def holding(keys: np.ndarray, short: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for quote in short:
                automaton.add_word(quote, key_of(quote))
            if short:
                automaton.make_automaton()
            for batch in batches:
                row, held = [], []
                for i, text in enumerate(batch.column(1)):
                    plain = text.as_py().translate(table)
                    found: set[int] = set()
                    if len(keys):
                        h = gram_hashes(plain)
                        found.update(np.unique(h[keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h]).tolist())
                    if short:
                        found.update(k for _, k in automaton.iter(plain))
                    if found:
                        row.append(i)
                        held.append(sorted(found))
                out = [c.take(pa.array(row, pa.int64())) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*out, pa.array(held, pa.list_(pa.int64()))], names=["doc_id", "text", "ks"])

        return run

    texts = docs.select("doc_id", "text").filter("text IS NOT NULL")
    plain = F.translate(F.regexp_replace("text", rf"\A{blank}+|{blank}+\z", ""), QUOTES, PLAIN_QUOTES)
    q = quotes.select("item_id", plain.alias("quote")).filter("quote <> ''").mapInArrow(keyed, f"item_id {item}, quote string, k long, short string")
    pieces = q.select("k", "short").distinct()
    many = pieces.agg(F.count(F.lit(1)), F.count("short")).first()
    passes = max(-(-many[0] // SENT_PIECES), -(-many[1] // SENT_SHORT))
    both = None
    for i in range(passes):
        own = list(pieces.filter(F.pmod("k", F.lit(passes)) == i).toLocalIterator())
        keys, short = np.array(sorted(x.k for x in own if x.short is None), np.int64), sorted(x.short for x in own if x.short is not None)
        if own:
            held = texts.mapInArrow(holding(keys, short), f"doc_id {doc}, text string, ks array<long>").select("doc_id", "text", F.explode("ks").alias("k"))
            met = held.join(q, "k").filter(F.contains(F.translate("text", QUOTES, PLAIN_QUOTES), F.col("quote"))).select("item_id", "doc_id", "text", "quote")
            both = met if both is None else both.unionByName(met)
    kinds = f"item_id {item}, doc_id {doc}, at long, line long, original string"
    return docs.sparkSession.createDataFrame([], kinds) if both is None else both.mapInArrow(places, kinds)
