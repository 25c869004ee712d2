"""One object over an indexed corpus: every view with its usual defaults."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verbatlas.functions.normalise import best_sentence, citation, cleaning
from verbatlas.functions.text import tokens
from verbatlas.operators import concord, filters, search
from verbatlas.plans.grammar import parse
from verbatlas.sources import vectors
from verbatlas.sources.store import Index, open_index


class Engine:
    """``Engine(spark, folder)`` opens the stored index of ``documents`` there, and indexes first what has changed.

    ``mapping`` gives the documents' metadata by SQL expressions (see ``open_index``); ``embed`` makes unit vectors from arrays of
    tokens and is named by ``model``.  ``exact``
    indexes blocks of normalised text by Unicode words (see ``open_index``); concordances then show the original."""

    def __init__(self, spark: SparkSession, folder: str, mapping: dict[str, str] | None = None, model: str = "hash64", embed: Callable[[Column], Column] = search.hash_embedding, exact: bool = False):
        self.spark, self.folder, self.mapping, self.model, self.embed, self.exact = spark, folder, mapping, model, embed, exact
        self.index: Index = open_index(spark, folder, mapping=mapping, exact=exact)

    def documents(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/documents.parquet")

    def scoped(self, scope: filters.DocFilter | None = None) -> Index:
        """The index, or what a filter takes of it."""
        return self.index.within(search.in_scope(self.index, scope) if scope else None)

    def passages(self, scope: filters.DocFilter | None = None) -> DataFrame:
        """All passages, or those of the documents that a filter takes."""
        return self.scoped(scope).passages

    def search(self, query: str, limit: int = 20, sort: str = "score", mode: str = "auto", corpora: list[str] | None = None, hits_per_doc: int = 3) -> DataFrame:
        """Documents for a query in the search language, its fields included; an empty query, an unknown sort or mode, a sort that the mode
        has not, and a mode for which vectors are missing or stale are refused.

        ``auto`` is hybrid where vectors are current and the query has words and the order is by score, else fts.  fts gives
        ``search_index``; semantic and hybrid one row a document, with its best passage by meaning (null if only words found it)."""
        if not query.strip():
            raise ValueError("an empty query")
        if sort not in ("score", "newest", "oldest") or (sort != "score" and mode not in ("auto", "fts")):
            raise ValueError(f"no order {sort} in mode {mode}")
        parsed, groups, _, scope, corpora = search.compiled(query, corpora)
        mode = "fts" if mode == "auto" and sort != "score" else search.mode_of(mode, bool(groups), vectors.freshness(self.index, self.model))
        if mode == "fts":
            return search.search_index(self.index, query, limit, hits_per_doc, sort, corpora)
        kept = self.index.within(search.in_scope(self.index, scope, corpora))
        pool = limit if mode == "semantic" else max(100, limit)
        near = vectors.ranked(vectors.read(kept, self.model), self._embedded(search.query_text(parsed)), pool)
        found = near.select("doc_id", F.col("score").alias("doc_score"))
        if mode == "hybrid":
            words = search.ranked(self.index, query, pool, corpora=corpora)[0].select("doc_id", F.col("doc_score").alias("score"))
            found = search.hybrid(words, near.select("doc_id", "score"), "doc_id", pool=pool, limit=limit).withColumnRenamed("score", "doc_score")
        found = found.join(near.select("doc_id", "line_start"), "doc_id", "left").join(self.index.docs.select("doc_id", "corpus", "path", "title", "date"), "doc_id")
        by = [F.desc("doc_score"), "doc_id"]
        return found.select(F.row_number().over(Window.orderBy(*by)).alias("rank"), "doc_id", "corpus", "path", "title", "date", "doc_score", "line_start").orderBy("rank")  # ``limit`` rows

    def _embedded(self, text: str) -> list[float]:
        row = self.spark.range(1).select(self.embed(tokens(F.lit(text))).alias("v")).first()
        return list(row.v)

    def build_vectors(self) -> int:
        """Embed what has no vectors yet; how many segments that were."""
        return vectors.build(self.index, self.model, self.embed)

    def kwic(self, phrase: list[str], near: str | None = None, width: int = 8, sort: str = "R1", limit: int = 200, scope: filters.DocFilter | None = None) -> DataFrame:
        """Concordance lines with left context, node and right context; of an exact index cut out of the original, with the node's start and end in its block."""
        if self.exact:
            rows = concord.kwic(self.scoped(scope), phrase, near, width, limit, sort, extra=["line", "starts", "ends", "source"])
            shown = concord.kwic_original(rows.withColumn("n", F.lit(len(phrase))), width)
            return shown.select("doc_id", "line_start", "i", "left", "node", "right", "source", "start", "end")
        rows = concord.kwic(self.scoped(scope), phrase, near, width, limit, sort, extra=["line", "source"])
        shown = concord.kwic_lines_text(rows.withColumn("n", F.lit(len(phrase))), width)
        return shown.select("doc_id", "line_start", "i", "left", "node", "right", "source")

    def kwic_totals(self, phrase: list[str], near: str | None = None, width: int = 8, scope: filters.DocFilter | None = None) -> DataFrame:
        return concord.kwic_totals(self.scoped(scope), phrase, near, width)

    def collocates(self, node: str, window: int = 5, least: int = 5, top: int = 30, score: str = "log_dice", scope: filters.DocFilter | None = None) -> DataFrame:
        out = concord.collocates(self.index if scope is None else self.passages(scope), node, window, least)
        return out.orderBy(F.desc(score), F.desc("count"), "word").limit(top)

    def compare(self, node: str, a: filters.DocFilter, b: filters.DocFilter, window: int = 5, least: int = 5) -> DataFrame:
        return concord.compare(self.passages(a), self.passages(b), node, window, least)

    def keyness(self, a: filters.DocFilter, b: filters.DocFilter, least: int = 5, top: int = 40) -> tuple[DataFrame, DataFrame]:
        """Key words of a against b, and of b against a."""
        both = concord.keyness(self.passages(a), self.passages(b), least, both_sides=True)
        return tuple(both.filter(F.col("key") == side).orderBy(F.desc("g2"), "word").limit(top) for side in ("a", "b"))

    def dist(self, phrase: list[str], by: str = "lang", scope: filters.DocFilter | None = None) -> DataFrame:
        return concord.distribution(self.scoped(scope), phrase, by)

    def ngrams(self, sizes: tuple[int, ...] = (3, 4, 5), top: int = 50, strict: bool = False, containing: list[str] | None = None, scope: filters.DocFilter | None = None) -> DataFrame:
        return concord.ngrams(self.passages(scope), sizes, top, strict, containing, self.index if scope is None else None)

    def profile(self, word: str, least: int = 3, scope: filters.DocFilter | None = None) -> DataFrame:
        return concord.profile(self.scoped(scope), word, least).orderBy(F.desc("per_million"), "doc_id")

    def similar(self, seeds: list[tuple[int, int]], top: int = 20) -> DataFrame:
        return search.similar(self.index, seeds, top, explain=3)

    def verify_quote(self, quotes: DataFrame) -> DataFrame:
        return search.verify_quotes(self.documents(), quotes)

    def cite(self, doc_id: int, line_start: int, terms: list[str] = (), kind: str = "writing") -> dict | None:
        """A passage with its citation and the sentence that holds most of the terms; null if there is none."""
        row = self.index.lines.filter((F.col("doc_id") == doc_id) & (F.col("line_start") == line_start)).select("line").first()
        if row is None:
            return None
        doc = self.index.docs.filter(F.col("doc_id") == doc_id).select("author", "title", "date", "url", "path").first()
        span = best_sentence(row.line, list(terms)) if terms else None
        return {"text": row.line, "sentence": row.line[span[0] : span[1]] if span else None, "path": doc.path, "citation": citation(kind, doc.author, doc.title or doc.path, doc.date, doc.url)}

    def facets(self, query: str | None, values: dict[str, str], top: int = 20) -> DataFrame:
        """Facets (name to column of docs) of the documents that a query finds, or of all: facet, value, count.  "months" and "ai" disregard the query's own."""
        kinds = dict(self.index.docs.dtypes)
        return search.facets(self.index, query or None, {n: F.col(c) if kinds[c].startswith("array") else F.array(c) for n, c in values.items()}, top)

    def status(self) -> DataFrame:
        """One row: documents, passages and tokens of the index."""
        return self.index.totals

    def rebuild(self) -> None:
        """Open the index of the source as it is now; what has changed is indexed."""
        self.index = open_index(self.spark, self.folder, mapping=self.mapping, exact=self.exact)

    def clean_report(self, boilerplate: tuple[str, ...] = ()) -> DataFrame:
        return cleaning(self.index.passages, boilerplate=boilerplate)

    @staticmethod
    def parse(query: str):
        return parse(query)

    @staticmethod
    def to_json(rows: DataFrame, most: int = 10_000) -> str:
        """A result as pretty JSON; one of more than ``most`` rows is refused, for it belongs in a table."""
        found = rows.limit(most + 1).collect()
        if len(found) > most:
            raise ValueError(f"more than {most} rows")
        return json.dumps([r.asDict(recursive=True) for r in found], ensure_ascii=False, indent=2, default=str)
