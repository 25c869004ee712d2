"""Quality classifier: a regularised quadratic discriminant over document statistics.

Every whole text becomes a fixed vector of transformed statistics (logs of sizes,
arcsine roots of shares, which lean on a prior of a few words so that one odd word
does not mark a short text).  Class counts, sums and products of labelled documents
are added up in Spark over all labelled rows, so training reads them all and the
driver gets one small table whatever their number.  Each class covariance is
shrunk towards the pooled covariance and its diagonal; a score is the logistic of
the difference of the two log densities, whose Mahalanobis terms use Cholesky
factors that are computed once.

Defined results: null and empty texts have the statistics of no text and get a
score like any other; a document whose id is null is never held out and has no
label; of several labels of one id the smallest counts; with fewer than two
labelled documents of a class, or no labels, every score is the smoothed share of
label 1; repeated rows give repeated rows; an empty table gives no rows; other
columns are no inputs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verbatlas.llm.common import settle, trim

#: The statistics in their order.
STATISTICS = (
    "log_chars", "log_words", "letters", "upper", "digits", "stops", "other_symbols", "spaces", "distinct_words",
    "commonest_word", "repeats_previous", "log_word_length", "log_line_words", "repeated_lines", "odd_word_ends", "words_without_letters", "words_all_upper",
)

#: The prior behind the shares: so many bytes and words of usual text.
PRIOR_BYTES, PRIOR_WORDS = 400, 40

_KINDS = np.zeros(256, np.uint8)  # of ASCII bytes: 1 lower, 2 upper, 3 digit, 4 usual punctuation, 5 other symbol, 6 white
_KINDS[97:123], _KINDS[65:91], _KINDS[48:58] = 1, 2, 3
_KINDS[[ord(c) for c in ".,;:'\"?!()-"]] = 4
_KINDS[[c for c in range(33, 127) if not _KINDS[c]]] = 5
_KINDS[[9, 10, 11, 12, 13, 32]] = 6


def statistics(text: str | None) -> np.ndarray:
    """The vector of STATISTICS of a whole text."""
    text = text or ""
    data = np.frombuffer(text.encode(), np.uint8)
    words, lines = text.split(), text.split("\n")
    kinds = np.bincount(_KINDS[data], minlength=7)
    wide = len(data) - int(kinds[1:].sum())  # bytes of letters beyond ASCII, nearly always
    letters = int(kinds[1] + kinds[2]) + wide
    w = max(1, len(words))
    counts = Counter(words)
    root = lambda x: float(np.arcsin(np.sqrt(min(1.0, max(0.0, x)))))
    of_bytes = lambda x, usual: root((float(x) + PRIOR_BYTES * usual) / (len(data) + PRIOR_BYTES))
    of_words = lambda x: root(x / (len(words) + PRIOR_WORDS))
    ends = sum(1 for x in words if not (x[-1].isalnum() or x[-1] in ".,;:?!'\")"))
    return np.array(
        [
            np.log1p(len(data)),
            np.log1p(len(words)),
            of_bytes(letters, 0.82),
            root((float(kinds[2]) + 0.03 * PRIOR_BYTES) / (letters + PRIOR_BYTES)),
            of_bytes(kinds[3], 0),
            of_bytes(kinds[4], 0.03),
            of_bytes(kinds[5], 0),
            of_bytes(kinds[6], 0.15),
            np.log1p(len(counts)) / np.log1p(w),
            of_words(max(counts.values(), default=0)),
            of_words(sum(map(str.__eq__, words, words[1:]))),
            np.log1p(letters / w),
            np.log1p(len(words) / len(lines)),
            root((len(lines) - len(set(lines))) / (len(lines) + 10)),
            of_words(ends),
            of_words(sum(1 for x in words if not any(map(str.isalpha, x)))),
            of_words(sum(1 for x in words if len(x) > 1 and x.isupper())),
        ]
    )


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t.as_py()) for t in batch.column(1)]
            flat = pa.array(np.concatenate(rows) if rows else np.zeros(0))
            offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, flat)], names=["doc_id", "x"])
        trim()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, x array<double>")


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Discriminant:
    """Means and inverse Cholesky factors of both classes, over standardised statistics."""

    center: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    offsets: list[float]
    share: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(x), self.share)
        z = (x - self.center) / self.scale
        logs = [o - 0.5 * np.square((z - m) @ f.T).sum(1) for m, f, o in zip(self.means, self.factors, self.offsets, strict=True)]
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -40, 40)))


def _sums(labelled: DataFrame) -> dict[int, np.ndarray]:
    """For each class, count, sums and products of the statistics (with a leading 1), added up in Spark."""
    d = len(STATISTICS) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.hstack([np.ones((batch.num_rows, 1)), np.array(batch.column(1).flatten()).reshape(batch.num_rows, -1)])
            label = np.array(batch.column(0))
            for c in (0, 1):
                own = x[label == c]
                if len(own):
                    total = (own.T @ own).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(total), c, np.int32)), pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["label", "i", "v"])

    parts = labelled.select("label", "x").mapInArrow(run, "label int, i int, v double").groupBy("label", "i").agg(F.sum("v").alias("v")).collect()  # 2 x 324 rows
    sums = {c: np.zeros(d * d) for c in (0, 1)}
    for row in parts:
        sums[row.label][row.i] = row.v
    return {c: s.reshape(d, d) for c, s in sums.items()}


def fit(labelled: DataFrame, shrink: float = 0.1, ridge: float = 1e-3) -> Discriminant:
    """Learn from (label, x) rows.

    ``shrink`` is the least weight of the pooled covariance (half of it of its
    diagonal alone) in each class; a class of few documents gets more.
    """
    sums = _sums(labelled)
    n = [sums[c][0, 0] for c in (0, 1)]
    share = (n[1] + 1) / (sum(n) + 2)
    if min(n) < 2:
        return Discriminant(np.zeros(0), np.ones(0), [], [], [], share)
    both = sums[0] + sums[1]
    center = both[0, 1:] / both[0, 0]
    scale = np.sqrt(np.maximum(np.diag(both)[1:] / both[0, 0] - center**2, 1e-8))
    means, covs = [], []
    for c in (0, 1):
        mean = sums[c][0, 1:] / n[c]
        cov = sums[c][1:, 1:] / n[c] - np.outer(mean, mean)
        means.append((mean - center) / scale)
        covs.append(cov / np.outer(scale, scale))
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / sum(n)
    target = 0.5 * pooled + 0.5 * np.diag(np.diag(pooled))
    factors, offsets = [], []
    for c in (0, 1):
        weight = max(shrink, len(center) / (len(center) + n[c]))
        cov = (1 - weight) * covs[c] + weight * target + ridge * np.eye(len(center))
        lower = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(lower))
        offsets.append(float(np.log(n[c] / sum(n)) - np.log(np.diag(lower)).sum()))
    return Discriminant(center, scale, means, factors, offsets, share)


def known_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, label) of the labels that are learnt from."""
    known = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("label"))
    return known.filter(~held_out(F.col("doc_id")))


def train(docs: DataFrame, labels: DataFrame) -> tuple[Discriminant, DataFrame]:
    """The discriminant learnt from labels that are not held out, and the settled statistics of all documents."""
    stats = settle(with_statistics(docs))
    return fit(stats.join(known_labels(labels), "doc_id")), stats


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted; labels are learnt from rows that are not held out."""
    model, stats = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).flatten()).reshape(batch.num_rows, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], names=["doc_id", "score"])

    scored = stats.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns; texts are not shuffled.

    Statistics are taken once and written beside the rows."""
    names = docs.columns
    at = names.index("text")
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = pa.array(np.concatenate([statistics(t.as_py()) for t in batch.column(at)]) if batch.num_rows else np.zeros(0))
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(STATISTICS))
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(batch.columns, names=names), pa.ListArray.from_arrays(offsets, flat)], names=["row", "x"])
        trim()

    texts = docs.select(*[F.col(f"`{c}`").cast("string").alias(c) if k == at else F.col(f"`{c}`") for k, c in enumerate(docs.columns)])
    measured = settle(texts.mapInArrow(measure, schema))
    stats = measured.select(F.col("row.doc_id").cast("long").alias("doc_id"), "x")
    model = fit(stats.join(known_labels(labels), "doc_id"))

    def judge(x: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.stack(x.to_list()))) if len(x) else pd.Series([], dtype=float)

    good = measured.filter(F.pandas_udf(judge, "double")("x") >= threshold)
    return good.select(*[F.col("row")[c].alias(c) for c in docs.columns])
