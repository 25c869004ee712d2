"""Corpus statistics as column functions; scores are rounded half away from zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round3(x: Column) -> Column:
    return F.round(x * 1000) / 1000


def round6(x: Column) -> Column:
    return F.round(x * 1000000) / 1000000


def per_million(n: Column, total: Column) -> Column:
    return F.when(total > 0, round3(n * F.lit(1e6) / total)).otherwise(0.0)


def log_dice(both: Column, node: Column, word: Column) -> Column:
    """14 + log2 of the Dice coefficient."""
    return round3(14 + F.log2(2.0 * both / (node + word)))


def mutual_information(both: Column, node: Column, word: Column, size: Column, span: int) -> Column:
    """log2 of observed over expected in a window of ``span`` places."""
    return round3(F.log2(both * size / (node * word * F.lit(float(span)))))


def log_likelihood(a: Column, b: Column, c: Column, d: Column) -> Column:
    """G2 of a word with counts a and b in samples of c and d tokens."""
    of = lambda n, size: F.when(n > 0, n * F.ln(n * (c + d) / (size * (a + b)))).otherwise(0.0)
    return round3(2 * (of(a, c) + of(b, d)))


def pct_diff(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Difference of the normed frequencies in percent of the second; null without a second."""
    return F.when(b > 0, round3((a / c - b / d) * 100 / (b / d)))
