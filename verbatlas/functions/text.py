"""Column functions on text: tokens, folding, dates, links, ids."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The tokeniser that SQL can express too: letters and digits, with apostrophes inside.
TOKEN = r"[\p{L}\p{N}]+(?:'[\p{L}\p{N}]+)*"

#: English function words that queries, collocates and n-grams drop by default.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "been", "but", "by", "can", "could", "did", "do", "does", "for", "from", "had", "has",
    "have", "he", "her", "here", "him", "his", "how", "i", "if", "in", "into", "is", "it", "its", "just", "may", "me", "might", "more",
    "most", "my", "no", "not", "of", "on", "one", "or", "our", "out", "over", "she", "should", "so", "some", "such", "than", "that",
    "the", "their", "them", "then", "there", "these", "they", "this", "those", "to", "too", "up", "us", "was", "we", "were", "what",
    "when", "which", "while", "who", "why", "will", "with", "would", "you", "your",
)


def tokens(text: Column) -> Column:
    """Lower-case tokens of a passage, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def fold(text: Column) -> Column:
    """Text as fields compare it: quotes unified, white space runs one blank, trimmed, lower case."""
    plain = F.translate(text, QUOTES, PLAIN_QUOTES)
    return F.lower(F.trim(F.regexp_replace(plain, r"\s+", " ")))


#: Quotes that fold unifies, and what to.
QUOTES, PLAIN_QUOTES = "‘’‛ʼ“”", "''''\"\""


def fold_text(text: str) -> str:
    """``fold`` of a value of the driver, after NFC."""
    text = unicodedata.normalize("NFC", text).translate(str.maketrans(QUOTES, PLAIN_QUOTES))
    return " ".join(text.split()).lower()


def fold_exact(text: Column) -> Column:
    """``fold`` after NFC, for text that is not known to be NFC; Spark has no function for it, so it comes in Arrow batches."""

    def nfc(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return fold(F.pandas_udf(nfc, "string")(text))


def year_of(date: Column) -> Column:
    """First four characters of a date text if they are digits."""
    head = F.substring(F.trim(date), 1, 4)
    return F.when(head.rlike("^[0-9]{4}$"), head.cast("int"))


def date_floor(date: Column) -> Column:
    """The first day that a partial date can mean, as text yyyy-MM-dd; no calendar check."""
    day = F.substring_index(F.substring_index(F.trim(date), "T", 1), " ", 1)
    part = lambda k: F.regexp_extract(day, r"^([0-9]{4})(?:-([0-9]{1,2}))?(?:-([0-9]{1,2}))?$", k)
    two = lambda x: F.when(x == "", "01").otherwise(F.lpad(x, 2, "0"))
    return F.when(part(1) != "", F.concat(part(1), F.lit("-"), two(part(2)), F.lit("-"), two(part(3))))


def normalise_url(url: Column) -> Column:
    """Host lower case without www. or m., tracking parameters, fragment and last slash dropped."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^https?://([^/?#]+)", 1)), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1), "/+$", "")
    query = F.array_join(F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda p: (p != "") & ~p.rlike("^(utm_|fbclid|gclid|ref=)")), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def strip_html(html: Column) -> Column:
    """Text of a page by patterns: scripts, styles and tags out, the common entities decoded, blanks collapsed."""
    text = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    text = F.regexp_replace(text, r"<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def record_id(*parts: Column) -> Column:
    """A stable id: sha1 of the parts with unit separators between."""
    return F.sha1(F.concat_ws("\u001f", *parts).cast("binary"))


_BORDER = regex.compile(r"(?V1)(?w)\b")


def unicode_spans(text: str | None) -> Iterator[tuple[str, int, int]]:
    """(word, start, end) of the words by the Unicode word borders, lower case, underscores around them cut, those without letter or digit dropped."""
    at = 0
    for piece in _BORDER.split(text or ""):
        word = piece.strip("_")
        if any(map(str.isalnum, word)):
            start = at + len(piece) - len(piece.lstrip("_"))
            yield word.lower(), start, start + len(word)
        at += len(piece)


def unicode_words(text: str | None) -> list[str]:
    """The words of ``unicode_spans``."""
    return [w for w, _, _ in unicode_spans(text)]


def unicode_tokens(text: Column) -> Column:
    """unicode_words of a column, in Arrow batches: Spark has no function for these borders."""

    def of(batch: pd.Series) -> pd.Series:
        return batch.map(unicode_words)

    return F.pandas_udf(of, "array<string>")(text)


#: Fixed values of the 64-bit FNV-1a hash.
_FNV_START, _FNV_PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)


def fnv1a(words: list[str]) -> np.ndarray:
    """64-bit FNV-1a hashes of the words' UTF-8 bytes, one byte of all words at a time."""
    data = [w.encode() for w in words]
    sizes = np.array([len(b) for b in data], np.int64)
    order = np.argsort(-sizes, kind="stable")
    text = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64)
    starts, longest = (np.cumsum(sizes) - sizes)[order], sizes[order]
    found = np.full(len(words), _FNV_START, np.uint64)
    left = len(words)
    for i in range(int(longest[0]) if len(words) else 0):
        left = int(np.searchsorted(-longest[:left], -i, side="left"))
        found[:left] = (found[:left] ^ text[starts[:left] + i]) * _FNV_PRIME
    out = np.empty_like(found)
    out[order] = found
    return out
