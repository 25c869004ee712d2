"""Stemmed tokens of the second index: words folded without marks, cut by Porter's suffix rules (1980, with his later two changes)."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = regex.compile(r"[\p{L}\p{N}\p{Co}\p{M}]+")
_SHAPE = re.compile("v+c")

#: Fixed values of the stemmer: suffixes that change, by step, and those that go.
SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "sion", "tion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
#: Tokens of fewer or more bytes are not stemmed.
LEAST, MOST = 3, 64


def _shape(part: str) -> str:
    """Vowels as v, other letters as c; y is a vowel after a consonant."""
    out = ""
    for ch in part:
        out += "v" if ch in "aeiou" or (ch == "y" and out[-1:] == "c") else "c"
    return out


def _measure(part: str) -> int:
    """How often consonants follow vowels."""
    return len(_SHAPE.findall(_shape(part)))


def _short(part: str) -> bool:
    """Does it end in consonant, vowel, consonant other than w, x, y?"""
    return _shape(part)[-3:] == "cvc" and part[-1] not in "wxy"


def _swap(word: str, table: dict[str, str]) -> str:
    """The longest suffix of the table is replaced if something is left to measure before it."""
    end = max((s for s in table if word.endswith(s)), key=len, default=None)
    return word[: -len(end)] + table[end] if end and _measure(word[: -len(end)]) > 0 else word


def _inflected(word: str) -> str:
    """Plurals and the endings ed and ing."""
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    cut = 2 if word.endswith("ed") else 3 if word.endswith("ing") else 0
    if not cut or "v" not in _shape(word[:-cut]):
        return word
    word = word[:-cut]
    if word.endswith(("at", "bl", "iz")) or (_measure(word) == 1 and _short(word)):
        return word + "e"
    return word[:-1] if word[-1:] == word[-2:-1] and _shape(word)[-1] == "c" and word[-1] not in "lsz" else word


@lru_cache(maxsize=1 << 16)
def porter(word: str) -> str:
    """The stem of a folded word."""
    if not LEAST <= len(word.encode()) <= MOST:
        return word
    word = _inflected(word)
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, SECOND), THIRD)
    end = max((s for s in FOURTH if word.endswith(s)), key=len, default=None)
    if end:
        kept = word[: -3 if end in ("sion", "tion") else -len(end)]
        word = kept if _measure(kept) > 1 else word
    if word.endswith("e"):
        m = _measure(word[:-1])
        word = word[:-1] if m > 1 or (m == 1 and not _short(word[:-1])) else word
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


def words_of(text: str | None) -> list[str]:
    """The words of a text in order; marks of Latin letters are dropped, case does not count."""
    if not text:
        return []
    plain = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
    return _WORD.findall(unicodedata.normalize("NFC", plain))


def stems_of(text: str | None) -> list[str]:
    """The stems of words_of."""
    return [porter(w) for w in words_of(text)]


def stemmed(texts: Column, exact: bool = False) -> Column:
    """stems_of, or with ``exact`` words_of, each text of an array, with a blank around every one and a line break between texts, so that a run of them in one text is a substring."""
    cut = words_of if exact else stems_of

    def of(batch: pd.Series) -> pd.Series:
        return batch.map(lambda row: " " + " \n ".join(" ".join(cut(t)) for t in (() if row is None else row)) + " ")

    return F.pandas_udf(of, "string")(texts)
