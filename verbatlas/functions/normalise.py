"""Exact normalisation of a passage for counting, with a map back to the original; sentences and citations.

Stages, in order: boilerplate lines, entities, tags, emphasis inside words, links and addresses, quotes, NFC.  Text is
held beside runs that say where its parts came from, so every later offset leads back.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from verbatlas.functions.text import PLAIN_QUOTES, QUOTES, unicode_spans, unicode_words
from verbatlas.sources.markdown import blocks, file_lines

#: Stages by name, in order, and tags that leave nothing behind.
STAGES = ("boilerplate", "entities", "tags", "emphasis", "links", "quotes", "nfc")
INLINE = ("a", "abbr", "b", "code", "em", "i", "mark", "s", "small", "span", "strong", "sub", "sup", "u")

_ENTITY = re.compile(r"&(?:[A-Za-z][A-Za-z0-9]{1,31}|#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6});")
_TAG = re.compile(r"</?([A-Za-z][A-Za-z0-9]*)(?:\s[^<>]*)?/?>|<!--.*?-->", re.S)
_EMPHASIS = re.compile(r"(\*{1,3}|__)([^\s*_]+)\1")  # marks around a part of a word; those around several words stand outside tokens
_LINK = re.compile(r"!?\[([^\]]*)\]\(([^)\s]*)\)")
_URL = re.compile(r"(?:https?://|www\.)\S+")


class Mapped:
    """A text with a map back to what it was made from, in runs: (place in the text, start, end) of each.

    A run without an end was copied, so its characters stand for one original character each; those of a run with an
    end all stand for that whole range."""

    def __init__(self, text: str):
        self.text = text
        self.runs: list[tuple[int, int, int | None]] = [(0, 0, None)] if text else []
        self.begins = [r[0] for r in self.runs]

    def place(self, i: int) -> tuple[int, int]:
        """Start and end of what character i stands for."""
        at, start, end = self.runs[bisect_right(self.begins, i) - 1]
        return (start + i - at, start + i - at + 1) if end is None else (start, end)

    def span(self, a: int, b: int) -> tuple[int, int]:
        """Start and end of what the characters from a up to b stand for."""
        return self.place(a)[0], self.place(b - 1)[1]

    @property
    def at(self) -> list[tuple[int, int]]:
        """Every character's place."""
        return [self.place(i) for i in range(len(self.text))]

    def replace(self, pattern: re.Pattern, by) -> bool:
        """Put ``by(match)`` for each match: a text, whose characters all stand for the whole match, or a (start, end) that is kept as it is."""
        out: list[str] = []
        runs: list[tuple[int, int, int | None]] = []
        size = last = 0

        def keep(a: int, b: int) -> None:
            nonlocal size
            out.append(self.text[a:b])
            k = bisect_right(self.begins, a) - 1
            while a < b:
                at, start, end = self.runs[k]
                upto = min(b, self.begins[k + 1]) if k + 1 < len(self.begins) else b
                start += a - at if end is None else 0
                before = runs[-1] if runs else None
                if end is not None or before is None or before[2] is not None or before[1] + size - before[0] != start:
                    runs.append((size, start, end))
                size, a, k = size + upto - a, upto, k + 1

        for m in pattern.finditer(self.text):
            new = by(m)
            if new is None:
                continue
            keep(last, m.start())
            if isinstance(new, tuple):
                keep(*new)
            elif new:
                out.append(new)
                runs.append((size, *self.span(*m.span())))
                size += len(new)
            last = m.end()
        if not last:
            return False
        keep(last, len(self.text))
        self.text, self.runs, self.begins = "".join(out), runs, [r[0] for r in runs]
        return True


def normalise(text: str, boilerplate: tuple[str, ...] = (), without: tuple[str, ...] = ()) -> Mapped:
    """The normalised text with its map; ``without`` names stages that are left out."""
    m = Mapped(text)
    use = lambda stage: stage not in without
    if use("boilerplate"):
        for rule in boilerplate:
            m.replace(re.compile(rf"^(?:{rule})\n?", re.M), lambda x: "")
    if use("entities"):  # coded several times over, as it happens in archives
        for _ in range(8):
            if not m.replace(_ENTITY, lambda x: new if (new := html.unescape(x[0])) != x[0] else None):
                break
    if use("tags"):
        m.replace(_TAG, lambda x: "" if (x[1] or "").lower() in INLINE else " ")
    if use("emphasis"):
        m.replace(_EMPHASIS, lambda x: x.span(2))
    if use("links"):
        m.replace(_LINK, lambda x: x.span(1))
        m.replace(_URL, lambda x: " ")
    if use("quotes"):
        table = dict(zip(QUOTES, PLAIN_QUOTES, strict=True))
        m.replace(re.compile(f"[{QUOTES}]"), lambda x: table[x[0]])
    if use("nfc") and not unicodedata.is_normalized("NFC", m.text):
        m.replace(re.compile(r"[^\u0300-\u036f\u0483-\u0487\u0591-\u05bd\u064b-\u065f\u3099\u309a][\u0300-\u036f\u0483-\u0487\u0591-\u05bd\u064b-\u065f\u3099\u309a]+|[\u1100-\u11ff]+"), lambda x: new if (new := unicodedata.normalize("NFC", x[0])) != x[0] else None)
    return m


def traced(text: str, boilerplate: tuple[str, ...] = ()) -> dict[str, str]:
    """The text after each stage."""
    return {s: normalise(text, boilerplate, STAGES[k + 1 :]).text for k, s in enumerate(STAGES)}


def exact_tokens(text: str | None, boilerplate: tuple[str, ...] = ()) -> list[str]:
    """Tokens of the normalised text by Unicode word borders."""
    return unicode_words(normalise(text or "", boilerplate).text)


def located_tokens(text: str | None, boilerplate: tuple[str, ...] = ()) -> tuple[list[str], list[int], list[int]]:
    """Tokens of the normalised text, and where each starts and ends in the text itself, in characters."""
    m = normalise(text or "", boilerplate)
    found = [(w, *m.span(a, b)) for w, a, b in unicode_spans(m.text)]
    return [w for w, _, _ in found], [a for _, a, _ in found], [b for _, _, b in found]


def exact_passages(rows: DataFrame, column: str = "line", boilerplate: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with toks and n_tok of the exact tokeniser, and starts and ends, the tokens' places in the text; rows without tokens go."""
    made = ["toks", "n_tok", "starts", "ends"]
    rest = [c for c in rows.columns if c not in made]
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rest] + ["toks array<string>", "n_tok long", "starts array<int>", "ends array<int>"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [located_tokens(t, boilerplate) for t in batch[column]]
            out = batch[rest].assign(toks=[f[0] for f in found], n_tok=[len(f[0]) for f in found], starts=[f[1] for f in found], ends=[f[2] for f in found])
            yield out[out["n_tok"] > 0]

    return rows.mapInPandas(run, schema)


def block_passages(docs: DataFrame, boilerplate: tuple[str, ...] = ()) -> DataFrame:
    """Exact passages of whole documents by Markdown blocks: doc_id, lang, source, line_start, line_end, line (the block as it stands), toks, n_tok, starts, ends.

    Null and empty texts have none.  A block that has no token goes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, lang, source, text in zip(batch["doc_id"], batch["lang"], batch["source"], batch["text"], strict=True):
                found = blocks(file_lines(text))  # one document's at a time, so that long ones do not meet in one table
                if found:
                    yield pd.DataFrame({"doc_id": doc, "lang": lang, "source": source, "line_start": [b[0] for b in found], "line_end": [b[1] for b in found], "line": [b[2] for b in found]})

    split = docs.select("doc_id", "lang", "source", "text").mapInPandas(run, "doc_id long, lang string, source string, line_start long, line_end long, line string")
    return exact_passages(split, boilerplate=boilerplate)


def cleaning(rows: DataFrame, column: str = "line", boilerplate: tuple[str, ...] = ()) -> DataFrame:
    """What each stage changes: stage, passages changed, passages whose tokens it changes, and the most frequent token difference with its count and first sample.

    Ties between differences go to the smaller.  rows: doc_id, line_start and the text."""
    from pyspark.sql import functions as F

    schema = "stage string, doc_id long, line_start long, tokens boolean, difference string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, line, text in zip(batch["doc_id"], batch["line_start"], batch[column], strict=True):
                whole = normalise(text or "", boilerplate).text
                for stage in STAGES:
                    other = normalise(text or "", boilerplate, (stage,)).text
                    if other != whole:
                        gone, new = multiset_minus(unicode_words(other), unicode_words(whole)), multiset_minus(unicode_words(whole), unicode_words(other))
                        out.append((stage, doc, line, bool(gone or new), f"{' '.join(gone)} > {' '.join(new)}" if gone or new else None))
            yield pd.DataFrame(out, columns=["stage", "doc_id", "line_start", "tokens", "difference"])

    each = rows.select("doc_id", "line_start", column).mapInPandas(run, schema)
    totals = each.groupBy("stage").agg(F.count(F.lit(1)).alias("passages"), F.count_if("tokens").alias("token_passages"))
    kinds = each.filter("difference IS NOT NULL").groupBy("stage", "difference").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "line_start")).alias("at"))
    best = kinds.groupBy("stage").agg(F.min(F.struct((-F.col("n")).alias("less"), "difference", "at")).alias("b"))
    return totals.join(best, "stage", "left").select("stage", "passages", "token_passages", F.col("b.difference").alias("difference"), (-F.col("b.less")).alias("count"), F.col("b.at.doc_id").alias("doc_id"), F.col("b.at.line_start").alias("line_start"))


def multiset_minus(a: list[str], b: list[str]) -> list[str]:
    """Items of a beyond those of b, each as often as it is more, in a's order."""
    left: dict[str, int] = {}
    for x in b:
        left[x] = left.get(x, 0) + 1
    out = []
    for x in a:
        if left.get(x):
            left[x] -= 1
        else:
            out.append(x)
    return out


# --- sentences and citations ---

_MARKER = re.compile(r"\s*(?:#{1,6} |[-*+] |[0-9]{1,9}[.)] |> )*")
_STOP = re.compile(r"[.!?…]+[\"'”’)\]]*(?=\s+\S|\s*$)")
_SHORT = re.compile(r"(?:^|[\s(])(?:[A-Z]|Mr|Mrs|Ms|Dr|Prof|St|e\.g|i\.e|cf|vs|etc|No|pp?)\.$")


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a passage, without its block marker; initials and usual short forms end none."""
    out, start = [], _MARKER.match(text).end()
    for m in _STOP.finditer(text, start):
        if _SHORT.search(text[start : m.end()]) and text[m.end() :].strip():
            continue
        if text[start : m.end()].strip():
            out.append((start, m.end()))
        start = m.end() + len(text[m.end() :]) - len(text[m.end() :].lstrip())
    if text[start:].strip():
        out.append((start, len(text.rstrip())))
    return out


def best_sentence(text: str, terms: list[str]) -> tuple[int, int] | None:
    """The span of the sentence that holds most different terms, the earliest of those; null if none holds any."""
    held = [(len({t for t in terms if t in exact_tokens(text[a:b])}), -a, (a, b)) for a, b in sentence_spans(text)]
    most = max(held, default=(0, 0, None))
    return most[2] if most[0] else None


def citation(kind: str, author: str | None, title: str | None, date: str | None, url: str | None, markdown: bool = True) -> str:
    """A citation line: author, title (quoted for posts by their date alone), date and link, as far as they are known."""
    title = None if kind in ("tweet", "post") else title
    named = f"*{title}*" if title and markdown else title
    parts = [p for p in (author, named, date) if p]
    line = ", ".join(parts)
    if url:
        line = f"[{line}]({url})" if markdown and line else f"{line}, {url}" if line else url
    return line


def passage_id(corpus: str, key: str, line: int) -> str:
    return f"{corpus}:{key}:{line}"


def split_passage_id(ident: str) -> tuple[str, str, int] | None:
    """Corpus, document key and line of a passage id; the key may hold colons."""
    m = re.fullmatch(r"([^:]+):(.+):([0-9]+)", ident, re.S)
    return (m[1], m[2], int(m[3])) if m else None
