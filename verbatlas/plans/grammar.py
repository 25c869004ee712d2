"""The search language: a query text as fields, phrases, patterns, negations and OR groups.

``parse`` needs no Spark.  A construct counts only at the start of a word: a phrase in
quotes (after one - it is negated), /pattern/flags, name:value with a known name, else a
term that runs to the next blank.  What follows a closing quote directly is a term.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, timedelta

import regex

from verbatlas.functions.text import STOPWORDS

#: Blanks, closing and opening quotes of the language.
BLANKS = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
CLOSING = '"“”„‟'
OPENING = '"“„'

#: Spellings of each field.
FIELDS = {
    "author": ("author", "au"), "title": ("title", "ti"), "type": ("type", "ty"), "tag": ("tag",), "date": ("date", "d", "year", "y"), "after": ("after", "since", "from"),
    "before": ("before", "until", "to"), "color": ("color", "colour", "co"), "i": ("i",), "zo": ("zo",), "source": ("source",), "in": ("in",), "lang": ("lang",),
    "genre": ("genre",), "theme": ("theme",), "entity": ("entity",), "event": ("event",), "ai": ("ai",), "month": ("month",),
}
#: Words that stand for a type; their value is searched as text.
TYPES = {
    "articles": ("art", "article", "articles"), "books": ("bo", "boo", "book", "books"), "tweets": ("tw", "tweet", "tweets"), "pdfs": ("pdf", "pdfs"),
    "podcasts": ("pod", "podcast", "podcasts"), "supplementals": ("sup", "supplemental", "supplementals"),
}
REPEATED = ("theme", "entity", "event", "month")

_FIELD = {spelling: name for name, all_ in FIELDS.items() for spelling in all_}
_TYPE = {spelling: name for name, all_ in TYPES.items() for spelling in all_}
_QUOTED = rf"[{OPENING}]((?:\\[\\{CLOSING}]|[^{CLOSING}])*+)[{CLOSING}]"
_PHRASE = regex.compile(rf"(-?){_QUOTED}")
_PATTERN = regex.compile(rf"/((?:\\.|[^/\\])++)/([a-z]*)(?=[{BLANKS}]|\Z)", regex.S)
_NAMED = regex.compile(rf"([^:{BLANKS}]*):")
_VALUE = regex.compile(_QUOTED)
_WORD = regex.compile(rf"[^{BLANKS}]+")
_UNESCAPE = regex.compile(rf"\\([\\{CLOSING}])")


@dataclass(frozen=True)
class Term:
    """A word, a prefix (``metaph*``, without the star) or a phrase."""

    text: str
    form: str


@dataclass
class Query:
    """What a query text says: OR of AND groups, negations, patterns and fields (last value, all values of repeated ones)."""

    any_of: list[list[Term]] = field(default_factory=list)
    without: list[Term] = field(default_factory=list)
    patterns: list[tuple[str, str]] = field(default_factory=list)
    fields: dict[str, str] = field(default_factory=dict)
    repeated: dict[str, list[str]] = field(default_factory=dict)
    fts: str = ""
    corpus_only: bool = True

    @property
    def has_image(self) -> bool:
        return "i" in self.fields

    @property
    def zotero(self) -> bool:
        return "zo" in self.fields

    @property
    def positive_terms(self) -> list[str]:
        return [t.text for group in self.any_of for t in group]


def scan(text: str) -> list[tuple]:
    """Tokens in order: ("phrase", negated, text), ("pattern", source, flags), ("field", name, value), ("term", text)."""
    out, at = [], 0

    def take(found) -> int:
        rest = _WORD.match(text, found.end())
        if rest:
            out.append(("term", rest.group()))
        return (rest or found).end()

    while word := _WORD.search(text, at):
        at = word.start()
        if m := _PHRASE.match(text, at):
            out.append(("phrase", m[1] == "-", _UNESCAPE.sub(r"\1", m[2])))
            at = take(m)
        elif m := _PATTERN.match(text, at):
            out.append(("pattern", m[1], m[2]))
            at = m.end()
        elif (m := _NAMED.match(text, at)) and (name := m[1].lower()) in _FIELD | _TYPE and m[1].isascii():
            if v := _VALUE.match(text, m.end()):
                out.append(("field", name, _UNESCAPE.sub(r"\1", v[1])))
                at = take(v)
            else:
                out.append(("field", name, text[m.end() : word.end()]))
                at = word.end()
        else:
            out.append(("term", word.group()))
            at = word.end()
    return out


def quote(value: str) -> str:
    """A field value as ``scan`` reads it back."""
    if value and not regex.search(rf"[{BLANKS}{CLOSING}\\]", value):
        return value
    return '"' + regex.sub(rf"([\\{CLOSING}])", r"\\\1", value) + '"'


def only_corpus(text: str) -> bool:
    """Does the text say nothing but which corpora to look in?"""
    return all(t[0] == "field" and t[1] == "in" for t in scan(text))


def _is_stopword(word: str) -> bool:
    return word.strip(BLANKS).lower() in STOPWORDS


def _operator(token: tuple) -> str | None:
    word = token[1].lower() if token[0] == "term" else ""
    return {"or": "OR", "|": "OR", "and": "AND"}.get(word)


def _free(tokens: list[tuple], partial: bool, query: Query) -> None:
    """Read terms and phrases into ``any_of``, ``without`` and the text form ``fts``."""
    words = [t[1] for t in tokens if t[0] == "term" and not _operator(t)]
    drop_stopwords = not all(_is_stopword(w.removeprefix("-")) for w in words)
    groups: list[list[tuple[Term, str]]] = [[]]
    operators = False
    for token in tokens:
        if op := _operator(token):
            operators = True
            if op == "OR":
                groups.append([])
            continue
        if token[0] == "phrase":
            negated, text, form = token[1], token[2], "phrase"
        else:
            text = token[1]
            negated = text.startswith("-") and len(text) > 1
            text = text[1:] if negated else text
            if drop_stopwords and not text.endswith("*") and _is_stopword(text):
                continue
            form = "prefix" if regex.fullmatch(r"[\p{L}\p{N}_]+\*", text) else "word"
        text = text[:-1] if form == "prefix" else text.replace('"', "").strip(BLANKS)
        if not text:
            continue
        open_end = form == "prefix" or (partial and form == "word" and regex.fullmatch(r"[\p{L}\p{N}_]+", text))
        if negated:
            query.without.append(Term(text, form))
        else:
            groups[-1].append((Term(text, form), f"{text}*" if open_end else f'"{text}"'))
    shown = [" ".join(f for _, f in g) for g in groups]
    groups = [g for g in groups if g]
    query.any_of = [[t for t, _ in g] for g in groups]
    if not groups:
        return
    if operators:
        # an OR counts in this form only between two terms; of neighbouring ones none does
        positive = regex.sub("(?: OR){2,}", "", " OR".join(f" {g}" if g else "" for g in shown)).removeprefix(" OR").removesuffix(" OR").strip()
    else:  # three words or more are joined by OR in this form only
        parts = [f for _, f in groups[0]]
        positive = (" OR " if len(parts) >= 3 else " ").join(parts)
    query.fts = (f"({positive})" if query.without else positive) + "".join(f' NOT "{t.text}"' for t in query.without)


def parse(text: str, partial: bool = False) -> Query:
    """A query text; ``partial`` treats bare words as prefixes in ``fts``."""
    query, free, typed = Query(), [], []
    for token in scan(text):
        query.corpus_only &= token[0] == "field" and token[1] == "in"
        if token[0] == "pattern":
            query.patterns.append(token[1:])
        elif token[0] != "field":
            free.append(token)
        elif token[1] in _TYPE:
            query.fields["type"] = _TYPE[token[1]]
            typed += [("term", w) for w in _WORD.findall(token[2])]
        else:
            name = _FIELD[token[1]]
            query.fields[name] = token[2]
            if name in REPEATED:
                query.repeated.setdefault(name, []).append(token[2])
            if name == "source" and "zotero" in token[2].lower():
                query.fields["zo"] = ""
    _free(free + typed, partial, query)
    return query


def date_range(value: str) -> tuple[str | None, str | None] | None:
    """A date value as first day and day after the last: year, month, day, years a-b, a- or -b; null if it is none."""
    value = value.strip(BLANKS)
    new_year = lambda y: f"{y:04}-01-01"
    if m := regex.fullmatch(r"(?:([0-9]{4})(-)?|()(-))([0-9]{4})?", value):
        first, last = m[1], m[5]
        if not (m[2] or m[4]):
            return (new_year(int(first)), new_year(int(first) + 1)) if first and not last else None
        if first and last and last < first or not (first or last):
            return None
        return (new_year(int(first)) if first else None, new_year(int(last) + 1) if last else None)
    m = regex.fullmatch(r"([0-9]{4})-(0[1-9]|1[0-2])(?:-(0[1-9]|[12][0-9]|3[01]))?", value)
    if not m:
        return None
    year, month = int(m[1]), int(m[2])
    if not year:  # the calendar here begins with year 1
        return None
    if m[3] is None:
        return value + "-01", f"{year + month // 12:04}-{month % 12 + 1:02}-01"
    # a day beyond the month's end rolls over
    return value, (date(year, month, 1) + timedelta(days=int(m[3]))).isoformat()
