"""Document filters: one predicate over document columns, its validation, and slices written in the query language.

A document without a field fails that field's filter; one without a readable date fails every date filter,
and one without topic tags every topic filter.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbatlas.functions.text import date_floor, fold, fold_text, year_of
from verbatlas.plans.grammar import date_range, parse, quote


@dataclass
class DocFilter:
    """All named conditions must hold.  Lists of lang, genre, source and months: any of them; of themes, entities and events: all."""

    lang: list[str] = field(default_factory=list)
    genre: list[str] = field(default_factory=list)
    source: list[str] = field(default_factory=list)
    kind: str | None = None
    author: str | None = None
    title: str | None = None
    year: int | None = None
    after: str | None = None  #: inclusive
    before: str | None = None  #: exclusive
    themes: list[str] = field(default_factory=list)
    entities: list[str] = field(default_factory=list)
    events: list[str] = field(default_factory=list)
    months: list[str] = field(default_factory=list)
    ai: bool | None = None

    def validate(self) -> None:
        """Refuse dates and months that cannot be meant."""
        for name in ("after", "before"):
            value = getattr(self, name)
            if value is not None and floor_of(value) is None:
                raise ValueError(f"{name}: {value!r} is no date")
        for month in self.months:
            if not re.fullmatch(r"[0-9]{4}(-(0[1-9]|1[0-2]))?", month.strip()):
                raise ValueError(f"month: {month!r} is neither a month nor a year")


def floor_of(date: str) -> str | None:
    """``date_floor`` of a value of the driver."""
    m = re.fullmatch(r"([0-9]{4})(?:-([0-9]{1,2}))?(?:-([0-9]{1,2}))?", re.split("[T ]", date.strip(), maxsplit=1)[0])
    return f"{m[1]}-{(m[2] or '1').zfill(2)}-{(m[3] or '1').zfill(2)}" if m else None


def singular(kind: Column) -> Column:
    """A kind without all s at its end, folded."""
    return F.regexp_replace(fold(kind), "s+$", "")


def predicate(f: DocFilter, resolve: Callable[[str], str] = lambda event: event) -> Column:
    """The filter over columns lang, genre, source, kind, author, title, date, themes, entities, event, month, ai; never null.

    ``resolve`` maps a monthly event id to its lasting one."""
    f.validate()
    parts: list[Column] = []
    for name in ("lang", "genre", "source"):
        if wanted := getattr(f, name):
            parts.append(fold(F.col(name)).isin(*map(fold_text, wanted)))
    if f.kind is not None:
        parts.append(singular(F.col("kind")) == fold_text(f.kind).rstrip("s"))
    for name in ("author", "title"):
        if (wanted := getattr(f, name)) is not None:
            parts.append(F.contains(fold(F.col(name)), F.lit(fold_text(wanted))))
    if f.year is not None:
        parts.append(year_of(F.col("date")) == f.year)
    floor = date_floor(F.col("date"))
    if f.after is not None:
        parts.append(floor >= floor_of(f.after))
    if f.before is not None:
        parts.append(floor < floor_of(f.before))
    for name, wanted in (("themes", f.themes), ("entities", f.entities)):
        have = F.transform(name, fold)
        parts += [F.array_contains(have, fold_text(w)) for w in wanted]
    parts += [fold(F.col("event")) == fold_text(resolve(w)) for w in f.events]
    if f.months:
        one = lambda m: F.startswith(F.col("month"), F.lit(m)) if len(m) == 4 else F.col("month") == m
        any_of = one(f.months[0].strip())
        for m in f.months[1:]:
            any_of |= one(m.strip())
        parts.append(any_of)
    if f.ai is not None:
        parts.append(F.col("ai") == f.ai)
    out = F.lit(True)
    for p in parts:
        out &= F.coalesce(p, F.lit(False))
    return out


def select(docs: DataFrame, f: DocFilter) -> DataFrame:
    return docs.filter(predicate(f))


#: Fields of the query language and the filter's lists that they add to.
_LISTS = {"lang": "lang", "genre": "genre", "source": "source", "theme": "themes", "themes": "themes", "entity": "entities", "entities": "entities", "event": "events", "events": "events", "month": "months", "months": "months"}


def from_query(named: dict[str, str | list[str]], base: DocFilter | None = None) -> DocFilter:
    """Query fields as a filter on top of ``base``; a year or date range that meets an after or before of its own is refused."""
    f = DocFilter(**{x.name: (list(v) if isinstance(v := getattr(base, x.name), list) else v) for x in fields(DocFilter)}) if base else DocFilter()
    for name, value in named.items():
        if name in _LISTS:
            getattr(f, _LISTS[name]).extend([value] if isinstance(value, str) else value)
        elif name in ("author", "title", "kind", "type"):
            setattr(f, "kind" if name == "type" else name, value)
        elif name == "ai":
            if value not in ("true", "false"):
                raise ValueError("ai is true or false")
            f.ai = value == "true"
        elif name in ("after", "before"):
            if getattr(f, name) is not None:
                raise ValueError(f"{name} is given twice")
            setattr(f, name, value)
        elif name in ("year", "date"):
            if f.after is not None or f.before is not None:
                raise ValueError(f"{name} meets an after or before")
            if re.fullmatch("[0-9]{4}", value.strip()):
                f.year = int(value)
            elif (found := date_range(value)) is None:
                raise ValueError(f"{value!r} is neither a date nor a range of years")
            else:
                f.after, f.before = found
        else:
            raise ValueError(f"no document field {name}")
    f.validate()
    return f


def parse_slice(text: str, corpora: tuple[str, ...]) -> tuple[list[str], DocFilter]:
    """Corpora and filter of a slice; a bare word names a corpus, and search terms are refused."""
    bare, rest = [], []
    for part in re.findall(r'[^\s"]*"(?:[^"\\]|\\.)*"|\S+', text):
        (rest if ":" in part else bare).append(part)
    if unknown := [b for b in bare if b not in corpora]:
        raise ValueError(f"no corpus {unknown[0]}; a slice has no search terms")
    query = parse(" ".join(rest))
    if query.any_of or query.without or query.patterns:
        raise ValueError("a slice has no search terms")
    named = {**query.fields, **query.repeated}
    if refused := {"tag", "color", "co", "id"} & set(named):
        raise ValueError(f"a slice has no {sorted(refused)[0]}")
    inside = named.pop("in", None)
    return bare + ([inside] if inside else []), from_query(named)


def to_slice(corpora: list[str], f: DocFilter) -> str:
    """The slice text that ``parse_slice`` reads back."""
    parts = list(corpora)
    for name in ("lang", "genre", "source"):
        parts += [f"{name}:{quote(v)}" for v in getattr(f, name)]
    for name, key in (("kind", "type"), ("author", "author"), ("title", "title"), ("year", "year"), ("after", "after"), ("before", "before")):
        if (value := getattr(f, name)) is not None:
            parts.append(f"{key}:{quote(str(value))}")
    for name, key in (("themes", "theme"), ("entities", "entity"), ("events", "event"), ("months", "month")):
        parts += [f"{key}:{quote(v)}" for v in getattr(f, name)]
    if f.ai is not None:
        parts.append(f"ai:{str(f.ai).lower()}")
    return " ".join(parts)
