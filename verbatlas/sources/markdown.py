"""Passages of Markdown bodies and posts of collection files, as Arrow-batched functions of whole files.

A block ends at a blank line; a heading is a block, a list item begins one, and rules or underlines
end one and carry no text.  A null or empty body has no passages; line numbers count from 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame

_HEADING = regex.compile(r"\s*#{1,6}(?: |\Z)")
_ITEM = regex.compile(r"\s*(?:[-*+] |[0-9]{1,9}[.)] )")
_POST = regex.compile(r"## (\S+) — tweet ([0-9]+)(?: · kind: (\S+))?\s*")


def blocks(lines: list[str], first: int = 1) -> list[tuple[int, int, str]]:
    """(first line, last line, text) of each block of a body whose first line has the number ``first``."""
    groups: list[list[int]] = []
    open_ = False
    for i, line in enumerate(lines):
        bare = "".join(line.split())
        rule = len(bare) >= 2 and (set(bare) in ({"="}, {"-"}) or (len(bare) >= 3 and set(bare) <= {"*", "_"}))
        if not bare or rule:
            open_ = False
            continue
        heading = _HEADING.match(line) is not None
        if not open_ or heading or _ITEM.match(line):
            groups.append([])
        groups[-1].append(i)
        open_ = not heading
    return [(first + g[0], first + g[-1], "\n".join(lines[g[0] : g[-1] + 1])) for g in groups]


def posts(lines: list[str]) -> list[tuple[str, str, str | None, list[tuple[int, int, str]]]]:
    """(time, id, kind, blocks) of each post section; its text stands between ~~~ fences."""
    found: list[list] = []
    state = "out"
    for n, line in enumerate(lines, 1):
        fence = line.rstrip() == "~~~"
        if state == "in":
            if fence:
                state = "out"
            else:
                found[-1][3].append((n, line))
        elif m := _POST.fullmatch(line):
            found.append([m[1], m[2], m[3], []])
            state = "before"
        elif state == "before" and fence:
            state = "in"
    return [(at, id_, kind, blocks([t for _, t in body], body[0][0]) if body else []) for at, id_, kind, body in found]


def file_lines(text: str | None) -> list[str]:
    """Lines of a file, without a mark of its byte order."""
    return regex.split(r"\r?\n", (text or "").removeprefix("﻿"))


def split_passages(files: DataFrame) -> DataFrame:
    """Of (path, body): path, ord (from 0), line_start, line_end, original."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, k, *b) for p, body in zip(batch["path"], batch["body"], strict=True) for k, b in enumerate(blocks(file_lines(body)))]
            yield pd.DataFrame(rows, columns=["path", "ord", "line_start", "line_end", "original"])

    return files.select("path", "body").mapInPandas(run, "path string, ord int, line_start int, line_end int, original string")


def split_posts(files: DataFrame) -> DataFrame:
    """Of (path, body): key (path#id), post_id, at, kind (tweet if none is named), ord, line_start, line_end, original; a post without text has one row without passage."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (f"{p}#{id_}", id_, at, kind or "tweet", k, *b)
                for p, body in zip(batch["path"], batch["body"], strict=True)
                for at, id_, kind, found in posts(file_lines(body))
                for k, b in enumerate(found or [(None, None, None)])
            ]
            out = pd.DataFrame(rows, columns=["key", "post_id", "at", "kind", "ord", "line_start", "line_end", "original"])
            yield out.astype({"line_start": "Int32", "line_end": "Int32"})

    return files.select("path", "body").mapInPandas(run, "key string, post_id string, at string, kind string, ord int, line_start int, line_end int, original string")
