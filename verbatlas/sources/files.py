"""Sources of files: discovery, frontmatter, document data, JSON lines, event records, briefings, theme lists and highlight archives.

Files are found and read by Spark; whole texts are parsed in Arrow batches.  What cannot be read is kept as a row
with a reason and never stops the rest.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatlas.functions.text import fold, fold_text

#: Bytes of a line of JSON, and of an event record, that are read at most.
LINE_BYTES, RECORD_BYTES = 1 << 20, 1 << 20


def glob_regex(glob: str) -> str:
    """A pattern for whole relative paths: ** crosses folders, * and ? do not."""
    out, at = "", 0
    while at < len(glob):
        if glob.startswith("**/", at):
            out, at = out + "(?:.*/)?", at + 3
        elif glob.startswith("**", at):
            out, at = out + ".*", at + 2
        else:
            c = glob[at]
            out, at = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), at + 1
    return f"^{out}$"


def discover(spark: SparkSession, root: str, include: tuple[str, ...] = ("**/*.md",), exclude: tuple[str, ...] = ()) -> DataFrame:
    """Files below root: path (relative), mtime, size, text; hidden parts are skipped, by path.

    Text that is not UTF-8 has replacement characters.  Spark's reader leaves out names that begin with _ as well."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/") + "/"
    path = F.substring_index(F.col("path"), base, -1)
    wanted = lambda globs: "|".join(map(glob_regex, globs))
    rows = files.select(path.alias("path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), F.make_valid_utf8("content").alias("text"))
    rows = rows.filter(F.col("path").rlike(wanted(include)) & ~F.col("path").rlike(r"(^|/)\."))
    return (rows.filter(~F.col("path").rlike(wanted(exclude))) if exclude else rows).orderBy("path")


def _scalar(value: str) -> str:
    value = value.strip()
    if len(value) >= 2 and value[0] == value[-1] and value[0] in "\"'":
        inner = value[1:-1]
        return inner.replace("''", "'") if value[0] == "'" else re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), inner)
    return value


def _inline(value: str) -> list[str]:
    """The items of an inline list; commas in quotes do not part."""
    items = re.findall(r"""\s*("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^,]*)\s*(?:,|$)""", value.strip()[1:-1])
    return [x for x in map(_scalar, items) if x]


def front_matter(text: str | None) -> tuple[dict[str, list[str]], int, list[str]]:
    """Fields (lists of values), the number of the body's first line, and its lines.

    A BOM and CRLF are accepted, --- or ... ends the head, lists stand inline or as "- item" lines, values may hold
    colons, and a head that does not end is body."""
    lines = re.split(r"\r?\n", (text or "").removeprefix("\ufeff"))
    end = next((k for k, line in enumerate(lines[1:], 1) if line.rstrip() in ("---", "...")), None) if lines[0].rstrip() == "---" else None
    if end is None:
        return {}, 1, lines
    fields: dict[str, list[str]] = {}
    name = None
    for line in lines[1:end]:
        if m := re.match(r"\s*-\s+(.*)$", line):
            if name is not None and _scalar(m[1]):
                fields[name].append(_scalar(m[1]))
        elif m := re.match(r"([A-Za-z0-9_][A-Za-z0-9_ -]*):(?:\s+(.*))?$", line):
            name, value = m[1].strip(), (m[2] or "").strip()
            fields[name] = _inline(value) if value.startswith("[") and value.endswith("]") else [v] if (v := _scalar(value)) else []
    return fields, end + 2, lines[end + 1 :]


def parsed(files: DataFrame) -> DataFrame:
    """Of (path, text): path, fields (map of lists), body_line, body."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [front_matter(t) for t in batch["text"]]
            yield pd.DataFrame({"path": batch["path"], "fields": pd.Series([f for f, _, _ in found], dtype=object), "body_line": [n for _, n, _ in found], "body": ["\n".join(b) for _, _, b in found]})

    return files.select("path", "text").mapInPandas(run, "path string, fields map<string, array<string>>, body_line int, body string")


#: The fields that each document column is taken from, in turn.
FIELD_MAP = {
    "title": ("title",), "date": ("date", "published_at"), "genre": ("genre", "type"), "lang": ("lang",), "author": ("author", "authors"), "summary": ("summary",),
    "source_system": ("source_system",), "source_id": ("source_id",),
}


def documents(files: DataFrame, required: tuple[str, ...] = (), field_map: dict[str, tuple[str, ...]] | None = None, default_author: str | None = None) -> DataFrame:
    """Documents of parsed files: path, one column a mapped field, topics, public_url; files without a required field are none.

    A title is the field, else the first heading, else the file's name; the public URL is the first web address of the URL fields."""
    names = FIELD_MAP | (field_map or {})
    first = lambda keys: F.coalesce(*[F.get(F.filter(F.try_element_at("fields", F.lit(k)), lambda v: F.trim(v) != ""), 0) for k in keys])
    rows = files
    for key in required:
        rows = rows.filter(F.coalesce(F.exists(F.try_element_at("fields", F.lit(key)), lambda v: F.trim(v) != ""), F.lit(False)))
    heading = F.regexp_extract("body", r"(?m)^\s*#{1,6}\s+(.+?)\s*#*\s*$", 1)
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    none = F.array().cast("array<string>")
    urls = F.concat(*[F.coalesce(F.try_element_at("fields", F.lit(k)), none) for k in ("published_url", "source_url", "canonical_url", "url")])
    own = {c: first(keys) for c, keys in names.items()}
    own["title"] = F.coalesce(own["title"], F.when(heading != "", heading), stem)
    if default_author:
        own["author"] = F.coalesce(own["author"], F.lit(default_author))
    return rows.select("path", *[v.alias(c) for c, v in own.items()], F.coalesce(F.try_element_at("fields", F.lit("topics")), none).alias("topics"), F.get(F.filter(urls, lambda u: u.rlike("(?i)^https?://")), 0).alias("public_url"))


# --- JSON lines ---

_KINDS = {"key": str, "path": str, "date": str, "month": str, "event": str, "event_name": str, "confidence": str, "run_id": str, "prompt_version": str, "ai_related": bool}
_LISTS = ("themes", "entities", "events", "mentioned_works")


def tag_row(line: str) -> dict | None:
    """A line of tags with every field of its own type, or None: bad JSON, a wrong type, a blank key, or a line that is too long."""
    if len(line.encode("utf-8", "surrogatepass")) > LINE_BYTES or "\ufffd" in line:
        return None
    try:
        row = json.loads(line)
    except (ValueError, RecursionError):
        return None
    if not isinstance(row, dict) or not isinstance(row.get("key"), str) or not row["key"].strip():
        return None
    for name, kind in _KINDS.items():
        if row.get(name) is not None and type(row[name]) is not kind:
            return None
    for name in _LISTS:
        if row.get(name) is not None and not (isinstance(row[name], list) and all(isinstance(x, str) for x in row[name])):
            return None
    typed = row.get("entities_typed")
    if typed is not None and not (isinstance(typed, list) and all(isinstance(x, dict) and isinstance(x.get("name"), str) and isinstance(x.get("type"), str) for x in typed)):
        return None
    return row


def tag_rows(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of (line, text): the last valid row of each key, and one row with the numbers of valid and bad lines.  Blank lines are neither."""
    schema = "line long, good boolean, key string, path string, date string, month string, event string, event_name string, ai_related boolean, themes array<string>, entities array<string>, events array<string>, mentioned_works array<string>, entity_types map<string, string>"
    names = [f.split()[0] for f in schema.split(", ") if not f.startswith("string>")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for n, text in zip(batch["line"], batch["text"], strict=True):
                if text is None or not text.strip():
                    continue
                row = tag_row(text)
                types = {fold_text(x["name"]): x["type"] for x in (row or {}).get("entities_typed") or ()}
                out.append((n, row is not None, *((row or {}).get(k) for k in names[2:-1]), types or None))
            yield pd.DataFrame({c: pd.Series([r[k] for r in out], dtype=object) for k, c in enumerate(names)})

    rows = lines.select("line", "text").mapInPandas(run, schema)
    rest = [c for c in names if c not in ("line", "good", "key")]
    last = rows.filter("good").groupBy("key").agg(*[F.max_by(F.struct(*rest), "line").alias("r")]).select("key", "r.*")
    return last, rows.agg(F.count_if("good").alias("valid"), F.count_if(~F.col("good")).alias("bad"))


# --- records, briefings, themes ---

_DATE = re.compile(r"\d{4}-\d{2}-\d{2}$")


def event_record(name: str, text: str) -> tuple[dict | None, str | None]:
    """A record of an event file, or why it is none."""
    if len(text.encode()) > RECORD_BYTES:
        return None, "too large"
    if re.search(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", text):
        return None, "control characters"
    fields, _, body = front_matter(text)
    one = lambda k: (fields.get(k) or [None])[0]
    if not one("id"):
        return None, "no id"
    if one("id") != re.sub(r"\.md$", "", name.rsplit("/", 1)[-1]):
        return None, "id is not the file's name"
    for k in ("start", "end"):
        if one(k) and not _DATE.match(one(k)):
            return None, f"{k} is no date"
    if one("start") and one("end") and one("end") < one("start"):
        return None, "ends before it starts"
    return {"id": one("id"), "name": one("name") or one("id"), "aliases": fields.get("aliases", []), "start": one("start"), "end": one("end"), "members": fields.get("members", []), "themes": fields.get("themes", []), "origin": one("origin"), "edited": one("edited"), "merged_into": one("merged_into"), "removed": one("removed"), "description": "\n".join(body).strip()}, None


_RECORD = "id string, name string, aliases array<string>, start string, end string, members array<string>, themes array<string>, origin string, edited string, merged_into string, removed string, description string"


def event_records(files: DataFrame) -> DataFrame:
    """Of (path, text): path, the record's columns, and why it was refused (null if it was not)."""
    names = [f.split()[0] for f in _RECORD.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, text in zip(batch["path"], batch["text"], strict=True):
                record, why = event_record(path, text or "")
                out.append((path, *((record or {}).get(k) for k in names), why))
            columns = ["path", *names, "why"]
            yield pd.DataFrame({c: pd.Series([r[k] for r in out], dtype=object) for k, c in enumerate(columns)})

    return files.select("path", "text").mapInPandas(run, f"path string, {_RECORD}, why string")


def briefing(name: str, text: str) -> dict | None:
    """A briefing file, ``<period>-briefing.json``, with its events; None if anything in it is of another form."""
    m = re.search(r"(\d{4}-(?:0[1-9]|1[0-2]|Q[1-4]))-briefing\.json$", name)
    try:
        data = json.loads(text)
    except ValueError:
        return None
    if not m or not isinstance(data, dict) or not isinstance(data.get("overview"), str) or not isinstance(data.get("events"), list):
        return None
    events = []
    for e in data["events"]:
        if not isinstance(e, dict) or not all(isinstance(e.get(k), str) and e[k].strip() for k in ("id", "name")):
            return None
        events.append({"member": f"{m[1]}/{e['id']}", "name": e["name"], "date": e.get("date") if isinstance(e.get("date"), str) else None})
    return {"period": m[1], "overview": data["overview"], "events": events}


def briefings(files: DataFrame) -> DataFrame:
    """Of (path, text): period, overview, events (member, name, date), newest period first; files of another form are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [b for p, t in zip(batch["path"], batch["text"], strict=True) if (b := briefing(p, t or ""))]
            yield pd.DataFrame({k: pd.Series([b[k] for b in found], dtype=object) for k in ("period", "overview", "events")})

    return files.select("path", "text").mapInPandas(run, "period string, overview string, events array<struct<member: string, name: string, date: string>>").orderBy(F.desc("period"))


def briefing_events(found: DataFrame, claims: DataFrame) -> DataFrame:
    """Events of briefings with the record that holds each: period, member, name, record (or null)."""
    each = found.select("period", F.inline("events"))
    return each.join(claims.select("member", "record"), "member", "left").select("period", "member", "name", "record")


def theme_list(text: str, longest: int = 300, cut: int = 2000) -> list[dict]:
    """Themes (name, id, definition) of a JSON list: names of at most ``longest`` characters, the first of each folded name, definitions cut."""
    data = json.loads(text)
    if not isinstance(data, dict) or not isinstance(data.get("themes"), list):
        raise ValueError("no list of themes")
    out: dict[str, dict] = {}
    for t in data["themes"]:
        if not isinstance(t, dict) or not isinstance(t.get("name"), str) or not 0 < len(t["name"].strip()) <= longest:
            raise ValueError("a theme without a usable name")
        out.setdefault(fold_text(t["name"]), {"name": t["name"].strip(), "id": t.get("id"), "definition": (t.get("definition") or "")[:cut]})
    return list(out.values())


def once_under_fold(rows: DataFrame, name: str, place: str) -> DataFrame:
    """The first row, by ``place``, of each folded name."""
    rest = [c for c in rows.columns if c != place]
    return rows.groupBy(fold(F.col(name)).alias("_v")).agg(F.min_by(F.struct(*rest), place).alias("r")).select("r.*")


# --- highlight archives ---

_META = re.compile(r"highlighted_at:\s*(?P<at>[^|]*?)\s*(?:\|\s*tags:\s*(?P<tags>[^|]*?)\s*)?(?:\|\s*color:\s*(?P<color>[^|]*?)\s*)?(?:\|\s*format:\s*(?P<format>[^|]*?)\s*)?$")


def highlights_of(text: str) -> list[dict]:
    """Records of an archive file: quoted lines, then a line with date, tags and colour; "---" lines part them.  Images and formulas have no text."""
    _, first, lines = front_matter(text)
    out, quote, start = [], [], None
    for n, line in enumerate([*lines, "---"], first):
        if line.startswith(">"):
            start = start or n
            quote.append(line[1:].removeprefix(" "))
        elif (m := _META.match(line.strip())) and quote:
            if (m["format"] or "text") not in ("image", "latex"):
                out.append({"line_start": start, "text": "\n".join(quote), "saved_at": m["at"] or None, "tags": [t.strip() for t in (m["tags"] or "").split(",") if t.strip()], "color": m["color"] or None})
            quote, start = [], None
        elif line.strip() == "---":
            quote, start = [], None
    return out


def highlights(files: DataFrame) -> DataFrame:
    """Of (path, text): path, line_start, text, saved_at, tags, color."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"path": p, **h} for p, t in zip(batch["path"], batch["text"], strict=True) for h in highlights_of(t or "")]
            yield pd.DataFrame({c: pd.Series([r[c] for r in rows], dtype=object) for c in ("path", "line_start", "text", "saved_at", "tags", "color")})

    return files.select("path", "text").mapInPandas(run, "path string, line_start int, text string, saved_at string, tags array<string>, color string")


def render_work(fields: dict[str, str | None], records: list[dict]) -> str:
    """The archive file of a work, which ``front_matter`` and ``highlights_of`` read back."""
    quoted = lambda v: v if re.fullmatch(r"[\w./:@-]+( [\w./@-]+)*", v) and not v.endswith(":") else '"' + v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'
    head = "\n".join(["---", *[f"{k}: {quoted(v)}" for k, v in fields.items() if v], "---"])
    parts = []
    for r in records:
        meta = [f"highlighted_at: {r.get('saved_at') or ''}"] + ([f"tags: {', '.join(r['tags'])}"] if r.get("tags") else []) + ([f"color: {r['color']}"] if r.get("color") else [])
        parts.append("\n".join("> " + line for line in r["text"].split("\n")) + "\n" + " | ".join(meta))
    return head + "\n\n" + "\n\n---\n\n".join(parts) + "\n"


def write_archive(works: DataFrame, folder: str) -> DataFrame:
    """Write one Markdown file a work below a folder that all executors share; (path, bytes) of each.  works: slug, title, author, records."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            out = []
            for w in batch.itertuples():
                records = [{"text": r["text"], "saved_at": r["saved_at"], "tags": list(r["tags"]), "color": r["color"]} for r in w.records]
                data = render_work({"title": w.title, "author": w.author}, records).encode()
                with open(f"{folder}/{w.slug}.md", "wb") as file:
                    file.write(data)
                out.append((f"{w.slug}.md", len(data)))
            yield pd.DataFrame(out, columns=["path", "bytes"])

    return works.mapInPandas(run, "path string, bytes long")
