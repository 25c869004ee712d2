"""Editors of append-only logs and event records.  The rules are sequential and the data small, so they run on the driver; a refusal changes nothing."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from dataclasses import dataclass, field, replace

from verbatlas.functions.text import fold_text

#: Bytes of a log line and of a whole log.
LINE_BYTES, LOG_BYTES = 4 << 20, 256 << 20


class Refused(ValueError):
    """An edit that the rules do not allow."""


def numbered(prefix: str, n: int) -> str:
    return f"{prefix}{n:06}"


class Log:
    """A JSON-lines file that only grows."""

    def __init__(self, path: str):
        self.path = path

    def read(self) -> list[dict]:
        if not os.path.exists(self.path):
            return []
        with open(self.path, encoding="utf-8") as file:
            return [json.loads(line) for line in file if line.strip()]

    def ready(self) -> int:
        """The length as it is now; a link, a folder, a file with several names, or a log without a last line end is refused."""
        if os.path.islink(self.path):
            raise Refused("the log is a link")
        if not os.path.exists(self.path):
            return 0
        state = os.stat(self.path)
        if not os.path.isfile(self.path) or state.st_nlink != 1:
            raise Refused("the log is no plain file")
        with open(self.path, "rb") as file:
            if state.st_size and (file.seek(-1, 2), file.read(1))[1] != b"\n":
                raise Refused("the last line is not whole")
        return state.st_size

    def append(self, line: dict, length: int | None = None) -> None:
        """Add a line; ``length`` is what ``ready`` gave when the log was read, and must still hold."""
        data = (json.dumps(line, ensure_ascii=False) + "\n").encode()
        now = self.ready()
        if length is not None and now != length:
            raise Refused("the log has changed")
        if len(data) > LINE_BYTES or now + len(data) > LOG_BYTES:
            raise Refused("the line or the log would be too long")
        with open(self.path, "ab") as file:
            file.write(data)
            file.flush()
            os.fsync(file.fileno())


def slug(text: str, most: int = 60) -> str:
    """Lower-case letters and digits with hyphens, marks taken off, cut at a hyphen."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
    out = re.sub(r"[^a-z0-9]+", "-", plain).strip("-")
    return out if len(out) <= most else (out[: most + 1].rsplit("-", 1)[0] if "-" in out[: most + 1] else out[:most])


def unique_id(base: str, taken: set[str]) -> str:
    """base, base-2, base-3, ...: the first that is free."""
    n, out = 1, base
    while out in taken:
        n += 1
        out = f"{base}-{n}"
    return out


@dataclass(frozen=True)
class Record:
    id: str
    name: str
    aliases: tuple[str, ...] = ()
    start: str | None = None
    end: str | None = None
    members: tuple[str, ...] = ()
    origin: str = "model"
    edited: str | None = None
    merged_into: str | None = None
    removed: str | None = None


@dataclass
class EventEditor:
    """Event records with their logs of merges and undone merges."""

    records: dict[str, Record]
    merges: list[dict] = field(default_factory=list)
    undone: list[dict] = field(default_factory=list)
    today: str = ""

    def _known(self, ident: str) -> Record:
        if ident not in self.records:
            raise Refused(f"no record {ident}")
        return self.records[ident]

    @staticmethod
    def _dates(start: str | None, end: str | None) -> None:
        for d in (start, end):
            if d is not None and not re.fullmatch(r"\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])", d):
                raise Refused(f"{d!r} is no date")
        if start and end and end < start:
            raise Refused("it would end before it starts")

    def set(self, ident: str, name: str | None = None, start: str | None = None, end: str | None = None, drop_aliases: tuple[str, ...] = (), add_aliases: tuple[str, ...] = ()) -> Record:
        """Change named fields; aliases go first, then come, under fold; the record is marked as edited."""
        r = self._known(ident)
        aliases = list(r.aliases)
        for a in drop_aliases:
            if not any(fold_text(x) == fold_text(a) for x in aliases):
                raise Refused(f"no alias {a}")
            aliases = [x for x in aliases if fold_text(x) != fold_text(a)]
        for a in add_aliases:
            if not any(fold_text(x) == fold_text(a) for x in aliases):
                aliases.append(a)
        new = replace(r, name=name or r.name, start=start or r.start, end=end or r.end, aliases=tuple(aliases), edited=self.today)
        self._dates(new.start, new.end)
        self.records[ident] = new
        return new

    def remove(self, ident: str) -> None:
        if self._known(ident).merged_into:
            raise Refused("a merged record is not removed")
        self.records[ident] = replace(self.records[ident], removed=self.today)

    def restore(self, ident: str) -> None:
        if not self._known(ident).removed:
            raise Refused("it is not removed")
        self.records[ident] = replace(self.records[ident], removed=None)

    def create(self, name: str, start: str | None, end: str | None = None, members: tuple[str, ...] = (), origin: str = "user") -> Record:
        """A record with an id of month and name."""
        self._dates(start, end)
        month = (start or self.today)[:7]
        ident = unique_id(f"{month}-{slug(name)}", set(self.records))
        self.records[ident] = Record(ident, name, (), start, end, members, origin)
        return self.records[ident]

    def in_effect(self, line: dict) -> bool:
        return line["id"] not in {u["merge"] for u in self.undone} and self.records.get(line["a"]) is not None and self.records[line["a"]].merged_into == line["b"]

    def merge(self, a: str, b: str, by: str = "user") -> dict:
        """a goes into b: a line, then the record."""
        x, y = self._known(a), self._known(b)
        if a == b or self.root(a) == self.root(b):
            raise Refused("they are one event already")
        if x.merged_into or y.merged_into:
            raise Refused("one of them is merged already")
        if x.removed or y.removed:
            raise Refused("one of them is removed")
        if by == "model" and (x.edited or y.edited):
            raise Refused("a model does not merge what was edited")
        if any(m["a"] == a and not self.in_effect(m) and m["id"] not in {u["merge"] for u in self.undone} for m in self.merges):
            raise Refused("a line of it was never applied")
        line = {"id": numbered("m", 1 + max((int(m["id"][1:]) for m in self.merges), default=0)), "a": a, "b": b, "by": by, "date": self.today}
        self.merges.append(line)
        self.records[a] = replace(x, merged_into=b)
        return line

    def unmerge_faults(self, ident: str) -> list[str]:
        """Members that two events would claim if the record were merged into nothing, and that one claims now; only its group's members are looked at."""
        split = EventEditor(self.records | {ident: replace(self._known(ident), merged_into=None)})
        group = {r for r in self.records if split.root(r) == ident}
        records = {fold_text(r) for r in self.records}
        members = {fold_text(m) for r in group for m in self.records[r].members} - records - {""}
        now: dict[str, set[str]] = {m: set() for m in members}
        then: dict[str, set[str]] = {m: set() for m in members}
        for r in self.records.values():
            for m in members.intersection(map(fold_text, r.members)):
                now[m].add(self.root(r.id))
                then[m].add(split.root(r.id))
        return [f"{m} would be claimed by {' and '.join(sorted(then[m]))}" for m in sorted(members) if len(then[m]) > 1 >= len(now[m])]

    def unmerge(self, ident: str) -> None:
        """Undo a merge line, unless two events would then claim a member; one that was never applied is withdrawn."""
        line = next((m for m in self.merges if m["id"] == ident), None)
        if line is None or ident in {u["merge"] for u in self.undone}:
            raise Refused("no such line to undo")
        if self.in_effect(line):
            if faults := self.unmerge_faults(line["a"]):
                raise Refused("; ".join(faults))
            self.records[line["a"]] = replace(self.records[line["a"]], merged_into=None)
        elif self._known(line["a"]).merged_into is not None:
            raise Refused("the record is merged into another one now")
        self.undone.append({"merge": ident, "date": self.today})

    def root(self, ident: str) -> str:
        """Where merges lead; a cycle or an unknown record ends at the record itself."""
        seen, at = {ident}, ident
        while (to := self.records[at].merged_into) and to in self.records:
            if to in seen:
                return ident
            seen.add(to)
            at = to
        return at

    def check(self) -> list[str]:
        """Lines that are not applied, records that are not as logged, and merges without a line."""
        gone = {u["merge"] for u in self.undone}
        live = [m for m in self.merges if m["id"] not in gone]
        out = [f"{m['id']}: not applied" for m in live if m["a"] in self.records and self.records[m["a"]].merged_into is None]
        out += [f"{m['id']}: {m['a']} is in {self.records[m['a']].merged_into}" for m in live if m["a"] in self.records and self.records[m["a"]].merged_into not in (None, m["b"])]
        logged = {(m["a"], m["b"]) for m in live}
        return out + [f"{r.id}: merged without a line" for r in self.records.values() if r.merged_into and (r.id, r.merged_into) not in logged]

    def apply_proposals(self, pairs: list[dict], items: dict[str, int], apply: bool) -> list[tuple[str, str, str]]:
        """Confident pairs of the same event, in order: (a, b, what happened); a dry run says the same and changes nothing.

        The one that starts earlier stays, then the one with more items, then the smaller id."""
        work = self if apply else EventEditor(dict(self.records), list(self.merges), list(self.undone), self.today)
        out = []
        for p in pairs:
            if p.get("verdict") != "same" or p.get("confidence") != "confident":
                continue
            a, b = p["a"], p["b"]
            if a not in work.records or b not in work.records:
                out.append((a, b, "no-record"))
                continue
            a, b = work.root(a), work.root(b)
            if a == b:
                out.append((p["a"], p["b"], "already-one-event"))
                continue
            stays, goes = sorted((a, b), key=lambda i: (work.records[i].start or "9999", -items.get(i, 0), i))
            try:
                work.merge(goes, stays, "model")
                out.append((p["a"], p["b"], f"{goes} into {stays}"))
            except Refused as why:
                out.append((p["a"], p["b"], "model-rule" if "model" in str(why) else "refused"))
        return out


@dataclass
class CorrectionEditor:
    """Corrections of tag rows as numbered lines.  A line is written only if it changes just the item and value that it names."""

    rows: dict[str, list[str]]
    log: list[dict] = field(default_factory=list)

    def state(self, log: list[dict] | None = None) -> dict[str, list[str]]:
        log = self.log if log is None else log
        gone = {u["undoes"] for u in log if u.get("undoes")}
        now = {k: list(v) for k, v in self.rows.items()}
        for line in log:
            if line.get("undoes") or line["id"] in gone or line["key"] not in now:
                continue
            own, value = now[line["key"]], fold_text(line["value"])
            rest = [x for x in own if fold_text(x) != value]
            now[line["key"]] = (own if len(rest) < len(own) else [*own, line["value"]]) if line["op"] == "add" else rest
        return now

    def _next(self) -> str:
        return numbered("c", 1 + max((int(x["id"][1:]) for x in self.log), default=0))

    def change(self, key: str, op: str, value: str) -> dict:
        """Add or remove a value of an item."""
        if key not in self.rows:
            raise Refused(f"no item {key}")
        line = {"id": self._next(), "key": key, "op": op, "value": value}
        before, after = self.state(), self.state([*self.log, line])
        if before[key] == after[key]:
            raise Refused("nothing would change")
        if any(before[k] != after[k] for k in before if k != key):
            raise Refused("other items would change")
        self.log.append(line)
        return line

    def undo(self, ident: str) -> dict:
        """Undo a correction: the last one of its item and value that is not undone."""
        gone = {u["undoes"] for u in self.log if u.get("undoes")}
        line = next((x for x in self.log if x["id"] == ident and not x.get("undoes")), None)
        if line is None or ident in gone:
            raise Refused("no such correction to undo")
        same = [x for x in self.log if not x.get("undoes") and x["id"] not in gone and x["key"] == line["key"] and fold_text(x["value"]) == fold_text(line["value"])]
        if same[-1]["id"] != ident:
            raise Refused("a later change of it comes first")
        self.log.append({"id": self._next(), "key": line["key"], "undoes": ident})
        return self.log[-1]


@dataclass
class Registry:
    """Registered corpora by id."""

    corpora: dict[str, dict] = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str) -> Registry:
        import tomllib

        out = cls()
        for c in tomllib.loads(text).get("corpus", []):
            out.add(c["id"], **{k: v for k, v in c.items() if k != "id"})
        return out

    def add(self, ident: str, **config) -> None:
        if not re.fullmatch(r"[A-Za-z0-9_-]+", ident) or ident in self.corpora:
            raise Refused(f"{ident!r} is no new id")
        if config.get("kind", "markdown-folder") not in ("markdown-folder", "highlight-archive") or not config.get("path"):
            raise Refused("a corpus needs a known kind and a path")
        self.corpora[ident] = {"kind": "markdown-folder", "name": ident, **config}

    def remove(self, ident: str) -> None:
        if self.corpora.pop(ident, None) is None:
            raise Refused(f"no corpus {ident}")

    def render(self) -> str:
        value = lambda v: json.dumps(v, ensure_ascii=False)
        return "\n".join("[[corpus]]\n" + "\n".join(f"{k} = {value(v)}" for k, v in {"id": i, **c}.items()) + "\n" for i, c in self.corpora.items())


#: Kinds of captured files, and who captures.
CAPTURE_KINDS, CAPTURE_BY = ("note", "article", "report", "transcript", "data", "other"), ("user", "agent", "script", "import")


def capture(folder: str, kind: str, by: str, title: str, text: str, today: str) -> dict:
    """Write a captured text and its receipt (a line of _manifest.jsonl) below a folder; a taken name is refused."""
    if kind not in CAPTURE_KINDS or by not in CAPTURE_BY or not slug(title):
        raise Refused("unknown kind, unknown hand or empty title")
    name = f"{today}-{slug(title)}.md"
    path = os.path.join(folder, name)
    log = Log(os.path.join(folder, "_manifest.jsonl"))
    length = log.ready()
    receipt = {"file": name, "kind": kind, "by": by, "title": title, "date": today}
    with open(path, "x", encoding="utf-8") as file:
        file.write(f"---\ntitle: {json.dumps(title, ensure_ascii=False)}\ndate: {today}\nkind: {kind}\n---\n\n{text}\n")
    log.append(receipt, length)
    return receipt


def captured(folder: str, moved: dict[str, str] | None = None) -> list[dict]:
    """Receipts, newest last, with where a moved file is now."""
    moved = moved or {}
    return [{**r, "file": moved.get(r["file"], r["file"])} for r in Log(os.path.join(folder, "_manifest.jsonl")).read()]
