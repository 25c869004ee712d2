"""Secret scans with structural confirmation.

Three base rules find assignments, access-key ids and long hex runs.  The method
adds candidates that are confirmed by structure before they are reported:

* ``jwt``: three base64url parts, whose first decodes to a JSON object with "alg" and
  whose second decodes to a JSON object
* ``pem``: an armoured key block whose body decodes to a well-formed key, or is
  encrypted as its headers say
* ``der``: a base64 or hex run, also one wrapped over lines of any one width, that decodes to ASN.1 with
  exact nested lengths in the shape of a key
* ``ssh``: such a run that decodes to the length-prefixed fields of an SSH key

Line ends may be written as in JSON (a backslash and n), and lines may be indented.
Public keys, which are no secrets by themselves, are reported too and marked ``public``.

Random or prose runs fail these checks and are not reported.  Confirmed spans come
beside the base spans, which all stay.  The time for a text is in proportion to its length: a run is decoded
once for each of its four alignments, and a candidate's check reads a bounded number of length fields.

Defined results: a null text is an empty one (no spans, the digest of nothing);
offsets count code points and the end is exclusive; texts of any length are
scanned whole; repeated rows give repeated rows; an empty table gives no rows;
other columns are left out of the result, so their names cannot clash.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "pem", "jwt", "der", "ssh")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
JWT = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)", re.ASCII)
#: Where a token's header may begin inside a run, and what its first bytes look like.
INNER_TOKEN = re.compile(r"(?:(?<=[_-])|(?<=\\[nrt]))e[w-z0-9_-]")
OBJECT = re.compile(rb"\s*\{\s*\"[\w.#:-]{1,32}\"\s*:")
BEGIN = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ ){0,8}(?:PRIVATE|PUBLIC) KEY)-----")
#: A line's end, also as JSON writes it.
BREAK = re.compile(r"\r?\n|\\+r\\+n|\\+[nr]|\r")
HEADER = re.compile(r"[A-Za-z][A-Za-z-]*: ")
CIPHER = re.compile(r"DEK-Info: [A-Z0-9-]+,(?:[0-9A-Fa-f]{2}){8,}$")
RUN = re.compile(r"[A-Za-z0-9+/_-]{40,}")
PAD = re.compile("={0,2}")
#: First characters of a DER sequence, a key blob and an OpenSSH private key, after a sign that is no letter or digit, or an escape of JSON.
FIRST = re.compile(r"(?:(?<![A-Za-z0-9])|(?<=\\[nrt]))(?:M[A-P]|AAAA|b3BlbnNzaC1rZXktdjE)")
#: The first line of wrapped base64 that may be a key.
WRAPPED = re.compile(r"(?:(?<![A-Za-z0-9+/=])|(?<=\\[nrt]))(?:M[A-P]|AAAA|b3Bl)[A-Za-z0-9+/]{12,}+[ \t]*+(?:\r?\n|\\+[nr])")
LINE = re.compile(r"[ \t]*+([A-Za-z0-9+/]++)(={0,2})[ \t]*+(?=(\r?\n|\\+r\\+n|\\+[nr])?)")
HEXRUN = re.compile(r"[0-9a-f]{40,}|[0-9A-F]{40,}")
#: The same first bytes in hex, wherever they stand.
HEXFIRST = re.compile(r"(?=30[0-9a-fA-F]{2}|000000[0-9a-fA-F]{2}(?:737368|656364|736b2d)|6[fF]70656[eE]7373682[dD]6[bB]6579)")
#: Most elements of a DER key and fields of an SSH key that are read.
MOST_NODES, MOST_FIELDS = 256, 32
#: Most characters of a token's header that begins inside a run.
INNER_HEADER = 4096

TO_STANDARD = str.maketrans("-_", "+/")


def unbase64(run: str) -> bytes | None:
    """Bytes of a standard or URL-safe base64 run, padded or not; None if it is no base64."""
    body = run.strip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return None


def der_nodes(data: bytes, start: int, end: int, depth: int = 0, left: list[int] | None = None) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the elements that fill data[start:end] exactly, or None; definite lengths only, MOST_NODES at most."""
    found, at = [], start
    left = [MOST_NODES] if left is None else left
    while at < end:
        left[0] -= 1
        if left[0] < 0 or end - at < 2 or data[at] & 0x1F == 0x1F:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size >= 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
            if size < 0x80:  # not the shortest form
                return None
        if at + size > end:
            return None
        if tag & 0x20 and (depth > 8 or der_nodes(data, at, at + size, depth + 1, left) is None):
            return None
        found.append((tag, at, at + size))
        at += size
    return found


def is_der_key(data: bytes | None) -> bool:
    """Is this one ASN.1 sequence, filled exactly, in the shape of a key?

    Shapes: version and at least eight integers (RSA), version, algorithm and octets
    (PKCS#8), version and octets (EC), algorithm and octets (encrypted), and
    algorithm and bits (public key)."""
    if not data or len(data) < 24 or data[0] != 0x30:
        return False
    top = der_nodes(data, 0, len(data))
    if top is None or len(top) != 1:
        return False
    inner = der_nodes(data, top[0][1], top[0][2]) or []
    tags = [t for t, _, _ in inner]

    def algorithm(k: int) -> bool:
        first = der_nodes(data, inner[k][1], inner[k][2]) or []
        return bool(first) and first[0][0] == 0x06

    if tags[:1] == [0x02]:
        version = data[inner[0][1] : inner[0][2]]
        if len(version) != 1 or version[0] > 3:
            return False
        return len(tags) >= 9 and set(tags[:9]) == {0x02} or tags[1:3] == [0x30, 0x04] and algorithm(1) or tags[1:2] == [0x04] and inner[1][2] - inner[1][1] >= 16
    return tags in ([0x30, 0x04], [0x30, 0x03]) and algorithm(0)


def is_ssh_key(data: bytes | None) -> bool:
    """Is this an OpenSSH private key or a public key blob of exact length-prefixed fields?"""
    if not data:
        return False
    magic = b"openssh-key-v1\0"
    at, fields = (len(magic), 3) if data.startswith(magic) else (0, 99)
    seen: list[bytes] = []
    while at < len(data) and len(seen) < fields:
        if at + 4 > len(data) or len(seen) > MOST_FIELDS:
            return False
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return False
        seen.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    if fields == 3:
        return len(seen) == 3 and seen[0].isascii() and at + 4 <= len(data)
    return at == len(data) and len(seen) >= 2 and re.match(rb"(ssh|ecdsa|sk-ssh|sk-ecdsa)-[a-z0-9@.-]+$", seen[0]) is not None


def key_kind(data: bytes | None) -> str | None:
    """"der" or "ssh" of a key, else None."""
    return "der" if is_der_key(data) else "ssh" if is_ssh_key(data) else None


def is_public(data: bytes | None) -> bool:
    """Does a key have its public half alone?"""
    if not is_der_key(data):
        return is_ssh_key(data) and not data.startswith(b"openssh-key-v1\0")
    top = der_nodes(data, 0, len(data))
    return [t for t, _, _ in der_nodes(data, top[0][1], top[0][2])] == [0x30, 0x03]


def public_span(text: str) -> bool:
    """Is what a confirmed span of a key holds a public key?"""
    if text.startswith("-----BEGIN "):
        return any(is_public(data) for _, _, data, _ in armoured_blocks(text))
    body = "".join(x.strip(" \t") for x in BREAK.split(text))
    return is_public(bytes.fromhex(body)) if re.fullmatch("(?:[0-9a-fA-F]{2})+", body) else is_public(unbase64(body))


def armoured_blocks(text: str) -> Iterator[tuple[int, int, bytes | None, list[str]]]:
    """(start, end, decoded body, headers) of the armoured blocks.

    A block ends at the next dashes, which must be its END line, so no text is read twice.  Each line is classified once:
    headers and their continuations, which are indented more, come before the first line of base64, and after it there is nothing else."""
    for m in BEGIN.finditer(text):
        end = text.find("-----", m.end())
        last = f"-----END {m[1]}-----"
        if end < 0 or not text.startswith(last, end):
            continue
        headers, body, depth = [], [], 0
        for line in BREAK.split(re.sub(r"\\+(?=/)", "", text[m.end() : end])):
            bare = "".join(line.split())
            if not bare:
                continue
            inside = len(line) - len(line.lstrip())
            if not body and HEADER.match(line, inside):
                headers.append(line.strip())
                depth = inside
            elif not body and headers and inside > depth:
                headers[-1] += " " + line.strip()
            else:
                body.append(bare)
        yield m.start(), end + len(last), unbase64("".join(body)), headers


def _chars(n: int) -> int:
    """Characters of n bytes in base64 without padding."""
    return -(-n * 4 // 3)


class Aligned:
    """A run of base64 decoded from each of its first four characters on, when it is asked for."""

    def __init__(self, run: str):
        self.run, self.made = run.translate(TO_STANDARD), {}

    def bytes_at(self, start: int) -> tuple[bytes, int]:
        """Decoded bytes, and where in them the character ``start`` begins."""
        shift = start % 4
        if shift not in self.made:
            body = self.run[shift:]
            body = body[: len(body) - (len(body) % 4 == 1)]
            self.made[shift] = base64.b64decode(body + "=" * (-len(body) % 4))
        return self.made[shift], start // 4 * 3


def key_sizes(data: bytes, at: int) -> Iterator[int]:
    """How many bytes a key that begins at ``at`` may have, by its own lengths; -1: as many as there are (an OpenSSH private key)."""
    head = data[at : at + 8]
    if head[:1] == b"\x30" and len(head) > 1:
        n = head[1] & 0x7F if head[1] >= 0x80 else 0
        if n <= 4:
            yield 2 + n + (int.from_bytes(head[2 : 2 + n], "big") if n else head[1])
    elif head.startswith(b"openssh"):
        yield -1
    elif head[:3] == b"\0\0\0" and head[4:].startswith((b"ssh-", b"ecds", b"sk-s", b"sk-e")):
        here, ends = at, []
        while here + 4 <= len(data) and len(ends) <= MOST_FIELDS and (here := here + 4 + int.from_bytes(data[here : here + 4], "big")) <= len(data):
            ends.append(here - at)
        yield from reversed(ends[1:])


def keys_in(run: str, starts: Iterator[int], whole) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of the keys in a run of base64 without padding that begin at ``starts``; ``whole(start, end)``: can one end there?

    Both alphabets are read, but one key has only one of them."""
    aligned, done = Aligned(run), 0
    signs = [[m.start() for m in re.finditer(x, run)] for x in ("[-_]", "[+/]")]

    def stretch(start: int) -> list[int]:
        """Where the text stops to be in each of the alphabets."""
        return [s[k] if (k := bisect_left(s, start)) < len(s) else len(run) for s in signs]

    for start in starts:
        if start < done:
            continue
        data, at = aligned.bytes_at(start)
        for size in key_sizes(data, at):
            one = stretch(start)
            ends = sorted(set(one), reverse=True) if size < 0 else [start + _chars(size)]
            found = False
            for end in ends:
                if end - start < 40 or end > max(one) or not whole(start, end):
                    continue
                own = data[at : at + (size if size >= 0 else (end - start) * 3 // 4)]
                if kind := key_kind(own):
                    done, found = end, True
                    yield start, end, kind
                    break
            if found:
                break


def key_runs(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of the base64 keys: each run is tried from its start and after every sign in it."""
    for m in RUN.finditer(text):
        first = FIRST.search(text, m.start(), m.end())
        if first is None:
            continue
        run, base = m[0], m.start()
        starts = (x.start() - base for x in FIRST.finditer(text, first.start(), m.end()))
        for start, end, kind in keys_in(run, starts, lambda start, end, run=run: end == len(run) or run[end] in "+/-_"):
            yield base + start, PAD.match(text, base + end).end(), kind


def wrapped_runs(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of the keys in base64 that is wrapped into lines of one width, the last of them shorter; lines may be indented."""
    done = 0
    for m in WRAPPED.finditer(text):
        if m.start() < done:
            continue
        lines, at = [], m.start()
        while line := LINE.match(text, at):
            if lines and (len(line[1]) > len(lines[0][1]) or lines[-1][2]):
                break
            lines.append(line)
            if len(line[1]) < len(lines[0][1]) or line[3] is None:
                break
            at = line.end() + len(line[3])
        done = lines[-1].end()
        ends = [0]
        for line in lines:
            ends.append(ends[-1] + len(line[1]))
        run = "".join(line[1] for line in lines)
        starts = (e for e, line in zip(ends, lines, strict=False) if FIRST.match(line[1]))
        last = set(ends)
        for start, end, kind in keys_in(run, starts, lambda start, end, last=last: end in last):
            a, b = bisect_left(ends, start), bisect_left(ends, end) - 1
            if b > a:  # one line is no wrapped run
                yield lines[a].start(1), lines[b].end(2), kind


def hex_runs(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of the keys in hex, at either alignment of a run."""
    for m in HEXRUN.finditer(text):
        run, made, done = m[0], {}, 0
        for first in HEXFIRST.finditer(run):
            start = first.start()
            if start < done:
                continue
            shift = start % 2
            if shift not in made:
                made[shift] = bytes.fromhex(run[shift : len(run) - (len(run) - shift) % 2])
            data, at = made[shift], start // 2
            for size in key_sizes(data, at):
                own = data[at : at + size] if size >= 0 else data[at:]
                if len(own) >= 20 and (size < 0 or len(own) == size) and (kind := key_kind(own)):
                    done = start + 2 * len(own)
                    yield m.start() + start, m.start() + done, kind
                    break


def json_object(part: str) -> dict | None:
    """The JSON object that a base64 part decodes to, or None."""
    data = unbase64(part)
    if not data or not data.lstrip().startswith(b"{"):
        return None
    try:
        found = json.loads(data)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def is_token_header(part: str) -> bool:
    """Does a signed token's first part decode to a JSON object with an "alg" string?"""
    return isinstance((json_object(part) or {}).get("alg"), str)


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The base rules: leftmost non-overlapping matches of each kind, failing matches dropped."""
    return {
        "assign": [m.span() for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12],
        "access": [m.span() for m in ACCESS.finditer(text)] if "AKIA" in text else [],
        "hex": [m.span() for m in HEX.finditer(text)],
    }


def confirmed_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The method's own spans; every one has passed its structural check."""
    found: dict[str, list[tuple[int, int]]] = {}
    armoured: list[tuple[int, int]] = []
    if "-----BEGIN " in text:
        for start, end, data, headers in armoured_blocks(text):
            if key_kind(data) or data and len(data) % 8 == 0 and any(CIPHER.match(h) for h in headers):
                armoured.append((start, end))
        if armoured:
            found["pem"] = list(armoured)
    if "ey" in text or "ew" in text:
        at, found["jwt"] = 0, []
        while m := JWT.search(text, at):
            starts = [m.start(1)] + [x.start() for x in INNER_TOKEN.finditer(text, max(m.start(1), m.end(1) - INNER_HEADER), m.end(1))]
            starts = [x for x in starts if text[x] == "e" and OBJECT.match(unbase64(text[x : min(x + 64, m.end(1) - (m.end(1) - x) % 4)]) or b"")]
            first = next((x for x in starts if is_token_header(text[x : m.end(1)])), None)
            good = first is not None and json_object(m[2]) is not None
            if good:
                found["jwt"].append((first, m.end()))
            at = m.end() if good else m.start(2)  # a token may begin at the second part
    runs = [*key_runs(text), *wrapped_runs(text), *hex_runs(text)]
    begins = [a for a, _ in armoured]
    for start, end, kind in runs:
        k = bisect_right(begins, start) - 1
        if k < 0 or armoured[k][1] < end:
            found.setdefault(kind, []).append((start, end))
    return found


def listed(spans: dict[str, list[tuple[int, int]]]) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed, then end."""
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(((s, e, k) for k, own in spans.items() for s, e in own), key=lambda x: (x[0], order[x[2]], x[1]))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, secrets) with secrets an array of (kind, start, end, confirmed, public) in listed order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("confirmed", pa.bool_()), ("public", pa.bool_())]))
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py() or ""
                base, own = base_spans(text), confirmed_spans(text)
                rows.append([{"kind": k, "start": s, "end": e, "confirmed": k in own, "public": k in ("pem", "der", "ssh") and public_span(text[s:e])} for s, e, k in listed({**base, **own})])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc_id", "secrets"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, secrets array<struct<kind: string, start: long, end: long, confirmed: boolean, public: boolean>>"
    )


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns, derived from the spans of ``scan``."""
    base = F.filter("secrets", lambda x: x["kind"].isin("assign", "access", "hex"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(docs).select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
        F.size(F.filter("secrets", lambda x: x["confirmed"])).cast("long").alias("n_confirmed"),
        F.size(F.filter("secrets", lambda x: x["public"])).cast("long").alias("n_public"),
    )
