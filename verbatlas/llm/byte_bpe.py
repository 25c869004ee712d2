"""Byte-level BPE by prefix dynamic programming.

For a byte-level BPE vocabulary every prefix of a piece has exactly one valid
last token.  ``PrefixCoder.table`` stores that token for every prefix: the
encoding is read by walking back from the end, a longer text needs only the new
entries, and an edit needs only the entries behind it.  The candidates that end at
a byte come from an automaton over the vocabulary.  Whether two tokens may stand
side by side is decided by replaying the merges along the border: the parts of the
left token that end there and those of the right token that begin there grow in
rank order, and a merge across the border must not come first.  That replay is
exact for vocabularies in which every part has a lower rank than what it becomes
(``regular``, which is tested for each vocabulary); for others the joined bytes
are merged by the rule itself.

The ids equal those of the public rank-file encoders: a piece that is itself in
the vocabulary is one id, any other piece is merged lowest rank first, and every
match of the split pattern is encoded by itself.

Defined results: a null text encodes like an empty one (no ids, no bytes); lone
surrogates cannot occur in Spark strings; repeated rows give repeated rows; an
empty table gives an empty table; all other columns, whatever their names, pass
through ``encode`` unless they are named like the output column, which replaces
them.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verbatlas.llm.common import trim

#: Most pieces, and most token pairs, that a worker remembers between batches of a task.
REMEMBERED, PAIRS = 360_000, 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a rank file (base64, blank, rank per line)."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


class TokenBytes:
    """The bytes of each id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self._tokens: pa.Array | None = None

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode_lists(self, ids: pa.ListArray) -> pa.Array:
        """The bytes of every list of ids: one gather of token bytes, whose buffer is then cut at the lists' borders."""
        if self._tokens is None:
            self._tokens = pa.array([self.bytes_of.get(i) for i in range(max(self.bytes_of, default=-1) + 1)], pa.large_binary())
        starts = np.concatenate([[0], np.cumsum(np.array(pc.fill_null(pc.list_value_length(ids), 0)))])
        taken = self._tokens.take(ids.flatten())
        if taken.null_count:
            raise ValueError("an id is not in the vocabulary")
        borders = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1]
        cuts = borders[starts] if len(taken) else np.zeros(len(starts), np.int64)
        data = taken.buffers()[2] if len(taken) else pa.py_buffer(b"")
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(cuts.tobytes()), data]).cast(pa.binary())


def merged(ranks: dict[bytes, int], data: bytes, stop: int = 1) -> list[int]:
    """The merge rule on a few bytes: join the leftmost pair of lowest rank until none or ``stop`` parts are left."""
    get = ranks.get
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > stop:
        rank, at = min([(get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)])
        if rank == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def last_merges(ranks: dict[bytes, int]) -> dict[int, tuple[int, int] | None]:
    """Of each token that the merge rule makes from its bytes: the two parts that it is made of in the end; None for a byte."""
    found: dict[int, tuple[int, int] | None] = {}
    for token, rank in ranks.items():
        parts = merged(ranks, token, 2)
        if len(parts) <= 2:
            found[rank] = (parts[0], parts[1]) if len(parts) == 2 else None
    return found


class PrefixCoder(TokenBytes):
    """Encoder and decoder over one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED, pairs: int = PAIRS, parts: dict[int, tuple[int, int] | None] | None = None):
        super().__init__(ranks)
        self._remembered, self._pairs = remembered, pairs
        self.split = regex.compile(pattern)
        self._pieces: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._beside: dict[int, bool] = {}
        self._heads: dict[int, tuple] = {}
        self._tails: dict[int, tuple] = {}
        self._parts = last_merges(ranks) if parts is None else parts
        self._sizes = {rank: len(self.bytes_of[rank]) for rank in self._parts}
        if max(self._sizes, default=0) >= 1 << 20:
            raise ValueError("ranks must be below 2**20")
        self.regular = all(p is None or max(p) < rank for rank, p in self._parts.items())
        self._ends = ahocorasick.Automaton()
        for rank, size in self._sizes.items():
            self._ends.add_word(self.bytes_of[rank].decode("latin-1"), (size, rank))
        self._ends.make_automaton()

    def _grown(self, token: int, side: int, kept: dict[int, tuple]) -> tuple:
        """The token and its parts at one side (0 its beginning, 1 its end), smallest first, as (bytes, rank of the next larger)."""
        if (known := kept.get(token)) is None:
            chain = [token]
            while (parts := self._parts[chain[-1]]) is not None:
                chain.append(parts[side])
            nexts = [*chain[-2::-1], 1 << 60]
            known = kept[token] = tuple((self.bytes_of[t], n) for t, n in zip(chain[::-1], nexts, strict=True))
        return known

    def _may_follow(self, left: int, right: int) -> bool:
        if not self.regular:
            return merged(self.ranks, self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        ends, begins, get = self._grown(left, 1, self._tails), self._grown(right, 0, self._heads), self.ranks.get
        i = j = 0
        while True:
            (a, grows_a), (b, grows_b) = ends[i], begins[j]
            across = get(a + b, 1 << 60)
            # of merges of one rank the leftmost comes first
            if across < grows_a and across <= grows_b and across != 1 << 60:
                return False
            if grows_a == grows_b == 1 << 60:
                return True
            if grows_a <= grows_b:
                i += 1
            else:
                j += 1

    def _beside_each_other(self, left: int, right: int) -> bool:
        """``_may_follow``, remembered."""
        if len(self._beside) >= self._pairs:
            self._beside.clear()
        ok = self._beside[left << 20 | right] = self._may_follow(left, right)
        return ok

    def table(self, data: bytes, known: list[int] | None = None) -> list[int]:
        """The valid last token of every prefix of ``data``; ``known`` holds the first entries if they are there."""
        last = list(known or [])
        done, seen = len(last), self._beside.get
        for at, (size, token) in self._ends.iter(data.decode("latin-1")):  # ends in order
            if at != done:
                if at < done:
                    continue
                break  # a prefix without a valid token: found below
            if size <= at:
                left = last[at - size]
                ok = seen(left << 20 | token)
                if ok is None:
                    ok = self._beside_each_other(left, token)
                if not ok:
                    continue
            last.append(token)
            done += 1
        if done < len(data):
            raise ValueError(f"no token of the vocabulary ends at byte {done + 1}; a byte is missing from it")
        return last

    def walk(self, data: bytes, last: list[int]) -> tuple[int, ...]:
        """The encoding of ``data``, read backwards from its prefix table."""
        ids, end, sizes = [], len(data), self._sizes
        while end:
            ids.append(token := last[end - 1])
            end -= sizes[token]
        return tuple(ids[::-1])

    def piece(self, text: str) -> bytes:
        """Ids of one match of the pattern, four bytes each, remembered in two generations of bounded size."""
        ids = self._pieces.get(text)
        if ids is None:
            ids = self._older.get(text)
            if ids is None:
                data = text.encode()
                whole = self.ranks.get(data)
                ids = array("i", (whole,) if whole is not None else self.walk(data, self.table(data))).tobytes()
            if len(text) <= 64:
                if len(self._pieces) >= self._remembered // 2:
                    self._older, self._pieces = self._pieces, {}
                self._pieces[text] = ids
        return ids

    def packed(self, text: str) -> bytes:
        """The ids of a text, four bytes each in the machine's order."""
        known, piece = self._pieces.get, self.piece
        return b"".join([known(p) or piece(p) for p in self.split.findall(text)])

    def encode(self, text: str) -> list[int]:
        return array("i", self.packed(text)).tolist()


class LiveText:
    """A text with its prefix tables, for appends and edits that re-encode only what they touch.

    A change can move piece borders from two pieces before it on (an apostrophe and a letter
    before the end may become one contraction), and up to the first old border that the new
    pieces meet again.
    """

    def __init__(self, coder: PrefixCoder, text: str = ""):
        self.coder, self.pieces, self.tables = coder, [], []
        self.reencoded = 0
        self.replace(0, 0, text)

    @property
    def text(self) -> str:
        return "".join(self.pieces)

    def ids(self) -> list[int]:
        out: list[int] = []
        for piece, last in zip(self.pieces, self.tables, strict=True):
            data = piece.encode()
            whole = self.coder.ranks.get(data)
            out.extend((whole,) if whole is not None else self.coder.walk(data, last))
        return out

    def append(self, more: str) -> None:
        n = sum(map(len, self.pieces))
        self.replace(n, n, more)

    def replace(self, start: int, end: int, new: str) -> None:
        """Put ``new`` in the place of code points start to end."""
        borders = [0]
        for p in self.pieces:
            borders.append(borders[-1] + len(p))
        first = max(0, next((i for i, b in enumerate(borders) if b > start), len(self.pieces)) - 3)
        old = self.text
        text, shift = old[:start] + new + old[end:], len(new) - (end - start)
        again = {b + shift: i for i, b in enumerate(borders) if b >= end}
        made, at, rest = [], borders[first], len(self.pieces)
        for m in self.coder.split.finditer(text, at):
            if m.start() >= start + len(new) and m.start() in again:
                rest = again[m.start()]
                break
            made.append(m.group())
        tables = []
        for k, p in enumerate(made):
            data, known = p.encode(), []
            if first + k < len(self.pieces):  # the table of a common beginning stays
                before = self.pieces[first + k].encode()
                same = next((i for i, (a, b) in enumerate(zip(before, data, strict=False)) if a != b), min(len(before), len(data)))
                known = self.tables[first + k][:same]
            self.reencoded += len(data) - len(known)
            tables.append(self.coder.table(data, known))
        self.pieces[first:rest], self.tables[first:rest] = made, tables


def share_ranks(spark: SparkSession, path: str):
    """Broadcast a rank file; a vocabulary has a fixed size (a few MB), whatever the data's size."""
    ranks = read_ranks(path)
    if sum(map(len, ranks)) > 64 << 20:
        raise ValueError("the vocabulary is too large to broadcast")
    return spark.sparkContext.broadcast(ranks)


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None, remembered: int = REMEMBERED, pairs: int = PAIRS) -> DataFrame:
    """``docs`` with the token ids of its whole texts in ``ids_col`` (array of int).

    With ``decoded_col``, the ids are decoded again in the same pass, so that a task needs one Python worker only.
    ``remembered`` and ``pairs`` trade a worker's memory for time; the ids do not depend on them."""
    shared = share_ranks(docs.sparkSession, path)
    parts = docs.sparkSession.sparkContext.broadcast(last_merges(shared.value))  # an entry a token at most, found once and not in each task
    docs = docs.drop(ids_col)
    docs = docs.drop(decoded_col) if decoded_col else docs
    fields = [T.StructField(ids_col, T.ArrayType(T.IntegerType(), False), False)] + ([T.StructField(decoded_col, T.BinaryType(), False)] if decoded_col else [])
    schema = T.StructType([*docs.schema.fields, *fields])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PrefixCoder(shared.value, pattern, remembered, pairs, parts.value)
        for batch in batches:
            values = [coder.packed(text.as_py() or "") for text in batch.column(at)]
            offsets = np.cumsum([0, *map(len, values)]) // 4
            flat = pa.array(np.frombuffer(b"".join(values), np.int32))
            ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), flat)
            more = [ids, coder.decode_lists(ids)] if decoded_col else [ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *(f.name for f in fields)])
        del coder  # an idle worker holds no pieces
        trim()

    return docs.mapInArrow(run, schema)


def decode(coded: DataFrame, path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``coded`` with the bytes of its ids in ``out_col``; null ids decode to no bytes."""
    shared = share_ranks(coded.sparkSession, path)
    coded = coded.drop(out_col)
    schema = T.StructType([*coded.schema.fields, T.StructField(out_col, T.BinaryType(), False)])
    at = coded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = TokenBytes(shared.value)
        for batch in batches:
            out = tokens.decode_lists(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, out_col])

    return coded.mapInArrow(run, schema)


def digest(docs: DataFrame, path: str, pattern: str, remembered: int = REMEMBERED, pairs: int = PAIRS) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256, from a full encode and decode."""
    return encode(docs.select("doc_id", "text"), path, pattern, decoded_col="decoded", remembered=remembered, pairs=pairs).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
