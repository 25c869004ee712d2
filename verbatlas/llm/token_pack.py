"""Token-id packing: best-fit-decreasing rows of one length, as binary id matrices.

Each task turns its documents into token ids, cuts documents longer than a row into
parts without loss, and packs shards of a bounded number of tokens: parts go by
falling size into the row with the least room that still fits, found in a segment
tree over room sizes.  No row is shuffled, so neither a hot source nor a group of
copies makes a task larger, and a lost task is simply packed again.

A packed row has the ids of its segments one after another and then padding,
``cu_seqlens`` (cumulative segment lengths from 0), and position ids that start
again from 0 in each segment (at the offset of the part in its document if
``resume`` is set, so that the parts of one document count on).

Defined results: a null text is an empty one; a document without tokens has one
segment of length 0, so no document is lost; repeated rows are packed as they come;
null ids are kept as null; an empty table gives no rows; other columns are left
out, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbatlas.llm.byte_bpe import share_ranks


class RoomTree:
    """Open rows by room left; ``take(size)`` finds one with the least room of at least ``size``."""

    def __init__(self, capacity: int):
        self.leaves = 1 << max(1, capacity).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: dict[int, list[int]] = {}

    def put(self, room: int, row: int) -> None:
        self.rows.setdefault(room, []).append(row)
        at = room + self.leaves
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(row, its room), removed from the tree, or None if nothing fits."""
        at, count = size + self.leaves, self.count
        while not count[at]:  # up to the first subtree to the right that has a row
            while at & 1:
                at >>= 1
            if at <= 1:
                return None
            at += 1
        while at < self.leaves:
            at *= 2
            if not count[at]:
                at += 1
        room = at - self.leaves
        while at:
            count[at] -= 1
            at >>= 1
        return self.rows[room].pop(), room


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices of the sizes (each at most ``capacity``) by row; ties go by index, so the result is one for each input."""
    tree, rows = RoomTree(capacity), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.take(sizes[i])
        row, room = found or (len(rows), capacity)
        if not found:
            rows.append([])
        rows[row].append(i)
        tree.put(room - sizes[i], row)
    return rows


def pack(docs: DataFrame, path: str, pattern: str, capacity: int = 2048, shard_tokens: int = 2_000_000, pad: int | None = None, resume: bool = False) -> DataFrame:
    """Packed rows: shard, row, n_tokens, ids and positions (little-endian, of ``width`` bytes), cu_seqlens, doc_ids, parts.

    ``pad`` fills the rows up; if none is named, it is the first number that is no id of the vocabulary."""
    if not 1 <= capacity <= 1 << 20:
        raise ValueError("capacity must be between 1 and 2**20")
    shared = share_ranks(docs.sparkSession, path)
    pad = max(shared.value.values(), default=-1) + 1 if pad is None else pad
    width = 2 if max(pad, *shared.value.values()) < 1 << 16 and capacity <= 1 << 16 and not resume else 4
    kind = np.dtype(f"<u{width}")

    def rows_of(shard: str, parts: list[tuple[int | None, int, np.ndarray]]) -> pa.RecordBatch:
        packed = best_fit_decreasing([len(p[2]) for p in parts], capacity)
        out: dict[str, list] = {k: [] for k in ("n_tokens", "ids", "positions", "cu_seqlens", "doc_ids", "parts")}
        for own in packed:
            segments = [parts[i] for i in own]
            ids, places = np.full(capacity, pad, kind), np.zeros(capacity, kind)
            ends = [0]
            for _, part, seg in segments:
                at = ends[-1]
                ids[at : at + len(seg)] = seg
                first = part * capacity if resume else 0
                places[at : at + len(seg)] = np.arange(first, first + len(seg))
                ends.append(at + len(seg))
            for k, v in zip(out, (ends[-1], ids.tobytes(), places.tobytes(), ends, [s[0] for s in segments], [s[1] for s in segments]), strict=True):
                out[k].append(v)
        types = (pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()))
        arrays = [pa.array(v, t) for v, t in zip(out.values(), types, strict=True)]
        n = len(packed)
        return pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.string()), pa.array(range(n), pa.int32()), *arrays, pa.array([width] * n, pa.int32())], names=["shard", "row", *out, "width"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(shared, pattern)
        task, shards, waiting, tokens = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array(encode(text.as_py() or ""), kind)
                for part, at in enumerate(range(0, max(1, len(ids)), capacity)):
                    waiting.append((doc_id, part, ids[at : at + capacity]))
                    tokens += len(waiting[-1][2])
                    if tokens >= shard_tokens or len(waiting) >= shard_tokens // 8:
                        yield rows_of(f"{task}-{shards}", waiting)
                        shards, waiting, tokens = shards + 1, [], 0
        if waiting:
            yield rows_of(f"{task}-{shards}", waiting)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "shard string, row int, n_tokens int, ids binary, positions binary, cu_seqlens array<int>, doc_ids array<long>, parts array<int>, width int"
    )


_encoders: dict[tuple[int, str], Callable] = {}


def _encoder(shared, pattern: str) -> Callable[[str], list[int]]:
    """The worker's encoder for a broadcast vocabulary; ids equal those of byte_bpe."""
    import tiktoken

    key = (getattr(shared, "id", id(shared)), pattern)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = tiktoken.Encoding("packed", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={}).encode_ordinary
    return _encoders[key]


def unpack(packed: DataFrame) -> DataFrame:
    """(doc_id, part, ids) of every segment, read back from the binary rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, part, ids = [], [], []
            for r in batch.to_pylist():
                row = np.frombuffer(r["ids"], f"<u{r['width']}")
                for k, (d, p) in enumerate(zip(r["doc_ids"], r["parts"], strict=True)):
                    doc.append(d)
                    part.append(p)
                    ids.append(row[r["cu_seqlens"][k] : r["cu_seqlens"][k + 1]].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(part, pa.int32()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "part", "ids"])

    return packed.mapInArrow(run, "doc_id long, part int, ids array<int>")
