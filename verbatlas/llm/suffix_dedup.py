"""Repeated byte strings across documents by distributed prefix doubling.

Every position gets a rank for its first 1, 2, 4, 8, 16 and 32 bytes: the rank of
2h bytes is a scramble of the ranks of h bytes at the position and h bytes further.
Equal strings have equal ranks on every machine, so the doubling itself needs no
exchange.  Exchanges sort ranks twice, and drop what is unique:

* at 32 bytes, for anchors only: a 50-byte string's anchor is the first least rank
  among its 19 positions, so its own bytes decide where it lies, and strings whose
  anchor occurs in one document only are unique;
* at 50 bytes (32, and 32 again 18 further on), for the strings around the anchors
  that are left.  The smallest document of each rank keeps it; others remove it.

Ranks at 50 bytes have 128 bits.  They travel as binary blocks dealt out by rank, so
a string that a third of all documents share makes blocks longer by one entry a
document, and no pair of documents is ever formed.  Whole texts that repeat are
settled first and take no further part.

Defined results: a null text is an empty one; texts shorter than the threshold keep
every byte; a null id comes before every other and is reported as null; rows of one
id never remove each other's bytes; repeated rows give repeated rows; an empty table
gives no rows; other columns are dropped, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbatlas.llm.common import NULL_ID, discard, id_key, release, settle, trim
from verbatlas.llm.shingles import mix

#: Bytes of the threshold, of an anchor, and anchors' neighbours: SIZE = GRAM + SPAN - 1.
SIZE, GRAM, SPAN = 50, 32, 19
#: Most ids that are broadcast to leave out rows; beyond it the choice is a shuffled join.
SENT_IDS = 1_000_000
#: Bytes of text for one bucket of ranks and for one bucket of strings, and of text that a task works on at a time.
RANK_BYTES, STRING_BYTES, PIECE_BYTES = 8 << 20, 4 << 20, 12 << 20

_FIRST = mix(np.arange(1, 257, dtype=np.uint64))
_OTHER = mix(np.arange(1001, 1257, dtype=np.uint64))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def doubled(first: np.ndarray, offsets: tuple[int, ...] = (1, 2, 4, 8, 16)) -> np.ndarray:
    """Ranks of prefixes twice as long for each offset in turn; the last positions fall away."""
    for h in offsets:
        first = mix(first[:-h] * _STEP + first[h:])
    return first


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a text's strings of SIZE bytes: their anchors (position, scrambled 32-byte rank) and the first and last start of each one's strings.

    A string's anchor is the first least rank among its SPAN positions; it moves only forwards as the string does."""
    if len(data) < SIZE:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64))
    rank = doubled(_FIRST[data])
    at, h = np.arange(len(rank)), 1
    while h < SPAN:
        step = min(h, SPAN - h)
        left, right = at[:-step], at[step:]
        at = np.where(rank[left] <= rank[right], left, right)
        h += step
    new = np.flatnonzero(np.diff(at, prepend=-1))
    # least ranks crowd at the low end: scrambled once more, they fall into all buckets alike
    return at[new], mix(rank[at[new]] ^ _STEP), new, np.append(new[1:], len(at)) - 1


def _blocks(buckets: int, key: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, list[bytes]]]:
    """Columns cut by the high bits of the rank."""
    bits = buckets.bit_length() - 1
    bucket = (key >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)
    order = np.argsort(bucket, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=buckets))])
    columns = [c[order] for c in columns]
    for b in np.flatnonzero(np.diff(ends)):
        yield int(b), [c[ends[b] : ends[b + 1]].tobytes() for c in columns]


def _pieces(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about PIECE_BYTES of text."""
    for batch in batches:
        sizes = np.array(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
        part = np.cumsum(sizes) // PIECE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def _numbered(doc: bytes, ids: np.ndarray) -> tuple[bytes, bytes]:
    """A block's documents as numbers in a table of its own ids."""
    used, number = np.unique(np.frombuffer(doc, np.uint32), return_inverse=True)
    return number.astype(np.uint16 if len(used) <= 1 << 16 else np.uint32).tobytes(), ids[used].tobytes()


def _ranked(texts: DataFrame, buckets: int) -> DataFrame:
    """Blocks of the anchors' ranks: bucket, ranks, docs (number in ids), ids; each document's rank once.

    A rank is cut to the bits of its bucket and 32 more.  The buckets grow with the text, so
    about one rank in ten thousand or less is taken for repeated by chance, which costs work only."""
    low = np.uint64(32 - (buckets.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, 2):
            ids = np.array(batch.column(0))
            ranks = [np.unique(anchors(np.frombuffer((t.as_py() or "").encode(), np.uint8))[1] >> low) for t in batch.column(2)]
            if not sum(map(len, ranks)):
                continue
            doc = np.repeat(np.arange(len(ranks), dtype=np.uint32), [len(r) for r in ranks])
            every = np.concatenate(ranks)
            rows = list(_blocks(buckets, every << low, [every.astype(np.uint32), doc]))
            named = [_numbered(c[1], ids) for _, c in rows]
            arrays = [pa.array([b for b, _ in rows], pa.int32()), pa.array([c[0] for _, c in rows], pa.binary()), pa.array([n[0] for n in named], pa.binary()), pa.array([n[1] for n in named], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["bucket", "ranks", "docs", "ids"])
            trim()

    return texts.mapInArrow(run, "bucket int, ranks binary, docs binary, ids binary")


def _repeated(table: pa.Table) -> pa.Table:
    """Of one bucket's blocks: (id, rank) of the ranks that occur under two ids at least."""
    ranks, docs = [], []
    for r, d, i in zip(table.column("ranks").to_pylist(), table.column("docs").to_pylist(), table.column("ids").to_pylist(), strict=True):
        rank, ids = np.frombuffer(r, np.uint32), np.frombuffer(i, np.int64)
        ranks.append(rank)
        docs.append(ids[np.frombuffer(d, np.uint16 if len(ids) <= 1 << 16 else np.uint32)])
    rank, doc = np.concatenate(ranks), np.concatenate(docs)
    order = np.argsort(rank, kind="stable")
    rank, doc = rank[order], doc[order]
    starts = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]]))
    several = np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts)
    keep = np.repeat(several, np.diff(np.append(starts, len(rank))))
    high = table.column("bucket")[0].as_py() << 32
    trim()
    return pa.table({"id": pa.array(doc[keep]), "rank": pa.array(rank[keep].astype(np.int64) + high)})


_AROUND = np.arange(-(SPAN - 1), SIZE)


def _strings(texts: DataFrame, buckets: int, ranked: int) -> DataFrame:
    """Blocks of the surroundings of the anchors that are left: bucket, docs (number in ids), places, near (least and greatest distance to a start), bytes, ids.

    ``ranked`` is the number of buckets of ``_ranked``."""
    low = np.uint64(32 - (ranked.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, 2):
            ids = np.stack([np.array(batch.column(0)), np.array(batch.column(1))], 1) if batch.num_rows else np.zeros((0, 2), np.int64)
            keys, doc, place, near, around = [], [], [], [], []
            for i, (t, wanted) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                data = np.frombuffer((t.as_py() or "").encode(), np.uint8)
                at, rank, first, last = anchors(data)
                if not len(at):
                    continue
                left = np.isin((rank >> low).astype(np.int64), np.array(wanted.values))
                at, rank, first, last = at[left], rank[left], first[left], last[left]
                padded = np.concatenate([np.zeros(SPAN - 1, np.uint8), data, np.zeros(SIZE, np.uint8)])
                near_bytes = padded[(at[:, None] + (SPAN - 1)) + _AROUND[None, :]]
                near_bytes[(_AROUND < (first - at)[:, None]) | (_AROUND >= (last - at)[:, None] + SIZE)] = 0  # of no string
                around.append(near_bytes)
                keys.append(rank)
                doc.append(np.full(len(at), i, np.uint32))
                place.append(at.astype(np.uint32))
                near.append(np.stack([at - last, at - first], 1).astype(np.uint8))
            if not keys:
                continue
            columns = [np.concatenate(x) for x in (doc, place, near, around)]
            rows = list(_blocks(buckets, np.concatenate(keys), columns))
            named = [_numbered(c[0], ids) for _, c in rows]
            arrays = [pa.array([b for b, _ in rows], pa.int32()), pa.array([n[0] for n in named], pa.binary()), *(pa.array([c[k] for _, c in rows], pa.binary()) for k in (1, 2)), pa.array([pa.compress(c[3], "zstd", asbytes=True) for _, c in rows], pa.binary()), pa.array([n[1] for n in named], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["bucket", "docs", "places", "near", "around", "ids"])
            trim()

    return texts.mapInArrow(run, "bucket int, docs binary, places binary, near binary, around binary, ids binary")


def _later(table: pa.Table) -> pa.Table:
    """Of one bucket's blocks: (id, k, first, last) runs of starts of strings that a smaller id has too."""
    ids, places, near, around = [], [], [], []
    for r in table.select(["docs", "places", "near", "around", "ids"]).to_pylist():
        table_ids = np.frombuffer(r["ids"], np.int64).reshape(-1, 2)
        ids.append(table_ids[np.frombuffer(r["docs"], np.uint16 if len(table_ids) <= 1 << 16 else np.uint32)])
        places.append(np.frombuffer(r["places"], np.uint32).astype(np.int64))
        near.append(np.frombuffer(r["near"], np.uint8).reshape(-1, 2))
        plain = pa.decompress(r["around"], len(places[-1]) * len(_AROUND), "zstd")
        around.append(np.frombuffer(plain, np.uint8).reshape(-1, len(_AROUND)))
    ids, places, near, around = (np.concatenate(x) for x in (ids, places, near, around))
    one, two = np.empty((SPAN, len(places)), np.uint64), np.empty((SPAN, len(places)), np.uint64)  # a row for each start
    for at in range(0, len(places), 8192):
        part = around[at : at + 8192].T
        one[:, at : at + 8192], two[:, at : at + 8192] = (doubled(of[part], (1, 2, 4, 8, 16, SIZE - GRAM)) for of in (_FIRST, _OTHER))
    hits = np.zeros((SPAN, len(places)), bool)  # by start, counted from SPAN - 1 before the anchor
    for row in range(SPAN):
        back = SPAN - 1 - row
        own = np.flatnonzero((back <= near[:, 1]) & (back >= near[:, 0]))
        if not len(own):
            continue
        a, b, doc = one[row, own], two[row, own], ids[own, 0]
        order = np.lexsort((b, a))
        own, a, b, doc = own[order], a[order], b[order], doc[order]
        starts = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        least = np.repeat(np.minimum.reduceat(doc, starts), np.diff(np.append(starts, len(a))))
        hits[row, own[doc > least]] = True
    edges = np.diff(np.concatenate([np.zeros((1, len(places)), bool), hits, np.zeros((1, len(places)), bool)]).astype(np.int8), axis=0).T
    who, first = np.nonzero(edges == 1)
    _, last = np.nonzero(edges == -1)
    base = places[who] - (SPAN - 1)
    trim()
    return pa.table({"id": ids[who, 0], "k": ids[who, 1], "first": base + first, "last": base + last - 1})


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept"]
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for text, whole, firsts, lasts in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3), batch.column(4), strict=True):
            data = (text.as_py() or "").encode()
            n, spans, kept = 0, 0, data
            if whole and len(data) >= SIZE:
                n, spans, kept = len(data), 1, b""
            elif firsts.is_valid and len(firsts):
                change = np.zeros(len(data) + 1, np.int64)
                np.add.at(change, np.array(firsts.values), 1)
                np.add.at(change, np.array(lasts.values) + SIZE, -1)
                gone = np.cumsum(change[:-1]) > 0
                n = int(gone.sum())
                spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            for k, v in enumerate((len(data), n, spans, kept)):
                out[k].append(v)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.binary())], names=names)


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) per row of ``docs``; kept has the bytes that stay."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # k tells apart the texts of one id; it is the text's hash where ids repeat, and else nothing, which takes no room in the blocks
    repeated = bool(docs.groupBy(id_key().alias("id")).count().filter("count > 1").head(1))
    k = F.xxhash64(text) if repeated else F.lit(0).cast("long")
    rows = docs.select(id_key().alias("id"), k.alias("k"), F.xxhash64(text).alias("h"), F.xxhash64(text, F.lit(1)).alias("h2"), text.alias("text"))
    least = rows.groupBy("h", "h2", F.octet_length("text").alias("n")).agg(F.min("id").alias("least"), F.max("id").alias("most"))
    copies = settle(rows.select("id", "k", "h", "h2").join(least.filter("least < most").select("h", "h2", "least"), ["h", "h2"]).filter("id > least").select("id", "k").distinct())
    few = copies.count() <= SENT_IDS
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    of = lambda size: 1 << max(4, (total // size).bit_length())
    own = rows.filter(F.octet_length("text") >= SIZE).select("id", "k", "text").join(F.broadcast(copies) if few else copies, ["id", "k"], "left_anti")
    left = settle(_ranked(own, of(RANK_BYTES)).groupBy("bucket").applyInArrow(_repeated, "id long, rank long"))
    release(spark)
    wanted = left.groupBy("id").agg(F.collect_set("rank").alias("wanted"))
    strings = _strings(own.join(wanted, "id").select("id", "k", "text", "wanted"), of(STRING_BYTES), of(RANK_BYTES))
    runs = settle(strings.groupBy("bucket").applyInArrow(_later, "id long, k long, first long, last long"))
    discard(left)
    release(spark)
    marks = runs.groupBy("id", "k").agg(F.collect_list("first").alias("firsts"), F.collect_list("last").alias("lasts"))
    every = rows.select("id", "k", "text").join(copies.withColumn("whole", F.lit(True)), ["id", "k"], "left").join(marks, ["id", "k"], "left")
    done = every.select("id", "text", F.coalesce("whole", F.lit(False)).alias("whole"), "firsts", "lasts").mapInArrow(_finish, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return done.withColumn("doc_id", F.when(F.col("id") != NULL_ID, F.col("id"))).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept")


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns."""
    return dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int | None, str | None]]) -> list[tuple[int, int, int, str]]:
    """The same by a dictionary of all strings, for tests: (n_bytes, n_removed, n_spans, kept_sha256) by row."""
    first: dict[bytes, int] = {}
    ids = [NULL_ID if i is None else i for i, _ in rows]
    data = [(t or "").encode() for _, t in rows]
    for i, d in zip(ids, data, strict=True):
        for k in range(len(d) - SIZE + 1):
            s = d[k : k + SIZE]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, d in zip(ids, data, strict=True):
        gone = bytearray(len(d))
        for k in range(len(d) - SIZE + 1):
            if first[d[k : k + SIZE]] < i:
                gone[k : k + SIZE] = b"\1" * SIZE
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), sum(gone), sum(1 for k in range(len(d)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    return out
