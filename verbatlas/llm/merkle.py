"""Merkle manifest of a dataset, with an authentication path for every row.

Every row is a leaf, the hash of its fields; per source, leaves ascend by doc_id, and runs of ``fan`` nodes become
the hash of their digests until one is left.  The sources' roots, ordered by source, make the root of the dataset.

Leaves are numbered within their source and cut into blocks of ``fan ** levels`` of them, which are whole subtrees.
Inside a block paths come out by fractal traversal: for each level there is an existing run, which holds the present
leaf's ancestor, and a desired run, the next one, which treehash builds by one leaf a step; when the leaf leaves the
existing run the desired one takes its place.  So besides the block's leaf digests, at most ``fan ** levels``, a task
holds two runs a level.  Above the blocks the tree is made and walked down by grouping, a level a round, and each
block's path up to the root comes to it as one row.

Defined results: null fields are written ``-``; a null source is a source of its own and the first; a null doc_id comes
before every other, and rows of one id go by their leaf; equal rows are leaves of their own; rows without siblings have
the hash of no bytes as proof; an empty table gives no rows; other columns are dropped, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbatlas.llm.common import settle, spread_join
from verbatlas.llm.ordered import blocks, numbered, packed, typed

#: The fields of a leaf, in their order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def written(field: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    text = field.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(fields: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(written, fields)), 256))


def tampered(docs: DataFrame, every: int = 5) -> DataFrame:
    """(doc_id, source, leaf, changed): digests of the rows and, where ``every`` divides the id's CRC-32, of the row with its text's A-Z lower-cased."""
    own = [F.col(c) for c in FIELDS]
    low = [*own[:-1], F.translate(F.col("text").cast("string"), UPPER, LOWER)]
    hit = F.crc32(F.col("doc_id").cast("string")) % every == 0
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), leaf_of(own).alias("leaf"), F.when(hit, leaf_of(low)).alias("changed"))


def join_digests(run: list[bytes]) -> bytes:
    """The digest, as hex text, of a run of digests."""
    return sha256(b"".join(run)).hexdigest().encode()


def height_of(n: int, fan: int) -> int:
    """Levels above ``n`` leaves until one node is left."""
    height = 0
    while n > 1:
        n, height = -(-n // fan), height + 1
    return height


class Treehash:
    """The nodes of one level, made from leaves that come one at a time; at most a run a level is held."""

    def __init__(self, level: int, fan: int):
        self.fan, self.open = fan, [[] for _ in range(level + 1)]

    def feed(self, leaf: bytes) -> None:
        self.open[0].append(leaf)
        for k in range(len(self.open) - 1):
            if len(self.open[k]) < self.fan:
                break
            self.open[k + 1].append(join_digests(self.open[k]))
            self.open[k] = []

    def nodes(self) -> list[bytes]:
        """All nodes so far; runs that are not full are closed."""
        for k in range(len(self.open) - 1):
            if self.open[k]:
                self.open[k + 1].append(join_digests(self.open[k]))
                self.open[k] = []
        return self.open[-1]


def traverse(leaves: list[bytes], height: int, fan: int) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(leaf number, runs): for each leaf in turn, the run of each level below ``height`` that holds the leaf's ancestor."""

    def begin(level: int, start: int, steps: int) -> Treehash:
        made = Treehash(level, fan)
        for leaf in leaves[start : start + steps]:
            made.feed(leaf)
        return made

    spans = [fan ** (k + 1) for k in range(height)]  # leaves below a run of each level
    existing = [begin(k, 0, spans[k]).nodes() for k in range(height)]
    desired = [Treehash(k, fan) for k in range(height)]
    for i in range(len(leaves)):
        if i:
            for k in range(height):
                if i % spans[k] == 0:
                    existing[k], desired[k] = desired[k].nodes(), Treehash(k, fan)
        yield i, existing
        for k in range(height):
            if i + spans[k] < len(leaves):
                desired[k].feed(leaves[i + spans[k]])


def block_root(leaves: list[bytes], first: bool, levels: int, fan: int) -> bytes:
    """The root of a block: blocks after a source's first, and so every one of several, have all ``levels``."""
    top = Treehash(height_of(len(leaves), fan) if first else levels, fan)
    for leaf in leaves:
        top.feed(leaf)
    return top.nodes()[0]


def _hex(value: bytes) -> bytes:
    return bytes(value).hex().encode()


def block_roots(leaves: DataFrame, levels: int, fan: int) -> DataFrame:
    """(source, block, root) of rows source, block, idx, leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = ((source, block, block_root([_hex(r[3]) for r in rows], not block, levels, fan).decode()) for (source, block), rows in blocks(batches, (0, 1)))
        yield from packed(made, [("source", pa.string()), ("block", pa.int64()), ("root", pa.string())])

    dealt = leaves.select("source", "block", "idx", "leaf").repartition("source", "block").sortWithinPartitions("source", "block", "idx")
    return dealt.mapInArrow(run, "source string, block long, root string")


def climb(nodes: DataFrame, fan: int) -> DataFrame:
    """(g, idx, path, root) of nodes (g, idx, h): each one's path to its group's root, as (place, run) a level.

    A level is one grouping of ``fan`` nodes; going down again, each node's row is joined with its run's."""
    levels = []  # (runs, tops): runs of several nodes or after the first, and groups of which one node is left
    at = nodes
    while True:
        grouped = at.groupBy("g", F.expr(f"idx div {fan}").alias("up")).agg(F.array_sort(F.collect_list(F.struct("idx", "h"))).alias("run"))
        grouped = settle(grouped.select("g", "up", F.transform("run", lambda x: x["h"]).alias("run")))
        done = (F.col("up") == 0) & (F.size("run") == 1)
        levels.append((grouped.filter(~done), grouped.filter(done).select("g", F.lit(0).cast("long").alias("idx"), F.col("run")[0].alias("root"))))
        if not levels[-1][0].head(1):
            break
        at = levels[-1][0].select("g", F.col("up").alias("idx"), F.sha2(F.array_join("run", ""), 256).alias("h"))
    none = F.array().cast("array<struct<place:int,run:array<string>>>")
    paths = levels[-1][1].select("g", "idx", none.alias("path"), "root")
    for runs, tops in reversed(levels[:-1]):
        up = paths.select("g", F.col("idx").alias("up"), F.col("path").alias("above"), "root")
        each = runs.join(up, ["g", "up"]).select("g", "up", "above", "root", "run", F.posexplode("run").alias("place", "h"))
        below = each.select("g", (F.col("up") * fan + F.col("place")).alias("idx"), F.concat(F.array(F.struct("place", "run")), "above").alias("path"), "root")
        paths = settle(below.unionByName(tops.select("g", "idx", none.alias("path"), "root")))
    return paths


def _proofs(levels: int, fan: int):
    """Rows of a block, its upper path first, to their leaf, roots and proofs."""

    def of(block: int, rows: list[tuple]) -> Iterator[tuple]:
        path, subroot, root = rows[0][6:9]
        above = [(p["place"], [h.encode() for h in p["run"]]) for p in path]
        leaves = [_hex(r[4]) for r in rows[1:]]
        height = height_of(len(leaves), fan) if not block else levels
        rest: list[tuple[bytes, bytes]] = []
        for i, runs in traverse(leaves, height, fan):
            if i % fan == 0:  # what stands above the leaf's own run is the same for all of it
                ways = [(i // fan**k % fan, runs[k]) for k in range(1, height)] + above
                rest = [(b"".join(run[:p]), b"".join(run[p + 1 :])) for p, run in ways]
                later = b"".join(x for pair in rest for x in pair)
            own = [(b"".join(runs[0][: i % fan]), b"".join(runs[0][i % fan + 1 :]))] if height else []
            source, _, idx, doc, _, changed, *_ = rows[i + 1]
            digest = leaves[i] if changed is None else _hex(changed)
            for head, tail in own + rest:
                digest = sha256(head + digest + tail).hexdigest().encode()
            proof = sha256((own[0][0] + own[0][1] if own else b"") + later).hexdigest()
            folded = digest.decode()
            yield source, idx, doc, leaves[i].decode(), subroot, root, proof, folded, folded == root

    return of


def manifest(docs: DataFrame, fan: int = 16, levels: int = 3) -> DataFrame:
    """Per row: source, position (in its source, from 0), doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    size = fan**levels
    hashed = settle(tampered(docs))  # texts are read once
    leaves = numbered(hashed, "source", ["doc_id", "leaf"]).withColumn("block", F.expr(f"idx div {size}"))
    tops = settle(block_roots(leaves, levels, fan))
    inside = climb(tops.select(F.struct("source").alias("g"), F.col("block").alias("idx"), F.col("root").alias("h")), fan)
    sources = inside.groupBy("g").agg(F.first("root").alias("subroot"), F.count(F.lit(1)).alias("n"))
    placed = numbered(sources.select(F.col("g.source").alias("source"), "subroot", "n", F.lit(0).alias("one")), "one", ["source"])
    upper = climb(placed.select(F.struct("one").alias("g"), "idx", F.col("subroot").alias("h")), fan).select("idx", F.col("path").alias("above"), "root")
    upper = settle(placed.join(upper, "idx").select(F.struct("source").alias("g"), "subroot", "n", "above", "root"))
    ways = spread_join(inside.select("g", F.col("idx").alias("block"), "path"), upper, ["g"])
    none = lambda kind: F.lit(None).cast(kind)
    kind = docs.schema["doc_id"].dataType.simpleString()
    heads = ways.select(F.col("g.source").alias("source"), "block", F.lit(-1).cast("long").alias("idx"), none(kind).alias("doc_id"), none("binary").alias("leaf"), none("binary").alias("changed"), F.concat("path", "above").alias("path"), "subroot", "root")
    rows = leaves.select("source", "block", "idx", "doc_id", "leaf", "changed", none(heads.schema["path"].dataType).alias("path"), none("string").alias("subroot"), none("string").alias("root"))
    dealt = rows.unionByName(heads).repartition("source", "block").sortWithinPartitions("source", "block", "idx")
    of = _proofs(levels, fan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, doc = pa.string(), None

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal doc
            for batch in batches:
                doc = batch.schema.field("doc_id").type
                yield batch

        found = (row for (_, block), held in blocks(seen(), (0, 1)) for row in of(block, held))
        digests = [(n, text) for n in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]
        yield from typed(found, lambda: [("source", text), ("position", pa.int64()), ("doc_id", doc), *digests, ("verified", pa.bool_())])

    return dealt.mapInArrow(run, f"source string, position long, doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
