"""Embedding near-dedup by a forest of random-projection trees.

Every tree splits the vectors again and again at the median of a random
projection; vectors near the median go to both sides (spill).  The upper levels
are fitted on a bounded sample, and leaves that are still too large are split on,
one level a round, at medians that Spark computes over all their vectors.  Every
vector is put into every tree.  Vectors of one leaf are compared exactly, in double
precision; leaves that splits cannot make smaller are compared in tiles of bounded
size, so no leaf is cut short.

A pair that shares several leaves is counted in the first of them only, which the
two vectors' leaf lists decide; so counts of links come out of the leaves without a
table of all pairs, and each leaf hands on only a spanning forest of its links.
Equal vectors are one class and are never paired with each other.

Defined results: vectors that are null, empty or zero, or hold a null or non-finite
component, link with nothing; vectors of different lengths do not link; a null id
is reported as null and comes before every other; rows that repeat an id are
vectors of their own in the counts and one node in the components; an empty table
gives no rows; other columns are dropped, so their names cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verbatlas.llm.common import NULL_ID, id_key, settle
from verbatlas.llm.components import components, roots

#: Most vectors, and bytes of them, that are collected to fit the upper levels, and fewest of them in a node that is split.
SAMPLE, SAMPLE_BYTES, LEAST = 16_384, 128 << 20, 64


def direction(tree: int, path: int, dim: int) -> np.ndarray:
    """The unit vector that the node ``path`` of a tree projects on; every machine makes the same."""
    v = np.random.default_rng([tree, path & 0xFFFFFFFF, path >> 32, dim]).standard_normal(dim)
    return v / np.linalg.norm(v)


def margin_of(threshold: float, dim: int, spill: float) -> float:
    """How far beyond a cut vectors go to both sides.

    Linked unit vectors are sqrt(2 - 2 * threshold) apart at most, and a random direction sees a distance through a
    factor that spreads by 1 / sqrt(dim), as it does unit vectors: so the share of vectors within the margin, and with it
    the number of copies, is the same at every dimension."""
    return spill * math.sqrt(max(0.0, 2 - 2 * threshold) / dim)


def _descend(x: np.ndarray, rows: np.ndarray, tree: int, path: int, cuts: dict[tuple[int, int], float], spill: float, out: list) -> None:
    cut = cuts.get((tree, path))
    if cut is None or not len(rows):
        out.append((path, rows))
        return
    at = x[rows] @ direction(tree, path, x.shape[1])
    _descend(x, rows[at < cut + spill], tree, 2 * path, cuts, spill, out)
    _descend(x, rows[at >= cut - spill], tree, 2 * path + 1, cuts, spill, out)


def fit_cuts(sample: np.ndarray, trees: int, small: int, spill: float) -> dict[tuple[int, int], float]:
    """Medians of the upper nodes, down to ``small`` sampled vectors a node."""
    cuts: dict[tuple[int, int], float] = {}
    for tree in range(trees):
        todo = [(1, np.arange(len(sample)))]
        while todo:
            path, rows = todo.pop()
            if len(rows) <= max(small, LEAST) or path >> 40:
                continue
            at = sample[rows] @ direction(tree, path, sample.shape[1])
            cut = float(np.median(at))
            sides = rows[at < cut + spill], rows[at >= cut - spill]
            if max(map(len, sides)) > 0.9 * len(rows):
                continue  # one dense cluster: a split would only copy it
            cuts[tree, path] = cut
            todo += [(2 * path, sides[0]), (2 * path + 1, sides[1])]
    return cuts


def _unit(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    values = values / np.abs(values).max(axis=1, keepdims=True)  # squares of huge and tiny components stay in range
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def _placed(reps: DataFrame, cuts: dict, trees: int, spill: float) -> DataFrame:
    """(id, size, v, leaves): the codes of all leaves that a vector lies in; tree in the high bits, then the node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(batch.column(2))
            which, codes = [], []
            for tree in range(trees):
                out: list = []
                _descend(x, np.arange(len(x)), tree, 1, cuts, spill, out)
                for path, rows in out:
                    which.append(rows)
                    codes.append(np.full(len(rows), (tree << 56) | path, np.int64))
            which, codes = np.concatenate(which), np.concatenate(codes)
            order = np.lexsort((codes, which))
            ends = np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(x)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(codes[order]))], names=["id", "size", "v", "leaves"])

    return reps.mapInArrow(run, _schema(reps))


def _schema(reps: DataFrame) -> str:
    return f"id long, size long, v {reps.schema['v'].dataType.simpleString()}, leaves array<long>"


def _split_on(placed: DataFrame, large: DataFrame, spill: float) -> DataFrame:
    """``placed`` with the leaves of ``large`` (leaf, cut) split one level further."""
    moved = placed.select("id", F.explode("leaves").alias("leaf")).join(large, "leaf").groupBy("id").agg(F.collect_list(F.struct("leaf", "cut")).alias("cuts"))
    joined = placed.join(moved, "id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = batch.column(3).to_pylist()
            x = _unit(batch.column(2)) if batch.num_rows else None
            for i, cuts in enumerate(batch.column(4).to_pylist()):
                for c in cuts or ():
                    code, cut = c["leaf"], c["cut"]
                    path = code & ((1 << 56) - 1)
                    at = float(x[i] @ direction(code >> 56, path, x.shape[1]))
                    head = code - path
                    new = [head | (2 * path)] * (at < cut + spill) + [head | (2 * path + 1)] * (at >= cut - spill)
                    leaves[i] = sorted([y for y in leaves[i] if y != code] + new)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(leaves, pa.list_(pa.int64()))], names=["id", "size", "v", "leaves"])

    return joined.mapInArrow(run, _schema(placed))


def _projected(placed: DataFrame, large: DataFrame) -> DataFrame:
    """(leaf, at): the projections of all vectors of the leaves of ``large``."""
    rows = placed.select("v", F.explode("leaves").alias("leaf")).join(large.select("leaf"), "leaf").select("leaf", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, leaf = _unit(batch.column(1)), np.array(batch.column(0))
                at = np.zeros(len(x))
                for code in np.unique(leaf):
                    own = leaf == code
                    at[own] = x[own] @ direction(int(code) >> 56, int(code) & ((1 << 56) - 1), x.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at)], names=["leaf", "at"])

    return rows.mapInArrow(run, "leaf long, at double")


def _compare(threshold: float):
    """Exact comparison of one tile pair of one leaf: link counts, weighted by class size, and a spanning forest."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        leaf, t1, t2 = (table.column(c)[0].as_py() for c in ("leaf", "t1", "t2"))
        ident, size, tile = (np.array(table.column(c)) for c in ("id", "size", "tile"))
        x = _unit(table.column("v").combine_chunks())
        lists = [np.array(y.values) for y in table.column("leaves").combine_chunks()]
        before = np.concatenate([y[y < leaf] for y in lists]) if lists else np.zeros(0, np.int64)
        codes, place = np.unique(before, return_inverse=True)
        member = None
        n, a, b = np.zeros(len(x), np.int64), [], []
        rows = np.flatnonzero(tile == t1)
        for start in range(0, len(rows), 512):
            own = rows[start : start + 512]
            near = x[own] @ x.T >= threshold
            near &= (np.arange(len(x))[None, :] > own[:, None]) if t1 == t2 else (tile == t2)[None, :]
            i, j = np.nonzero(near)
            if not len(i):
                continue
            i = own[i]
            if len(codes):
                if member is None:
                    member = np.zeros((len(x), len(codes)), np.float32)
                    member[np.repeat(np.arange(len(x)), [int((y < leaf).sum()) for y in lists]), place] = 1
                new = np.concatenate([(member[i[k : k + 65536]] * member[j[k : k + 65536]]).sum(1) == 0 for k in range(0, len(i), 65536)]) if len(i) * len(codes) < 4_000_000 else ((member[own] @ member.T) == 0)[np.searchsorted(own, i), j]
                counted_i, counted_j = i[new], j[new]
            else:
                counted_i, counted_j = i, j
            np.add.at(n, counted_i, size[counted_j])
            np.add.at(n, counted_j, size[counted_i])
            forest = roots(ident[i].tolist(), ident[j].tolist())
            a += forest.keys()
            b += forest.values()
        hit = n > 0
        k = int(hit.sum())
        return pa.table(
            {
                "id": pa.concat_arrays([pa.array(ident[hit]), pa.array(a, pa.int64())]),
                "n": pa.concat_arrays([pa.array(n[hit]), pa.nulls(len(a), pa.int64())]),
                "other": pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(b, pa.int64())]),
            }
        )

    return run


def _forest(reps: DataFrame, n: int, dim: int, trees: int, leaf_rows: int, spill: float) -> tuple[DataFrame, DataFrame]:
    """(placed, sizes): the ``n`` vectors of one length with their leaves, and the leaves' numbers of vectors."""
    # the smallest hashes of all vectors, at most SAMPLE of them and SAMPLE_BYTES of components
    taken = reps.orderBy(F.xxhash64("v"), "id").limit(max(LEAST, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))).select("v").toArrow()
    sample = _unit(taken.column(0).combine_chunks())
    cuts = fit_cuts(sample, trees, leaf_rows * len(sample) // n, spill)
    placed = settle(_placed(reps, cuts, trees, spill))
    stuck = None
    while True:
        sizes = placed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count()
        large = sizes.filter((F.col("count") > 2 * leaf_rows) & (F.col("leaf").bitwiseAND((1 << 56) - 1) < 1 << 54))
        if stuck is not None:
            large = large.join(stuck, "leaf", "left_anti")
        large = settle(large)
        if not large.head(1):
            return placed, sizes
        cut = _projected(placed, large).groupBy("leaf").agg(
            F.percentile_approx("at", 0.5).alias("cut"), F.percentile_approx("at", F.array(F.lit(0.1), F.lit(0.9))).alias("q")
        )
        # a leaf whose vectors lie within the spill is one dense cluster: it stays, and is compared in tiles
        cut = settle(cut.withColumn("splits", F.col("q")[1] - F.col("q")[0] > 2 * spill))
        now = cut.filter(~F.col("splits")).select("leaf")
        stuck = now if stuck is None else stuck.unionByName(now)
        placed = settle(_split_on(placed, cut.filter("splits").select("leaf", "cut"), spill))


def link(vectors: DataFrame, threshold: float = 0.9, trees: int = 8, leaf_rows: int = 1024, spill: float = 0.36) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors`` (vec_id, embedding).

    ``spill`` is the margin around each cut as a share of the largest distance of linked vectors (see ``margin_of``)."""
    kind = vectors.schema["embedding"].dataType
    kind = kind.simpleString() if isinstance(kind.elementType, (T.FloatType, T.DoubleType)) else "array<double>"
    rows = vectors.select(id_key("vec_id").alias("id"), F.col("embedding").cast(kind).alias("v"))
    usable = F.coalesce(
        (F.size("v") > 0) & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0), F.lit(False)
    )
    good = rows.filter(usable)
    # vectors of one id have keys of their own in the forest
    classes = settle(good.groupBy("v").agg(F.min("id").alias("vec"), F.count(F.lit(1)).alias("size")).withColumn("id", F.monotonically_increasing_id()))
    # lengths with many vectors have a forest each; all others are one leaf a length, and one job
    dims = {r[0]: r[1] for r in classes.groupBy(F.size("v")).count().filter(F.col("count") > 2 * leaf_rows).collect()}
    few = classes.filter(~F.size("v").isin(*dims)) if dims else classes
    few = few.select("id", "size", "v", F.array(F.size("v").cast("long")).alias("leaves"))
    parts = [(few, few.select(F.col("leaves")[0].alias("leaf")).groupBy("leaf").count())]
    for dim, n in sorted(dims.items()):
        parts.append(_forest(classes.filter(F.size("v") == dim).select("id", "size", "v"), n, dim, trees, leaf_rows, margin_of(threshold, dim, spill)))
    links = None
    for placed, sizes in parts:
        tiles = sizes.select("leaf", F.ceil(F.col("count") / (2 * leaf_rows)).alias("tiles"))
        spread = placed.withColumn("leaf", F.explode("leaves")).join(tiles, "leaf")
        spread = spread.withColumn("tile", F.pmod(F.xxhash64("id"), "tiles")).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
        spread = spread.select("leaf", F.size("v").alias("dim"), F.least("tile", "with").alias("t1"), F.greatest("tile", "with").alias("t2"), "id", "size", "tile", "v", "leaves")
        own = spread.groupBy("leaf", "dim", "t1", "t2").applyInArrow(_compare(threshold), "id long, n long, other long")
        links = own if links is None else links.unionByName(own)
    links = settle(links)
    counts = links.filter("n IS NOT NULL").groupBy("id").agg(F.sum("n").alias("n"))
    members = settle(good.join(classes.select("v", F.col("id").alias("rep"), "vec", "size"), "v").select("id", "rep", "vec", "size"))
    name = lambda c, to: classes.select(F.col("id").alias(c), F.col("vec").alias(to))
    pairs = links.filter("other IS NOT NULL").select("id", "other").join(name("id", "a"), "id").join(name("other", "b"), "other").select("a", "b")
    nodes = components(pairs.unionByName(members.filter("id <> vec").select(F.col("id").alias("a"), F.col("vec").alias("b"))))
    linked = members.join(counts.withColumnRenamed("id", "rep"), "rep", "left").select("id", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    every = linked.unionByName(rows.filter(~usable).select("id", F.lit(0).cast("long").alias("n_links")))
    real = lambda c: F.when(c != NULL_ID, c)
    out = every.join(nodes.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    return out.select(real(F.col("id")).alias("vec_id"), "n_links", real(F.col("component")).alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
