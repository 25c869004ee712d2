"""Exact top-k search by inner product over a vector-approximation file.

Vectors are integers, floor(scale * x).  The approximation file holds a cell number a component; cells are cut at the
quantiles of a bounded sample, and the outermost reach to the largest component of all vectors, so every vector lies
within its cells.  The file is scanned once for all queries: from the cells come an upper and a lower bound of each
score, and what stays of a query are the vectors whose upper bound reaches the k-th best lower bound.  Then exact
vectors are read in the order of their bounds, a wave a time, until no bound of an unread vector reaches the k-th best
score that was found.

A task of the scan holds one group of queries and streams one stretch of the file past it; what it keeps is handed on
when it is much.  Equal vectors are one class that is scanned, scored and answered once, for which its k + 1 smallest
ids stand: more of them can be in no answer.

Defined results: vectors that are null or hold null or non-finite components take no part; vectors of different
lengths are not compared; a null id is no query, and as a candidate it is reported as null and comes before every other
in ties; rows that repeat an id are candidates of each other; components beyond 2**62 count as 2**62, and scores beyond
a long as its limit; an empty table gives no rows; other columns are dropped, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbatlas.llm.common import NULL_ID, discard, id_key, settle, spread_join

#: Most vectors, and bytes of them, that are collected to cut the cells.
SAMPLE, SAMPLE_BYTES = 16_384, 64 << 20

#: Scores that a task of the scan bounds at a time, and survivors that it holds before it hands them on.
AT_ONCE, HELD = 1 << 20, 1 << 20

#: Exact vectors of a query that the first wave reads; each later one may read eight times as many.
WAVE = 32


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """(id, v): the vectors that take part, as arrays of long."""
    number = lambda x: F.floor(x.cast("double") * float(scale)).cast("long")
    top = F.lit(1 << 62).cast("long")
    usable = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))
    return vectors.filter(usable).select(id_key("vec_id").alias("id"), F.transform("embedding", lambda x: F.greatest(F.least(number(x), top), -top)).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(n, len(values) // n if n else 0)


def cut_cells(sample: list[np.ndarray], cells: int) -> dict[int, list[np.ndarray]]:
    """By length: the cells' lower edges of each component, the last one above all sampled values."""
    by_length: dict[int, list[np.ndarray]] = {}
    for v in sample:
        by_length.setdefault(len(v), []).append(v)
    out = {}
    for length, own in by_length.items():
        x = np.array(own).reshape(len(own), length)
        at = np.linspace(0, 1, cells)
        out[length] = [np.unique(np.append(np.quantile(x[:, d], at, method="lower"), x[:, d].max() + 1)) for d in range(length)]
    return out


class Cells:
    """Cell numbers of vectors, and what each cell spans, inclusive; ``most``: the largest component of all vectors."""

    def __init__(self, edges: list[np.ndarray], most: int):
        self.edges = edges
        width = max((len(e) for e in edges), default=0) + 1
        self.low, self.high = np.full((len(edges), width), -most, np.int64), np.full((len(edges), width), most, np.int64)
        for d, e in enumerate(edges):
            self.low[d, 1 : len(e) + 1] = e
            self.high[d, : len(e)] = e - 1

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, d], side="right") for d, e in enumerate(self.edges)], 1).astype(np.uint8) if self.edges else np.zeros((len(x), 0), np.uint8)

    def spans(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = np.arange(codes.shape[1])
        return self.low[d, codes], self.high[d, codes]


class Scan:
    """One group of queries, past which approximations stream; bounds are doubled, so halves of cells stay whole."""

    def __init__(self, names: list[int], queries: np.ndarray, k: int, most: int):
        largest = int(np.abs(queries).max(initial=0))
        reach = 4 * largest * most * max(1, queries.shape[1])
        self.kind = np.float32 if reach < 1 << 24 else np.float64  # sums of whole numbers are exact in these
        self.slack = 0.0 if reach < 1 << 53 else reach * 2.0**-50 * max(1, queries.shape[1])
        self.names, self.q = np.array(names, np.int64), queries.astype(self.kind)
        self.size, self.k = np.abs(self.q), k
        self.best = np.full((len(names), k), -np.inf, self.kind)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.count = 0

    def add(self, names: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        step = max(1, AT_ONCE // len(self.names))
        for i in range(0, len(names), step):
            a, b = low[i : i + step].astype(np.float64), high[i : i + step].astype(np.float64)
            middle, half = (a + b).astype(self.kind), (b - a).astype(self.kind)
            score, off = self.q @ middle.T, self.size @ half.T
            lower, upper = score - off - self.slack, score + off + self.slack
            better = np.flatnonzero((lower > self.best[:, :1]).any(1))
            if len(better):
                both = np.concatenate([self.best[better], lower[better]], 1)
                self.best[better] = np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k :]
            q, c = np.nonzero(upper >= self.best[:, :1])
            self.held.append((q, names[i : i + step][c], upper[q, c]))
            self.count += len(q)
            if self.count > HELD:
                self.shrink()

    def shrink(self) -> None:
        """Drop what later lower bounds have ruled out."""
        q, c, u = (np.concatenate(x) for x in zip(*self.held, strict=True))
        keep = u >= self.best[q, 0]
        self.held, self.count = [(q[keep], c[keep], u[keep])], int(keep.sum())

    def hand_on(self, lows: bool) -> pa.RecordBatch:
        """Rows (q, lows, cands, bounds); with ``lows`` every query has one, with its best lower bounds."""
        if self.held:
            self.shrink()
            q, c, u = self.held[0]
        else:
            q, c, u = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        order = np.argsort(q, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(q, minlength=len(self.names)))]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x[order], t)) for x, t in ((c, pa.int64()), (u.astype(np.float64), pa.float64()))]
        low = [[float(x) for x in row if x > -np.inf] if lows else [] for row in self.best]
        self.held, self.count = [], 0
        return pa.RecordBatch.from_arrays([pa.array(self.names), pa.array(low, pa.list_(pa.float64())), *lists], names=["q", "lows", "cands", "bounds"])


def _file(classes: DataFrame, edges: dict[int, list[np.ndarray]], most: int) -> DataFrame:
    """The approximation file: (cls, dim, codes).  Lengths that the sample has not have one cell a component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.array(batch.column(1))
            for dim in np.unique(dims):
                rows = batch.filter(pa.array(dims == dim))
                codes = Cells(edges.get(int(dim), [np.zeros(0, np.int64)] * int(dim)), most).codes(_matrix(rows.column(2)))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([c.tobytes() for c in codes], pa.binary())], names=["cls", "dim", "codes"])

    return classes.select("cls", "dim", "v").mapInArrow(run, "cls long, dim int, codes binary")


def _scan(tiles: DataFrame, edges: dict[int, list[np.ndarray]], most: int, k: int) -> DataFrame:
    """Rows dim, g, j, kind, cls, v, codes of tiles, queries first, to (q, lows, cands, bounds)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, scan, names, queries, cells = None, None, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([np.array(batch.column(c)) for c in range(4)], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                dim, g, j, kind = keys[a].tolist()
                if (dim, g, j) != tile:
                    if scan is not None:
                        yield scan.hand_on(True)
                    tile, scan, names, queries = (dim, g, j), None, [], []
                    cells = Cells(edges.get(dim, [np.zeros(0, np.int64)] * dim), most)
                rows = batch.slice(a, b - a)
                own = np.array(rows.column(4))
                if kind == 0:
                    names.append(own)
                    queries.append(_matrix(rows.column(5)))
                elif names:
                    if scan is None:
                        scan = Scan(np.concatenate(names), np.concatenate(queries), k, most)
                        queries = []
                    codes = np.frombuffer(b"".join(rows.column(6).to_pylist()), np.uint8).reshape(len(own), dim)
                    for i in range(0, len(own), 1024):
                        scan.add(own[i : i + 1024], *cells.spans(codes[i : i + 1024]))
                        if scan.count > HELD:
                            yield scan.hand_on(False)
        if scan is not None:
            yield scan.hand_on(True)

    return tiles.mapInArrow(run, "q long, lows array<double>, cands array<long>, bounds array<double>")


def _scores(pairs: DataFrame) -> DataFrame:
    """Exact scores: (q, cand, first, qv, cv) to (q, cand, first, score)."""
    limit = 2**63 - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, c = (batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in (3, 4))
            lengths = np.array([len(x) for x in batch.column(3)], np.int64)
            if not len(q) or float(np.abs(q).max()) * float(np.abs(c).max()) * int(lengths.max()) < 2.0**62:
                total = np.concatenate([[0], np.cumsum(q * c)]) if len(q) else np.zeros(1, np.int64)
                if len(q) and float(np.abs(q).max()) * float(np.abs(c).max()) * len(q) >= 2.0**62:  # sums over the batch would not fit
                    score = [int((x * y).sum()) for x, y in zip(np.split(q, np.cumsum(lengths)[:-1]), np.split(c, np.cumsum(lengths)[:-1]), strict=True)]
                else:
                    ends = np.cumsum(lengths)
                    score = total[ends] - total[ends - lengths]
            else:
                score = [max(-limit, min(limit, sum(a * b for a, b in zip(x, y, strict=True)))) for x, y in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(score, pa.int64())], names=["q", "cand", "first", "score"])

    return pairs.select("q", "cand", "first", "qv", "cv").mapInArrow(run, "q long, cand long, first long, score long")


def _first(rows: DataFrame, key: str, n: int, *order: Column | str) -> DataFrame:
    """The first ``n`` rows of each key; no more of a key leave a task."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def _read_in_order(rest: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(q, cand, first, score): the ``k`` best classes of each query, among survivors (q, cand, bound)."""
    of = lambda name, *more: vectors.select(F.col("cls").alias(name), F.col("v").alias(f"{name[0]}v"), *more)
    best, wave = None, WAVE
    while True:
        read = settle(_first(rest, "q", wave, F.desc("bound"), "cand"))
        scored = _scores(read.join(of("cand", F.col("ids")[0].alias("first")), "cand").join(of("q"), "q"))
        found = settle(_first(scored if best is None else best.unionByName(scored), "q", k, F.desc("score"), "first"))
        kth = found.groupBy("q").agg(F.when(F.count(F.lit(1)) >= k, 2.0 * F.min("score")).alias("kth"))
        place = F.struct((-F.col("bound")).alias("b"), F.col("cand").alias("c"))
        done = read.groupBy("q").agg(F.max(place).alias("done")).join(kth, "q")
        left = rest.join(done, "q").filter((place > F.col("done")) & (F.col("kth").isNull() | (F.col("bound") >= F.col("kth"))))
        left = settle(left.select("q", "cand", "bound"))
        for gone in (read, rest, best):
            if gone is not None:
                discard(gone)
        best, rest, wave = found, left, wave * 8
        if not rest.head(1):
            return best


def search(vectors: DataFrame, k: int = 20, scale: int = 64, every: int = 20, cells: int = 64, query_rows: int = 32_768, block_rows: int = 1 << 20) -> DataFrame:
    """(query_id, rank, vec_id, score) of ``vectors`` (vec_id, embedding): for every id that ``every`` divides, the ``k`` best of all other rows.

    ``cells`` is the most a component has (up to 250); a task of the scan holds ``query_rows`` queries and streams ``block_rows`` vectors."""
    good = quantised(vectors, scale).withColumn("h", F.unhex(F.sha2(F.array_join(F.col("v").cast("array<string>"), ","), 256)))
    asks = (F.col("id") % every == 0) & (F.col("id") != NULL_ID)
    ids = _first(good.select("h", "id"), "h", k + 1, "id").groupBy("h").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    known = good.groupBy("h").agg(F.first("v").alias("v"), F.count_if(asks).alias("n"))
    classes = settle(known.join(ids, "h").select("h", "v", "n", "ids", F.size("v").alias("dim"), F.monotonically_increasing_id().alias("cls")))
    # the smallest hashes of all vectors, at most SAMPLE of them and SAMPLE_BYTES of components
    about = classes.agg(F.coalesce(F.max("dim"), F.lit(0)), F.coalesce(F.max(F.greatest(F.coalesce(F.array_max("v"), F.lit(0)), -F.coalesce(F.array_min("v"), F.lit(0)))), F.lit(0)), F.count(F.lit(1))).first()
    taken = classes.orderBy("h").limit(max(64, min(SAMPLE, SAMPLE_BYTES // (8 * max(1, about[0]))))).select("v").toArrow()
    most = int(about[1])
    edges = cut_cells([np.array(v.values, np.int64) for v in taken.column(0)], cells)
    file = settle(_file(classes, edges, most))
    spread = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = classes.groupBy("dim").agg(F.count_if(F.col("n") > 0).alias("asked"), F.count(F.lit(1)).alias("all")).filter("asked > 0")
    parts = parts.select("dim", F.ceil(F.col("asked") / query_rows).alias("gs"), F.greatest(F.ceil(F.col("all") / block_rows), F.least(F.lit(spread), F.ceil(F.col("all") / 1024))).alias("js"))
    own = lambda n: F.pmod(F.xxhash64("cls"), n)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    queries = classes.filter("n > 0").join(parts, "dim").select("dim", own("gs").alias("g"), each("js").alias("j"), F.lit(0).alias("kind"), "cls", "v", F.lit(None).cast("binary").alias("codes"))
    stretch = file.join(parts, "dim").select("dim", each("gs").alias("g"), own("js").alias("j"), F.lit(1).alias("kind"), "cls", F.lit(None).cast("array<long>").alias("v"), "codes")
    tiles = queries.unionByName(stretch).repartition("dim", "g", "j").sortWithinPartitions("dim", "g", "j", "kind")
    kept = settle(_scan(tiles, edges, most, k + 1))
    lows = _first(kept.select("q", F.explode("lows").alias("low")), "q", k + 1, F.desc("low"))
    least = lows.groupBy("q").agg(F.when(F.count(F.lit(1)) > k, F.min("low")).alias("least"))
    rest = kept.join(least, "q").select("q", "least", F.inline(F.arrays_zip("cands", "bounds"))).filter("least IS NULL OR bounds >= least")
    best = _read_in_order(settle(rest.select("q", F.col("cands").alias("cand"), F.col("bounds").alias("bound"))), classes, k + 1)
    rows = best.join(classes.select(F.col("cls").alias("cand"), "ids"), "cand").select("q", "cand", "score", F.explode("ids").alias("id"))
    top = _first(rows, "q", k + 1, F.desc("score"), "id").groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "id", "cand"))).alias("top"))
    answers = settle(classes.filter("n > 0").select("h", "n", F.col("cls").alias("q")).join(top, "q"))
    out = spread_join(good.filter(asks).select("id", "h"), answers, ["h"])
    mine = F.array_position(F.transform("top", lambda x: (x["cand"] == F.col("q")) & (x["id"] == F.col("id"))), True) - 1
    others = out.select("id", F.slice(F.filter("top", lambda x, i: i != mine), 1, k).alias("top")).select("id", F.posexplode("top").alias("at", "x"))
    return others.select(F.col("id").alias("query_id"), (F.col("at") + 1).alias("rank"), F.when(F.col("x.id") != NULL_ID, F.col("x.id")).alias("vec_id"), (-F.col("x.less")).alias("score"))
