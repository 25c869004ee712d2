"""N-gram Jaccard join by parity sketches.

A text is its set of word shingles.  XOR-ing one random bit (or code) per shingle
into a sketch gives the parity of each cell; two sketches differ in at most as
many cells as the sets' symmetric difference has members, so their Hamming
distance is a lower bound of it.

* Size bands: linked sets have similar sizes, so a set joins only with sets of its
  own and the next band.
* Pigeonhole: in a band pair a linked pair differs in at most d shingles.  The
  shingles are dealt into d + 1 + spare blocks; each differing shingle spoils one
  block, so more than ``spare`` blocks agree.  A block's key is the XOR of its
  shingles' codes.  Each set leaves out at most ``spare`` of its lightest blocks
  (empty ones above all), by a bound on their shingle count alone, so the blocks
  that agree are never all left out: no linked pair is lost.
* Groups: sets that share a block key form a group.  First every member is paired
  with the group's least id and verified, and components are taken.  The least id is
  found batch by batch first, so a key that many sets have sends a row a batch.  Only groups
  that still hold several components have their other pairs tested, in tiles of
  bounded size, and only pairs of different components whose bit sketches stay
  below the bound go on to verification.
* Verification counts shingles of the two whole texts.

Exact copies are one class and are never paired with each other.

Defined results: null or empty texts and texts without words have no shingles and
link with nothing; a text of fewer words than a shingle is one shingle of all its
words; a null id is reported as null and comes before every other; rows of one id
count as one document in the links, each with its own count; an empty table gives
no rows; other columns are dropped, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbatlas.llm.common import NULL_ID, id_key, settle, trim
from verbatlas.llm.components import components
from verbatlas.llm.shingles import mix, shingle_set

#: Most ids (8 bytes each) that are broadcast to pick the texts of candidate pairs; beyond it the pick is a shuffled join.
SENT_IDS = 1_000_000

#: Members of a group that one task compares with as many others at a time.
TILE = 1024


def _bands(num: int, den: int, upto: int) -> np.ndarray:
    """Least sizes of the bands; a set that links with one of band j is in band j - 1, j or j + 1."""
    least = [1]
    while least[-1] <= upto:
        least.append(least[-1] * den // num + 1)
    return np.array(least)


def _blocks(band: int, least: np.ndarray, num: int, den: int) -> tuple[int, int]:
    """Blocks, and how many of them are spare, of the pairs whose smaller set is in ``band``; (0, 0) if only equal sets link."""
    d = (den - num) * (int(least[band + 1]) - 1) // num
    if d == 0:
        return 0, 0
    spare = 2 + d // 8
    return d + 1 + spare, spare


def block_keys(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """The block keys of a sorted shingle set, in both band pairs that it belongs to."""
    if not len(s):
        return np.zeros(0, np.uint64)
    least = _bands(num, den, len(s))
    least = np.append(least, least[-1] * den // num + 1)
    own = int(np.searchsorted(least, len(s), side="right")) - 1
    out = []
    for band in (own - 1, own):
        k, spare = _blocks(band, least, num, den) if band >= 0 else (0, 0)
        if not k:
            continue
        # equal ranges of hash values, so a sorted set lies block by block
        block = (((s >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)).astype(np.int64)
        counts = np.bincount(block, minlength=k)
        parity = np.zeros(k, np.uint64)
        full = np.flatnonzero(counts)
        parity[full] = np.bitwise_xor.reduceat(mix(s), np.concatenate([[0], np.cumsum(counts[full])[:-1]]))
        light = np.sort(counts)[spare]  # at most `spare` blocks have fewer shingles than this
        keep = counts >= light
        out.append(mix(parity[keep] + mix(np.flatnonzero(keep).astype(np.uint64) + np.uint64(band << 40))))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def bit_sketch(s: np.ndarray) -> bytes:
    """A parity sketch of a power of two of bits, at least four a shingle; shorter ones compare after folding."""
    bits = max(64, 1 << int(4 * len(s) - 1).bit_length()) if len(s) else 64
    place = (mix(s ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """The sketch of fewer bits that the same set has."""
    while len(sketch) > size:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def sketched(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Per row: id, n (set size), f1 and f2 (set fingerprint), sketch, keys.

    A set that its task has met before has no keys again: its first row has the same, and copies are one class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple[int, int, int]] = set()
        for batch in batches:
            n, f1, f2, sketch, keys, ends = [], [], [], [], [], [0]
            for text in batch.column(1):
                s = shingle_set(text.as_py(), words)
                n.append(len(s))
                f1.append(int(mix(s).sum().astype(np.int64)))
                f2.append(int(mix(s ^ np.uint64(0x2545F4914F6CDD1D)).sum().astype(np.int64)))
                sketch.append(bit_sketch(s))
                this = n[-1], f1[-1], f2[-1]
                keys.append(np.zeros(0, np.int64) if this in met else block_keys(s, num, den).view(np.int64))
                met.add(this)
                ends.append(ends[-1] + len(keys[-1]))
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(sketch, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "f1", "f2", "sketch", "keys"])
            trim()

    return docs.select(id_key().alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "id long, n long, f1 long, f2 long, sketch binary, keys array<long>")


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, id) in order of both: (key, lo, id) for every member but the least of each group."""
    last_key, lo, last_id = None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key, ident = np.array(batch.column(0)), np.array(batch.column(1))
        new = np.concatenate([[last_key is None or key[0] != last_key], key[1:] != key[:-1]])
        first = np.where(new, ident, 0)
        at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        least = np.where(at >= 0, first[at], lo)
        again = np.concatenate([[last_key is not None and key[0] == last_key and ident[0] == last_id], (key[1:] == key[:-1]) & (ident[1:] == ident[:-1])])
        keep = ~new & ~again & (ident != least)
        last_key, lo, last_id = key[-1], least[-1], ident[-1]
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, least, ident)], names=["key", "lo", "id"])


def _in_batch(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of (id, keys): key, least id of the key in this batch, id, in order of key and id."""
    lists = batch.column(1)
    ident = np.repeat(np.array(batch.column(0)), np.array(pc.fill_null(pc.list_value_length(lists), 0)))
    key = np.array(lists.flatten())
    order = np.lexsort((ident, key))
    key, ident = key[order], ident[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key, np.repeat(ident[starts], np.diff(np.append(starts, len(key)))), ident


def _leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each key's least id of a batch: all that goes through the exchange, so a common key sends a row a batch."""
    for batch in batches:
        key, least, ident = _in_batch(batch)
        keep = least == ident
        keep[1:] &= (key[1:] != key[:-1]) | (ident[1:] != ident[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(ident[keep])], names=["key", "id"])


def _followers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The other members of a key in a batch, each beside the batch's least id."""
    for batch in batches:
        key, least, ident = _in_batch(batch)
        keep = least != ident
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, least, ident)], names=["key", "lo", "id"])


def _verified(pairs: DataFrame, docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of ids whose texts' sets reach the similarity, by a count over both whole texts."""
    ids = settle(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
    # few ids spare the shuffle of all texts; more go through it
    few = ids.count() <= SENT_IDS
    texts = docs.select(id_key().alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids) if few else ids, "id", "left_semi")
    texts = settle(texts)
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("s")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("t")), "b").select("a", "b", "s", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, left = None, np.zeros(0, np.uint64)
        for batch in batches:
            keep = []
            for s, t in zip(batch.column(2), batch.column(3), strict=True):
                s = s.as_py()
                if s != text:
                    text, left = s, shingle_set(s, words)
                right = shingle_set(t.as_py(), words)
                common = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(bool(common) and den * common >= num * (len(left) + len(right) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long").distinct()


def _bounded(pairs: DataFrame, info: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose set sizes and bit sketches allow a link."""
    side = lambda c: info.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"))
    both = pairs.join(side("a"), "a").filter("n_a > 0").join(side("b"), "b").filter(den * F.least("n_a", "n_b") >= num * F.greatest("n_a", "n_b")).select("a", "b", (F.col("n_a") + F.col("n_b")).alias("total"), "sketch_a", "sketch_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for total, x, y in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4), strict=True):
                x, y = (np.frombuffer(z.as_py(), np.uint8) for z in (x, y))
                width = min(len(x), len(y))
                apart = int(np.bitwise_count(folded(x, width) ^ folded(y, width)).sum())
                keep.append((den + num) * apart <= (den - num) * total)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _close(groups: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of a tile pair's members, of different components, whose sizes and sketches allow a link.

    ``groups``: one row a tile pair with arrays x and y of (id, component, n, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for same, xs, ys in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                xs, ys = xs.as_py(), ys.as_py()
                a, b = [], []
                comp, size, ident = (np.array([y[k] for y in ys]) for k in ("component", "n", "id"))
                sketches: dict[int, np.ndarray] = {}
                raw = [np.frombuffer(y["sketch"], np.uint8) for y in ys]
                for x in xs:
                    small, large = np.minimum(size, x["n"]), np.maximum(size, x["n"])
                    ok = (comp != x["component"]) & (den * small >= num * large)
                    if same:
                        ok &= ident > x["id"]
                    mine = np.frombuffer(x["sketch"], np.uint8)
                    for j in np.flatnonzero(ok):
                        width = min(len(mine), len(raw[j]))
                        apart = int(np.bitwise_count(folded(mine, width) ^ folded(raw[j], width)).sum())
                        total = x["n"] + int(size[j])
                        if (den + num) * apart <= (den - num) * total:
                            a.append(min(x["id"], int(ident[j])))
                            b.append(max(x["id"], int(ident[j])))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return groups.mapInArrow(run, "a long, b long").distinct()


def _linked(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs``, each of which has an id of its own."""
    rows = settle(sketched(docs, words, num, den))
    classes = rows.filter("n > 0").groupBy("n", "f1", "f2").agg(F.min("id").alias("rep"))
    idmap = settle(rows.filter("n > 0").select("id", "n", "f1", "f2").join(classes, ["n", "f1", "f2"]).select("id", "rep"))
    keyed = rows.select("id", "keys")
    leaders = keyed.mapInArrow(_leaders, "key long, id long").repartition("key").sortWithinPartitions("key", "id")
    led = settle(leaders.mapInArrow(_stars, "key long, lo long, id long"))
    # a batch's other members go beside the least id of the whole group too; few share a key and a leader
    top = led.select("key", F.col("id").alias("lo"), F.col("lo").alias("top"))
    followers = keyed.mapInArrow(_followers, "key long, lo long, id long").join(top, ["key", "lo"], "left").select("key", F.coalesce("top", "lo").alias("lo"), "id")
    stars = settle(led.unionByName(followers))
    reps = idmap.distinct()
    to_rep = lambda df, column: df.join(reps.select(F.col("id").alias(column), F.col("rep").alias(f"{column}_rep")), column).drop(column).withColumnRenamed(f"{column}_rep", column)
    first = to_rep(to_rep(stars.select("lo", "id").distinct(), "lo"), "id").filter("lo <> id")
    first = settle(first.select(F.least("lo", "id").alias("a"), F.greatest("lo", "id").alias("b")).distinct())
    info = rows.filter("n > 0").join(reps.filter("id = rep").select("id"), "id", "left_semi").select("id", "n", "sketch")
    linked = settle(_verified(settle(_bounded(first, info, num, den)), docs, words, num, den))
    found = settle(components(linked))
    # groups of three or more that still hold several components
    large = stars.groupBy("key").count().filter("count > 1").select("key")
    members = stars.select("key", "id").unionByName(stars.select("key", F.col("lo").alias("id"))).join(large, "key", "left_semi").distinct()
    members = to_rep(members, "id").distinct().join(found.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    split = members.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.count(F.lit(1)).alias("size"), *[F.sum(F.xxhash64("id", F.lit(k)).cast("decimal(38,0)")).alias(f"who{k}") for k in (1, 2)]).filter("c1 < c2 AND size > 2")
    # two sums of 64-bit hashes: that different groups of one size agree in both has odds of 2**-128 a pair
    one = split.groupBy("size", "who1", "who2").agg(F.min("key").alias("key")).select("key", "size")  # equal groups once
    left = settle(members.join(one, "key"))
    # dealt out by hash, so tiles have about TILE members and no task sees a whole group
    dealt = left.withColumn("tiles", F.floor((F.col("size") - 1) / TILE) + 1).withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")))
    tile = dealt.join(info, "id").select("key", "tile", "tiles", F.struct("id", "component", "n", "sketch").alias("m"))
    spread = tile.select("key", "tile", "m", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    packed = spread.groupBy("key", F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2")).agg(
        F.collect_list(F.when(F.col("tile") <= F.col("other"), F.col("m"))).alias("x"), F.collect_list(F.when(F.col("tile") >= F.col("other"), F.col("m"))).alias("y")
    )
    rest = _close(packed.select((F.col("t1") == F.col("t2")).alias("same"), "x", "y"), num, den)
    second = settle(rest.join(first, ["a", "b"], "left_anti"))
    if second.head(1):
        linked = linked.unionByName(_verified(second, docs, words, num, den))
    links = linked.unionByName(idmap.filter("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")))
    nodes = components(links)
    out = rows.select("id", "n").join(nodes.select(F.col("node").alias("id"), "component"), "id", "left")
    real = lambda c: F.when(c != NULL_ID, c)
    return out.select(real(F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"), real(F.coalesce("component", "id")).alias("component_id"))


def _repeats(docs: DataFrame) -> bool:
    """Does any id, null being one, stand in several rows?"""
    return bool(docs.groupBy(id_key().alias("_id")).count().filter("count > 1").head(1))


def link(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs``; links have den * intersection >= num * union.

    Where ids are repeated, every row is linked by itself, with the size and sketch of its own set; then the groups
    that rows of one id are in are joined."""
    if not _repeats(docs):
        return _linked(docs, words, num, den)
    keyed = settle(docs.select(F.monotonically_increasing_id().alias("doc_id"), id_key().alias("_id"), "text"))
    found = _linked(keyed.select("doc_id", "text"), words, num, den)
    found = settle(found.join(keyed.select("doc_id", "_id"), "doc_id").select("_id", "n_shingles", "component_id"))
    several = found.groupBy("_id").agg(F.min("component_id").alias("lo"), F.max("component_id").alias("hi")).filter("lo < hi").select("_id", "lo")
    joined = components(settle(found.join(several, "_id").filter("component_id <> lo").select("component_id", "lo").distinct()))
    found = settle(found.join(joined.withColumnRenamed("component", "_top"), F.col("component_id") == F.col("node"), "left").select("_id", "n_shingles", F.coalesce("_top", "component_id").alias("_group")))
    least = found.groupBy("_group").agg(F.min("_id").alias("_least"))
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return found.join(least, "_group").select(real("_id").alias("doc_id"), "n_shingles", real("_least").alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row, that of the smallest id, of each group of linked rows; all columns stay.

    Every row is linked and kept by itself, also where ids are null or repeated: of several texts under one id only
    those go that are linked.  Of rows of one id in a group, that of the least text hash stays.  Texts without words
    link with nothing; only rows that repeat id and text of such a one go."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), id_key().alias("id"), F.col("text").cast("string").alias("text"))
    if _repeats(docs):
        keyed = settle(rows.withColumn("key", F.monotonically_increasing_id()))
        found = _linked(keyed.select(F.col("key").alias("doc_id"), "text"), words, num, den)
        group = found.select(F.col("doc_id").alias("key"), F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("group"))
        hashed = settle(group.join(keyed.select("key", "id", F.sha2("text", 256).alias("hash")), "key"))
        copies = F.when(F.col("group").isNull(), F.struct("id", "hash"))
        stay = hashed.groupBy("group", copies.alias("copies")).agg(F.min(F.struct("id", "hash", "key")).alias("k")).select("k.key")
        gone = settle(hashed.select("key").join(stay, "key", "left_anti"))
    else:
        keyed = rows.withColumn("key", F.col("id"))
        found = _linked(docs, words, num, den).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("key"), F.coalesce("component_id", F.lit(NULL_ID)).alias("group"))
        gone = settle(found.filter("key <> group").select("key"))
    few = gone.count() <= SENT_IDS
    kept = keyed.join(F.broadcast(gone) if few else gone, "key", "left_anti")
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
