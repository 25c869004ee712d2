"""Facets, theme by month matrices, logs with corrections, events, and the second index over containers and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbatlas.functions.stats import round3
from verbatlas.functions.text import fold


def facet(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Distinct keys by folded value, shown in the most frequent spelling (ties alphabetical)."""
    spelt = rows.select(F.col(key).alias("k"), F.trim(value).alias("spelling"), fold(F.col(value)).alias("v")).filter("v <> ''")
    total = spelt.groupBy("v").agg(F.countDistinct("k").alias("count"))
    forms = spelt.groupBy("v", "spelling").agg(F.countDistinct("k").alias("n"))
    best = forms.groupBy("v").agg(F.min(F.struct((-F.col("n")).alias("n"), "spelling")).alias("b"))
    return total.join(best, "v").select(F.col("b.spelling").alias("value"), "count").orderBy(F.desc("count"), "value")


def period_matrix(rows: DataFrame, theme: str, period: Column, first: str, last: str, step: str = "interval 1 day") -> DataFrame:
    """Counts of every theme in every period from first to last, empty ones as 0."""
    spark = rows.sparkSession
    spine = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)), F.expr(step))).alias("period"))
    counts = rows.groupBy(F.col(theme).alias("theme"), period.alias("period")).agg(F.count(F.lit(1)).alias("n"))
    every = rows.select(F.col(theme).alias("theme")).distinct().crossJoin(F.broadcast(spine))  # themes x periods: the matrix itself
    return every.join(counts, ["theme", "period"], "left").select("theme", F.col("period").cast("string").alias("period"), F.coalesce("n", F.lit(0)).alias("n"))


def spans(rows: DataFrame, key: str, at: str) -> DataFrame:
    """Items, first and last day and number of days of each key."""
    day = F.to_date(F.col(at))
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("items"), F.min(day).cast("string").alias("first_day"), F.max(day).cast("string").alias("last_day"), F.countDistinct(day).alias("days"))


def last_rows(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key: a maximum, combined before the shuffle."""
    rest = [c for c in log.columns if c != key and c not in order]
    return log.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("m")).select(key, *[F.col(f"m.{c}").alias(c) for c in log.columns if c != key])


def undone(log: DataFrame) -> DataFrame:
    """Corrections without those that a later undo line of the same key names. ``log``: id, key, undoes, value."""
    undo = log.filter("undoes IS NOT NULL").select(F.col("undoes").alias("id"), "key", F.col("id").alias("by"))
    own = log.filter("undoes IS NULL")
    gone = own.join(undo, ["id", "key"]).filter("by > id").select("id", "key").distinct()
    return own.join(gone, ["id", "key"], "left_anti")


def key_then_path(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows joined to documents by key, else by path; a match by key is never displaced. rows: row_id, key, path; docs: doc, key, path."""
    by_key = rows.filter("key IS NOT NULL").join(docs.select("doc", "key"), "key").select("row_id", "doc", F.lit("key").alias("matched"))
    rest = rows.join(by_key.select("row_id").distinct(), "row_id", "left_anti")
    by_path = rest.join(docs.select("doc", "path"), "path").join(by_key.select("doc").distinct(), "doc", "left_anti")
    return by_key.unionByName(by_path.select("row_id", "doc", F.lit("path").alias("matched")))


def band_pairs(events: DataFrame, key: str, gap_s: int) -> DataFrame:
    """Pairs of one key's events at most ``gap_s`` seconds apart, joined on time bins: id_a < id_b."""
    s = F.unix_timestamp("ts")
    a = events.select(key, F.col("event_id").alias("id_a"), s.alias("sa"), F.explode(F.array(F.floor(s / gap_s) - 1, F.floor(s / gap_s), F.floor(s / gap_s) + 1)).alias("bin"))
    b = events.select(key, F.col("event_id").alias("id_b"), s.alias("sb"), F.floor(s / gap_s).alias("bin"))
    return a.join(b, [key, "bin"]).filter((F.col("id_a") < F.col("id_b")) & (F.abs(F.col("sa") - F.col("sb")) <= gap_s)).select("id_a", "id_b")


def threads(events: DataFrame) -> DataFrame:
    """Of each event, how many others its user has on the same day, and the first six of them."""
    day = events.withColumn("day", F.to_date("ts"))
    six = day.withColumn("r", F.row_number().over(Window.partitionBy("user_id", "day").orderBy("event_id"))).filter("r <= 7")
    first = six.groupBy("user_id", "day").agg(F.array_sort(F.collect_list("event_id")).alias("ids"))
    size = day.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("size"))
    out = day.join(first, ["user_id", "day"]).join(size, ["user_id", "day"])
    others = F.slice(F.filter("ids", lambda x: x != F.col("event_id")), 1, 6)
    return out.select("event_id", (F.col("size") - 1).alias("others"), F.array_join(others.cast("array<string>"), ",").alias("first_six"))


def majority(rows: DataFrame, group: str, theme: str, top: int = 5) -> DataFrame:
    """Themes that a third or more of a group's items carry, at most ``top`` of them."""
    total = rows.groupBy(group).agg(F.count(F.lit(1)).alias("total"))
    each = rows.groupBy(group, theme).agg(F.count(F.lit(1)).alias("n")).join(total, group).filter(F.col("n") * 3 >= F.col("total"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), theme))
    return each.withColumn("r", rank).filter(F.col("r") <= top).select(group, theme, "n")


#: Ids of one name that a row of ``name_pairs`` holds, about; all pairs that a row of two tiles makes are in memory at once.
TILE = 256


def name_pairs(names: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs of names with a Jaccard share of words of at least ``least``.  names: id, name.

    Names with the same words are one class, and classes are compared: two that are close share one of the rarest
    n - ceil(least * n) + 1 words of each, so only those are joined on, and a word that very many names hold brings no
    pairs.  All of a class are pairs among themselves.  Members are dealt into tiles of about ``TILE`` ids, and pairs of tiles are opened row by row
    in tasks as many as there are shuffle partitions, so no task holds more than a few tiles, however many share a name."""
    words = names.select("id", F.array_sort(F.array_distinct(F.split(fold(F.col("name")), " "))).alias("ws")).groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ws")))).alias("ws")).filter("size(ws) > 0")
    member = words.select("id", F.sha2(F.to_json(F.struct("ws")), 256).alias("k"), "ws")
    classes = member.groupBy("k").agg(F.first("ws").alias("ws"))  # equal in all of a class
    each = classes.select("k", F.explode("ws").alias("w"))
    often = each.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    listed = each.join(often, "w").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("n", "w"))).alias("ws"))
    listed = listed.select("k", F.transform("ws", lambda x: x["w"]).alias("ws"))
    rare = listed.select("k", F.explode(F.slice("ws", 1, F.size("ws") - F.ceil(F.size("ws") * F.lit(least)).cast("int") + 1)).alias("w"))
    met = rare.join(rare.select(F.col("k").alias("k2"), "w"), "w").filter("k < k2").select("k", "k2").distinct()
    both = met.join(listed, "k").join(listed.select(F.col("k").alias("k2"), F.col("ws").alias("ws2")), "k2").withColumn("c", F.size(F.array_intersect("ws", "ws2")))
    n, n2 = F.size("ws"), F.size("ws2")
    share = F.col("c") / (n + n2 - F.col("c"))
    close = both.filter(share >= least).select("k", "k2", round3(share).alias("jaccard"), round3(2 * F.col("c") / (n + n2)).alias("dice"))
    size = member.groupBy("k").agg(F.count(F.lit(1)).alias("m"))
    tile = F.pmod(F.xxhash64("id"), F.ceil(F.col("m") / TILE)).cast("int")
    ids = member.select("id", "k").join(size, "k").groupBy("k", "m", tile.alias("t")).agg(F.collect_list("id").alias("ids"))
    deal = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = ids.select("k", "t", "ids")
    b = ids.select(F.col("k").alias("k2"), F.col("t").alias("t2"), F.col("ids").alias("ids2"))
    # numbers of tiles meet first, then the ids of each; so many partitions whatever their bytes, as a row of a few KB makes millions
    met = close.join(a.select("k", "t"), "k").join(b.select("k2", "t2"), "k2")
    if least <= 1:
        own = size.filter("m > 1").select("k", F.col("k").alias("k2"), F.lit(1.0).alias("jaccard"), F.lit(1.0).alias("dice"))
        met = met.unionByName(own.join(a.select("k", "t"), "k").join(b.select("k2", "t2"), "k2").filter("t <= t2").select(*met.columns))
    tiles = met.join(a, ["k", "t"]).repartition(deal, "k2", "t2").join(b.repartition(deal, "k2", "t2"), ["k2", "t2"])
    within = (F.col("k") == F.col("k2")) & (F.col("t") == F.col("t2"))
    opened = tiles.select("ids2", F.explode("ids").alias("x"), within.alias("within"), "jaccard", "dice").select("x", F.explode("ids2").alias("y"), "within", "jaccard", "dice")
    return opened.filter(~F.col("within") | (F.col("x") < F.col("y"))).select(F.least("x", "y").alias("id"), F.greatest("x", "y").alias("id2"), "jaccard", "dice")


def coverage_order(records: DataFrame, terms: list[str], limit: int) -> DataFrame:
    """Records by the number of query words that they hold, then container and place."""
    held = sum(F.contains(F.lower("text"), F.lit(t)).cast("long") for t in terms)
    return records.withColumn("held", held).filter("held > 0").select("conv_id", "turn", "held").orderBy(F.desc("held"), "conv_id", "turn").limit(limit)


def record_position(records: DataFrame, at: int) -> DataFrame:
    """Per container: records, records at or before a place, greatest place."""
    return records.groupBy("conv_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("turn") <= at).alias("position"), F.max("turn").alias("last"))
