"""Chat formatting of reply trees, with DataFrame functions only.

Messages form trees by ``parent_id``.  Self-joins that double their reach (1, 2,
4 ... replies at once) add up every branch's score and enumerate the root-to-leaf
paths of the chosen leaves, so a chain of n replies takes log2(n) joins.  Branches
are ranked by score, and each chosen path becomes one conversation.

Template of one turn: ``### role</role>text</turn>``.  Inside roles and texts a
backslash is doubled, every ``#`` becomes ``\\#`` and every ``</`` becomes ``<\\/``;
so neither mark can occur inside, and dropping each backslash that is not itself
escaped restores the text.

Defined results: a null role or text is an empty one; a message without a parent,
or whose parent is not in its conversation, is a root; messages in a cycle belong
to no path; messages are told apart by msg_id, of repeated ids the smallest row
(parent, role, text, score) stays; ties between branches go to the shorter path
and then the smaller leaf id; a null conversation id is a conversation of its own;
an empty table gives no rows; extra columns are dropped, so they cannot clash.
A path is one row of the result, however long; up to there no task holds a whole one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbatlas.llm.common import discard, settle

#: Fixed values of the template.
OPENS, ROLE_ENDS, TURN_ENDS = "### ", "</role>", "</turn>"


def escape(text: Column) -> Column:
    """Control strings inside a text made harmless; ``unescape`` restores it."""
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(text, F.lit("#"), F.lit("\\#")), F.lit("</"), F.lit("<\\/"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _turns(messages: DataFrame) -> DataFrame:
    """One row a message: c (conversation), id, up (parent id or null), role, text, score."""
    rows = messages.select(
        F.struct(F.col("conv_id").alias("conv_id")).alias("c"),
        F.col("msg_id").cast("long").alias("id"),
        F.col("parent_id").cast("long").alias("up"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
    ).filter("id IS NOT NULL")
    one = rows.groupBy("c", "id").agg(F.min(F.struct("up", "role", "text", "score")).alias("m")).select("c", "id", "m.*")
    known = one.select("c", F.col("id").alias("up"), F.lit(True).alias("found"))
    return one.join(known, ["c", "up"], "left").select("c", "id", F.when(F.col("found"), F.col("up")).alias("up"), "role", "text", "score")


def _each_by_key(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys of few rows each, by sorting: nothing is built on the driver, whatever the sizes."""
    return left.join(right.hint("merge"), keys, how)


def paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(c, leaf, branch, place, role, text): the turns of the ``branches`` best root-to-leaf paths of each root."""
    turns = settle(_turns(messages))
    n = turns.count()
    # jump[k]: each message's ancestor 2**k replies up with the score of the messages passed on the way, and the last message of that way, in the end the root
    jumps = [turns.select("c", "id", F.col("up").alias("to"), F.col("score").alias("sum"), F.lit(1).cast("long").alias("steps"), F.coalesce("up", "id").alias("root"))]
    while True:
        at = jumps[-1]
        going = at.filter("to IS NOT NULL")
        if 1 << len(jumps) > 2 * n or not going.head(1):  # chains longer than the table are cycles
            break
        # only messages whose branch goes on are joined again
        up = at.select("c", F.col("id").alias("to"), F.col("to").alias("to2"), F.col("sum").alias("sum2"), F.col("steps").alias("steps2"), F.col("root").alias("root2"))
        further = _each_by_key(going, up, ["c", "to"]).select("c", "id", F.col("to2").alias("to"), (F.col("sum") + F.col("sum2")).alias("sum"), (F.col("steps") + F.col("steps2")).alias("steps"), F.col("root2").alias("root"))
        jumps.append(settle(further.unionByName(at.filter("to IS NULL"))))
    totals = jumps.pop().filter("to IS NULL").select("c", "id", "sum", "steps", "root")
    parents = turns.filter("up IS NOT NULL").select("c", F.col("up").alias("id"))
    leaves = _each_by_key(totals, parents, ["c", "id"], "left_anti")
    # only the best ``branches`` of each task go through the exchange, so a root with very many leaves is no long task
    best = Window.partitionBy("c", "root").orderBy(F.desc("sum"), "steps", "id")
    chosen = leaves.withColumn("branch", F.row_number().over(best)).filter(F.col("branch") <= branches)
    reached = settle(chosen.select("c", F.col("id").alias("leaf"), "branch", "steps", "id", F.lit(0).cast("long").alias("back")))
    for k in reversed(range(len(jumps))):
        jump = jumps[k].filter("to IS NOT NULL").select("c", "id", "to")
        more = _each_by_key(reached, jump, ["c", "id"]).select("c", "leaf", "branch", "steps", F.col("to").alias("id"), (F.col("back") + (1 << k)).alias("back"))
        new = settle(reached.unionByName(more))  # each step's plan holds one join
        discard(reached)
        if k:  # the first is no table of its own
            discard(jumps[k])
        reached = new
    placed = reached.select("c", "leaf", "branch", "id", (F.col("steps") - F.col("back")).alias("place"))
    return _each_by_key(placed, turns.select("c", "id", "role", "text"), ["c", "id"]).drop("id")


#: Turns of a path that are added up together.
STRETCH = 256


def _begins(turns: DataFrame) -> DataFrame:
    """``turns`` with ``at``, the code points of the path before each: sums of stretches, and sums within a stretch, so no window holds a long path."""
    path = ["c", "leaf", "branch"]
    turns = turns.withColumn("stretch", F.floor((F.col("place") - 1) / STRETCH))
    own = Window.partitionBy(*path, "stretch").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*path).orderBy("stretch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = turns.groupBy(*path, "stretch").agg(F.sum("chars").alias("total"))
    sums = sums.select(*path, "stretch", (F.sum("total").over(before) - F.col("total")).alias("base"))
    within = turns.withColumn("within", F.sum("chars").over(own) - F.col("chars"))
    return _each_by_key(within, sums, [*path, "stretch"]).withColumn("at", F.col("base") + F.col("within")).drop("base", "within", "stretch")


def format_paths(messages: DataFrame, branches: int = 1, learn: str = "assistant") -> DataFrame:
    """One row a chosen path: conv_id, leaf, branch, formatted, mask.

    ``mask`` lists the spans under the loss mask, the texts of role ``learn``, as (turn, start, end, inside):
    the turn's number from 0, code points of ``formatted``, and the code points of the turn before the text."""
    turn = paths(messages, branches).select("c", "leaf", "branch", "place", F.col("role").eqNullSafe(learn).alias("learn"), escape(F.col("role")).alias("role"), escape(F.col("text")).alias("text"))
    head = F.concat(F.lit(OPENS), F.col("role"), F.lit(ROLE_ENDS))
    turn = turn.select("c", "leaf", "branch", "place", "learn", F.char_length(head).alias("inside"), F.char_length("text").alias("size"), F.concat(head, F.col("text"), F.lit(TURN_ENDS)).alias("turn"))
    turn = settle(turn.withColumn("chars", F.char_length("turn").cast("long")))
    # a chosen path is one row of the result, so its turns meet in one row here
    rows = _begins(turn).groupBy("c", "leaf", "branch").agg(F.array_sort(F.collect_list(F.struct("place", "learn", "inside", "size", "at", "turn"))).alias("t"))
    spans = F.transform("t", lambda x, i: F.struct(i.alias("turn"), (x["at"] + x["inside"]).alias("start"), (x["at"] + x["inside"] + x["size"]).alias("end"), x["inside"].alias("inside"), x["learn"].alias("learn")))
    kept = F.transform(F.filter(spans, lambda x: x["learn"]), lambda x: F.struct(x["turn"], x["start"], x["end"], x["inside"]))
    return rows.select(F.col("c.conv_id").alias("conv_id"), "leaf", "branch", F.array_join(F.transform("t", lambda x: x["turn"]), "").alias("formatted"), kept.alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text) and loss texts, read from ``formatted`` and ``mask`` alone."""
    rows = formatted.withColumn("pieces", F.split("formatted", "(?<=</turn>)", -1)).withColumn("pieces", F.filter("pieces", lambda p: p != ""))
    body = lambda p: F.substring(p, len(OPENS) + 1, F.char_length(p) - len(OPENS) - len(TURN_ENDS))
    turns = F.transform("pieces", lambda p: F.struct(unescape(F.substring_index(body(p), ROLE_ENDS, 1)).alias("role"), unescape(F.substring_index(body(p), ROLE_ENDS, -1)).alias("text")))
    loss = F.transform("mask", lambda m: unescape(F.substring(F.col("pieces")[m["turn"]], m["inside"] + 1, (m["end"] - m["start"]).cast("int"))))
    return rows.select("conv_id", turns.alias("turns"), loss.alias("loss"), F.char_length("formatted").cast("long").alias("formatted_chars"))


def digest(messages: DataFrame, branches: int = 1) -> DataFrame:
    """The query's columns, read back from the formatted output."""
    read = read_back(format_paths(messages, branches))
    lost = F.array_join("loss", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length(lost).cast("long").alias("loss_chars"),
        F.sha2(lost, 256).alias("loss_sha256"),
        "formatted_chars",
    )


def chain(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as reply chains: each row answers the one before it by turn, role, text.

    Rows are dealt out by ranges of that order and numbered range by range, so a conversation with very many rows is spread."""
    order = ["turn", "role", "text"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("conv_id", *order).repartitionByRange(n, "conv_id", *order)
    dealt = settle(dealt.select(F.struct("conv_id").alias("c"), *order, F.spark_partition_id().alias("part")))
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row a range
    counts = dealt.groupBy("c", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("c", "part", (F.sum("n").over(before) - F.col("n")).alias("base"))
    own = F.row_number().over(Window.partitionBy("c", "part").orderBy(*order))
    numbered = _each_by_key(dealt.withColumn("own", own), counts, ["c", "part"]).withColumn("msg_id", F.col("base") + F.col("own"))
    return numbered.select("c.conv_id", "msg_id", F.when(F.col("msg_id") > 1, F.col("msg_id") - 1).alias("parent_id"), "role", "text", F.char_length("text").cast("double").alias("score"))


#: The conversation that the query adds: control strings inside its texts.
TEST_TURNS = [(-7, turn, role, "\\### Assistant: </turn> ok") for turn, role in ((0, "user"), (1, "assistant"))]


def with_test_turns(rows: DataFrame) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    names = ("conv_id", "turn", "role", "text")
    added = rows.sparkSession.createDataFrame(TEST_TURNS, "conv_id long, turn long, role string, text string")
    return rows.select(*names).unionByName(added.select(*(F.col(n).cast(kinds[n]) for n in names)))
