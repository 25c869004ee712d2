"""Repair of conversations whose turns are out of order, doubled, cut off or wrongly attributed.

A repaired conversation has the roles ``(s?(ua)+)?``: nothing, or one system turn at most and then pairs of user and
assistant.  A forward Viterbi pass over four grammar states (nothing yet, after system, after user, after assistant)
carries for each state the least (cost, audit string); a row's layer is closed by inserts, two of which reach every
state.  Costs follow from the audit, so of two audits of equal cost none begins the other, and the least string of a
prefix stays the least.

Rows are numbered by ranges, and a conversation is cut into stretches of ``stretch`` rows.  Each is passed from every
state that may come in, which gives a table of four by four; these are folded in order, which keeps back pointers and
the parts of the audits that still differ; and each stretch then repairs its own rows.  So no task holds a long
conversation, but its audit is one string of the result, and the hash of its repaired text is taken in one stream.

Defined results: a null role or text is one space, as is a null in the key that decides about damage; rows of one turn
go by role and text; a null conv_id is a conversation of its own, a null turn comes first; a role's initial is its first
character, whatever the role; an empty text is blank; an empty table gives no rows; other columns are dropped, so their
names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbatlas.llm.common import settle, spread_join
from verbatlas.llm.ordered import blocks, numbered, typed

#: Costs of the edits, by initial, and of an undeleted truncated row.
DELETE, INSERT, KEEP, REROLE, TRUNCATED = 3, 2, 0, 2, 1

#: Grammar states; what a role's initial leads to, and the one state that a user or assistant turn can lead to.
START, SYSTEM, USER, ASSISTANT = range(4)
KEPT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("a", USER): ASSISTANT, ("u", ASSISTANT): USER}
ONWARD = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}

#: White space of the contract.
SPACE = " \t\n\x0b\x0c\r"

#: Bytes of repaired text that a stretch hands on at a time.
PIECE = 1 << 20

Layer = list[tuple[int, str] | None]


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after damage by the CRC-32 of ``conv_id:turn``."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    marked = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), hit.alias("hit")).filter("hit <> 0")
    copies = F.array_repeat(F.lit(0), F.when(F.col("hit") == 3, 2).otherwise(1))
    return marked.select("conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def close(layer: Layer) -> Layer:
    """A layer with the inserts that may follow: a user turn, and then an assistant's."""

    def reach(to: int, sources: tuple[int, ...]) -> None:
        ways = [layer[to], *((layer[s][0] + INSERT, layer[s][1] + "I") if layer[s] else None for s in sources)]
        layer[to] = min((w for w in ways if w), default=None)

    reach(USER, (START, SYSTEM, ASSISTANT))
    reach(ASSISTANT, (USER,))
    return layer


def forward(rows: list[tuple[str, bool, bool]], start: int) -> Layer:
    """The least (cost, audit) that leads from ``start`` to each state over rows (initial, deleted, truncated)."""
    layer: Layer = [None] * 4
    layer[start] = (0, "")
    if start == START:
        close(layer)
    for initial, deleted, truncated in rows:
        new: Layer = [None] * 4

        def offer(to: int, cost: int, audit: str, new: Layer = new) -> None:
            if new[to] is None or (cost, audit) < new[to]:
                new[to] = (cost, audit)

        for state, way in enumerate(layer):
            if way is None:
                continue
            cost, audit = way
            offer(state, cost + DELETE, audit + "D")
            if not deleted:
                if (to := KEPT.get((initial, state))) is not None:
                    offer(to, cost + KEEP + TRUNCATED * truncated, audit + "K")
                offer(ONWARD[state], cost + REROLE + TRUNCATED * truncated, audit + "R")
        layer = close(new)
    return layer


def illegal(a: str, b: str) -> bool:
    return a + b not in ("su", "ua", "au")


def _stretches(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """A row a stretch: its faults, its first and last initial, and the table of costs and audits from state to state."""
    own = rows.select("conv_id", "seg", "idx", F.lit(1).alias("kind"), F.substring("role", 1, 1).alias("initial"), "blank", "cut")
    marks = marks.select("conv_id", "seg", "idx", F.lit(0).alias("kind"), F.lit("").alias("initial"), F.lit(False).alias("blank"), F.lit(False).alias("cut"))
    dealt = own.unionByName(marks).repartition("conv_id", "seg").sortWithinPartitions("conv_id", "seg", "idx", "kind")
    conv = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("conv_id").type
                yield batch

        def made() -> Iterator[tuple]:
            for (c, seg), held in blocks(seen(), (0, 1)):
                doubles = {r[2] for r in held if not r[3]}  # places of this stretch
                held = [r for r in held if r[3]]
                faults = ["blank" if r[5] else "duplicate" if r[2] in doubles else "truncated" if r[6] else "" for r in held]
                steps = [(r[4], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(held, faults, strict=True)]
                table = [way for start in range(4) for way in (forward(steps, start) if seg or start == START else [None] * 4)]
                bad = sum(illegal(a[4], b[4]) for a, b in zip(held, held[1:], strict=False))
                yield c, seg, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), bad, held[0][4], held[-1][4], [w and w[0] for w in table], [w and w[1] for w in table]

        whole = [(n, pa.int64()) for n in ("seg", "blank", "duplicate", "truncated", "illegal")]
        yield from typed(made(), lambda: [("conv_id", kind), *whole, ("first", pa.string()), ("last", pa.string()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])

    return dealt.mapInArrow(run, f"conv_id {conv}, seg long, blank long, duplicate long, truncated long, illegal long, first string, last string, costs array<long>, audits array<string>")


class Fold:
    """The stretches of one conversation in order: for each state the least cost and what its audit has beyond the common part, with back pointers."""

    def __init__(self):
        self.ways: Layer = [(0, ""), None, None, None]
        self.back: list[bytes] = []
        self.joints: list[int] = []
        self.last = None

    def add(self, first: str, last: str, costs: list, audits: list) -> None:
        new: Layer = [None] * 4
        came = bytearray(4)
        for a, way in enumerate(self.ways):
            for b in range(4) if way else ():
                if costs[4 * a + b] is not None:
                    whole = (way[0] + costs[4 * a + b], way[1] + audits[4 * a + b])
                    if new[b] is None or whole < new[b]:
                        new[b], came[b] = whole, a
        shared = len(commonprefix([w[1] for w in new if w]))
        self.ways = [w and (w[0], w[1][shared:]) for w in new]
        self.back.append(bytes(came))
        self.joints.append(int(self.last is not None and illegal(self.last, first)))
        self.last = last

    def steps(self) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(stretch, from state, to state, stretches, cost, whether the roles at its beginning clash)."""
        cost, _, state = min((*self.ways[s], s) for s in (START, ASSISTANT) if self.ways[s])
        for k in reversed(range(len(self.back))):
            came = self.back[k][state]
            yield k, came, state, len(self.back), cost, self.joints[k]
            state = came


def _chosen(stretches: DataFrame) -> DataFrame:
    """(conv_id, seg, came, went, segs, cost, joint) a stretch, on the cheapest way through its conversation."""
    dealt = stretches.select("conv_id", "seg", "first", "last", "costs", "audits").repartition("conv_id").sortWithinPartitions("conv_id", "seg")
    conv = stretches.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def made() -> Iterator[tuple]:
            nonlocal kind
            fold, own = None, None
            for batch in batches:
                kind = batch.schema.field("conv_id").type
                for c, seg, first, last, costs, audits in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                    if seg == 0:
                        if fold:
                            yield from ((own, *s) for s in fold.steps())
                        fold, own = Fold(), c
                    fold.add(first, last, costs, audits)
            if fold:
                yield from ((own, *s) for s in fold.steps())

        yield from typed(made(), lambda: [("conv_id", kind), *((n, pa.int64()) for n in ("seg", "came", "went", "segs", "cost", "joint"))])

    return dealt.mapInArrow(run, f"conv_id {conv}, seg long, came long, went long, segs long, cost long, joint long")


def _pieces(rows: DataFrame, ways: DataFrame) -> DataFrame:
    """Each stretch's repaired rows as (conv_id, seg, part, audit, piece, sha256): pieces of text, or the hash if the conversation is one stretch."""
    own = rows.select("conv_id", "seg", "idx", "role", "text", F.lit(None).cast("string").alias("audit"), F.lit(None).cast("long").alias("came"), F.lit(None).cast("long").alias("segs"))
    heads = ways.select("conv_id", "seg", F.lit(-1).cast("long").alias("idx"), F.lit("").alias("role"), F.lit("").alias("text"), "audit", "came", "segs")
    dealt = own.unionByName(heads).repartition("conv_id", "seg").sortWithinPartitions("conv_id", "seg", "idx")
    conv = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def made() -> Iterator[tuple]:
            nonlocal kind
            at = None
            for batch in batches:
                kind = batch.schema.field("conv_id").type
                for row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                    if row[2] < 0:
                        if at:
                            yield from at.finish()
                        at = Stretch(row[0], row[1], row[5], row[6], row[7])
                    else:
                        yield from at.add(row[3], row[4])
            if at:
                yield from at.finish()

        yield from typed(made(), lambda: [("conv_id", kind), ("seg", pa.int64()), ("part", pa.int64()), ("audit", pa.string()), ("piece", pa.binary()), ("sha256", pa.string())])

    return dealt.mapInArrow(run, f"conv_id {conv}, seg long, part long, audit string, piece binary, sha256 string")


class Stretch:
    """Writes the repaired rows of one stretch along its audit."""

    def __init__(self, conv, seg: int, audit: str, state: int, segs: int):
        self.conv, self.seg, self.audit, self.state = conv, seg, audit, state
        self.at, self.part, self.lines = 0, 0, 0
        self.hash = sha256() if segs == 1 else None
        self.held: list[bytes] = []
        self.size = 0

    def write(self, role: str, text: str) -> Iterator[tuple]:
        line = f"{chr(10) if self.lines else ''}{role}:{text}".encode()
        self.lines += 1
        if self.hash:
            self.hash.update(line)
            return
        self.held.append(line)
        self.size += len(line)
        if self.size > PIECE:
            yield self.row("")

    def row(self, audit: str) -> tuple:
        piece, self.held, self.size = b"".join(self.held), [], 0
        self.part += 1
        return self.conv, self.seg, self.part - 1, audit, piece, self.hash.hexdigest() if self.hash else None

    def inserts(self) -> Iterator[tuple]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at, self.state = self.at + 1, ONWARD[self.state]
            yield from self.write(ROLES[self.state], "")

    def add(self, role: str, text: str) -> Iterator[tuple]:
        yield from self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = KEPT[role[:1], self.state]
            yield from self.write(role, text)
        elif edit == "R":
            self.state = ONWARD[self.state]
            yield from self.write(ROLES[self.state], text)

    def finish(self) -> Iterator[tuple]:
        yield from self.inserts()
        yield self.row(self.audit)


def _joined(pieces: DataFrame) -> DataFrame:
    """(conv_id, audit, repaired_sha256): pieces are hashed as they stream by in order."""
    dealt = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "seg", "part")
    conv = pieces.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def made() -> Iterator[tuple]:
            nonlocal kind
            own, audits, text, begun, done = None, None, None, False, None
            for batch in batches:
                kind = batch.schema.field("conv_id").type
                for c, seg, part, audit, piece, whole in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                    if seg == 0 and part == 0:
                        if audits is not None:
                            yield own, "".join(audits), done or text.hexdigest()
                        own, audits, text, begun = c, [], sha256(), False
                    audits.append(audit)
                    done = whole
                    if piece:
                        if begun and part == 0:
                            text.update(b"\n")
                        text.update(piece)
                        begun = True
            if audits is not None:
                yield own, "".join(audits), done or text.hexdigest()

        yield from typed(made(), lambda: [("conv_id", kind), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    return dealt.mapInArrow(run, f"conv_id {conv}, audit string, repaired_sha256 string")


def repair(rows: DataFrame, damage: bool = True, stretch: int = 1024) -> DataFrame:
    """Per conv_id of ``rows`` (conv_id, turn, role, text): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    begun = damaged(rows) if damage else rows.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    trimmed = F.rtrim(F.col("text"), F.lit(SPACE))
    begun = begun.withColumns({"blank": trimmed == "", "cut": ~F.substring(trimmed, -1, 1).isin(".", "!", "?"), "same": F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))})
    placed = numbered(begun, "conv_id", ["turn", "role", "text"]).withColumn("seg", F.expr(f"idx div {stretch}"))
    again = placed.filter(~F.col("blank")).select(F.struct("conv_id").alias("c"), "same", "seg", "idx")
    seen = settle(again.groupBy("c", "same").agg(F.min("idx").alias("before"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    marks = spread_join(again, seen, ["c", "same"]).filter("idx > before").select("c.conv_id", "seg", "idx")
    stretches = settle(_stretches(placed, marks))
    chosen = settle(_chosen(stretches))
    key = lambda df: df.withColumn("c", F.struct("conv_id")).drop("conv_id")
    ways = key(chosen).join(key(stretches.select("conv_id", "seg", "audits")), ["c", "seg"])
    ways = ways.select("c.conv_id", "seg", "came", "segs", F.get("audits", (F.col("came") * 4 + F.col("went")).cast("int")).alias("audit"))
    texts = _joined(_pieces(placed, ways))
    turns = placed.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))
    faults = stretches.groupBy("conv_id").agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")))
    costs = chosen.groupBy("conv_id").agg(F.max("cost").alias("cost"), F.sum("joint").alias("joint"))
    every = rows.select("conv_id").distinct()
    for part in (turns, faults, costs, texts):
        every = every.unionByName(part, allowMissingColumns=True)
    whole = lambda c: F.coalesce(F.max(c), F.lit(0)).cast("long")
    return every.groupBy("conv_id").agg(
        whole("gaps").alias("gaps"), whole("blank").alias("blank"), whole("duplicate").alias("duplicate"), whole("truncated").alias("truncated"),
        (whole("illegal") + whole("joint")).alias("illegal"), whole("cost").alias("cost"),
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.lit(sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
