"""The topic layer over documents, and lasting events: corrections, joins, facets, listings and merge chains as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbatlas.functions.text import fold
from verbatlas.sources.scratch import written

# --- logs and corrections ---


def fold_sets(base: DataFrame, patches: DataFrame) -> DataFrame:
    """Sets after add and remove lines: (key, value) rows.  base: key, value; patches: key, line, op, value.

    Of each value only its last line counts, and a value without a line is as in ``base``; so a maximum by key and
    value, combined before the exchange, does, however long a key's log is.  Of two lines with one number, remove counts."""
    last = patches.groupBy("key", "value").agg(F.max(F.struct("line", "op")).alias("last"))
    both = base.select("key", "value", F.lit(True).alias("had")).distinct().join(last, ["key", "value"], "full")
    return both.filter(F.coalesce(F.col("last.op") == "add", F.col("had"))).select("key", "value")


def corrected(rows: DataFrame, corrections: DataFrame) -> DataFrame:
    """Tag rows (key, themes) after corrections (key, line, replaces array, op, value) in the order of lines.

    A line that replaces sets the whole list; later add and remove lines change it.  Lines before the last
    replacement do not count.  Values are compared under fold; the list keeps its order and adds at the end."""
    whole = corrections.filter("replaces IS NOT NULL").groupBy("key").agg(F.max(F.struct("line", "replaces")).alias("w")).select("key", "w.line", "w.replaces")
    later = corrections.filter("op IS NOT NULL").join(whole.select("key", F.col("line").alias("after")), "key", "left").filter("after IS NULL OR line > after")
    value = fold(F.col("value"))
    last = later.groupBy("key", value.alias("v")).agg(F.max(F.struct("line", "op", "value")).alias("last"), F.min("line").alias("first"))
    base = rows.join(whole, "key", "left").select("key", F.posexplode(F.coalesce("replaces", "themes", F.array().cast("array<string>"))).alias("at", "shown"))
    base = base.groupBy("key", fold(F.col("shown")).alias("v")).agg(F.min(F.struct("at", "shown")).alias("b"))
    both = base.join(last, ["key", "v"], "full").filter(F.coalesce(F.col("last.op") == "add", F.lit(True)))
    shown = both.select("key", F.struct(F.coalesce("b.at", F.lit(1 << 30)).alias("at"), F.coalesce("last.line", F.lit(0).cast("long")).alias("line"), F.coalesce("b.shown", "last.value").alias("shown")).alias("x"))
    lists = shown.groupBy("key").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return rows.select("key").join(lists, "key", "left").select("key", F.coalesce(F.transform("xs", lambda x: x["shown"]), F.array().cast("array<string>")).alias("themes"))


def valid_undo(log: DataFrame) -> DataFrame:
    """Undo lines (id, key, undoes) that count: they name an earlier correction of the same key that no earlier undo has named."""
    undo = log.filter("undoes IS NOT NULL").select("id", "key", "undoes")
    named = log.filter("undoes IS NULL").select(F.col("id").alias("undoes"), "key")
    real = undo.join(named, ["undoes", "key"], "left_semi").filter("undoes < id")
    return real.groupBy("undoes", "key").agg(F.min("id").alias("id"))


def correction_list(log: DataFrame) -> DataFrame:
    """Corrections (id, key, value, undoes), newest first, with whether each can be undone, and why not: undone, or not the last of its key and value."""
    gone = valid_undo(log).select(F.col("undoes").alias("id"), F.lit(True).alias("undone"))
    own = log.filter("undoes IS NULL").join(gone, "id", "left")
    last = own.filter("undone IS NULL").groupBy("key", "value").agg(F.max("id").alias("last"))
    out = own.join(last, ["key", "value"], "left")
    why = F.when(F.col("undone"), "undone").when(F.col("id") != F.col("last"), "not the last change")
    return out.select("id", "key", "value", why.isNull().alias("undoable"), why.alias("why_not")).orderBy(F.desc("id"))


# --- tag rows and documents ---


def join_report(rows: DataFrame, docs: DataFrame, joined: DataFrame, sample: int = 5) -> DataFrame:
    """One row: rows matched by key and by path, unmatched ones with the first few of their ids, and documents with tags.

    ``joined``: row_id, doc, matched, of ``topics.key_then_path``."""
    by = lambda how: F.count_distinct(F.when(F.col("matched") == how, F.col("row_id")))
    matched = joined.agg(by("key").alias("by_key"), by("path").alias("by_path"), F.count_distinct("doc").alias("tagged"))
    missing = rows.join(joined.select("row_id").distinct(), "row_id", "left_anti")
    first = missing.orderBy("row_id").limit(sample).agg(F.array_join(F.array_sort(F.collect_list("row_id")).cast("array<string>"), ",").alias("sample"))
    return matched.crossJoin(missing.agg(F.count(F.lit(1)).alias("unmatched"))).crossJoin(first).crossJoin(docs.agg(F.count(F.lit(1)).alias("documents")))


def mentioned_documents(mentions: DataFrame, docs: DataFrame, joined: DataFrame) -> DataFrame:
    """Mentioned keys as documents: by the document's own source key, else by the row that a path joined; the first path counts.

    mentions: key; docs: doc, key, path; joined: row key (row_key) and doc."""
    direct = docs.filter("key IS NOT NULL").groupBy("key").agg(F.min_by("doc", "path").alias("d1"))
    placed = joined.join(docs.select("doc", "path"), "doc").groupBy(F.col("row_key").alias("key")).agg(F.min_by("doc", "path").alias("d2"))
    return mentions.join(direct, "key", "left").join(placed, "key", "left").select("key", F.coalesce("d1", "d2").alias("doc"))


# --- facets ---


def facet(rows: DataFrame, key: str, values: Column, top: int = 0, months: bool = False) -> DataFrame:
    """Documents by folded value of an array column, each once a value: value (most frequent spelling, ties alphabetical), count.

    Largest first, ties by value; months in their own order.  ``top`` 0 keeps all."""
    each = rows.select(F.col(key).alias("k"), F.explode(values).alias("raw")).select("k", F.trim("raw").alias("spelling"), fold(F.col("raw")).alias("v")).filter("v <> ''").distinct()
    total = each.groupBy("v").agg(F.count_distinct("k").alias("count"))
    forms = each.groupBy("v", "spelling").agg(F.count(F.lit(1)).alias("n"))
    best = forms.groupBy("v").agg(F.min(F.struct((-F.col("n")).alias("less"), "spelling")).alias("b"))
    out = total.join(best, "v").select(F.col("b.spelling").alias("value"), "count")
    out = out.orderBy("value") if months else out.orderBy(F.desc("count"), "value")
    return out.limit(top) if top else out


def modes(rows: DataFrame, key: str, value: str, doc: str) -> DataFrame:
    """Of each key the value that most documents give it, ties by name: entity types, event names."""
    n = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count_distinct(doc).alias("n"))
    return n.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("less"), F.col(value).alias("value"))).alias("m")).select(key, F.col("m.value").alias(value))


def event_facet(rows: DataFrame, whole: DataFrame, floor: int, records: DataFrame | None = None) -> DataFrame:
    """Events of the selected ``rows`` that have ``floor`` items or more in the ``whole`` corpus: event, name, count.

    Named by their record, else by the most frequent name in the layer.  rows and whole: doc, event, event_name."""
    large = whole.groupBy("event").agg(F.count_distinct("doc").alias("size")).filter(F.col("size") >= floor)
    counts = rows.filter("event IS NOT NULL").groupBy("event").agg(F.count_distinct("doc").alias("count")).join(large.select("event"), "event", "left_semi")
    named = counts.join(modes(whole, "event", "event_name", "doc"), "event", "left")
    if records is not None:
        named = named.join(records.select(F.col("id").alias("event"), F.col("name").alias("record_name")), "event", "left").withColumn("event_name", F.coalesce("record_name", "event_name"))
    return named.select("event", F.col("event_name").alias("name"), "count").orderBy(F.desc("count"), "event")


def tagged_counts(docs: DataFrame) -> DataFrame:
    """One row: documents with tags, and those about AI and not."""
    return docs.agg(F.count_if(F.col("themes").isNotNull()).alias("tagged"), F.count_if(F.col("ai")).alias("ai_true"), F.count_if(~F.col("ai")).alias("ai_false"))


def fill_names(rows: DataFrame) -> DataFrame:
    """doc, event, event_name with missing names taken from the most frequent one of the event."""
    best = modes(rows, "event", "event_name", "doc").withColumnRenamed("event_name", "usual")
    return rows.join(best, "event", "left").select("doc", "event", F.coalesce("event_name", "usual").alias("event_name"))


def theme_months(rows: DataFrame, first: str, last: str, most: int = 1800) -> DataFrame:
    """theme, month, n over every month from first to last, zeros too, with totals: theme null for a month's, month null for a theme's, both for all.

    rows: doc, theme, month (yyyy-MM).  A document counts once a cell and once in each total."""
    spine = spine_of(rows.sparkSession, first, last, most)
    inside = rows.filter(F.col("month").between(first, last)).select("doc", "theme", "month").distinct()
    cells = inside.groupBy("theme", "month").agg(F.count_distinct("doc").alias("n"))
    every = rows.select("theme").distinct().crossJoin(F.broadcast(spine))  # the matrix itself; at most ``most`` months
    full = every.join(cells, ["theme", "month"], "left")
    by_month = spine.join(inside.groupBy("month").agg(F.count_distinct("doc").alias("n")), "month", "left").select(F.lit(None).cast("string").alias("theme"), "month", "n")
    by_theme = rows.select("theme").distinct().join(inside.groupBy("theme").agg(F.count_distinct("doc").alias("n")), "theme", "left").select("theme", F.lit(None).cast("string").alias("month"), "n")
    total = inside.agg(F.count_distinct("doc").alias("n")).select(F.lit(None).cast("string").alias("theme"), F.lit(None).cast("string").alias("month"), "n")
    return full.unionByName(by_month).unionByName(by_theme).unionByName(total).withColumn("n", F.coalesce("n", F.lit(0)))


def spine_of(spark, first: str, last: str, most: int = 1800) -> DataFrame:
    """Every month from first to last; more than ``most`` are refused."""
    n = (int(last[:4]) - int(first[:4])) * 12 + int(last[5:7]) - int(first[5:7]) + 1
    if not 1 <= n <= most:
        raise ValueError(f"{n} months; 1 to {most} are allowed")
    return spark.range(n).select(F.date_format(F.add_months(F.lit(f"{first}-01").cast("date"), F.col("id").cast("int")), "yyyy-MM").alias("month"))


# --- lasting events ---


def resolve_chains(links: DataFrame) -> DataFrame:
    """(id, root): the end of each id's ``into`` chain, by doubling joins, so a chain of n takes log2(n) of them; ids whose end is found leave.

    A link to an unknown id counts as none; ids on a cycle, and those that lead to one, keep themselves."""
    ids = links.select("id").distinct()
    known = links.join(ids.select(F.col("id").alias("into")), "into", "left_semi").filter("id <> into").groupBy("id").agg(F.min("into").alias("to"))
    at = ids.join(known, "id", "left").select("id", F.coalesce("to", "id").alias("to"), F.col("to").isNotNull().alias("moved"))
    found = written(at.filter("NOT moved").select("id", F.col("id").alias("root")))
    left = written(at.filter("moved").select("id", "to"))
    while left.head(1):  # each step's plan holds what was written by the ones before
        met = left.join(found.select(F.col("id").alias("to"), "root"), "to", "left")
        new = written(met.filter("root IS NOT NULL").select("id", "root"))
        if not new.head(1):  # of ways that end, the shortest left would have ended now: all that are left lead to cycles
            return found.unionByName(left.select("id", F.col("id").alias("root")))
        found = found.unionByName(new)
        rest = met.filter("root IS NULL").select("id", "to")
        left = written(rest.join(left.select(F.col("id").alias("to"), F.col("to").alias("to2")), "to").select("id", F.col("to2").alias("to")))
    return found


def claims(records: DataFrame) -> DataFrame:
    """Monthly ids (member) with the first record, by id, that holds each, and the later ones that claim it as well."""
    each = records.select("id", F.explode("members").alias("member")).distinct()
    return each.groupBy("member").agg(F.min("id").alias("record"), F.array_sort(F.collect_list("id")).alias("ids")).select("member", "record", F.array_join(F.slice("ids", 2, F.greatest(F.size("ids") - 1, F.lit(0))), ",").alias("refused"))


def lasting(rows: DataFrame, records: DataFrame, event: str = "event") -> DataFrame:
    """``rows`` with ``record``: the event id as a member's record, or a record's own, after merges; unknown ids stay."""
    roots = resolve_chains(records.select("id", F.col("merged_into").alias("into")))
    held = claims(records).select(F.col("member").alias(event), "record")
    named = rows.join(held, event, "left").withColumn("id", F.coalesce("record", event)).drop("record").join(roots, "id", "left")
    return named.withColumn("record", F.coalesce("root", "id")).drop("id", "root")


def combined(records: DataFrame) -> DataFrame:
    """Records that are not merged away, with the span and aliases of all that are merged into them.

    The span runs from the least start to the greatest end (a start alone is an end as well).  Names and aliases of the
    merged ones follow in order of ids; what is equal under fold to the name or to an earlier alias is left out."""
    roots = resolve_chains(records.select("id", F.col("merged_into").alias("into")))
    each = records.join(roots, "id")
    last = F.coalesce("end", "start")
    spans = each.groupBy("root").agg(F.min("start").alias("start"), F.max(last).alias("end"), F.array_sort(F.collect_list(F.when(F.col("id") != F.col("root"), F.col("id")))).alias("merged"))
    own = F.col("id") == F.col("root")
    none = F.array().cast("array<string>")
    words = F.concat(F.when(own, none).otherwise(F.array("name")), F.coalesce("aliases", none))
    # (own first, record, place): the first of each folded spelling stays
    spelt = each.select("root", own.alias("own"), "id", F.posexplode(words).alias("at", "alias")).filter(F.trim("alias") != "")
    first = spelt.groupBy("root", fold(F.col("alias")).alias("v")).agg(F.min(F.struct((~F.col("own")).alias("later"), "id", "at", F.trim("alias").alias("alias"))).alias("a"))
    names = records.select(F.col("id").alias("root"), fold(F.col("name")).alias("v"))
    kept = first.join(names, ["root", "v"], "left_anti").groupBy("root").agg(F.array_sort(F.collect_list("a")).alias("xs"))
    out = records.select(F.col("id").alias("root"), "name", "removed").join(spans, "root").join(kept, "root", "left")
    return out.select(F.col("root").alias("id"), "name", "start", "end", F.array_join(F.transform("xs", lambda x: x["alias"]), "|").alias("aliases"), F.array_join("merged", ",").alias("merged_from"), F.col("removed").isNotNull().alias("removed"))


def events_listing(items: DataFrame, records: DataFrame, least: int = 0, hidden: bool = False) -> DataFrame:
    """Events with items, items by month ("2016-06:2,..."), first and last day, undated items, and the record's data; most items first, then id.

    items: doc, event (resolved), day (or null).  Records without items stay while ``least`` is 0; merged and removed
    ones only with ``hidden``."""
    month = F.substring("day", 1, 7)
    counts = items.groupBy("event").agg(F.count_distinct("doc").alias("items"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count_if(F.col("day").isNull()).alias("undated"))
    months = items.filter("day IS NOT NULL").groupBy("event", month.alias("month")).agg(F.count_distinct("doc").alias("n"))
    months = months.groupBy("event").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("month", "n"))), lambda x: F.concat_ws(":", x["month"], x["n"])), ",").alias("months"))
    known = records.select(F.col("id").alias("event"), "name", "start", "end", (F.col("merged_into").isNotNull() | F.col("removed").isNotNull()).alias("gone"))
    both = counts.join(months, "event", "left").join(known, "event", "full").withColumn("items", F.coalesce("items", F.lit(0).cast("long")))
    kept = both.filter(F.col("items") >= least)
    kept = kept if hidden else kept.filter(~F.coalesce("gone", F.lit(False)))
    return kept.select("event", "name", "items", "months", "first_day", "last_day", F.coalesce("undated", F.lit(0)).alias("undated"), "start", "end").orderBy(F.desc("items"), "event")


def item_events(items: DataFrame, ops: DataFrame, records: DataFrame) -> DataFrame:
    """(doc, event) after all: the item's own and listed events, resolved, then add and remove lines in order; removed records are left out.

    items: doc, events array; ops: doc, line, op, event."""
    base = lasting(items.select("doc", F.explode("events").alias("event")), records).select(F.col("doc").alias("key"), F.col("record").alias("value"))
    patches = lasting(ops, records).select(F.col("doc").alias("key"), "line", "op", F.col("record").alias("value"))
    gone = records.filter("removed IS NOT NULL").select(F.col("id").alias("value"))
    return fold_sets(base, patches).join(gone, "value", "left_anti").select(F.col("key").alias("doc"), F.col("value").alias("event"))


def unmerge_preview(items: DataFrame, records: DataFrame, away: str) -> DataFrame:
    """One row: items of the record that comes back, of the one that it leaves, of both, and of that one now, if ``away`` is no longer merged."""
    now = lasting(items, records)
    split = lasting(items, records.withColumn("merged_into", F.when(F.col("id") != away, F.col("merged_into"))))
    kept = resolve_chains(records.select("id", F.col("merged_into").alias("into"))).filter(F.col("id") == away).first().root
    docs = split.filter(F.col("record").isin(away, kept)).groupBy("doc").agg(F.max(F.col("record") == away).alias("back"), F.max(F.col("record") == kept).alias("stay"))
    out = docs.agg(F.count_if("back").alias("returning"), F.count_if("stay").alias("kept"), F.count_if(F.col("back") & F.col("stay")).alias("both"))
    return out.crossJoin(now.filter(F.col("record") == kept).agg(F.count_distinct("doc").alias("kept_now")))


def seed_plan(items: DataFrame, records: DataFrame) -> DataFrame:
    """Monthly events (event, name) that no record holds, with the first and last date of their items: what new records are made from."""
    held = claims(records).select(F.col("member").alias("event"))
    return items.join(held, "event", "left_anti").groupBy("event").agg(F.min_by("name", "doc").alias("name"), F.min("day").alias("start"), F.max("day").alias("end"), F.count_distinct("doc").alias("items")).orderBy("event")


def merge_states(log: DataFrame, undone: DataFrame, records: DataFrame) -> DataFrame:
    """Merge lines (id, a, b) with their state by record a: in effect, not applied, other, or undone; newest first, and whether each can be undone."""
    at = records.select(F.col("id").alias("a"), "merged_into")
    out = log.join(undone.select(F.col("merge").alias("id"), F.lit(True).alias("undone")), "id", "left").join(at, "a", "left")
    state = F.when(F.col("undone"), "undone").when(F.col("merged_into") == F.col("b"), "in effect").when(F.col("merged_into").isNull(), "not applied").otherwise("other")
    latest = Window.partitionBy("a").orderBy(F.desc("id"))
    out = out.withColumn("state", state).withColumn("newest", F.row_number().over(latest) == 1)
    why = F.when(F.col("state") != "in effect", F.col("state")).when(~F.col("newest"), "a later line")
    return out.select("id", "a", "b", "state", why.isNull().alias("undoable"), why.alias("why_not")).orderBy(F.desc("id"))


def unlogged_merges(log: DataFrame, records: DataFrame) -> DataFrame:
    """Records that are merged without a line that says so."""
    merged = records.filter("merged_into IS NOT NULL").select(F.col("id").alias("a"), F.col("merged_into").alias("b"))
    return merged.join(log.select("a", "b"), ["a", "b"], "left_anti")


def waiting_proposals(proposals: DataFrame, decisions: DataFrame, records: DataFrame) -> DataFrame:
    """Pairs (a, b, verdict, confidence) that wait for a decision: same but doubtful, both with a record, not decided, and not one event already."""
    roots = resolve_chains(records.select("id", F.col("merged_into").alias("into")))
    pair = proposals.filter("verdict = 'same' AND confidence = 'doubtful'").join(decisions.select("a", "b"), ["a", "b"], "left_anti")
    both = pair.join(roots.select(F.col("id").alias("a"), F.col("root").alias("ra")), "a").join(roots.select(F.col("id").alias("b"), F.col("root").alias("rb")), "b")
    return both.filter("ra <> rb").select("a", "b", "verdict", "confidence")


def mention_lines(lines: DataFrame, names: DataFrame) -> DataFrame:
    """Where files are used: lines (path, n, line) that link to a file (name) or mention its stem in backticks.

    Targets are taken out of the lines and joined by equality, so no line meets every name."""
    link = F.transform(F.regexp_extract_all("line", F.lit(r"\]\(([^)\s#]+)"), F.lit(1)), lambda t: F.struct(F.element_at(F.split(t, "/"), -1).alias("name"), F.lit("link").alias("how")))
    tick = F.transform(F.regexp_extract_all("line", F.lit("`([^`]+)`"), F.lit(1)), lambda t: F.struct(F.element_at(F.split(t, "/"), -1).alias("name"), F.lit("mention").alias("how")))
    found = lines.select("path", "n", F.inline(F.array_distinct(F.concat(link, tick))))
    return found.join(names.select("name").distinct(), "name").select("name", "path", "n", "how").orderBy("name", "path", "n", "how")
