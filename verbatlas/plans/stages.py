"""Registered queries of the tagger's stages, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from verbatlas.operators import tagger
from verbatlas.plans.catalogue import query
from verbatlas.plans.fixtures import ANSWERED, NAMED, OWN_NAMES, SPELLINGS, SPELT_AS, TAGGED_WORKS, THEME_ALIASES, THEMES, VETOES
from verbatlas.sources.corpus import table


@query("""WITH w AS (SELECT user_id AS key, event_id AS file, strftime(ts, '%Y-%m-%d') AS latest, props AS text FROM events), i AS (SELECT * FROM w WHERE latest BETWEEN '2024-01-05' AND '2024-01-20')
SELECT key, min(file) AS file, arg_min(latest, file) AS latest, substr(arg_min(text, file), 1, 5) AS text FROM i GROUP BY key""")
def tagger_select_works(spark, d):
    works = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("file"), F.date_format("ts", "yyyy-MM-dd").alias("latest"), F.col("props").alias("text"))
    return tagger.select_works(works, "2024-01-05", "2024-01-20", cap=5)


@query("""WITH r AS (SELECT o_orderkey AS key, row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m') ORDER BY o_orderdate, o_orderkey)::VARCHAR AS n FROM orders) SELECT key, CASE WHEN length(n) < 4 THEN lpad(n, 4, '0') ELSE n END AS short FROM r""")
def tagger_short_ids(spark, d):
    return tagger.short_ids(table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("date"), F.date_format("o_orderdate", "yyyy-MM").alias("month")))


@query("""WITH t AS (SELECT lower(trim(unnest(string_split(p_name, ' ')))) AS tag FROM part) SELECT tag, count(*) AS n FROM t WHERE tag <> '' AND tag NOT IN ('part', 'favorites') GROUP BY tag ORDER BY n DESC, tag LIMIT 150""")
def tagger_tag_counts(spark, d):
    return tagger.tag_counts(table(spark, d, "part").select(F.split("p_name", " ").alias("tags")), ("part", "favorites"))


@query("""WITH e AS (SELECT event_id AS key, event_type || event_id AS text, CASE WHEN event_id % 3 = 0 THEN event_id // 2 END AS parent, CASE WHEN event_id % 5 = 0 THEN event_id + 1000000 END AS quoted FROM events),
s AS (SELECT event_id AS id, arg_max('s' || l, l) AS text FROM (SELECT event_id, unnest([1, 3, 2]) AS l FROM events WHERE event_type = 'click') GROUP BY event_id), a AS (SELECT event_id AS id, 'a' || event_id AS text FROM events WHERE value >= 100)
SELECT e.key, e.text, coalesce(s1.text, a1.text, o1.text) AS parent_text, coalesce(s2.text, a2.text, o2.text) AS quoted_text FROM e LEFT JOIN s s1 ON s1.id = e.parent LEFT JOIN a a1 ON a1.id = e.parent LEFT JOIN e o1 ON o1.key = e.parent LEFT JOIN s s2 ON s2.id = e.quoted LEFT JOIN a a2 ON a2.id = e.quoted LEFT JOIN e o2 ON o2.key = e.quoted""")
def tagger_enrichment(spark, d):
    e = table(spark, d, "events").select("event_type", "value", F.col("event_id").alias("key"), F.concat("event_type", "event_id").alias("text"), F.when(F.col("event_id") % 3 == 0, F.floor(F.col("event_id") / 2)).alias("parent"), F.when(F.col("event_id") % 5 == 0, F.col("event_id") + 1000000).alias("quoted"))
    lines = e.filter("event_type = 'click'").select(F.col("key").alias("id"), F.explode(F.array(F.lit(1), F.lit(3), F.lit(2))).alias("line")).withColumn("text", F.concat(F.lit("s"), "line"))
    archive = e.filter("value >= 100").select(F.col("key").alias("id"), F.concat(F.lit("a"), "key").alias("text"))
    return tagger.enrich(e, tagger.latest_snapshot(lines), archive)


@query(f"""WITH e AS (SELECT DISTINCT name, lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))) AS v FROM {NAMED.sql}), w AS (SELECT lower(author) AS v, key, highlights, date FROM {TAGGED_WORKS.sql} UNION SELECT lower(title), key, highlights, date FROM {TAGGED_WORKS.sql}),
r AS (SELECT name, key, row_number() OVER (PARTITION BY name ORDER BY highlights DESC, date DESC, key) AS rank FROM e JOIN w ON e.v = w.v WHERE contains(e.v, ' ')) SELECT name, key, rank::INT AS rank FROM r WHERE rank <= 5""")
def tagger_entity_works(spark, d):
    return tagger.entity_works(NAMED.df(spark, d), TAGGED_WORKS.df(spark, d))


@query(f"""WITH k AS (SELECT lower(name) AS v, name FROM {THEMES.sql} UNION ALL SELECT lower(alias), name FROM {THEME_ALIASES.sql} JOIN {THEMES.sql} ON theme = name),
t AS (SELECT key, unnest(themes) AS raw, unnest(range(len(themes))) AS pos FROM {ANSWERED.sql}), tt AS (SELECT key, name, min(pos) AS pos FROM t JOIN k ON lower(trim(raw)) = v GROUP BY ALL), tr AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos) AS r FROM tt),
e AS (SELECT key, unnest(entities) AS raw, unnest(range(len(entities))) AS pos FROM {ANSWERED.sql}), ee AS (SELECT key, lower(trim(raw)) AS v, min(pos) AS pos, arg_min(trim(raw), pos) AS shown FROM e x WHERE trim(raw) <> '' AND NOT EXISTS (SELECT 1 FROM {OWN_NAMES.sql} o WHERE o.key = x.key AND lower(o.name) = lower(trim(raw))) GROUP BY ALL), er AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos) AS r FROM ee)
SELECT a.key, coalesce((SELECT string_agg(name, '|' ORDER BY pos) FROM tr WHERE tr.key = a.key AND r <= 3), '') AS themes, coalesce((SELECT string_agg(shown, '|' ORDER BY pos) FROM er WHERE er.key = a.key AND r <= 8), '') AS entities FROM {ANSWERED.sql} a""")
def tagger_validate_tags(spark, d):
    out = tagger.validate_tags(ANSWERED.df(spark, d), THEMES.df(spark, d), THEME_ALIASES.df(spark, d), OWN_NAMES.df(spark, d))
    return out.select("key", F.array_join("themes", "|").alias("themes"), F.array_join("entities", "|").alias("entities"))


_TAGGED = "(SELECT user_id AS key, list_sort(list_distinct(list(event_type))) AS themes, list_sort(list_distinct(list(event_id % 7))) AS entities, min(event_type) AS event FROM events WHERE {} GROUP BY user_id)"
_SHARE = "avg(CASE WHEN len(list_distinct(list_concat({a}, {b}))) = 0 THEN 1.0 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END)"


@query(f"""WITH t AS {_TAGGED.format('value >= 60')}, c AS {_TAGGED.format('value < 140')} SELECT count(*) AS items, round({_SHARE.format(a='t.themes', b='c.themes')} * 1000) / 1000 AS themes, round({_SHARE.format(a='t.entities', b='c.entities')} * 1000) / 1000 AS entities,
round(avg((t.themes = c.themes)::INT) * 1000) / 1000 AS same_themes, round(avg((t.event IS NOT DISTINCT FROM c.event)::INT) * 1000) / 1000 AS same_event FROM t JOIN c ON t.key = c.key""")
def tagger_agreement(spark, d):
    e = table(spark, d, "events")
    of = lambda rows: rows.groupBy(F.col("user_id").alias("key")).agg(F.array_sort(F.collect_set("event_type")).alias("themes"), F.array_sort(F.collect_set(F.col("event_id") % 7)).alias("entities"), F.min("event_type").alias("event"))
    return tagger.agreement(of(e.filter("value >= 60")), of(e.filter("value < 140")))


@query("""WITH n AS (SELECT user_id AS name, count(DISTINCT event_id) AS n FROM events GROUP BY user_id), k AS (SELECT user_id AS name, event_type AS type, row_number() OVER (PARTITION BY user_id ORDER BY count(DISTINCT event_id) DESC, event_type) AS r FROM events GROUP BY user_id, event_type)
SELECT n.name, n, type FROM n JOIN k ON n.name = k.name WHERE r = 1""")
def tagger_entity_counts(spark, d):
    return tagger.entity_counts(table(spark, d, "events").select(F.col("event_id").alias("key"), F.col("user_id").alias("name"), F.col("event_type").alias("type")))


_MAP = f"""WITH c AS (SELECT *, regexp_replace(lower(name), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS v FROM {SPELLINGS.sql}), s AS (SELECT name, first_value(name) OVER (PARTITION BY v, type ORDER BY n DESC, name) AS into_, 1 AS rule FROM c),
a AS (SELECT alias, s.name, 2 FROM {SPELT_AS.sql} s JOIN c ON c.name = s.alias), l AS (SELECT x.name, min(y.name) AS into_, 3 FROM c x JOIN c y ON x.type = y.type AND x.name <> y.name AND ends_with(lower(y.name), ' ' || lower(x.name)) GROUP BY x.name HAVING count(DISTINCT y.name) = 1),
u AS (SELECT * FROM s UNION ALL SELECT * FROM a UNION ALL SELECT * FROM l) SELECT name, arg_min(into_, rule) AS "into" FROM u WHERE name <> into_ AND NOT EXISTS (SELECT 1 FROM {VETOES.sql} v WHERE v.a = u.name AND v.b = into_) GROUP BY name"""


@query(_MAP)
def tagger_entity_map(spark, d):
    return tagger.spelling_map(SPELLINGS.df(spark, d), SPELT_AS.df(spark, d), VETOES.df(spark, d))


@query(f"""WITH RECURSIVE m AS ({_MAP}), w AS (SELECT name, "into" AS at_, 1 AS n FROM m UNION ALL SELECT w.name, m."into", n + 1 FROM w JOIN m ON m.name = w.at_ WHERE n < 20) SELECT name, at_ AS "into" FROM w WHERE at_ NOT IN (SELECT name FROM m)""")
def tagger_entity_roots(spark, d):
    return tagger.resolved_map(tagger.spelling_map(SPELLINGS.df(spark, d), SPELT_AS.df(spark, d), VETOES.df(spark, d)))


_SIG = "(SELECT user_id AS id, min(CAST(ts AS DATE)) AS s, max(CAST(ts AS DATE)) AS e, list_distinct(list(event_type || (event_id % 11))) AS signals FROM events GROUP BY user_id)"


@query(f"""WITH RECURSIVE e AS {_SIG}, x AS (SELECT id, s, e, unnest(signals) AS signal FROM e), p AS (SELECT a.id AS a, b.id AS b, greatest(0, date_diff('day', least(a.e, b.e), greatest(a.s, b.s)))::INT AS gap_days, count(DISTINCT a.signal) AS shared FROM x a JOIN x b ON a.signal = b.signal AND a.id < b.id GROUP BY ALL HAVING gap_days <= 5),
i AS (SELECT id, row_number() OVER (ORDER BY id) AS at FROM e), o AS (SELECT p.*, x.at AS ia, y.at AS ib, row_number() OVER (ORDER BY shared DESC, gap_days, a, b) AS k FROM p JOIN i x ON x.id = a JOIN i y ON y.id = b),
g AS (SELECT 0::BIGINT AS k, list_transform(range((SELECT count(*) FROM i)), lambda z: 0) AS used, false AS kept
  UNION ALL SELECT o.k, CASE WHEN used[ia] < 6 AND used[ib] < 6 THEN list_transform(used, lambda n, z: n + CASE WHEN z = ia OR z = ib THEN 1 ELSE 0 END) ELSE used END, used[ia] < 6 AND used[ib] < 6 FROM g JOIN o ON o.k = g.k + 1)
SELECT a, b, gap_days, shared FROM g JOIN o ON o.k = g.k WHERE kept""")
def tagger_merge_candidates(spark, d):
    e = table(spark, d, "events")
    events = e.groupBy(F.col("user_id").alias("id")).agg(F.min(F.to_date("ts")).alias("start"), F.max(F.to_date("ts")).alias("end"), F.collect_set(F.concat("event_type", F.col("event_id") % 11)).alias("signals"))
    return tagger.merge_candidates(events, gap=5)


@query("""WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS items, substr(strftime(o_orderdate, '%Y-%m'), 1, 4) || '-Q' || quarter(any_value(o_orderdate)) AS q FROM orders GROUP BY 1) SELECT month, CASE WHEN min(items) OVER (PARTITION BY q) < 15 THEN q ELSE month END AS period FROM m""")
def tagger_period_groups(spark, d):
    return tagger.period_groups(table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("items")))


@query("""SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS items, min(o_orderkey) AS first_key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber > 3) GROUP BY 1""")
def tagger_untagged(spark, d):
    items = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    return tagger.untagged(items, table(spark, d, "lineitem").filter("l_linenumber > 3").select(F.col("l_orderkey").alias("key")))


@query("""SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderkey AS key, CASE WHEN o_orderstatus = 'F' THEN 'old' ELSE 'new' END AS value FROM orders WHERE o_orderstatus = 'F' OR o_totalprice > 100000""")
def tagger_ordered_insert(spark, d):
    rows = table(spark, d, "orders").select("o_orderstatus", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_orderkey").alias("key"))
    part = lambda rows, value: rows.select("date", "key", F.lit(value).alias("value"))
    return tagger.inserted(part(rows.filter("o_orderstatus = 'F'"), "old"), part(rows.filter("o_totalprice > 100000"), "new"))


@query("""WITH e AS (SELECT user_id, coalesce(CASE WHEN event_type = 'error' THEN 'failure' END, event_type) AS name FROM events), n AS (SELECT user_id AS key, list_sort(list(DISTINCT name)) AS entities FROM e GROUP BY user_id)
SELECT t.key, t.date, CASE WHEN t.key % 2 = 0 THEN '2024-01/E' || t.key END AS event, array_to_string(entities, '|') AS entities FROM (SELECT user_id AS key, strftime(min(ts), '%Y-%m-%d') AS date FROM events GROUP BY user_id) t JOIN n ON t.key = n.key""")
def tagger_current_rows(spark, d):
    rows = table(spark, d, "events").groupBy(F.col("user_id").alias("key")).agg(F.date_format(F.min("ts"), "yyyy-MM-dd").alias("date"), F.collect_set("event_type").alias("entities"))
    rows = rows.withColumn("briefing", F.lit("2024-01")).withColumn("event", F.when(F.col("key") % 2 == 0, F.concat(F.lit("E"), "key")))
    names = spark.createDataFrame([("error", "failure")], "name string, into string")
    return tagger.current_rows(rows, names).withColumn("entities", F.array_join("entities", "|"))


@query("""WITH v AS (SELECT * FROM (VALUES ('click', 'use'), ('view', 'use'), ('error', 'fault')) AS v(label, name)) SELECT name, count(DISTINCT event_id) AS items FROM events LEFT JOIN v ON event_type = label GROUP BY name""")
def tagger_vocabulary(spark, d):
    vocabulary = spark.createDataFrame([("click", "use"), ("view", "use"), ("error", "fault")], "label string, name string")
    return tagger.mapped_labels(table(spark, d, "events").select(F.col("event_id").alias("key"), F.col("event_type").alias("label")), vocabulary)


@query("""WITH t AS (SELECT strftime(o_orderdate, '%Y') AS period, count(DISTINCT o_orderkey) AS total FROM orders GROUP BY 1), e AS (SELECT o_orderpriority AS theme, strftime(o_orderdate, '%Y') AS period, count(DISTINCT o_orderkey) AS items FROM orders GROUP BY ALL) SELECT theme, e.period, items, round(items * 1000 / total) / 10 AS share FROM e JOIN t ON e.period = t.period""")
def tagger_overview(spark, d):
    return tagger.overview(table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("theme"), F.date_format("o_orderdate", "yyyy").alias("year")), "year")


@query("SELECT period, run FROM (SELECT CAST(ts AS DATE)::VARCHAR AS period, event_id AS run, max(event_id) OVER (PARTITION BY CAST(ts AS DATE)) AS last FROM events) WHERE run < last")
def tagger_superseded(spark, d):
    return tagger.superseded(table(spark, d, "events").select(F.to_date("ts").cast("string").alias("period"), F.col("event_id").alias("run")))
