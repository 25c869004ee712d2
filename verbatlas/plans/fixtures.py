"""Small tables that are written out once and read by Spark and, as VALUES, by SQL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

_SQL = {"long": "BIGINT", "int": "INT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]"}


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, list):
        return "[" + ", ".join(map(_literal, value)) + "]"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value)


@dataclass(frozen=True)
class Fixture:
    """``schema``: "name type, ..."; ``rows``: tuples in that order."""

    schema: str
    rows: tuple

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), self.schema)

    @property
    def sql(self) -> str:
        """A SELECT over the same rows."""
        fields = [f.split() for f in self.schema.split(", ")]
        values = ", ".join("(" + ", ".join(map(_literal, row)) + ")" for row in self.rows)
        columns = ", ".join(f'CAST("{n}" AS {_SQL[t]}) AS "{n}"' for n, t in fields)
        names = ", ".join(f'"{n}"' for n, _ in fields)
        return f"(SELECT {columns} FROM (VALUES {values}) AS v({names}))"


@dataclass(frozen=True)
class Derived:
    """Rows that one SELECT makes from given tables, in Spark's SQL and DuckDB's alike; LIST( ... ) is an array, {name} a table."""

    select: str
    tables: tuple[str, ...]

    def df(self, spark: SparkSession, d: str) -> DataFrame:
        return spark.sql(self.select.replace("LIST(", "array("), **{t: spark.read.parquet(f"{d}/{t}.parquet") for t in self.tables})

    @property
    def sql(self) -> str:
        out = self.select.replace("LIST(", "list_value(")
        for t in self.tables:
            out = out.replace("{" + t + "}", t)
        return f"({out})"


#: All documents with the metadata of a library: spellings that differ, missing values, dates that are none.
DOCUMENTS = Derived(
    """SELECT doc_id AS doc, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN upper(lang) || ' ' ELSE lang END AS lang,
  CASE doc_id % 4 WHEN 0 THEN 'essay' WHEN 1 THEN 'Essay' WHEN 2 THEN 'note' END AS genre, CASE WHEN doc_id % 3 = 0 THEN 'Forum' WHEN doc_id % 3 = 1 THEN 'blog' ELSE source END AS source,
  CASE doc_id % 4 WHEN 0 THEN 'posts' WHEN 1 THEN 'Post' WHEN 2 THEN 'essays' END AS kind, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN 'Ada  Byron' ELSE 'Karel ' || source END AS author,
  CASE WHEN doc_id % 6 = 0 THEN 'On “Engines” of ' || source WHEN doc_id % 6 < 5 THEN 'Re: engines' END AS title,
  CASE WHEN doc_id % 9 = 0 THEN 'soon' WHEN doc_id % 5 = 0 THEN CAST(2000 + doc_id % 20 AS STRING) ELSE CAST(2000 + doc_id % 20 AS STRING) || '-0' || CAST(1 + doc_id % 9 AS STRING) END AS date,
  CASE WHEN doc_id % 8 > 0 THEN LIST(source, 'Work', CASE WHEN doc_id % 2 = 0 THEN 'work ' ELSE 'Maths' END) END AS themes,
  LIST(lang, CASE WHEN doc_id % 3 = 0 THEN 'PRAGUE' WHEN doc_id % 3 = 1 THEN 'Prague' ELSE 'Babbage' END) AS entities, CASE WHEN doc_id % 4 = 0 THEN '2016-06-fair' END AS event,
  CASE WHEN doc_id % 9 > 0 THEN CAST(2000 + doc_id % 20 AS STRING) || '-0' || CAST(1 + doc_id % 9 AS STRING) END AS month, CASE WHEN doc_id % 3 < 2 THEN doc_id % 3 = 0 END AS ai FROM {documents}""",
    ("documents",),
)

#: All conversations as works of the second index, and their turns as highlights.
CONVERSATIONS = Derived(
    """SELECT DISTINCT conv_id AS work_id, 'work-' || CAST(conv_id AS STRING) AS slug, CASE WHEN conv_id % 3 = 0 THEN 'Notes on the Engine' ELSE 'Looms' END AS title,
  CASE conv_id % 4 WHEN 0 THEN 'Ada Byron' WHEN 1 THEN 'Joseph Engine' WHEN 2 THEN 'Karel' END AS author, CASE conv_id % 3 WHEN 0 THEN 'article' WHEN 1 THEN 'book' ELSE 'tweet' END AS work_type,
  CASE conv_id % 3 WHEN 0 THEN 'readwise' WHEN 1 THEN 'zotero' ELSE 'x' END AS source_system, 'r' || CAST(conv_id AS STRING) AS source_id, CASE WHEN conv_id % 2 = 0 THEN 'https://example.org/' || CAST(conv_id AS STRING) END AS url FROM {conversations}""",
    ("conversations",),
)
TURNS = Derived(
    """SELECT conv_id * 1000 + turn AS id, conv_id AS work_id, CASE WHEN turn % 5 = 4 THEN '![image](x.png)' WHEN turn % 5 = 3 THEN 'Pattern weaves ' || text || ' weaves' ELSE text END AS text, CASE WHEN turn = 1 THEN 'engine?' END AS note,
  CASE WHEN conv_id % 5 = 0 THEN NULL WHEN conv_id % 5 = 1 THEN '' ELSE CAST(2010 + conv_id % 10 AS STRING) || '-0' || CAST(1 + turn % 9 AS STRING) || '-01' END AS highlighted_at, '["' || role || '", "Maths ", "", "play_100%"]' AS tags,
  CASE WHEN turn % 3 = 0 THEN 'x' ELSE CAST(turn * 7 % 10 AS STRING) END AS location, CASE conv_id % 4 WHEN 0 THEN 'yellow' WHEN 1 THEN 'blue' WHEN 2 THEN 'Blue' END AS color,
  CASE WHEN turn % 4 = 0 THEN 'image' ELSE 'text' END AS format, CASE WHEN conv_id % 4 = 0 THEN '' END AS ocr_text FROM {conversations}""",
    ("conversations",),
)

#: All events as lasting records: chains of up to three merges, one of them into a hot record, cycles, links to nothing, members that two records claim.
_R = "'r' || lpad(CAST({} AS STRING), 12, '0')"
EVENT_RECORDS = Derived(
    f"""SELECT {_R.format('event_id')} AS id, 'Fair ' || CAST(user_id AS STRING) AS name, CASE WHEN event_id % 9 > 0 THEN LIST('The ' || event_type, CASE WHEN event_id % 3 = 0 THEN 'FAIR  ' || CAST(user_id AS STRING) ELSE 'Big “fair”' END) END AS aliases,
  CASE WHEN event_id % 7 > 0 THEN CAST(CAST(ts AS DATE) AS STRING) END AS start, CASE WHEN event_id % 4 = 0 THEN CAST(CAST(ts AS DATE) + 3 AS STRING) END AS end,
  CASE WHEN event_id % 6 > 0 THEN LIST('m' || CAST(event_id AS STRING), 'm' || CAST(event_id + 1 AS STRING)) END AS members,
  CASE WHEN event_id % 97 = 50 THEN {_R.format('event_id + 1')} WHEN event_id % 97 = 51 THEN {_R.format('event_id - 1')} WHEN event_id % 101 = 7 THEN 'nowhere' WHEN event_id % 8 IN (1, 2, 3) THEN {_R.format('event_id - 1')} END AS merged_into,
  CASE WHEN event_id % 53 = 0 THEN '2025-01-01' END AS removed FROM {{events}}""",
    ("events",),
)

#: Every line of an order as an item of an event: a third of all of one event, others by a member's or a record's own id, or unknown.
EVENT_ITEMS = Derived(
    f"""SELECT l_orderkey AS doc, CASE l_linenumber % 3 WHEN 0 THEN 'm2' WHEN 1 THEN 'm' || CAST(l_partkey AS STRING) ELSE CASE WHEN l_suppkey % 5 = 0 THEN 'x' || CAST(l_suppkey AS STRING) ELSE {_R.format('l_partkey')} END END AS event,
  CASE WHEN l_partkey % 10 > 0 THEN CAST(CAST(l_shipdate AS DATE) AS STRING) END AS day FROM {{lineitem}}""",
    ("lineitem",),
)
ORDER_EVENTS = Derived("SELECT o_orderkey AS doc, CASE WHEN o_orderkey % 7 > 0 THEN LIST('m' || CAST(o_custkey AS STRING), 'm2') END AS events FROM {orders}", ("orders",))
EVENT_OPS = Derived(
    f"""SELECT l_orderkey AS doc, l_orderkey * 10 + l_linenumber AS line, CASE WHEN l_suppkey % 2 = 0 THEN 'add' ELSE 'remove' END AS op, CASE l_linenumber % 3 WHEN 0 THEN 'm2' WHEN 1 THEN 'm' || CAST(l_partkey AS STRING) ELSE {_R.format('l_partkey % 60')} END AS event FROM {{lineitem}}""",
    ("lineitem",),
)

#: Log lines of merges, two for some records, which of them are undone, and pairs proposed for merging.
EVENT_MERGES = Derived(f"SELECT 'm' || lpad(CAST(event_id AS STRING), 12, '0') AS id, {_R.format('event_id - event_id % 2')} AS a, {_R.format('event_id - event_id % 2 - 1')} AS b FROM {{events}} WHERE event_id > 1", ("events",))
MERGES_UNDONE = Derived("SELECT 'm' || lpad(CAST(event_id * 3 AS STRING), 12, '0') AS merge FROM {events}", ("events",))
PROPOSED = Derived(
    f"""SELECT {_R.format('event_id')} AS a, {_R.format("event_id + 1 + user_id % 3")} AS b, CASE WHEN event_id % 4 < 3 THEN 'same' ELSE 'different' END AS verdict, CASE WHEN event_id % 5 < 4 THEN 'doubtful' ELSE 'confident' END AS confidence FROM {{events}}""",
    ("events",),
)
PAIRS_DECIDED = Derived(f"SELECT {_R.format('event_id * 2')} AS a, {_R.format('event_id * 2 + 2')} AS b FROM {{events}}", ("events",))

#: Texts with marks in two forms, tag rows and their corrections, lines that name files.
FOLDED = Derived("SELECT doc_id AS id, CASE doc_id % 5 WHEN 0 THEN '  Cafe\u0301  ‘' || text || '’ ' WHEN 1 THEN 'D\u030cA\u0301B\n\t' || text WHEN 2 THEN NULL WHEN 3 THEN '' ELSE text END AS t FROM {documents}", ("documents",))
TAG_ROWS = Derived("SELECT 'd' || CAST(doc_id AS STRING) AS key, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN LIST('Maths', 'work ', 'WORK') ELSE LIST(source, 'Play', lang) END AS themes FROM {documents}", ("documents",))
TAG_LINES = Derived(
    """SELECT 'd' || CAST(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE o_custkey END AS STRING) AS key, o_orderkey AS line, CASE WHEN o_orderkey % 41 = 0 THEN LIST('Only', 'Play') END AS replaces,
  CASE WHEN o_orderkey % 41 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'remove' ELSE 'add' END AS op, CASE WHEN o_orderkey % 41 > 0 THEN CASE o_orderkey % 4 WHEN 0 THEN 'play' WHEN 1 THEN 'Maths' WHEN 2 THEN ' WORK' ELSE o_orderpriority END END AS value FROM {orders}""",
    ("orders",),
)
FILE_LINES = Derived("SELECT 'f' || CAST(doc_id % 40 AS STRING) AS path, doc_id AS n, 'see [it](../notes/' || source || '.md#part) and `' || CASE WHEN doc_id % 3 = 0 THEN source ELSE lang END || '.md` ' || text AS line FROM {documents}", ("documents",))
FILE_NAMES = Derived("SELECT source || '.md' AS name FROM {documents}", ("documents",))

#: Works and entities of a tagger, what it answered, its themes, and names in several spellings.
TAGGED_WORKS = Derived("SELECT 'w' || CAST(o_orderkey AS STRING) AS key, 'Clerk ' || CAST(o_custkey % 50 AS STRING) AS author, CASE WHEN o_orderkey % 3 = 0 THEN 'On looms' ELSE 'T ' || o_orderpriority END AS title, o_orderkey % 40 AS highlights, CAST(CAST(o_orderdate AS DATE) AS STRING) AS date FROM {orders}", ("orders",))
NAMED = Derived("SELECT CASE c_custkey % 4 WHEN 0 THEN 'Clerk ' || CAST(c_custkey % 60 AS STRING) WHEN 1 THEN 'CLERK  ' || CAST(c_custkey % 60 AS STRING) WHEN 2 THEN 'On Looms' ELSE 'Clerk' || c_mktsegment END AS name FROM {customer}", ("customer",))
ANSWERED = Derived(
    """SELECT 'k' || CAST(o_orderkey AS STRING) AS key, CASE WHEN o_orderkey % 9 > 0 THEN LIST(' Click', 'view-x', o_orderstatus, 'ERROR', 'click', 'purchase', 'signup') END AS themes,
  CASE WHEN o_orderkey % 8 > 0 THEN LIST('Clerk ' || CAST(o_custkey % 50 AS STRING), 'Prague', 'prague ', '', o_orderpriority, 'a', 'b', 'c', 'd', 'e', 'f', 'g') END AS entities FROM {orders}""",
    ("orders",),
)
THEMES = Derived("SELECT DISTINCT upper(event_type) AS name FROM {events}", ("events",))
THEME_ALIASES = Derived("SELECT DISTINCT event_type || '-x' AS alias, upper(event_type) AS theme FROM {events}", ("events",))
OWN_NAMES = Derived("SELECT 'k' || CAST(o_orderkey AS STRING) AS key, CASE WHEN o_orderkey % 2 = 0 THEN 'CLERK ' || CAST(o_custkey % 50 AS STRING) ELSE 'x' END AS name FROM {orders}", ("orders",))
SPELLINGS = Derived(
    """SELECT CASE c_custkey % 4 WHEN 0 THEN 'N ' WHEN 1 THEN 'n-' WHEN 2 THEN 'N' ELSE 'Jan N ' END || CAST((c_custkey - c_custkey % 4) / 4 AS STRING) AS name, c_custkey * 7 % 13 AS n, CASE WHEN c_custkey % 40 < 20 THEN 'person' ELSE 'place' END AS type FROM {customer}""",
    ("customer",),
)
SPELT_AS = Derived("SELECT 'N ' || CAST(c_custkey AS STRING) AS alias, 'Place ' || CAST(c_nationkey AS STRING) AS name FROM {customer}", ("customer",))
VETOES = Derived("SELECT 'N' || CAST(c_custkey * 3 AS STRING) AS a, 'N ' || CAST(c_custkey * 3 AS STRING) AS b FROM {customer}", ("customer",))

LIBRARY = Fixture(
    "doc long, corpus string, path string, lang string, genre string, source string, kind string, author string, title string, date string, themes array<string>, entities array<string>, event string, month string, ai boolean",
    (
        (1, "writing", "a/1.md", "en", "essay", "blog", "essays", "Ada  Byron", "On “Engines”", "2016-06-23", ["Work", "Maths"], ["Babbage"], "2016-06-fair", "2016-06", True),
        (2, "writing", "a/2.md", "EN ", "Essay", "blog", "essay", "ada byron", "On looms", "2016-06", ["work"], [], None, "2016-06", False),
        (3, "writing", "a/3.md", "cs", "note", None, "notes", "Karel", "Roboti", "2004", ["maths", "Play"], ["babbage", "Prague"], "2004-01-play", "2004-01", None),
        (4, "posts", "b/1.md", "en", None, "forum", "post", None, "Re: engines", "2017-1-9T10:00", ["Play"], ["PRAGUE"], "2004-01-play", "2017-01", True),
        (5, "posts", "b/2.md", None, "note", "forum", "posts", "Ada", None, None, None, None, None, None, None),
        (6, "posts", "b/3.md", "en", "note", "Forum", "posts", "Ada", "Ďábel", "soon", ["Work", "work "], ["Babbage", "babbage"], "2016-06-fair", "2016-12", True),
    ),
)

RECORDS = Fixture(
    "id string, name string, aliases array<string>, start string, end string, members array<string>, merged_into string, removed string",
    (
        ("2004-01-play", "Play", ["The play"], "2004-01-02", "2004-02-01", ["2004-01/E01"], None, None),
        ("2016-06-fair", "Fair", ["the  PLAY", "Big fair"], "2016-06-01", None, ["2016-06/E01", "2016-06/E02"], None, None),
        ("2016-07-fair", "Second fair", ["Late fair"], "2016-05-30", "2016-07-02", ["2016-07/E01", "2016-06/E02"], "2016-06-fair", None),
        ("2016-08-end", "End", [], "2016-08-01", "2016-08-03", ["2016-08/E01"], "2016-07-fair", None),
        ("loop-a", "A", [], None, None, [], "loop-b", None),
        ("loop-b", "B", [], None, None, [], "loop-a", None),
        ("lost", "Lost", [], None, None, ["2017-01/E09"], "nowhere", None),
        ("gone", "Gone", [], "2017-01-01", "2017-01-02", ["2017-01/E01"], None, "2018-01-01"),
    ),
)
