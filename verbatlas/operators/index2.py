"""The second index: works (containers) and their highlights (records)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbatlas.functions.stem import stemmed, stems_of, words_of

#: Columns of ``hits`` that full text reads.
FULLTEXT = ("text", "note", "title", "author", "tags", "ocr_text")

def upsert(old: DataFrame, new: DataFrame, key: str, keeps: list[str] = ()) -> DataFrame:
    """``old`` with the rows of ``new``; where both have a key, the new row counts but for the columns that keep their old value."""
    kept = old.select(F.col(key), *[F.col(c).alias(f"_old_{c}") for c in keeps], F.lit(True).alias("_had"))
    merged = new.join(kept, key, "left").select(*[F.when(F.col("_had"), F.col(f"_old_{c}")).otherwise(F.col(c)).alias(c) if c in keeps else F.col(c) for c in old.columns])
    return old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(merged)


def hits(records: DataFrame, works: DataFrame) -> DataFrame:
    """Records with the columns of their work."""
    return records.join(works, "work_id")


@dataclass
class Filters:
    """Lists are OR; the conditions together are AND."""

    author: list[str] = field(default_factory=list)
    title: list[str] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    kind: list[str] = field(default_factory=list)
    source: list[str] = field(default_factory=list)
    color: list[str] = field(default_factory=list)
    after: str | None = None
    before: str | None = None
    has_image: bool = False
    without: list[str] = field(default_factory=list)
    patterns: list[tuple[str, str]] = field(default_factory=list)


def like(column: Column, part: str) -> Column:
    """Does the text hold ``part``?  Only A-Z match a-z, as in SQL's LIKE there; % and _ are plain characters."""
    ascii_lower = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.contains(ascii_lower(column), ascii_lower(F.lit(part)))


def where(f: Filters) -> Column:
    """The filters over columns of ``hits``; never null."""

    def any_of(values: list[str], test) -> list[Column]:
        if not values:
            return []
        out = F.coalesce(test(values[0]), F.lit(False))
        for v in values[1:]:
            out |= F.coalesce(test(v), F.lit(False))
        return [out]

    parts = any_of(f.author, lambda v: like(F.col("author"), v)) + any_of(f.title, lambda v: like(F.col("title"), v)) + any_of(f.tag, lambda v: like(F.col("tags"), v))
    parts += any_of(f.kind, lambda v: F.startswith(F.lower("work_type"), F.lit(v.lower()))) + any_of(f.source, lambda v: F.col("source_system") == v) + any_of(f.color, lambda v: F.col("color") == v)
    if f.after is not None:
        parts.append(F.col("highlighted_at") >= f.after)
    if f.before is not None:
        parts.append((F.col("highlighted_at") != "") & (F.col("highlighted_at") < f.before))
    if f.has_image:
        parts.append((F.col("format") == "image") | F.contains("text", F.lit("![image](")))
    every = F.concat_ws(" ", "text", "note", "title", "author")
    parts += [~F.contains(F.lower(every), F.lit(w.lower())) for w in f.without]
    parts += [F.col("text").rlike(source if "c" in flags else f"(?i){source}") for source, flags in f.patterns]  # without the flag c case does not count
    out = F.lit(True)
    for p in parts:
        out &= F.coalesce(p, F.lit(False))
    return out


def matching(rows: DataFrame, groups: list[list[tuple[str, str]]], columns: tuple[str, ...] = FULLTEXT) -> DataFrame:
    """Rows with a term of every group, by Porter stems and without marks and case.

    A term is ("word", w), ("phrase", "w1 w2 ...") or ("prefix", "w"): stems in a row inside one column, the last one open for a
    prefix; or ("exact", "w1 w2 ..."): words in a row as they are, not by stems.  Terms without letters and digits are left out, and groups without terms; null columns hold nothing."""
    texts = F.array(*[F.col(c).cast("string") for c in columns])
    held = {exact: stemmed(texts, exact) for exact in (False, True)}
    for group in groups:
        terms = [(kind == "exact", f" {' '.join(cut)}{'' if kind == 'prefix' else ' '}") for kind, text in group if (cut := (words_of if kind == "exact" else stems_of)(text))]
        if terms:
            # one Arrow call a row and form: Spark takes equal calls of a filter once
            rows = rows.filter(F.greatest(F.lit(False), *[F.contains(held[exact], F.lit(t)) for exact, t in terms]))
    return rows


def search(records: DataFrame, works: DataFrame, words: list[str], filters: Filters | None = None, limit: int = 20, offset: int = 0, groups: list[list[tuple[str, str]]] | None = None) -> DataFrame:
    """Records by words held (text, note, title, author), then author hits before title hits before others, then the newest; ties by id.

    With ``groups`` the records are those of ``matching``, and the words only order them."""
    rows = hits(records, works).filter(where(filters or Filters()))
    rows = rows if groups is None else matching(rows, groups)
    every = F.lower(F.concat_ws(" ", "text", "note", "title", "author"))
    held = sum((F.contains(every, F.lit(w.lower())).cast("long") for w in words), F.lit(0).cast("long"))
    in_any = lambda c: F.coalesce(F.greatest(F.lit(False), *[F.contains(F.lower(c), F.lit(w.lower())) for w in words]), F.lit(False)) if words else F.lit(False)
    rank = F.when(in_any("author"), 0).when(in_any("title"), 1).otherwise(2)
    rows = rows.withColumn("held", held).withColumn("class", rank)
    rows = rows.filter("held > 0") if words and groups is None else rows
    return rows.orderBy(F.desc("held"), "class", F.desc(F.coalesce("highlighted_at", F.lit(""))), "id").select("id", "slug", "held", "class").offset(offset).limit(limit)


def reading_order(records: DataFrame) -> DataFrame:
    """Records of each work by location as a number, those without one first, then by date and id."""
    number = F.regexp_extract(F.trim(F.coalesce("location", F.lit(""))), r"^[0-9]+", 0).try_cast("long")
    return records.withColumn("place", number).orderBy("work_id", F.asc_nulls_first("place"), F.asc_nulls_first("highlighted_at"), "id")


def tags(records: DataFrame) -> DataFrame:
    """Tags of the JSON lists, lower case and trimmed, by number of records."""
    each = records.select("id", F.explode(F.from_json("tags", "array<string>")).alias("raw")).select("id", F.lower(F.trim("raw")).alias("tag"))
    return each.filter("tag <> ''").groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag")


def facets(records: DataFrame, works: DataFrame) -> DataFrame:
    """(facet, value, n): source systems by name, colours by number of records."""
    sources = works.groupBy(F.col("source_system").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("source").alias("facet"), "value", "n")
    colors = records.filter("color IS NOT NULL").groupBy(F.col("color").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("color").alias("facet"), "value", "n")
    return sources.unionByName(colors)


def ocr_pending(records: DataFrame) -> DataFrame:
    """Records with an image whose text has not been read: no OCR text, and the image format or an image in the text."""
    return records.filter(F.col("ocr_text").isNull() & (F.coalesce(F.col("format") == "image", F.lit(False)) | F.contains("text", F.lit("![image]("))))


def with_ocr(records: DataFrame, read: DataFrame) -> DataFrame:
    """``records`` with the read texts (id, ocr) as ocr_text."""
    return records.join(read.select("id", F.col("ocr").alias("_ocr")), "id", "left").withColumn("ocr_text", F.coalesce("_ocr", "ocr_text")).select(*records.columns)


def by_id(records: DataFrame, ident: int) -> DataFrame:
    return records.filter(F.col("id") == ident)


def by_slug(works: DataFrame, slug: str) -> DataFrame:
    return works.filter(F.col("slug") == slug).select("work_id")


def totals(records: DataFrame, works: DataFrame) -> DataFrame:
    return works.agg(F.count(F.lit(1)).alias("works")).crossJoin(records.agg(F.count(F.lit(1)).alias("records")))
