"""Column functions on ids, slugs and links."""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from verbatlas.functions.text import fold

#: Ways to write a DOI, and the hosts whose links name an account.
DOI_HEADS = ("https://doi.org/", "http://doi.org/", "https://dx.doi.org/", "http://dx.doi.org/", "doi:")
STATUS_HOSTS = ("x.com", "twitter.com")


def numbered_id(prefix: str, n: Column) -> Column:
    """A letter and the number in at least six digits; longer numbers stay whole."""
    text = n.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(text) < 6, F.lpad(text, 6, "0")).otherwise(text))


def number_of(prefix: str, written: Column) -> Column:
    """The number of an id in its one spelling, 1 to 999,999,999; null for any other text."""
    digits = F.regexp_extract(written, rf"\A{prefix}((?!000000)[0-9]{{6}}|[1-9][0-9]{{6,8}})\z", 1)
    return F.when(digits != "", digits.cast("long"))


def monthly_id(written: Column) -> Column:
    """The one spelling of a monthly event id: period, slash, E and digits; null for other text."""
    return F.nullif(F.regexp_extract(F.upper(fold(written)), r"\A([0-9]{4}-(?:0[1-9]|1[0-2]|Q[1-4])/E[0-9]+)\z", 1), F.lit(""))


def monthly_order(written: Column) -> Column:
    """Sort key of monthly ids: period, then the number by value, then as written."""
    number = F.regexp_extract(written, r"/E0*([0-9]*)$", 1)
    return F.struct(F.substring_index(written, "/", 1), F.length(number), number, written)


def doi_url(written: Column) -> Column:
    """A DOI in any usual spelling as a link; null if it is none."""
    heads = "|".join(h.replace(".", r"\.") for h in DOI_HEADS)
    bare = F.trim(F.regexp_replace(F.trim(written), f"(?i)^(?:{heads})", ""))
    return F.when(bare.startswith("10."), F.concat(F.lit("https://doi.org/"), bare))


def is_http(url: Column) -> Column:
    return url.rlike("^https?://")


def status_handle(url: Column) -> Column:
    """The account in the link of a post; null for other links."""
    hosts = "|".join(h.replace(".", r"\.") for h in STATUS_HOSTS)
    return F.nullif(F.regexp_extract(url, rf"^.*?://(?:www\.)*(?:mobile\.)*(?:{hosts})/([^/]+)/(?:status|statuses)(?:/|$)", 1), F.lit(""))


def percent(text: Column, keep_slash: bool = False) -> Column:
    """Percent-encoding of all but letters, digits and - . _ ~ (and / in paths)."""
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), *((("%2F", "/"),) if keep_slash else ())):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def render_link(template: str, path: Column, line: Column) -> Column:
    """A link template with its {path} (encoded) and {line} filled in."""
    return F.replace(F.replace(F.lit(template), F.lit("{path}"), percent(path)), F.lit("{line}"), line.cast("string"))


def file_url(path: Column) -> Column:
    return F.concat(F.lit("file://"), percent(path, keep_slash=True))


def plain_slug(name: str | None) -> str:
    """ASCII letters and digits in lower case, accents off, single hyphens for the rest."""
    text = regex.sub("[̀-ͯ]", "", unicodedata.normalize("NFKD", name or "")).lower()
    return "-".join(regex.findall("[a-z0-9]+", text))


def slug(name: Column) -> Column:
    """plain_slug of a column, in Arrow batches; Spark has no decomposition of accents of its own."""

    def of(batch: pd.Series) -> pd.Series:
        return batch.map(plain_slug)

    return F.pandas_udf(of, "string")(name)
