"""Column functions on partial dates, months and briefing periods, all held as text.

Text that does not have the named form gives null (or false for the tests), never an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")

#: The first instant of the numbered ids, and how many of their low bits are no time.
SNOWFLAKE_START_MS, SNOWFLAKE_BITS, SNOWFLAKE_LEAST_MS = 1288834974657, 22, 86_400_000


def british_date(date: Column) -> Column:
    """``2016-06-23`` as ``23 June 2016``, ``2016-06`` as ``June 2016``, ``2016`` as it is."""
    day = F.regexp_extract(F.trim(date), r"^([^T ]*)", 1)
    form = r"^([0-9]{4})(?:-\+?([0-9]+))?(?:-\+?([0-9]+))?$"
    part = lambda k: F.regexp_extract(day, form, k)
    number = lambda k: part(k).try_cast("int")
    name = F.try_element_at(F.array(*map(F.lit, MONTHS)), F.when(number(2).between(1, 12), number(2)))
    return (
        F.when(part(1) == "", None)
        .when(part(2) == "", part(1))
        .when(part(3) == "", F.concat(name, F.lit(" "), part(1)))
        .when(number(3).between(1, 31), F.concat(number(3).cast("string"), F.lit(" "), name, F.lit(" "), part(1)))
    )


def snowflake_time(post_id: Column) -> Column:
    """UTC time of a numbered post as yyyy-MM-ddTHH:mm:ssZ; older ids count up and have none."""
    since = F.shiftrightunsigned(F.trim(post_id).try_cast("long"), SNOWFLAKE_BITS)
    at = F.timestamp_millis(since + F.lit(SNOWFLAKE_START_MS))
    return F.when(since >= SNOWFLAKE_LEAST_MS, F.date_format(F.convert_timezone(None, F.lit("UTC"), at.cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def reference_date(date: Column) -> Column:
    """First word of a library's date, cut before the first part that is all zeros or no number; null without a year."""
    first = F.regexp_extract(date, r"^\s*(\S+)", 1)
    found = F.regexp_extract(first, r"^([0-9]{4}(?![^-])(?:-(?![0]+(?:-|$))[0-9]+(?![^-])){0,2})", 1)
    return F.when((found != "") & ~found.startswith("0000"), found)


def is_date(text: Column) -> Column:
    """Is the text exactly a day of the calendar, yyyy-MM-dd?"""
    return F.coalesce(text.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & text.try_cast("date").isNotNull(), F.lit(False))


def valid_month(text: Column) -> Column:
    """Is the trimmed text a year or a month?"""
    return F.coalesce(F.trim(text).rlike(r"\A[0-9]{4}(?:-(?:0[1-9]|1[0-2]))?\z"), F.lit(False))


def exact_month(text: Column) -> Column:
    """Is the text a month and nothing else?"""
    return F.coalesce(text.rlike(r"\A[0-9]{4}-(?:0[1-9]|1[0-2])\z"), F.lit(False))


def month_of(date: Column, layer_month: Column | None = None) -> Column:
    """The month that a date begins with, else a month given beside it."""
    cut = lambda c: F.when(exact_month(F.substring(F.trim(c), 1, 7)), F.substring(F.trim(c), 1, 7))
    if layer_month is None:
        return cut(date)
    return F.coalesce(cut(date), F.when(F.length(F.trim(layer_month)) == 7, cut(layer_month)))


def day_of(date: Column, month: Column) -> Column:
    """The day that a date begins with, if the calendar has it and it lies in ``month``."""
    day = F.substring(F.trim(date), 1, 10)
    return F.when(is_date(day) & (F.substring(day, 1, 7) == month), day)


def in_month(month: Column, wanted: str) -> Column:
    """Does a month equal the wanted one, or lie in the wanted year?"""
    wanted = wanted.strip()
    return F.coalesce(month.startswith(wanted) if len(wanted) == 4 else month == F.lit(wanted), F.lit(False))


def is_period(text: Column) -> Column:
    """Is the text a month or a quarter (yyyy-Qn)?"""
    return F.coalesce(text.rlike(r"\A[0-9]{4}-(?:0[1-9]|1[0-2]|Q[1-4])\z"), F.lit(False))


def period_month(period: Column) -> Column:
    """The month itself, or the first month of the quarter."""
    quarter = F.regexp_extract(period, "Q([1-4])$", 1).try_cast("int")
    first = F.coalesce(F.concat(F.substring(period, 1, 5), F.lpad(((quarter - 1) * 3 + 1).cast("string"), 2, "0")), period)
    return F.when(is_period(period), first)


def period_span(period: Column) -> Column:
    """First and last day of a period as struct(first, last) of text."""
    first = F.concat(period_month(period), F.lit("-01")).try_cast("date")
    last = F.last_day(F.add_months(first, F.when(F.contains(period, F.lit("Q")), 2).otherwise(0)))
    return F.when(first.isNotNull(), F.struct(first.cast("string").alias("first"), last.cast("string").alias("last")))
