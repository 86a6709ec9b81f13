"""Numbers, times and currencies from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def huf(c: Column, low: int = 1, high: int = 500_000_000) -> Column:
    """First number of a text: what follows a comma is dropped, separators are removed, values outside the range are null."""
    first = F.regexp_extract(F.translate(c, "\u00a0", " "), r"\d[\d\s.]*", 0)
    n = F.regexp_replace(first, r"\D", "").try_cast("long")
    return F.when(n.between(low, high), n)


def all_digits(c: Column, low: int = 100, high: int = 100_000_000) -> Column:
    n = F.regexp_replace(c, r"\D", "").try_cast("long")
    return F.when(n.between(low, high), n)


def local_utc(c: Column, zone: str = "Europe/Budapest") -> Column:
    """ISO time with a zone, else the first date (year, month and day between dots, dashes, slashes or spaces) with its time if one follows, as local time; what is no date is null. The result is UTC."""
    zoned = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}.*(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(c))
    part = lambda g: F.regexp_extract(c, r"(\d{4})[.\-/ ]+(\d{1,2})[.\-/ ]+(\d{1,2})\.?(?:[T\s]+(\d{1,2}):(\d{2})(?::(\d{2}))?)?", g).try_cast("int")
    zero = F.lit(0)
    naive = F.try_make_timestamp(part(1), part(2), part(3), F.coalesce(part(4), zero), F.coalesce(part(5), zero), F.coalesce(part(6), zero))
    return F.coalesce(zoned, F.to_utc_timestamp(naive, zone))


def locale_number(c: Column, german: Column) -> Column:
    de = F.regexp_replace(F.regexp_replace(c, r"\.", ""), ",", ".")
    return F.when(german, de).otherwise(F.regexp_replace(c, ",", "")).try_cast("double")
