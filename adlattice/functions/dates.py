"""Relative posting dates of the listing pages, against an explicit ``now``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS_DAYS, WEEK_DAYS = 30, 7


def _back(amount: Column, unit: str) -> Column:
    n = amount.try_cast("int") if hasattr(amount, "try_cast") else amount.cast("int")
    return F.make_dt_interval(**{unit: n})


def short_relative(c: Column, now: Column) -> Column:
    """``3d ago``, ``5h ago``, ``7m ago`` (minutes); any other text means now; NULL or a non-number gives NULL."""
    out = F.when(c.isNull(), F.lit(None).cast("timestamp_ntz"))
    for mark, unit in (("d ago", "days"), ("h ago", "hours"), ("m ago", "mins")):
        out = out.when(c.contains(mark), now - _back(F.trim(F.split_part(c, F.lit(mark), F.lit(1))), unit))
    return out.otherwise(now)


def long_relative(c: Column, now: Column) -> Column:
    """``2 weeks ago`` and the like (week 7, month 30 days), then ``Jan 5, 2024``, else today; as a date."""
    n = F.regexp_extract(c, r"(\d+)", 1).try_cast("int")
    out = F.when(c.rlike(r"\d+ day.* ago"), now - F.make_dt_interval(days=n))
    out = out.when(c.rlike(r"\d+ hour.* ago"), now - F.make_dt_interval(hours=n))
    out = out.when(c.rlike(r"\d+ week.* ago"), now - F.make_dt_interval(days=n * F.lit(WEEK_DAYS)))
    out = out.when(c.rlike(r"\d+ month.* ago"), now - F.make_dt_interval(days=n * F.lit(MONTHS_DAYS)))
    written = F.try_to_timestamp(c, F.lit("MMM d, yyyy")).cast("timestamp_ntz")
    return F.coalesce(out.otherwise(written), now).cast("date")


def iso_instant(c: Column, fallback: Column) -> Column:
    """A written ISO date or time as a wall time, the fallback where it is written otherwise; NULL stays NULL."""
    told = F.when(c.rlike(r"^\d{4}-\d\d-\d\d(?:[T ]\d\d:\d\d(?::\d\d(?:\.\d{1,6})?)?)?$"), c.try_cast("timestamp_ntz"))
    return F.when(c.isNotNull(), F.coalesce(told, fallback))


def posting_date(attribute: Column, text: Column, now: Column) -> Column:
    """The ISO attribute of a card's date if it has one, else its text by :func:`long_relative`."""
    return F.coalesce(F.when(attribute.rlike(r"^\d{4}-\d\d-\d\d"), F.substring(attribute, 1, 10).try_cast("date")), long_relative(text, now))


def local_date(c: Column, hours: int = 8) -> Column:
    """The calendar day at a fixed distance from UTC (Hong Kong time by default) as ``yyyy-MM-dd``."""
    return F.date_format(c + F.make_dt_interval(hours=F.lit(hours)), "yyyy-MM-dd")
