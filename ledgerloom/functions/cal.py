"""Calendar columns. Instants are UTC without zone; every calendar field is read at +05:30."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OFFSET = "INTERVAL 330 MINUTES"


def ist(ts: Column) -> Column:
    return ts + F.expr(OFFSET)


def utc(local: Column) -> Column:
    return local - F.expr(OFFSET)


def day(ts: Column) -> Column:
    return F.to_date(ist(ts))


def day_key(ts: Column) -> Column:
    """yyyy-MM-dd."""
    return F.date_format(ist(ts), "yyyy-MM-dd")


def compact_day(ts: Column) -> Column:
    """yyyyMMdd."""
    return F.date_format(ist(ts), "yyyyMMdd")


def month_key(ts: Column) -> Column:
    """yyyy-MM."""
    return F.date_format(ist(ts), "yyyy-MM")


def month_index(ts: Column) -> Column:
    """year * 12 + month - 1."""
    return (F.year(ist(ts)) * 12 + F.month(ist(ts)) - 1).cast("int")


def month_of_index(index: Column) -> Column:
    return F.format_string("%04d-%02d", F.floor(index / 12).cast("int"), (index % 12 + 1).cast("int"))


def days_between(earlier: Column, later: Column) -> Column:
    """Difference in calendar days."""
    return F.datediff(day(later), day(earlier))


def seconds_between(earlier: Column, later: Column) -> Column:
    """Elapsed whole seconds, NTZ-safe."""
    return epoch(later) - epoch(earlier)


def epoch(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def month_start(index: Column) -> Column:
    """First instant of the month, as UTC."""
    return utc(F.make_timestamp_ntz(F.floor(index / 12).cast("int"), (index % 12 + 1).cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))


def month_end(index: Column) -> Column:
    """Last whole second of the month, as UTC."""
    return month_start(index + 1) - F.expr("INTERVAL 1 SECOND")


def has_clock(ts: Column) -> Column:
    """Whether the local time is not midnight."""
    return F.date_format(ist(ts), "HHmmss") != "000000"
