"""Written dates as columns. A day that does not exist is null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Statement formats in order of preference, each with its shape.
FORMATS = {
    "dd/MM/yyyy": r"^\s*(\d{1,2})/(\d{1,2})/(\d{4})\s*$", "dd/MM/yy": r"^\s*(\d{1,2})/(\d{1,2})/(\d{2})\s*$", "dd-MM-yyyy": r"^\s*(\d{1,2})-(\d{1,2})-(\d{4})\s*$", "dd MMM yyyy": r"^\s*(\d{1,2})\s+([A-Za-z]{3,})\s+(\d{4})\s*$",
    "dd-MMM-yyyy": r"^\s*(\d{1,2})-([A-Za-z]{3,})-(\d{4})\s*$", "dd-MMM-yy": r"^\s*(\d{1,2})-([A-Za-z]{3,})-(\d{2})\s*$", "yyyy-MM-dd": r"^\s*(\d{4})-(\d{1,2})-(\d{1,2})\s*$",
}
#: Dates and clock times as alerts write them.
ISO_DAY = r"(?<![0-9])([0-9]{4})-([0-9]{2})-([0-9]{2})(?![0-9])"
NUMERIC_DAY = r"(?<![0-9])([0-9]{2})[-/]([0-9]{2})[-/]([0-9]{2,4})(?![0-9])"
NAMED_DAY = r"([0-9]{1,2})[- ]?([a-z]{3})[- ]?([0-9]{2,4})"
CLOCK = r"(?i)(?<![0-9:.])([01]?[0-9]|2[0-3]):([0-5][0-9])(?::[0-5][0-9])?(?:\s*([ap])\.?\s?m\b\.?)?(?![0-9:])"
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


def month_number(name: Column) -> Column:
    """1 … 12 from the first three letters; null otherwise."""
    at = F.instr(F.lit(_MONTHS), F.lower(F.substring(name, 1, 3)))
    return F.when((F.length(name) >= 3) & (at % 3 == 1), ((at + 2) / 3).cast("int"))


def made(year: Column, month: Column, day: Column) -> Column:
    """A day, or null if there is none."""
    text = F.format_string("%04d-%02d-%02d", year, month, day)
    return F.when(year.isNotNull() & month.between(1, 12) & day.between(1, 31), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))


_PARSE = {"dd/MM/yyyy": "d/M/yyyy", "dd/MM/yy": "d/M/yy", "dd-MM-yyyy": "d-M-yyyy", "dd MMM yyyy": "d MMM yyyy", "dd-MMM-yyyy": "d MMM yyyy", "dd-MMM-yy": "d MMM yy", "yyyy-MM-dd": "yyyy-M-d"}


def statement_day(text: Column, fmt: str) -> Column:
    """The day of a cell in one of the statement formats: its shape is checked, then it is parsed once."""
    t = F.btrim(text)
    if "MMM" in fmt:
        # the first three letters of a month, in the case the parser wants
        t = F.initcap(F.regexp_replace(t, r"[-\s]*([A-Za-z]{3})[A-Za-z]*[-\s]*", " $1 "))
    return F.when(text.rlike(FORMATS[fmt]), F.try_to_timestamp(t, F.lit(_PARSE[fmt])).cast("date"))


def first_format(cells: Column) -> Column:
    """The first statement format that parses all non-empty cells of an array; null if none does."""
    full = F.filter(cells, lambda c: F.coalesce(c, F.lit("")) != "")
    out = F.when(F.size(full) == 0, F.lit(None).cast("string"))
    for fmt in FORMATS:
        out = out.when(F.forall(full, _reads(fmt)), fmt)
    return out


def _reads(fmt: str) -> Callable[[Column], Column]:
    return lambda c: statement_day(c, fmt).isNotNull()


def alert_day(text: Column) -> Column:
    """The first readable date of an alert: ISO, then numeric, then with a named month."""
    low = F.lower(text)

    def at(pattern: str, y: int, m: int, d: int, named: bool = False) -> Column:
        part = lambda i: F.regexp_extract(low, pattern, i)
        year = part(y).try_cast("int")
        return made(F.when(year < 100, year + 2000).otherwise(year), month_number(part(m)) if named else part(m).try_cast("int"), part(d).try_cast("int"))

    iso = at(ISO_DAY, 1, 2, 3)
    numeric = at(NUMERIC_DAY, 3, 2, 1)
    named = at(NAMED_DAY, 3, 2, 1, True)
    return F.coalesce(iso, numeric, named)


def clock_minutes(text: Column) -> Column:
    """Minutes after midnight of the first clock time in a text."""
    hour, minute, half = (F.regexp_extract(text, CLOCK, i) for i in (1, 2, 3))
    h = hour.try_cast("int")
    twelve = F.when(h.between(1, 12), h % 12 + F.when(F.lower(half) == "p", 12).otherwise(0))
    return F.when(half == "", h).otherwise(twelve) * 60 + minute.try_cast("int")
