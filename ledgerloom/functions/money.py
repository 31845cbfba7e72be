"""Money columns: whole paise in BIGINT, the sign kept apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AMOUNT = r"^[+-]?[0-9]+(\.[0-9]{1,2})?$"


def plain_amount(text: Column) -> Column:
    """The cell without spaces around it and without commas."""
    return F.replace(F.btrim(text), F.lit(","), F.lit(""))


def is_amount(text: Column) -> Column:
    return F.coalesce(plain_amount(text).rlike(AMOUNT), F.lit(False))


def signed_paise(text: Column) -> Column:
    """Paise of an amount as people write it; null for anything else, and for sums beyond BIGINT."""
    plain = plain_amount(text)
    whole = F.regexp_replace(F.split_part(plain, F.lit("."), F.lit(1)), r"[+-]", "")
    part = F.rpad(F.split_part(plain, F.lit("."), F.lit(2)), 2, "0")
    paise = F.concat(F.when(plain.startswith("-"), F.lit("-")).otherwise(F.lit("")), whole, part).try_cast("bigint")
    return F.when(plain.rlike(AMOUNT), paise)


def group_indian(rupees: Column) -> Column:
    """Digits grouped as 12,34,567."""
    first = F.regexp_replace(F.reverse(rupees.cast("string")), r"^(\d{3})(?=\d)", "$1,")
    return F.reverse(F.regexp_replace(first, r"(?<=,)(\d{2})(?=\d)", "$1,"))


def inr(paise: Column) -> Column:
    """A rupee sum with sign, Indian grouping and two decimals."""
    size = F.abs(paise)
    return F.concat(
        F.when(paise < 0, F.lit("-")).otherwise(F.lit("")), F.lit("₹"), group_indian(div(size, F.lit(100))), F.lit("."), F.lpad((size % 100).cast("string"), 2, "0")
    )


def div(a: Column, b: Column) -> Column:
    """Integer division that truncates toward zero; null on zero."""
    return F.call_function("div", a.cast("bigint"), F.nullif(b.cast("bigint"), F.lit(0).cast("bigint")))


def cell_paise(raw: Column) -> Column:
    """Paise of a raw spreadsheet number; beyond two decimals the third one rounds half up."""
    t = F.btrim(raw)
    part = lambda i: F.regexp_extract(t, r"^(-?)(\d+)(?:\.(\d*))?$", i)
    digits = F.rpad(part(3), 3, "0")
    size = part(2).try_cast("bigint") * 100 + F.substring(digits, 1, 2).try_cast("int") + F.when(F.substring(digits, 3, 1) >= "5", 1).otherwise(0)
    return F.when(t.rlike(r"^-?\d+(\.\d*)?$"), F.when(part(1) == "-", -size).otherwise(size))


def whole_rupees(paise: Column) -> Column:
    """A rupee sum rounded half up to whole rupees, grouped, without decimals."""
    size = div(F.abs(paise) + 50, F.lit(100))
    return F.concat(F.when(paise < 0, F.lit("-")).otherwise(F.lit("")), F.lit("₹"), group_indian(size))


def permille(value: Column, total: Column, weight: int = 1) -> Column:
    return div(value * 1000, F.greatest(total, F.lit(1))) * weight


def pct_change(now: Column, before: Column) -> Column:
    return div((now - before) * 100, before)
