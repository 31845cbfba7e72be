"""Rows that fail to parse: a strict load, and the remainder with its reason.

The strict load keeps only lines that conform in every respect and types them. What it
did not take is found by an anti-join on the record offsets, and only that remainder is
diagnosed. A line comes out on exactly one side.

Defined cases: a null line is one empty field, hence ``column_count``; a null offset is
an offset of its own (null-safe join); lines that share an offset are told apart by a
digest of their text; a sum beyond BIGINT paise loads with a null amount cast, so it is
read through DECIMAL; extra columns of the input are carried through untouched; an empty
table gives two empty tables. Quoting is checked without a recursive pattern, so very
long lines are safe.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import AMOUNT, plain_amount

#: Stands for a comma inside quotes while a line is cut; a Unicode noncharacter.
_COMMA = "\uffff"

FIELDS = ("date_text", "narration", "ref_text", "withdrawal_text", "deposit_text", "balance_text")


@dataclass(frozen=True)
class Loaded:
    rows: DataFrame
    rejects: DataFrame


def _segments(line: Column) -> Column:
    """Pieces between double quotes; those at odd places lie inside quotes."""
    return F.split(F.coalesce(line, F.lit("")), '"', -1)


def quoting_ok(line: Column) -> Column:
    """Whether each field is free of quotes or wholly enclosed in them with inner ones doubled.

    A piece outside quotes is empty (then its two quotes are one doubled quote) or is
    bounded by commas on the sides where quotes stand.
    """
    parts = _segments(line)
    last = F.size(parts) - 1

    def bad(x: Column, i: Column) -> Column:
        outside = i % 2 == 0
        left = (i == 0) | x.startswith(",")
        right = (i == last) | x.endswith(",")
        return outside & (x != "") & ~(left & right)

    flags = F.transform(parts, lambda x, i: bad(x, i))
    return (last % 2 == 0) & ~F.exists(flags, lambda b: b)


def fields(line: Column) -> Column:
    """The cells of a line whose quoting is right."""
    hidden = F.array_join(F.transform(_segments(line), lambda x, i: F.when(i % 2 == 1, F.replace(x, F.lit(","), F.lit(_COMMA))).otherwise(x)), '"')

    def bare(x: Column) -> Column:
        inner = F.when(x.startswith('"'), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x)
        return F.replace(inner, F.lit(_COMMA), F.lit(","))

    return F.transform(F.split(hidden, ",", -1), bare)


def statement_date(text: Column) -> Column:
    """The day of a dd/MM/yy cell, or null if there is no such day."""
    return F.when(text.rlike(r"^[0-9]{2}/[0-9]{2}/[0-9]{2}$"), F.try_to_timestamp(text, F.lit("dd/MM/yy")).cast("date"))


def _amount(text: Column) -> Column:
    return F.coalesce(plain_amount(text).rlike(AMOUNT), F.lit(False))


def paise(text: Column) -> Column:
    return F.when(_amount(text), (plain_amount(text).try_cast("decimal(36,2)") * 100).try_cast("bigint"))


def _cut(rows: DataFrame, line: str) -> DataFrame:
    cells = rows.withColumn("_ok", quoting_ok(F.col(line))).withColumn("_f", F.when(F.col("_ok"), fields(F.col(line))))
    at = lambda i: F.get(F.col("_f"), F.lit(i))
    return cells.select("*", *(at(i).alias(f"_{name}") for i, name in enumerate(FIELDS)))


def _tests() -> list[tuple[str, Column]]:
    """Reason and the condition under which it holds, in order of precedence."""
    empty = lambda c: F.col(c) == ""
    return [
        ("quoting", ~F.col("_ok")),
        ("column_count", F.size("_f") != len(FIELDS)),
        ("date_text", statement_date(F.col("_date_text")).isNull()),
        ("withdrawal_text", ~empty("_withdrawal_text") & ~_amount(F.col("_withdrawal_text"))),
        ("deposit_text", ~empty("_deposit_text") & ~_amount(F.col("_deposit_text"))),
        ("balance_text", ~_amount(F.col("_balance_text"))),
        ("amount_sides", empty("_withdrawal_text") == empty("_deposit_text")),
    ]


def strict_load(raw: DataFrame, line: str = "line_text") -> DataFrame:
    """Conforming lines only, typed; every other line is left out."""
    cut = _cut(raw, line)
    good = F.lit(True)
    for _, broken in _tests():
        good = good & ~F.coalesce(broken, F.lit(True))
    out = (F.col("_withdrawal_text") != "").alias("_out")
    return (
        cut.where(good)
        .withColumn("_is_debit", out)
        .select(
            *raw.columns,
            statement_date(F.col("_date_text")).alias("txn_date"),
            F.col("_narration").alias("narration"),
            F.nullif(F.ltrim(F.col("_ref_text"), F.lit("0")), F.lit("")).alias("reference"),
            F.when(F.col("_is_debit"), "debit").otherwise("credit").alias("direction"),
            paise(F.when(F.col("_is_debit"), F.col("_withdrawal_text")).otherwise(F.col("_deposit_text"))).alias("amount_paise"),
            paise(F.col("_balance_text")).alias("balance_paise"),
        )
    )


def load(raw: DataFrame, offset: str = "row_id", line: str = "line_text") -> Loaded:
    """Typed rows, and the lines left over with the first reason that holds.

    ``raw`` has a record offset and the line; names taken by the typed columns are dropped from it.
    """
    taken = {"txn_date", "narration", "reference", "direction", "amount_paise", "balance_paise", "reason"}
    raw = raw.select(*(c for c in raw.columns if c in (offset, line) or c.lower() not in taken and not c.startswith("_")))
    rows = strict_load(raw, line)
    mark = lambda df: df.select(F.col(offset).alias("_o"), F.xxhash64(line).alias("_h"))
    left = raw.withColumns({"_o": F.col(offset), "_h": F.xxhash64(line)})
    loaded = mark(rows).withColumnsRenamed({"_o": "_lo", "_h": "_lh"})
    remainder = left.join(loaded, F.col("_o").eqNullSafe(F.col("_lo")) & (F.col("_h") == F.col("_lh")), "left_anti").drop("_o", "_h")
    reason = None
    for name, broken in _tests():
        reason = F.when(broken, name) if reason is None else reason.when(broken, name)
    return Loaded(rows, _cut(remainder, line).select(*raw.columns, reason.alias("reason")))


def summary(loaded: Loaded) -> DataFrame:
    """Lines by outcome; loaded ones under ``loaded``."""
    ok = loaded.rows.agg(F.count("*").alias("n_lines")).select(F.lit("loaded").alias("reason"), "n_lines")
    return ok.unionByName(loaded.rejects.groupBy("reason").agg(F.count("*").alias("n_lines")))
