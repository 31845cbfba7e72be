"""Monthly analytics. Rows have by columns (books), ts, amount_paise, direction, category, merchant and id.

Each aggregate is one scan with map-side partial sums and one shuffle on (by, month, key).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import cal
from ledgerloom.functions.money import div

BY = ("book_id",)
#: Categories kept apart from spending.
INVESTED, INSURED = "Investments", "Insurance"
OTHER = "Other"


def is_debit() -> Column:
    return F.col("direction") == "debit"


def is_credit() -> Column:
    return F.col("direction") == "credit"


def _sum(when: Column, what: Column | None = None) -> Column:
    return F.coalesce(F.sum(F.when(when, F.col("amount_paise") if what is None else what)), F.lit(0)).cast("bigint")


def month_stats(rows: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """income, spend, invested, insured, out and net of each month."""
    cat = F.coalesce("category", F.lit(""))
    out = rows.groupBy(*by, cal.month_key(F.col("ts")).alias("month")).agg(
        _sum(is_credit()).alias("income"), _sum(is_debit() & ~cat.isin(INVESTED, INSURED)).alias("spend"), _sum(is_debit() & (cat == INVESTED)).alias("invested"), _sum(is_debit() & (cat == INSURED)).alias("insured")
    )
    paid = F.col("spend") + F.col("invested") + F.col("insured")
    return out.withColumn("paid", paid).withColumn("net", F.col("income") - F.col("paid"))


def trend_dense(rows: DataFrame, last_month: int, n: int = 12, by: Sequence[str] = BY) -> DataFrame:
    """The last n months for each book, absent ones with zeros. ``last_month`` is a month index."""
    months = rows.select(*by).distinct().withColumn("m", F.explode(F.sequence(F.lit(last_month - n + 1), F.lit(last_month))))
    months = months.select(*by, cal.month_of_index(F.col("m")).alias("month"))
    sums = ("income", "spend", "invested", "insured", "paid", "net")
    inside = rows.where(cal.month_index(F.col("ts")).between(last_month - n + 1, last_month))
    return months.join(month_stats(inside, by), [*by, "month"], "left").na.fill(0, list(sums))


def debit_totals(rows: DataFrame, key: str, by: Sequence[str] = BY) -> DataFrame:
    """total and n of debits for each month and key."""
    return rows.where(is_debit()).groupBy(*by, cal.month_key(F.col("ts")).alias("month"), key).agg(F.sum("amount_paise").alias("total"), F.count("*").alias("n"))


def top_k(totals: DataFrame, key: str, k: int, by: Sequence[str] = BY) -> DataFrame:
    """The k largest of each month with their rank, ties by key."""
    rank = F.row_number().over(Window.partitionBy(*by, "month").orderBy(F.desc("total"), F.asc(key)))
    return totals.withColumn("rank", rank).where(F.col("rank") <= k)


def category_breakdown(rows: DataFrame, top: int = 6, by: Sequence[str] = BY) -> DataFrame:
    """The largest categories of each month in order, the rest in one last row."""
    totals = debit_totals(rows.withColumn("category", F.coalesce("category", F.lit("Uncategorized"))), "category", by)
    w = Window.partitionBy(*by, "month")
    ranked = totals.withColumn("rank", F.row_number().over(w.orderBy(F.desc("total"), F.asc("category"))))
    cut = F.col("rank") > top
    grouped = ranked.groupBy(*by, "month", F.least("rank", F.lit(top + 1)).alias("place")).agg(F.max(F.when(~cut, F.col("category")).otherwise(OTHER)).alias("category"), F.sum("total").alias("total"))
    return grouped.select(*by, "month", "place", "category", "total")


def category_share(rows: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Each category's whole percent of a month's debits, rounded half up."""
    totals = debit_totals(rows.withColumn("category", F.coalesce("category", F.lit("Uncategorized"))), "category", by)
    whole = F.sum("total").over(Window.partitionBy(*by, "month"))
    return totals.withColumn("whole", whole).select(*by, "month", "category", "total", div(F.col("total") * 200 + F.col("whole"), F.col("whole") * 2).alias("percent"))


def month_compare(rows: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Each category this month and the month before, with the change and its rank by size."""
    t = rows.where(is_debit()).groupBy(*by, cal.month_index(F.col("ts")).alias("m"), F.coalesce("category", F.lit("Uncategorized")).alias("category")).agg(F.sum("amount_paise").alias("now"))
    before = t.select(*by, (F.col("m") + 1).alias("m"), "category", F.col("now").alias("before"))
    both = t.join(before, [*by, "m", "category"], "full_outer").na.fill(0, ["now", "before"])
    # only months with spending of their own, after a month with spending
    months = t.select(*by, "m").distinct()
    seen = months.join(months.select(*by, (F.col("m") + 1).alias("m")), [*by, "m"], "left_semi")
    both = both.join(seen, [*by, "m"], "left_semi").withColumn("change", F.col("now") - F.col("before"))
    rank = F.row_number().over(Window.partitionBy(*by, "m").orderBy(F.desc(F.abs("change")), F.asc("category")))
    return both.select(*by, cal.month_of_index(F.col("m")).alias("month"), "category", "now", "before", "change", div(F.col("change") * 100, F.col("before")).alias("change_pct"), rank.alias("rank"))


def month_totals(rows: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    return rows.groupBy(*by, cal.month_key(F.col("ts")).alias("month")).agg(_sum(is_debit()).alias("spent"), F.count_if(is_debit()).alias("payments"), _sum(is_credit()).alias("received"))


def top_merchants(rows: DataFrame, k: int = 6, by: Sequence[str] = BY) -> DataFrame:
    named = rows.where(F.coalesce("merchant", F.lit("")) != "")
    return top_k(debit_totals(named, "merchant", by), "merchant", k, by)


# coverage


def document_months(docs: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Each document with each month its period touches."""
    months = F.sequence(cal.month_index(F.col("period_start")), cal.month_index(F.col("period_end")))
    return docs.where("period_start <= period_end").select(*by, "id", "source_raw", "period_start", "period_end", F.explode(months).alias("m"))


def coverage_grid(docs: DataFrame, pinned: DataFrame | None = None, by: Sequence[str] = BY) -> DataFrame:
    """Every month from the first to the last of a book, for every source of the book, with its documents."""
    cells = document_months(docs, by)
    months = cells.select(*by, "m") if pinned is None else cells.select(*by, "m").unionByName(pinned.select(*by, "m"))
    span = months.groupBy(*by).agg(F.min("m").alias("lo"), F.max("m").alias("hi")).select(*by, F.explode(F.sequence("lo", "hi")).alias("m"))
    sources = docs.select(*by, "source_raw").distinct()
    held = cells.groupBy(*by, "m", "source_raw").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    grid = span.join(sources, list(by)).join(held, [*by, "m", "source_raw"], "left")
    return grid.select(*by, cal.month_of_index(F.col("m")).alias("month"), "source_raw", F.coalesce(F.size("ids"), F.lit(0)).cast("bigint").alias("n_documents"), F.coalesce(F.array_join("ids", ","), F.lit("")).alias("document_ids"))


def complete_months(docs: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Months that lie inside a single period: by, m."""
    held = document_months(docs, by)
    return held.where((F.col("period_start") <= cal.month_start(F.col("m"))) & (F.col("period_end") >= cal.month_end(F.col("m")))).select(*by, "m").distinct()
