"""Rule suggestions: payees without a category that cost enough, often enough; and frequent categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import cal
from ledgerloom.functions.money import div
from ledgerloom.functions.text import merchant_key
from ledgerloom.operators.rules import MISCELLANEOUS, UNCATEGORIZED

WINDOW_DAYS, MIN_ROWS, MIN_MONTHS, FLOOR_PAISE, SHARE_PCT = 90, 3, 2, 50000, 2


def modal_spelling(rows: DataFrame, keys: Sequence[str], raw: str) -> DataFrame:
    """keys, display: the most frequent spelling of each key, ties by spelling."""
    counts = rows.groupBy(*keys, raw).agg(F.count("*").alias("_n"))
    return counts.groupBy(*keys).agg(F.min_by(raw, F.struct(-F.col("_n"), F.col(raw))).alias("display"))


def _window(rows: DataFrame, now: Column) -> DataFrame:
    return rows.where((F.col("direction") == "debit") & (F.col("ts") >= now - F.expr(f"INTERVAL {WINDOW_DAYS} DAYS")) & (F.col("ts") <= now))


def suggestions(rows: DataFrame, now: Column, muted: DataFrame | None = None, by: Sequence[str] = ("book_id",)) -> DataFrame:
    """merchant_pattern, display, total, n and rank for each book, largest first."""
    recent = _window(rows, now).withColumn("key", merchant_key(F.col("merchant")))
    gate = recent.groupBy(*by).agg(F.greatest(F.lit(FLOOR_PAISE), div(F.sum("amount_paise") * SHARE_PCT, F.lit(100))).alias("gate"))
    open_rows = recent.where(F.coalesce("category", F.lit(UNCATEGORIZED)).isin(UNCATEGORIZED, MISCELLANEOUS) & (F.col("key") != ""))
    if muted is not None:
        open_rows = open_rows.join(muted.select("key"), "key", "left_anti")
    # one pass by spelling, a second by key: the spellings are pre-aggregated
    spelt = open_rows.groupBy(*by, "key", "merchant").agg(F.count("*").alias("n"), F.sum("amount_paise").alias("total"), F.collect_set(cal.month_index(F.col("ts"))).alias("m"))
    grouped = spelt.groupBy(*by, "key").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.size(F.array_distinct(F.flatten(F.collect_list("m")))).alias("months"), F.min_by("merchant", F.struct(-F.col("n"), F.col("merchant"))).alias("display"))
    kept = grouped.where((F.col("n") >= MIN_ROWS) & (F.col("months") >= MIN_MONTHS)).join(gate, list(by)).where("total >= gate")
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("total"), F.asc("key")))
    return kept.select(*by, F.col("key").alias("merchant_pattern"), "display", "total", "n", rank.alias("rank"))


def top_categories(rows: DataFrame, now: Column, seeds: Sequence[str], excluded: Sequence[str] = (UNCATEGORIZED, MISCELLANEOUS), k: int = 3, by: Sequence[str] = ("book_id",)) -> DataFrame:
    """The k categories with most debits in the window, topped up from the seeds in their order."""
    counts = _window(rows, now).where(F.col("category").isNotNull() & ~F.col("category").isin(*excluded)).groupBy(*by, "category").agg(F.count("*").alias("n"))
    books = rows.select(*by).distinct()
    seeded = books.withColumn("s", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(seeds) if c not in excluded)))).select(*by, F.col("s.c").alias("category"), F.col("s.i").alias("i"))
    both = counts.join(seeded, [*by, "category"], "full_outer").na.fill(0, ["n"])
    used = F.when(F.col("n") > 0, 0).otherwise(1)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(used, F.desc("n"), F.when(F.col("n") > 0, F.col("category")), F.col("i")))
    return both.withColumn("rank", rank).where(F.col("rank") <= k).select(*by, "rank", "category", "n")
