"""Spending insights for each book: trends, recurring payments, duplicates and outliers, ranked to cards.

Rows have by columns, id, ts, amount_paise, direction, category and merchant; ``now`` is a timestamp column. Detectors return cards
(id, kind, headline, detail, evidence, score, mute_kind, mute_key). All arithmetic is on whole paise.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import cal
from ledgerloom.functions.ident import insight_id
from ledgerloom.functions.money import div, inr
from ledgerloom.functions.text import merchant_key
from ledgerloom.operators.analytics import complete_months


@dataclass(frozen=True)
class InsightConfig:
    """Thresholds of the detectors and the ranker; amounts in paise."""

    trend_min_pct: int = 25
    trend_min_abs: int = 50_000
    trend_months: int = 3
    trend_look_back: int = 24
    concentration_pct: int = 70
    min_occurrences: int = 3
    monthly_days: tuple[int, int] = (28, 33)
    weekly_days: tuple[int, int] = (6, 8)
    spread_pct: int = 15
    changed_pct: int = 10
    new_months: int = 2
    active_cadences: int = 2
    outlier_multiple: int = 3
    outlier_min: int = 100_000
    min_priors: int = 5
    look_back_days: int = 35
    duplicate_minutes: int = 10
    max_cards: int = 5
    max_per_kind: int = 3
    weights: dict[str, int] = field(default_factory=lambda: {"trend": 1, "recurringNew": 3, "recurringChanged": 3, "possibleDuplicate": 4, "outlierAmount": 2, "committedSpend": 0})


BY = ("book_id",)
CARD = ("id", "kind", "headline", "detail", "evidence", "score", "mute_kind", "mute_key")


def latest_complete(docs: DataFrame, now: Column, by: Sequence[str] = BY) -> DataFrame:
    """by, latest: the newest complete month not after now's."""
    return complete_months(docs, by).where(F.col("m") <= cal.month_index(now)).groupBy(*by).agg(F.max("m").alias("latest"))


def denominators(rows: DataFrame, docs: DataFrame, now: Column, by: Sequence[str] = BY) -> DataFrame:
    """by, d: debits of the latest complete month, 1 at least, for every book."""
    m = rows.where("direction = 'debit'").groupBy(*by, cal.month_index(F.col("ts")).alias("latest")).agg(F.sum("amount_paise").alias("d"))
    total = latest_complete(docs, now, by).join(m, [*by, "latest"], "left")
    return rows.select(*by).distinct().join(total.select(*by, "d"), list(by), "left").select(*by, F.greatest(F.coalesce("d", F.lit(0)), F.lit(1)).cast("bigint").alias("d"))


def _card(kind: str, canonical: Column, headline: Column, detail: Column, evidence: Column, score: Column, mute_kind: str | None, mute_key: Column) -> list[Column]:
    return [
        insight_id(canonical).alias("id"), F.lit(kind).alias("kind"), headline.alias("headline"), detail.alias("detail"), evidence.alias("evidence"), score.cast("bigint").alias("score"),
        F.lit(mute_kind).cast("string").alias("mute_kind"), mute_key.cast("string").alias("mute_key"),
    ]


def trends(rows: DataFrame, docs: DataFrame, now: Column, c: InsightConfig = InsightConfig(), by: Sequence[str] = BY) -> tuple[DataFrame, DataFrame]:
    """Cards of categories that moved against their average of up to three complete months, and the ids of payments that drive one."""
    latest = latest_complete(docs, now, by)
    window = complete_months(docs, by).join(latest, list(by)).where((F.col("m") < F.col("latest")) & (F.col("m") >= F.col("latest") - c.trend_look_back))
    window = window.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("m")))).where(F.col("n") <= c.trend_months).select(*by, "m", "latest")
    size = window.groupBy(*by, "latest").agg(F.count("*").alias("w"))
    debits = rows.where("direction = 'debit'").withColumn("m", cal.month_index(F.col("ts"))).withColumn("category", F.coalesce("category", F.lit("Uncategorized")))
    base = debits.join(window.select(*by, "m"), [*by, "m"]).groupBy(*by, "category").agg(F.sum("amount_paise").alias("base"))
    now_rows = debits.join(size, list(by)).where(F.col("m") == F.col("latest"))
    # the driver is the first listed of the largest payments
    cur = now_rows.groupBy(*by, "latest", "w", "category").agg(
        F.sum("amount_paise").alias("cur"), F.min_by(F.struct("id", "amount_paise", "merchant"), F.struct(-F.col("amount_paise"), F.col("ts"), F.col("id"))).alias("top"), F.array_sort(F.collect_list("id")).alias("evidence")
    )
    avg = div(F.col("base"), F.col("w"))
    x = cur.join(base, [*by, "category"]).where("base > 0").withColumn("avg", avg).where("avg > 0").withColumn("delta", F.col("cur") - F.col("avg"))
    x = x.withColumn("pct", div(F.col("delta") * 100, F.col("avg"))).where((F.abs("pct") >= c.trend_min_pct) & (F.abs("delta") >= c.trend_min_abs))
    x = x.withColumn("drives", (F.col("delta") > 0) & (F.col("top.amount_paise") * 100 >= F.col("cur") * c.concentration_pct)).join(denominators(rows, docs, now, by), list(by))
    month = cal.month_of_index(F.col("latest"))
    s = lambda col: col.cast("string")
    detail = F.concat(F.when(F.col("pct") >= 0, F.lit("up ")).otherwise(F.lit("down ")), s(F.abs("pct")), F.lit("% vs your "), s(F.col("w")), F.lit("-month average"), F.when(F.col("drives"), F.concat(F.lit(" — driven by one "), inr(F.col("top.amount_paise")), F.lit(" payment to "), F.coalesce("top.merchant", F.lit("")))).otherwise(F.lit("")))
    score = div(F.abs("delta") * 1000, F.col("d")) * c.weights["trend"]
    canonical = F.concat_ws("|", F.lit("trend"), "category", month, s(F.col("pct")))
    cards = x.select(*by, *_card("trend", canonical, F.concat("category", F.lit(": "), inr(F.col("cur"))), detail, F.col("evidence"), score, "category", F.col("category")))
    return cards, x.where("drives").select(*by, F.col("top.id").alias("txn_id"))


def lower_median(values: Column) -> Column:
    """The element at (n − 1) ÷ 2 of the sorted array."""
    return F.get(F.array_sort(values), ((F.size(values) - 1) / 2).cast("int"))


def recurring_series(rows: DataFrame, now: Column, c: InsightConfig = InsightConfig(), by: Sequence[str] = BY) -> DataFrame:
    """Merchants paid monthly or weekly with a steady amount and still active."""
    debits = rows.where("direction = 'debit'").withColumn("key", merchant_key(F.col("merchant"))).where("key <> ''")
    order = Window.partitionBy(*by, "key").orderBy("ts", "id")
    gaps = debits.withColumn("gap", F.datediff(cal.day(F.col("ts")), F.lag(cal.day(F.col("ts"))).over(order)))
    # exact percentiles are counted by value, map-side, so a long series is no long array
    g = gaps.groupBy(*by, "key").agg(
        F.count("*").alias("n"), F.expr("percentile_disc(0.5) within group (order by gap)").cast("bigint").alias("gap"), F.expr("percentile_disc(0.5) within group (order by amount_paise)").cast("bigint").alias("median"),
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max_by("amount_paise", F.struct("ts", "id")).alias("latest_amount"),
        F.transform(F.array_sort(F.collect_list(F.struct("ts", "id"))), lambda x: x["id"]).alias("ids"),
    )
    cadence = F.when(F.col("gap").between(*c.monthly_days), "monthly").when(F.col("gap").between(*c.weekly_days), "weekly")
    g = g.where(F.col("n") >= c.min_occurrences).withColumn("cadence", cadence).where("cadence is not null and median > 0")
    stable = gaps.select(*by, "key", "amount_paise").join(g.select(*by, "key", "median"), [*by, "key"]).where(F.abs(F.col("amount_paise") - F.col("median")) * 100 <= F.col("median") * c.spread_pct)
    stable = stable.groupBy(*by, "key").agg(F.count("*").alias("stable")).where(F.col("stable") >= c.min_occurrences).select(*by, "key")
    most = F.when(F.col("cadence") == "monthly", c.monthly_days[1]).otherwise(c.weekly_days[1]) * c.active_cadences
    g = g.join(stable, [*by, "key"], "left_semi").where(F.datediff(cal.day(now), cal.day(F.col("last_seen"))) <= most)
    spelt = debits.groupBy(*by, "key", "merchant").agg(F.count("*").alias("c")).groupBy(*by, "key").agg(F.min_by("merchant", F.struct(-F.col("c"), F.col("merchant"))).alias("display"))
    g = g.join(spelt, [*by, "key"]).withColumn("monthly", F.when(F.col("cadence") == "monthly", F.col("median")).otherwise(div(F.col("median") * 52, F.lit(12))))
    return g.select(*by, "key", "display", "cadence", "median", "monthly", "first_seen", "last_seen", "n", "latest_amount", "ids")


def recurrences(rows: DataFrame, docs: DataFrame, now: Column, c: InsightConfig = InsightConfig(), by: Sequence[str] = BY) -> tuple[DataFrame, DataFrame]:
    """Cards of new and changed series and of the committed sum, and the ids of all members."""
    s = recurring_series(rows, now, c, by)
    x = s.join(denominators(rows, docs, now, by), list(by))
    word = F.when(F.col("cadence") == "monthly", F.lit(" per month")).otherwise(F.lit(" per week"))
    new = cal.month_index(F.col("first_seen")) >= cal.month_index(now) - c.new_months
    since = F.date_format(cal.ist(F.col("first_seen")), "MMM yyyy")
    text = lambda col: F.col(col).cast("string")
    fresh = x.where(new).select(*by, *_card("recurringNew", F.concat_ws("|", F.lit("recurring-new"), "key", text("median")), F.concat(F.lit("New recurring: "), "display"), F.concat(inr(F.col("median")), word, F.lit(" since "), since), F.col("ids"), div(F.col("monthly") * 1000, F.col("d")) * c.weights["recurringNew"], "merchant", F.col("key")))
    drift = F.abs(F.col("latest_amount") - F.col("median"))
    moved = x.where(~new & (drift * 100 >= F.col("median") * c.changed_pct))
    moved = moved.select(*by, *_card("recurringChanged", F.concat_ws("|", F.lit("recurring-changed"), "key", text("latest_amount")), F.concat("display", F.lit(": "), inr(F.col("latest_amount"))), F.concat(F.lit("usually "), inr(F.col("median")), word), F.col("ids"), div(drift * 1000, F.col("d")) * c.weights["recurringChanged"], "merchant", F.col("key")))
    total = s.groupBy(*by).agg(F.count("*").alias("k"), F.sum("monthly").alias("total"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("key", "ids"))), lambda v: v["ids"])).alias("ids")).where("k >= 2")
    committed = total.select(*by, *_card("committedSpend", F.concat_ws("|", F.lit("committed"), text("k"), text("total")), F.concat(inr(F.col("total")), F.lit(" per month committed")), F.concat(F.lit("across "), text("k"), F.lit(" recurring payments")), F.col("ids"), F.lit(0), None, F.lit(None)))
    return fresh.unionByName(moved).unionByName(committed), s.select(*by, F.explode("ids").alias("txn_id"))


def _recent(rows: DataFrame, now: Column, c: InsightConfig) -> DataFrame:
    keyed = rows.where("direction = 'debit'").withColumn("key", merchant_key(F.col("merchant"))).where("key <> ''")
    return keyed.where((F.col("ts") <= now) & (F.datediff(cal.day(now), cal.day(F.col("ts"))) <= c.look_back_days))


def duplicates(rows: DataFrame, docs: DataFrame, now: Column, c: InsightConfig = InsightConfig(), by: Sequence[str] = BY) -> DataFrame:
    """Cards of equal payments to one merchant on one day; close in time if all have a clock time."""
    recent = _recent(rows, now, c).withColumn("day", cal.day(F.col("ts"))).withColumn("sec", cal.epoch(F.col("ts")))
    bucket = [*by, "key", "day", "amount_paise"]
    step = recent.withColumn("gap", F.col("sec") - F.lag("sec").over(Window.partitionBy(*bucket).orderBy("sec", "id")))
    g = step.groupBy(*bucket).agg(F.count("*").alias("n"), F.bool_and(cal.has_clock(F.col("ts"))).alias("timed"), F.min("gap").alias("closest"), F.array_sort(F.collect_list("id")).alias("ids"), F.min_by("merchant", "id").alias("sample"))
    g = g.where((F.col("n") >= 2) & (~F.col("timed") | (F.col("closest") <= c.duplicate_minutes * 60))).join(denominators(rows, docs, now, by), list(by))
    n = F.col("n").cast("string")
    headline = F.concat("sample", F.lit(": "), inr(F.col("amount_paise")), F.lit(" ×"), n)
    detail = F.concat(n, F.lit(" identical payments on "), F.date_format("day", "d MMM"))
    return g.select(*by, *_card("possibleDuplicate", F.concat(F.lit("duplicate|"), F.array_join("ids", ",")), headline, detail, F.col("ids"), div(F.col("amount_paise") * 1000, F.col("d")) * c.weights["possibleDuplicate"], "merchant", F.col("key")))


def outliers(rows: DataFrame, docs: DataFrame, now: Column, c: InsightConfig = InsightConfig(), by: Sequence[str] = BY) -> DataFrame:
    """Cards of payments far above the median of all earlier ones to the merchant."""
    keyed = rows.where("direction = 'debit'").withColumn("key", merchant_key(F.col("merchant"))).where("key <> ''")
    # only payments of the least size can be outliers, and only their merchants' payments are their priors
    big = _recent(rows, now, c).where(F.col("amount_paise") >= c.outlier_min).select(*by, "key", "id", "ts", "amount_paise", "merchant")
    prior = keyed.select(*by, "key", F.col("ts").alias("p_ts"), F.col("amount_paise").alias("p"))
    pairs = big.join(prior, [*by, "key"]).where("p_ts < ts")
    g = pairs.groupBy(*by, "key", "id", "amount_paise", "merchant").agg(F.count("*").alias("n"), F.expr("percentile_disc(0.5) within group (order by p)").cast("bigint").alias("typical"))
    g = g.where((F.col("n") >= c.min_priors) & (F.col("typical") > 0) & (F.col("amount_paise") >= F.col("typical") * c.outlier_multiple)).join(denominators(rows, docs, now, by), list(by))
    detail = F.concat(F.lit("about "), div(F.col("amount_paise"), F.col("typical")).cast("string"), F.lit("× your usual "), inr(F.col("typical")))
    return g.select(*by, *_card("outlierAmount", F.concat(F.lit("outlier|"), F.col("id").cast("string")), F.concat("merchant", F.lit(": "), inr(F.col("amount_paise"))), detail, F.array("id"), div(F.col("amount_paise") * 1000, F.col("d")) * c.weights["outlierAmount"], "merchant", F.col("key")))


def all_insights(rows: DataFrame, docs: DataFrame, now: Column, c: InsightConfig = InsightConfig(), by: Sequence[str] = BY) -> tuple[DataFrame, DataFrame]:
    """Every card that survives, and every id that was made."""
    trend_cards, concentrated = trends(rows, docs, now, c, by)
    series_cards, claimed = recurrences(rows, docs, now, c, by)
    dup, out = duplicates(rows, docs, now, c, by), outliers(rows, docs, now, c, by)
    explained = claimed.unionByName(concentrated).unionByName(dup.select(*by, F.explode("evidence").alias("txn_id"))).distinct()
    kept = out.withColumn("txn_id", F.get("evidence", F.lit(0))).join(explained, [*by, "txn_id"], "left_anti").drop("txn_id")
    base = trend_cards.unionByName(series_cards).unionByName(dup)
    return base.unionByName(kept), base.unionByName(out).select(*by, "id").distinct()


def rank_cards(cards: DataFrame, dismissed: DataFrame | None = None, muted: DataFrame | None = None, c: InsightConfig = InsightConfig(), by: Sequence[str] = BY) -> DataFrame:
    """The cards of each book in order: by score, at most three of a kind, the committed sum last in a place of its own."""
    live = cards
    if dismissed is not None:
        live = live.join(dismissed.select("id"), "id", "left_anti")
    if muted is not None:
        live = live.join(muted.select("mute_kind", "mute_key"), ["mute_kind", "mute_key"], "left_anti")
    live = live.withColumn("last", (F.col("kind") == "committedSpend"))
    order = [F.asc("last"), F.desc("score"), F.asc("id")]
    live = live.withColumn("of_kind", F.row_number().over(Window.partitionBy(*by, "kind").orderBy(*order[1:]))).where((F.col("of_kind") <= c.max_per_kind) & (~F.col("last") | (F.col("of_kind") == 1)))
    # the committed card holds one of the places, so the others have one less
    book = Window.partitionBy(*by)
    live = live.withColumn("place", F.row_number().over(book.orderBy(*order))).withColumn("held", F.max(F.col("last").cast("int")).over(book))
    live = live.where(F.col("last") | (F.col("place") <= c.max_cards - F.col("held")))
    return live.withColumn("place", F.row_number().over(book.orderBy(*order))).select(*by, "place", *CARD)


def insight_cards(rows: DataFrame, docs: DataFrame, now: Column, c: InsightConfig = InsightConfig(), by: Sequence[str] = BY, dismissed: DataFrame | None = None, muted: DataFrame | None = None) -> DataFrame:
    return rank_cards(all_insights(rows, docs, now, c, by)[0], dismissed, muted, c, by)
