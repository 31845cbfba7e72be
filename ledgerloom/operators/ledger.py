"""The ledger: dedup, visibility, supersession, filters and projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import cal
from ledgerloom.operators.rules import source_kind


def dedup_batch(batch: DataFrame, stored: DataFrame | None, key: str = "content_hash", order: Sequence[str] = ("txn_at", "uuid")) -> DataFrame:
    """The first row for each key that is not stored yet. ``min_by`` keeps one row for each key map-side, so a hot key is one row per task."""
    cols = batch.columns
    first = batch.groupBy(key).agg(F.min_by(F.struct(*cols), F.struct(*(F.col(c).isNull() for c in order), *order)).alias("r")).select("r.*")
    return first if stored is None else first.join(stored.select(key).distinct(), key, "left_anti").select(*cols)


def import_report(batch: DataFrame, new: DataFrame, by: Sequence[str] = ("book_id",)) -> DataFrame:
    """Parsed and new rows of each book, and the months touched."""
    total = batch.groupBy(*by).agg(F.count("*").alias("parsed"))
    added = new.groupBy(*by).agg(F.count("*").alias("added"), F.count_distinct(cal.month_index(F.col("txn_at"))).alias("months"))
    return total.join(added, list(by), "left").na.fill(0, ["added", "months"])


def months_around(new: DataFrame, by: Sequence[str] = ("book_id",)) -> DataFrame:
    """The months of new rows and their neighbours: what a late row makes stale."""
    m = cal.month_index(F.col("txn_at"))
    return new.select(*by, F.explode(F.array(m - 1, m, m + 1)).alias("m")).distinct()


def visible(rows: DataFrame, matches: DataFrame, row_id: str = "id") -> DataFrame:
    """Rows without the bank sides of matches."""
    hidden = matches.select(F.col("bank_id").alias(row_id)).distinct()
    keep = source_kind(F.col("source_raw")) == "paymentApp"
    return rows.where(keep).unionByName(rows.where(~keep).join(hidden, row_id, "left_anti"))


def supersede_alerts(rows: DataFrame, by: Sequence[str] = ("book_id",)) -> tuple[DataFrame, DataFrame]:
    """The ledger without alert rows that an app export also holds (same reference and direction), its categories carried over.

    Returns the kept rows and the superseded alert rows.
    """
    key = [*by, "reference", "direction"]
    alert = F.col("source_raw") == "alert"
    has_ref = F.coalesce("reference", F.lit("")) != ""
    exports = rows.where(~alert & has_ref & (source_kind(F.col("source_raw")) == "paymentApp")).select(*key).distinct()
    gone = rows.where(alert & has_ref).join(exports, key, "left_semi")
    carried = gone.groupBy(*key).agg(F.min_by("category_override", F.when(F.col("category_override").isNotNull(), F.struct("txn_at", "uuid"))).alias("_carried"))
    kept = rows.join(gone.select("uuid"), "uuid", "left_anti").join(carried, key, "left")
    export = ~alert & (source_kind(F.col("source_raw")) == "paymentApp")
    kept = kept.withColumn("category_override", F.when(export, F.coalesce("category_override", "_carried")).otherwise(F.col("category_override")))
    return kept.select(*rows.columns), gone.select(*rows.columns)


def insert_absent(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``table`` plus the new rows whose key it lacks, one for each key."""
    return table.unionByName(new.dropDuplicates([key]).join(table.select(key), key, "left_anti").select(*table.columns))


def widen_periods(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Documents with periods stretched over their rows."""
    seen = rows.groupBy(F.col("document_id").alias("id")).agg(F.min("txn_at").alias("_lo"), F.max("txn_at").alias("_hi"))
    out = docs.join(seen, "id", "left")
    return out.select(*(F.least("period_start", "_lo").alias(c) if c == "period_start" else F.greatest("period_end", "_hi").alias(c) if c == "period_end" else F.col(c) for c in docs.columns))


def recategorize(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """Set a category where it is null or still the replaced one. ``changes`` has uuid, old_category, new_category."""
    c = changes.dropDuplicates(["uuid"]).select("uuid", "old_category", "new_category")
    out = rows.join(c, "uuid", "left")
    may = F.col("new_category").isNotNull() & (F.col("category_override").isNull() | F.col("category_override").eqNullSafe(F.col("old_category")))
    return out.withColumn("category_override", F.when(may, F.col("new_category")).otherwise(F.col("category_override"))).select(*rows.columns)


def erase_documents(rows: DataFrame, matches: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows and matches without those of some documents."""
    gone = rows.join(documents.select(F.col("id").alias("document_id")), "document_id", "left_semi").select("uuid")
    kept = matches.join(gone.withColumnRenamed("uuid", "app_id"), "app_id", "left_anti").join(gone.withColumnRenamed("uuid", "bank_id"), "bank_id", "left_anti")
    return rows.join(documents.select(F.col("id").alias("document_id")), "document_id", "left_anti").select(*rows.columns), kept.select(*matches.columns)


def shift_months(rows: DataFrame, to_month: int, ts: str = "txn_at") -> DataFrame:
    """All dates moved by whole months so that the newest month is ``to_month``; days clamp to the month's end."""
    newest = rows.agg(F.max(cal.month_index(F.col(ts))).alias("_newest"))
    local = cal.ist(F.col(ts))
    day = F.add_months(F.to_date(local), F.lit(to_month) - F.col("_newest"))
    moved = cal.utc(day.cast("timestamp_ntz") + (local - F.date_trunc("day", local).cast("timestamp_ntz")))
    return rows.crossJoin(F.broadcast(newest)).withColumn(ts, moved).select(*rows.columns)


def ledger_filter(
    rows: DataFrame, months: Sequence[str] = (), sources: Sequence[str] = (), categories: Sequence[str] = (), direction: str | None = None, least: int | None = None, most: int | None = None, text: str = ""
) -> DataFrame:
    """Filters of the ledger view: alternatives inside one, all of them together. Every part reaches the scan that can."""
    keep: Column = F.lit(True)
    if months:
        keep = keep & cal.month_key(F.col("txn_at")).isin(*months)
    if sources:
        keep = keep & F.col("source_raw").isin(*sources)
    if categories:
        keep = keep & F.col("category").isin(*categories)
    if direction:
        keep = keep & (F.col("direction") == direction)
    if least is not None:
        keep = keep & (F.col("amount_paise") >= least)
    if most is not None:
        keep = keep & (F.col("amount_paise") <= most)
    if text:
        rupees = F.concat((F.col("amount_paise") / 100).cast("decimal(20,2)").cast("string"))
        hay = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("counterparty", "narration", "reference", "category")]
        found = rupees.contains(text.lower())
        for h in hay:
            found = found | h.contains(text.lower())
        keep = keep & found
    return rows.where(keep)


#: Orders of the ledger view, each total through the id.
ORDERS = {"newest": ("txn_at", True), "oldest": ("txn_at", False), "largest": ("amount_paise", True), "smallest": ("amount_paise", False)}


def ordered(rows: DataFrame, order: str = "newest") -> DataFrame:
    col, down = ORDERS[order]
    return rows.orderBy(F.desc(col) if down else F.asc(col), F.asc("uuid"))


def search(rows: DataFrame, query: str, k: int = 8, by: Sequence[str] = ("book_id",)) -> DataFrame:
    """The newest k rows of each book in which each word is in the merchant or the category."""
    found = rows
    for w in query.lower().split():
        found = found.where(F.lower(F.coalesce("merchant", F.lit(""))).contains(w) | F.lower(F.coalesce("category", F.lit(""))).contains(w))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("ts"), F.asc("id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def expired(rows: DataFrame, now: Column, captured: str = "captured_at", days: int = 45) -> DataFrame:
    """Rows older than ``days`` elapsed whole days."""
    return rows.where(F.floor(cal.seconds_between(F.col(captured), now) / 86400) > days)


def prune(stored: DataFrame, live: DataFrame, key: str = "id") -> DataFrame:
    """Stored ids that still exist."""
    return stored.join(live.select(key).distinct(), key, "left_semi")


def first_of_section(rows: DataFrame, section: Sequence[str], order: Sequence[str], n: int = 30) -> DataFrame:
    """The first n rows of each section, each with the number of rows left out."""
    w = Window.partitionBy(*section)
    return rows.withColumn("_n", F.row_number().over(w.orderBy(*order))).withColumn("more", F.greatest(F.count("*").over(w) - n, F.lit(0))).where(F.col("_n") <= n).drop("_n")


def by_reference(wanted: DataFrame, rows: DataFrame, by: Sequence[str] = ("book_id",)) -> DataFrame:
    """For each wanted reference and direction the first row that has it."""
    key = [*by, "reference", "direction"]
    first = rows.where(F.coalesce("reference", F.lit("")) != "").groupBy(*key).agg(F.min_by("uuid", F.struct("txn_at", "uuid")).alias("uuid"))
    return wanted.join(first, key, "left")


def evidence_rows(cards: DataFrame, rows: DataFrame, card_id: str = "id") -> DataFrame:
    """Each card with the rows its evidence names."""
    return cards.select(F.col(card_id).alias("card_id"), F.posexplode("evidence").alias("place", "uuid")).join(rows, "uuid")


def ingest_report(new: DataFrame, stored: DataFrame, waiting: DataFrame, key: str = "capture_hash") -> DataFrame:
    """outcome, n: new rows that were added, that wait as memos, or that were known."""
    known, open_ = stored.select(key).distinct().withColumn("_k", F.lit(True)), waiting.select(key).distinct().withColumn("_w", F.lit(True))
    out = new.join(known, key, "left").join(open_, key, "left")
    return out.groupBy(F.when(F.col("_k"), "known").when(F.col("_w"), "waiting").otherwise("added").alias("outcome")).agg(F.count("*").alias("n"))
