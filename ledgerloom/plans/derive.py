"""Relations that the queries share, derived from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import match
from ledgerloom.operators.ledger import supersede_alerts, visible
from ledgerloom.operators.rules import longest_match, source_kind
from ledgerloom.session import stored, table

#: Category rules of the queries: pattern and category.
RULES = (
    ("restaurant", "Food"), ("bakery", "Food"), ("dairy", "Groceries"), ("provision", "Groceries"), ("pharmacy", "Health"), ("medical", "Health"), ("hospital", "Health"), ("motors", "Transport"), ("tours", "Travel"), ("travels", "Travel"),
    ("electronics", "Shopping"), ("textiles", "Shopping"), ("jewellers", "Investments"), ("hardware", "Home"), ("builders", "Home"), ("book house", "Education"), ("tuition", "Education"), ("stationery", "Education"), ("rent", "Rent"), ("services", "Bills"),
    ("society dues", "Bills"), ("loan part", "Loans"), ("medicine", "Health"), ("medical stores limited", "Pharmacy chain"), ("enterprises", "Business"), ("agencies", "Business"), ("traders", "Business"), ("advance", "Insurance"),
)
#: The instant that counts as now.
NOW = "2026-06-30 06:30:00"


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def payee_text() -> Column:
    return F.concat_ws(" ", F.coalesce("counterparty", F.lit("")), F.coalesce("narration", F.lit("")))


def _first_rows(spark: SparkSession, d: str) -> DataFrame:
    """Stored transactions, the first of each content hash."""
    t = table(spark, d, "stored_transactions")
    cols = ["uuid", "book_id", "source_raw", "txn_at", "amount_paise", "direction", "counterparty", "reference", "narration", "category_override"]
    return t.groupBy("content_hash").agg(F.min_by(F.struct(*cols), F.struct("txn_at", "uuid")).alias("r")).select("r.*")


def _categorized(rows: DataFrame) -> DataFrame:
    return rows.withColumn("category", F.coalesce(F.nullif("category_override", F.lit("")), longest_match(payee_text(), RULES)))


def ledger(spark: SparkSession, d: str) -> DataFrame:
    """Stored transactions, the first of each content hash, with their category."""
    return _categorized(_first_rows(spark, d))


def ledger_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The ledger without superseded alerts, written once, and its app and bank sides."""
    rows = stored(supersede_alerts(_first_rows(spark, d))[0], "ledger-rows")
    sides = rows.select("book_id", F.col("uuid").alias("id"), F.col("txn_at").alias("ts"), "amount_paise", "direction", "reference", "source_raw")
    app, bank = (sides.where(source_kind(F.col("source_raw")) == kind) for kind in ("paymentApp", "bank"))
    return rows, app, bank


def insight_rows(spark: SparkSession, d: str) -> DataFrame:
    """The ledger as insight rows, each payment once: without alerts that an export holds, bank sides of matches and own transfers.

    The narration stands in for an empty payee. Rows are written once, as the matching and all readers need them.
    """
    rows, app, bank = ledger_sides(spark, d)
    transfers = match.self_transfers(bank)
    flagged = stored(transfers.select(F.explode(F.array("debit_id", "credit_id")).alias("id")), "own-transfers")
    own_alerts = match.alert_self_transfers(app.where("source_raw = 'alert'"), bank.join(flagged, "id", "left_semi"))
    own = flagged.union(own_alerts).distinct().withColumnRenamed("id", "uuid")
    kept = _categorized(visible(rows, match.reconcile(app, bank), "uuid").join(own, "uuid", "left_anti"))
    merchant = F.coalesce(F.nullif("counterparty", F.lit("")), F.col("narration"))
    return stored(kept.select("book_id", F.col("uuid").alias("id"), F.col("txn_at").alias("ts"), "amount_paise", "direction", "category", merchant.alias("merchant")), "insight-rows")


def recon(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """App and bank rows, the first of each id."""
    def side(name: str, key: str) -> DataFrame:
        t = table(spark, d, name).where("txn_at is not null and amount_paise is not null")
        r = t.groupBy(F.col(key).alias("id")).agg(F.min(F.struct("txn_at", "book_id", "amount_paise", "direction", F.coalesce("reference", F.lit("")).alias("reference"))).alias("r"))
        return r.select("id", "r.book_id", F.col("r.txn_at").alias("ts"), "r.amount_paise", "r.direction", "r.reference", F.when(F.col("id") % 3 == 0, "hdfc").when(F.col("id") % 3 == 1, "idfc").otherwise("bank:sbi").alias("source_raw"))

    return side("recon_app", "app_id"), side("recon_bank", "bank_id")


def statement_tables(spark: SparkSession, d: str) -> DataFrame:
    """Statement files as table rows: the header at row 0 where there is one, then the body."""
    f = table(spark, d, "statement_files")
    head = F.when(F.size("header_row") > 0, F.array("header_row")).otherwise(F.array().cast("array<array<string>>"))
    return f.select(F.col("file_id").alias("doc_id"), F.posexplode(F.concat(head, "body_rows")).alias("row_ix", "cells"))


_RULE_VALUES = ", ".join(f"({i}, '{p}', '{c}')" for i, (p, c) in enumerate(RULES))


def greedy_sql(name: str, left: str, right: str, key: tuple[str, ...], more: str = "") -> str:
    """CTEs up to ``name`` (lid, rid): left rows in order of (ts, id) take the nearest free right row of their key within two days.

    A recursion over the left rows of each key, which carries the right rows that are taken.
    """
    on = " AND ".join(f"l.{c} = r.{c}" for c in key)
    gap = "abs(epoch_us(l.ts) - epoch_us(r.ts))"
    return f"""
{name}_c AS (SELECT concat_ws('|', {', '.join(f'l.{c}' for c in key)}) AS k, l.id AS lid, l.ts, list(r.id ORDER BY {gap}, r.ts, r.id) AS rids FROM {left} l JOIN {right} r ON {on} AND {gap} <= 172800000000 {more} GROUP BY 1, 2, 3),
{name}_o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts, lid) AS n FROM {name}_c),
{name}_s AS (SELECT k, n, lid, rids[1] AS rid, [rids[1]] AS used FROM {name}_o WHERE n = 1
  UNION ALL SELECT k, n, lid, pick, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END FROM (SELECT o.k, o.n, o.lid, s.used, list_filter(o.rids, lambda x: NOT list_contains(s.used, x))[1] AS pick FROM {name}_s s JOIN {name}_o o ON o.k = s.k AND o.n = s.n + 1)),
{name} AS (SELECT lid, rid FROM {name}_s WHERE rid IS NOT NULL)"""


def reconcile_sql(name: str, app: str, bank: str) -> str:
    """CTEs up to ``name`` (app_id, bank_id, tier): both tiers over two relations with book_id, id, ts, amount_paise, direction, reference."""
    key = ("book_id", "reference", "direction")
    first = lambda df: f"(SELECT {', '.join(key)}, arg_min(id, (ts, id)) AS id FROM {df} WHERE coalesce(reference, '') <> '' GROUP BY ALL)"
    rest = lambda df, side: f"(SELECT * FROM {df} WHERE ts IS NOT NULL AND amount_paise IS NOT NULL AND id NOT IN (SELECT {side} FROM {name}_1))"
    return f"""
{name}_1 AS (SELECT x.id AS app_id, y.id AS bank_id FROM {first(app)} x JOIN {first(bank)} y USING ({', '.join(key)})),
{name}_a AS {rest(app, 'app_id')}, {name}_b AS {rest(bank, 'bank_id')},{greedy_sql(f"{name}_2", f"{name}_a", f"{name}_b", ("book_id", "amount_paise", "direction"))},
{name} AS (SELECT app_id, bank_id, 'reference' AS tier FROM {name}_1 UNION ALL SELECT lid, rid, 'amountDate' FROM {name}_2)"""


#: SQL of the relations above, as common table expressions. They need WITH RECURSIVE.
LEDGER_SQL = f"""
rules(i, p, c) AS (VALUES {_RULE_VALUES}),
first_rows AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY txn_at, uuid) AS rn FROM stored_transactions) WHERE rn = 1),
hits AS (SELECT f.uuid, r.c, row_number() OVER (PARTITION BY f.uuid ORDER BY length(r.p) DESC, r.i) AS n FROM first_rows f JOIN rules r ON contains(lower(concat_ws(' ', coalesce(f.counterparty, ''), coalesce(f.narration, ''))), r.p)),
ledger AS (SELECT f.uuid, book_id, source_raw, txn_at, amount_paise, direction, counterparty, reference, narration, category_override, coalesce(nullif(category_override, ''), h.c, 'Uncategorized') AS category,
  txn_at + INTERVAL 330 MINUTE AS ist FROM first_rows f LEFT JOIN hits h ON h.uuid = f.uuid AND h.n = 1),
exports AS (SELECT DISTINCT book_id, reference, direction FROM first_rows WHERE coalesce(reference, '') <> '' AND (source_raw IN ('gpay', 'paytm', 'bhim') OR starts_with(source_raw, 'upi:'))),
superseded AS (SELECT * FROM first_rows SEMI JOIN exports USING (book_id, reference, direction) WHERE source_raw = 'alert'),
carried AS (SELECT book_id, reference, direction, arg_min(category_override, (txn_at, uuid)) FILTER (WHERE category_override IS NOT NULL) AS carried FROM superseded GROUP BY 1, 2, 3),
kept AS (SELECT f.* REPLACE (CASE WHEN source_raw IN ('gpay', 'paytm', 'bhim') OR starts_with(source_raw, 'upi:') THEN coalesce(category_override, carried) ELSE category_override END AS category_override) FROM first_rows f LEFT JOIN carried c USING (book_id, reference, direction) WHERE f.uuid NOT IN (SELECT uuid FROM superseded)),
sides AS (SELECT book_id, uuid AS id, txn_at AS ts, amount_paise, direction, reference, source_raw, source_raw IN ('gpay', 'paytm', 'bhim', 'alert') OR starts_with(source_raw, 'upi:') AS app FROM kept),
app_rows AS (SELECT * FROM sides WHERE app), bank_rows AS (SELECT * FROM sides WHERE NOT app), bank_debits AS (SELECT * FROM bank_rows WHERE direction = 'debit'), bank_credits AS (SELECT * FROM bank_rows WHERE direction = 'credit'),{greedy_sql("moved", "bank_debits", "bank_credits", ("book_id", "amount_paise"), "AND l.source_raw <> r.source_raw")},
flagged AS (SELECT lid AS id FROM moved UNION SELECT rid FROM moved),
both_ways AS (SELECT book_id, reference, amount_paise FROM app_rows WHERE source_raw = 'alert' AND reference <> '' GROUP BY 1, 2, 3 HAVING count(DISTINCT direction) = 2),
own AS (SELECT id FROM flagged UNION SELECT id FROM app_rows JOIN both_ways USING (book_id, reference, amount_paise) WHERE source_raw = 'alert' UNION SELECT x.id FROM app_rows x JOIN (SELECT book_id, reference FROM bank_rows WHERE id IN (SELECT id FROM flagged)) y USING (book_id, reference) WHERE source_raw = 'alert' AND x.reference <> ''),{reconcile_sql("matched", "app_rows", "bank_rows")},
shown AS (SELECT * FROM kept WHERE uuid NOT IN (SELECT id FROM own) AND uuid NOT IN (SELECT bank_id FROM matched)),
shown_hits AS (SELECT f.uuid, r.c, row_number() OVER (PARTITION BY f.uuid ORDER BY length(r.p) DESC, r.i) AS n FROM shown f JOIN rules r ON contains(lower(concat_ws(' ', coalesce(f.counterparty, ''), coalesce(f.narration, ''))), r.p)),
told AS (SELECT f.*, coalesce(nullif(category_override, ''), h.c, 'Uncategorized') AS category, txn_at + INTERVAL 330 MINUTE AS ist FROM shown f LEFT JOIN shown_hits h ON h.uuid = f.uuid AND h.n = 1),
insight_rows AS MATERIALIZED (SELECT book_id, uuid AS id, txn_at AS ts, ist, CAST(ist AS DATE) AS day, strftime(ist, '%Y-%m') AS month, year(ist) * 12 + month(ist) - 1 AS m, amount_paise, direction, category, coalesce(nullif(counterparty, ''), narration) AS merchant FROM told),
keyed AS (SELECT *, array_to_string(regexp_extract_all(lower(merchant), '\\p{{L}}+')[1:3], ' ') AS key FROM insight_rows)"""
RECON_SQL = """
app AS (SELECT app_id AS id, min({'ts': txn_at, 'b': book_id, 'a': amount_paise, 'd': direction, 'r': coalesce(reference, '')}) AS s FROM recon_app WHERE txn_at IS NOT NULL AND amount_paise IS NOT NULL GROUP BY 1),
bank AS (SELECT bank_id AS id, min({'ts': txn_at, 'b': book_id, 'a': amount_paise, 'd': direction, 'r': coalesce(reference, '')}) AS s FROM recon_bank WHERE txn_at IS NOT NULL AND amount_paise IS NOT NULL GROUP BY 1),
a AS (SELECT id, s.b AS book_id, s.ts AS ts, s.a AS amount_paise, s.d AS direction, s.r AS reference FROM app),
b AS (SELECT id, s.b AS book_id, s.ts AS ts, s.a AS amount_paise, s.d AS direction, s.r AS reference, CASE id % 3 WHEN 0 THEN 'hdfc' WHEN 1 THEN 'idfc' ELSE 'bank:sbi' END AS source_raw FROM bank)"""
