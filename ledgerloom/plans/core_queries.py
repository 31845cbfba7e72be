"""Queries of the general loading operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.session import table
from ledgerloom.sources import drift, malformed


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return malformed.load(table(spark, d, "hdfc_rows")).rejects.select("row_id", "reason")


def p1_rows(spark: SparkSession, d: str) -> DataFrame:
    return malformed.load(table(spark, d, "hdfc_rows")).rows.drop("line_text")


def p1_summary(spark: SparkSession, d: str) -> DataFrame:
    return malformed.summary(malformed.load(table(spark, d, "hdfc_rows")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.drift_report(table(spark, d, "statement_files"))


def p2_ledger(spark: SparkSession, d: str) -> DataFrame:
    return drift.promote(drift.ingest(table(spark, d, "statement_files")))


QUERIES = {f.__name__: f for f in (p1_found, p1_rows, p1_summary, p2_found, p2_ledger)}

#: One field: free of quotes, or wholly enclosed with inner ones doubled.
_F = r'([^",]*|"([^"]|"")*")'
_AMOUNT = r"[+-]?[0-9]+(\.[0-9]{1,2})?"


def _p1(select: str, where: str) -> str:
    cut = "regexp_extract_all(',' || line_text, ',(\"(?:[^\"]|\"\")*\"|[^\",]*)', 1)"
    bare = "list_transform(" + cut + ", lambda x: CASE WHEN starts_with(x, '\"') THEN replace(x[2:-2], '\"\"', '\"') ELSE x END)"
    amount = lambda i: f"regexp_full_match(replace(trim(f[{i}]), ',', ''), '{_AMOUNT}')"
    return f"""
WITH q AS (SELECT *, regexp_full_match(line_text, '{_F}(,{_F})*', 's') AS ok FROM hdfc_rows),
     c AS (SELECT *, CASE WHEN ok THEN {bare} END AS f FROM q),
     r AS (SELECT *, CASE WHEN NOT ok THEN 'quoting' WHEN len(f) <> 6 THEN 'column_count'
       WHEN NOT regexp_full_match(f[1], '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{2}}') OR try_strptime(f[1], '%d/%m/%y') IS NULL THEN 'date_text'
       WHEN f[4] <> '' AND NOT {amount(4)} THEN 'withdrawal_text' WHEN f[5] <> '' AND NOT {amount(5)} THEN 'deposit_text'
       WHEN NOT {amount(6)} THEN 'balance_text' WHEN (f[4] = '') = (f[5] = '') THEN 'amount_sides' END AS reason FROM c)
SELECT {select} FROM r {where}"""


def oracle_sql() -> dict[str, str]:
    paise = lambda x: f"CAST(round(CAST(replace(trim({x}), ',', '') AS DECIMAL(18, 2)) * 100) AS BIGINT)"
    rows = f"""row_id, document_id, row_ix, CAST(strptime(f[1], '%d/%m/%y') AS DATE) AS txn_date, f[2] AS narration, nullif(ltrim(f[3], '0'), '') AS reference,
      CASE WHEN f[4] <> '' THEN 'debit' ELSE 'credit' END AS direction, {paise("CASE WHEN f[4] <> '' THEN f[4] ELSE f[5] END")} AS amount_paise, {paise('f[6]')} AS balance_paise"""
    return {
        "p1_found": _p1("row_id, reason", "WHERE reason IS NOT NULL"),
        "p1_rows": _p1(rows, "WHERE reason IS NULL"),
        "p1_summary": _p1("coalesce(reason, 'loaded') AS reason, count(*) AS n_lines", "GROUP BY 1"),
    }
