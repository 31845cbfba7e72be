"""Queries of the ledger operators over whole tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import cal, dates, ident, money, text
from ledgerloom.operators import alerts, analytics, insights, ledger, match, rules, suggest, verify
from ledgerloom.plans import derive
from ledgerloom.session import stored, table
from ledgerloom.streaming import capture

QUERIES: dict = {}
SQL: dict[str, str] = {}

L, R = derive.LEDGER_SQL, derive.RECON_SQL
NOW = f"TIMESTAMP '{derive.NOW}'"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def oracle_sql() -> dict[str, str]:
    return SQL


# scalars


@query("""SELECT uuid, strftime(txn_at + INTERVAL 330 MINUTE, '%Y-%m-%d') AS day, strftime(txn_at + INTERVAL 330 MINUTE, '%Y-%m') AS month, strftime(txn_at + INTERVAL 330 MINUTE, '%Y%m%d') AS compact,
  year(txn_at + INTERVAL 330 MINUTE) * 12 + month(txn_at + INTERVAL 330 MINUTE) - 1 AS month_index, date_trunc('month', txn_at + INTERVAL 330 MINUTE) - INTERVAL 330 MINUTE AS month_start,
  CAST(txn_at + INTERVAL 330 MINUTE AS TIME) <> TIME '00:00:00' AS has_clock FROM stored_transactions""")
def cal_day_month(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("txn_at")
    return table(spark, d, "stored_transactions").select("uuid", cal.day_key(ts).alias("day"), cal.month_key(ts).alias("month"), cal.compact_day(ts).alias("compact"), cal.month_index(ts).alias("month_index"), cal.month_start(cal.month_index(ts)).alias("month_start"), cal.has_clock(ts).alias("has_clock"))


@query("""WITH x AS (SELECT bank_id, amount_paise * CASE direction WHEN 'debit' THEN -1 ELSE 1 END AS x FROM recon_bank WHERE amount_paise IS NOT NULL),
  g AS (SELECT bank_id, x, CAST(abs(x) // 100 AS VARCHAR) AS r FROM x),
  p AS (SELECT *, CASE WHEN length(r) <= 3 THEN r WHEN length(r) <= 5 THEN r[:-4] || ',' || r[-3:] WHEN length(r) <= 7 THEN r[:-6] || ',' || r[-5:-4] || ',' || r[-3:] ELSE r[:-8] || ',' || r[-7:-6] || ',' || r[-5:-4] || ',' || r[-3:] END AS s FROM g)
SELECT bank_id, CASE WHEN x < 0 THEN '-' ELSE '' END || '₹' || s || '.' || lpad(CAST(abs(x) % 100 AS VARCHAR), 2, '0') AS shown FROM p""")
def money_format_inr(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "recon_bank").where("amount_paise is not null")
    return t.select("bank_id", money.inr(F.when(F.col("direction") == "debit", -F.col("amount_paise")).otherwise(F.col("amount_paise"))).alias("shown"))


_CELL = "replace(trim(c), ',', '')"


@query(f"""WITH c AS (SELECT file_id, unnest(body_rows) AS r FROM statement_files), e AS (SELECT file_id, unnest(r) AS c FROM c)
SELECT file_id, count(*) AS cells, count(*) FILTER (WHERE regexp_full_match({_CELL}, '[+-]?[0-9]+(\\.[0-9]{{1,2}})?')) AS amounts,
  CAST(sum(CASE WHEN regexp_full_match({_CELL}, '[+-]?[0-9]+(\\.[0-9]{{1,2}})?') THEN CAST(CAST({_CELL} AS DECIMAL(18, 2)) * 100 AS BIGINT) ELSE 0 END) AS BIGINT) AS total FROM e GROUP BY 1""")
def money_signed_paise(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "statement_files").select("file_id", F.explode("body_rows").alias("r")).select("file_id", F.explode("r").alias("c"))
    p = money.signed_paise(F.col("c"))
    return e.groupBy("file_id").agg(F.count("*").alias("cells"), F.count(p).alias("amounts"), F.sum(F.coalesce(p, F.lit(0))).alias("total"))


@query("""SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '\\p{L}+')[1:3], ' ') AS merchant_key, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))), ' ') AS tokens,
  regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS slug, regexp_replace(regexp_replace(text, '[a-zA-Z]', 'A', 'g'), '[0-9]', 'N', 'g') AS mask FROM documents""")
def text_keys(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.merchant_key(t).alias("merchant_key"), F.array_join(F.array_sort(text.match_tokens(t)), " ").alias("tokens"), text.slug(t).alias("slug"), text.shape_mask(t).alias("mask"))


@query("""SELECT uuid, trim(regexp_replace(lower(coalesce(narration, '')), '\\s+', ' ', 'g')) AS norm, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(coalesce(narration, '')), '[\\p{L}\\p{N}\\p{M}]+'))), ' ') AS tokens, left(narration, 60) AS head FROM stored_transactions""")
def text_narration(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("narration")
    return table(spark, d, "stored_transactions").select("uuid", text.narration_norm(n).alias("norm"), F.array_join(F.array_sort(text.merge_tokens(n)), " ").alias("tokens"), text.head(n).alias("head"))


@query("""SELECT alert_id, array_to_string(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(text, '[0-9]+', '0', 'g'), '\\b[A-Z][A-Za-z]+\\b', 'W', 'g'), '\\s+'), lambda x: x <> '')[1:8], ' ') AS skeleton,
  translate(text, '₹•', '$*') AS plain, CASE WHEN regexp_matches(lower(text), 'state bank|sbi') THEN 'SBI' WHEN regexp_matches(lower(text), 'icici') THEN 'ICICI' WHEN regexp_matches(lower(text), 'axis') THEN 'Axis' WHEN regexp_matches(lower(text), 'kotak') THEN 'Kotak' WHEN regexp_matches(lower(text), 'hdfc') THEN 'HDFC' WHEN regexp_matches(lower(text), 'idfc') THEN 'IDFC First' WHEN regexp_matches(lower(text), 'punjab national|pnb') THEN 'PNB' WHEN regexp_matches(lower(text), 'bank of baroda') THEN 'Bank of Baroda' WHEN regexp_matches(lower(text), 'canara') THEN 'Canara' WHEN regexp_matches(lower(text), 'yes bank') THEN 'Yes Bank' WHEN regexp_matches(lower(text), 'federal') THEN 'Federal' WHEN regexp_matches(lower(text), 'indusind') THEN 'IndusInd' WHEN regexp_matches(lower(text), 'union bank') THEN 'Union Bank' WHEN regexp_matches(lower(text), 'idbi') THEN 'IDBI' END AS bank FROM alerts""")
def text_alert_shape(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "alerts").select("alert_id", text.skeleton(t).alias("skeleton"), text.plain_symbols(t).alias("plain"), text.bank_name(t).alias("bank"))


@query("""SELECT uuid, sha256(CASE WHEN coalesce(reference, '') <> '' THEN source_raw || '|ref|' || reference || '|' || direction ELSE source_raw || '|' || strftime(txn_at + INTERVAL 330 MINUTE, '%Y-%m-%d') || '|' || amount_paise || '|' || direction || '|' || trim(regexp_replace(lower(coalesce(narration, '')), '\\s+', ' ', 'g')) END) AS hash FROM stored_transactions""")
def ident_content_hash(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "stored_transactions")
    return t.select("uuid", ident.content_hash(F.col("source_raw"), F.col("txn_at"), F.col("amount_paise"), F.col("direction"), F.col("reference"), F.col("narration")).alias("hash"))


@query("""SELECT record_id, effective_category, spent_at, merchant, amount_paise, sha256(concat_ws('|', amount_paise, direction, array_to_string(regexp_extract_all(lower(coalesce(merchant, '')), '\\p{L}+')[1:3], ' '), '', strftime(spent_at + INTERVAL 330 MINUTE, '%Y-%m-%d'))) AS capture,
  sha256(coalesce(merchant, ''))[1:16] AS card FROM spend_records""")
def ident_capture_hash(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "spend_records")
    return t.select("record_id", "effective_category", "spent_at", "merchant", "amount_paise", ident.capture_hash(F.col("amount_paise"), F.col("direction"), F.col("merchant"), F.lit(None).cast("string"), F.col("spent_at")).alias("capture"), ident.insight_id(F.coalesce("merchant", F.lit(""))).alias("card"))


@query("SELECT row_id, ltrim(split_part(line_text, ',', 3), '0') AS x, nullif(ltrim(split_part(line_text, ',', 3), '0'), '') AS bare, CAST(('0x' || sha1(document_id)[-2:]) AS INTEGER) % 4 AS part FROM hdfc_rows")
def ident_hash_split(spark: SparkSession, d: str) -> DataFrame:
    ref = F.split_part("line_text", F.lit(","), F.lit(3))
    return table(spark, d, "hdfc_rows").select("row_id", F.ltrim(ref, F.lit("0")).alias("x"), ident.bare_reference(ref).alias("bare"), ident.hash_split(F.col("document_id"), 4).alias("part"))


@query("""SELECT source_raw, kind, shown, row_number() OVER (ORDER BY CASE kind WHEN 'paymentApp' THEN 0 ELSE 1 END, shown) AS place, n FROM (SELECT source_raw, CASE WHEN source_raw IN ('gpay', 'paytm', 'bhim', 'alert') OR starts_with(source_raw, 'upi:') THEN 'paymentApp' ELSE 'bank' END AS kind,
  CASE source_raw WHEN 'gpay' THEN 'Google Pay' WHEN 'paytm' THEN 'Paytm' WHEN 'bhim' THEN 'BHIM' WHEN 'hdfc' THEN 'HDFC Bank' WHEN 'idfc' THEN 'IDFC First Bank' WHEN 'alert' THEN 'Alerts' ELSE CASE WHEN length(split_part(source_raw, ':', 2)) <= 4 THEN upper(split_part(source_raw, ':', 2)) ELSE upper(split_part(source_raw, ':', 2)[1]) || split_part(source_raw, ':', 2)[2:] END END AS shown, count(*) AS n FROM stored_transactions GROUP BY 1)""")
def source_kind_order(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    s = table(spark, d, "stored_transactions").groupBy("source_raw").agg(F.count("*").alias("n"))
    s = s.select("source_raw", rules.source_kind(F.col("source_raw")).alias("kind"), rules.source_name(F.col("source_raw")).alias("shown"), "n")
    # one row for each source, a handful
    return s.withColumn("place", F.row_number().over(Window.orderBy(F.when(F.col("kind") == "paymentApp", 0).otherwise(1), "shown")))


# ledger


@query("SELECT uuid, content_hash FROM (SELECT uuid, content_hash, row_number() OVER (PARTITION BY content_hash ORDER BY txn_at, uuid) AS n FROM stored_transactions WHERE txn_at >= TIMESTAMP '2025-07-01') t WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM stored_transactions s WHERE s.content_hash = t.content_hash AND s.txn_at < TIMESTAMP '2025-07-01')")
def ledger_dedup(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "stored_transactions")
    split = F.lit("2025-07-01").cast("timestamp_ntz")
    new = ledger.dedup_batch(t.where(F.col("txn_at") >= split).select("uuid", "content_hash", "txn_at"), t.where(F.col("txn_at") < split))
    return new.select("uuid", "content_hash")


@query("""WITH e AS (SELECT DISTINCT book_id, reference, direction FROM stored_transactions WHERE source_raw IN ('gpay', 'paytm', 'bhim') OR starts_with(source_raw, 'upi:'))
SELECT uuid FROM stored_transactions a WHERE source_raw = 'alert' AND coalesce(reference, '') <> '' AND EXISTS (SELECT 1 FROM e WHERE e.book_id = a.book_id AND e.reference = a.reference AND e.direction = a.direction)""")
def ledger_superseded_alerts(spark: SparkSession, d: str) -> DataFrame:
    return ledger.supersede_alerts(table(spark, d, "stored_transactions"))[1].select("uuid")


@query(f"WITH RECURSIVE {L} SELECT uuid, category, amount_paise FROM ledger WHERE strftime(ist, '%Y-%m') IN ('2025-01', '2025-02', '2025-03') AND source_raw IN ('hdfc', 'idfc', 'gpay') AND direction = 'debit' AND amount_paise >= 10000 AND (contains(lower(coalesce(counterparty, '')), 'stores') OR contains(lower(coalesce(narration, '')), 'stores') OR contains(lower(coalesce(reference, '')), 'stores') OR contains(lower(category), 'stores'))")
def ledger_filter_search(spark: SparkSession, d: str) -> DataFrame:
    rows = derive.ledger(spark, d)
    return ledger.ledger_filter(rows, months=["2025-01", "2025-02", "2025-03"], sources=["hdfc", "idfc", "gpay"], direction="debit", least=10000, text="Stores").select("uuid", "category", "amount_paise")


@query(f"WITH RECURSIVE {L} SELECT book_id, rank, id FROM (SELECT book_id, id, row_number() OVER (PARTITION BY book_id ORDER BY ts DESC, id) AS rank FROM insight_rows WHERE contains(lower(coalesce(merchant, '')), 'book') OR contains(lower(category), 'book')) WHERE rank <= 8")
def tools_search(spark: SparkSession, d: str) -> DataFrame:
    return ledger.search(derive.insight_rows(spark, d), "book").select("book_id", "rank", "id")


@query("""SELECT book_id, count(*) AS parsed, count(DISTINCT CASE WHEN n = 1 THEN uuid END) AS added, count(DISTINCT CASE WHEN n = 1 THEN strftime(txn_at + INTERVAL 330 MINUTE, '%Y-%m') END) AS months FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY txn_at, uuid) AS n FROM stored_transactions) GROUP BY 1""")
def ledger_import_report(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "stored_transactions").select("uuid", "book_id", "content_hash", "txn_at")
    return ledger.import_report(t, ledger.dedup_batch(t, None))


@query("""WITH r AS (SELECT document_id AS id, min(txn_at) AS lo, max(txn_at) AS hi FROM stored_transactions GROUP BY 1) SELECT d.id, least(period_start, coalesce(lo, period_start)) AS period_start, greatest(period_end, coalesce(hi, period_end)) AS period_end FROM stored_documents d LEFT JOIN r USING (id)""")
def ledger_widen_periods(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "stored_documents").select("id", "period_start", "period_end")
    return ledger.widen_periods(docs, table(spark, d, "stored_transactions").select("document_id", "txn_at"))


@query("""WITH m AS (SELECT max(year(txn_at + INTERVAL 330 MINUTE) * 12 + month(txn_at + INTERVAL 330 MINUTE) - 1) AS top FROM recon_bank), l AS (SELECT DISTINCT bank_id, txn_at + INTERVAL 330 MINUTE AS ist FROM recon_bank)
SELECT bank_id, CAST(CAST(ist AS DATE) + to_months(CAST(24324 - top AS INTEGER)) AS TIMESTAMP) + (ist - date_trunc('day', ist)) - INTERVAL 330 MINUTE AS txn_at FROM l, m""")
def ledger_shift_months(spark: SparkSession, d: str) -> DataFrame:
    return ledger.shift_months(table(spark, d, "recon_bank").select("bank_id", "txn_at").distinct(), 24324)


# rules


@query(f"WITH RECURSIVE {L} SELECT uuid, category FROM ledger WHERE coalesce(category_override, '') = ''")
def rules_longest_match(spark: SparkSession, d: str) -> DataFrame:
    return derive.ledger(spark, d).where(F.coalesce("category_override", F.lit("")) == "").select("uuid", "category")


@query(f"""WITH RECURSIVE {L} SELECT f.uuid, CASE WHEN lower(coalesce(f.narration, '')) LIKE '%transfer%' THEN 'Self Transfer' ELSE coalesce(nullif(f.category_override, ''), h.c, CASE WHEN f.source_raw IN ('gpay', 'paytm', 'bhim', 'alert') OR starts_with(f.source_raw, 'upi:') THEN 'Uncategorized' ELSE 'Miscellaneous' END) END AS category
FROM first_rows f LEFT JOIN hits h ON h.uuid = f.uuid AND h.n = 1""")
def rules_effective_category(spark: SparkSession, d: str) -> DataFrame:
    t = derive.ledger(spark, d)
    own = F.lower(F.coalesce("narration", F.lit(""))).contains("transfer")
    return t.select("uuid", rules.effective_category(derive.payee_text(), F.col("category_override"), F.col("source_raw"), own, derive.RULES).alias("category"))


@query(f"""WITH RECURSIVE {L}, n AS (SELECT f.book_id, f.category_override, coalesce(h.c, 'Uncategorized') AS before, length(r.p) AS len, contains(lower(concat_ws(' ', coalesce(f.counterparty, ''), coalesce(f.narration, ''))), 'provision stores limited') AS hit
  FROM first_rows f LEFT JOIN hits h ON h.uuid = f.uuid AND h.n = 1 LEFT JOIN rules r ON r.c = h.c AND contains(lower(concat_ws(' ', coalesce(f.counterparty, ''), coalesce(f.narration, ''))), r.p) AND length(r.p) >= 24)
SELECT book_id, count(*) FILTER (WHERE hit AND category_override IS NULL AND before <> 'Wholesale') AS changed, count(*) AS rows FROM n GROUP BY 1""")
def rules_impact(spark: SparkSession, d: str) -> DataFrame:
    t = derive.ledger(spark, d).withColumn("text", derive.payee_text())
    return rules.rule_impact(t, "text", derive.RULES, ("provision stores limited", "Wholesale"), F.col("category_override").isNotNull())


@query("SELECT * FROM (SELECT DISTINCT lower(p_brand) AS pattern, 'Brand' AS category, CAST(row_number() OVER (ORDER BY lower(p_brand)) - 1 AS INTEGER) AS sort_order FROM (SELECT DISTINCT p_brand FROM part)) UNION ALL SELECT 'Fresh Mart', 'Groceries', CAST((SELECT count(DISTINCT p_brand) FROM part) AS INTEGER)")
def rules_seed_additive(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    brands = table(spark, d, "part").select(F.lower("p_brand").alias("pattern")).distinct()
    have = brands.select("pattern", F.lit("Brand").alias("category"), (F.row_number().over(Window.orderBy("pattern")) - 1).alias("sort_order"))
    return rules.seed_rules(have, [("BRAND#11", "Known"), ("Fresh Mart", "Groceries")]).withColumn("sort_order", F.col("sort_order").cast("int"))


# analytics


_STATS = "CAST(coalesce(sum(amount_paise) FILTER (WHERE direction = 'credit'), 0) AS BIGINT) AS income, CAST(coalesce(sum(amount_paise) FILTER (WHERE direction = 'debit' AND category NOT IN ('Investments', 'Insurance')), 0) AS BIGINT) AS spend, CAST(coalesce(sum(amount_paise) FILTER (WHERE direction = 'debit' AND category = 'Investments'), 0) AS BIGINT) AS invested, CAST(coalesce(sum(amount_paise) FILTER (WHERE direction = 'debit' AND category = 'Insurance'), 0) AS BIGINT) AS insured"


@query(f"WITH RECURSIVE {L}, s AS (SELECT book_id, month, {_STATS} FROM insight_rows GROUP BY 1, 2) SELECT *, spend + invested + insured AS paid, income - spend - invested - insured AS net FROM s")
def analytics_month_stats(spark: SparkSession, d: str) -> DataFrame:
    return analytics.month_stats(derive.insight_rows(spark, d))


@query(f"""WITH RECURSIVE {L}, s AS (SELECT book_id, m, {_STATS} FROM insight_rows GROUP BY 1, 2), g AS (SELECT book_id, unnest(range(24306, 24318)) AS m FROM (SELECT DISTINCT book_id FROM insight_rows)), j AS (SELECT g.book_id, g.m, coalesce(income, 0) AS income, coalesce(spend, 0) AS spend, coalesce(invested, 0) AS invested, coalesce(insured, 0) AS insured FROM g LEFT JOIN s ON s.book_id = g.book_id AND s.m = g.m)
SELECT book_id, printf('%04d-%02d', m // 12, m % 12 + 1) AS month, income, spend, invested, insured, spend + invested + insured AS paid, income - spend - invested - insured AS net FROM j""")
def analytics_trend_dense(spark: SparkSession, d: str) -> DataFrame:
    return analytics.trend_dense(derive.insight_rows(spark, d), 24317)


@query(f"""WITH RECURSIVE {L}, t AS (SELECT book_id, month, category, sum(amount_paise) AS total FROM insight_rows WHERE direction = 'debit' GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY book_id, month ORDER BY total DESC, category) AS n FROM t)
SELECT book_id, month, CAST(least(n, 7) AS INTEGER) AS place, CASE WHEN least(n, 7) = 7 THEN 'Other' ELSE max(category) END AS category, CAST(sum(total) AS BIGINT) AS total FROM r GROUP BY book_id, month, least(n, 7)""")
def analytics_category_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return analytics.category_breakdown(derive.insight_rows(spark, d))


@query(f"""WITH RECURSIVE {L}, t AS (SELECT book_id, month, category, sum(amount_paise) AS total FROM insight_rows WHERE direction = 'debit' GROUP BY 1, 2, 3), w AS (SELECT *, sum(total) OVER (PARTITION BY book_id, month) AS whole FROM t)
SELECT book_id, month, category, CAST(total AS BIGINT) AS total, CAST((total * 200 + whole) // (whole * 2) AS BIGINT) AS percent FROM w""")
def analytics_category_share(spark: SparkSession, d: str) -> DataFrame:
    return analytics.category_share(derive.insight_rows(spark, d))


@query(f"""WITH RECURSIVE {L}, t AS (SELECT book_id, m, category, sum(amount_paise) AS now FROM insight_rows WHERE direction = 'debit' GROUP BY 1, 2, 3), p AS (SELECT book_id, m + 1 AS m, category, now AS before FROM t),
  j AS (SELECT coalesce(t.book_id, p.book_id) AS book_id, coalesce(t.m, p.m) AS m, coalesce(t.category, p.category) AS category, coalesce(now, 0) AS now, coalesce(before, 0) AS before FROM t FULL JOIN p ON t.book_id = p.book_id AND t.m = p.m AND t.category = p.category),
  k AS (SELECT DISTINCT a.book_id, a.m FROM t a JOIN t b ON a.book_id = b.book_id AND a.m = b.m + 1), c AS (SELECT j.*, now - before AS change FROM j JOIN k USING (book_id, m))
SELECT book_id, printf('%04d-%02d', m // 12, m % 12 + 1) AS month, category, CAST(now AS BIGINT) AS now, CAST(before AS BIGINT) AS before, CAST(change AS BIGINT) AS change, CASE WHEN before <> 0 THEN CAST(change * 100 // before AS BIGINT) END AS change_pct, CAST(row_number() OVER (PARTITION BY book_id, m ORDER BY abs(change) DESC, category) AS INTEGER) AS rank FROM c""")
def analytics_month_compare(spark: SparkSession, d: str) -> DataFrame:
    return analytics.month_compare(derive.insight_rows(spark, d))


@query(f"WITH RECURSIVE {L} SELECT book_id, month, CAST(coalesce(sum(amount_paise) FILTER (WHERE direction = 'debit'), 0) AS BIGINT) AS spent, count(*) FILTER (WHERE direction = 'debit') AS payments, CAST(coalesce(sum(amount_paise) FILTER (WHERE direction = 'credit'), 0) AS BIGINT) AS received FROM insight_rows GROUP BY 1, 2")
def analytics_month_totals(spark: SparkSession, d: str) -> DataFrame:
    return analytics.month_totals(derive.insight_rows(spark, d))


@query(f"WITH RECURSIVE {L}, t AS (SELECT book_id, month, merchant, sum(amount_paise) AS total, count(*) AS n FROM insight_rows WHERE direction = 'debit' AND merchant <> '' GROUP BY 1, 2, 3) SELECT * FROM (SELECT book_id, month, merchant, CAST(total AS BIGINT) AS total, n, CAST(row_number() OVER (PARTITION BY book_id, month ORDER BY total DESC, merchant) AS INTEGER) AS rank FROM t) WHERE rank <= 6")
def analytics_top_merchants(spark: SparkSession, d: str) -> DataFrame:
    return analytics.top_merchants(derive.insight_rows(spark, d))


_CELLS = "c AS (SELECT id, book_id, source_raw, period_start, period_end, unnest(range(year(period_start + INTERVAL 330 MINUTE) * 12 + month(period_start + INTERVAL 330 MINUTE) - 1, year(period_end + INTERVAL 330 MINUTE) * 12 + month(period_end + INTERVAL 330 MINUTE))) AS m FROM stored_documents WHERE period_start <= period_end)"


@query(f"""WITH {_CELLS}, g AS (SELECT book_id, unnest(range(min(m), max(m) + 1)) AS m FROM c GROUP BY 1), s AS (SELECT DISTINCT book_id, source_raw FROM stored_documents), h AS (SELECT book_id, m, source_raw, list_sort(list_distinct(list(id))) AS ids FROM c GROUP BY 1, 2, 3)
SELECT g.book_id, printf('%04d-%02d', g.m // 12, g.m % 12 + 1) AS month, s.source_raw, coalesce(len(ids), 0) AS n_documents, coalesce(array_to_string(ids, ','), '') AS document_ids FROM g JOIN s ON s.book_id = g.book_id LEFT JOIN h ON h.book_id = g.book_id AND h.m = g.m AND h.source_raw = s.source_raw""")
def coverage_grid(spark: SparkSession, d: str) -> DataFrame:
    return analytics.coverage_grid(table(spark, d, "stored_documents"))


_COMPLETE = f"{_CELLS}, complete AS (SELECT DISTINCT book_id, CAST(m AS INTEGER) AS m FROM c WHERE period_start <= make_timestamp(m // 12, m % 12 + 1, 1, 0, 0, 0) - INTERVAL 330 MINUTE AND period_end >= make_timestamp((m + 1) // 12, (m + 1) % 12 + 1, 1, 0, 0, 0) - INTERVAL 330 MINUTE - INTERVAL 1 SECOND)"


@query(f"WITH {_COMPLETE} SELECT book_id, m FROM complete")
def coverage_complete_months(spark: SparkSession, d: str) -> DataFrame:
    return analytics.complete_months(table(spark, d, "stored_documents"))


# suggestions

_SPEND = "sp AS (SELECT DISTINCT record_id, book_id, merchant, amount_paise, spent_at, direction, effective_category FROM spend_records WHERE amount_paise IS NOT NULL)"


def _spend(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "spend_records").where("amount_paise is not null").distinct()
    return t.select("book_id", F.col("record_id").alias("id"), F.col("spent_at").alias("ts"), "amount_paise", "direction", F.col("effective_category").alias("category"), F.coalesce("merchant", F.lit("")).alias("merchant"))


@query(f"""WITH {_SPEND}, w AS (SELECT *, array_to_string(regexp_extract_all(lower(coalesce(merchant, '')), '\\p{{L}}+')[1:3], ' ') AS key FROM sp WHERE direction = 'debit' AND spent_at >= {NOW} - INTERVAL 90 DAY AND spent_at <= {NOW}), g AS (SELECT book_id, greatest(50000, sum(amount_paise) * 2 // 100) AS gate FROM w GROUP BY 1),
  o AS (SELECT * FROM w WHERE coalesce(effective_category, 'Uncategorized') IN ('Uncategorized', 'Miscellaneous') AND key <> ''), k AS (SELECT book_id, key, count(*) AS n, sum(amount_paise) AS total, count(DISTINCT strftime(spent_at + INTERVAL 330 MINUTE, '%Y-%m')) AS months FROM o GROUP BY 1, 2),
  s AS (SELECT book_id, key, merchant, row_number() OVER (PARTITION BY book_id, key ORDER BY count(*) DESC, merchant) AS r FROM o GROUP BY 1, 2, 3)
SELECT k.book_id, k.key AS merchant_pattern, s.merchant AS display, CAST(total AS BIGINT) AS total, n, CAST(row_number() OVER (PARTITION BY k.book_id ORDER BY total DESC, k.key) AS INTEGER) AS rank FROM k JOIN g USING (book_id) JOIN s ON s.book_id = k.book_id AND s.key = k.key AND s.r = 1 WHERE n >= 3 AND months >= 2 AND total >= gate""")
def suggest_rules(spark: SparkSession, d: str) -> DataFrame:
    return suggest.suggestions(_spend(spark, d), derive.now())


_SEEDS = ("Groceries", "Food", "Transport", "Shopping", "Bills")


@query(f"""WITH {_SPEND}, c AS (SELECT book_id, effective_category AS category, count(*) AS n FROM sp WHERE direction = 'debit' AND spent_at >= {NOW} - INTERVAL 90 DAY AND spent_at <= {NOW} AND effective_category NOT IN ('Uncategorized', 'Miscellaneous') GROUP BY 1, 2),
  s AS (SELECT book_id, x.c AS category, x.i AS i FROM (SELECT DISTINCT book_id FROM sp), (VALUES {', '.join(f"({i}, '{c}')" for i, c in enumerate(_SEEDS))}) x(i, c)), j AS (SELECT coalesce(c.book_id, s.book_id) AS book_id, coalesce(c.category, s.category) AS category, coalesce(n, 0) AS n, i FROM c FULL JOIN s ON c.book_id = s.book_id AND c.category = s.category)
SELECT * FROM (SELECT book_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY CASE WHEN n > 0 THEN 0 ELSE 1 END, n DESC, CASE WHEN n > 0 THEN category END NULLS FIRST, i) AS INTEGER) AS rank, category, n FROM j) WHERE rank <= 3""")
def suggest_top_categories(spark: SparkSession, d: str) -> DataFrame:
    return suggest.top_categories(_spend(spark, d), derive.now(), _SEEDS)


# reconciliation

_T1 = """fa AS (SELECT *, row_number() OVER (PARTITION BY book_id, reference, direction ORDER BY ts, id) AS n FROM a WHERE reference <> ''), fb AS (SELECT *, row_number() OVER (PARTITION BY book_id, reference, direction ORDER BY ts, id) AS n FROM b WHERE reference <> ''),
t1 AS (SELECT fa.book_id, fa.id AS app_id, fb.id AS bank_id FROM fa JOIN fb ON fa.book_id = fb.book_id AND fa.reference = fb.reference AND fa.direction = fb.direction AND fa.n = 1 AND fb.n = 1)"""


@query(f"WITH RECURSIVE {R}, {_T1} SELECT book_id, app_id, bank_id, 'reference' AS tier FROM t1")
def match_tier1_reference(spark: SparkSession, d: str) -> DataFrame:
    return match.tier1(*derive.recon(spark, d))


_MATCHED = derive.reconcile_sql("matched", "a", "b")


@query(f"WITH RECURSIVE {R}, {_MATCHED} SELECT app_id, bank_id, tier FROM matched")
def match_reconcile(spark: SparkSession, d: str) -> DataFrame:
    return match.reconcile(*derive.recon(spark, d))


@query(f"WITH RECURSIVE {R}, {_MATCHED} SELECT 'app' AS side, id FROM a WHERE id NOT IN (SELECT app_id FROM matched) UNION ALL SELECT 'bank', id FROM b WHERE id NOT IN (SELECT bank_id FROM matched)")
def match_unmatched(spark: SparkSession, d: str) -> DataFrame:
    app, bank = derive.recon(spark, d)
    return match.unmatched(app, bank, stored(match.reconcile(app, bank), "matches"))  # both sides read them


@query(f"WITH RECURSIVE {L} SELECT lid AS debit_id, rid AS credit_id FROM moved")
def match_self_transfers(spark: SparkSession, d: str) -> DataFrame:
    return match.self_transfers(derive.ledger_sides(spark, d)[2])


@query("""WITH x AS (SELECT DISTINCT app_id AS id, book_id, amount_paise, direction, coalesce(reference, '') AS reference FROM recon_app WHERE amount_paise IS NOT NULL), k AS (SELECT book_id, reference, amount_paise FROM x GROUP BY 1, 2, 3 HAVING count(DISTINCT direction) = 2)
SELECT DISTINCT id FROM x JOIN k USING (book_id, reference, amount_paise) WHERE reference <> '' UNION SELECT id FROM x JOIN (SELECT DISTINCT book_id, reference FROM recon_bank WHERE amount_paise = 50000 AND coalesce(reference, '') <> '') f USING (book_id, reference)""")
def match_alert_self_transfers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "recon_app").where("amount_paise is not null").select(F.col("app_id").alias("id"), "book_id", "amount_paise", "direction", F.coalesce("reference", F.lit("")).alias("reference")).distinct()
    flagged = table(spark, d, "recon_bank").where("amount_paise = 50000 and coalesce(reference, '') <> ''")
    return match.alert_self_transfers(rows, flagged)


@query(f"WITH RECURSIVE {R}, {_MATCHED} SELECT id FROM b WHERE id NOT IN (SELECT bank_id FROM matched)")
def ledger_visible(spark: SparkSession, d: str) -> DataFrame:
    app, bank = derive.recon(spark, d)
    return ledger.visible(bank, match.reconcile(app, bank)).select("id")


# captured alerts against the ledger


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Captured alerts, and all rows of the ledger: an alert has handle, payee and tail, a row has payee, narration and reference."""
    blank = F.lit(None).cast("string")
    cols = ("book_id", "id", "amount_paise", "direction", "ts", "account_tail", "vpa", "payee", "narration", "reference")
    a = _captured(spark, d).withColumns({"narration": F.lit(""), "reference": blank})
    b = derive.ledger(spark, d).withColumns({"id": F.col("uuid"), "ts": F.col("txn_at"), "account_tail": blank, "vpa": blank, "payee": F.coalesce("counterparty", F.lit("")), "narration": F.coalesce("narration", F.lit("")), "reference": F.nullif("reference", F.lit(""))})
    return a.select(*cols), b.select(*cols)


@query()
def capture_judge(spark: SparkSession, d: str) -> DataFrame:
    return match.judged_candidates(*_sides(spark, d)).select("a_id", "b_id", "verdict")


@query(f"""WITH RECURSIVE {R}, g AS (SELECT a.book_id, a.id AS a_id, b.id AS b_id, row_number() OVER (PARTITION BY a.id ORDER BY abs(epoch(a.ts) - epoch(b.ts)), CASE WHEN a.amount_paise = b.amount_paise THEN 0 ELSE 1 END, b.id) AS rank FROM a JOIN b ON a.book_id = b.book_id AND a.direction = b.direction)
SELECT book_id, a_id, b_id, CAST(rank AS INTEGER) AS rank FROM g WHERE rank <= 30""")
def capture_link_candidates(spark: SparkSession, d: str) -> DataFrame:
    return match.link_candidates(*derive.recon(spark, d))


@query()
def capture_pairs(spark: SparkSession, d: str) -> DataFrame:
    return match.pair_detections(match.judged_candidates(*_sides(spark, d)))


def _captured(spark: SparkSession, d: str) -> DataFrame:
    """Captured alerts, the first of each capture hash: the same alert posted again is no second memo."""
    a = alerts.parse_alerts(table(spark, d, "alerts"))
    cols = ["book_id", "amount_paise", "direction", "ts", "account_tail", "vpa", "payee"]
    return a.groupBy(F.col("capture_hash").alias("id")).agg(F.min_by(F.struct(*cols), F.struct("received_at", "alert_id")).alias("r")).select("id", "r.*")


def _memo_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Memos and bank rows. Memos are the captured alerts, and each bank row with a counterparty as one that came up to four days before."""
    t = derive.ledger(spark, d).where(rules.source_kind(F.col("source_raw")) == "bank")
    early = F.col("txn_at") - F.make_dt_interval(F.pmod(F.col("amount_paise"), F.lit(5)).cast("int"))
    memos = t.where(F.coalesce("counterparty", F.lit("")) != "").select("book_id", F.col("uuid").alias("id"), "amount_paise", "direction", early.alias("ts"), ident.vpa(F.coalesce("narration", F.lit(""))).alias("vpa"), F.col("counterparty").alias("payee"))
    rows = t.select("book_id", F.col("uuid").alias("id"), "amount_paise", "direction", F.col("txn_at").alias("ts"), "narration")
    return memos.unionByName(_captured(spark, d).select(*memos.columns)), rows


@query()
def capture_memo_candidates(spark: SparkSession, d: str) -> DataFrame:
    return match.memo_candidates(*_memo_rows(spark, d)).select("memo_id", "row_id", "gap")


@query()
def capture_merge(spark: SparkSession, d: str) -> DataFrame:
    return match.merge_memos(match.memo_candidates(*_memo_rows(spark, d)))


@query()
def alert_parse(spark: SparkSession, d: str) -> DataFrame:
    return alerts.parse_alerts(table(spark, d, "alerts")).drop("text")


@query("""SELECT alert_id, CASE WHEN dw AND NOT cw THEN 'debit' WHEN cw AND NOT dw THEN 'credit' END AS direction, CASE WHEN s <> '' THEN CAST(round(CAST(replace(s, ',', '') AS DECIMAL(18, 2)) * 100) AS BIGINT) END AS amount_paise FROM (SELECT alert_id, regexp_matches(lower(text), 'debited|spent|withdrawn|paid|sent|purchase') AS dw, regexp_matches(lower(text), 'credited|received|refund|deposited') AS cw,
  regexp_extract(text, '(?i)(?:rs\\.?|inr|₹)\\s*([0-9][0-9,]*(?:\\.[0-9]{1,2})?)', 1) AS s FROM alerts)""")
def alert_direction_amount(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "alerts").select("alert_id", alerts.direction(t).alias("direction"), money.signed_paise(F.nullif(F.regexp_extract(t, alerts.SIGNED_AMOUNT, 1), F.lit(""))).alias("amount_paise"))


# insights

_INSIGHT = f"""{L}, {_COMPLETE}, latest AS (SELECT book_id, max(m) AS latest FROM complete WHERE m <= 24317 GROUP BY 1),
den AS (SELECT b.book_id, greatest(coalesce(sum(i.amount_paise), 0), 1) AS d FROM (SELECT DISTINCT book_id FROM insight_rows) b LEFT JOIN latest l ON l.book_id = b.book_id LEFT JOIN insight_rows i ON i.book_id = b.book_id AND i.m = l.latest AND i.direction = 'debit' GROUP BY 1)"""


def _card_id(canonical: str) -> str:
    return f"sha256({canonical})[1:16] AS id"


def _cards(df: DataFrame) -> DataFrame:
    return df.select("book_id", "id", "kind", "score", F.array_join("evidence", ",").alias("evidence"), "mute_key")


@query(f"""WITH RECURSIVE {_INSIGHT}, w AS (SELECT book_id, m, latest FROM (SELECT c.book_id, c.m, l.latest, row_number() OVER (PARTITION BY c.book_id ORDER BY c.m DESC) AS n FROM complete c JOIN latest l USING (book_id) WHERE c.m < l.latest AND c.m >= l.latest - 24) WHERE n <= 3), ws AS (SELECT book_id, latest, count(*) AS w FROM w GROUP BY 1, 2),
  base AS (SELECT i.book_id, category, sum(amount_paise) AS base FROM insight_rows i JOIN w ON w.book_id = i.book_id AND w.m = i.m WHERE direction = 'debit' GROUP BY 1, 2), cur AS (SELECT i.book_id, ws.latest, ws.w, category, sum(amount_paise) AS cur, array_to_string(list_sort(list(id)), ',') AS evidence FROM insight_rows i JOIN ws ON ws.book_id = i.book_id AND ws.latest = i.m WHERE direction = 'debit' GROUP BY 1, 2, 3, 4),
  x AS (SELECT cur.*, base // w AS avg FROM cur JOIN base USING (book_id, category) WHERE base > 0), y AS (SELECT *, cur - avg AS delta, (cur - avg) * 100 // avg AS pct FROM x WHERE avg > 0)
SELECT y.book_id, {_card_id("concat_ws('|', 'trend', category, printf('%04d-%02d', latest // 12, latest % 12 + 1), CAST(pct AS VARCHAR))")}, 'trend' AS kind, CAST(abs(delta) * 1000 // d AS BIGINT) AS score, evidence, category AS mute_key FROM y JOIN den USING (book_id) WHERE abs(pct) >= 25 AND abs(delta) >= 50000""")
def insight_trend(spark: SparkSession, d: str) -> DataFrame:
    return _cards(insights.trends(derive.insight_rows(spark, d), table(spark, d, "stored_documents"), derive.now())[0])


_SERIES = """g AS (SELECT *, datediff('day', lag(day) OVER (PARTITION BY book_id, key ORDER BY ts, id), day) AS gap FROM keyed WHERE direction = 'debit' AND key <> ''),
s AS (SELECT book_id, key, count(*) AS n, quantile_disc(gap, 0.5) AS gap, quantile_disc(amount_paise, 0.5) AS median, min(ts) AS first_seen, max(ts) AS last_seen, arg_max(amount_paise, (ts, id)) AS latest_amount, array_to_string(list(id ORDER BY ts, id), ',') AS ids FROM g GROUP BY 1, 2),
c AS (SELECT *, CASE WHEN gap BETWEEN 28 AND 33 THEN 'monthly' WHEN gap BETWEEN 6 AND 8 THEN 'weekly' END AS cadence FROM s WHERE n >= 3),
st AS (SELECT g.book_id, g.key FROM g JOIN c ON c.book_id = g.book_id AND c.key = g.key WHERE c.median > 0 AND abs(g.amount_paise - c.median) * 100 <= c.median * 15 GROUP BY 1, 2 HAVING count(*) >= 3),
sp AS (SELECT book_id, key, merchant, row_number() OVER (PARTITION BY book_id, key ORDER BY count(*) DESC, merchant) AS r FROM g GROUP BY 1, 2, 3)"""


@query(f"""WITH RECURSIVE {L}, {_SERIES} SELECT c.book_id, c.key, sp.merchant AS display, cadence, CAST(median AS BIGINT) AS median, CAST(CASE cadence WHEN 'monthly' THEN median ELSE median * 52 // 12 END AS BIGINT) AS monthly, first_seen, last_seen, n, CAST(latest_amount AS BIGINT) AS latest_amount, ids
FROM c JOIN st ON st.book_id = c.book_id AND st.key = c.key JOIN sp ON sp.book_id = c.book_id AND sp.key = c.key AND sp.r = 1 WHERE cadence IS NOT NULL AND median > 0 AND datediff('day', CAST(last_seen + INTERVAL 330 MINUTE AS DATE), DATE '2026-06-30') <= CASE cadence WHEN 'monthly' THEN 66 ELSE 16 END""")
def insight_recurring_series(spark: SparkSession, d: str) -> DataFrame:
    return insights.recurring_series(derive.insight_rows(spark, d), derive.now()).withColumn("ids", F.array_join("ids", ","))


@query()
def insight_recurring_cards(spark: SparkSession, d: str) -> DataFrame:
    return _cards(insights.recurrences(derive.insight_rows(spark, d), table(spark, d, "stored_documents"), derive.now())[0])


_RECENT = f"r AS (SELECT * FROM keyed WHERE direction = 'debit' AND key <> '' AND ts <= {NOW} AND datediff('day', day, DATE '2026-06-30') <= 35)"


@query(f"""WITH RECURSIVE {_INSIGHT}, {_RECENT}, q AS (SELECT *, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY book_id, key, day, amount_paise ORDER BY ts, id) AS gap FROM r),
  b AS (SELECT book_id, key, day, amount_paise, count(*) AS n, bool_and(CAST(ist AS TIME) <> TIME '00:00:00') AS timed, min(gap) AS closest, array_to_string(list_sort(list(id)), ',') AS ids FROM q GROUP BY 1, 2, 3, 4)
SELECT b.book_id, {_card_id("'duplicate|' || ids")}, 'possibleDuplicate' AS kind, CAST(amount_paise * 1000 // d * 4 AS BIGINT) AS score, ids AS evidence, key AS mute_key FROM b JOIN den USING (book_id) WHERE n >= 2 AND (NOT timed OR closest <= 600)""")
def insight_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return _cards(insights.duplicates(derive.insight_rows(spark, d), table(spark, d, "stored_documents"), derive.now()))


@query(f"""WITH RECURSIVE {_INSIGHT}, {_RECENT}, p AS (SELECT r.book_id, r.id, r.key, r.amount_paise, count(*) AS n, quantile_disc(k.amount_paise, 0.5) AS typical FROM r JOIN keyed k ON k.book_id = r.book_id AND k.key = r.key AND k.direction = 'debit' AND k.ts < r.ts WHERE r.amount_paise >= 100000 GROUP BY 1, 2, 3, 4)
SELECT p.book_id, {_card_id("'outlier|' || id")}, 'outlierAmount' AS kind, CAST(amount_paise * 1000 // d * 2 AS BIGINT) AS score, p.id AS evidence, key AS mute_key FROM p JOIN den USING (book_id) WHERE n >= 5 AND typical > 0 AND amount_paise >= typical * 3""".replace("'outlier|' || id)", "'outlier|' || p.id)"))
def insight_outliers(spark: SparkSession, d: str) -> DataFrame:
    return _cards(insights.outliers(derive.insight_rows(spark, d), table(spark, d, "stored_documents"), derive.now()))


@query()
def insight_engine(spark: SparkSession, d: str) -> DataFrame:
    cards = insights.insight_cards(derive.insight_rows(spark, d), table(spark, d, "stored_documents"), derive.now())
    return cards.withColumn("evidence", F.array_join("evidence", ","))


@query(f"""WITH RECURSIVE {L}, {_SERIES}, t AS (SELECT c.book_id, sp.merchant AS display, cadence, median, CASE cadence WHEN 'monthly' THEN median ELSE median * 52 // 12 END AS monthly, c.key FROM c JOIN st ON st.book_id = c.book_id AND st.key = c.key JOIN sp ON sp.book_id = c.book_id AND sp.key = c.key AND sp.r = 1 WHERE cadence IS NOT NULL AND median > 0 AND datediff('day', CAST(last_seen + INTERVAL 330 MINUTE AS DATE), DATE '2026-06-30') <= CASE cadence WHEN 'monthly' THEN 66 ELSE 16 END)
SELECT * FROM (SELECT book_id, display, cadence, CAST(median AS BIGINT) AS median, CAST(row_number() OVER (PARTITION BY book_id ORDER BY monthly DESC, key) AS INTEGER) AS rank FROM t) WHERE rank <= 8""")
def tools_recurring(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    s = insights.recurring_series(derive.insight_rows(spark, d), derive.now())
    rank = F.row_number().over(Window.partitionBy("book_id").orderBy(F.desc("monthly"), F.asc("key")))
    return s.withColumn("rank", rank).where("rank <= 8").select("book_id", "display", "cadence", "median", "rank")


# statements


@query("SELECT file_id AS doc_id, CASE WHEN len(list_filter(header_row, lambda c: regexp_matches(c, '(?i)date|narration|particular|description|remarks|debit|credit|withdraw|deposit|amount|balance|ref|cheque'))) >= 2 THEN 0 END AS header_ix FROM statement_files WHERE len(body_rows) + len(header_row) > 0")
def verify_header(spark: SparkSession, d: str) -> DataFrame:
    return verify.header_index(derive.statement_tables(spark, d))


_BODY = """b AS (SELECT file_id, unnest(body_rows) AS r, generate_subscripts(body_rows, 1) AS row_ix FROM statement_files)"""
_FORMAT_SQL = (("dd/MM/yyyy", "[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}", "%d/%m/%Y"), ("dd/MM/yy", "[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}", "%d/%m/%y"), ("dd-MM-yyyy", "[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}", "%d-%m-%Y"), ("dd MMM yyyy", "[0-9]{1,2} +[A-Za-z]{3} +[0-9]{4}", "%d %b %Y"), ("dd-MMM-yyyy", "[0-9]{1,2}-[A-Za-z]{3}-[0-9]{4}", "%d-%b-%Y"), ("dd-MMM-yy", "[0-9]{1,2}-[A-Za-z]{3}-[0-9]{2}", "%d-%b-%y"), ("yyyy-MM-dd", "[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}", "%Y-%m-%d"))
_VOTES = ", ".join(f"coalesce(bool_and(regexp_full_match(trim(c), '{p}') AND try_strptime(trim(c), '{f}') IS NOT NULL), false) AS f{i}" for i, (_, p, f) in enumerate(_FORMAT_SQL))


@query(f"""WITH {_BODY}, k AS (SELECT * FROM b WHERE len(list_filter(r, lambda c: c <> '')) >= 3), e AS (SELECT file_id, unnest(r) AS c, generate_subscripts(r, 1) - 1 AS col FROM k), v AS (SELECT file_id, col, {_VOTES} FROM e WHERE c <> '' GROUP BY 1, 2)
SELECT file_id AS doc_id, CAST(col AS INTEGER) AS col, CASE {' '.join(f"WHEN f{i} THEN '{n}'" for i, (n, _, _) in enumerate(_FORMAT_SQL))} END AS date_format FROM v""")
def verify_date_format(spark: SparkSession, d: str) -> DataFrame:
    return verify.date_format_vote(verify.body_rows(derive.statement_tables(spark, d)))


@query(f"""WITH {_BODY}, h AS (SELECT file_id, len(list_filter(header_row, lambda c: regexp_matches(c, '(?i)date|narration|particular|description|remarks|debit|credit|withdraw|deposit|amount|balance|ref|cheque'))) >= 2 AS head, header_row, body_rows FROM statement_files),
  e AS (SELECT file_id, row_ix, unnest(r) AS c, generate_subscripts(r, 1) AS col FROM b), m AS (SELECT file_id, col, regexp_replace(regexp_replace(c, '[a-zA-Z]', 'A', 'g'), '[0-9]', 'N', 'g') AS mask, count(*) AS n, min(row_ix) AS seen FROM e WHERE c <> '' GROUP BY 1, 2, 3),
  t AS (SELECT file_id, col, mask FROM (SELECT *, row_number() OVER (PARTITION BY file_id, col ORDER BY n DESC, seen) AS rn FROM m) WHERE rn = 1), w AS (SELECT file_id, greatest(CASE WHEN head THEN len(header_row) ELSE 0 END, coalesce(list_max(list_transform(body_rows, lambda r: len(r))), 0)) AS width FROM h)
SELECT h.file_id AS doc_id, CASE WHEN head THEN array_to_string(header_row, '|') ELSE '' END AS header_row, CAST(width AS INTEGER) AS column_count, CAST(len(body_rows) AS BIGINT) AS row_count,
  (SELECT string_agg(coalesce(mask, ''), '|' ORDER BY g.col) FROM (SELECT unnest(range(1, width + 1)) AS col) g LEFT JOIN t ON t.file_id = h.file_id AND t.col = g.col) AS cell_shapes, CAST(NULL AS VARCHAR) AS bank_name FROM h JOIN w USING (file_id) WHERE len(body_rows) + len(header_row) > 0""")
def verify_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    f = verify.fingerprint(derive.statement_tables(spark, d))
    return f.withColumns({"header_row": F.array_join("header_row", "|"), "cell_shapes": F.array_join("cell_shapes", "|")})


@query()
def verify_column_inference(spark: SparkSession, d: str) -> DataFrame:
    return verify.infer_columns(derive.statement_tables(spark, d)).drop("reference_patterns")


@query("""WITH r AS (SELECT n_nationkey, o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS p, CASE o_orderstatus WHEN 'P' THEN 1 ELSE -1 END AS s FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
  q AS (SELECT *, row_number() OVER (PARTITION BY n_nationkey ORDER BY o_orderkey) AS row_ix, sum(p * s) OVER (PARTITION BY n_nationkey ORDER BY o_orderkey) AS bal FROM r), t AS (SELECT *, bal + CASE WHEN o_orderkey % 97 = 0 THEN 1 ELSE 0 END AS balance FROM q), l AS (SELECT *, lag(balance) OVER (PARTITION BY n_nationkey ORDER BY row_ix) AS prev FROM t)
SELECT n_nationkey AS doc_id, count(*) AS n_rows, CAST(min(row_ix) FILTER (WHERE prev IS NOT NULL AND prev + p * s <> balance) AS INTEGER) AS broken_at, CASE WHEN min(row_ix) FILTER (WHERE prev IS NOT NULL AND prev + p * s <> balance) IS NOT NULL THEN arg_min(CASE WHEN prev - p * s = balance THEN 'direction' ELSE 'chain' END, row_ix) FILTER (WHERE prev IS NOT NULL AND prev + p * s <> balance) END AS why FROM l GROUP BY 1""")
def verify_balance_chain(spark: SparkSession, d: str) -> DataFrame:
    """Orders of each nation as a statement with a running balance; every 97th balance is off by a paisa."""
    from pyspark.sql import Window

    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("doc_id"), "o_orderkey", "o_orderdate", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("p"), (F.col("o_orderstatus") == "P").alias("credit"))
    w = Window.partitionBy("doc_id").orderBy("o_orderkey")
    o = o.withColumn("row_ix", F.row_number().over(w)).withColumn("bal", F.sum(F.when(F.col("credit"), F.col("p")).otherwise(-F.col("p"))).over(w) + F.when(F.col("o_orderkey") % 97 == 0, 1).otherwise(0))
    rupees = lambda c: (c.cast("decimal(20,0)") / 100).cast("decimal(22,2)").cast("string")
    blank = F.lit("")
    cells = F.array(F.date_format("o_orderdate", "dd/MM/yyyy"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")), F.when(F.col("credit"), blank).otherwise(rupees(F.col("p"))), F.when(F.col("credit"), rupees(F.col("p"))).otherwise(blank), rupees(F.col("bal")))
    null = F.lit(None).cast("int")
    rows = o.select("doc_id", "row_ix", cells.alias("cells"), F.lit(0).alias("date_col"), F.lit(1).alias("narration_col"), null.alias("reference_col"), F.lit(2).alias("debit_col"), F.lit(3).alias("credit_col"), null.alias("amount_col"), null.alias("side_col"), F.lit(4).alias("balance_col"), F.lit(False).alias("unsigned"), F.lit("dd/MM/yyyy").alias("date_format"))
    return verify.chain_outcome(verify.balance_chain(rows))


# streams


@query("SELECT content_hash, count(*) AS n FROM (SELECT DISTINCT content_hash FROM stored_transactions) GROUP BY 1")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """First rows of a stream over the whole table; its result is that of the batch."""
    from ledgerloom.session import scratch

    t = table(spark, d, "stored_transactions")
    where = scratch(spark, "stream")
    s = spark.readStream.schema(t.schema).parquet(_folder(spark, d, "stored_transactions"))
    out = f"{where}/out"
    capture.run(capture.first_seen(s), capture.append_new(out, "content_hash"), f"{where}/state")
    return spark.read.parquet(out).groupBy("content_hash").agg(F.count("*").alias("n"))


def _folder(spark: SparkSession, d: str, name: str) -> str:
    """A folder to stream a table from: its own if it is one, else a copy in the shared folder."""
    import os

    from ledgerloom.session import scratch

    path = f"{d}/{name}.parquet"
    if os.path.isdir(path):
        return path
    copy = scratch(spark, "stream-in")
    table(spark, d, name).write.parquet(copy)
    return copy
