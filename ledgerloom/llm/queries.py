"""Queries of the llm operators over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import copies, leaks, lookalike, mixing, names, nearest, personal
from ledgerloom.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return names.name_pairs(_entities(spark, d))


def p3_entities(spark: SparkSession, d: str) -> DataFrame:
    """Each spelling with the smallest spelling of its entity and its number of links."""
    linked = _entities(spark, d)
    first = linked.groupBy("entity").agg(F.min("name").alias("entity_name"))
    return linked.join(first, "entity").select("book_id", "name", "entity_name", "n_links")


def _entities(spark: SparkSession, d: str) -> DataFrame:
    return names.entities(names.payee_names(table(spark, d, "stored_transactions"), table(spark, d, "spend_records")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return nearest.nearest_in_time(table(spark, d, "recon_app"), table(spark, d, "recon_bank"), "app_id", "bank_id", ["book_id", "amount_paise", "direction"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.personal_items(table(spark, d, "alerts"))


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    return personal.redacted_texts(table(spark, d, "alerts"))


#: Rows before this instant are the ledger's first batch, all others its second.
P6_SPLIT = "2025-07-01"


def _ledger(rows: DataFrame) -> DataFrame:
    late = F.coalesce(F.col("txn_at") >= F.lit(P6_SPLIT).cast("timestamp_ntz"), F.lit(True))
    return copies.collapse([rows.where(~late), rows.where(late)], rows.sparkSession)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "stored_transactions")
    return copies.copy_pairs(rows, _ledger(rows))


def p6_payments(spark: SparkSession, d: str) -> DataFrame:
    """One row for each payment with its number of copies."""
    return _ledger(table(spark, d, "stored_transactions")).select("first_id", "first_at", F.col("copies").cast("bigint").alias("copies"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), leaks.EXACT).select("doc_id", "item_id")


def p7_near(spark: SparkSession, d: str) -> DataFrame:
    """Leaks with up to two word edits in a passage, and the words of the item that leaked."""
    return leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_pairs(table(spark, d, "documents"))


def p9_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.forms(table(spark, d, "documents"))


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.classes(table(spark, d, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p3_found, p3_entities, p4_found, p5_found, p5_redacted, p6_found, p6_payments, p7_found, p7_near, p8_mix, p8_shares, p9_found, p9_forms, p9_classes)}


def oracle_sql() -> dict[str, str]:
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    plain = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
    spaces = "".join(map(chr, (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)))
    looks = lookalike.LOOKALIKES
    form = (
        "nfc_normalize(translate(nfc_normalize(regexp_replace(translate(text, "
        + f"'{(wide + spaces).replace(chr(39), chr(39) * 2)}', '{(plain + ' ' * len(spaces)).replace(chr(39), chr(39) * 2)}'), "
        + r"'[\x{AD}\x{200B}-\x{200F}\x{2060}-\x{2064}\x{FEFF}]', '', 'g')), "
        + f"'{''.join(looks)}', '{''.join(looks.values())}'))"
    )
    key = """md5(concat_ws(chr(31), coalesce('=' || book_id, '-'), coalesce('=' || source_raw, '-'), coalesce('=' || txn_at, '-'), coalesce('=' || amount_paise, '-'), coalesce('=' || direction, '-'),
      regexp_replace(lower(coalesce(counterparty, '')), '[^\\p{L}\\p{N}]+', '', 'g'), regexp_replace(lower(coalesce(reference, '')), '[^\\p{L}\\p{N}]+', '', 'g'),
      array_to_string(list_sort(regexp_extract_all(lower(coalesce(narration, '')), '[\\p{L}\\p{N}]+')), ' ')))"""
    return {
        "p4_found": """
WITH a AS (SELECT DISTINCT app_id, book_id, txn_at, amount_paise, direction, coalesce(reference, '') AS r FROM recon_app),
     b AS (SELECT DISTINCT bank_id, book_id, txn_at, amount_paise, direction, coalesce(reference, '') AS r FROM recon_bank),
     c AS (SELECT a.app_id, b.bank_id, row_number() OVER (PARTITION BY a.app_id, a.book_id, a.txn_at, a.amount_paise, a.direction, a.r ORDER BY abs(epoch_us(a.txn_at) - epoch_us(b.txn_at)), b.txn_at, b.bank_id) AS n
           FROM a JOIN b ON a.book_id = b.book_id AND a.amount_paise = b.amount_paise AND a.direction = b.direction
             AND abs(epoch_us(a.txn_at) - epoch_us(b.txn_at)) <= 172800000000 AND (a.r = '' OR b.r = '' OR ltrim(a.r, '0') = ltrim(b.r, '0')))
SELECT DISTINCT app_id, bank_id FROM c WHERE n = 1""",
        "p6_found": f"WITH k AS (SELECT uuid, {key} AS k FROM stored_transactions) SELECT DISTINCT a.uuid AS uuid_a, b.uuid AS uuid_b FROM k a JOIN k b ON a.k = b.k AND a.uuid < b.uuid",
        "p6_payments": f"WITH k AS (SELECT uuid, txn_at, {key} AS k FROM stored_transactions) SELECT arg_min(uuid, (txn_at, uuid)) AS first_id, min(txn_at) AS first_at, count(*) AS copies FROM k GROUP BY k",
        "p7_found": """
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents), iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items),
     d AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM dw),
     t AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM iw)
SELECT DISTINCT doc_id, item_id FROM d JOIN t USING (g)""",
        "p9_found": f"WITH f AS (SELECT DISTINCT doc_id, text, {form} AS form FROM documents) SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM f a JOIN f b ON a.form = b.form AND a.text <> b.text AND a.doc_id < b.doc_id",
        "p9_forms": f"SELECT doc_id, {form} AS form FROM documents",
        "p9_classes": f"WITH f AS (SELECT doc_id, text, {form} AS form FROM documents), c AS (SELECT form, min(doc_id) AS class_id, count(DISTINCT text) AS n_texts, count(*) AS n_rows FROM f GROUP BY form) SELECT doc_id, class_id, n_texts, n_rows FROM f JOIN c USING (form)",
    }
