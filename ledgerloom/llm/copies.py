"""Duplicates hidden by formatting differences: an incremental ledger of canonical keys.

Two rows are copies if they agree on the exact columns, on the squeezed columns when case and
everything but letters and digits is ignored, and on the bags of words of the text column.
The ledger holds one row for each canonical key: its count and its earliest row. A batch is
aggregated first (map-side, so a hot key is a single row per task), then full-outer-joined
against the buckets it touches; counts add up and the earlier representative stays.

Defined cases: null and empty are equal in squeezed and word columns; null exact columns are
equal to each other only; the earliest row is the one with the smallest order value (null
last), then the smallest id; an empty batch leaves the ledger as it was; rows with a null id are
counted but never represent a key that has an id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.segments import pairs_within
from ledgerloom.session import forget, scratch, stored

EXACT = ("book_id", "source_raw", "txn_at", "amount_paise", "direction")
SQUEEZED = ("counterparty", "reference")
WORDS = "narration"
#: Keys that a bucket should hold; the first batch decides the number of buckets.
BUCKET_KEYS = 2_000_000


def squeeze(text: Column) -> Column:
    """Letters and digits only, in lower case; null as empty."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", "")


def word_bag(text: Column) -> Column:
    """The words of a text, in lower case, sorted and joined; null as empty."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "), " ")
    return F.array_join(F.array_sort(F.filter(words, lambda w: w != "")), " ")


def canonical_key(exact: Sequence[str] = EXACT, squeezed: Sequence[str] = SQUEEZED, words: str = WORDS) -> Column:
    """A 128-bit digest of the canonical form, as 32 hex digits."""
    unit = "\u001f"
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in exact]
    return F.md5(F.concat_ws(unit, *parts, *(squeeze(F.col(c)) for c in squeezed), word_bag(F.col(words))))


def aggregate_batch(rows: DataFrame, row_id: str = "uuid", order: str = "txn_at", key: Column | None = None) -> DataFrame:
    """canonical_key, copies, first_at, first_id of one batch."""
    first = F.struct(F.col(order).isNull().alias("late"), F.col(order).alias("at"), F.col(row_id).isNull().alias("none"), F.col(row_id).alias("id"))
    grouped = rows.select((canonical_key() if key is None else key).alias("canonical_key"), first.alias("first")).groupBy("canonical_key").agg(F.count("*").alias("copies"), F.min("first").alias("first"))
    return grouped.select("canonical_key", "copies", F.col("first.at").alias("first_at"), F.col("first.id").alias("first_id"))


class CopyLedger:
    """Canonical-key counts in a bucketed table below ``path``.

    A merge reads and rewrites only the buckets its batch touches, as a new version beside the old files, and then writes
    a manifest (bucket, version, number of buckets) and the ids of the batches it holds. A lost executor or a failed job so changes nothing, and a
    batch that is merged again under its id is not counted twice. ``version`` opens an older state.
    """

    SCHEMA = "canonical_key string, copies bigint, first_at timestamp_ntz, first_id string, version int, bucket int"

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, version: int = 0):
        self.spark, self.path, self.buckets, self.version = spark, path or scratch(spark, "copy-ledger"), buckets, version
        rows = spark.read.schema("bucket int, version int, buckets int").parquet(f"{self.path}/manifest/{version}").collect() if version else []
        self.where = {r["bucket"]: r["version"] for r in rows}
        self.batches = {r["batch"] for r in spark.read.schema("batch string").parquet(f"{self.path}/batches/{version}").collect()} if version else set()
        if rows:
            self.buckets = rows[0]["buckets"]

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("canonical_key"), F.lit(self.buckets)).cast("int")

    def read(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """The current rows of some buckets, of all by default."""
        paths = [f"{self.path}/version={v}/bucket={b}" for b, v in sorted(self.where.items()) if buckets is None or b in buckets]
        if not paths:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).option("basePath", self.path).parquet(*paths)

    def merge(self, rows: DataFrame, batch_id: str | None = None, **names) -> CopyLedger:
        """Fold one batch in, unless a batch of this id has been."""
        if batch_id is not None and batch_id in self.batches:
            return self
        keyed = stored(aggregate_batch(rows, **names), "copy-batch")
        if self.buckets is None:
            self.buckets = max(16, -(-keyed.count() // BUCKET_KEYS))
        batch = keyed.withColumn("bucket", self._bucket())
        touched = sorted(r["bucket"] for r in batch.select("bucket").distinct().collect())  # at most ``buckets`` numbers
        if not touched:
            return self
        known = [b for b in touched if b in self.where]
        merged = self.fold(self.read(known), batch) if known else batch
        version = self.version + 1
        merged.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/version={version}")
        forget(keyed)
        self.where |= dict.fromkeys(touched, version)
        self.batches |= {batch_id} if batch_id is not None else set()
        write = lambda rows, schema, name: self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{name}/{version}")
        write([(b,) for b in sorted(self.batches)], "batch string", "batches")
        write([(b, v, self.buckets) for b, v in sorted(self.where.items())], "bucket int, version int, buckets int", "manifest")
        self.version = version
        return self

    @staticmethod
    def fold(old: DataFrame, batch: DataFrame) -> DataFrame:
        """Full outer join on bucket and key: counts add up, the earlier representative stays."""
        side = lambda df, p: df.select("bucket", "canonical_key", *(F.col(c).alias(p + c) for c in ("copies", "first_at", "first_id")))
        joined = side(old, "a_").join(side(batch, "b_"), ["bucket", "canonical_key"], "full_outer")
        both = lambda p: F.when(F.col(p + "copies").isNotNull(), F.struct(F.col(p + "first_at").isNull().alias("late"), F.col(p + "first_at").alias("at"), F.col(p + "first_id").isNull().alias("none"), F.col(p + "first_id").alias("id")))
        first = F.least(both("a_"), both("b_"))
        zero = F.lit(0)
        return joined.select("canonical_key", (F.coalesce("a_copies", zero) + F.coalesce("b_copies", zero)).alias("copies"), first["at"].alias("first_at"), first["id"].alias("first_id"), "bucket")


def collapse(batches: Sequence[DataFrame], spark: SparkSession) -> DataFrame:
    """One row for each payment over all batches: canonical_key, copies, first_at, first_id."""
    ledger = CopyLedger(spark)
    for rows in batches:
        ledger.merge(rows)
    return ledger.read().drop("bucket", "version")


def copy_pairs(rows: DataFrame, ledger: DataFrame, row_id: str = "uuid") -> DataFrame:
    """All pairs of copies, from the keys the ledger counts more than once; large groups of copies are split."""
    many = ledger.where(F.col("copies") > 1).select("canonical_key", "copies")
    members = stored(rows.select(canonical_key().alias("canonical_key"), F.col(row_id).alias("id")).join(many, "canonical_key"), "copies")
    return pairs_within(members, ["canonical_key"], "id", "copies").select(F.col("a").alias("uuid_a"), F.col("b").alias("uuid_b")).distinct()


def copy_classes(rows: DataFrame, ledger: DataFrame, row_id: str = "uuid") -> DataFrame:
    """Each row with the representative and size of its class."""
    keyed = rows.select(F.col(row_id), canonical_key().alias("canonical_key"))
    return keyed.join(ledger, "canonical_key").select(row_id, F.col("first_id").alias("class_id"), "copies")
