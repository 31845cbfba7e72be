"""Live capture with Structured Streaming: alerts in, captured rows out, late rows folded in.

State is bounded by the watermark: duplicates are told apart for ``RETENTION`` of event time, and counts close when
the watermark passes their month. Writes go through ``foreachBatch`` and are idempotent by batch id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ledgerloom.functions import cal
from ledgerloom.operators import match
from ledgerloom.operators.alerts import parse_alerts
from ledgerloom.operators.analytics import is_debit

RETENTION = "45 days"


def alert_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _event_time(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumn("_event", F.col(ts).cast("timestamp")).withWatermark("_event", RETENTION)


def captures(alerts: DataFrame) -> DataFrame:
    """Parsed alerts, the first of each capture hash within the retention."""
    return _event_time(parse_alerts(alerts), "received_at").dropDuplicatesWithinWatermark(["capture_hash"]).drop("_event")


def first_seen(rows: DataFrame, key: str = "content_hash", ts: str = "txn_at") -> DataFrame:
    """Rows of a stream, the first of each key within the retention."""
    return _event_time(rows, ts).dropDuplicatesWithinWatermark([key]).drop("_event")


def daily_spend(rows: DataFrame, ts: str = "txn_at", late: str = RETENTION) -> DataFrame:
    """Debits of each book and local day; a day closes once the watermark has passed it."""
    x = rows.where(is_debit()).withColumn("_event", cal.ist(F.col(ts)).cast("timestamp")).withWatermark("_event", late)
    g = x.groupBy("book_id", F.window("_event", "1 day")).agg(F.sum("amount_paise").alias("spent"), F.count("*").alias("payments"))
    return g.select("book_id", F.date_format("window.start", "yyyy-MM-dd").alias("day"), "spent", "payments")


def append_new(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """A batch writer that appends rows whose key the table lacks, in one folder for each batch: a repeated batch rewrites its own."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        out = batch.dropDuplicates([key])
        try:
            seen = spark.read.option("basePath", path).parquet(path).where(F.col("batch") != batch_id).select(key)
            out = out.join(seen, key, "left_anti")
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        out.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def drop_expired(captured: DataFrame, days: int = 45) -> DataFrame:
    """Captured rows that the newest event has not yet outlived; elapsed whole days."""
    newest = captured.agg(F.max("received_at").alias("_now"))
    return captured.join(F.broadcast(newest)).where(F.floor(cal.seconds_between(F.col("received_at"), F.col("_now")) / 86400) <= days).drop("_now")


def rematch(app_path: str, bank_path: str, out_path: str) -> Callable[[DataFrame, int], None]:
    """A batch writer for late rows: matches of their months and the neighbours are made again and replace those partitions."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        m = cal.month_index(F.col("ts"))
        # months touched by a batch: a handful of numbers, whatever the batch holds
        months = sorted({r["m"] for r in batch.select(F.explode(F.array(m - 1, m, m + 1)).alias("m")).distinct().collect()})
        if not months:
            return
        near = m.between(months[0] - 1, months[-1] + 1)
        done = match.recompute_months(spark.read.parquet(app_path).where(near), spark.read.parquet(bank_path).where(near), months)
        done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(out_path)

    return write


def run(stream: DataFrame, write: Callable[[DataFrame, int], None] | None, checkpoint: str, table: str | None = None) -> StreamingQuery:
    """Work off what is there and stop."""
    w = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    w = w.foreachBatch(write) if write else w.format("memory").queryName(table).outputMode("append")
    q = w.start()
    q.awaitTermination()
    return q
