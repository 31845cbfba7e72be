"""Session helpers: table access, the shared folder, and lineage cuts that survive lost executors."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", name: str = "ledgerloom") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables; filters and column pruning reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where that setting is absent (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        where = tempfile.mkdtemp(prefix="ledgerloom-")
    spark.sparkContext.setCheckpointDir(where)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there and column pruning goes on."""
    path = scratch(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept.stored_at = path
    return kept


def forget(*tables: DataFrame) -> None:
    """Remove tables of ``stored`` whose readers are all written themselves."""
    for df in tables:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let go of what finished queries left in the driver: their plans, broadcasts and shuffle files stay until its garbage is collected, and meanwhile its heap grows to the limit."""
    gc.collect()  # Python's references hold plans of the JVM
    spark.sparkContext._jvm.System.gc()


def here(condition: Column) -> Column:
    """A filter that stays where it stands.

    Catalyst moves a filter below the projections it reads by writing their expressions into it again, which for a chain of
    dear columns repeats them over and over; a condition it holds for non-deterministic is left in place.
    """
    return F.when(condition, F.rand(0)).otherwise(-1 - F.rand(1)) >= 0
