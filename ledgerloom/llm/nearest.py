"""Matching records by nearest time: ASOF joins inside hash-partitioned Arrow groups.

Rows go to groups by a hash of the entity key and a block of time, so a hot key is spread over
its blocks; the right side also enters the next and previous block where it lies within the
tolerance of its bounds. Inside a group DuckDB joins backward and forward, and the nearer
candidate within the tolerance is kept.

Where both sides carry a reference, the references must be equal without leading zeros. A left
row with a reference therefore meets two right relations, that of its own reference and that
without one; a left row without meets all.

Defined cases: rows without time, amount, key column or id have no match; repeated rows count once;
equal distances go to the earlier right time, then to the smaller right id; empty tables give an
empty result; extra columns are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE_S = 48 * 3600
#: Length of a block of time. Bank rows within the tolerance of a bound are in two blocks.
BLOCK_S = 8 * 86400
#: Rows of both sides that a group should hold.
GROUP_ROWS = 40_000

_OUT = pa.schema([("left_id", pa.int64()), ("right_id", pa.int64())])

#: One row for each left row, relation and direction. q is the entity key, r the reference ('' for none).
_SQL = """
WITH bare AS (SELECT q, t, min(id) AS id FROM rgt WHERE r = '' GROUP BY q, t),
     own AS (SELECT q, r, t, min(id) AS id FROM rgt WHERE r <> '' GROUP BY q, r, t),
     whole AS (SELECT q, t, min(id) AS id FROM rgt GROUP BY q, t),
     named AS (SELECT * FROM lft WHERE r <> ''),
     free AS (SELECT * FROM lft WHERE r = ''),
     found AS (
  SELECT a.id AS left_id, a.q, a.r, a.t AS lt, b.t AS bt, b.id AS right_id FROM named a ASOF JOIN own b ON a.q = b.q AND a.r = b.r AND a.t >= b.t
  UNION ALL SELECT a.id, a.q, a.r, a.t, b.t, b.id FROM named a ASOF JOIN own b ON a.q = b.q AND a.r = b.r AND a.t <= b.t
  UNION ALL SELECT a.id, a.q, a.r, a.t, b.t, b.id FROM named a ASOF JOIN bare b ON a.q = b.q AND a.t >= b.t
  UNION ALL SELECT a.id, a.q, a.r, a.t, b.t, b.id FROM named a ASOF JOIN bare b ON a.q = b.q AND a.t <= b.t
  UNION ALL SELECT a.id, a.q, a.r, a.t, b.t, b.id FROM free a ASOF JOIN whole b ON a.q = b.q AND a.t >= b.t
  UNION ALL SELECT a.id, a.q, a.r, a.t, b.t, b.id FROM free a ASOF JOIN whole b ON a.q = b.q AND a.t <= b.t)
SELECT left_id, right_id FROM (
  SELECT *, row_number() OVER (PARTITION BY left_id, q, r, lt ORDER BY abs(lt - bt), bt, right_id) AS n FROM found WHERE abs(lt - bt) <= {tolerance})
WHERE n = 1
"""


def bare_reference(ref: Column) -> Column:
    """'' where there is none, else a mark and the reference without leading zeros."""
    text = F.coalesce(ref, F.lit(""))
    return F.when(text == "", "").otherwise(F.concat(F.lit("="), F.ltrim(text, F.lit("0"))))


def _match_group(left: pa.Table, right: pa.Table, tolerance_us: int) -> pa.Table:
    import duckdb

    if not left.num_rows or not right.num_rows:
        return _OUT.empty_table()
    con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})  # no spill to the executor's own disk
    try:
        con.register("lft", left)
        con.register("rgt", right)
        return con.sql(_SQL.format(tolerance=tolerance_us)).to_arrow_table().cast(_OUT)
    finally:
        con.close()


def _side(rows: DataFrame, row_id: str, keys: list[str], ts: str, ref: str) -> DataFrame:
    kept = rows.select(F.col(row_id).alias("id"), F.xxhash64(*keys).alias("h"), F.concat_ws("\u001f", *(F.col(k).cast("string") for k in keys)).alias("q"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), bare_reference(F.col(ref)).alias("r"), *(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)))
    full = F.col("id").isNotNull() & F.col("t").isNotNull()
    for i in range(len(keys)):
        full = full & F.col(f"k{i}").isNotNull()
    return kept.where(full).select("id", "h", "q", "t", "r")


def nearest_in_time(
    left: DataFrame, right: DataFrame, left_id: str, right_id: str, keys: list[str], ts: str = "txn_at", ref: str = "reference", tolerance_s: int = TOLERANCE_S, block_s: int = BLOCK_S, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """left_id, right_id: for each left row its nearest right row. ``block_s`` must not be below ``tolerance_s``."""
    if block_s < tolerance_s:
        raise ValueError("a block must be as long as the tolerance at least")
    tolerance_us, block_us = tolerance_s * 1_000_000, block_s * 1_000_000
    groups = max(1, -(-(left.count() + right.count()) // group_rows))
    block = lambda t: F.floor(t / F.lit(block_us)).cast("bigint")
    at = lambda df: df.withColumn("g", F.pmod(F.xxhash64("h", "b"), F.lit(groups)).cast("int"))
    lft = at(_side(left, left_id, keys, ts, ref).withColumn("b", block(F.col("t"))))
    near = F.array_distinct(F.array(block(F.col("t") - tolerance_us), block(F.col("t")), block(F.col("t") + tolerance_us)))
    rgt = at(_side(right, right_id, keys, ts, ref).withColumn("b", F.explode(near)))
    # a key's block is part of the key inside a group, for several blocks of one key may share it
    cols = ["g", F.concat_ws("\u001f", "q", F.col("b").cast("string")).alias("q"), "t", "r", "id"]

    def match(a: pa.Table, b: pa.Table) -> pa.Table:
        return _match_group(a, b, tolerance_us)

    out = lft.select(*cols).groupBy("g").cogroup(rgt.select(*cols).groupBy("g")).applyInArrow(match, "left_id bigint, right_id bigint")
    return out.select(F.col("left_id").alias(left_id), F.col("right_id").alias(right_id)).distinct()
