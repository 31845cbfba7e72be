"""Positioned text to statement tables: words with places become a header, columns and rows.

Words have doc_id, page, x0, x1, y, text. The header is the first line in which three columns have a role; its words, joined where they stand close,
give the columns; words below fall to the column whose middle is nearest; a line with a date begins a row and lines without one continue it.
Every step is a window or an aggregate over one document's words. Defined cases: a document without a header gives no row; lines above the
first date are furniture; pages are read in order, and a header repeated on a later page is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.verify import label_role
from ledgerloom.sources.drift import DATE


def lines_of(words: DataFrame, slack: float = 2.0) -> DataFrame:
    """``words`` with line: a new line begins where y grows by more than ``slack``."""
    order = Window.partitionBy("doc_id", "page").orderBy("y", "x0")
    new = F.when(F.col("y") - F.lag("y").over(order) > slack, 1).otherwise(0)
    w = words.withColumn("_new", new)
    return w.withColumn("line", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def header_columns(lines: DataFrame, gap: float = 7.0) -> DataFrame:
    """doc_id, page, line, col, label, mid of the header: words of one label stand no more than ``gap`` apart."""
    order = Window.partitionBy("doc_id", "page", "line").orderBy("x0")
    w = lines.withColumn("_new", F.when(F.col("x0") - F.lag("x1").over(order) > gap, 1).otherwise(0)).withColumn("col", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    cells = w.groupBy("doc_id", "page", "line", "col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda x: x["text"]), " ").alias("label"), ((F.min("x0") + F.max("x1")) / 2).alias("mid"))
    roles = cells.groupBy("doc_id", "page", "line").agg(F.count_distinct(label_role(F.col("label"))).alias("roles"), F.count_if(F.col("label").rlike(DATE)).alias("dated"))
    first = roles.where("roles >= 3 and dated = 0").groupBy("doc_id").agg(F.min(F.struct("page", "line")).alias("h"))
    return cells.join(first, "doc_id").where((F.col("page") == F.col("h.page")) & (F.col("line") == F.col("h.line"))).drop("h")


def layout_rows(words: DataFrame, gap: float = 7.0, slack: float = 2.0) -> DataFrame:
    """doc_id, row_ix, cells: the header as row 0, then the rows."""
    lines = lines_of(words, slack)
    head = header_columns(lines, gap)
    cols = head.groupBy("doc_id").agg(F.min("page").alias("hp"), F.min("line").alias("hl"), F.array_sort(F.collect_list(F.struct("col", "mid", "label"))).alias("cols"))
    w = lines.join(cols, "doc_id").where((F.col("page") > F.col("hp")) | (F.col("line") > F.col("hl")))
    mid = (F.col("x0") + F.col("x1")) / 2
    near = F.array_min(F.transform("cols", lambda c: F.struct(F.abs(c["mid"] - mid).alias("d"), c["col"].alias("col"))))["col"]
    cells = w.withColumn("col", near).groupBy("doc_id", "page", "line", "col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda x: x["text"]), " ").alias("t"))
    # a later page's copy of the header has the same labels
    labels = cols.select("doc_id", F.explode("cols").alias("c")).select("doc_id", F.col("c.col").alias("col"), F.col("c.label").alias("label"))
    cells = cells.join(labels, ["doc_id", "col"])
    line = cells.groupBy("doc_id", "page", "line").agg(F.map_from_entries(F.collect_list(F.struct("col", "t"))).alias("m"), F.bool_and(F.col("t") == F.col("label")).alias("is_head"), F.bool_or(F.col("t").rlike(DATE) & (label_role(F.col("label")) == "date")).alias("dated"))
    order = Window.partitionBy("doc_id").orderBy("page", "line").rowsBetween(Window.unboundedPreceding, 0)
    rows = line.where("not is_head").withColumn("row_ix", F.sum(F.coalesce("dated", F.lit(False)).cast("int")).over(order)).where("row_ix > 0")
    parts = rows.select("doc_id", "row_ix", "page", "line", F.explode("m").alias("col", "t"))
    joined = parts.groupBy("doc_id", "row_ix", "col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "line", "t"))), lambda x: x["t"]), " ").alias("t")).groupBy("doc_id", "row_ix").agg(F.map_from_entries(F.collect_list(F.struct("col", "t"))).alias("m"))
    body = joined.join(cols, "doc_id").select("doc_id", F.col("row_ix").cast("int").alias("row_ix"), F.transform("cols", lambda c: F.coalesce(F.col("m")[c["col"]], F.lit(""))).alias("cells"))
    return cols.select("doc_id", F.lit(0).alias("row_ix"), F.transform("cols", lambda c: c["label"]).alias("cells")).unionByName(body)
