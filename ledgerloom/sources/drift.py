"""Schemas that drift between files: one ledger table over all of them, and a report of each change.

Ingestion enforces a target schema. A cell goes to its typed column if its header label stands for a target field and the cell casts; every
other non-empty cell is kept in a JSON rescue column. Approved fields are promoted to columns of their own, and their values are
replayed from the rescue column. Ingestion keeps a record of each file: its columns, the kind that their cells cast to, and how many
of them were typed and how many rescued. The report compares the record of each file with that of the file before it in its series.

Defined cases: a null or empty ``header_row`` gives rescued cells under ``Column N`` and is skipped by the report; null ``body_rows`` give
no rows; rows shorter or longer than the header keep their cells (surplus ones under ``Column N``, which no label can be, as labels are read
in lower case); a null cell is an empty one; a repeated field or label in one header keeps its first column, the others count as unknown
columns under their labels; ties in time go by file id; null series or times form a series of their own; sums whose unit nothing
decides stay in the rescue column. Series may be of any length: the step to the previous file is taken inside blocks of one
month and then over the last file of each block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import stored
from ledgerloom.sources.malformed import paise

#: What the labels of statement columns stand for.
LABELS = {
    "txn_date": ["date", "tran date", "txn date", "transaction date", "posting date", "post date", "trans date", "entry date"],
    "value_date": ["value date", "value dt", "val. date", "val date", "val dt"],
    "narration": ["narration", "particulars", "description", "details", "transaction remarks", "remarks", "transaction details"],
    "reference": ["reference", "ref no", "ref no.", "utr no", "utr", "chq/ref no", "chq/ref no.", "ref/cheque no", "ref no./cheque no.", "cheque number", "chq no", "reference no"],
    "debit": ["debit", "withdrawal", "withdrawal amt", "withdrawal amt.", "dr amount", "withdrawal amount", "debit amount", "withdrawal amount (inr)", "paid out"],
    "credit": ["credit", "deposit", "deposit amt", "deposit amt.", "cr amount", "deposit amount", "credit amount", "deposit amount (inr)", "paid in"],
    "balance": ["balance", "closing balance", "running balance", "balance (inr)", "available balance"],
    "amount": ["amount", "amount (inr)", "amount(inr)"],
    "side": ["dr/cr", "dr / cr", "type (dr/cr)"],
    "serial": ["sl no", "sl. no", "serial", "s.no", "s.no.", "sr no", "sr. no", "serial no"],
    "currency": ["currency", "ccy", "curr"],
    "branch": ["branch", "branch code", "init.br", "init br", "branch name"],
    "channel": ["channel", "mode", "txn type", "transaction type", "txn mode"],
    "tag": ["tag", "category", "label"],
}
#: Typed columns of the target schema, by field.
TARGET = {"txn_date": "date", "value_date": "date", "narration": "string", "reference": "string", "debit": "paise", "credit": "paise", "balance": "paise"}
#: Fields approved for columns of their own, replayed from the rescue column.
PROMOTED = ("serial", "currency", "branch", "channel", "tag")

_MONTH = "(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
_D, _Y = "([0-9]{1,2})(?:st|nd|rd|th)?", "([0-9]{4}|[0-9]{2})"
#: The written forms of a day: a pattern over the lower-case cell, and the places of its year, month and day behind a mark.
DATE_FORMS = (
    (rf"^([0-9]{{1,2}})[-/. ]([0-9]{{1,2}})[-/. ]{_Y}$", "=$3 $2 $1"), (r"^([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})$", "=$1 $2 $3"), (rf"^{_D}[-/., ]*({_MONTH})[-/., ']*{_Y}$", "=$3 $2 $1"),
    (rf"^({_MONTH})[-/. ]*{_D}[-/., ]+{_Y}$", "=$3 $1 $2"), (rf"^([0-9]{{4}})[-/. ]?({_MONTH})[-/. ]?([0-9]{{1,2}})$", "=$1 $2 $3"),
    (r"^=([0-9]{2}) ", "=20$1 "), (r"([a-z]{3})[a-z]+", "$1"),
)
DATE = "(?i)" + "|".join(shape for shape, _ in DATE_FORMS[:5])
INTEGER = r"^[+-]?[0-9][0-9,]*$"
DECIMAL = r"^[+-]?(?:[0-9][0-9,]*)?\.[0-9]+$"


def label_key(label: Column) -> Column:
    """A label in lower case, trimmed, with single spaces."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), r"(?U)\s+", " "))


def _field_map() -> Column:
    pairs = [F.lit(x) for field, labels in LABELS.items() for label in labels for x in (label, field)]
    return F.create_map(*pairs)


def written_date(text: Column) -> Column:
    """The day that a cell writes in one of the forms; null if it writes none that exists."""
    bare = F.regexp_replace(F.btrim(text), r"\s+", " ")
    t = F.lower(bare)
    for shape, places in DATE_FORMS:
        t = F.regexp_replace(t, shape, places)
    to = lambda fmt: F.try_to_timestamp(t, F.lit(fmt)).cast("date")
    # most cells are no dates, which one pattern tells
    return F.when(bare.rlike(DATE), F.when(bare.rlike("[A-Za-z]{3}"), to("'='yyyy MMM d")).otherwise(to("'='yyyy M d")))


def any_date(text: Column) -> Column:
    """The day of a cell of a date column: a written one, or a spreadsheet serial, which counts days from 1899-12-30."""
    t = F.btrim(text)
    return F.coalesce(F.when(t.rlike("^[1-9][0-9]{4}$"), F.date_add(F.lit("1899-12-30").cast("date"), t.try_cast("int"))), written_date(t))


def cell_kind(cells: Column) -> Column:
    """What all non-empty cells together cast to: integer, decimal, date or text; null if there is none."""
    full = F.filter(F.transform(cells, lambda c: F.btrim(F.coalesce(c, F.lit("")))), lambda c: c != "")
    return (
        F.when(F.size(full) == 0, F.lit(None).cast("string"))
        .when(F.forall(full, lambda c: c.rlike(INTEGER)), "integer")
        .when(F.forall(full, lambda c: c.rlike(INTEGER) | c.rlike(DECIMAL)), "decimal")
        .when(F.forall(full, lambda c: written_date(c).isNotNull()), "date")
        .otherwise("text")
    )


_CAST = {"date": any_date, "paise": paise, "string": lambda c: c}


def columns_of(files: DataFrame) -> DataFrame:
    """Each file with its columns: position, label, field, kind.

    A field seen before in the same header, and any label without a field, is named by its own label with a mark before it.
    """
    keyed = files.withColumn("_labels", F.transform(F.coalesce("header_row", F.array().cast("array<string>")), label_key))
    names = F.transform("_labels", lambda x: F.coalesce(F.element_at(_field_map(), x), F.concat(F.lit("?"), x)))
    keyed = keyed.withColumn("_names", names)
    once = F.transform("_names", lambda x, i: F.when(F.array_position("_names", x) == i + 1, x).otherwise(F.concat(F.lit("?"), F.get("_labels", i), F.when(F.array_position("_labels", F.get("_labels", i)) == i + 1, "").otherwise(F.concat(F.lit(" Again "), i.cast("string"))))))
    keyed = keyed.withColumn("_names", once)
    body = F.coalesce("body_rows", F.array().cast("array<array<string>>"))
    cols = F.transform("_names", lambda x, i: F.struct(i.cast("int").alias("pos"), F.get("_labels", i).alias("label"), x.alias("field"), cell_kind(F.transform(body, lambda r: F.get(r, i))).alias("kind")))
    return keyed.withColumn("columns", cols).drop("_labels", "_names")


MONEY = tuple(f for f, kind in TARGET.items() if kind == "paise")


def money_readings(columns: Column, body: Column) -> tuple[Column, Column]:
    """A sheet of the file's sums (to be kept as ``_sheet``), and over it the readings of debit, credit and balance: whether the column's whole numbers are paise.

    Files drift between rupees with a fraction and whole paise, column by column. Of the readings that a file's
    whole-number columns allow, those under which most running balances close are kept, and of these, if there are such, those that
    read all whole numbers of the file in one unit. The second column is an array of them.
    """
    place = lambda f: F.get(F.filter(columns, lambda c: c["field"] == f), F.lit(0))
    def read(f: str) -> Column:
        return F.transform(body, lambda r: paise(F.coalesce(F.get(r, place(f)["pos"]), F.lit(""))))

    sheet = F.arrays_zip(*(read(f).alias(f) for f in MONEY))
    scaled = lambda row, f, u: F.coalesce(row[f], F.lit(0)) * F.when(u, 1).otherwise(100)

    def closed(rows: Column, u: dict[str, bool]) -> Column:
        step = lambda i: F.get(rows, i)
        fits = lambda i: (scaled(step(i), "balance", F.lit(u["balance"])) - scaled(step(i - 1), "balance", F.lit(u["balance"]))) == (scaled(step(i), "credit", F.lit(u["credit"])) - scaled(step(i), "debit", F.lit(u["debit"])))
        return F.when(F.size(rows) > 1, F.size(F.filter(F.sequence(F.lit(1), F.size(rows) - 1), fits))).otherwise(0)

    whole = sum((F.coalesce((place(f)["kind"] == "integer").cast("int"), F.lit(0)) for f in MONEY), F.lit(0))
    best = []
    for bits in range(8):
        u = {f: bool(bits >> k & 1) for k, f in enumerate(MONEY)}
        allowed = F.lit(True)
        for f in MONEY:
            if u[f]:
                allowed = allowed & (place(f)["kind"] == "integer")
        best.append(F.when(F.coalesce(allowed, F.lit(False)), F.struct(closed(F.col("_sheet"), u).alias("n"), (F.lit(not any(u.values())) | (whole == sum(u.values()))).alias("one"), *(F.lit(u[f]).alias(f) for f in MONEY))))
    read = F.array_compact(F.array(*best))
    most = F.array_max(F.transform(read, lambda x: x["n"]))
    top = F.filter(read, lambda x: x["n"] == most)
    return sheet, F.when(F.exists(top, lambda x: x["one"]), F.filter(top, lambda x: x["one"])).otherwise(top)


def _decided(top: Column, f: str) -> Column:
    """Whether a column is in paise; null where the best readings differ."""
    return F.when(F.forall(top, lambda x: x[f]), True).when(F.forall(top, lambda x: ~x[f]), False)


def _with_units(files: DataFrame) -> DataFrame:
    """``files`` with columns and _units: a struct of debit, credit and balance, true for paise, false for rupees, null where nothing decides.

    A file of whole numbers closes in paise as well as in rupees. Its balances are then compared with those of the files of its account whose unit is
    certain: the reading within a factor of ten of their (geometric) mean holds, and as the two readings lie a hundredfold apart, one at most does.
    """
    body = F.coalesce("body_rows", F.array().cast("array<array<string>>"))
    sheet, top = money_readings(F.col("columns"), body)
    known = columns_of(files).withColumn("_sheet", sheet).withColumn("_top", top)
    sums = F.filter(F.transform("_sheet", lambda r: F.abs(r["balance"])), lambda x: x > 0)
    level = F.aggregate(sums, F.lit(0.0), lambda acc, x: acc + F.ln(x.cast("double"))) / F.size(sums)
    known = known.withColumn("_level", F.when(F.size(sums) > 0, level)).drop("_sheet")
    # written once: three branches read it, and a filter on the readings would be worked into each scan
    known = stored(known.select("file_id", "account_id", "book_id", "received_at", "columns", "body_rows", "_top", "_level"), "file-readings").withColumn("_paise", _decided(F.col("_top"), "balance"))
    ln100 = math.log(100)
    certain = known.where("_paise is not null and _level is not null and account_id is not null").groupBy(F.col("account_id").alias("_a")).agg(F.avg(F.col("_level") - F.when(F.col("_paise"), ln100).otherwise(0.0)).alias("_mean"))
    open_files = known.where("_paise is null").join(certain, F.col("account_id") == F.col("_a"), "left").drop("_a")
    near = lambda shift: F.abs(F.col("_level") - shift - F.col("_mean")) < ln100 / 2
    told = F.when(near(ln100), True).when(near(0.0), False)
    open_files = open_files.withColumn("_told", told).withColumn("_top", F.when(F.col("_told").isNull(), F.col("_top")).otherwise(F.filter("_top", lambda x: x["balance"] == F.col("_told"))))
    both = known.where("_paise is not null").unionByName(open_files.drop("_mean", "_told"))
    return both.withColumn("_units", F.struct(*(_decided(F.col("_top"), f).alias(f) for f in MONEY))).drop("_top", "_level", "_paise")


def record(files: DataFrame) -> DataFrame:
    """file_id, account_id, received_at and columns of each file: what ingestion makes of it.

    A column is its position, label, field (target, approved, or its label under a mark), the kind its cells cast to, and the counts of cells that are typed (they
    fit the target schema) and rescued (no target field, or no cast). Written once, as the report reads it several times.
    """
    body = F.coalesce("body_rows", F.array().cast("array<array<string>>"))
    cells = lambda c: F.filter(F.transform(body, lambda r: F.btrim(F.coalesce(F.get(r, c["pos"]), F.lit("")))), lambda x: x != "")

    def fits(c: Column) -> Column:
        def of(kind: str) -> Column:
            fields = [f for f, k in TARGET.items() if k == kind]
            return F.when(c["field"].isin(*fields), F.size(F.filter(cells(c), lambda x: _CAST[kind](x).isNotNull())))

        # a column of written days only has cast already
        whole = F.when((c["kind"] == "date") & c["field"].isin(*(f for f, k in TARGET.items() if k == "date")), F.size(cells(c)))

        return F.coalesce(whole, *(of(kind) for kind in _CAST), F.lit(0))

    told = F.transform("columns", lambda c: F.struct(c["pos"].alias("pos"), c["label"].alias("label"), c["field"].alias("field"), c["kind"].alias("kind"), fits(c).alias("typed"), F.size(cells(c)).alias("full")))
    return columns_of(files.where(F.size("header_row") > 0)).select("file_id", "account_id", "received_at", told.alias("columns"))


def ingest(files: DataFrame) -> DataFrame:
    """One row for each body row: the target schema, and a rescue column (JSON, null if empty).

    The rescue column holds each non-empty cell that has no target column or does not cast, under its
    field, or its label where it has no field.
    """
    body = F.coalesce("body_rows", F.array().cast("array<array<string>>"))
    rows = _with_units(files).select("file_id", "account_id", "book_id", "received_at", "columns", "_units", F.posexplode(body).alias("row_ix", "cells"))
    name = lambda i: F.coalesce(F.get("columns", i)["field"], F.concat(F.lit("?Column "), (i + 1).cast("string")))
    entries = F.transform("cells", lambda c, i: F.struct(name(i), F.btrim(F.coalesce(c, F.lit("")))))
    rows = rows.withColumn("_m", F.map_filter(F.map_from_entries(entries), lambda k, v: v != ""))
    typed = {field: _CAST[kind](F.col("_m")[field]) for field, kind in TARGET.items()}
    typed |= {f: F.when(F.col(f"_units.{f}"), (typed[f] / 100).cast("bigint")).when(~F.col(f"_units.{f}"), typed[f]) for f in MONEY}
    out = rows.withColumns({f"{f}_paise" if TARGET[f] == "paise" else f: c for f, c in typed.items()})
    placed = {f: (F.col(f"{f}_paise") if TARGET[f] == "paise" else F.col(f)).isNotNull() for f in TARGET}
    out = out.withColumn("_took", F.array_compact(F.array(*(F.when(ok, F.lit(f)) for f, ok in placed.items()))))
    left = F.map_filter("_m", lambda k, v: ~F.array_contains("_took", k))
    bare = F.transform_keys(left, lambda k, v: F.regexp_replace(k, r"^\?", ""))
    return out.withColumn("rescued", F.when(F.size(left) > 0, F.to_json(bare))).drop("_m", "_took", "_units", "cells", "columns")


def promote(ledger: DataFrame, approved: tuple[str, ...] = PROMOTED) -> DataFrame:
    """Typed columns for approved fields, replayed from the rescue column and taken out of it."""
    m = F.from_json("rescued", "map<string,string>")
    out = ledger.withColumn("_r", m).withColumns({f: F.col("_r")[f] for f in approved})
    left = F.map_filter("_r", lambda k, v: ~k.isin(*approved))
    return out.withColumn("rescued", F.when(F.size(left) > 0, F.to_json(left))).drop("_r")


def drift_report(files: DataFrame) -> DataFrame:
    """file_id, change_kind, column_label: each file's record of ingestion against that of the file before it in its series.

    Columns with the same field are the same column; a column whose cells are rescued under a label is matched by its label. A vanished column and a
    new one of the same kind count as renamed if one of them at least is of no known field, and they stand at the same place or are the only two left over.
    """
    heads = stored(record(files), "file-columns")
    heads = heads.withColumn("_block", F.date_trunc("month", "received_at"))
    order = ["received_at", "file_id"]

    # Kinds that hold before a file: the last kind seen of each field, inside the block and before it.
    inside = Window.partitionBy("account_id", "_block").orderBy(*order)
    blocks = Window.partitionBy("account_id").orderBy("_block")
    tail = heads.groupBy("account_id", "_block").agg(F.max_by("columns", F.struct(*order)).alias("columns")).withColumn("_before", F.lag("columns").over(blocks))
    steps = heads.withColumn("_prev", F.lag("columns").over(inside))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    first = tail.select(F.col("account_id").alias("_a"), F.col("_block").alias("_b"), "_before")
    steps = steps.join(first, same("account_id", "_a") & same("_block", "_b"), "left").withColumn("_prev", F.coalesce("_prev", "_before")).drop("_before", "_a", "_b")

    # An all-empty column keeps its former kind.
    kinds = heads.select("account_id", "_block", *order, F.explode("columns").alias("c")).select("account_id", "_block", *order, F.col("c.field").alias("field"), F.col("c.kind").alias("kind"))
    in_block = Window.partitionBy("account_id", "field", "_block").orderBy(*order)
    kept = kinds.withColumn("_k", F.last("kind", True).over(in_block.rowsBetween(Window.unboundedPreceding, -1)))
    ends = kinds.groupBy("account_id", "field", "_block").agg(F.max_by("kind", F.when(F.col("kind").isNotNull(), F.struct(*order))).alias("_e"))
    ends = ends.withColumn("_e", F.last("_e", True).over(Window.partitionBy("account_id", "field").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)))
    ends = ends.select(F.col("account_id").alias("_a"), F.col("field").alias("_f"), F.col("_block").alias("_b"), "_e")
    kept = kept.join(ends, same("account_id", "_a") & (F.col("field") == F.col("_f")) & same("_block", "_b"), "left").withColumn("former", F.coalesce("_k", "_e"))
    former = kept.groupBy(F.col("file_id").alias("_id")).agg(F.map_from_entries(F.collect_list(F.struct("field", "former"))).alias("_former"))
    steps = steps.where(F.col("_prev").isNotNull()).join(former, F.col("file_id").eqNullSafe(F.col("_id")))

    has = lambda cols, c: F.exists(cols, lambda o: o["field"] == c["field"])
    gone = F.filter("_prev", lambda c: ~has("columns", c))
    new = F.filter("columns", lambda c: ~has("_prev", c))
    steps = steps.withColumns({"_gone": gone, "_new": new})
    unsure = lambda a, b: (a["field"].startswith("?") | b["field"].startswith("?")) & a["kind"].eqNullSafe(b["kind"])
    place = lambda c, others: F.exists(others, lambda o: unsure(c, o) & (o["pos"] == c["pos"]))
    rest = lambda cols, others: F.filter(cols, lambda c: ~place(c, F.col(others)))
    steps = steps.withColumns({"_gone_rest": rest("_gone", "_new"), "_new_rest": rest("_new", "_gone")})
    alone = (F.size("_gone_rest") == 1) & (F.size("_new_rest") == 1) & F.coalesce(unsure(F.get("_gone_rest", F.lit(0)), F.get("_new_rest", F.lit(0))), F.lit(False))
    steps = steps.withColumn("_moved", alone)
    change = lambda kind, cols: F.transform(cols, lambda c: F.struct(F.lit(kind).alias("change_kind"), c["label"].alias("column_label")))
    match = lambda c: F.get(F.filter("_prev", lambda o: o["field"] == c["field"]), F.lit(0))
    stay = F.filter("columns", lambda c: has("_prev", c))
    relabelled = F.concat(F.filter(stay, lambda c: match(c)["label"] != c["label"]), F.filter("_new", lambda c: place(c, F.col("_gone"))), F.when(F.col("_moved"), F.col("_new_rest")).otherwise(F.slice("_new_rest", 1, 0)))
    retyped = F.filter(stay, lambda c: c["kind"] != F.col("_former")[c["field"]])
    added, removed = (F.when(F.col("_moved"), F.slice(c, 1, 0)).otherwise(F.col(c)) for c in ("_new_rest", "_gone_rest"))
    every = F.concat(change("added", added), change("removed", removed), change("renamed", relabelled), change("retyped", retyped))
    return steps.select("file_id", F.explode(every).alias("x")).select("file_id", "x.change_kind", "x.column_label")
