"""Statement tables proved against their own running balance.

A table row has doc_id, row_ix and cells (array of strings). A mapping names the columns by place: date_col, narration_col,
reference_col, debit_col, credit_col, amount_col, side_col, balance_col, unsigned, date_format, reference_patterns.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import cal, dates
from ledgerloom.functions.ident import synthetic_reference
from ledgerloom.functions.money import signed_paise
from ledgerloom.functions.text import bank_name, shape_mask
from ledgerloom.session import here

#: Words of a header row.
HEADER_WORDS = "(?i)date|narration|particular|description|remarks|debit|credit|withdraw|deposit|amount|balance|ref|cheque"
MAPPING = "date_col int, narration_col int, reference_col int, debit_col int, credit_col int, amount_col int, side_col int, balance_col int, unsigned boolean, date_format string, reference_patterns array<string>"


def header_index(table: DataFrame) -> DataFrame:
    """doc_id, header_ix: the first row with two header words and no date; null if there is none."""
    words = F.size(F.filter("cells", lambda c: c.rlike(HEADER_WORDS)))
    dated = F.exists("cells", lambda c: (c != "") & dates.first_format(F.array(c)).isNotNull())
    return table.groupBy("doc_id").agg(F.min(F.when((words >= 2) & ~F.coalesce(dated, F.lit(False)), F.col("row_ix"))).alias("header_ix"))


def body_rows(table: DataFrame) -> DataFrame:
    """Rows below the header with three filled cells at least."""
    below = table.join(header_index(table), "doc_id").where(F.col("header_ix").isNull() | (F.col("row_ix") > F.col("header_ix")))
    return below.where(F.size(F.filter("cells", lambda c: c != "")) >= 3).drop("header_ix")


def date_format_vote(table: DataFrame) -> DataFrame:
    """doc_id, col, date_format: the first format that parses every filled cell of a column; null if none does.

    Each format is counted in one aggregate; the cells of a column never meet in one array.
    """
    cells = table.select("doc_id", F.posexplode("cells").alias("col", "c")).where("c <> ''")
    fits = cells.groupBy("doc_id", "col").agg(*(F.bool_and(dates.statement_day(F.col("c"), fmt).isNotNull()).alias(f"f{i}") for i, fmt in enumerate(dates.FORMATS)))
    pick = F.when(F.lit(False), F.lit(None).cast("string"))
    for i, fmt in enumerate(dates.FORMATS):
        pick = pick.when(F.col(f"f{i}"), fmt)
    return fits.select("doc_id", "col", pick.alias("date_format"))


def fingerprint(table: DataFrame) -> DataFrame:
    """doc_id, header_row, column_count, row_count, cell_shapes (the most frequent mask of each column, ties to the first seen), bank_name."""
    head = header_index(table)
    rows = table.join(head, "doc_id").withColumn("is_body", F.col("header_ix").isNull() | (F.col("row_ix") > F.col("header_ix")))
    shape = rows.groupBy("doc_id").agg(
        F.max(F.when(F.col("row_ix") == F.col("header_ix"), F.col("cells"))).alias("header_row"), F.max(F.when(F.col("is_body") | (F.col("row_ix") == F.col("header_ix")), F.size("cells")).otherwise(0)).alias("column_count"), F.count_if("is_body").alias("row_count"),
    )
    # what a bank is called stands above the body; one row for each document, so the text is short
    above = rows.where(~F.col("is_body") | (F.col("header_ix").isNotNull() & (F.col("row_ix") <= F.col("header_ix")))).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("row_ix", F.array_join("cells", " ").alias("t")))).alias("t"))
    above = above.select("doc_id", bank_name(F.array_join(F.transform("t", lambda x: x["t"]), " ")).alias("bank_name"))
    cells = rows.where("is_body").select("doc_id", "row_ix", F.posexplode("cells").alias("col", "c")).where("c <> ''")
    masks = cells.groupBy("doc_id", "col", shape_mask(F.col("c")).alias("mask")).agg(F.count("*").alias("n"), F.min("row_ix").alias("seen"))
    top = masks.groupBy("doc_id", "col").agg(F.min_by("mask", F.struct(-F.col("n"), F.col("seen"))).alias("mask"))
    by_col = top.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("col", "mask"))).alias("m"))
    out = shape.join(by_col, "doc_id", "left").join(above, "doc_id", "left")
    every = F.when(F.col("column_count") > 0, F.sequence(F.lit(0), F.col("column_count") - 1)).otherwise(F.array().cast("array<int>"))
    shapes = F.transform(every, lambda i: F.coalesce(F.col("m")[i], F.lit("")))
    return out.select("doc_id", F.coalesce("header_row", F.array().cast("array<string>")).alias("header_row"), "column_count", "row_count", shapes.alias("cell_shapes"), "bank_name")


def _cell(col: str) -> Column:
    return F.coalesce(F.get("cells", F.col(col)), F.lit(""))


def _day(text: Column, fmt: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("date"))
    for f in dates.FORMATS:
        out = out.when(fmt == f, dates.statement_day(text, f))
    return out


def balance_chain(rows: DataFrame, key: Sequence[str] = ("doc_id",), opening: Column | None = None) -> DataFrame:
    """Each row read through its mapping and proved: key, row_ix, day, amount_paise, direction, balance_paise, reference, narration, problem.

    ``rows`` has key, row_ix, cells and the mapping's columns. With a previous balance, the amount taken off or added must give
    the balance and the columns must say the same; the first row goes by its columns (an unsigned one as debit).
    problem is null for a proven row.
    """
    by = list(key)
    debit, credit, amount = _cell("debit_col"), _cell("credit_col"), _cell("amount_col")
    two = F.col("debit_col").isNotNull() & F.col("credit_col").isNotNull()
    side = F.lower(_cell("side_col"))
    value = F.when(two, F.when((debit != "") & (credit == ""), signed_paise(debit)).when((debit == "") & (credit != ""), signed_paise(credit))).otherwise(F.when(F.col("amount_col").isNotNull(), F.abs(signed_paise(amount))))
    says = F.when(two, F.when(debit != "", "debit").otherwise("credit")).when(F.col("side_col").isNotNull(), F.when(side == "dr", "debit").when(side == "cr", "credit")).when(F.col("unsigned"), F.lit(None)).otherwise(F.when(signed_paise(amount) < 0, "debit").otherwise("credit"))
    x = rows.withColumns({"day": _day(_cell("date_col"), F.col("date_format")), "balance_paise": signed_paise(_cell("balance_col")), "amount_paise": value, "_says": says})
    prior = F.lag("balance_paise").over(Window.partitionBy(*by).orderBy("row_ix"))
    first = F.row_number().over(Window.partitionBy(*by).orderBy("row_ix")) == 1
    x = x.withColumns({"_prev": prior if opening is None else F.when(first, opening).otherwise(prior), "_first": first})
    chained = F.when(F.col("_prev") - F.col("amount_paise") == F.col("balance_paise"), "debit").when(F.col("_prev") + F.col("amount_paise") == F.col("balance_paise"), "credit")
    problem = (
        F.when(F.col("day").isNull(), "date").when(F.col("balance_paise").isNull(), "balance").when(F.col("amount_paise").isNull(), "amount").when(F.col("side_col").isNotNull() & F.col("_says").isNull() & ~two, "side")
        .when(F.col("amount_paise") <= 0, "not positive").when(F.col("_prev").isNotNull() & chained.isNull(), "chain").when(F.col("_prev").isNotNull() & F.col("_says").isNotNull() & (F.col("_says") != chained), "direction")
    )
    start = F.coalesce("_opening", F.lit("debit")) if "_opening" in rows.columns else F.lit("debit")
    direction = F.when(F.col("_prev").isNotNull(), chained).otherwise(F.coalesce("_says", start))
    narration = _cell("narration_col")
    written = F.nullif(_cell("reference_col"), F.lit(""))
    if "reference_patterns" in rows.columns:
        found = F.expr("filter(transform(reference_patterns, p -> trim(regexp_extract(coalesce(get(cells, narration_col), ''), p, 1))), x -> x <> '')")
        written = F.coalesce(written, F.get(found, F.lit(0)))
    made = synthetic_reference(F.col("balance_paise"), cal.utc(F.col("day").cast("timestamp_ntz")), F.col("amount_paise"))
    out = x.withColumns({"direction": direction, "narration": narration, "problem": problem, "reference": F.coalesce(written, made)})
    return out.select(*by, "row_ix", "day", "amount_paise", "direction", "balance_paise", "reference", "narration", "problem")


def chain_outcome(chain: DataFrame, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """key, n_rows, broken_at and why: the first broken row; null for a proven table."""
    return chain.groupBy(*key).agg(F.count("*").alias("n_rows"), F.min(F.when(F.col("problem").isNotNull(), F.struct("row_ix", "problem"))).alias("b")).select(*key, "n_rows", F.col("b.row_ix").alias("broken_at"), F.col("b.problem").alias("why"))


def column_profile(body: DataFrame) -> DataFrame:
    """doc_id, col, kind (date, number, side, text or empty), full (no empty cell), avg_len, date_format."""
    n = body.groupBy("doc_id").agg(F.count("*").alias("rows"), F.max(F.size("cells")).alias("width"))
    cells = body.select("doc_id", F.posexplode("cells").alias("col", "c")).where("c <> ''")
    votes = date_format_vote(body)
    agg = cells.groupBy("doc_id", "col").agg(F.count("*").alias("n"), F.bool_and(signed_paise(F.col("c")).isNotNull()).alias("num"), F.bool_and(F.lower("c").isin("dr", "cr")).alias("side"), F.floor(F.avg(F.length("c"))).cast("int").alias("avg_len"))
    x = agg.join(votes, ["doc_id", "col"], "left").join(n, "doc_id")
    kind = F.when(F.col("date_format").isNotNull(), "date").when(F.col("num"), "number").when(F.col("side"), "side").otherwise("text")
    return x.select("doc_id", "col", kind.alias("kind"), (F.col("n") == F.col("rows")).alias("full"), "avg_len", "date_format")


def candidate_mappings(profile: DataFrame) -> DataFrame:
    """doc_id, mapping_ix and the mapping columns: every reading of a table's columns as debit and credit, signed amount, or amount and side.

    The number of readings is bounded by the table's width, not by its rows.
    """
    pick = lambda kind, what: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, what)))
    p = profile.groupBy("doc_id").agg(
        F.min(F.when(F.col("kind") == "date", F.struct("col", "date_format"))).alias("date"), F.min(F.when(F.col("kind") == "text", F.struct(-F.col("avg_len"), F.col("col")))).alias("nar"), pick("text", F.struct("avg_len", "col")).alias("texts"),
        pick("number", F.col("col")).alias("nums"), pick("number", F.when(F.col("full"), F.col("col"))).alias("fulls"), pick("side", F.col("col")).alias("sides"),
    ).where("date is not null and nar is not null")
    nar = F.col("nar.col")
    ref = F.get(F.filter("texts", lambda t: t["col"] != nar), F.lit(0))["col"]
    null = F.lit(None).cast("int")
    shape = lambda d, c, a, s, b: F.struct(d.alias("debit_col"), c.alias("credit_col"), a.alias("amount_col"), s.alias("side_col"), b.alias("balance_col"))
    two = F.flatten(F.transform("fulls", lambda b: F.flatten(F.transform(F.filter("nums", lambda x: x != b), lambda d: F.transform(F.filter("nums", lambda x: (x != b) & (x != d)), lambda c: shape(d, c, null, null, b))))))
    one = F.flatten(F.transform("fulls", lambda b: F.transform(F.filter("fulls", lambda x: x != b), lambda a: shape(null, null, a, null, b))))
    sided = F.flatten(F.transform("fulls", lambda b: F.flatten(F.transform(F.filter("fulls", lambda x: x != b), lambda a: F.transform("sides", lambda s: shape(null, null, a, s, b))))))
    out = p.select("doc_id", F.col("date.col").alias("date_col"), F.col("date.date_format").alias("date_format"), nar.alias("narration_col"), ref.alias("reference_col"), F.posexplode(F.concat(two, one, sided)).alias("mapping_ix", "m"))
    return out.select("doc_id", "mapping_ix", "date_col", "narration_col", "reference_col", "m.*", F.lit(False).alias("unsigned"), "date_format", F.array().cast("array<string>").alias("reference_patterns"))


def infer_columns(table: DataFrame) -> DataFrame:
    """doc_id, mapping_ix and the mapping of tables with exactly one reading that the balance proves. Ambiguous or unproven tables are absent."""
    body = body_rows(table)
    few = body.groupBy("doc_id").agg(F.count("*").alias("n")).where("n >= 2").select("doc_id")
    body = body.join(few, "doc_id", "left_semi")
    maps = candidate_mappings(column_profile(body))
    chain = balance_chain(body.join(maps, "doc_id"), ("doc_id", "mapping_ix"))
    reading = chain.groupBy("doc_id", "mapping_ix").agg(
        F.bool_and(F.col("problem").isNull()).alias("ok"), F.sum(F.xxhash64("row_ix", "day", "amount_paise", "direction", "reference", "narration").cast("decimal(38,0)")).alias("digest"), F.count("*").alias("n")
    )
    proven = reading.where("ok").groupBy("doc_id").agg(F.count_distinct("digest").alias("readings"), F.min("mapping_ix").alias("mapping_ix")).where("readings = 1").select("doc_id", "mapping_ix")
    return maps.join(proven, ["doc_id", "mapping_ix"], "left_semi")


def apply_specs(table: DataFrame, specs: Sequence[dict]) -> DataFrame:
    """doc_id, spec_id and the mapping of the first layout (by id) whose head and formats fit a table.

    A spec has id, detect (patterns of the whole text), header (role → pattern), sign (debitCredit, amountDRCR, signedAmount or
    unsignedChain), furniture (patterns of rows to skip) and date_formats.
    """
    found = None
    needs = {"debitCredit": ("debit", "credit"), "amountDRCR": ("amount", "drcr")}
    whole = table.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_ix", F.array_join("cells", "|").alias("t")))), lambda x: x["t"]), "\n").alias("whole")) if any(s.get("detect") for s in specs) else None
    for spec in sorted(specs, key=lambda s: s["id"]):
        required = ["date", "narration", "balance", *needs.get(spec["sign"], ("amount",))]
        if any(r not in spec["header"] for r in required):
            continue
        rows = table
        if spec.get("detect"):
            fits = F.lit(True)
            for pattern in spec["detect"]:
                fits = fits & F.col("whole").rlike(f"(?i){pattern}")
            rows = rows.join(whole.where(fits).select("doc_id"), "doc_id", "left_semi")
        roles = [*required, *sorted(r for r in spec["header"] if r not in required)]
        # one fold over the roles: each takes the first fitting cell that is free, or -1
        wanted = F.array(*(F.lit(f"(?i){spec['header'][r]}") for r in roles))
        heads = rows.where(F.size("cells") > 0).withColumn("_at", F.aggregate(wanted, F.array().cast("array<int>"), lambda acc, p: F.array_append(acc, F.coalesce(F.get(F.filter(F.sequence(F.lit(0), F.size("cells") - 1), lambda i: F.regexp_like(F.get("cells", i), p) & ~F.array_contains(acc, i)), F.lit(0)), F.lit(-1)))))
        heads = heads.where(here(~F.array_contains(F.slice("_at", 1, len(required)), -1)))
        col = lambda r: F.nullif(F.get("_at", F.lit(roles.index(r))), F.lit(-1)) if r in roles else F.lit(None).cast("int")
        mapping = F.struct(col("date").alias("date_col"), col("narration").alias("narration_col"), col("reference").alias("reference_col"), col("debit").alias("debit_col"), col("credit").alias("credit_col"), col("amount").alias("amount_col"), col("drcr").alias("side_col"), col("balance").alias("balance_col"))
        first = heads.groupBy("doc_id").agg(F.min_by(mapping, "row_ix").alias("m"), F.min("row_ix").alias("header_ix"))
        body = spec_body(table, first.select("doc_id", "header_ix"), spec)
        votes = date_format_vote(body).join(first.select("doc_id", F.col("m.date_col").alias("col")), ["doc_id", "col"])
        allowed = votes.where(F.col("date_format").isin(*spec["date_formats"])).select("doc_id", "date_format")
        one = first.join(allowed, "doc_id").select("doc_id", "header_ix", F.lit(spec["id"]).alias("spec_id"), "m.*", F.lit(spec["sign"] == "unsignedChain").alias("unsigned"), "date_format", F.array(*(F.lit(p) for p in spec.get("reference", []))).cast("array<string>").alias("reference_patterns"))
        found = one if found is None else found.unionByName(one)
    if found is None:
        return table.sparkSession.createDataFrame([], f"doc_id {dict(table.dtypes)['doc_id']}, header_ix int, spec_id string, {MAPPING}")
    first_fit = found.groupBy("doc_id").agg(F.min("spec_id").alias("spec_id"))
    return found.join(first_fit, ["doc_id", "spec_id"], "left_semi")


def spec_body(table: DataFrame, heads: DataFrame, spec: dict) -> DataFrame:
    """Filled rows below the header that are no furniture."""
    rows = table.join(heads, "doc_id").where(F.col("row_ix") > F.col("header_ix")).where(F.exists("cells", lambda c: c != ""))
    for pattern in spec.get("furniture", []):
        rows = rows.where(~F.array_join("cells", "|").rlike(f"(?i){pattern}"))
    return rows.drop("header_ix")


def resolve(table: DataFrame, specs: Sequence[dict]) -> DataFrame:
    """doc_id, outcome (spec, inferred or refused), spec_id and the mapping: layouts first, then inference, then refusal."""
    by_spec = apply_specs(table, specs)
    rest = table.join(by_spec.select("doc_id"), "doc_id", "left_anti")
    inferred = infer_columns(rest)
    maps = by_spec.drop("header_ix").withColumn("outcome", F.lit("spec")).unionByName(inferred.drop("mapping_ix").withColumn("outcome", F.lit("inferred")).withColumn("spec_id", F.lit(None).cast("string")))
    docs = table.select("doc_id").distinct()
    return docs.join(maps, "doc_id", "left").withColumn("outcome", F.coalesce("outcome", F.lit("refused")))


def unsigned_readings(rows: DataFrame) -> DataFrame:
    """doc_id, opening (debit, credit or both), for tables of unsigned amounts without an opening balance: which first direction proves.

    Two proven readings that differ are ambiguous and come out with opening null.
    """
    both = rows.withColumn("_opening", F.explode(F.array(F.lit("debit"), F.lit("credit"))))
    chain = balance_chain(both.withColumn("opening", F.col("_opening")), ("doc_id", "opening"))
    reading = chain.groupBy("doc_id", "opening").agg(F.bool_and(F.col("problem").isNull()).alias("ok"), F.sum(F.xxhash64("row_ix", "amount_paise", "direction").cast("decimal(38,0)")).alias("digest"))
    ok = reading.where("ok").groupBy("doc_id").agg(F.min("opening").alias("opening"), F.count_distinct("digest").alias("n"), F.count("*").alias("k"))
    return ok.select("doc_id", F.when(F.col("n") > 1, None).when(F.col("k") > 1, "both").otherwise(F.col("opening")).alias("opening"))


#: What a header label stands for, in order of precedence, and the kinds a proposer may name.
ROLE_WORDS = (
    ("balance", r"\bbalance\b|\bbal\b"), ("debit", r"withdraw|\bdebit|\bdr\b|paid out"), ("credit", r"deposit|\bcredit|\bcr\b|paid in"), ("date", r"\bdate\b|\bdt\b"), ("narration", "particular|narration|description|details|remark"),
    ("reference", r"cheque|\bchq|\bref|instrument"), ("amount", r"\bamount\b|\bamt\b"),
)
ROLE_KINDS = ("date", "valueDate", "narration", "reference", "debit", "credit", "amount", "drcrMarker", "balance", "other")


def label_role(label: Column) -> Column:
    """The role of a header label; null if it has none."""
    low = F.lower(label)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for role, words in ROLE_WORDS:
        out = out.when(low.rlike(words), role)
    return out


def sample_rows(table: DataFrame, n: int = 8) -> DataFrame:
    """doc_id, row_ix, cells: the first half of ``n`` body rows, then the first row that fills each column those leave empty."""
    body = body_rows(table)
    order = Window.partitionBy("doc_id").orderBy("row_ix")
    ranked = body.withColumn("_n", F.row_number().over(order))
    head = ranked.where(F.col("_n") <= n // 2).select("doc_id", "row_ix", "cells")
    cells = ranked.select("doc_id", "row_ix", "_n", F.posexplode("cells").alias("col", "c")).where("c <> ''")
    first = cells.groupBy("doc_id", "col").agg(F.min("row_ix").alias("row_ix"), F.min("_n").alias("_n")).where(F.col("_n") > n // 2)
    pick = first.select("doc_id", "row_ix").distinct().withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= n - n // 2)
    return head.unionByName(body.join(pick, ["doc_id", "row_ix"], "left_semi").select("doc_id", "row_ix", "cells"))


def mappings_of_kinds(kinds: DataFrame, votes: DataFrame) -> DataFrame:
    """Mappings of proposed kinds (doc_id, kinds: array): the date or the value date, the rightmost sum as balance if none is named.

    A proposal without date, narration or balance is left out. ``votes`` are the columns' date formats.
    """
    place = lambda kind: F.nullif(F.array_position("kinds", kind), F.lit(0)).cast("int") - 1
    sums = F.filter(F.transform("kinds", lambda k, i: F.when(k.isin("debit", "credit", "amount"), i)), lambda i: i.isNotNull())
    x = kinds.withColumns({"date_col": F.coalesce(place("date"), place("valueDate")), "narration_col": place("narration"), "balance_col": F.coalesce(place("balance"), F.get(F.reverse(sums), F.lit(0)))})
    other = lambda kind: F.get(F.filter(F.transform("kinds", lambda k, i: F.when((k == kind) & (i != F.col("balance_col")), i)), lambda i: i.isNotNull()), F.lit(0))
    x = x.withColumns({"reference_col": place("reference"), "debit_col": other("debit"), "credit_col": other("credit"), "amount_col": other("amount"), "side_col": place("drcrMarker")})
    x = x.where("date_col is not null and narration_col is not null and balance_col is not null").join(votes.select("doc_id", F.col("col").alias("date_col"), "date_format"), ["doc_id", "date_col"])
    return x.select("doc_id", "date_col", "narration_col", "reference_col", "debit_col", "credit_col", "amount_col", "side_col", "balance_col", F.lit(False).alias("unsigned"), "date_format", F.array().cast("array<string>").alias("reference_patterns"))


def propose(table: DataFrame, proposer: Callable[[list[list[str]]], list[str] | None]) -> DataFrame:
    """Mappings that a function proposes from sample rows (header first) and that the balance then proves; all others are dropped."""
    head = table.join(header_index(table), "doc_id").where(F.col("row_ix") == F.col("header_ix")).select("doc_id", "row_ix", "cells")
    rows = head.unionByName(sample_rows(table)).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_ix", "cells"))), lambda x: x["cells"]).alias("rows"))

    def ask(s: pd.Series) -> pd.Series:
        return s.map(lambda v: proposer([list(r) for r in v]))

    kinds = rows.select("doc_id", F.pandas_udf(ask, "array<string>")("rows").alias("kinds")).where("kinds is not null")
    body = body_rows(table)
    maps = mappings_of_kinds(kinds, date_format_vote(body))
    proven = chain_outcome(balance_chain(body.join(maps, "doc_id"))).where("broken_at is null").select("doc_id")
    return maps.join(proven, "doc_id", "left_semi")
