"""Reconciliation of payment-app rows with bank rows, and transfers between own accounts.

Rows have by columns (books), id, ts, amount_paise, direction, reference (and source_raw). Input order is (ts, id).

Greedy tiers are exact and local: a pair needs one key (book, amount, direction) and lies within the
window, so a key's rows are cut where the time between neighbours exceeds the window, and each piece is
an island of its own. Islands are hashed to tasks, and a task streams them in order of time, holding no more
than the rows of one window.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import cal
from ledgerloom.functions.text import match_tokens, merchant_key, merge_tokens
from ledgerloom.session import stored

WINDOW_DAYS = 2
DAY_US = 86_400_000_000
BY = ("book_id",)


def _has(ref: Column) -> Column:
    return F.coalesce(ref, F.lit("")) != ""


def tier1(app: DataFrame, bank: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """app_id, bank_id, tier: equal reference and direction; the first row of either side takes the first of the other.

    Only the first bank row of a key is ever eligible and only one app row can take it, so two aggregates and an
    equi-join give what the ordered loop gives.
    """
    key = [*by, "reference", "direction"]
    first = lambda df, name: df.where(_has(F.col("reference"))).groupBy(*key).agg(F.min_by("id", F.struct("ts", "id")).alias(name))
    return first(app, "app_id").join(first(bank, "bank_id"), key).select(*by, "app_id", "bank_id", F.lit("reference").alias("tier"))


def _islands(rows: DataFrame, key: Sequence[str], window_us: int) -> DataFrame:
    """``rows`` with us and island: a new island begins where a key's next row is later than the window."""
    rows = rows.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    order = Window.partitionBy(*key).orderBy("us")
    gap = F.col("us") - F.lag("us").over(order)
    return rows.withColumn("_new", F.when(gap > window_us, 1).otherwise(0)).withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def _greedy(batches: Iterator[pd.DataFrame], window_us: int, transfers: bool) -> Iterator[pd.DataFrame]:
    """Rows come sorted by island and time. Each left row takes the nearest free right row within the window."""
    lefts: list = []
    rights: list = []
    key, out = None, []

    def settle(until: int | None) -> None:
        """Left rows whose window is complete take their partner."""
        while lefts and (until is None or lefts[0][0] + window_us < until):
            us, _, lid, source = lefts.pop(0)
            while rights and rights[0][0] < us - window_us:
                rights.pop(0)
            best = None
            for i, (rus, rid, rsource) in enumerate(rights):
                if rus > us + window_us:
                    break
                if transfers and rsource == source:
                    continue
                rank = (abs(rus - us), rus, rid)
                if best is None or rank < best[0]:
                    best = (rank, i)
            if best:
                out.append((lid, rights.pop(best[1])[1]))

    for pdf in batches:
        for row in pdf[["k", "us", "side", "id", "source"]].itertuples(index=False, name=None):
            if row[0] != key:
                settle(None)
                lefts.clear(), rights.clear()
                key = row[0]
            settle(row[1])
            if row[2] == 0:
                lefts.append((row[1], 0, row[3], row[4]))
            else:
                rights.append((row[1], row[3], row[4]))
        yield pd.DataFrame(out, columns=["left_id", "right_id"])
        out.clear()
    settle(None)
    yield pd.DataFrame(out, columns=["left_id", "right_id"])


def _greedy_pairs(left: DataFrame, right: DataFrame, key: Sequence[str], window_days: int, transfers: bool) -> DataFrame:
    window_us = window_days * DAY_US
    source = (lambda df: F.col("source_raw")) if transfers else (lambda df: F.lit(""))
    side = lambda df, n: df.where("ts is not null and amount_paise is not null").select(*key, "id", "ts", F.lit(n).alias("side"), source(df).alias("source"))
    rows = _islands(side(left, 0).unionByName(side(right, 1)), key, window_us)
    # an island of one side has no pair
    rows = rows.withColumn("k", F.md5(F.to_json(F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(key)), "island"))))
    both = rows.groupBy("k").agg(F.min("side").alias("lo"), F.max("side").alias("hi")).where("lo < hi").select("k")
    rows = rows.join(both, "k", "left_semi")
    kind = dict(left.dtypes)["id"]
    sorted_rows = rows.select("k", "us", "side", "id", "source").repartition("k").sortWithinPartitions("k", "us", "side", "id")
    return sorted_rows.mapInPandas(lambda it: _greedy(it, window_us, transfers), f"left_id {kind}, right_id {kind}")


def tier2(app: DataFrame, bank: DataFrame, window_days: int = WINDOW_DAYS, by: Sequence[str] = BY) -> DataFrame:
    """app_id, bank_id, tier: equal amount and direction within the window; app rows in order of time take the nearest free bank row."""
    pairs = _greedy_pairs(app, bank, [*by, "amount_paise", "direction"], window_days, False)
    return pairs.select(F.col("left_id").alias("app_id"), F.col("right_id").alias("bank_id"), F.lit("amountDate").alias("tier"))


def reconcile(app: DataFrame, bank: DataFrame, window_days: int = WINDOW_DAYS, by: Sequence[str] = BY) -> DataFrame:
    """Both tiers; what tier 1 took is not offered to tier 2."""
    one = tier1(app, bank, by).select("app_id", "bank_id", "tier")
    rest = lambda df, side: df.join(one.select(F.col(side).alias("id")), "id", "left_anti")
    return one.unionByName(tier2(rest(app, "app_id"), rest(bank, "bank_id"), window_days, by))


def unmatched(app: DataFrame, bank: DataFrame, matches: DataFrame) -> DataFrame:
    """side, id of rows without a match."""
    rest = lambda df, side, name: df.join(matches.select(F.col(side).alias("id")), "id", "left_anti").select(F.lit(name).alias("side"), "id")
    return rest(app, "app_id", "app").unionByName(rest(bank, "bank_id", "bank"))


def self_transfers(bank: DataFrame, window_days: int = WINDOW_DAYS, by: Sequence[str] = BY) -> DataFrame:
    """debit_id, credit_id: a debit and an equal credit of another source within the window, nearest first."""
    pairs = _greedy_pairs(bank.where("direction = 'debit'"), bank.where("direction = 'credit'"), [*by, "amount_paise"], window_days, True)
    return pairs.select(F.col("left_id").alias("debit_id"), F.col("right_id").alias("credit_id"))


def alert_self_transfers(alerts: DataFrame, flagged: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Ids of alert rows whose reference and amount occur in both directions, or whose reference a flagged bank row has."""
    key = [*by, "reference", "amount_paise"]
    two = alerts.groupBy(*key).agg(F.count_distinct("direction").alias("_d")).where("_d = 2").select(*key)
    own = alerts.where(_has(F.col("reference")))
    return own.join(two, key, "left_semi").select("id").union(own.join(flagged.select(*by, "reference").distinct(), [*by, "reference"], "left_semi").select("id")).distinct()


def recompute_months(app: DataFrame, bank: DataFrame, months: Sequence[int], window_days: int = WINDOW_DAYS, by: Sequence[str] = BY) -> DataFrame:
    """Matches of each month in order: app rows of the month, bank rows of it and its neighbours that no earlier month took.

    One job for each month over all books; results are written, so the plan stays flat.
    """
    m = cal.month_index(F.col("ts"))
    done = None
    for month in sorted(months):
        near = bank.where(m.between(month - 1, month + 1))
        if done is not None:
            near = near.join(done.select(F.col("bank_id").alias("id")), "id", "left_anti")
        found = reconcile(app.where(m == month), near, window_days, by).withColumn("month", cal.month_of_index(F.lit(month)))
        done = stored(found if done is None else done.unionByName(found), "matches")
    return done


# captured memos and statement rows


def _day_gap(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(cal.day(a), cal.day(b)))


def memo_candidates(memos: DataFrame, rows: DataFrame, window_days: int = 3, by: Sequence[str] = BY) -> DataFrame:
    """id, row_id, gap of memos and rows that may be one payment. Memos have payee and vpa; rows have narration."""
    m = memos.select(*by, F.col("id").alias("memo_id"), "amount_paise", "direction", F.col("ts").alias("m_ts"), merge_tokens(F.col("vpa")).alias("v"), F.split(merchant_key(F.col("payee")), " ").alias("p"), F.lower("vpa").alias("vpa"))
    r = rows.select(*by, F.col("id").alias("row_id"), "amount_paise", "direction", F.col("ts").alias("r_ts"), merge_tokens(F.col("narration")).alias("t"))
    # the day window is part of the equi-join: a row enters the blocks of days around it
    block = lambda ts: F.floor(F.datediff(cal.day(ts), F.lit("1970-01-01").cast("date")) / (window_days + 1)).cast("int")
    m = m.withColumn("b", block(F.col("m_ts")))
    r = r.withColumn("b", F.explode(F.array(block(F.col("r_ts")) - 1, block(F.col("r_ts")), block(F.col("r_ts")) + 1)))
    pairs = m.join(r, [*by, "amount_paise", "direction", "b"]).withColumn("gap", _day_gap(F.col("m_ts"), F.col("r_ts"))).where(F.col("gap") <= window_days)
    by_vpa = F.col("vpa").isNotNull() & (F.size("v") > 0) & (F.size(F.array_except("v", "t")) == 0)
    first = F.get("p", F.lit(0))
    handle = F.regexp_extract(F.coalesce("vpa", F.lit("")), "@([^@]*)$", 1)
    by_name = (first != "") & ~(F.col("vpa").isNotNull() & (first == handle)) & F.array_contains("t", first)
    return pairs.where(by_vpa | by_name).select(*by, "amount_paise", "direction", "memo_id", "row_id", "gap")


def merge_memos(candidates: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """memo_id, row_id: pairs in order of (gap, memo, row), each side once.

    A pair is certain once it is the first of both its sides among the pairs that are left, so rounds of
    mutual-first pairs give the same result as the loop over all pairs; each round is one shuffle by side.
    """
    left = stored(candidates.select("memo_id", "row_id", "gap").distinct(), "memo-pairs")
    done = None
    while True:
        rank = F.struct("gap", "memo_id", "row_id")
        best_memo = left.groupBy("memo_id").agg(F.min(rank).alias("x")).select("x.*")
        best_row = left.groupBy("row_id").agg(F.min(rank).alias("x")).select("x.*")
        sure = stored(best_memo.join(best_row, ["gap", "memo_id", "row_id"]), "memo-merges")
        done = sure if done is None else done.unionByName(sure)
        left = stored(left.join(sure.select("memo_id"), "memo_id", "left_anti").join(sure.select("row_id"), "row_id", "left_anti"), "memo-pairs")
        if left.isEmpty():
            return done.select("memo_id", "row_id", "gap")


def judge(pairs: DataFrame, window_days: int = 3) -> DataFrame:
    """``pairs`` (columns a_… and b_… for id, amount_paise, direction, ts, account_tail, vpa, payee, narration, reference) with verdict.

    none, suggested or merge. References decide where both have one; then amount, direction and days must agree, and an
    account tail or the counterparty makes a merge of a suggestion.
    """
    ref = lambda s: F.lower(F.btrim(F.coalesce(f"{s}_reference", F.lit(""))))
    words = lambda s: match_tokens(F.concat_ws(" ", F.coalesce(f"{s}_payee", F.lit("")), F.coalesce(f"{s}_vpa", F.lit("")), F.coalesce(f"{s}_narration", F.lit(""))))
    digits = lambda s: F.get(F.reverse(F.regexp_extract_all(F.coalesce(f"{s}_account_tail", F.lit("")), F.lit(r"(\d+)"), F.lit(1))), F.lit(0))
    df = pairs.withColumns({"_ra": ref("a"), "_rb": ref("b"), "_wa": words("a"), "_wb": words("b"), "_ta": digits("a"), "_tb": digits("b"), "_va": F.lower("a_vpa"), "_vb": F.lower("b_vpa")})
    both_refs = (F.col("_ra") != "") & (F.col("_rb") != "")
    veto = (F.col("a_amount_paise") != F.col("b_amount_paise")) | F.coalesce(F.col("a_direction") != F.col("b_direction"), F.lit(False)) | (_day_gap(F.col("a_ts"), F.col("b_ts")) > window_days)
    both_tails = F.col("_ta").isNotNull() & F.col("_tb").isNotNull()
    tails_agree = F.col("_ta").endswith(F.col("_tb")) | F.col("_tb").endswith(F.col("_ta"))
    in_text = lambda tail, w: F.exists(w, lambda t: t.endswith(F.col(tail)) & (F.length(t) <= F.length(tail) + 4))
    one_tail = (F.col("_ta").isNotNull() & F.col("_tb").isNull() & in_text("_ta", "_wb")) | (F.col("_tb").isNotNull() & F.col("_ta").isNull() & in_text("_tb", "_wa"))
    vpa_in = lambda v, w: F.col(v).isNotNull() & (F.size(match_tokens(F.col(v))) > 0) & (F.size(F.array_except(match_tokens(F.col(v)), F.col(w))) == 0)
    first = lambda s: F.split_part(merchant_key(F.col(f"{s}_payee")), F.lit(" "), F.lit(1))
    name_in = lambda s, w: (F.length(first(s)) >= 3) & F.array_contains(w, first(s))
    party = F.when(F.col("_va").isNotNull() & F.col("_vb").isNotNull(), F.col("_va") == F.col("_vb")).otherwise(vpa_in("_va", "_wb") | vpa_in("_vb", "_wa") | name_in("a", "_wb") | name_in("b", "_wa"))
    strong = (both_tails & tails_agree) | F.coalesce(one_tail, F.lit(False)) | F.coalesce(party, F.lit(False))
    verdict = F.when(both_refs, F.when(F.col("_ra") == F.col("_rb"), "merge").otherwise("none")).when(veto | (both_tails & ~tails_agree), "none").when(strong, "merge").otherwise("suggested")
    return df.withColumn("verdict", verdict).drop("_ra", "_rb", "_wa", "_wb", "_ta", "_tb", "_va", "_vb")


def judged_candidates(detections: DataFrame, rows: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Pairs that may be one payment with their verdict, found by equal reference or by equal amount near in time."""
    cols = ("id", "amount_paise", "direction", "ts", "account_tail", "vpa", "payee", "narration", "reference")
    a = detections.select(*by, *(F.col(c).alias(f"a_{c}") for c in cols))
    b = rows.select(*(F.col(c).alias(f"_{c}") for c in by), *(F.col(c).alias(f"b_{c}") for c in cols))
    ref = lambda c: F.nullif(F.lower(F.btrim(c)), F.lit(""))
    same = lambda df, other: [F.col(c) == F.col(f"_{c}") for c in by]
    block = lambda c: F.floor(F.datediff(cal.day(c), F.lit("1970-01-01").cast("date")) / 4).cast("int")
    by_ref = a.join(b, [*same(a, b), ref(F.col("a_reference")) == ref(F.col("b_reference"))])
    near = b.withColumn("_k", F.explode(F.array(block(F.col("b_ts")) - 1, block(F.col("b_ts")), block(F.col("b_ts")) + 1)))
    by_amount = a.join(near, [*same(a, near), F.col("a_amount_paise") == F.col("b_amount_paise"), block(F.col("a_ts")) == F.col("_k")]).drop("_k")
    # a pair with two equal references is in the first branch already
    by_amount = by_amount.where(~F.coalesce(ref(F.col("a_reference")) == ref(F.col("b_reference")), F.lit(False)))
    return judge(by_ref.unionByName(by_amount)).where((F.col("verdict") != "none") & (F.col("a_id") != F.col("b_id"))).drop(*(f"_{c}" for c in by))


def pair_detections(candidates: DataFrame) -> DataFrame:
    """a_id, b_id: merges by minutes between them; a detection with two equally near free rows gets none.

    Rounds: a detection is settled once none of its nearest rows is the first wish of an earlier pair; with one nearest
    row it takes it, with several it is given up. Each round shuffles by side, and settled rows leave the table.
    """
    minutes = F.floor(F.abs(cal.seconds_between(F.col("a_ts"), F.col("b_ts"))) / 60)
    left = stored(candidates.where("verdict = 'merge'").select("a_id", "b_id", minutes.alias("gap")).distinct(), "pairs")
    done = None
    while True:
        rank = F.struct("gap", "a_id", "b_id")
        wa = left.groupBy("a_id").agg(F.min(rank).alias("first"))
        wb = left.groupBy("b_id").agg(F.min(rank).alias("b_first"))
        near = left.join(wa, "a_id").where(F.col("gap") == F.col("first.gap")).join(wb, "b_id")
        # undecided while a tied row may still go to an earlier pair
        ties = near.groupBy("a_id").agg(F.count("*").alias("n"), F.max("first").alias("first"), F.bool_or(F.col("b_first") < F.col("first")).alias("open"))
        firsts = ties.where("not open").select("first.*", "n")
        step = stored(firsts.select("a_id", "b_id", "gap", (F.col("n") == 1).alias("sure")), "settled")
        sure = step.where("sure").select("a_id", "b_id", "gap")
        done = sure if done is None else done.unionByName(sure)
        left = stored(left.join(step.select("a_id"), "a_id", "left_anti").join(sure.select("b_id"), "b_id", "left_anti"), "pairs")
        if left.isEmpty():
            return done


def link_candidates(detections: DataFrame, rows: DataFrame, k: int = 30, by: Sequence[str] = BY) -> DataFrame:
    """The k nearest rows in time of the same direction for each detection; on equal gaps equal amounts come first, then smaller ids.

    On each side of a detection the k nearest rows by (gap, id) are taken, and the k nearest of its own amount; the first k of all these are
    the first k of all rows, whatever their ties.
    """
    d = detections.select(*by, "direction", F.col("id").alias("a_id"), F.col("ts").alias("a_ts"), F.col("amount_paise").alias("a_amount"))
    r = rows.select(*by, "direction", F.col("id").alias("b_id"), F.col("ts").alias("b_ts"), F.col("amount_paise").alias("b_amount"))

    def around(key: list[str]) -> DataFrame:
        """Places of the rows of a key in order of time, of smaller ids first and last, and the detections' places among them."""
        own, other = d.withColumn("amount", F.col("a_amount")), r.withColumn("amount", F.col("b_amount"))
        order = Window.partitionBy(*key)
        ranked = other.withColumn("up", F.row_number().over(order.orderBy("b_ts", "b_id"))).withColumn("down", F.row_number().over(order.orderBy("b_ts", F.col("b_id").desc())))
        mixed = own.select(*key, F.col("a_ts").alias("t"), F.col("a_id").alias("id"), F.lit(0).alias("row")).unionByName(other.select(*key, F.col("b_ts").alias("t"), F.col("b_id").alias("id"), F.lit(1).alias("row")))
        at = F.sum("row").over(order.orderBy("t", "row").rowsBetween(Window.unboundedPreceding, 0))
        place = mixed.withColumn("at", at).where("row = 0").select(F.col("id").alias("a_id"), *key, "at").distinct()
        placed = own.join(place, ["a_id", *key])
        later = placed.withColumn("up", F.explode(F.sequence(F.col("at") + 1, F.col("at") + k))).drop("at").join(ranked.drop("down"), [*key, "up"]).drop("up")
        sooner = placed.withColumn("down", F.explode(F.sequence(F.col("at") - k + 1, F.col("at")))).drop("at").join(ranked.drop("up"), [*key, "down"]).drop("down")
        cols = [*by, "a_id", "a_ts", "a_amount", "b_id", "b_ts", "b_amount"]
        return later.select(*cols).unionByName(sooner.select(*cols))

    near = around([*by, "direction"]).unionByName(around([*by, "direction", "amount"])).distinct()
    gap = F.abs(cal.seconds_between(F.col("a_ts"), F.col("b_ts")))
    best = F.row_number().over(Window.partitionBy("a_id").orderBy(gap, F.when(F.col("a_amount") == F.col("b_amount"), 0).otherwise(1), "b_id"))
    return near.withColumn("rank", best).where(F.col("rank") <= k).select(*by, "a_id", "b_id", "rank")


def union_of(pairs: DataFrame) -> DataFrame:
    """One row of each judged pair: the statement's row fills first (``b_is_row`` over ``a_is_row``), the other side fills the gaps."""
    swap = F.col("b_is_row") & ~F.col("a_is_row")
    pick = lambda c, blank=False: F.when(swap, _fill(f"b_{c}", f"a_{c}", blank)).otherwise(_fill(f"a_{c}", f"b_{c}", blank)).alias(c)
    plain = lambda c: F.when(swap, F.col(f"b_{c}")).otherwise(F.col(f"a_{c}")).alias(c)
    return pairs.select(F.col("a_id").alias("id"), plain("amount_paise"), pick("direction"), plain("ts"), pick("account_tail"), pick("vpa"), pick("payee", True), pick("narration", True), pick("reference"), (F.col("a_is_row") | F.col("b_is_row")).alias("is_row"))


def _fill(first: str, second: str, blank: bool) -> Column:
    return F.coalesce(F.nullif(F.col(first), F.lit("")), F.col(second)) if blank else F.coalesce(first, second)
