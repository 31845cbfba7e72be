import random
import re
from datetime import datetime, timedelta
from itertools import combinations

from ledgerloom.llm import copies

ROW = "uuid string, book_id long, source_raw string, txn_at timestamp_ntz, amount_paise long, direction string, counterparty string, reference string, narration string"


def key(r):
    squeeze = lambda s: "".join(c for c in (s or "").lower() if c.isalnum())
    return (*r[1:6], squeeze(r[6]), squeeze(r[7]), tuple(sorted(re.findall(r"[^\W_]+", (r[8] or "").lower()))))


def make(n, seed):
    rng = random.Random(seed)
    t = datetime(2025, 1, 1)
    return [
        (f"u{i:04}", rng.choice([1, 1, 2, None]), rng.choice(["hdfc", "gpay"]), rng.choice([t, t + timedelta(days=1), None]), rng.choice([100, None]), "debit", rng.choice(["A B", "ab", None, ""]), rng.choice([None, "", "R-1", "r1"]), rng.choice(["UPI/x/y", "y x  upi", None, "x y", "é x", "e x", "x" * 50_000]))
        for i in range(n)
    ]


def test_pairs_and_counts_against_brute_force_over_batches(spark):
    rows = make(300, 1)
    df = spark.createDataFrame(rows, ROW)
    parts = [df.where("uuid < 'u0100'"), df.where("uuid >= 'u0100' and uuid < 'u0200'"), df.where("uuid >= 'u0200'")]
    led = copies.collapse(parts, spark)
    groups = {}
    for r in rows:
        groups.setdefault(key(r), []).append(r)
    assert {tuple(r) for r in copies.copy_pairs(df, led).collect()} == {p for g in groups.values() for p in combinations(sorted(r[0] for r in g), 2)}
    first = {min(g, key=lambda r: (r[3] is None, r[3] or datetime.min, r[0]))[0]: len(g) for g in groups.values()}
    assert {r.first_id: r.copies for r in led.collect()} == first
    got = {r.uuid: (r.class_id, r.copies) for r in copies.copy_classes(df, led).collect()}
    assert len(got) == len(rows) and all(first[c] == n for c, n in got.values())


def test_order_of_batches_does_not_matter_and_empty_ones_change_nothing(spark):
    df = spark.createDataFrame(make(120, 2), ROW)
    a, b = df.where("uuid < 'u0060'"), df.where("uuid >= 'u0060'")
    none = df.limit(0)
    one = sorted(map(tuple, copies.collapse([a, none, b], spark).collect()), key=str)
    two = sorted(map(tuple, copies.collapse([b, a], spark).collect()), key=str)
    assert one == two
    assert copies.copy_pairs(none, copies.collapse([none], spark)).count() == 0


def test_old_versions_stay_and_untouched_buckets_are_not_rewritten(spark):
    df = spark.createDataFrame(make(200, 3), ROW)
    led = copies.CopyLedger(spark, buckets=8).merge(df)
    before, where = sorted(map(tuple, led.read().drop("version").collect()), key=str), dict(led.where)
    led.merge(df.limit(1))
    assert sum(led.where[b] == 2 for b in led.where) == 1 and {b for b in where} == set(led.where)
    old = copies.CopyLedger(spark, led.path, 8, version=1)
    assert sorted(map(tuple, old.read().drop("version").collect()), key=str) == before
    assert led.read().groupBy().sum("copies").first()[0] == 201


def test_a_batch_merged_again_counts_once(spark):
    row = [(1, "s", None, 5, "debit", "A", "r", "x y", "u1"), (1, "s", None, 5, "debit", "a", "R", "y x", "u2")]
    df = spark.createDataFrame(row, "book_id long, source_raw string, txn_at timestamp_ntz, amount_paise long, direction string, counterparty string, reference string, narration string, uuid string")
    ledger = copies.CopyLedger(spark).merge(df, "day 1").merge(df, "day 1")
    again = copies.CopyLedger(spark, ledger.path, version=ledger.version).merge(df, "day 1").merge(df, "day 2")
    assert [r.copies for r in ledger.read().collect()] == [2] and [r.copies for r in again.read().collect()] == [4] and again.buckets == 16
