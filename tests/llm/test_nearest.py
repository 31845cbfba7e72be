import random
from datetime import datetime, timedelta

import pytest

from ledgerloom.llm import nearest

APP = "app_id long, book_id long, txn_at timestamp_ntz, amount_paise long, direction string, reference string, h long, id string"
BANK = "bank_id long, book_id long, txn_at timestamp_ntz, amount_paise long, direction string, reference string"
KEYS = ["book_id", "amount_paise", "direction"]


def brute(app, bank):
    out = set()
    for a in app:
        best = None
        for b in bank:
            if None in (*a[:5], *b[:5]) or a[1] != b[1] or a[3:5] != b[3:5] or abs(a[2] - b[2]) > timedelta(hours=48):
                continue
            ra, rb = a[5] or "", b[5] or ""
            if ra and rb and ra.lstrip("0") != rb.lstrip("0"):
                continue
            rank = (abs(a[2] - b[2]), b[2], b[0])
            if best is None or rank < best:
                best = rank
        if best:
            out.add((a[0], best[2]))
    return out


@pytest.mark.parametrize("group_rows", [40_000, 50])
def test_against_brute_force(spark, group_rows):
    rng = random.Random(7)
    t = datetime(2025, 1, 1)
    some = lambda x: None if rng.random() < 0.03 else x
    ref = lambda: rng.choice([None, "", "12", "0012", "7", "000", "0"])
    when = lambda: t + timedelta(hours=rng.randint(0, 24 * 30))
    app = [(i, rng.choice([1, 1, 1, 2]), some(when()), some(rng.choice([100, 200])), rng.choice(["debit", "credit"]), ref(), 1, "x") for i in range(400)]
    bank = [(i, rng.choice([1, 1, 1, 2]), some(when()), some(rng.choice([100, 200])), rng.choice(["debit", "credit"]), ref()) for i in range(400)]
    bank += [(1000 + i, *b[1:]) for i, b in enumerate(bank[:80])] + bank[:30]  # equal times, repeated rows
    app += app[:30]
    got = nearest.nearest_in_time(spark.createDataFrame(app, APP), spark.createDataFrame(bank, BANK), "app_id", "bank_id", KEYS, group_rows=group_rows)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(app, bank)


def test_bounds_and_empty(spark):
    t = datetime(2025, 1, 9)
    app = [(1, 1, t, 5, "debit", None, 0, ""), (2, 1, t + timedelta(seconds=1), 5, "debit", None, 0, "")]
    bank = [(9, 1, t - timedelta(hours=48), 5, "debit", "r"), (8, 1, t + timedelta(days=3), 5, "debit", "r")]
    go = lambda a, b: {tuple(r) for r in nearest.nearest_in_time(spark.createDataFrame(a, APP), spark.createDataFrame(b, BANK), "app_id", "bank_id", KEYS).collect()}
    assert go(app, bank) == {(1, 9)}
    assert go([], bank) == go(app, []) == go([], []) == set()
    with pytest.raises(ValueError):
        nearest.nearest_in_time(spark.createDataFrame(app, APP), spark.createDataFrame(bank, BANK), "app_id", "bank_id", KEYS, block_s=10)
