import random
from datetime import datetime, timedelta

from ledgerloom.operators import match

ROW = "book_id long, id long, ts timestamp_ntz, amount_paise long, direction string, reference string, source_raw string"


def rows(rng, n, start):
    t = datetime(2025, 1, 1)
    return [(rng.randint(1, 2), start + i, t + timedelta(hours=rng.randint(0, 400)), rng.choice([100, 200]), rng.choice(["debit", "credit"]), rng.choice(["", None, "r1", "r2", "r3"]), rng.choice(["hdfc", "idfc", "bank:x"])) for i in range(n)]


def loop_reconcile(app, bank):
    """Both tiers for one book, by the plain loop in order (ts, id)."""
    app, bank = sorted(app, key=lambda r: (r[2], r[1])), sorted(bank, key=lambda r: (r[2], r[1]))
    by_ref, used, out, rest = {}, set(), set(), []
    for b in bank:
        if b[5]:
            by_ref.setdefault((b[5], b[4]), b)
    for a in app:
        hit = by_ref.get((a[5], a[4])) if a[5] else None
        if hit and hit[1] not in used:
            used.add(hit[1])
            out.add((a[1], hit[1], "reference"))
        else:
            rest.append(a)
    for a in rest:
        near = [b for b in bank if b[1] not in used and b[3] == a[3] and b[4] == a[4] and abs(b[2] - a[2]) <= timedelta(days=2)]
        if near:
            b = min(near, key=lambda b: (abs(b[2] - a[2]), b[2], b[1]))
            used.add(b[1])
            out.add((a[1], b[1], "amountDate"))
    return out


def test_reconcile_against_the_loop(spark):
    for seed in range(3):
        rng = random.Random(seed)
        app, bank = rows(rng, 120, 0), rows(rng, 120, 1000)
        got = {tuple(r) for r in match.reconcile(spark.createDataFrame(app, ROW), spark.createDataFrame(bank, ROW)).select("app_id", "bank_id", "tier").collect()}
        want = set()
        for book in (1, 2):
            want |= loop_reconcile([r for r in app if r[0] == book], [r for r in bank if r[0] == book])
        assert got == want


def test_self_transfers_against_the_loop(spark):
    rng = random.Random(9)
    bank = rows(rng, 150, 0)
    got = {tuple(r) for r in match.self_transfers(spark.createDataFrame(bank, ROW)).collect()}
    want = set()
    for book in (1, 2):
        free = sorted((r for r in bank if r[0] == book and r[4] == "credit"), key=lambda r: (r[2], r[1]))
        for d in sorted((r for r in bank if r[0] == book and r[4] == "debit"), key=lambda r: (r[2], r[1])):
            near = [c for c in free if c[6] != d[6] and c[3] == d[3] and abs(c[2] - d[2]) <= timedelta(days=2)]
            if near:
                c = min(near, key=lambda c: (abs(c[2] - d[2]), c[2], c[1]))
                free.remove(c)
                want.add((d[1], c[1]))
    assert got == want and want


def test_memo_merge_against_the_loop(spark):
    rng = random.Random(4)
    pairs = {(f"m{rng.randint(1, 40)}", f"r{rng.randint(1, 40)}"): rng.randint(0, 3) for _ in range(160)}
    df = spark.createDataFrame([(1, 1, "debit", m, r, g) for (m, r), g in pairs.items()], "book_id int, amount_paise int, direction string, memo_id string, row_id string, gap int")
    got = {tuple(r) for r in match.merge_memos(df).select("memo_id", "row_id").collect()}
    used, want = set(), set()
    for g, m, r in sorted((g, m, r) for (m, r), g in pairs.items()):
        if m not in used and r not in used:
            used |= {m, r}
            want.add((m, r))
    assert got == want


def test_detection_pairs_against_the_loop(spark):
    t = datetime(2025, 1, 1)
    for seed in range(3):
        rng = random.Random(seed)
        at = {f"a{i}": t + timedelta(minutes=rng.randint(0, 20)) for i in range(30)} | {f"b{i}": t + timedelta(minutes=rng.randint(0, 20)) for i in range(30)}
        pairs = sorted({(f"a{rng.randint(0, 29)}", f"b{rng.randint(0, 29)}") for _ in range(120)})
        df = spark.createDataFrame([(a, b, at[a], at[b], "merge") for a, b in pairs], "a_id string, b_id string, a_ts timestamp_ntz, b_ts timestamp_ntz, verdict string")
        got = {(r.a_id, r.b_id) for r in match.pair_detections(df).collect()}
        order = sorted((abs(at[a] - at[b]).seconds // 60, a, b) for a, b in pairs)
        taken, done, given_up = set(), {}, set()
        for g, a, b in order:
            if a in done or a in given_up or b in taken:
                continue
            if any(a2 == a and g2 == g and b2 != b and b2 not in taken for g2, a2, b2 in order):
                given_up.add(a)
                continue
            done[a] = b
            taken.add(b)
        assert got == set(done.items())


def test_judge_cases(spark):
    t = datetime(2025, 1, 1, 6, 30)
    cols = "a_id string, b_id string, " + ", ".join(f"{s}_{c}" for s in "ab" for c in ("amount_paise long", "direction string", "ts timestamp_ntz", "account_tail string", "vpa string", "payee string", "narration string", "reference string"))

    def pair(name, verdict, a=None, b=None):
        base = {"amount_paise": 100, "direction": "debit", "ts": t, "account_tail": None, "vpa": None, "payee": "", "narration": "", "reference": None}
        x, y = base | (a or {}), base | (b or {})
        return (name, verdict, *x.values(), *y.values())

    cases = [
        pair("refs", "merge", {"reference": " R1 ", "amount_paise": 5}, {"reference": "r1"}), pair("refs differ", "none", {"reference": "r1"}, {"reference": "r2"}), pair("amount", "none", {"amount_paise": 7}), pair("direction", "none", {"direction": "credit"}), pair("no direction", "suggested", {"direction": None}),
        pair("days", "none", {"ts": t + timedelta(days=4)}), pair("days in", "suggested", {"ts": t + timedelta(days=3)}), pair("tails", "merge", {"account_tail": "xx1234"}, {"account_tail": "234"}), pair("tails differ", "none", {"account_tail": "1234"}, {"account_tail": "9"}), pair("tail in text", "merge", {"account_tail": "1234"}, {"narration": "to xx1234 now"}),
        pair("vpas", "merge", {"vpa": "A@b"}, {"vpa": "a@b"}), pair("vpas differ", "suggested", {"vpa": "a@b", "payee": "ravi"}, {"vpa": "c@b", "payee": "ravi"}), pair("vpa in text", "merge", {"vpa": "shop@pay"}, {"narration": "UPI shop pay"}), pair("name", "merge", {"payee": "Ravi Shop"}, {"narration": "UPI-RAVI-x"}), pair("short name", "suggested", {"payee": "Al"}, {"narration": "al"}),
    ]
    df = spark.createDataFrame(cases, cols)
    for r in match.judge(df).collect():
        assert r.verdict == r.b_id, r.a_id


def test_months_in_order_and_empty_sides(spark):
    t = datetime(2025, 1, 31, 12)
    app = [(1, 1, t, 100, "debit", "", "gpay"), (1, 2, t + timedelta(days=1), 100, "debit", "x", "gpay")]
    bank = [(1, 11, t + timedelta(hours=1), 100, "debit", "x", "hdfc")]
    got = match.recompute_months(spark.createDataFrame(app, ROW), spark.createDataFrame(bank, ROW), [24300, 24301])
    # January comes first and takes the row that February's reference names
    assert [(r.app_id, r.bank_id, r.month) for r in got.collect()] == [(1, 11, "2025-01")]
    none = spark.createDataFrame([], ROW)
    assert match.reconcile(none, none).count() == 0 and match.self_transfers(none).count() == 0 and match.reconcile(spark.createDataFrame(app, ROW), none).count() == 0
