"""Queries take whole tables: fixtures in which a cut would show."""

import random
from datetime import datetime, timedelta

from test_match import loop_reconcile

from ledgerloom.plans import derive, ledger_queries

TXN = "uuid string, book_id long, content_hash string, source_raw string, txn_at timestamp_ntz, amount_paise long, direction string, counterparty string, reference string, narration string, category_override string, document_id string"
ALERT = "alert_id long, book_id long, received_at timestamp_ntz, channel string, issuer string, text string"
T = datetime(2025, 3, 3, 9)


def txn(uuid, source="hdfc", ts=T, amount=100, direction="debit", party="", ref=None, narration="", book=1, override=None):
    return (uuid, book, "h" + uuid, source, ts, amount, direction, party, ref, narration, override, None)


def folder(spark, path, txns, alerts=()):
    spark.createDataFrame(txns, TXN).write.parquet(f"{path}/stored_transactions.parquet")
    spark.createDataFrame(list(alerts), ALERT).write.parquet(f"{path}/alerts.parquet")
    return str(path)


def test_all_memos_take_part(spark, tmp_path):
    txns = [txn(f"u{i:02}", "hdfc" if i % 2 else "bank:sbi", T + timedelta(days=9 * i), 1000 + 5 * i, party="Omkar Das", narration="UPI OMKAR DAS") for i in range(24)]
    txns += [txn("vpa", amount=90_000, narration="UPI shop pay"), txn("own", amount=80_000, party="Zed", narration="NEFT shop2@pay"), txn("app", "gpay", party="Omkar Das", narration="OMKAR")]
    texts = ["Rs 900.00 paid to Mohan via shop@pay on 03/03/2025", "Rs 900.00 paid to Mohan via shop@pay on 03/03/2025", "Rs 900.00 paid to Mohan via other@pay on 03/03/2025"]
    d = folder(spark, tmp_path, txns, [(i, 1, T, "sms", "X", t) for i, t in enumerate(texts)])
    pairs = [tuple(r) for r in ledger_queries.capture_memo_candidates(spark, d).select("memo_id", "row_id", "gap").collect()]
    by_row = {(m, r): g for m, r, g in pairs}
    # a memo of each bank row, by name or by handle, and one of the alert that came twice; the other handle has none
    assert {(m, r) for m, r in by_row if m == r} == {(t[0], t[0]) for t in txns[:24]} | {("own", "own")}
    alert = [m for m, r in by_row if m != r]
    assert len(pairs) == 26 and len(alert) == 1 and by_row[alert[0], "vpa"] == 0
    used, want = set(), set()
    for g, m, r in sorted((g, m, r) for m, r, g in pairs):
        if not {("m", m), ("r", r)} & used:
            used |= {("m", m), ("r", r)}
            want.add((m, r))
    assert {(r.memo_id, r.row_id) for r in ledger_queries.capture_merge(spark, d).collect()} == want


def loop_insight_rows(txns):
    """uuid and payee's category source of the rows that count, for rows of different content hashes."""
    kind = lambda t: "app" if t[3] in ("gpay", "paytm", "bhim", "alert") or t[3].startswith("upi:") else "bank"
    exports = {(t[1], t[8], t[6]) for t in txns if kind(t) == "app" and t[3] != "alert" and t[8]}
    rows = [t for t in txns if not (t[3] == "alert" and (t[1], t[8], t[6]) in exports)]
    gone = set()
    for book in {t[1] for t in rows}:
        mine = [t for t in rows if t[1] == book]
        side = lambda k: [(t[1], t[0], t[4], t[5], t[6], t[8], t[3]) for t in mine if kind(t) == k]  # noqa: B023, E731
        gone |= {b for _, b, _ in loop_reconcile(side("app"), side("bank"))}
        free, own = sorted((t for t in mine if kind(t) == "bank" and t[6] == "credit"), key=lambda t: (t[4], t[0])), []
        for a in sorted((t for t in mine if kind(t) == "bank" and t[6] == "debit"), key=lambda t: (t[4], t[0])):
            near = [c for c in free if c[3] != a[3] and c[5] == a[5] and abs(c[4] - a[4]) <= timedelta(days=2)]
            if near:
                c = min(near, key=lambda c: (abs(c[4] - a[4]), c[4], c[0]))
                free.remove(c)
                own += [a, c]
        refs, alerts = {t[8] for t in own if t[8]}, [t for t in mine if t[3] == "alert" and t[8]]
        both = {(t[8], t[5]) for t in alerts if any(o[8] == t[8] and o[5] == t[5] and o[6] != t[6] for o in alerts)}
        gone |= {t[0] for t in own} | {t[0] for t in alerts if t[8] in refs or (t[8], t[5]) in both}
    return {t[0] for t in rows if t[0] not in gone}


def test_insight_rows_hold_each_payment_once(spark, tmp_path):
    # one payment as export, statement row and alert; one without reference; an own transfer and its alert
    txns = [txn("e", "gpay", ref="r", party="x"), txn("b", ref="r"), txn("a", "alert", ref="r", override="Rent"), txn("e2", "gpay", amount=7), txn("b2", ts=T + timedelta(days=1), amount=7)]
    txns += [txn("d", amount=900, ref="t"), txn("c", "idfc", amount=900, direction="credit"), txn("ta", "alert", amount=901, ref="t")]
    got = {r.id: r.category for r in derive.insight_rows(spark, folder(spark, tmp_path / "few", txns)).collect()}
    assert set(got) == {"e", "e2"} == loop_insight_rows(txns) and got["e"] == "Rent"
    rng = random.Random(5)
    ref = lambda: rng.choice([None, "", *(f"r{i}" for i in range(25))])
    many = [txn(f"u{i:03}", rng.choice(["gpay", "alert", "hdfc", "idfc", "bank:x"]), T + timedelta(hours=rng.randint(0, 700)), rng.choice([100, 200, 300]), rng.choice(["debit", "credit"]), ref=ref(), book=rng.randint(1, 2)) for i in range(300)]
    got = [r.id for r in derive.insight_rows(spark, folder(spark, tmp_path / "many", many)).collect()]
    assert len(got) == len(set(got)) and set(got) == loop_insight_rows(many)


def test_unmatched_and_visible_follow_both_tiers(spark, tmp_path):
    rng = random.Random(3)
    side = lambda start: [(start + i, rng.randint(1, 2), T + timedelta(hours=rng.randint(0, 600)), rng.choice([100, 200]), rng.choice(["debit", "credit"]), rng.choice([None, "r1", "r2", "r3"])) for i in range(60)]
    app, bank = side(0), side(1000)
    for name, key, rows in (("recon_app", "app_id", app), ("recon_bank", "bank_id", bank)):
        spark.createDataFrame(rows, f"{key} long, book_id long, txn_at timestamp_ntz, amount_paise long, direction string, reference string").write.parquet(f"{tmp_path}/{name}.parquet")
    row = lambda r: (r[1], r[0], *r[2:])
    found = [m for book in (1, 2) for m in loop_reconcile([row(r) for r in app if r[1] == book], [row(r) for r in bank if r[1] == book])]
    assert {t for _, _, t in found} == {"reference", "amountDate"}
    apps, banks = {r[0] for r in app} - {a for a, _, _ in found}, {r[0] for r in bank} - {b for _, b, _ in found}
    assert {tuple(r) for r in ledger_queries.match_unmatched(spark, str(tmp_path)).collect()} == {("app", i) for i in apps} | {("bank", i) for i in banks}
    assert {r.id for r in ledger_queries.ledger_visible(spark, str(tmp_path)).collect()} == banks


def test_alerts_are_judged_by_handle_payee_and_tail(spark, tmp_path):
    txns = [txn("vpa", amount=90_000, narration="UPI shop pay"), txn("name", "gpay", amount=80_000, party="Mohan", narration="MOHAN", ref="r1"), txn("tail", amount=70_000, narration="CARD XX4321"), txn("none", amount=60_000, narration="NEFT", party="Zed"), txn("late", ts=T + timedelta(days=4), amount=90_000, narration="UPI shop pay")]
    texts = ["Rs 900.00 paid to Ravi via shop@pay on 03/03/2025", "Rs 800.00 paid to Mohan on 03/03/2025", "Rs 700.00 paid to Kiran on 03/03/2025 from a/c 4321", "Rs 600.00 paid to Ravi on 03/03/2025"]
    d = folder(spark, tmp_path, txns, [(i, 1, T, "sms", "X", t) for i, t in enumerate(texts)])
    assert {r.b_id: r.verdict for r in ledger_queries.capture_judge(spark, d).collect()} == {"vpa": "merge", "name": "merge", "tail": "merge", "none": "suggested"}
    assert {r.b_id for r in ledger_queries.capture_pairs(spark, d).collect()} == {"vpa", "name", "tail"}
