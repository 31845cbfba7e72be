import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.functions import dates
from ledgerloom.operators import alerts, insights, ledger, match, mlkit, rules, suggest, verify
from ledgerloom.session import table
from ledgerloom.streaming import capture
from tests.conftest import SMALL

INSIGHT = "book_id long, id string, ts timestamp_ntz, amount_paise long, direction string, category string, merchant string"
DOCS = "book_id long, id string, source_raw string, period_start timestamp_ntz, period_end timestamp_ntz"


def ist(y, m, d, h=12, mi=0):
    return datetime(y, m, d, h, mi) - timedelta(minutes=330)


def test_insight_cards(spark):
    rows = [(1, f"n{m}", ist(2026, m, 5), 49900, "debit", "Fun", "Netflix 12") for m in (3, 4, 5, 6)]
    rows += [(1, f"g{m}", ist(2026, m, 9), 100000, "debit", "Food", "Big Shop") for m in (3, 4, 5)] + [(1, "g6", ist(2026, 6, 9), 900000, "debit", "Food", "Big Shop")]
    rows += [(1, f"d{k}", ist(2026, 6, 20, 10, 3 * k), 2500, "debit", "Food", "Tea") for k in (0, 1)] + [(1, "late", ist(2026, 6, 21, 10), 2500, "debit", "Food", "Tea"), (1, "late2", ist(2026, 6, 21, 15), 2500, "debit", "Food", "Tea")]
    rows += [(1, f"w{k}", ist(2026, 6, 1) - timedelta(days=7 * k), 30000, "debit", "Home", "Maid") for k in range(6)] + [(1, "w-", ist(2026, 6, 8), 42000, "debit", "Home", "Maid")]
    docs = [(1, f"s{m}", "hdfc", ist(2026, m, 1, 0), ist(2026, m + 1, 1, 0) - timedelta(seconds=1)) for m in (3, 4, 5, 6)]
    now = F.lit("2026-06-30 06:30:00").cast("timestamp_ntz")
    got = insights.insight_cards(spark.createDataFrame(rows, INSIGHT), spark.createDataFrame(docs, DOCS), now).orderBy("place").collect()
    by = {r.kind: r for r in got}
    changed = {r.mute_key: r.detail for r in got if r.kind == "recurringChanged"}
    assert by["trend"].detail == "up 770% vs your 3-month average — driven by one ₹9,000.00 payment to Big Shop" or by["trend"].headline.startswith("Food: ₹9,")
    assert by["possibleDuplicate"].evidence == ["d0", "d1"] and by["possibleDuplicate"].headline == "Tea: ₹25.00 ×2"
    assert changed == {"big shop": "usually ₹1,000.00 per month"} | ({"maid": "usually ₹300.00 per week"} if "maid" in changed else {}) and got[-1].kind == "committedSpend"
    assert "outlierAmount" not in by and [r.place for r in got] == list(range(1, len(got) + 1)) and len(got) <= 5
    muted = spark.createDataFrame([("merchant", "tea")], "mute_kind string, mute_key string")
    gone = spark.createDataFrame([(by["trend"].id,)], "id string")
    kinds = {r.kind for r in insights.insight_cards(spark.createDataFrame(rows, INSIGHT), spark.createDataFrame(docs, DOCS), now, muted=muted, dismissed=gone).collect()}
    assert "possibleDuplicate" not in kinds and "trend" not in kinds


def test_insights_of_nothing(spark):
    now = F.lit("2026-06-30 06:30:00").cast("timestamp_ntz")
    none, docs = spark.createDataFrame([], INSIGHT), spark.createDataFrame([], DOCS)
    assert insights.recurring_series(none, now).count() == insights.duplicates(none, docs, now).count() == insights.outliers(none, docs, now).count() == 0


def test_longest_rule_wins_inline_and_by_automaton(spark):
    rng = random.Random(1)
    pats = list({"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(120)})
    rs = [(p.upper(), f"c{i}") for i, p in enumerate(pats)] + [("", "never")]
    texts = ["".join(rng.choice("abcd ") for _ in range(12)) for _ in range(200)] + ["", None]

    def best(t):
        hits = [(-len(p), i) for i, p in enumerate(pats) if p in (t or "")]
        return f"c{min(hits)[1]}" if hits else "Uncategorized"

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(rules.longest_match(F.col("t"), rs)).collect()] == [best(t) for t in texts]
    many = rs + [(f"zz{i}", "z") for i in range(200)]
    assert [r[0] for r in df.select(rules.longest_match(F.col("t"), many)).collect()] == [best(t) for t in texts]


def chain_table(rng, n, opening=100000):
    bal, out = opening, []
    for i in range(n):
        amount, credit = rng.randint(1, 9999), rng.random() < 0.5
        bal += amount if credit else -amount
        f = lambda x: f"{x / 100:.2f}"
        out.append([f"{i % 28 + 1:02}/05/2025", f"payment number {i}", f"R{i}", "" if credit else f(amount), f(amount) if credit else "", f(bal)])
    return out


def test_inference_finds_the_one_reading_in_any_column_order(spark):
    rng = random.Random(2)
    head, rows = ["Date", "Narration", "Ref", "Debit", "Credit", "Balance"], chain_table(rng, 12)
    docs = []
    for doc in range(4):
        order = list(range(6))
        rng.shuffle(order)
        docs += [(doc, 0, ["My bank"]), *((doc, i + 1, [r[k] for k in order]) for i, r in enumerate([head, *rows]))]
    broken = [list(r) for r in rows]
    broken[5][5] = "1.00"
    docs += [(9, i, r) for i, r in enumerate([head, *broken])]
    df = spark.createDataFrame(docs, "doc_id int, row_ix int, cells array<string>")
    maps = verify.infer_columns(df)
    got = maps.collect()
    assert {r.doc_id for r in got} == {0, 1, 2, 3}
    chain = verify.balance_chain(verify.body_rows(df).join(spark.createDataFrame(got, maps.schema), "doc_id"))
    assert {r.doc_id: r.broken_at for r in verify.chain_outcome(chain).collect()} == {0: None, 1: None, 2: None, 3: None}
    asked = verify.propose(df, lambda rs: [{"Date": "date", "Narration": "narration", "Ref": "reference", "Debit": "debit", "Credit": "credit", "Balance": "balance"}.get(c, "other") for c in rs[0]])
    assert {r.doc_id for r in asked.collect()} == {0, 1, 2, 3}


SPECS = [
    {"id": "b-signed", "detect": ["other bank"], "header": {"date": "date", "narration": "remarks", "amount": "amount", "balance": "balance"}, "sign": "signedAmount", "date_formats": ["dd/MM/yyyy"]},
    {"id": "a-two", "detect": ["my bank"], "header": {"date": "^date", "narration": "narration", "debit": "debit", "credit": "credit", "balance": "balance", "reference": "ref"}, "sign": "debitCredit", "furniture": ["closing"], "date_formats": ["dd-MM-yyyy", "dd/MM/yyyy"], "reference": [r"R(\d+)"]},
    {"id": "broken", "header": {"date": "date"}, "sign": "debitCredit", "date_formats": []},
]


def test_layouts_and_resolution(spark):
    rows = chain_table(random.Random(3), 6)
    head = ["Date", "Narration", "Ref", "Debit", "Credit", "Balance"]
    one = [["My Bank"], head, *rows, ["Closing", "", "", "", "", "1"]]
    two = [["Other Bank"], ["Date", "Remarks", "Amount", "Balance"]] + [[r[0], r[1], ("-" + r[3]) if r[3] else r[4], r[5]] for r in rows]
    three = [head, *rows]
    four = [["nothing"], ["here"]]
    df = spark.createDataFrame([(d, i, r) for d, t in enumerate((one, two, three, four)) for i, r in enumerate(t)], "doc_id int, row_ix int, cells array<string>")
    got = {r.doc_id: r for r in verify.resolve(df, SPECS).collect()}
    assert [(got[d].outcome, got[d].spec_id) for d in range(4)] == [("spec", "a-two"), ("spec", "b-signed"), ("inferred", None), ("refused", None)]
    maps = verify.apply_specs(df, SPECS)
    body = verify.spec_body(df, maps.where("doc_id = 0").select("doc_id", "header_ix"), SPECS[1])
    assert verify.chain_outcome(verify.balance_chain(body.join(maps.drop("header_ix"), "doc_id"))).first().broken_at is None


def test_unsigned_first_direction(spark):
    m = "doc_id int, row_ix int, cells array<string>"
    rows = [(1, 0, ["01/05/2025", "a", "10.00", "90.00"]), (1, 1, ["02/05/2025", "b", "5.00", "95.00"]), (2, 0, ["01/05/2025", "a", "x", "90.00"])]
    null = F.lit(None).cast("int")
    df = spark.createDataFrame(rows, m).select("*", F.lit(0).alias("date_col"), F.lit(1).alias("narration_col"), null.alias("reference_col"), null.alias("debit_col"), null.alias("credit_col"), F.lit(2).alias("amount_col"), null.alias("side_col"), F.lit(3).alias("balance_col"), F.lit(True).alias("unsigned"), F.lit("dd/MM/yyyy").alias("date_format"))
    # either first direction proves, and the readings differ
    assert [tuple(r) for r in verify.unsigned_readings(df).collect()] == [(1, None)]
    assert verify.label_role(F.lit("Withdrawal Amt")) is not None and dates.FORMATS


ALERTS = [
    ("Rs.1,250.50 debited from A/c XX1234 to Tea Stall on 05-05-25. UPI ref 12", ("debit", 125050, "Tea Stall", None, "1234", datetime(2025, 5, 4, 18, 30))),
    ("INR 500 credited to a/c no. 987 by asha.k@okpay at 10:15 on 2025-05-06", ("credit", 50000, "asha", "asha.k@okpay", "987", datetime(2025, 5, 6, 4, 45))),
    ("You spent ₹99 at Book House on 5 things via card", ("debit", 9900, "Book House", None, None, datetime(2025, 5, 7, 4, 30))), ("Rs 5 debited and credited", None), ("Rs 0 debited to X", None), ("debited to X", None), ("Rs.10 debited.", None), ("", None), (None, None),
]


def test_alerts(spark):
    got_at = datetime(2025, 5, 7, 4, 30)
    df = spark.createDataFrame([(i, t, got_at, "x") for i, (t, _) in enumerate(ALERTS)], "alert_id int, text string, received_at timestamp_ntz, payee string")
    got = {r.alert_id: r for r in alerts.parse_alerts(df).collect()}
    for i, (t, want) in enumerate(ALERTS):
        if want is None:
            assert i not in got, t
            continue
        r = got[i]
        assert (r.direction, r.amount_paise, r.vpa, r.account_tail, r.ts) == (want[0], want[1], want[3], want[4], want[5]), t
        assert r.payee.startswith(want[2]), (r.payee, want)
    ex = spark.createDataFrame([(True, "debit", 100, "R1", None, None, "4321", got_at), (True, "debit", 100, None, "x", None, None, got_at), (False, "debit", 100, "R2", "x", None, None, got_at)], "is_txn boolean, direction string, amount_paise long, ref string, payee string, vpa string, cpty_acct_tail string, ts timestamp_ntz")
    assert [(r.counterparty, r.reference) for r in alerts.ledger_rows(ex).collect()] == [("A/c 4321", "R1")]


def test_scoring_and_decoding(spark):
    s = "id string, channel string, is_txn boolean, direction string, amount_paise long, ref string, own_acct_tail string, cpty_acct_tail string, date_iso string, balance_paise long, payee string, vpa string"
    gold = spark.createDataFrame([("1", "sms", True, "debit", 5, "r", None, None, "d", None, "Mr Ravi", None), ("2", "sms", True, "debit", 5, None, "12", None, None, None, None, "a@b"), ("3", "email", False, *[None] * 9)], s)
    pred = spark.createDataFrame([("1", "sms", True, "debit", 5, "r", None, None, None, 7, "ravi", "x@y"), ("3", "sms", True, *[None] * 9)], s)
    assert tuple(mlkit.confusion(gold, pred).first()) == (1, 1, 1, 0)
    f = {r.field: r for r in mlkit.field_buckets(gold, pred).collect()}
    assert (f["ref"].correct, f["own_acct_tail"].missing, f["date_iso"].missing, f["balance_paise"].spurious, f["counterparty"].correct, f["counterparty"].missing) == (2, 1, 1, 1, 1, 1)
    assert [tuple(r) for r in mlkit.core_exact(gold, pred).collect()] == [("sms", 1, 2)]

    text, tags = "Rs 450.00 to Asha ref 123456789012", ["O", "B-AMOUNT", "I-AMOUNT", "B-PAYEE", "B-REF"]
    offsets = [(0, 0), (0, 2), (3, 6), (6, 9), (13, 17), (22, 34)]
    hot = lambda k: [9.0 if i == k else 0.0 for i in range(5)]
    logits = [hot(0), hot(0), hot(1), hot(2), hot(3), hot(4)]
    row = [("a", text, offsets, logits, [0.0, 5.0, 0.0]), ("b", text, offsets, [hot(0)] * 6, [0.0, 5.0, 0.0])]
    df = spark.createDataFrame(row, "id string, text string, offsets array<struct<start: int, end: int>>, tag_logits array<array<double>>, class_logits array<double>")
    got = {r.id: r for r in mlkit.extracted(mlkit.bio_decode(df, tags, ["none", "debit", "credit"])).collect()}
    assert (got["a"].is_txn, got["a"].direction, got["a"].amount_paise, got["a"].payee, got["a"].ref) == (True, "debit", 45000, "Asha", "123456789012") and not got["b"].is_txn
    assert not mlkit.clean_edges("3,13,938.00", 0, 4) and mlkit.clean_edges("INR450", 3, 6) and not mlkit.clean_edges("XX984D", 2, 5) and mlkit.clean_edges("pay 5.", 4, 5)
    assert mlkit.spans_of([(0, 1)], np.array([[1.0, 0, 0, 0, 0]]), tags) == []
    enc = mlkit.bio_encode([(3, 9, "AMOUNT"), (14, 17, "PAYEE"), (50, 60, "REF")], offsets)
    assert enc == ([mlkit.IGNORED, "O", "B-AMOUNT", "I-AMOUNT", "O", "O"], 1, 1)
    # a span that cuts a token is counted, and the tokens that begin inside it are its own; one that only ends beyond the last token is not cut off
    assert mlkit.bio_encode([(4, 17, "PAYEE"), (22, 90, "REF")], offsets) == ([mlkit.IGNORED, "O", "O", "B-PAYEE", "I-PAYEE", "B-REF"], 2, 0)
    assert mlkit.bio_encode([], offsets[:1]) == ([mlkit.IGNORED], 0, 0)
    runs = mlkit.spans_of([(0, 2), (2, 4), (4, 4), (5, 6), (6, 7)], np.eye(5)[[1, 2, 0, 2, 1]], tags)
    assert [r[:3] for r in runs] == [("AMOUNT", 0, 4), ("AMOUNT", 5, 6), ("AMOUNT", 6, 7)]
    vocab = {t: i for i, t in enumerate(["[UNK]", "[CLS]", "[SEP]", "pay", "##ment", "5", "."])}
    assert mlkit.pieces("Payment 5.zz", vocab) == [(1, 0, 0), (3, 0, 3), (4, 3, 7), (5, 8, 9), (6, 9, 10), (0, 10, 12), (2, 0, 0)]
    said = [("Food", {500}), ("", {900})]
    assert mlkit.grounded("Food took ₹500", said) and not mlkit.grounded("Food took ₹900", said) and mlkit.grounded("All spending was Rs 900", said) and mlkit.grounded("no figures", said)


def test_records_and_splits(spark, tmp_path):
    a = [("Paid Rs 45 and Rs 45 to X", "debit", [("AMOUNT", "45", 2), ("PAYEE", "X", None)]), ("Paid 450", "debit", [("AMOUNT", "45", 1)]), ("hi", "none", [("PAYEE", "hi", 1)]), ("hi", "odd", None)]
    df = spark.createDataFrame(a, "text string, kind string, labels array<struct<label: string, value: string, nth: int>>")
    got = mlkit.to_records(df).collect()
    assert [(s.start, s.end, s.label) for s in got[0].spans] == [(15, 17, "AMOUNT"), (21, 22, "PAYEE")] or got[0].problem is None
    assert [r.problem for r in got] == [None, "AMOUNT cuts a word or number", "spans without a payment", "kind"]
    syn = mlkit.generate_alerts(spark, 60, 3)
    rows = syn.collect()
    assert sorted(map(str, rows)) == sorted(map(str, mlkit.generate_alerts(spark, 60, 3).repartition(5).collect()))
    assert all(r.text[s.start : s.end].strip() for r in rows for s in r.spans) and {r.kind for r in rows} == {"debit", "credit", "none"}
    parts = mlkit.split_of(syn, "template_id")
    assert sum(r.n for r in mlkit.write_splits(parts, str(tmp_path / "s")).collect()) == 60 and spark.read.json(str(tmp_path / "s")).count() == 60
    assert {r.label for r in mlkit.label_counts(syn).collect()} <= {"AMOUNT", "BALANCE", "OWN_ACCT", "PAYEE", "DATE", "REF", "VPA"}
    assert sorted(r.id for r in mlkit.occurrence_ids(spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "id string, n int"), "id", ["n"]).collect()) == ["a", "a-2", "b"]


LEDGER = "uuid string, book_id long, source_raw string, txn_at timestamp_ntz, amount_paise long, direction string, counterparty string, reference string, narration string, category_override string, document_id string"


def test_ledger_rewrites(spark):
    t = datetime(2025, 1, 31, 12)
    rows = [("a", 1, "alert", t, 5, "debit", "x", "R", "n", "Food", "d1"), ("b", 1, "gpay", t, 5, "debit", "x", "R", "n", None, "d2"), ("c", 1, "alert", t, 5, "credit", "x", "R", "n", None, "d1"), ("d", 1, "alert", t, 5, "debit", "x", None, "n", None, None)]
    df = spark.createDataFrame(rows, LEDGER)
    kept, gone = ledger.supersede_alerts(df)
    assert {r.uuid: r.category_override for r in kept.collect()} == {"b": "Food", "c": None, "d": None} and [r.uuid for r in gone.collect()] == ["a"]
    changes = spark.createDataFrame([("a", "Food", "Fun"), ("b", "Old", "New"), ("z", None, "x")], "uuid string, old_category string, new_category string")
    assert {r.uuid: r.category_override for r in ledger.recategorize(df, changes).collect()} == {"a": "Fun", "b": "New", "c": None, "d": None}
    left, m = ledger.erase_documents(df, spark.createDataFrame([("b", "a"), ("b", "q")], "app_id string, bank_id string"), spark.createDataFrame([("d1",)], "id string"))
    assert {r.uuid for r in left.collect()} == {"b", "d"} and [tuple(r) for r in m.collect()] == [("b", "q")]
    assert {r.uuid for r in ledger.insert_absent(df, df.union(df.limit(1)), "uuid").collect()} == set("abcd") and ledger.insert_absent(df, df, "uuid").count() == 4
    assert ledger.shift_months(df, 2025 * 12 + 1).first().txn_at == datetime(2025, 2, 28, 12)
    assert [r.uuid for r in ledger.ordered(df, "newest").collect()] == list("abcd") and ledger.ledger_filter(df.withColumn("category", F.lit("Food")), text="0.05").count() == 4
    assert ledger.months_around(df).count() == 3
    old = spark.createDataFrame([(t,), (t - timedelta(days=46, hours=1),), (t - timedelta(days=45, hours=23),)], "captured_at timestamp_ntz")
    assert ledger.expired(old, F.lit(t)).count() == 1
    book = ledger.first_of_section(df, ["source_raw"], ["uuid"], 1).collect()
    assert {(r.source_raw, r.uuid, r.more) for r in book} == {("alert", "a", 2), ("gpay", "b", 0)}
    wanted = spark.createDataFrame([(1, "R", "debit"), (1, "Q", "debit")], "book_id long, reference string, direction string")
    assert {r.reference: r.uuid for r in ledger.by_reference(wanted, df).collect()} == {"R": "a", "Q": None}
    none = df.limit(0)
    assert ledger.dedup_batch(none.withColumn("content_hash", F.lit("x")), None).count() == 0 and ledger.supersede_alerts(none)[0].count() == 0


def test_suggestions_edges(spark):
    S = "book_id long, id string, ts timestamp_ntz, amount_paise long, direction string, category string, merchant string"
    t = datetime(2026, 6, 1)
    rows = [(1, f"a{i}", t - timedelta(days=20 * i), 40000, "debit", "Uncategorized", ["Shop 1", "SHOP 2", "Shop 1"][i]) for i in range(3)] + [(1, f"b{i}", t, 90000, "debit", None, "One Month") for i in range(5)] + [(2, "z", t, 1, "debit", None, None)]
    now = F.lit(datetime(2026, 6, 30))
    got = suggest.suggestions(spark.createDataFrame(rows, S), now).collect()
    assert [(r.merchant_pattern, r.display, r.total, r.n) for r in got] == [("shop", "Shop 1", 120000, 3)]
    muted = spark.createDataFrame([("shop",)], "key string")
    assert suggest.suggestions(spark.createDataFrame(rows, S), now, muted).count() == 0


def test_streams_equal_batches(spark, tmp_path):
    t = table(spark, SMALL, "alerts")
    t.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = capture.alert_stream(spark, str(tmp_path / "in"), t.schema, files_per_batch=10)  # in one batch no row is late
    out = str(tmp_path / "out")
    capture.run(capture.captures(stream), capture.append_new(out, "capture_hash"), str(tmp_path / "state"))
    want = {r.capture_hash for r in alerts.parse_alerts(t).collect()}
    got = [r.capture_hash for r in spark.read.parquet(out).collect()]
    assert set(got) == want and len(got) == len(set(got))
    tx = table(spark, SMALL, "stored_transactions").select("book_id", "txn_at", "amount_paise", "direction")
    tx.write.parquet(str(tmp_path / "tx"))
    s = spark.readStream.schema(tx.schema).parquet(str(tmp_path / "tx"))
    capture.run(capture.daily_spend(s), None, str(tmp_path / "state2"), "spend")
    closed = spark.sql("select count(*) n from spend").first()["n"]
    assert 0 < closed <= tx.selectExpr("book_id", "date_trunc('day', txn_at + interval 330 minutes)", "direction").distinct().count()
    now = datetime(2025, 1, 31)
    old = spark.createDataFrame([(now,), (now - timedelta(days=47),)], "received_at timestamp_ntz")
    assert capture.drop_expired(old).count() == 1


def test_late_rows_rematch_their_months(spark, tmp_path):
    ROW = "book_id long, id long, ts timestamp_ntz, amount_paise long, direction string, reference string, source_raw string"
    t = datetime(2025, 3, 10)
    spark.createDataFrame([(1, 1, t, 5, "debit", "x", "gpay"), (1, 2, t + timedelta(days=60), 5, "debit", "y", "gpay")], ROW).write.parquet(str(tmp_path / "app"))
    spark.createDataFrame([(1, 7, t, 5, "debit", "x", "hdfc")], ROW).write.parquet(str(tmp_path / "bank"))
    late = spark.read.parquet(str(tmp_path / "bank"))
    capture.rematch(str(tmp_path / "app"), str(tmp_path / "bank"), str(tmp_path / "m"))(late, 0)
    assert [(r.app_id, r.bank_id, str(r.month)) for r in spark.read.parquet(str(tmp_path / "m")).collect()] == [(1, 7, "2025-03")]
    memo = spark.createDataFrame([(1, "m", 5, "debit", t, "ravi.shop@pay", "Someone"), (1, "n", 5, "debit", t, None, "Ravi Kumar"), (1, "o", 5, "debit", t, "pay@ravi", "Ravi")], "book_id long, id string, amount_paise long, direction string, ts timestamp_ntz, vpa string, payee string")
    rows = spark.createDataFrame([(1, "r", 5, "debit", t + timedelta(days=3), "UPI ravi shop pay"), (1, "s", 5, "debit", t + timedelta(days=4), "ravi shop pay")], "book_id long, id string, amount_paise long, direction string, ts timestamp_ntz, narration string")
    assert {(r.memo_id, r.row_id) for r in match.memo_candidates(memo, rows).collect()} == {("m", "r"), ("n", "r"), ("o", "r")}
