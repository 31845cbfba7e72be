import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ledgerloom.session import table
from ledgerloom.sources import drift
from tests.conftest import SMALL

SCHEMA = "file_id long, account_id long, book_id long, received_at timestamp_ntz, header_row array<string>, column_count int, body_rows array<array<string>>"
FIELD = {label: f for f, labels in drift.LABELS.items() for label in labels}


def kind(cells):
    import re

    full = [c.strip() for c in cells if c and c.strip()]
    if not full:
        return None
    if all(re.fullmatch(r"[+-]?[0-9][0-9,]*", c) for c in full):
        return "integer"
    if all(re.fullmatch(r"[+-]?[0-9][0-9,]*|[+-]?(?:[0-9][0-9,]*)?\.[0-9]+", c) for c in full):
        return "decimal"
    if all(re.fullmatch(r"\d\d-\d\d-\d{4}|\d{4}-\d\d-\d\d|\d\d? [A-Za-z]{3} \d{4}", c) for c in full):
        return "date"
    return "text"


def brute(files):
    """The report by a loop over each series."""
    out, by = set(), {}
    for f in files:
        if f[4]:
            by.setdefault(f[1], []).append(f)
    for series in by.values():
        series.sort(key=lambda f: (f[3], f[0]))
        prev, former = None, {}
        for f in series:
            cols = {}
            for j, label in enumerate(f[4]):
                norm = " ".join(label.lower().split())
                cols[FIELD.get(norm, "?" + norm)] = (norm, kind([r[j] if j < len(r) else "" for r in f[6]]))
            if prev is not None:
                for k, (label, kd) in cols.items():
                    if k not in prev:
                        out.add((f[0], "added", label))
                        continue
                    if prev[k] != label:
                        out.add((f[0], "renamed", label))
                    if kd and former.get(k) and kd != former[k]:
                        out.add((f[0], "retyped", label))
                out |= {(f[0], "removed", label) for k, label in prev.items() if k not in cols}
            prev = {k: label for k, (label, _) in cols.items()}
            for k, (_, kd) in cols.items():
                if kd:
                    former[k] = kd
    return out


def test_report_against_a_loop(spark):
    rng = random.Random(3)
    dates = ["01-02-2025", "2025-03-04", "5 Jan 2025"]
    files = []
    for i in range(220):
        names = rng.sample(list(FIELD), rng.randint(2, 6))
        seen, head = set(), []
        for n in names:
            if FIELD[n] not in seen:
                seen.add(FIELD[n])
                head.append(rng.choice([n, n.upper(), f"  {n} "]))
        body = [[rng.choice(["", "1", "2.50", "3,000", rng.choice(dates), "x"]) for _ in head] for _ in range(rng.randint(0, 2))]
        files.append((i, rng.randint(1, 6), 1, datetime(2025, 1, 1) + timedelta(days=rng.randint(0, 300)), head if rng.random() > 0.1 else [], len(head), body))
    got = {tuple(r) for r in drift.drift_report(spark.createDataFrame(files, SCHEMA)).collect()}
    assert got == brute(files)


def test_unknown_labels_pair_by_place_and_kind(spark):
    t = datetime(2025, 1, 1)
    rows = [(1, 1, 1, t, ["Date", "Foo", "Bar"], 3, [["2025-01-01", "1", "x"]]), (2, 1, 1, t + timedelta(days=40), ["Date", "Fee", "Qux", "Extra"], 4, [["2025-01-02", "2", "7", "y"]])]
    got = {tuple(r) for r in drift.drift_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(2, "renamed", "fee"), (2, "removed", "bar"), (2, "added", "qux"), (2, "added", "extra")}


def test_rescue_and_promotion(spark):
    t = datetime(2025, 1, 1)
    rows = [
        (1, 1, 1, t, ["Txn Date", "Narration", "Debit", "Credit", "Balance", "Ccy", "Odd"], 7, [["01-01-2025", "a", "1,000.50", "", "10.00", "INR", "?"], ["soon", "b", "x", None, "9.00", "", ""]]),
        (2, None, None, None, None, None, None), (3, 1, 1, t, [], 2, [["a", "b"]]), (4, 1, 1, t, ["Date"], 1, [["2025-01-05", "more"], []]), (4, 1, 1, t, ["Date"], 1, [["2025-01-05", "more"], []]),
    ]
    led = {(r.file_id, r.row_ix): r for r in drift.promote(drift.ingest(spark.createDataFrame(rows, SCHEMA))).collect()}
    a, b = led[1, 0], led[1, 1]
    assert (str(a.txn_date), a.debit_paise, a.credit_paise, a.balance_paise, a.currency, a.rescued) == ("2025-01-01", 100050, None, 1000, "INR", '{"odd":"?"}')
    assert b.txn_date is None and b.rescued == '{"txn_date":"soon","debit":"x"}' and b.balance_paise == 900
    assert led[3, 0].rescued == '{"Column 1":"a","Column 2":"b"}' and led[4, 0].rescued == '{"Column 2":"more"}' and led[4, 1].rescued is None
    assert drift.drift_report(spark.createDataFrame([], SCHEMA)).count() == 0 and drift.ingest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_cell_is_lost(spark):
    f = table(spark, SMALL, "statement_files")
    n = f.selectExpr("explode(body_rows) r").selectExpr("explode(r) c").where("trim(c) <> ''").count()
    led = drift.ingest(f)
    kept = led.selectExpr("sum(int(txn_date is not null) + int(value_date is not null) + int(narration is not null) + int(reference is not null) + int(debit_paise is not null) + int(credit_paise is not null) + int(balance_paise is not null) + coalesce(size(map_keys(from_json(rescued, 'map<string,string>'))), 0)) n").first()["n"]
    assert kept == n


def test_whole_paise_and_rupees_come_out_alike(spark):
    t = datetime(2025, 1, 1)
    head = ["Date", "Debit", "Credit", "Balance"]
    rows = [
        (1, 1, 1, t, head, 4, [["2025-01-01", "10.50", "", "89.50"], ["2025-01-02", "", "5.00", "94.50"]]), (2, 1, 1, t, head, 4, [["2025-01-01", "1050", "", "8950"], ["2025-01-02", "", "500", "9450"]]),
        (3, 1, 1, t, head, 4, [["2025-01-01", "10.50", "", "8950"], ["2025-01-02", "", "5.00", "9450"]]), (4, 1, 1, t, head, 4, [["2025-01-01", "10", "", "89.50"], ["2025-01-02", "", "5", "94.50"], ["2025-01-03", "4", "", "90.50"]]),
    ]
    got = {(r.file_id, r.row_ix): (r.debit_paise, r.credit_paise, r.balance_paise) for r in drift.ingest(spark.createDataFrame(rows, SCHEMA)).collect()}
    for f in (1, 2, 3):
        assert (got[f, 0], got[f, 1]) == ((1050, None, 8950), (None, 500, 9450))
    # whole rupees whose balance closes as rupees only
    assert (got[4, 0], got[4, 1]) == ((1000, None, 8950), (None, 500, 9450))


def _two(spark, head_a, row_a, head_b, row_b):
    t = datetime(2025, 1, 1)
    rows = [(1, 1, 1, t, head_a, len(head_a), [row_a]), (2, 1, 1, t + timedelta(days=9), head_b, len(head_b), [row_b])]
    return {tuple(r)[1:] for r in drift.drift_report(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_renames_between_known_and_unknown_labels(spark):
    assert _two(spark, ["Date", "Memo"], ["2025-01-01", "x"], ["Date", "Narration"], ["2025-01-01", "y"]) == {("renamed", "narration")}
    assert _two(spark, ["Date", "Debit"], ["2025-01-01", "1"], ["Date", "Paid by you"], ["2025-01-01", "2"]) == {("renamed", "paid by you")}
    # moved and renamed, alone of its kind
    assert _two(spark, ["Date", "Foo", "Debit"], ["2025-01-01", "x", "1"], ["Debit", "Date", "Bar"], ["1", "2025-01-01", "y"]) == {("renamed", "bar")}
    # two known fields are never one column
    assert _two(spark, ["Date", "Debit"], ["2025-01-01", "1"], ["Date", "Credit"], ["2025-01-01", "2"]) == {("removed", "debit"), ("added", "credit")}


def test_surplus_cells_beside_labels_like_their_names(spark):
    t = datetime(2025, 1, 1)
    rows = [(1, 1, 1, t, ["Column 3", "Date", "x", "X", "x again 3"], 5, [["a", "2025-01-01", "b", "c", "d", "e", "f"]])]
    (r,) = drift.ingest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert json.loads(r.rescued) == {"column 3": "a", "x": "b", "x Again 3": "c", "x again 3": "d", "Column 6": "e", "Column 7": "f"} and str(r.txn_date) == "2025-01-01"


def test_each_written_day_casts(spark):
    same = ["05/01/2025", "5-1-25", "2025.01.05", "5th Jan 2025", "5 January 2025", "05-JAN-25", "January 5, 2025", "Jan 5th 2025", "2025-Jan-05", "5Jan2025", "45662"]
    none = ["31/02/2025", "5 Foo 2025", "2025-13-01", "", "soon", "1234567"]
    df = spark.createDataFrame([(x,) for x in same + none], "t string").select("t", drift.any_date(F.col("t")).alias("d"), drift.written_date(F.col("t")).alias("w"))
    got = {r.t: (str(r.d), str(r.w)) for r in df.collect()}
    assert {got[x][0] for x in same} == {"2025-01-05"} and {got[x] for x in none} == {("None", "None")} and got["45662"][1] == "None"
    assert _two(spark, ["Date"], ["5th Jan 2025"], ["Date"], ["January 6, 2025"]) == set() and _two(spark, ["Date"], ["5th Jan 2025"], ["Date"], ["31/02/2025"]) == {("retyped", "date")}


def test_sums_of_unknown_unit_stay_in_the_rescue_column(spark):
    t = datetime(2025, 1, 1)
    whole = [["2025-01-01", "500", "9000"], ["2025-01-02", "100", "8900"]]  # closes in rupees and in paise
    rows = [(1, 1, 1, t, ["Date", "Debit", "Balance"], 3, [["2025-01-01", "500", "900.00"]]), (3, 2, 1, t, ["Date", "Debit", "Balance"], 3, whole), (4, 1, 1, t, ["Date", "Debit", "Balance"], 3, whole), (5, None, 1, t, ["Date", "Debit", "Balance"], 3, whole), (2, 1, 1, t, ["Date", "Debit", "Balance"], 3, [["2025-01-01", "500.00", "90000"], ["2025-01-02", "100", "89900.00"]])]
    got = {(r.file_id, r.row_ix): r for r in drift.ingest(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1, 0].debit_paise is None and got[1, 0].balance_paise == 90000 and got[1, 0].rescued == '{"debit":"500"}'
    # another account of no certain file, and none: in the rescue column; beside files of some thousand rupees: rupees
    assert [got[f, 0].debit_paise for f in (3, 4, 5)] == [None, 50000, None] and got[3, 0].rescued == got[5, 0].rescued == '{"debit":"500","balance":"9000"}'
    assert (got[2, 1].debit_paise, got[2, 1].balance_paise, got[2, 1].rescued) == (10000, 8990000, None)


def test_record_counts_typed_and_rescued_cells(spark):
    t = datetime(2025, 1, 1)
    rows = [(1, 1, 1, t, ["Date", "Debit", "Odd"], 3, [["2025-01-01", "5.00", "x"], ["soon", "", "y"]])]
    (r,) = drift.record(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(c.field, c.kind, c.typed, c.full) for c in r.columns] == [("txn_date", "text", 1, 2), ("debit", "decimal", 1, 1), ("?odd", "text", 0, 2)]
