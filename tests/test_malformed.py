import random
import re
from datetime import datetime

from ledgerloom.session import table
from ledgerloom.sources import malformed
from tests.conftest import SMALL

AMOUNT = re.compile(r"[+-]?[0-9]+(\.[0-9]{1,2})?")


def brute(line):
    """Reason of one line by a hand-written reader."""
    fields, at, ok = [], 0, True
    line = line or ""
    while True:
        if line[at : at + 1] == '"':
            end, value = at + 1, ""
            while True:
                k = line.find('"', end)
                if k < 0:
                    return "quoting"
                value += line[end:k]
                if line[k + 1 : k + 2] == '"':
                    value, end = value + '"', k + 2
                    continue
                at = k + 1
                break
            if at < len(line) and line[at] != ",":
                ok = False
        else:
            end = line.find(",", at)
            value = line[at : end if end >= 0 else len(line)]
            at = end if end >= 0 else len(line)
            if '"' in value:
                ok = False
        if not ok:
            return "quoting"
        fields.append(value)
        if at >= len(line):
            break
        at += 1
    if len(fields) != 6:
        return "column_count"
    amount = lambda s: bool(AMOUNT.fullmatch(s.strip(" ").replace(",", "")))
    try:
        if not re.fullmatch(r"[0-9]{2}/[0-9]{2}/[0-9]{2}", fields[0]):
            return "date_text"
        datetime.strptime(fields[0], "%d/%m/%y")
    except ValueError:
        return "date_text"
    if fields[3] and not amount(fields[3]):
        return "withdrawal_text"
    if fields[4] and not amount(fields[4]):
        return "deposit_text"
    if not amount(fields[5]):
        return "balance_text"
    return "amount_sides" if bool(fields[3]) == bool(fields[4]) else None


def test_random_lines_against_a_hand_written_reader(spark):
    rng = random.Random(5)
    bits = ['"', '""', ",", "1.00", "5", "x", " ", "12/05/25", "31/02/25", "1,200.50", ""]
    lines = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    for _ in range(1500):
        cells = [rng.choice(["12/05/25", "31/04/25", "1/2/25", '"01/01/24"']), rng.choice(["a", '"b, c"', '"say ""x"""']), "00012", rng.choice(["", "1.00", '"1,000"', "1.", "-"]), rng.choice(["", "2", " 3.5 ", "x"]), rng.choice(["10", '"1,00,000.00"', "", "+5.5", "NIL"])]
        lines.append(",".join(cells))
    df = spark.createDataFrame(list(enumerate(lines)), "row_id long, line_text string")
    got = malformed.load(df)
    reasons = {r.row_id: r.reason for r in got.rejects.collect()}
    loaded = {r.row_id for r in got.rows.collect()}
    for i, line in enumerate(lines):
        assert reasons.get(i) == brute(line), line
        assert (i in loaded) == (brute(line) is None), line


def test_values_and_edge_cases(spark):
    rows = [
        (1, '12/05/25,"A ""B"", C",000123,"1,00,000.50",,"-5.00"', "k"), (1, "bad", "same offset"), (None, "12/05/25,n,,,7,8", "null offset"), (2, None, "null"), (3, "", "empty"), (4, "12/05/25,n,," + "9" * 30 + ",,1", "huge"),
        (5, "12/05/25," + "z" * 200_000 + ",,1,,2", "long"), (6, '12/05/25,' + '"' + '""' * 50_000 + '"' + ",,1,,2", "many quotes"), (7, "12/05/25,n,,0,5,1", "both"), (7, "12/05/25,n,,0,5,1", "both"),
    ]
    df = spark.createDataFrame(rows, "row_id long, line_text string, REASON string").withColumnRenamed("REASON", "note")
    got = malformed.load(df)
    ok = {(r.row_id, r.note): r for r in got.rows.collect()}
    first = ok[1, "k"]
    assert (first.narration, first.reference, first.direction, first.amount_paise, first.balance_paise) == ('A "B", C', "123", "debit", 10000050, -500)
    assert ok[None, "null offset"].amount_paise == 700 and ok[4, "huge"].amount_paise is None
    assert (5, "long") in ok and (6, "many quotes") in ok
    bad = sorted((str(r.row_id), r.reason) for r in got.rejects.collect())
    assert bad == [("1", "column_count"), ("2", "column_count"), ("3", "column_count"), ("7", "amount_sides"), ("7", "amount_sides")]


def test_empty_table_and_clashing_columns(spark):
    got = malformed.load(spark.createDataFrame([], "row_id long, line_text string, reason string, amount_paise long"))
    assert got.rows.count() == 0 and got.rejects.count() == 0
    assert malformed.summary(got).where("n_lines > 0").count() == 0


def test_each_line_comes_out_once(spark):
    t = table(spark, SMALL, "hdfc_rows")
    got = malformed.load(t)
    assert got.rows.count() + got.rejects.count() == t.count()
    assert {r.reason: r.n_lines for r in malformed.summary(got).collect()}["loaded"] == got.rows.count()
