from datetime import date, datetime

from pyspark.sql import functions as F

from ledgerloom.functions import cal, dates, ident, money, text
from ledgerloom.operators import mlkit


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_money(spark):
    raw = ["5.", "5", " 1,23,456.7 ", "-0.05", "+3", "1.234", "", None, "x", "١", "9" * 25]
    got = [r[0] for r in values(spark, [(x,) for x in raw], "c string", money.signed_paise(F.col("c")))]
    assert got == [None, 500, 12345670, -5, 300, None, None, None, None, None, None]
    nums = [(0,), (5,), (-123456789,), (10000000,), (99999,)]
    assert [r[0] for r in values(spark, nums, "n long", money.inr(F.col("n")))] == ["₹0.00", "₹0.05", "-₹12,34,567.89", "₹1,00,000.00", "₹999.99"]
    assert [r[0] for r in values(spark, nums, "n long", money.whole_rupees(F.col("n")))] == ["₹0", "₹0", "-₹12,34,568", "₹1,00,000", "₹1,000"]
    cells = ["303594.0", "1417816.76", "1999", "1000.505", "1000.504", "-2.5", "x", "1.2.3", ""]
    assert [r[0] for r in values(spark, [(x,) for x in cells], "c string", money.cell_paise(F.col("c")))] == [30359400, 141781676, 199900, 100051, 100050, -250, None, None, None]
    assert values(spark, [(-7, 2), (7, 0)], "a long, b long", money.div(F.col("a"), F.col("b"))) == [(-3,), (None,)]


def test_text(spark):
    rows = [("Naïve  Café-24 & Söns",), (None,), ("ABC-9é",)]
    got = values(spark, rows, "t string", text.merchant_key(F.col("t")), text.narration_norm(F.col("t")), F.array_sort(text.match_tokens(F.col("t"))), text.shape_mask(F.col("t")))
    assert got[0] == ("naïve café söns", "naïve café-24 & söns", ["24", "caf", "na", "ns", "s", "ve"], "AAïAA  AAAé-NN & AöAA")
    assert got[1] == ("", "", [], None) and got[2][3] == "AAA-Né"
    html = "<html><head><style>x</style></head><body><!-- c --><p>Rs&nbsp;5 &amp;lt; &#8377;7&#x41;</p><br>ok</body></html>"
    assert [r[0] for r in values(spark, [(html,), ("1 < 2 &amp; 3",), (None,)], "t string", text.html_plain(F.col("t")))] == ["Rs 5 &lt; ₹7A ok", "1 < 2 &amp; 3", None]
    assert values(spark, [(" Mr.  Ravi  Rao, ",)], "t string", text.clean_name(F.col("t"))) == [("Ravi Rao",)]
    assert text.chunks("a\nbb\ncccccc\nd", 4) == ["a\nbb", "cccc", "cc\nd"]
    assert values(spark, [("VM-HDFCBK", "Paid Rs 500 To Asha on 5")], "s string, t string", text.sender_key(F.col("s")), text.skeleton(F.col("t"))) == [("hdfcbk", "W W 0 W W on 0")]


def test_identity(spark):
    texts = [("A/c XX1234 paid to shop.one@okpay. ok",), ("mail a.b@host.com acct no 98765",), ("none",)]
    got = values(spark, texts, "t string", ident.vpa(F.col("t")), ident.account_tail(F.col("t")), ident.trailing_tail(F.col("t")))
    assert got == [("shop.one@okpay", "1234", None), (None, "9876", "8765"), (None, None, None)]
    assert values(spark, [("000",), ("0012",)], "t string", ident.bare_reference(F.col("t"))) == [(None,), ("12",)]


def test_dates(spark):
    cells = [("31/02/2025",), ("1/2/2025",), ("05 September 2025",), ("5-Sep-25",), ("2025-13-01",), ("2024-02-29",), (" 07/08/25 ",)]
    want = {"dd/MM/yyyy": [None, date(2025, 2, 1), None, None, None, None, None], "dd MMM yyyy": [None, None, date(2025, 9, 5), None, None, None, None], "dd-MMM-yy": [None, None, None, date(2025, 9, 5), None, None, None], "yyyy-MM-dd": [None, None, None, None, None, date(2024, 2, 29), None], "dd/MM/yy": [None] * 6 + [date(2025, 8, 7)]}
    for fmt, days in want.items():
        assert [r[0] for r in values(spark, cells, "c string", dates.statement_day(F.col("c"), fmt))] == days, fmt
    alerts = [("on 2025-05-06 at 14:05",), ("on 31/02/25, 3 Mar 2025",), ("5May25 02:15 pm",), ("ref 12345678",), ("at 25:00 13:07 am",)]
    got = values(spark, alerts, "t string", dates.alert_day(F.col("t")), dates.clock_minutes(F.col("t")))
    assert got == [(date(2025, 5, 6), 845), (date(2025, 3, 3), None), (date(2025, 5, 5), 855), (None, None), (None, None)]
    ts = [(datetime(2025, 1, 31, 18, 30),), (datetime(2025, 1, 31, 18, 29, 59),)]
    assert values(spark, ts, "t timestamp_ntz", cal.month_key(F.col("t")), cal.has_clock(F.col("t")), cal.month_end(cal.month_index(F.col("t")))) == [("2025-02", False, datetime(2025, 2, 28, 18, 29, 59)), ("2025-01", True, datetime(2025, 1, 31, 18, 29, 59))]


def test_strict_readers(spark):
    spans = [("1,23,456.7",), ("1,234/-",), ("12,34",), ("5.123",), ("99999999999999999999",)]
    assert [r[0] for r in values(spark, spans, "s string", mlkit.strict_amount(F.col("s")))] == [12345670, 123400, None, None, None]
    refs = [("123456789012",), ("abcd123456789012",), ("n123456789012345",), ("ABCDEFGHIJKLMNOP",), ("12",)]
    assert [r[0] for r in values(spark, refs, "s string", mlkit.strict_reference(F.col("s")))] == ["123456789012", "ABCD123456789012", "N123456789012345", None, None]
    days = {"22-09-26": "2026-09-22", "22.9.1970": "1970-09-22", "22-Sep-70": "1970-09-22", "22Sep26": "2026-09-22", "1st Oct' 2024": "2024-10-01", "22-September-2026": "2026-09-22", "Sep 22, 2026": "2026-09-22", "2026-9-2": "2026-09-02", "14-08": "--08-14", "14/08": "--08-14", "29 Feb": "--02-29", "Feb 30": None, "31-04-25": None, "x": None}
    assert {k: v for k, v in values(spark, [(k,) for k in days], "s string", F.col("s"), mlkit.strict_date(F.col("s")))} == days
