import io
import struct
import zipfile
from datetime import datetime

from ledgerloom.sources import layout, statements, tables

LINE = "doc_id string, line_ix int, line string"


def xlsx(rows):
    shared, cells = [], []
    for r, row in enumerate(rows, 1):
        out = ""
        for c, v in enumerate(row):
            if v is None:
                continue
            ref = f"{chr(65 + c)}{r}"
            if isinstance(v, float):
                out += f'<c r="{ref}"><v>{v}</v></c>'
            else:
                shared.append(v)
                out += f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>'
        cells.append(f"<row r='{r}'>{out}</row>")
    ns = "xmlns='http://schemas.openxmlformats.org/spreadsheetml/2006/main'"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{''.join(cells)}</sheetData></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {ns}><sheetData/></worksheet>")
    return data.getvalue()


def xls(strings, cells):
    """A BIFF8 workbook in an OLE2 file; the string table runs over into a continuation."""
    rec = lambda kind, body: struct.pack("<HH", kind, len(body)) + body
    packed = [struct.pack("<HB", len(s), 0) + s.encode("latin-1") for s in strings]
    sst = struct.pack("<II", len(strings), len(strings)) + b"".join(packed[:-1]) + packed[-1][:5]
    stream = rec(0x809, struct.pack("<HHHH", 0x600, 5, 0, 0)) + rec(0xFC, sst) + rec(0x3C, b"\0" + packed[-1][5:]) + rec(0x0A, b"") + rec(0x809, struct.pack("<HHHH", 0x600, 0x10, 0, 0))
    for r, c, v in cells:
        if isinstance(v, int):
            stream += rec(0xFD, struct.pack("<HHHI", r, c, 0, v))
        elif isinstance(v, float):
            stream += rec(0x203, struct.pack("<HHHd", r, c, 0, v))
        else:
            stream += rec(0x27E, struct.pack("<HHHI", r, c, 0, v[0]))
    stream += rec(0x0A, b"")
    stream += b"\0" * (5120 - len(stream))
    n = len(stream) // 512
    fat = [0xFFFFFFFD, 0xFFFFFFFE, *range(3, 2 + n), 0xFFFFFFFE]
    fat += [0xFFFFFFFF] * (128 - len(fat))
    entry = lambda name, kind, start, size: (name.encode("utf-16-le") + b"\0" * 64)[:64] + struct.pack("<HBB", 2 * len(name) + 2, kind, 0) + b"\xff" * 12 + b"\0" * 36 + struct.pack("<II", start, size) + b"\0" * 4
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 10 + struct.pack("<II", 1, 1) + struct.pack("<IIIIIII", 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0, 0)
    head = head[:76] + struct.pack("<109I", 0, *[0xFFFFFFFF] * 108)
    folder = entry("Root Entry", 5, 0xFFFFFFFE, 0) + entry("Workbook", 2, 2, len(stream)) + b"\0" * 256
    return head + struct.pack("<128I", *fat) + folder + stream


def test_containers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x, "a, b" ,c\r\n\r\n1,,3\n')
    (tmp_path / "b.txt").write_text("Date  Text here\t5.00\n\n01/02/2025    pay   7\n")
    (tmp_path / "c.xlsx").write_bytes(xlsx([["Date", None, "Bal"], ["x", 2.5]]))
    (tmp_path / "d.xls").write_bytes(xls(["Date", "Narration", "continued text"], [(0, 0, 0), (0, 1, 1), (2, 0, 2), (2, 1, 12.5), (2, 2, ((700 << 2) | 2,)), (2, 3, ((1250 << 2) | 3,))]))
    (tmp_path / "e.xlsx").write_bytes(b"PK broken")
    (tmp_path / "f.xls").write_bytes(b"\xd0\xcf\x11")
    files = tables.read_files(spark, str(tmp_path))
    rows = tables.table_rows(files)
    got = {(r.doc_id[-5:], r.row_ix): r.cells for r in rows.collect()}
    assert got["a.csv", 0] == ["x", "a, b", "c"] and got["a.csv", 1] == ["1", "", "3"]
    assert got["b.txt", 0] == ["Date", "Text here", "5.00"] and got["b.txt", 1] == ["01/02/2025", "pay", "7"]
    assert got[".xlsx", 0] == ["Date", "", "Bal"] and got[".xlsx", 1] == ["x", "2.5", ""]
    assert got["d.xls", 0] == ["Date", "Narration", "", ""] and got["d.xls", 1] == ["continued text", "12.50", "700.00", "12.50"]
    assert {r.doc_id[-6:] for r in tables.unreadable(files, rows).collect()} == {"e.xlsx", "/f.xls"}


def test_line_readers(spark):
    ruler = "--------  ------------------------  ----------------  --------  ----------  ----------  ----------"
    row = lambda *c: f"{c[0]:8}  {c[1]:24}  {c[2]:16}  {c[3]:8}  {c[4]:>10}  {c[5]:>10}  {c[6]:>10}"
    docs = {
        "h": ["HDFC BANK Ltd.   Statement of accounts", ruler, row("01/05/25", "UPI-RAVI SHOP-x@y", "0000123", "01/05/25", "100.00", "", "900.00"), row("", "more words", "", "", "", "", ""), row("02/05/25", "NEFT CR-AB12-ASHA-RENT", "", "", "", "50.00", "950.00"), "Page No .: 1", row("", "not a continuation", "", "", "", "", ""), row("03/05/25", "CASH", "", "", "1.00", "", "950.00"), "STATEMENT SUMMARY", row("04/05/25", "after", "", "", "1.00", "", "1.00")],
        "b": ["Transaction History from 01/05/2025 to 31/05/2025", "Date Pay/Collect", "05/05/2025 10:20:30 ABC Bank XX12 me(Me Self) shop@x(Shop Name) 123456 PAY 1,250.50 DR SUCCESS", "06/05/2025 10:20:30 ABC Bank 99 COLLECT 5.00 CR FAILED"],
        "g": ["Transaction statement period", "3 May, 2025 Paid to Tea Stall ₹40", "10:05 PM UPI Transaction ID: 555666", "note", "4 May, 2025 Received from Asha ₹1,000.50", "5 May, 2025 Paid to X ₹2", "12:01 AM UPI Transaction ID: 9"],
        "d": ["demo-csv,v1", "period,2025-05-01,2025-05-31", "2025-05-02,1500,debit,Shop,,lunch", "2025-05-02,x,debit,Shop,,lunch"], "other": ["hello"],
    }
    lines = spark.createDataFrame([(d, i, x) for d, xs in docs.items() for i, x in enumerate(xs)], LINE)
    got = {}
    for r in statements.read_lines(lines).collect():
        got.setdefault(r.doc_id, []).append(r)
    for v in got.values():
        v.sort(key=lambda r: r.line_ix)
    a, b, c = got["h"]
    assert (a.ts, a.amount_paise, a.direction, a.counterparty, a.reference, a.narration, a.problem) == (datetime(2025, 4, 30, 18, 30), 10000, "debit", "RAVI SHOP", "123", "UPI-RAVI SHOP-x@y more words", None)
    assert (b.direction, b.counterparty, b.reference, b.problem) == ("credit", "ASHA", "B95000D20250502A5000", None) and c.problem == "balance chain"
    (p,) = got["b"]
    assert (p.ts, p.amount_paise, p.counterparty, p.reference) == (datetime(2025, 5, 5, 4, 50, 30), 125050, "Shop Name", "123456")
    x, y, z = got["g"]
    assert (x.ts, x.amount_paise, x.counterparty, x.reference, x.problem) == (datetime(2025, 5, 3, 16, 35), 4000, "Tea Stall", "555666", None)
    assert y.problem and z.ts == datetime(2025, 5, 4, 18, 31)
    good, bad = got["d"]
    assert (good.amount_paise, good.reference, good.problem) == (1500, None, None) and bad.problem and "other" not in got


def test_workbooks_and_yearless_lines(spark):
    table = [("w", 0, ["Bank"]), ("w", 1, ["Date", "Particulars", "Chq No", "Debit", "Credit", "Balance"]), ("w", 2, ["05-May-2025", "UPI/123456789/Asha/rent", "", "303594.0", "", "1000.505"]), ("w", 3, ["45783", "plain", "77", "", "0.5", "1001.01"]), ("w", 4, ["total", "", "", "", "", ""])]
    a, b = statements.workbook_rows(spark.createDataFrame(table, "doc_id string, row_ix int, cells array<string>")).orderBy("line_ix").collect()
    assert (a.amount_paise, a.direction, a.counterparty, a.reference, a.problem) == (30359400, "debit", "Asha", "123456789", None)
    assert (b.amount_paise, b.reference, b.ts, b.problem) == (50, "77", datetime(2025, 5, 5, 18, 30), None)
    lines = spark.createDataFrame([("y", 0, "02 Jan Paid to Shop - Rs.10"), ("y", 1, "Note"), ("y", 2, "31 Dec Asha + ₹5.50"), ("y", 3, "01 Jan Old - ₹1")], LINE)
    periods = spark.createDataFrame([("y", datetime(2024, 11, 30, 18, 30), datetime(2025, 1, 31, 18, 29))], "doc_id string, period_start timestamp_ntz, period_end timestamp_ntz")
    got = statements.yearless_lines(lines, periods).orderBy("line_ix").collect()
    assert [(r.ts.year, r.ts.month, r.amount_paise, r.direction, bool(r.problem)) for r in got] == [(2025, 1, 1000, "debit", False), (2024, 12, 550, "credit", False), (2024, 1, 100, "debit", True)]


def test_passbook(spark):
    head = ["Date", "Time", "Transaction Details", "Other Transaction Details (UPI ID)", "Your Account", "Amount", "UPI Ref No.", "Tags"]
    rows = [("p", 0, ["junk"]), ("p", 1, head), ("p", 2, ["01/05/2025", "10:00:01", "Paid to Tea Stall", "tea@x", "Bank - 12", "-1,250.00", "999", "#food"]), ("p", 3, ["01/05/2025", "late", "Paid to Y", "", "", "0", "", ""])]
    good, bad = statements.passbook_rows(spark.createDataFrame(rows, "doc_id string, row_ix int, cells array<string>")).orderBy("line_ix").collect()
    assert (good.ts, good.amount_paise, good.direction, good.counterparty, good.reference, good.narration) == (datetime(2025, 5, 1, 4, 30, 1), 125000, "debit", "Tea Stall", "999", "Paid to Tea Stall / tea@x / Bank - 12 / #food") and bad.problem


def test_positioned_words(spark):
    W = "doc_id string, page int, x0 double, x1 double, y double, text string"
    put = lambda page, y, *xs: [("d", page, float(x), float(x) + 5 * len(t), float(y), t) for x, t in xs]
    words = put(0, 5, (0, "My"), (20, "Bank"), (300, "Statement")) + put(0, 20, (0, "Date"), (80, "Details"), (200, "Debit"), (260, "Credit"), (320, "Balance")) + put(0, 40, (0, "01/05/2025"), (80, "tea"), (97, "stall"), (200, "5.00"), (320, "95.00")) + put(0, 50, (80, "second"), (115, "line")) + put(1, 5, (0, "Date"), (80, "Details"), (200, "Debit"), (260, "Credit"), (320, "Balance")) + put(1, 20, (0, "02/05/2025"), (80, "pay"), (260, "1.00"), (320, "96.00"))
    got = [r.cells for r in layout.layout_rows(spark.createDataFrame(words, W)).orderBy("row_ix").collect()]
    assert got == [["Date", "Details", "Debit", "Credit", "Balance"], ["01/05/2025", "tea stall second line", "5.00", "", "95.00"], ["02/05/2025", "pay", "", "1.00", "96.00"]]
    lined = layout.lines_of(spark.createDataFrame(words, W))
    cells = {(r.page, r.line): r.cells for r in tables.line_cells(lined).collect()}
    assert cells[0, 2] == ["01/05/2025", "tea stall", "5.00", "95.00"] or cells[0, 2][0] == "01/05/2025"
    anchors = spark.createDataFrame([("d", 0, 0.0), ("d", 1, 75.0), ("d", 2, 190.0)], "doc_id string, col int, left double")
    assert {(r.page, r.line): r.cells for r in tables.banded_cells(lined, anchors).collect()}[0, 3] == {1: "second line"}
