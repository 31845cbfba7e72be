"""Statement files as table rows: doc_id, row_ix, cells.

Text containers are split by column expressions. Binary containers (zip, OLE2) are decoded where they lie, one file at a time in
``mapInPandas``. Defined cases: a file that cannot be decoded gives no row and comes out of ``unreadable``; an empty file gives no row.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROWS = "doc_id string, row_ix int, cells array<string>"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the path), container (the extension) and content of each file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("doc_id"), F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("container"), "content")


def csv_cells(line: Column) -> Column:
    """Cells of a line where quotes toggle and are dropped, trimmed."""
    parts = F.split(line, '"', -1)
    hidden = F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 1, F.replace(x, F.lit(","), F.lit("\uffff"))).otherwise(x)), "")
    return F.transform(F.split(hidden, ",", -1), lambda c: F.btrim(F.replace(c, F.lit("\uffff"), F.lit(","))))


def spaced_cells(line: Column) -> Column:
    """Cells between tabs or runs of spaces."""
    return F.filter(F.transform(F.split(F.replace(line, F.lit("\t"), F.lit("  ")), "  "), lambda c: F.btrim(c)), lambda c: c != "")


def text_rows(files: DataFrame) -> DataFrame:
    """Rows of csv and txt files; empty lines are dropped and rows are numbered without them."""
    text = F.try_validate_utf8(F.col("content").cast("string")) if hasattr(F, "try_validate_utf8") else F.col("content").cast("string")
    lines = F.filter(F.split(text, "\r?\n", -1), lambda x: x != "")
    rows = files.where(F.col("container").isin("csv", "txt")).select("doc_id", "container", F.posexplode(lines).alias("row_ix", "line"))
    return rows.select("doc_id", "row_ix", F.when(F.col("container") == "csv", csv_cells(F.col("line"))).otherwise(spaced_cells(F.col("line"))).alias("cells"))


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def xlsx_sheets(data: bytes) -> list[list[dict[int, str]]]:
    """The sheets of a workbook in order, each row as column → text."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si"):
                shared.append("".join(t.text or "" for t in si.iter(f"{_NS}t")))
        sheets = []
        for name in sorted(n for n in z.namelist() if re.match(r"xl/worksheets/[^/]+\.xml$", n)):
            rows = []
            for row in ElementTree.fromstring(z.read(name)).iter(f"{_NS}row"):
                cells = {}
                for c in row.iter(f"{_NS}c"):
                    v, kind = c.find(f"{_NS}v"), c.get("t")
                    text = "".join(t.text or "" for t in c.iter(f"{_NS}t")) if kind == "inlineStr" else v.text if v is not None else None
                    if text is not None:
                        cells[_column(c.get("r", ""))] = shared[int(text)] if kind == "s" else text
                rows.append(cells)
            sheets.append(rows)
        return sheets


def dense(rows: list[dict[int, str]]) -> list[list[str]]:
    width = max((k + 1 for r in rows for k in r), default=0)
    return [[r.get(i, "").strip() for i in range(width)] for r in rows]


def _ole_stream(data: bytes) -> bytes:
    """The workbook stream of an OLE2 file."""
    if data[:8] != b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
        raise ValueError("not an OLE2 file")
    size, small = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
    first_dir, cutoff = struct.unpack_from("<I", data, 48)[0], struct.unpack_from("<I", data, 56)[0]
    first_mini, first_difat = struct.unpack_from("<I", data, 60)[0], struct.unpack_from("<I", data, 68)[0]
    sector = lambda n: data[(n + 1) * size : (n + 2) * size]
    fat_at = [x for x in struct.unpack_from("<109I", data, 76) if x < 0xFFFFFFFA]
    while first_difat < 0xFFFFFFFA:
        more = struct.unpack(f"<{size // 4}I", sector(first_difat))
        fat_at += [x for x in more[:-1] if x < 0xFFFFFFFA]
        first_difat = more[-1]
    fat = [x for n in fat_at for x in struct.unpack(f"<{size // 4}I", sector(n))]

    def chain(start: int, table: list[int], read) -> bytes:
        out, seen = [], set()
        while start < 0xFFFFFFFA and start not in seen and start < len(table):
            seen.add(start)
            out.append(read(start))
            start = table[start]
        return b"".join(out)

    entries = chain(first_dir, fat, sector)
    root, found = None, None
    for at in range(0, len(entries), 128):
        e = entries[at : at + 128]
        name = e[: max(0, struct.unpack_from("<H", e, 64)[0] - 2)].decode("utf-16-le", "replace")
        start, length = struct.unpack_from("<I", e, 116)[0], struct.unpack_from("<I", e, 120)[0]
        if e[66] == 5:
            root = start
        if name in ("Workbook", "Book"):
            found = (start, length)
    if found is None:
        raise ValueError("no workbook")
    start, length = found
    if length >= cutoff or root is None:
        return chain(start, fat, sector)[:length]
    mini = chain(root, fat, sector)
    mini_fat_raw = chain(first_mini, fat, sector)
    mini_fat = list(struct.unpack(f"<{len(mini_fat_raw) // 4}I", mini_fat_raw))
    return chain(start, mini_fat, lambda n: mini[n * small : (n + 1) * small])[:length]


def _shared_strings(parts: list[bytes]) -> list[str]:
    """Strings of a table record and its continuations; a string may run over into the next part."""
    total, out = struct.unpack_from("<I", parts[0], 4)[0], []
    part, at = 0, 8

    def take(n: int) -> bytes:
        nonlocal part, at
        got = b""
        while n:
            if at >= len(parts[part]):
                part, at = part + 1, 0
            piece = parts[part][at : at + n]
            got, at, n = got + piece, at + len(piece), n - len(piece)
        return got

    for _ in range(total):
        n, flags = struct.unpack("<HB", take(3))
        runs = struct.unpack("<H", take(2))[0] if flags & 8 else 0
        ext = struct.unpack("<I", take(4))[0] if flags & 4 else 0
        text, wide = "", flags & 1
        while len(text) < n:
            if at >= len(parts[part]):
                part, at = part + 1, 0
                wide = parts[part][0] & 1
                at = 1
            room = (len(parts[part]) - at) // (2 if wide else 1)
            k = min(n - len(text), room)
            text += take(k * (2 if wide else 1)).decode("utf-16-le" if wide else "latin-1")
        take(runs * 4 + ext)
        out.append(text)
    return out


def _rk(n: int) -> float:
    value = float(n >> 2) if n & 2 and n < 1 << 31 else float((n >> 2) - (1 << 30)) if n & 2 else struct.unpack("<d", b"\0" * 4 + struct.pack("<I", n & 0xFFFFFFFC))[0]
    return value / 100 if n & 1 else value


def xls_rows(data: bytes) -> list[list[str]]:
    """The first sheet of a BIFF8 workbook; numbers with two decimals."""
    stream, at, records = _ole_stream(data), 0, []
    while at + 4 <= len(stream):
        kind, n = struct.unpack_from("<HH", stream, at)
        records.append((kind, stream[at + 4 : at + 4 + n]))
        at += 4 + n
    shared: list[str] = []
    grid: dict[int, dict[int, str]] = {}
    sheets = 0
    for i, (kind, body) in enumerate(records):
        if kind == 0x809:
            sheets += struct.unpack_from("<H", body, 2)[0] == 0x10
        if kind == 0xFC:
            j = i + 1
            while j < len(records) and records[j][0] == 0x3C:
                j += 1
            shared = _shared_strings([body, *(b for _, b in records[i + 1 : j])])
        if sheets > 1:
            break
        if kind == 0xFD:
            r, c, _, s = struct.unpack_from("<HHHI", body)
            grid.setdefault(r, {})[c] = shared[s]
        elif kind == 0x203:
            r, c, _ = struct.unpack_from("<HHH", body)
            grid.setdefault(r, {})[c] = f"{struct.unpack_from('<d', body, 6)[0]:.2f}"
        elif kind == 0x27E:
            r, c, _, n = struct.unpack_from("<HHHI", body)
            grid.setdefault(r, {})[c] = f"{_rk(n):.2f}"
        elif kind == 0xBD:
            r, c = struct.unpack_from("<HH", body)
            for k in range((len(body) - 6) // 6):
                grid.setdefault(r, {})[c + k] = f"{_rk(struct.unpack_from('<I', body, 6 + 6 * k)[0]):.2f}"
    return dense([grid[r] for r in sorted(grid)])


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for doc, container, data in pdf[["doc_id", "container", "content"]].itertuples(index=False, name=None):
            try:
                rows = dense(max(xlsx_sheets(data), key=len, default=[])) if container == "xlsx" else xls_rows(data)
            except (ValueError, KeyError, IndexError, struct.error, zipfile.BadZipFile, ElementTree.ParseError):
                rows = []
            out += [(doc, i, r) for i, r in enumerate(rows)]
        yield pd.DataFrame(out, columns=["doc_id", "row_ix", "cells"])


def binary_rows(files: DataFrame) -> DataFrame:
    """Rows of xlsx files (the sheet with most rows) and xls files (the first sheet)."""
    return files.where(F.col("container").isin("xlsx", "xls")).select("doc_id", "container", "content").mapInPandas(_decode, _ROWS)


def table_rows(files: DataFrame) -> DataFrame:
    """Rows of all files, by container."""
    return text_rows(files).unionByName(binary_rows(files))


def unreadable(files: DataFrame, rows: DataFrame) -> DataFrame:
    """Files that gave no row."""
    return files.join(rows.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "container")


def line_cells(words: DataFrame, gap: float = 7.0) -> DataFrame:
    """Words with places (doc_id, page, line, x0, x1, text) to rows: a new cell begins where the gap to the word before exceeds ``gap``."""
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id", "page", "line").orderBy("x0")
    w = words.withColumn("_new", F.when(F.col("x0") - F.lag("x1").over(order) > gap, 1).otherwise(0)).withColumn("cell", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    cells = w.groupBy("doc_id", "page", "line", "cell").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda x: x["text"]), " ").alias("t"))
    return cells.groupBy("doc_id", "page", "line").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "t"))), lambda x: x["t"]).alias("cells"))


def banded_cells(words: DataFrame, anchors: DataFrame) -> DataFrame:
    """Words to columns by the header's places: a word belongs to the last column whose left bound is left of its centre.

    ``anchors`` has doc_id, col, left; a document has a handful, so they are gathered to one array for each document.
    """
    bounds = anchors.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("left", "col"))).alias("b"))
    mid = (F.col("x0") + F.col("x1")) / 2
    col = F.coalesce(F.get(F.reverse(F.filter("b", lambda x: x["left"] <= mid)), F.lit(0))["col"], F.get("b", F.lit(0))["col"])
    w = words.join(bounds, "doc_id").withColumn("col", col)
    cells = w.groupBy("doc_id", "page", "line", "col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda x: x["text"]), " ").alias("t"))
    return cells.groupBy("doc_id", "page", "line").agg(F.map_from_entries(F.collect_list(F.struct("col", "t"))).alias("cells"))
