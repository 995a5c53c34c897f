"""Reading statements, workbooks, ledgers and extracts; versioned tables."""

from __future__ import annotations

import csv
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.imports import extraction_transactions, load_extraction

CELLS = "file string, sheet string, row bigint, col int, text string, formula string"
CHUNK = 50_000


def _binary(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern) \
        .option("recursiveFileLookup", "true").load(path).select("path", "content")


def _frames(records: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    """Records in frames of a fixed size, so a long file never becomes one frame."""
    names = ["file", "sheet", "row", "col", "text", "formula"]
    held: list[tuple] = []
    for r in records:
        held.append(r)
        if len(held) >= CHUNK:
            yield pd.DataFrame(held, columns=names)
            held = []
    if held:
        yield pd.DataFrame(held, columns=names)


def _csv_cells(path: str, content: bytes) -> Iterator[tuple]:
    name = posixpath.basename(path)
    # A quoted field may be as long as its file.
    csv.field_size_limit(2**31 - 1)
    text = io.TextIOWrapper(io.BytesIO(content), encoding="utf-8-sig", newline="", errors="replace")
    for i, row in enumerate(csv.reader(text), 1):
        for j, value in enumerate(row, 1):
            if value != "":
                yield name, name.rsplit(".", 1)[0], i, j, value, None


def read_csv_grid(spark: SparkSession, path: str, pattern: str = "*.{csv,txt}") -> DataFrame:
    """Delimited statements as cells: quotes, embedded newlines and blank lines kept,
    no header assumed.  One task per group of files; empty cells are not listed."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path_, content in zip(b["path"], b["content"]):
                yield from _frames(_csv_cells(path_, content))
    return _binary(spark, path, pattern).mapInPandas(read, CELLS)


def undecodable_files(spark: SparkSession, path: str, pattern: str = "*.{csv,txt}") -> DataFrame:
    """Files that are not UTF-8: their cells hold U+FFFD where bytes could not be read."""
    return _binary(spark, path, pattern).filter(~F.is_valid_utf8(F.col("content").cast("string"))) \
        .select(F.element_at(F.split("path", "/"), -1).alias("file"))


# Number formats a spreadsheet has built in for dates.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 27, 30, 36, 45, 46, 47, 50, 57}
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {}
    for f in root.iter(f"{_MAIN}numFmt"):
        bare = re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", ""))
        own[int(f.get("numFmtId"))] = re.search("[dmyh]", bare, re.I) is not None
    found = root.find(f"{_MAIN}cellXfs")
    ids = [int(x.get("numFmtId", 0)) for x in (found if found is not None else [])]
    return {i for i, n in enumerate(ids) if n in DATE_FORMATS or own.get(n)}


def _column(ref: str) -> int:
    n = 0
    for ch in re.sub("[^A-Z]", "", ref.upper()):
        n = n * 26 + ord(ch) - 64
    return n


# A quoted text or sheet name, or a cell reference that is no part of a longer name.
_REFERENCE = re.compile(r'''"[^"]*"|'[^']*'|(?<![\w.$])(\$?)([A-Z]{1,3})(\$?)(\d+)(?![\w(.!])''')


def _letters(n: int) -> str:
    out = ""
    while n > 0:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def _shifted(formula: str, down: int, right: int) -> str:
    """A formula as it reads in a cell further down and right; what a dollar sign fixes stays."""
    def moved(m: re.Match) -> str:
        if m[2] is None:
            return m[0]
        col = _column(m[2]) + (0 if m[1] else right)
        row = int(m[4]) + (0 if m[3] else down)
        return f"{m[1]}{_letters(col)}{m[3]}{row}" if col > 0 and row > 0 else "#REF!"
    return _REFERENCE.sub(moved, formula)


def _iso(serial: float) -> str | None:
    if not 1 <= serial <= 2958465:
        return None
    days = int(serial // 1) - (25569 if serial > 60 else 25568)
    return str((pd.Timestamp("1970-01-01") + pd.Timedelta(days=days)).date())


def _text_of(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def _workbook_cells(path: str, content: bytes) -> Iterator[tuple]:
    book = zipfile.ZipFile(io.BytesIO(content))
    names = set(book.namelist())
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = [_text_of(si) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
    dates = _date_styles(book)
    targets = {}
    if "xl/_rels/workbook.xml.rels" in names:
        for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
            targets[r.get("Id")] = "xl/" + re.sub("^/?(xl/)?", "", r.get("Target", ""))
    sheets = [(s.get("name"), targets.get(s.get(_REL))) for s in
              ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")]
    for sheet, part in sheets:
        if part not in names:
            continue
        row_no = 0
        filled: dict[str, tuple[int, int, str]] = {}
        # Streamed: a sheet is never held as a tree.
        for _, el in ElementTree.iterparse(book.open(part)):
            if el.tag != f"{_MAIN}row":
                continue
            row_no = int(el.get("r", row_no + 1))
            col = 0
            for c in el.iter(f"{_MAIN}c"):
                col = _column(c.get("r")) if c.get("r") else col + 1
                v, f, kind = c.find(f"{_MAIN}v"), c.find(f"{_MAIN}f"), c.get("t", "n")
                raw = (v.text or "") if v is not None else ""
                if kind == "s":
                    value = shared[int(raw)] if raw.isdigit() and int(raw) < len(shared) else ""
                elif kind == "inlineStr":
                    value = _text_of(c)
                elif kind == "b":
                    value = "TRUE" if raw == "1" else "FALSE"
                elif kind == "n" and raw and int(c.get("s", -1)) in dates:
                    value = _iso(float(raw)) or raw
                else:
                    value = raw
                written = f.text if f is not None else None
                if f is not None and f.get("t") == "shared":
                    # The first cell of a filled range holds its formula; the others name it.
                    if written:
                        filled[f.get("si")] = (row_no, col, written)
                    elif f.get("si") in filled:
                        r0, c0, first = filled[f.get("si")]
                        written = _shifted(first, row_no - r0, col - c0)
                formula = "=" + written if written else None
                if value != "" or formula:
                    yield posixpath.basename(path), sheet, row_no, col, value, formula
            el.clear()


def workbook_cells(books: DataFrame) -> DataFrame:
    """Cells of workbooks given as ``path, content``: dates as ISO text, formulas
    beside their values.  Workbooks are read in parallel, each as a stream of rows."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path_, content in zip(b["path"], b["content"]):
                yield from _frames(_workbook_cells(path_, content))
    return books.select("path", "content").mapInPandas(read, CELLS)


def read_workbooks(spark: SparkSession, path: str, pattern: str = "*.xls[xm]") -> DataFrame:
    """Every workbook under a folder as cells."""
    return workbook_cells(_binary(spark, path, pattern))


# Everything a screen or report reads; the derived search text and key stay behind.
LEDGER_COLUMNS = ["transaction_id", "card_id", "txn_date", "entry_type", "status", "review_reason", "description", "direction",
                  "amount_aed", "included_in_source_balance", "currency", "original_amount", "currency_raw", "exchange_rate",
                  "exchange_rate_formula", "supplier_raw", "req_number", "lpo_number", "invoice", "payment_ref", "account", "crm",
                  "client", "event_end", "sales_operation", "notes", "source_sheet", "source_row", "source_date_raw",
                  "date_repaired", "rate_review_note", "created_at"]


def read_ledger(spark: SparkSession, path: str, columns: Sequence[str] = LEDGER_COLUMNS) -> tuple[DataFrame, DataFrame]:
    """(transactions, accounts) of a stored ledger, named columns only."""
    return (spark.read.parquet(f"{path}/transactions").select(*columns), spark.read.parquet(f"{path}/accounts"))


def write_ledger(txn: DataFrame, acct: DataFrame, path: str) -> None:
    txn.write.mode("overwrite").parquet(f"{path}/transactions")
    acct.write.mode("overwrite").parquet(f"{path}/accounts")


def read_extraction(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(accounts, transactions) of nested per-account documents, one JSON object per line."""
    cards = spark.read.schema(schema).json(path)
    return load_extraction(cards), extraction_transactions(cards)


def write_snapshot(df: DataFrame, path: str, version: int) -> None:
    """One immutable version of a table, written before a change."""
    df.write.mode("errorifexists").parquet(f"{path}/version={version:010d}")


def read_snapshot(spark: SparkSession, path: str, version: int) -> DataFrame:
    """The table as it was at ``version``."""
    return spark.read.parquet(f"{path}/version={version:010d}")


def restore_snapshot(spark: SparkSession, path: str, version: int, as_version: int) -> DataFrame:
    """Put an older version back as the newest one; nothing is deleted."""
    write_snapshot(read_snapshot(spark, path, version), path, as_version)
    return read_snapshot(spark, path, as_version)


def cell_counts(cells: DataFrame) -> DataFrame:
    return cells.groupBy("file", "sheet").agg(F.count(F.lit(1)).alias("cells"), F.max("row").alias("last_row"))
