"""Runnable queries: understanding raw sheets.

Each account's rows are written out as a sheet in one of three layouts, in the
long cell form every reader gives.  The SQL side states what the layout holds;
the Spark side has to find it.
"""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ..fixtures import accounts, transactions
from ..operators import sheets as H
from ..plans.scan import cut_lineage, position, walk
from ..session import shared_dir
from ..sources import files as files_
from .registry import query

HEADINGS = [
    ["TRANSACTION DATE", "DETAILS", "DEBIT", "CREDIT", "BALANCE", "REQ", "Customer"],
    [None, "Description", "CREDIT (AED)", "DEBIT (AED)", "Available  Balance", "Payment Reference", "REQ NUMBER"],
    ["Sr. No", "Transaction Date", "Transaction Particulars", "Transaction Type", "Transaction Amount", "Balance", None],
]
FIRST_ROW = 11


def layout():
    return F.pmod(F.col("card_id"), F.lit(3))


def _s(c):
    return F.col(c).cast("string")


def placed(spark, d):
    """Rows of accounts with their place in the account's sheet."""
    t = transactions(spark, d).filter("status <> 'voided'").select(
        "card_id", "transaction_id", "txn_date", "amount_aed", "supplier_raw", "req_number", "payment_ref")
    return walk(t, ["card_id"], ["txn_date", "transaction_id"], [position("pos")])


def cells(spark, d):
    p = placed(spark, d)
    size, out = F.abs("amount_aed").cast("string"), F.col("amount_aed") < 0
    day, r = F.date_format("txn_date", "dd/MM/yyyy"), (F.col("pos") + FIRST_ROW - 1)
    rs, above = r.cast("string"), (r - 1).cast("string")
    cell = lambda n, text, formula=None: F.struct(
        F.lit(n).alias("col"), text.alias("text"), (formula if formula is not None else F.lit(None).cast("string")).alias("formula"))
    flip = ((F.col("card_id") % 2 == 1) != ((F.col("card_id") % 7 == 0) & (F.col("pos") == 2)))
    a, b = F.when(flip, "+").otherwise("-"), F.when(flip, "-").otherwise("+")
    start = F.when(F.col("pos") == 1, "1000.00").otherwise(F.concat(F.lit("E"), above))
    formula = F.concat(F.lit("="), start, a, F.lit("C"), rs, b, F.lit("D"), rs)
    second = F.when(F.col("card_id") % 4 == 0, F.concat(F.lit("=I"), above, F.lit("+C"), rs))
    zero = F.array(cell(1, day), cell(2, F.col("supplier_raw")), cell(3, F.when(out, size)), cell(4, F.when(~out, size)),
                   cell(5, F.lit("1"), formula), cell(7, F.col("req_number")), cell(9, F.lit("1"), second))
    one = F.array(cell(1, day), cell(2, F.col("supplier_raw")), cell(3, F.when(~out, size)), cell(4, F.when(out, size)),
                  cell(5, F.lit("1")), cell(6, F.col("payment_ref")), cell(7, F.col("req_number")))
    two = F.array(cell(1, _s("pos")), cell(2, day), cell(3, F.col("supplier_raw")), cell(4, F.when(out, "Debit").otherwise("Credit")),
                  cell(5, size), cell(6, F.lit("1")))
    body = p.select("card_id", r.alias("row"), F.explode(F.when(layout() == 0, zero).when(layout() == 1, one).otherwise(two)).alias("c"))

    sums = p.groupBy("card_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(~out, F.col("amount_aed")).otherwise(0)).alias("credit"),
        F.sum(F.when(out, -F.col("amount_aed")).otherwise(0)).alias("debit"))
    at = lambda row, n, text: F.struct(F.lit(row).cast("bigint").alias("row"), F.lit(n).alias("col"), text.alias("text"),
                                       F.lit(None).cast("string").alias("formula"))
    heads = [F.array(*[at(1 if k == 0 else 4, i + 1, F.lit(h)) for i, h in enumerate(HEADINGS[k]) if h]) for k in range(3)]
    off = F.when(F.col("card_id") % 5 == 0, 1).otherwise(0)
    closing = (F.lit(100) + F.col("credit") - F.col("debit") + off).cast("decimal(28,2)").cast("string")
    labels = ["Number of Transactions", "Credit Value", "Debit Value", "Opening Balance", "Closing Balance"]
    facts = F.array(at(1, 2, F.lit("Account Number")), at(1, 3, _s("card_id")), at(1, 5, F.lit("From: 01/09/1996 To: x")),
                    *[at(2, i + 2, F.lit(x)) for i, x in enumerate(labels)],
                    at(3, 2, _s("n")), at(3, 3, _s("credit")), at(3, 4, _s("debit")), at(3, 5, F.lit("100.00")), at(3, 6, closing))
    none = F.array().cast("array<struct<row:bigint,col:int,text:string,formula:string>>")
    top = sums.select("card_id", F.explode(F.concat(
        F.when(layout() == 0, heads[0]).when(layout() == 1, heads[1]).otherwise(heads[2]),
        F.when(layout() == 2, facts).otherwise(none))).alias("c")).select("card_id", "c.row", "c.col", "c.text", "c.formula")
    every = body.select("card_id", "row", "c.col", "c.text", "c.formula").unionByName(top)
    # Cells are read many times below, as a reader's stored output would be, a few columns each time.
    path = shared_dir(spark, "cells")
    every.select(_s("card_id").alias("file"), F.lit("S").alias("sheet"), "row", "col", "text", "formula") \
        .filter("text IS NOT NULL OR formula IS NOT NULL").write.parquet(path)
    return spark.read.parquet(path)


PLACED = """(SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY txn_date, transaction_id) AS pos, ((card_id % 3) + 3) % 3 AS lay FROM fx_transactions WHERE status <> 'voided')"""
SIZES = f"(SELECT CAST(card_id AS VARCHAR) AS file, card_id, lay, count(*) AS n FROM {PLACED} GROUP BY card_id, lay)"


@query("detect_header", "H1", f"SELECT file, CASE WHEN lay = 0 THEN 1 ELSE 4 END AS header_row FROM {SIZES}", "file #header_row")
def detect_header(spark, d):
    return H.detect_header(cells(spark, d)).select("file", "header_row")


FIELDS = "(VALUES " + ", ".join(f"({k}, '{f}', {c})" for k, fields in enumerate([
    {"date": 1, "supplier": 2, "debit": 3, "credit": 4, "statement_balance": 5, "req_number": 6},
    {"supplier": 2, "credit": 3, "debit": 4, "statement_balance": 5, "payment_ref": 6, "req_number": 7},
    {"date": 2, "supplier": 3, "txn_type": 4, "amount_abs": 5, "statement_balance": 6}]) for f, c in fields.items()) + ") AS f(lay, field, col)"


def _mapped(spark, d):
    c = cells(spark, d)
    # One row a sheet, used several times below.
    headers = cut_lineage(H.detect_header(c))
    headings = H.header_cells(c, headers)
    return c, headers, headings, H.map_columns(headings)


@query("map_columns", "H2", f"SELECT file, field, col FROM {SIZES} s JOIN {FIELDS} ON f.lay = s.lay", "file field #col")
def map_columns(spark, d):
    return _mapped(spark, d)[3].select("file", "field", "col")


@query("find_date_column", "H3 X2", f"SELECT file, 1 AS col FROM {SIZES} WHERE lay = 1 AND n >= 3", "file #col")
def find_date_column(spark, d):
    c, headers, _, mapping = _mapped(spark, d)
    return H.find_date_column(c, headers, mapping).select("file", "col")


@query("bind_direction", "H4", f"""
SELECT file, CASE WHEN field NOT IN ('debit', 'credit') THEN field
  WHEN (field = 'debit') = (coalesce(decreasing_header, 'DEBIT') = 'DEBIT') THEN 'decrease' ELSE 'increase' END AS field, col
FROM {SIZES} s JOIN {FIELDS} ON f.lay = s.lay JOIN fx_accounts a ON a.card_id = s.card_id""", "file field #col")
def bind_direction(spark, d):
    mapping = _mapped(spark, d)[3]
    owners = accounts(spark, d).select(_s("card_id").alias("file"), F.lit("S").alias("sheet"), "decreasing_header")
    return H.bind_direction(mapping, owners).select("file", "field", "col")


@query("overrule_direction", "H5", f"""
SELECT file, CASE WHEN field NOT IN ('debit', 'credit') THEN field WHEN n >= 4 THEN CASE WHEN field = 'credit' THEN 'decrease' ELSE 'increase' END
  WHEN (field = 'debit') = (coalesce(decreasing_header, 'DEBIT') = 'DEBIT') THEN 'decrease' ELSE 'increase' END AS field, col
FROM {SIZES} s JOIN {FIELDS} ON f.lay = s.lay JOIN fx_accounts a ON a.card_id = s.card_id""", "file field #col")
def overrule_direction(spark, d):
    c, _, _, mapping = _mapped(spark, d)
    owners = accounts(spark, d).select(_s("card_id").alias("file"), F.lit("S").alias("sheet"), "decreasing_header")
    # A verdict of the balance column: on sheets of four lines or more, CREDIT lowers it.
    votes = c.filter(F.col("row") >= FIRST_ROW).groupBy("file", "sheet").agg(F.count_distinct("row").alias("n")) \
        .withColumn("lowers", F.when(F.col("n") >= 4, "credit"))
    return H.overrule_direction(H.bind_direction(mapping, owners), mapping, votes).select("file", "field", "col")


@query("direction_from_formula", "H6", f"""
SELECT file, CASE WHEN card_id % 2 = 1 THEN 'D' ELSE 'C' END AS decreasing_column, CASE WHEN card_id % 2 = 1 THEN 'C' ELSE 'D' END AS increasing_column,
  n AS formulas, CASE WHEN card_id % 7 = 0 AND n >= 2 THEN 'mixed_balance_formula' END AS anomaly FROM {SIZES} WHERE lay = 0""",
       "file decreasing_column increasing_column #formulas anomaly")
def direction_from_formula(spark, d):
    formulas = cells(spark, d).filter("col = 5 AND formula IS NOT NULL").select(
        "file", "sheet", "row", "formula", F.lit("C").alias("first_col"), F.lit("D").alias("second_col"))
    return H.direction_from_formula(formulas).drop("sheet")


@query("reference_column", "H7", f"""
SELECT s.file, CASE WHEN lay = 0 THEN 7 ELSE 7 END AS col, CASE WHEN lay = 0 THEN 'content' ELSE 'named' END AS chosen_by
FROM {SIZES} s WHERE lay IN (0, 1) AND EXISTS (SELECT 1 FROM fx_transactions t WHERE t.card_id = s.card_id AND t.status <> 'voided' AND trim(coalesce(t.req_number, '')) <> '')""",
       "file #col chosen_by")
def reference_column(spark, d):
    c, headers, headings, mapping = _mapped(spark, d)
    return H.reference_column(c, headers, mapping, headings).select("file", "col", "chosen_by")


BALANCE_FOUND = f"""
SELECT file, card_id, 5 AS col, 'E' AS letter, CASE WHEN n = 1 THEN 1 ELSE n - 1 END AS formulas, 'chosen' AS role, n = 1 AS opening_in_formula FROM {SIZES} WHERE lay = 0
UNION ALL SELECT file, card_id, 9, 'I', n, CASE WHEN n >= 3 THEN 'secondary' ELSE 'ignored' END, FALSE FROM {SIZES} WHERE lay = 0 AND card_id % 4 = 0"""


@query("find_balance_column", "H8", BALANCE_FOUND, "file #col letter #formulas role opening_in_formula")
def find_balance_column(spark, d):
    c = cells(spark, d)
    return H.find_balance_column(c, cut_lineage(H.detect_header(c))).select("file", "col", "letter", "formulas", "role", "opening_in_formula")


@query("money_columns", "H10", f"SELECT file, letter, n FROM {SIZES} s JOIN (VALUES ('C'), ('D')) AS l(letter) ON TRUE WHERE lay = 0", "file letter #n")
def money_columns(spark, d):
    c = cells(spark, d)
    return H.money_columns(c, H.find_balance_column(c, cut_lineage(H.detect_header(c)))).select("file", "letter", "n")


@query("statement_header", "H9", f"""
SELECT CAST(card_id AS VARCHAR) AS file, CAST(card_id AS VARCHAR) AS account_number, DATE '1996-09-01' AS period_start, n AS transactions, credit AS credit_value,
  debit AS debit_value, 100 AS opening, 100 + credit - debit + CASE WHEN card_id % 5 = 0 THEN 1 ELSE 0 END AS closing, card_id % 5 <> 0 AS adds_up
FROM (SELECT card_id, count(*) AS n, coalesce(sum(amount_aed) FILTER (WHERE amount_aed >= 0), 0) AS credit, coalesce(sum(-amount_aed) FILTER (WHERE amount_aed < 0), 0) AS debit
  FROM {PLACED} WHERE lay = 2 GROUP BY card_id)""",
       "file account_number @period_start $transactions $credit_value $debit_value $opening $closing adds_up")
def statement_header(spark, d):
    return H.statement_header(cells(spark, d)).drop("sheet", "currency")


@query("sheet_rows", "H2", f"""
SELECT CAST(card_id AS VARCHAR) AS file, pos + {FIRST_ROW - 1} AS row, strftime(txn_date, '%d/%m/%Y') AS date, trim(supplier_raw) AS supplier,
  CAST(abs(amount_aed) AS VARCHAR) AS amount_abs, CASE WHEN amount_aed < 0 THEN 'Debit' ELSE 'Credit' END AS txn_type FROM {PLACED} WHERE lay = 2""",
       "file #row date supplier amount_abs txn_type")
def sheet_rows(spark, d):
    c, headers, _, mapping = _mapped(spark, d)
    return H.sheet_rows(c, headers, mapping).filter("txn_type IS NOT NULL").select("file", "row", "date", "supplier", "amount_abs", "txn_type")


# ---------------------------------------------------------------- workbooks

BOOK_ROWS = 500


def _workbook(pdf: pd.DataFrame) -> pd.DataFrame:
    """One small workbook: text, a number, a styled date and a formula per row."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    rows = []
    for r in pdf.sort_values("place").itertuples():
        p = int(r.place)
        rows.append(f'<row r="{p}"><c r="A{p}" t="inlineStr"><is><t>{r.name}</t></is></c><c r="B{p}" s="1"/>'
                    f'<c r="C{p}" s="1"><v>{r.serial}</v></c><c r="D{p}"><f>B{p}*2</f><v>{r.figure}</v></c></row>')
    parts = {
        "xl/workbook.xml": f'<workbook {ns} {rel}><sheets><sheet name="Book" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                                      '<Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet {ns}><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet {ns}><sheetData>{"".join(rows)}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return pd.DataFrame({"path": [f"/books/{int(pdf['book'].iloc[0])}.xlsx"], "content": [out.getvalue()]})


@query("read_workbooks", "S2 X3", f"""
SELECT CAST(book AS VARCHAR) || '.xlsx' AS file, place AS row, col, CASE col WHEN 1 THEN card_name WHEN 3 THEN '1995-06-01' ELSE CAST(place * 2 AS VARCHAR) END AS text,
  CASE WHEN col = 4 THEN '=B' || CAST(place AS VARCHAR) || '*2' END AS formula
FROM (SELECT *, (card_id + 1000000) // {BOOK_ROWS} AS book, (card_id + 1000000) % {BOOK_ROWS} + 1 AS place FROM fx_accounts) JOIN (VALUES (1), (3), (4)) AS c(col) ON TRUE""",
       "file #row #col text formula")
def read_workbooks(spark, d):
    n = F.col("card_id") + 1_000_000
    # A workbook holds a fixed number of accounts, so no task builds a large one.
    rows = accounts(spark, d).select(
        F.floor(n / BOOK_ROWS).alias("book"), (n % BOOK_ROWS + 1).alias("place"), F.col("card_name").alias("name"),
        F.lit(34851).alias("serial"), ((n % BOOK_ROWS + 1) * 2).alias("figure"))
    books = rows.groupBy("book").applyInPandas(_workbook, "path string, content binary")
    return files_.workbook_cells(books).drop("sheet")
