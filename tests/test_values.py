"""Cell values: the literals the rules were written against."""

import datetime as dt
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallywise.functions import amounts as A
from tallywise.functions import dates as D
from tallywise.functions import keys as K
from tallywise.functions import text as X


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("r")).first().r


@pytest.mark.parametrize("text, want", [
    ("7.6363552748566696E-2", "0.076363552748566696"), ("1,234.56", "1234.56"), ("AED 500.00", "500"), (" 75.25 ", "75.25"),
    ("(500)", "-500"), ("1.234,56", "1234.56"), (" 12,5 ", "12.5"), ("(1.5e2)", "-150"), ("-20", "-20"), ("5.", "5")])
def test_amounts(spark, text, want):
    assert one(spark, A.parse_amount(F.col("t")), t=text) == Decimal(want)


@pytest.mark.parametrize("text", ["", "   ", "see note", "-", ".", "1-2", "1,2,3,4.5.6", None, "1.2.3,4,5"])
def test_words_are_not_zero(spark, text):
    assert one(spark, A.parse_amount(F.col("t")), t=text) is None


@pytest.mark.parametrize("text, day_first, iso, ambiguous", [
    ("28/01/2026", False, "2026-01-28", False), ("03/04/2026", True, "2026-04-03", True), ("03/04/2026", False, "2026-03-04", True),
    ("5 Sep 2026", True, "2026-09-05", False), ("Sept 5, 26", True, "2026-09-05", False), ("2026/03/04", True, "2026-03-04", False),
    ("2026-09-01 00:00:00", True, "2026-09-01", False), ("46023", True, "2026-01-01", False), ("31/02/2026", True, None, False),
    ("13/13/2026", True, None, True), ("1.2.26", True, "2026-02-01", True), ("words", True, None, False), ("", True, None, False)])
def test_dates(spark, text, day_first, iso, ambiguous):
    got = one(spark, D.parse_date(F.col("t"), F.col("f")), t=text, f=day_first)
    assert (str(got.iso) if got.iso else None, bool(got.ambiguous)) == (iso, ambiguous)


def test_old_serials_have_no_leap_day(spark):
    df = spark.createDataFrame([(1.0,), (60.0,), (61.0,), (0.5,)], "n double").select(D.serial_to_date(F.col("n")).alias("d"))
    assert [r.d for r in df.collect()] == [dt.date(1900, 1, 1), dt.date(1900, 3, 1), dt.date(1900, 3, 1), None]


def test_transposed_date_keeps_its_original(spark):
    got = spark.range(1).select(D.repair_transposed(F.lit("2026-09-01").cast("date"), F.lit(True)).alias("r")).first().r
    assert got.date == dt.date(2026, 1, 9) and got.repaired and "2026-09-01 -> 2026-01-09" in got.note


@pytest.mark.parametrize("name, want", [
    ("Emaar Misr 818", "emaar misr"), ("Emaar Misr", "emaar misr"), ("ACCOR* SOFITEL", "accor sofitel"),
    ("TRANSFER\nVALUE DATE: 1 JAN\nSALC12345\nREF", "voucher:salc12345"), ("TRANSFER\nVALUE DATE: 1 JAN\nfor rent", "transfer for rent")])
def test_supplier_keys(spark, name, want):
    assert one(spark, X.supplier_key(F.col("t")), t=name) == want


@pytest.mark.parametrize("name, code", [("GALLUP 840", "840"), ("GALLUP 784", "784"), ("GALLUP", None)])
def test_country_codes_split_off(spark, name, code):
    got = one(spark, X.split_supplier(F.col("t")), t=name)
    assert (got.name, got.country) == ("GALLUP", code)


@pytest.mark.parametrize("words, want", [
    ("REFUND FROM SUPPLIER", "refund"), ("PAYMENT RECD.-INTERNET BANKING", "funding"), ("nonrefundable", "funding"), ("Charge Back", "refund")])
def test_money_in(spark, words, want):
    assert one(spark, X.money_in_kind(F.col("t")), t=words) == want


@pytest.mark.parametrize("line, ref, kind, want", [
    ("CHARGES\nx", "", "bank_account", "BAC"), ("HARGES AND FEES\nx", "", "bank_account", "BAC"), ("CHARGES", "KS1", "bank_account", "KS1"),
    ("CHARGES", "", "card", ""), ("TRANSFER\nCHARGES", "", "bank_account", "")])
def test_bank_charges_label_themselves(spark, line, ref, kind, want):
    assert one(spark, X.bank_charge_reference(F.col("t"), F.col("r"), F.col("k")), t=line, r=ref, k=kind) == want


def test_unknown_currency_cell(spark):
    got = one(spark, A.parse_currency_cell(F.col("t")), t="XYZ 500")
    assert (got.code, got.amount) == ("XYZ", 500)


def test_edited_text(spark):
    df = spark.createDataFrame([(None, "a"), (" ", "a"), (" b ", "a")], "n string, o string")
    assert [r.r for r in df.select(X.edited_text(F.col("n"), F.col("o")).alias("r")).collect()] == ["a", None, "b"]


@pytest.mark.parametrize("formula, want", [("=E5/934000", "934000"), ("=E5/934,000.5", "934000.5"), ("=100/20", None), ("=E5/F5", None)])
def test_rate_formulas(spark, formula, want):
    got = one(spark, K.rate_formula_denominator(F.col("t")), t=formula)
    assert (got is None) if want is None else got == Decimal(want)


def test_search_terms():
    assert X.query_terms('  Hotel "SA 993"  req') == ["hotel", "sa 993", "req"]


def test_every_header_hint_needs_its_letters():
    from tallywise.operators.sheets import HEADER_HINTS, HINT_CORES
    texts = {r"\bsr\.?\s*no\b": "Sr. No", r"\btransaction\s*type\b": "Transaction Type", r"\bvalue\s*date\b": "Value Date", r"\breq": "REQ 5",
             r"\bdetails?\b": "Detail", r"\bparticulars?\b": "Particular"}
    assert len(HEADER_HINTS) == len(HINT_CORES)
    for hint, core in zip(HEADER_HINTS, HINT_CORES):
        text = texts.get(hint, hint.replace(r"\b", "").replace("\\", ""))
        assert re.search("(?i)" + hint, text) and core in text.lower()


def test_headings_are_read_without_looking_at_every_cell(spark):
    from tallywise.operators import sheets as H
    cells = spark.createDataFrame(
        [("f", "s", 3, i, t) for i, t in enumerate([" Date ", "  ", "Debit", "CREDIT  (AED)", "Balance", "1e5", "REQ"], 1)]
        + [("f", "s", 4, 1, " 1.5"), ("f", "s", 4, 2, "x")], "file string, sheet string, row long, col int, text string")
    headers = H.detect_header(cells)
    assert [(r.header_row, r.score) for r in headers.collect()] == [(3, 4)]
    headings = H.header_cells(cells, headers)
    assert {r.col: r.heading for r in headings.collect()} == {1: "Date", 3: "Debit", 4: "CREDIT (AED)", 5: "Balance", 6: "1e5", 7: "REQ"}
    mapping = H.map_columns(headings)
    assert {r.field: r.col for r in mapping.collect()} == {"date": 1, "debit": 3, "credit": 4, "statement_balance": 5, "req_number": 7}
    # The patterns of the fields stand above the join with the header, never in a filter of the cells.
    plan = mapping._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "beneficiary" in line]


def test_labels_of_a_statement_are_found_in_any_case_and_with_blanks(spark):
    from tallywise.operators import sheets as H
    rows = [(1, 2, " ACCOUNT number: "), (1, 3, "77"), (1, 5, "x From: 01/09/1996 To"), (2, 2, "Number of Transaction"), (2, 3, "credit VALUE"),
            (2, 4, "Debit Value"), (2, 5, "Opening Balance "), (2, 6, "closing balance"), (2, 7, "my currency"), (3, 2, "2"), (3, 3, "5"),
            (3, 4, "3"), (3, 5, "100"), (3, 6, "102")]
    cells = spark.createDataFrame([("f", "s", *r) for r in rows], "file string, sheet string, row long, col int, text string")
    got = H.statement_header(cells)
    r = got.first()
    assert (r.account_number, r.currency, int(r.transactions), r.adds_up, str(r.period_start)) == ("77", None, 2, True, "1996-09-01")
    assert "account number|currency" in got._jdf.queryExecution().optimizedPlan().toString()
