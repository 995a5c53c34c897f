"""Runnable queries: building import rows, changing the ledger, reports, files and streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixtures import accounts, statement_lines, submissions, transactions, upload_lines
from ..functions.text import is_blank
from ..operators import balances as B
from ..operators import chains as C
from ..operators import checks as Q
from ..operators import edits as E
from ..operators import imports as I
from ..operators import matching as M
from ..operators import reports as R
from ..operators import statistics as S
from ..schema import ISO_CURRENCIES
from ..session import shared_dir, state_on_disk
from ..sources import files as files_
from ..streaming import streams as ST
from .chains_and_checks import BANK_ORDER, CORRECTIONS, KIND, OCCURRENCE, OPEN, corrections, order_number
from .filters_and_totals import MONTHS
from .matching_and_values import BLANKED, CLASSIFY_SQL, HELD, VOUCHED, blanked, suppliers
from .registry import query
from .sql_parts import BALANCES, SIGNATURE, SPEND, voucher

OK = "(transaction_id // 10)"


def ok():
    return F.floor(F.col("transaction_id") / 10)


# ------------------------------------------------------------ import rows

def sheet_text(spark, d):
    """The ledger written out again as a sheet, with the faults sheets have."""
    i, size = F.col("transaction_id"), F.abs("amount_aed").cast("string")
    out = F.col("amount_aed") < 0
    t = transactions(spark, d).filter("entry_type = 'source_transaction'")
    return t.select(
        i.alias("line"), "card_id", F.lit(True).alias("day_first"),
        F.when(i % 41 == 0, "").when(i % 43 == 0, "31/02/2020").otherwise(F.date_format("txn_date", "dd/MM/yyyy")).alias("date"),
        F.when(i % 47 == 0, " ").otherwise(F.col("supplier_raw")).alias("supplier"),
        F.when(out | (i % 53 == 0), size).alias("decrease"), F.when(~out | (i % 53 == 0), size).alias("increase"),
        F.when(i % 59 == 0, "GPB 500").otherwise(F.col("currency")).alias("currency"),
        F.when(i % 59 != 0, F.col("original_amount").cast("string")).alias("original_amount"),
        F.when(i % 61 == 0, "XAF").alias("settlement_currency"), "req_number", "payment_ref", "notes")


@query("build_rows", "I1 X1 X2 X6 X13 X16", f"""
SELECT line, card_id, txn_date, kind, amount_aed, currency, original_amount, exchange_rate, req_number,
  errors, len(string_split(errors, '#')) = 1 AND errors = '' AS include FROM (
SELECT i AS line, card_id, CASE WHEN i % 41 = 0 OR i % 43 = 0 THEN NULL ELSE txn_date END AS txn_date,
  CASE WHEN i % 53 = 0 OR amount_aed < 0 THEN 'purchase' ELSE 'funding' END AS kind,
  CASE WHEN i % 53 = 0 THEN NULL ELSE amount_aed END AS amount_aed,
  CASE WHEN i % 59 = 0 THEN NULL ELSE currency END AS currency, CASE WHEN i % 59 = 0 THEN NULL ELSE original_amount END AS original_amount,
  CASE WHEN i % 59 <> 0 AND i % 53 <> 0 AND original_amount > 0 AND currency IS NOT NULL THEN round(CAST(abs(amount_aed) AS DOUBLE) / CAST(original_amount AS DOUBLE), 10) END AS exchange_rate,
  CASE WHEN trim(coalesce(req_number, '')) = '' THEN CASE WHEN a.card_type = 'bank_account' AND starts_with(supplier_raw, 'CHARGES AND FEES') AND i % 47 <> 0 THEN 'BAC' ELSE '' END ELSE trim(req_number) END AS req_number,
  array_to_string(list_filter([
    CASE WHEN i % 53 = 0 THEN 'Money in and money out are both filled in.' END,
    CASE WHEN i % 53 = 0 THEN 'Neither money in nor money out is known.' END,
    CASE WHEN i % 41 = 0 THEN 'The date is missing.' WHEN i % 43 = 0 THEN 'Not a date: "31/02/2020".' END,
    CASE WHEN i % 47 = 0 THEN 'Nobody is named as payee.' END,
    CASE WHEN i % 61 = 0 THEN 'Settled in XAF, unlike the account ' || a.card_name || ', which uses ' || a.settlement_currency || '.' END], lambda x: x IS NOT NULL), ',') AS errors
FROM (SELECT *, transaction_id AS i FROM fx_transactions) t JOIN fx_accounts a USING (card_id)
WHERE entry_type = 'source_transaction' AND NOT (i % 41 = 0 AND i % 53 = 0) AND NOT (i % 53 = 0 AND i % 47 = 0))""",
       "line card_id @txn_date kind $amount_aed currency $original_amount $exchange_rate req_number errors include")
def build_rows(spark, d):
    return I.build_rows(sheet_text(spark, d), accounts(spark, d)).select(
        "line", "card_id", "txn_date", "kind", "amount_aed", "currency", "original_amount", "exchange_rate", "req_number",
        "errors", "include")


def book_rows(spark, d):
    """Every account's rows as a bookkeeping sheet: an opening, a chain, a typed-over balance."""
    a = accounts(spark, d)
    live = transactions(spark, d).filter("entry_type = 'source_transaction' AND status <> 'voided'")
    run = B.running_balance(live, a)
    out = F.col("amount_aed") < 0
    body = run.select(
        F.col("card_id").alias("sheet"), order_number().alias("row"),
        F.when(ok() % 43 == 0, "someday").otherwise(F.date_format("txn_date", "dd/MM/yyyy")).alias("date_text"),
        F.col("supplier_raw").alias("supplier"), F.col("currency_raw").alias("currency_text"),
        F.when(out, F.abs("amount_aed")).alias("decrease"), F.when(~out, F.col("amount_aed")).alias("increase"),
        F.when((ok() % 67 != 0) & (ok() % 19 != 0), "=F1-D2+E2").alias("balance_formula"),
        F.when(ok() % 19 != 0, F.col("running_balance") + F.when(ok() % 67 == 0, 7).otherwise(0)).cast("decimal(18,2)").alias("balance_value"),
        F.when(ok() % 5 == 0, F.concat(F.lit("=E5/"), F.when(ok() % 9 == 0, F.lit("7")).otherwise(F.col("original_amount").cast("string"))))
        .when(ok() % 5 == 1, "=E5/250").when(ok() % 31 == 0, "=100/20").alias("rate_formula"),
        F.col("exchange_rate").alias("rate_value"))
    none = lambda t, n: F.lit(None).cast(t).alias(n)
    first = a.select(F.col("card_id").alias("sheet"), F.lit(0).cast("bigint").alias("row"), none("string", "date_text"),
                     none("string", "supplier"), none("string", "currency_text"), none("decimal(18,2)", "decrease"),
                     none("decimal(18,2)", "increase"), none("string", "balance_formula"), F.col("opening_balance").alias("balance_value"),
                     none("string", "rate_formula"), none("decimal(20,10)", "rate_value"))
    return body.unionByName(first)


BOOK = f"""SELECT *, {OK} AS ok, (CAST(date_diff('day', DATE '1990-01-01', txn_date) AS BIGINT) * 10000000000 + transaction_id) AS row
FROM fx_transactions WHERE entry_type = 'source_transaction' AND status <> 'voided'"""
BOOK_ANOMALIES = f"""
SELECT card_id AS sheet, row, unnest(list_filter([
  CASE WHEN ok % 19 = 0 THEN {{'kind': 'balance_chain_broken', 'detail': coalesce(supplier_raw, '')}} END,
  CASE WHEN ok % 43 = 0 THEN {{'kind': 'date_unparseable', 'detail': 'someday'}} END,
  CASE WHEN ok % 5 = 3 THEN {{'kind': 'currency_unrecognised', 'detail': 'XYZ 500'}} END,
  CASE WHEN ok % 5 = 0 AND ok % 9 = 0 AND original_amount <> 7 THEN {{'kind': 'rate_denominator_mismatch', 'detail': '=E5/7 against ' || CAST(original_amount AS VARCHAR)}} END,
  CASE WHEN ok % 5 NOT IN (0, 1) AND ok % 31 = 0 THEN {{'kind': 'rate_formula_unexpected', 'detail': '=100/20'}} END,
  CASE WHEN ok % 5 = 1 THEN {{'kind': 'rate_without_currency', 'detail': '=E5/250'}} WHEN ok % 5 IN (2, 4) AND ok % 31 = 0 THEN {{'kind': 'rate_without_currency', 'detail': '=100/20'}} END],
  lambda x: x IS NOT NULL), recursive := true) FROM ({BOOK})"""


@query("extract_rows", "I3 X5 X6 X7 X24", f"""
SELECT card_id AS sheet, row, CASE WHEN ok % 43 = 0 THEN NULL ELSE txn_date END AS txn_date, amount_aed, direction,
  CASE ok % 5 WHEN 0 THEN 'USD' WHEN 2 THEN CASE WHEN ok % 31 = 0 THEN NULL ELSE 'AED' END WHEN 4 THEN CASE WHEN ok % 31 = 0 THEN NULL ELSE 'AED' END END AS currency,
  CASE ok % 5 WHEN 0 THEN original_amount WHEN 1 THEN 250 END AS original_amount, ok % 19 <> 0 AS included_in_source_balance,
  CASE WHEN ok % 67 = 0 AND ok % 19 <> 0 THEN 'reseed' ELSE '' END AS mark FROM ({BOOK})""",
       "sheet #row @txn_date $amount_aed direction currency $original_amount included_in_source_balance mark")
def extract_rows(spark, d):
    return I.extract_rows(book_rows(spark, d)).select(
        "sheet", "row", "txn_date", "amount_aed", "direction", "currency", "original_amount", "included_in_source_balance",
        F.when(F.col("reseed_balance").isNotNull(), "reseed").otherwise("").alias("mark"))


@query("extraction_anomalies", "I3", BOOK_ANOMALIES, "sheet #row kind detail")
def extraction_anomalies(spark, d):
    return I.extraction_anomalies(I.extract_rows(book_rows(spark, d)))


@query("anomaly_counts", "A21", f"SELECT kind, count(*) AS n FROM ({BOOK_ANOMALIES}) GROUP BY 1", "kind #n")
def anomaly_counts(spark, d):
    return I.anomaly_counts(I.extraction_anomalies(I.extract_rows(book_rows(spark, d))))


@query("apply_review_status", "I4", f"""
SELECT b.card_id AS sheet, b.row, CASE WHEN ok % 19 = 0 THEN 'excluded_from_source_balance' WHEN w.why IS NOT NULL THEN 'needs_review' ELSE 'confirmed' END AS status,
  CASE WHEN ok % 19 = 0 THEN 'Left out of the sheet''s own balance formula' ELSE w.why END AS review_reason
FROM ({BOOK}) b LEFT JOIN (SELECT sheet, row, array_to_string(list_sort(list(kind || ': ' || detail)), '; ') AS why FROM ({BOOK_ANOMALIES})
  WHERE kind <> 'balance_chain_broken' GROUP BY 1, 2) w ON w.sheet = b.card_id AND w.row = b.row""", "sheet #row status review_reason")
def apply_review_status(spark, d):
    x = I.extract_rows(book_rows(spark, d))
    return I.apply_review_status(x, I.extraction_anomalies(x)).select("sheet", "row", "status", "review_reason")


@query("inject_adjustments", "I5 W4", f"""
SELECT sheet, row, printed - computed AS amount_aed FROM (
SELECT *, coalesce(lag(lvl) OVER (PARTITION BY sheet ORDER BY row), opening) + moved AS computed FROM (
SELECT *, printed - moved AS lvl FROM (
SELECT b.card_id AS sheet, b.row, ok, a.opening_balance AS opening, sum(CASE WHEN ok % 19 <> 0 THEN amount_aed ELSE 0 END) OVER (PARTITION BY b.card_id ORDER BY b.row) AS moved,
  a.opening_balance + sum(amount_aed) OVER (PARTITION BY b.card_id ORDER BY b.row) + CASE WHEN ok % 67 = 0 THEN 7 ELSE 0 END AS printed
FROM ({BOOK}) b JOIN fx_accounts a USING (card_id)) WHERE ok % 19 <> 0)) WHERE ok % 67 = 0""", "sheet #row $amount_aed")
def inject_adjustments(spark, d):
    rows = book_rows(spark, d)
    x = I.extract_rows(rows)
    chain = C.chain_breaks_resync(x, I.opening_balances(rows), ["row"], keys=["sheet"])
    return I.inject_adjustments(x, chain).filter("entry_type = 'reconciliation_adjustment'").select("sheet", "row", "amount_aed")


@query("normalise_rates", "I16", """
SELECT transaction_id, n AS normalized_exchange_rate, CASE WHEN (differs OR bare) AND status = 'confirmed' THEN 'needs_review' ELSE status END AS status,
  CASE WHEN differs THEN 'source' WHEN rate_review_note IS NOT NULL THEN 'kept' WHEN bare AND one THEN 'no code, bare 1' WHEN bare THEN 'no code' END AS note FROM (
SELECT *, coalesce(exchange_rate IS NOT NULL AND abs(exchange_rate - n) > 1e-9, FALSE) AS differs,
  exchange_rate IS NOT NULL AND currency IS NULL AND rate_review_note IS NULL AS bare,
  exchange_rate = 1 AND currency IS NULL AND original_amount IS NULL AND exchange_rate_formula IS NULL AS one
FROM (SELECT *, CASE WHEN original_amount > 0 THEN CAST(round(CAST(abs(amount_aed) AS DOUBLE) / CAST(original_amount AS DOUBLE), 10) AS DECIMAL(20,10)) END AS n FROM fx_transactions))""",
       "transaction_id $normalized_exchange_rate status note")
def normalise_rates(spark, d):
    n = F.col("rate_review_note")
    short = (F.when(n.startswith("The stated rate"), "source").when(n.startswith("normalized rate"), "kept")
             .when(n.contains("no currency code") & n.contains("bare 1"), "no code, bare 1").when(n.contains("no currency code"), "no code"))
    return I.normalise_rates(transactions(spark, d)).select(
        "transaction_id", "normalized_exchange_rate", "status", short.alias("note"))


@query("import_payments", "I19 X16", f"""
SELECT transaction_id AS line, CASE WHEN {OK} % 43 = 0 THEN NULL ELSE txn_date END AS txn_date, -abs(amount_aed) AS amount_aed, currency, original_amount,
  CASE WHEN original_amount > 0 THEN round(CAST(abs(amount_aed) AS DOUBLE) / CAST(original_amount AS DOUBLE), 10) END AS exchange_rate,
  array_to_string(list_filter([CASE WHEN {OK} % 43 = 0 THEN 'unreadable date' END, CASE WHEN supplier_raw IS NULL THEN 'no beneficiary' END,
    CASE WHEN trim(coalesce(req_number, '')) = '' THEN 'no request number' END, CASE WHEN {OK} % 47 = 0 THEN 'local currency is not AED' END,
    CASE WHEN currency IS NULL AND {OK} % 53 = 0 THEN 'does not cost itself' END], lambda x: x IS NOT NULL), ',') AS problems
FROM (SELECT * FROM fx_transactions)""", "line @txn_date $amount_aed currency $original_amount exchange_rate problems")
def import_payments(spark, d):
    return I.import_payments(payment_rows(spark, d)).select(
        "line", "txn_date", "amount_aed", "currency", "original_amount", "exchange_rate", "problems")


PAID = f"""SELECT transaction_id, status, CASE WHEN {OK} % 43 = 0 THEN NULL ELSE txn_date END AS paid_on, txn_date, -abs(amount_aed) AS cost, amount_aed,
  upper(trim(regexp_replace(coalesce(supplier_raw, ''), '\\s+', ' ', 'g'))) AS who, upper(trim(regexp_replace(coalesce(req_number, ''), '\\s+', ' ', 'g'))) AS asked
FROM fx_transactions"""


@query("recognise_payments", "I19 J10", f"""
SELECT p.line, p.copy, CASE WHEN p.paid_on IS NULL THEN 0 ELSE coalesce(c.held, 0) END AS held, h.held_id FROM (
SELECT *, transaction_id AS line, row_number() OVER (PARTITION BY paid_on, cost, who, asked ORDER BY transaction_id) AS copy FROM ({PAID})) p
LEFT JOIN (SELECT txn_date, amount_aed, who, asked, count(*) AS held FROM ({PAID}) WHERE status <> 'voided' GROUP BY ALL) c
  ON c.txn_date = p.paid_on AND c.amount_aed = p.cost AND c.who = p.who AND c.asked = p.asked
LEFT JOIN (SELECT *, transaction_id AS held_id, row_number() OVER (PARTITION BY txn_date, amount_aed, who, asked ORDER BY transaction_id) AS copy
  FROM ({PAID}) WHERE status <> 'voided') h
  ON h.txn_date = p.paid_on AND h.amount_aed = p.cost AND h.who = p.who AND h.asked = p.asked AND h.copy = p.copy""", "line #copy #held held_id")
def recognise_payments(spark, d):
    paid = I.import_payments(payment_rows(spark, d))
    return I.recognise_payments(paid, transactions(spark, d)).select("line", "copy", "held", "held_id")


def payment_rows(spark, d):
    """The ledger written out as the list of payments of a bank."""
    size = F.abs("amount_aed")
    local = F.col("currency").isNull()
    return transactions(spark, d).select(
        F.col("transaction_id").alias("line"), F.when(ok() % 43 == 0, "yesterday").otherwise(F.date_format("txn_date", "dd-MM-yyyy")).alias("date"),
        F.col("supplier_raw").alias("beneficiary"), F.coalesce("currency", F.lit("aed")).alias("currency"),
        F.when(local, (size + F.when(ok() % 53 == 0, 1).otherwise(0)).cast("string")).otherwise(F.col("original_amount").cast("string")).alias("amount"),
        F.col("req_number").alias("reference"), F.when(ok() % 47 == 0, "SAR").otherwise("AED").alias("local_currency"),
        F.format_number(size.cast("double"), 2).alias("local_amount"))


CANDIDATES = f"""SELECT *, encode_hex AS dedup_key FROM ({OCCURRENCE})"""


@query("import_report", "A15 J8", f"""
SELECT c.card_id, count(*) AS row_count, count(*) FILTER (WHERE c.transaction_id % 3 <> 0) AS to_insert, count(*) FILTER (WHERE c.transaction_id % 3 = 0) AS already_imported,
  count(*) FILTER (WHERE status = 'needs_review') AS needs_review, count(*) FILTER (WHERE entry_type = 'reconciliation_adjustment') AS adjustments,
  count(*) FILTER (WHERE status = 'excluded_from_source_balance') AS excluded, count(*) FILTER (WHERE occurrence > 1) AS repeat_charges,
  count(*) FILTER (WHERE date_repaired) AS dates_repaired FROM ({CANDIDATES}) c GROUP BY 1""",
       "card_id #row_count #to_insert #already_imported #needs_review #adjustments #excluded #repeat_charges #dates_repaired")
def import_report(spark, d):
    rows = Q.assign_occurrence(transactions(spark, d))
    # The ledger holds some of these rows under their own key, the rest under another.
    held = rows.select(F.when(F.col("transaction_id") % 3 == 0, F.col("dedup_key")).otherwise(F.col("signature") if "signature" in rows.columns else F.lit("-")).alias("dedup_key"))
    return I.import_report(rows, held)


@query("rejected_rows", "A15", """
SELECT transaction_id, unnest(list_filter([CASE WHEN entry_type = 'reconciliation_adjustment' AND dir IS NOT NULL THEN 'adjustment with a direction' END,
  CASE WHEN dir = 'spend' AND amount_aed > 0 THEN 'money out above zero' END, CASE WHEN dir = 'funding' AND amount_aed < 0 THEN 'money in below zero' END,
  CASE WHEN exchange_rate IS NOT NULL AND status <> 'needs_review' AND (currency IS NULL OR original_amount IS NULL) THEN 'rate of an incomplete conversion' END], lambda x: x IS NOT NULL)) AS why
FROM (SELECT *, CASE WHEN transaction_id % 500 = 0 THEN 'spend' ELSE direction END AS dir FROM fx_transactions)""", "transaction_id why")
def rejected_rows(spark, d):
    t = transactions(spark, d)
    return I.rejected_rows(t.withColumn("direction", F.when(F.col("transaction_id") % 500 == 0, "spend").otherwise(F.col("direction"))))


@query("upsert_accounts", "I22", """
SELECT coalesce(s.card_name, n.card_name) AS card_name, CASE WHEN s.card_name IS NULL THEN n.opening_balance ELSE s.opening_balance END AS opening_balance,
  coalesce(s.opening_date, n.opening_date) AS opening_date FROM (SELECT * FROM fx_accounts WHERE card_type <> 'payment_account') s
FULL JOIN (SELECT card_name, opening_balance + 1 AS opening_balance, DATE '1996-01-01' AS opening_date FROM fx_accounts WHERE card_type <> 'bank_account') n ON n.card_name = s.card_name""",
       "card_name $opening_balance @opening_date")
def upsert_accounts(spark, d):
    a = accounts(spark, d)
    stored = a.filter("card_type <> 'payment_account'").select("card_name", "opening_balance", "opening_date")
    new = a.filter("card_type <> 'bank_account'").select(
        "card_name", (F.col("opening_balance") + 1).alias("opening_balance"), F.lit("1996-01-01").cast("date").alias("opening_date"))
    return I.upsert_accounts(stored, new)


LEFT_OUT = f"""
SELECT q.line, 'import_unticked' AS kind, concat_ws(' — ', nullif(f.supplier_raw, ''), CAST(f.amount_aed AS VARCHAR) || ' AED', 'already in the ledger') AS detail
FROM ({CLASSIFY_SQL}) q JOIN fx_file f ON f.line = q.line WHERE outcome IN ('held', 'held_swapped', 'held_other_date', 'several_near') AND q.line % 97 <> 0
UNION ALL SELECT line, 'import_stopped', concat_ws(' — ', nullif(supplier_raw, ''), CAST(amount_aed AS VARCHAR) || ' AED', 'The date is missing.') FROM fx_file WHERE line % 97 = 0
UNION ALL SELECT line, 'import_refused', concat_ws(' — ', nullif(supplier_raw, ''), CAST(amount_aed AS VARCHAR) || ' AED', 'the ledger said no') FROM fx_file WHERE line % 89 = 0"""


@query("reconcile_import", "I11", LEFT_OUT, "line kind detail")
def reconcile_import(spark, d):
    f = upload_lines(spark, d)
    done = M.classify_duplicates(f, transactions(spark, d)).withColumn(
        "errors", F.when(F.col("line") % 97 == 0, F.array(F.lit("The date is missing."))).otherwise(F.array().cast("array<string>")))
    refused = f.filter(F.col("line") % 89 == 0).select("line", F.lit("the ledger said no").alias("message"))
    return I.reconcile_import(done, refused)


def _batches(spark, d):
    a = accounts(spark, d)
    return a.select(
        F.col("card_id").alias("batch_id"), F.concat(F.col("card_name"), F.lit(".xlsx")).alias("source"),
        F.lit("2026-01-01 09:00:00").cast("timestamp_ntz").alias("created_at"),
        F.when(F.col("card_id") % 2 == 0, "owner@example.com").alias("imported_by"), (F.col("card_id") % 9 == 0).alias("dry_run"),
        F.lit(10).alias("row_count"), F.lit(8).alias("inserted_count"), F.lit(2).alias("skipped_count"))


def _batch_anomalies(spark, d):
    return transactions(spark, d).filter("status <> 'confirmed'").select(
        F.col("card_id").alias("batch_id"), "source_row", F.concat(F.lit("import_"), F.col("status")).alias("kind"),
        F.coalesce("supplier_raw", F.lit("?")).alias("detail"))


@query("import_history", "I12", """
SELECT b.card_id AS batch_id, card_name || '.xlsx' AS source, TIMESTAMP '2026-01-01 09:00:00' AS created_at,
  CASE WHEN card_id % 2 = 0 THEN 'owner@example.com' ELSE 'the system' END AS imported_by, 10 AS rows_in_file, 8 AS imported, 2 AS left_out,
  coalesce(n, 0) AS recorded, coalesce(kinds, '') AS left_out_kinds
FROM fx_accounts b LEFT JOIN (SELECT card_id AS bid, sum(n) AS n, array_to_string(list_sort(list(status || '=' || CAST(n AS VARCHAR))), ',') AS kinds FROM (
  SELECT card_id, status, count(*) AS n FROM fx_transactions WHERE status <> 'confirmed' GROUP BY 1, 2) GROUP BY 1) k ON k.bid = b.card_id
WHERE card_id % 9 <> 0""", "batch_id source !created_at imported_by #rows_in_file #imported #left_out #recorded left_out_kinds")
def import_history(spark, d):
    return I.import_history(_batches(spark, d), _batch_anomalies(spark, d))


@query("left_out_rows", "I12", """
SELECT t.card_id AS batch_id, a.card_name || '.xlsx' AS source, t.source_row, t.status AS kind, coalesce(t.supplier_raw, '?') AS detail
FROM fx_transactions t JOIN fx_accounts a USING (card_id) WHERE t.status <> 'confirmed' AND t.card_id % 9 <> 0""", "batch_id source source_row kind detail")
def left_out_rows(spark, d):
    return I.left_out_rows(_batches(spark, d), _batch_anomalies(spark, d))


@query("file_projection", "Q24", f"""
SELECT p.card_id, a.card_name, row_count, fresh, net, closing, b.ledger_balance + a.balance_sign * net AS projected,
  CASE WHEN closing IS NOT NULL THEN abs(b.ledger_balance + a.balance_sign * net - closing) < 0.005 END AS agrees FROM (
SELECT f.card_id, count(*) AS row_count, count(*) FILTER (WHERE outcome IN ('new', 'missing_copy')) AS fresh,
  coalesce(sum(f.amount_aed) FILTER (WHERE outcome IN ('new', 'missing_copy')), 0) AS net, arg_max(f.amount_aed, f.line) AS closing
FROM ({CLASSIFY_SQL}) q JOIN fx_file f ON f.line = q.line GROUP BY f.card_id) p JOIN fx_accounts a ON a.card_id = p.card_id JOIN ({BALANCES}) b ON b.card_id = p.card_id""",
       "card_id card_name #row_count #fresh $net $closing $projected agrees")
def file_projection(spark, d):
    t, a = transactions(spark, d), accounts(spark, d)
    done = M.classify_duplicates(upload_lines(spark, d), t).withColumns({
        "errors": F.array().cast("array<string>"), "statement_balance": F.col("amount_aed")})
    return I.file_projection(done, a, B.account_balances(t, a))


# ------------------------------------------------------------------ changes

def currency_table(spark):
    return spark.createDataFrame([(c,) for c in ISO_CURRENCIES], "code string")


def entries(spark, d):
    """Orders' rows handed in again by a person, some of them wrongly."""
    i = F.col("transaction_id")
    t = transactions(spark, d)
    return t.select(
        (i + 1_000_000_000_000).alias("submission_id"), F.when(ok() % 101 != 0, F.col("card_id")).alias("card_id"), "txn_date",
        F.when(ok() % 103 == 0, "gift").when(F.col("amount_aed") < 0, "purchase").otherwise("funding").alias("kind"),
        F.when(ok() % 107 == 0, 0).otherwise(F.abs("amount_aed")).cast("decimal(18,2)").alias("amount"),
        F.coalesce(F.col("supplier_raw"), F.lit(" ")).alias("supplier"), "req_number", "payment_ref",
        F.when(ok() % 109 == 0, "GPB").when(ok() % 127 == 0, "AUD").otherwise(F.col("currency")).alias("currency"), "original_amount",
        F.when(ok() % 113 != 0, F.when(F.col("currency").isNotNull(), F.col("exchange_rate"))).alias("exchange_rate"),
        (ok() % 17 == 0).alias("needs_review"), F.col("created_at").alias("submitted_at"))


ENTRY_ERROR = f"""CASE WHEN ok % 101 = 0 THEN 'Name the account and the day'
  WHEN ok % 107 = 0 THEN 'The amount must be above zero; its sign follows from the kind' WHEN supplier_raw IS NULL THEN 'Nobody is named as payee'
  WHEN ok % 103 = 0 THEN 'Not a kind of entry: gift'
  WHEN cur IS NOT NULL AND ok % 17 <> 0 AND original_amount IS NULL THEN 'No amount in ' || cur || ' is given, and the entry is not flagged'
  WHEN cur IS NOT NULL AND ok % 17 <> 0 AND (ok % 113 = 0 OR currency IS NULL) THEN 'No exchange rate is given, and the entry is not flagged'
  WHEN cur IS NULL AND original_amount IS NOT NULL THEN 'An original amount or rate stands without its currency'
  WHEN cur = 'GPB' THEN 'Not a known currency: GPB' END"""
ENTRIES = f"""SELECT *, {ENTRY_ERROR} AS error FROM (SELECT *, {OK} AS ok, CASE WHEN {OK} % 109 = 0 THEN 'GPB' WHEN {OK} % 127 = 0 THEN 'AUD' ELSE currency END AS cur FROM fx_transactions)"""


@query("refused_submissions", "I6", f"SELECT transaction_id + 1000000000000 AS submission_id, error FROM ({ENTRIES}) WHERE error IS NOT NULL", "submission_id error")
def refused_submissions(spark, d):
    return E.refused_submissions(entries(spark, d), currency_table(spark))


@query("submitted_suppliers", "I6 J9 X7", f"""
SELECT DISTINCT trim(supplier_raw) AS name, CAST(NULL AS VARCHAR) AS country_code FROM ({ENTRIES}) WHERE error IS NULL
EXCEPT SELECT 'SUPPLIER ' || CAST(s_suppkey % 50 AS VARCHAR), CASE WHEN s_suppkey % 2 = 0 THEN '840' END FROM supplier""", "name country_code")
def submitted_suppliers(spark, d):
    return E.submitted_suppliers(suppliers(spark, d), entries(spark, d), currency_table(spark))


NEW_SIGNATURE = """concat_ws('|', CAST(card_id AS VARCHAR), CAST(txn_date AS VARCHAR), CAST(amt AS VARCHAR), upper(trim(supplier_raw)),
  upper(trim(coalesce(payment_ref, ''))), upper(trim(coalesce(req_number, ''))))"""


@query("apply_submissions", "I6 X10 X11", f"""
SELECT transaction_id + 1000000000000 AS transaction_id, amt AS amount_aed, way AS direction, CASE WHEN ok % 17 = 0 THEN 'needs_review' ELSE 'confirmed' END AS status,
  coalesce(held, 0) + k AS occurrence, sha256(sig || '|' || way || '|#' || CAST(coalesce(held, 0) + k AS VARCHAR)) AS dedup_key FROM (
SELECT *, row_number() OVER (PARTITION BY sig ORDER BY transaction_id) AS k FROM (
  SELECT *, {NEW_SIGNATURE} AS sig FROM (SELECT *, amount_aed AS amt, CASE WHEN amount_aed < 0 THEN 'spend' ELSE 'funding' END AS way FROM ({ENTRIES}) WHERE error IS NULL))) n
LEFT JOIN (SELECT regexp_replace({SIGNATURE}, '\\|[a-z_]*$', '') AS hsig, count(*) AS held FROM fx_transactions GROUP BY 1) h ON h.hsig = n.sig""",
       "transaction_id $amount_aed direction status #occurrence dedup_key")
def apply_submissions(spark, d):
    return E.apply_submissions(transactions(spark, d), entries(spark, d), currency_table(spark)).select(
        "transaction_id", "amount_aed", "direction", "status", "occurrence", "dedup_key")


def edits(spark, d):
    """Two edits per row of the ledger: one takes a reference out, one sets an amount or a kind."""
    i = F.col("transaction_id")
    t = transactions(spark, d)
    none = lambda x: F.lit(None).cast(x)
    first = t.select((i * 2).alias("edit_id"), i.alias("transaction_id"), F.when(i % 3 == 0, " ").alias("payment_ref"),
                     none("string").alias("kind"), none("decimal(18,2)").alias("amount_aed"), F.lit("first look").alias("rationale"))
    second = t.select((i * 2 + 1).alias("edit_id"), F.when(ok() % 91 == 0, -i).otherwise(i).alias("transaction_id"),
                      F.when(i % 5 == 0, "PAY 1").alias("payment_ref"), F.when(i % 7 == 0, "refund").when(i % 11 == 0, "gift").alias("kind"),
                      F.when(i % 13 == 0, F.abs("amount_aed") + 1).cast("decimal(18,2)").alias("amount_aed"), F.lit("second look").alias("rationale"))
    return first.unionByName(second)


# The first edit can only take a reference out; the second starts from what the first left.
CLOSED = """CASE WHEN entry_type = 'reconciliation_adjustment' THEN 'Adjustments are closed to edits' END"""
BARE_RATE = """CASE WHEN exchange_rate IS NOT NULL AND status <> 'needs_review' AND (currency IS NULL OR original_amount IS NULL)
  THEN 'The rate lacks a currency or an original amount, and the entry is not under review' END"""
EDITED = f"""
SELECT *, coalesce({CLOSED}, CASE WHEN nkind = 'gift' THEN 'Not a kind of entry: gift' END, {BARE_RATE},
  CASE WHEN pay2 IS NOT DISTINCT FROM pay1 AND to_amount = amount_aed AND to_dir IS NOT DISTINCT FROM direction THEN 'The edit changes no value' END) AS error2 FROM (
SELECT *, CASE WHEN error1 IS NULL THEN NULL ELSE payment_ref END AS pay1, CASE WHEN i % 5 = 0 THEN 'PAY 1' WHEN error1 IS NOT NULL THEN payment_ref END AS pay2,
  CASE WHEN to_dir = 'spend' THEN -coalesce(namt, abs(amount_aed)) ELSE coalesce(namt, abs(amount_aed)) END AS to_amount FROM (
SELECT *, CASE WHEN nkind = 'refund' THEN 'funding' WHEN nkind IS NULL THEN direction END AS to_dir,
  coalesce({CLOSED}, {BARE_RATE}, CASE WHEN i % 3 <> 0 OR payment_ref IS NULL THEN 'The edit changes no value' END) AS error1 FROM (
SELECT *, CASE WHEN i % 7 = 0 THEN 'refund' WHEN i % 11 = 0 THEN 'gift' END AS nkind, CASE WHEN i % 13 = 0 THEN abs(amount_aed) + 1 END AS namt
FROM (SELECT *, transaction_id AS i, ({OK} % 91 <> 0 OR transaction_id = 0) AS live FROM fx_transactions))))"""


@query("apply_edits", "I7 X17 X25", f"""
SELECT transaction_id, CASE WHEN live AND error2 IS NULL THEN to_amount ELSE amount_aed END AS amount_aed,
  CASE WHEN live AND error2 IS NULL THEN to_dir ELSE direction END AS direction,
  CASE WHEN live AND error2 IS NULL THEN pay2 ELSE pay1 END AS payment_ref FROM ({EDITED})""", "transaction_id $amount_aed direction payment_ref")
def apply_edits(spark, d):
    return E.apply_edits(transactions(spark, d), edits(spark, d)).select("transaction_id", "amount_aed", "direction", "payment_ref")


@query("edit_log", "I7 X25", f"""
SELECT transaction_id, transaction_id * 2 AS edit_id, 'first look' AS rationale, 'payment_ref' AS field, payment_ref AS was, NULL AS became FROM ({EDITED}) WHERE error1 IS NULL
UNION ALL SELECT transaction_id, transaction_id * 2 + 1, 'second look', unnest(list_filter([
  CASE WHEN to_amount <> amount_aed THEN {{'field': 'amount_aed', 'was': CAST(amount_aed AS VARCHAR), 'became': CAST(CAST(to_amount AS DECIMAL(18,2)) AS VARCHAR)}} END,
  CASE WHEN to_dir <> direction THEN {{'field': 'direction', 'was': direction, 'became': to_dir}} END,
  CASE WHEN pay2 IS DISTINCT FROM pay1 THEN {{'field': 'payment_ref', 'was': pay1, 'became': pay2}} END], lambda x: x IS NOT NULL), recursive := true)
FROM ({EDITED}) WHERE live AND error2 IS NULL""", "transaction_id edit_id rationale field was became")
def edit_log(spark, d):
    return E.edit_log(transactions(spark, d), edits(spark, d)).select("transaction_id", "edit_id", "rationale", "field", "was", "became")


@query("refused_edits", "I7", f"""
SELECT transaction_id, transaction_id * 2 AS edit_id, error1 AS error FROM ({EDITED}) WHERE error1 IS NOT NULL
UNION ALL SELECT transaction_id, transaction_id * 2 + 1, error2 FROM ({EDITED}) WHERE live AND error2 IS NOT NULL
UNION ALL SELECT -transaction_id, transaction_id * 2 + 1, 'No entry has this id' FROM fx_transactions WHERE {OK} % 91 = 0 AND transaction_id <> 0""", "transaction_id edit_id error")
def refused_edits(spark, d):
    return E.refused_edits(transactions(spark, d), edits(spark, d))


@query("refresh_dedup_keys", "I21", f"""
SELECT transaction_id, CASE WHEN moved THEN sha256(replace(signature, '|' || CAST(amount_aed AS VARCHAR) || '|', '|' || CAST(CAST(amount_aed * 2 AS DECIMAL(18,2)) AS VARCHAR) || '|') || '|#' || CAST(occurrence AS VARCHAR)) ELSE encode_hex END AS dedup_key
FROM (SELECT *, transaction_id % 10 = 1 AS moved FROM ({OCCURRENCE}))""", "transaction_id dedup_key")
def refresh_dedup_keys(spark, d):
    old = Q.assign_occurrence(transactions(spark, d))
    new = old.withColumn("amount_aed", (F.col("amount_aed") * F.when(F.col("transaction_id") % 10 == 1, 2).otherwise(1)).cast("decimal(18,2)"))
    return E.refresh_dedup_keys(old, new).select("transaction_id", "dedup_key")


def decisions(spark, d):
    """A person works through the whole ledger once, and changes their mind on some rows."""
    i = F.col("transaction_id")
    t = transactions(spark, d)
    one = t.select((i * 2).alias("decision_id"), "transaction_id", F.when(ok() % 4 == 0, "void").when(ok() % 4 == 1, "confirm")
                   .when(ok() % 4 == 2, "reopen").otherwise("leave_pending").alias("action"),
                   F.when(ok() % 23 == 0, " ").otherwise("looked at it").alias("rationale"), F.lit(None).cast("string").alias("review_reason"),
                   F.col("created_at").alias("decided_at"))
    two = t.filter("status = 'needs_review'").select(
        (i * 2 + 1).alias("decision_id"), "transaction_id", F.when(ok() % 3 == 0, "confirm").otherwise("erase").alias("action"),
        F.lit("thought again").alias("rationale"), F.lit(None).cast("string").alias("review_reason"), F.col("created_at").alias("decided_at"))
    return one.unionByName(two)


DECIDED = f"""
SELECT *, CASE WHEN goal1 IS NOT NULL THEN goal1 ELSE status END AS s1, CASE WHEN n = 2 AND {OK} % 3 = 0 THEN 'confirmed' END AS goal2 FROM (
SELECT t.*, a.card_type, a.card_name, CASE WHEN t.status = 'needs_review' THEN 2 ELSE 1 END AS n, CASE
  WHEN {OK} % 23 = 0 THEN 'Every decision needs its reason written down'
  WHEN {OK} % 4 = 0 AND a.card_type = 'bank_account' THEN a.card_name || ' follows a bank''s statement, so none of its lines may be voided'
  WHEN {OK} % 4 = 2 AND review_reason IS NULL THEN 'Reopening needs a question to answer' END AS error1,
  CASE WHEN {OK} % 23 = 0 OR ({OK} % 4 = 0 AND a.card_type = 'bank_account') OR ({OK} % 4 = 2 AND review_reason IS NULL) OR {OK} % 4 = 3 THEN NULL
    WHEN {OK} % 4 = 0 THEN 'voided' WHEN {OK} % 4 = 1 THEN 'confirmed' ELSE 'needs_review' END AS goal1
FROM fx_transactions t JOIN fx_accounts a USING (card_id))"""


@query("judge_decisions", "I8", f"""
SELECT transaction_id * 2 AS decision_id, error1 AS error, status AS from_status, s1 AS to_status FROM ({DECIDED})
UNION ALL SELECT transaction_id * 2 + 1, CASE WHEN goal2 IS NULL THEN 'Not an action: erase' END, s1, coalesce(goal2, s1) FROM ({DECIDED}) WHERE n = 2""",
       "decision_id error from_status to_status")
def judge_decisions(spark, d):
    return E.judge_decisions(transactions(spark, d), accounts(spark, d), decisions(spark, d)).select(
        "decision_id", "error", "from_status", "to_status")


@query("apply_decisions", "I8", f"""
SELECT transaction_id, to_status AS status, coalesce(to_status = 'confirmed' AND decided AND exchange_rate IS NOT NULL AND (currency IS NULL OR original_amount IS NULL), FALSE) AS rate_accepted_incomplete
FROM (SELECT *, coalesce(goal2, s1) AS to_status, error1 IS NULL OR goal2 IS NOT NULL AS decided FROM ({DECIDED}))""", "transaction_id status rate_accepted_incomplete")
def apply_decisions(spark, d):
    t = transactions(spark, d)
    judged = E.judge_decisions(t, accounts(spark, d), decisions(spark, d))
    return E.apply_decisions(t, judged).select("transaction_id", "status", "rate_accepted_incomplete")


@query("void_extra_copies", "I13 F13", """
SELECT transaction_id, card_id, copy, in_balance, CASE WHEN in_balance THEN -amount_aed ELSE 0 END AS effect FROM (
SELECT t.*, a.opening_date IS NULL OR t.txn_date >= a.opening_date AS in_balance,
  row_number() OVER (PARTITION BY card_id, txn_date, amount_aed, supplier_raw ORDER BY created_at, transaction_id) AS copy
FROM fx_transactions t JOIN fx_accounts a USING (card_id) WHERE t.status <> 'voided') WHERE copy > 1""", "transaction_id card_id #copy in_balance $effect")
def void_extra_copies(spark, d):
    by_hand = transactions(spark, d).withColumn("source_sheet", F.lit(None).cast("string"))
    return E.void_extra_copies(by_hand, accounts(spark, d)).select("transaction_id", "card_id", "copy", "in_balance", "effect")


@query("mark_bank_charges", "I14 X13", f"""
SELECT transaction_id, CASE WHEN a.card_type = 'bank_account' AND t.status <> 'voided' AND starts_with(supplier_raw, 'CHARGES AND FEES') AND trim(coalesce(req_number, '')) = ''
  THEN 'BAC' ELSE req_number END AS req_number FROM ({BLANKED}) t JOIN fx_accounts a USING (card_id)""", "transaction_id req_number")
def mark_bank_charges(spark, d):
    return E.mark_bank_charges(blanked(spark, d), accounts(spark, d)).select("transaction_id", "req_number")


#: Accounts that opened amid their rows.
OPENED = "SELECT card_id, max(txn_date) - CAST((max(txn_date) - min(txn_date)) // 2 AS INTEGER) AS opening_date FROM fx_transactions GROUP BY 1"


@query("repair_statement_dates", "I15 J15", f"""
WITH stated AS (SELECT line, card_id, amount_aed, txn_date AS bank_date, {voucher("coalesce(supplier_raw, '')")} AS voucher FROM fx_file),
span AS (SELECT card_id, min(bank_date) AS lo, max(bank_date) AS hi FROM stated GROUP BY 1)
SELECT t.transaction_id, coalesce(w.bank_date, t.txn_date) AS txn_date, t.date_repaired OR w.bank_date IS NOT NULL AS date_repaired FROM fx_transactions t
LEFT JOIN (SELECT * FROM ({VOUCHED}) WHERE outcome = 'date_differs') w ON w.transaction_id = t.transaction_id""", "transaction_id @txn_date date_repaired")
def repair_statement_dates(spark, d):
    statement = upload_lines(spark, d).withColumnRenamed("txn_date", "bank_date")
    return E.repair_statement_dates(transactions(spark, d), statement).select("transaction_id", "txn_date", "date_repaired")


@query("moved_balances", "I15", f"""
WITH stated AS (SELECT line, card_id, amount_aed, txn_date AS bank_date, {voucher("coalesce(supplier_raw, '')")} AS voucher FROM fx_file),
span AS (SELECT card_id, min(bank_date) AS lo, max(bank_date) AS hi FROM stated GROUP BY 1)
SELECT t.transaction_id, t.card_id, t.txn_date AS old_date, w.bank_date AS new_date, a.opening_date,
  CASE WHEN w.bank_date >= a.opening_date THEN t.amount_aed ELSE -t.amount_aed END AS effect
FROM fx_transactions t JOIN ({VOUCHED}) w ON w.transaction_id = t.transaction_id AND w.outcome = 'date_differs' JOIN ({OPENED}) a ON a.card_id = t.card_id
WHERE (t.txn_date >= a.opening_date) <> (w.bank_date >= a.opening_date)""", "transaction_id card_id @old_date @new_date @opening_date $effect")
def moved_balances(spark, d):
    t = transactions(spark, d)
    opened = t.groupBy("card_id").agg(F.expr("date_sub(max(txn_date), CAST(datediff(max(txn_date), min(txn_date)) DIV 2 AS INT))").alias("opening_date"))
    repaired = E.repair_statement_dates(t, upload_lines(spark, d).withColumnRenamed("txn_date", "bank_date"))
    return E.moved_balances(t, repaired, opened)


@query("build_update_rows_by_id", "I9 J14", """
SELECT line, held_id, error, unchanged FROM (SELECT *, coalesce(error IS NULL AND value = coalesce(payment_ref, ''), FALSE) AS unchanged FROM (
SELECT transaction_id AS line, card_id, payment_ref, CASE WHEN transaction_id % 19 = 0 THEN NULL ELSE transaction_id END AS held_id, value,
  CASE WHEN transaction_id % 19 = 0 THEN 'The ledger has no row of this id.' WHEN transaction_id % 23 = 0 THEN 'Sheet and ledger differ in a field that this update leaves alone'
   WHEN value = '' THEN 'The sheet gives no value to fill in' END AS error
FROM (SELECT *, CASE transaction_id % 4 WHEN 0 THEN '' WHEN 1 THEN coalesce(payment_ref, '') ELSE 'PAY 9' END AS value FROM fx_transactions)))""", "line held_id error unchanged")
def build_update_rows_by_id(spark, d):
    i = F.col("transaction_id")
    t = transactions(spark, d)
    lines = t.select(
        i.alias("line"), "card_id", F.when(i % 19 == 0, F.concat(F.lit("none "), i.cast("string"))).otherwise(i.cast("string")).alias("ledger_id"),
        F.when(i % 4 == 0, " ").when(i % 4 == 1, F.col("payment_ref")).otherwise("PAY 9").alias("value"),
        F.col("txn_date").cast("string").alias("sheet_date"), (F.col("amount_aed") + F.when(i % 23 == 0, 1).otherwise(0)).cast("decimal(18,2)").alias("sheet_amount"))
    return E.build_update_rows(lines, t, "payment_ref").select("line", "held_id", "error", "unchanged")


BALANCE_LINES = f"""
SELECT s.transaction_id AS line, CASE WHEN s.transaction_id % 9 = 0 THEN s.statement_balance + 5000000 ELSE s.statement_balance END AS balance, amount_aed, req_number,
  CASE transaction_id % 4 WHEN 0 THEN '' WHEN 1 THEN upper(trim(coalesce(req_number, ''))) ELSE 'REQ 5' END AS value, s.card_id FROM fx_statement s WHERE statement_balance IS NOT NULL"""


@query("build_update_rows_by_balance", "I9 J13", f"""
SELECT line, held_id, empty, unchanged, differs, held_id IS NOT NULL AND error IS NULL AND NOT unchanged AND NOT empty AND NOT differs AS include FROM (
SELECT l.line, CASE WHEN n = 1 THEN id END AS held_id, coalesce(n = 1 AND value = '', FALSE) AS empty,
  coalesce(n = 1 AND value <> '' AND upper(value) = upper(trim(coalesce(h.req_number, ''))), FALSE) AS unchanged,
  coalesce(n = 1 AND value <> '' AND upper(value) <> upper(trim(coalesce(h.req_number, ''))) AND trim(coalesce(h.req_number, '')) <> '', FALSE) AS differs,
  CASE WHEN n IS NULL THEN 'none' WHEN n > 1 THEN 'shared' WHEN abs(abs(l.amount_aed) - abs(h.amount_aed)) >= 0.005 THEN 'amount' END AS error
FROM ({BALANCE_LINES}) l LEFT JOIN (SELECT card_id, statement_balance AS b, count(*) AS n, min(transaction_id) AS id FROM fx_statement WHERE statement_balance IS NOT NULL GROUP BY 1, 2) k
  ON k.card_id = l.card_id AND k.b = l.balance LEFT JOIN fx_statement h ON h.transaction_id = CASE WHEN n = 1 THEN id END)""", "line held_id empty unchanged differs include")
def build_update_rows_by_balance(spark, d):
    i = F.col("transaction_id")
    s = statement_lines(spark, d)
    lines = s.filter("statement_balance IS NOT NULL").select(
        i.alias("line"), "card_id", (F.col("statement_balance") + F.when(i % 9 == 0, 5000000).otherwise(0)).cast("decimal(18,2)").alias("balance"),
        F.col("amount_aed").alias("sheet_amount"), F.col("txn_date").cast("string").alias("sheet_date"),
        F.when(i % 4 == 0, "").when(i % 4 == 1, F.upper("req_number")).otherwise("REQ 5").alias("value"))
    return E.build_update_rows(lines, s, "req_number", by="balance").select("line", "held_id", "empty", "unchanged", "differs", "include")


@query("fill_references", "I10 J13 H7", f"""
SELECT l.line, held_id, CASE WHEN n > 1 THEN 'shared balance' WHEN n IS NULL THEN 'no such balance' WHEN l.line % 7 = 0 THEN 'dated differently'
  WHEN trim(coalesce(h.req_number, '')) = '' THEN 'fill' WHEN upper(trim(h.req_number)) = upper(value) THEN 'already there' ELSE 'disagrees' END AS outcome FROM (
SELECT l.*, n, CASE WHEN n = 1 THEN id END AS held_id FROM ({BALANCE_LINES}) l LEFT JOIN (SELECT card_id, statement_balance AS b, count(*) AS n, min(transaction_id) AS id
  FROM fx_statement WHERE statement_balance IS NOT NULL GROUP BY 1, 2) k ON k.card_id = l.card_id AND k.b = l.balance WHERE value <> '') l
LEFT JOIN fx_statement h ON h.transaction_id = held_id""", "line held_id outcome")
def fill_references(spark, d):
    i = F.col("transaction_id")
    s = statement_lines(spark, d)
    lines = s.filter("statement_balance IS NOT NULL").select(
        i.alias("line"), "card_id", (F.col("statement_balance") + F.when(i % 9 == 0, 5000000).otherwise(0)).cast("decimal(18,2)").alias("balance"),
        F.date_add("txn_date", F.when(i % 7 == 0, 1).otherwise(0)).alias("sheet_date"),
        F.when(i % 4 == 0, "").when(i % 4 == 1, F.upper("req_number")).otherwise("REQ 5").alias("reference"))
    return E.fill_references(lines, s).select("line", "held_id", "outcome")


@query("judge_accounts", "I20", """
SELECT card_id AS request_id, array_to_string(list_filter([
  CASE WHEN card_id % 3 = 0 THEN 'The name "' || card_name || '" is taken' END,
  CASE WHEN card_id % 5 = 0 AND tracks_balance THEN 'Its opening balance is missing' END,
  CASE WHEN opening_date IS NULL AND tracks_balance THEN 'The day of its opening balance is missing' END,
  CASE WHEN card_id % 7 = 0 THEN 'It settles in an unknown currency: ZZZ' END,
  CASE WHEN card_id % 11 = 0 THEN 'Its reference is longer than eight characters' END,
  CASE WHEN card_id % 13 = 0 THEN 'Its balance sign is neither 1 nor -1' END], lambda x: x IS NOT NULL), ',') AS errors FROM fx_accounts""",
       "request_id errors")
def judge_accounts(spark, d):
    a, c = accounts(spark, d), F.col("card_id")
    new = a.select(
        c.alias("request_id"), F.when(c % 3 == 0, F.col("card_name")).otherwise(F.concat(F.lit(" New "), "card_name")).alias("card_name"),
        F.when(c % 5 != 0, F.col("opening_balance")).alias("opening_balance"), "opening_date", "card_type", "status",
        F.when(c % 7 == 0, "ZZZ").otherwise(F.col("settlement_currency")).alias("settlement_currency"),
        F.when(c % 11 == 0, "123456789").otherwise(F.col("account_reference")).alias("account_reference"),
        F.when(c % 13 == 0, 2).otherwise(F.col("balance_sign")).alias("balance_sign"), "tracks_balance")
    return E.judge_accounts(a, new).select("request_id", "errors")


# ------------------------------------------------------------------ reports

@query("bank_charges", "A16", """
SELECT t.card_id, a.card_name, a.settlement_currency, count(*) FILTER (WHERE bac) AS bac_rows, coalesce(sum(-amount_aed) FILTER (WHERE bac), 0) AS bac_cost,
  count(*) FILTER (WHERE charge) AS charge_lines, count(*) FILTER (WHERE charge AND bac) AS marked, count(*) FILTER (WHERE charge AND req = '') AS unmarked,
  count(*) FILTER (WHERE charge AND NOT bac AND req <> '') AS own_reference, count(*) FILTER (WHERE NOT charge AND bac) AS bac_not_charges
FROM (SELECT *, upper(trim(coalesce(req_number, ''))) AS req, upper(trim(coalesce(req_number, ''))) = 'BAC' AS bac, coalesce(starts_with(supplier_raw, 'CHARGES AND FEES'), FALSE) AS charge
  FROM fx_transactions WHERE status <> 'voided') t JOIN fx_accounts a USING (card_id) WHERE a.card_type = 'bank_account' GROUP BY 1, 2, 3""",
       "card_id card_name settlement_currency #bac_rows $bac_cost #charge_lines #marked #unmarked #own_reference #bac_not_charges")
def bank_charges(spark, d):
    return R.bank_charges(transactions(spark, d), accounts(spark, d))


@query("missing_references", "A17 F7", """
SELECT t.card_id, a.card_name, a.settlement_currency, count(*) AS row_count, sum(-amount_aed) AS value, min(txn_date) AS first_day, max(txn_date) AS last_day
FROM fx_transactions t JOIN fx_accounts a USING (card_id) WHERE t.status <> 'voided' AND amount_aed < 0 AND trim(coalesce(req_number, '')) = '' GROUP BY 1, 2, 3""",
       "card_id card_name settlement_currency #row_count $value @first_day @last_day")
def missing_references(spark, d):
    return R.missing_references(transactions(spark, d), accounts(spark, d))


@query("review_counts", "A19", f"SELECT kind, count(*) AS n FROM ({OPEN}) GROUP BY 1", "kind #n")
def review_counts(spark, d):
    return R.review_counts(Q.open_review_items(transactions(spark, d), accounts(spark, d)))


@query("open_items_by_account", "A20", f"""
SELECT b.card_id, b.card_name, b.settlement_currency, b.reconciliation_difference, coalesce(n, 0) AS open_items FROM ({BALANCES}) b
LEFT JOIN (SELECT card_id, count(*) AS n FROM ({OPEN}) GROUP BY 1) o ON o.card_id = b.card_id WHERE coalesce(n, 0) > 0 OR abs(b.reconciliation_difference) > 0.005""",
       "card_id card_name settlement_currency $reconciliation_difference #open_items")
def open_items_by_account(spark, d):
    t, a = transactions(spark, d), accounts(spark, d)
    return R.open_items_by_account(Q.open_review_items(t, a), B.account_balances(t, a))


@query("sort_transactions", "O1", "SELECT transaction_id, card_id, amount_aed FROM fx_transactions", "transaction_id card_id $amount_aed")
def sort_transactions(spark, d):
    return R.sort_transactions(transactions(spark, d), accounts(spark, d), "amount", "desc").select("transaction_id", "card_id", "amount_aed")


EXPORT = r"""
SELECT CAST(transaction_id AS VARCHAR) AS id, a.card_name AS card, CAST(txn_date AS VARCHAR) AS day, coalesce(regexp_replace(supplier_raw, '\s\d{3}\s*$', ''), description, '') AS supplier,
  CAST(amount_aed AS VARCHAR) AS settled, CASE WHEN entry_type = 'reconciliation_adjustment' THEN 'Reconciliation adjustment' WHEN direction = 'spend' THEN 'Spend' ELSE 'Funding' END AS type,
  replace(t.status, '_', ' ') AS status, CASE WHEN included_in_source_balance THEN 'Yes' ELSE 'No' END AS in_balance, coalesce(source_sheet, 'manual entry') AS sheet
FROM fx_transactions t JOIN fx_accounts a USING (card_id)"""
EXPORT_NAMES = {"Ledger ID": "id", "Card": "card", "Date": "day", "Supplier": "supplier", "AED settlement": "settled", "Type": "type",
                "Status": "status", "In source balance": "in_balance", "Source sheet": "sheet"}


@query("export_transactions", "K1 F11", EXPORT, "id card day supplier settled type status in_balance sheet")
def export_transactions(spark, d):
    path = shared_dir(spark, "export")
    R.export_transactions(transactions(spark, d), accounts(spark, d), path)
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("emptyValue", "").csv(path)
    return back.select(*[F.coalesce(F.col(f"`{k}`"), F.lit("")).alias(v) for k, v in EXPORT_NAMES.items()])


@query("export_by_account", "K2", f"""
SELECT a.card_id, a.card_name, coalesce(n, 0) AS transactions, coalesce(n, 0) AS exported, b.source_balance AS statement_balance, b.last_transaction AS last_activity
FROM fx_accounts a JOIN ({BALANCES}) b USING (card_id) LEFT JOIN (SELECT card_id, count(*) AS n FROM fx_transactions GROUP BY 1) t USING (card_id)""",
       "card_id card_name #transactions #exported $statement_balance @last_activity")
def export_by_account(spark, d):
    path = shared_dir(spark, "by-account")
    t, a = transactions(spark, d), accounts(spark, d)
    R.export_by_account(t, a, B.account_balances(t, a), path)
    rows = spark.read.parquet(f"{path}/transactions").groupBy(F.col("Card").alias("card_name")).agg(F.count(F.lit(1)).alias("exported"))
    return spark.read.parquet(f"{path}/summary").join(rows, "card_name", "left").select(
        "card_id", "card_name", "transactions", F.coalesce("exported", F.lit(0)).alias("exported"), "statement_balance", "last_activity")


@query("export_reconciliation", "K3 O3 A13 X19", f"""
SELECT card_id, strftime(txn_date, '%Y-%m') AS month, line_no AS seq, CASE WHEN amount_aed < 0 THEN -amount_aed END AS debit, CASE WHEN amount_aed >= 0 THEN amount_aed END AS credit,
  m.opening + sum(amount_aed) OVER (PARTITION BY o.card_id, strftime(txn_date, '%Y-%m') ORDER BY line_no) AS balance,
  amount_aed > 0 OR (trim(coalesce(req_number, '')) <> '' AND upper(trim(req_number)) <> 'BAC') AS settled
FROM ({BANK_ORDER}) o JOIN (SELECT card_id AS mc, month AS mm, opening FROM ({MONTHS})) m ON m.mc = o.card_id AND m.mm = strftime(o.txn_date, '%Y-%m')
UNION ALL SELECT card_id, month, 0, NULL, NULL, opening, NULL FROM ({MONTHS}) JOIN (SELECT card_id AS bc FROM fx_accounts WHERE card_type = 'bank_account') ON bc = card_id""",
       "card_id month #seq $debit $credit $balance settled")
def export_reconciliation(spark, d):
    path = shared_dir(spark, "months")
    R.export_reconciliation(statement_lines(spark, d), accounts(spark, d), path)
    return spark.read.option("inferSchema", False).parquet(path).select(
        "card_id", F.date_format(F.concat(F.col("month").cast("string"), F.lit("-01")).try_cast("date"), "yyyy-MM").alias("month"),
        "seq", "debit", "credit", "balance", "settled")


@query("sample_extract", "K5", f"""
SELECT part, count(*) AS documents, sum(amount) AS amount FROM (
SELECT 'transactions' AS part, CAST(amount_aed AS DOUBLE) AS amount FROM fx_transactions UNION ALL SELECT 'cards', CAST(ledger_balance AS DOUBLE) FROM ({BALANCES})
UNION ALL SELECT 'spendByCurrency', CAST(total_settled_aed AS DOUBLE) FROM ({SPEND})) GROUP BY 1""", "part #documents #amount")
def sample_extract(spark, d):
    t, a = transactions(spark, d), accounts(spark, d)
    path = shared_dir(spark, "sample")
    extract = R.sample_extract(t, B.account_balances(t, a), B.spend_by_currency(t, a))
    # One write for each part: written by partitions, all lines would be sorted by part first.
    for part in R.EXTRACT_PARTS:
        extract.filter(F.col("part") == part).select("json").write.text(f"{path}/part={part}")
    back = spark.read.text(path)
    figure = F.coalesce(*[F.get_json_object("value", p) for p in ("$.amount_aed", "$.ledger_balance", "$.aedTotal")])
    return back.groupBy("part").agg(F.count(F.lit(1)).alias("documents"), F.sum(figure.cast("decimal(28,2)")).alias("amount")) \
        .withColumn("amount", F.round("amount", 0).cast("bigint"))


@query("snapshot_and_restore", "K4 U4", """
SELECT transaction_id, status, amount_aed FROM fx_transactions""", "transaction_id status $amount_aed")
def snapshot_and_restore(spark, d):
    path = shared_dir(spark, "snapshots")
    t = transactions(spark, d).select("transaction_id", "status", "amount_aed")
    files_.write_snapshot(t, path, 1)
    files_.write_snapshot(t.filter("status = 'confirmed'").withColumn("status", F.lit("voided")), path, 2)
    return files_.restore_snapshot(spark, path, 1, 3)


# ------------------------------------------------------------------ sources

@query("read_ledger", "S3", """
SELECT t.transaction_id, a.card_name, t.amount_aed, t.notes FROM fx_transactions t JOIN fx_accounts a USING (card_id)""", "transaction_id card_name $amount_aed notes")
def read_ledger(spark, d):
    path = shared_dir(spark, "ledger")
    files_.write_ledger(transactions(spark, d), accounts(spark, d), path)
    t, a = files_.read_ledger(spark, path)
    return t.join(a.select("card_id", "card_name"), "card_id").select("transaction_id", "card_name", "amount_aed", "notes")


@query("read_csv_grid", "S1", r"""
SELECT CAST(transaction_id AS VARCHAR) AS id, supplier_raw AS narrative, 'say "' || status || '", ok' AS quoted FROM fx_transactions""", "id narrative quoted")
def read_csv_grid(spark, d):
    path = shared_dir(spark, "statements")
    transactions(spark, d).select(
        F.col("transaction_id").cast("string").alias("a"), F.col("supplier_raw").alias("b"),
        F.concat(F.lit('say "'), F.col("status"), F.lit('", ok')).alias("c")).write.option("escape", '"').option("emptyValue", "").csv(path)
    cells = files_.read_csv_grid(spark, path)
    # One output row per file row: at most three cells each.
    at = lambda n: F.max(F.when(F.col("col") == n, F.col("text")))
    return cells.groupBy("file", "row").agg(at(1).alias("id"), at(2).alias("narrative"), at(3).alias("quoted")).drop("file", "row")


EXTRACT_SCHEMA = ("card string, opening_balance double, transactions array<struct<transaction_id: bigint, txn_date: string, amount_aed: double>>")


@query("load_extraction", "S4", """
SELECT CAST(transaction_id // 10 AS VARCHAR) AS card_name, min(txn_date) AS opening_date, count(*) AS row_count FROM fx_transactions GROUP BY 1""", "card_name @opening_date #row_count")
def load_extraction(spark, d):
    path = shared_dir(spark, "extraction")
    # One document per order: at most three transactions each.
    transactions(spark, d).groupBy(ok().cast("string").alias("card")).agg(
        F.lit(100.0).alias("opening_balance"), F.collect_list(F.struct("transaction_id", "txn_date", "amount_aed")).alias("transactions")) \
        .write.json(path)
    return files_.read_extraction(spark, path, EXTRACT_SCHEMA)[0].select("card_name", "opening_date", "row_count")


# ------------------------------------------------------------------ streams

SIG = "concat_ws('|', card_id, txn_date, kind, amount, supplier)"


SUPPRESS_SQL = f"""
WITH RECURSIVE handed_in AS (SELECT {SIG} AS sig, submitted_at AS moment, allow_duplicate AS allowed FROM fx_submissions),
accepted AS (SELECT sig, min(moment) AS moment FROM handed_in GROUP BY sig UNION ALL
  SELECT x.sig, min(y.moment) FROM accepted x JOIN handed_in y ON y.sig = x.sig AND y.moment > x.moment
    AND (y.allowed OR y.moment >= x.moment + INTERVAL 30 MINUTE) GROUP BY x.sig, x.moment)
SELECT s.submission_id FROM fx_submissions s JOIN accepted a ON a.sig = {SIG} AND a.moment = s.submitted_at"""


@query("suppress_double_submits", "T1", SUPPRESS_SQL, "submission_id")
def suppress_double_submits(spark, d):
    return ST.suppress_double_submits(submissions(spark, d), seconds=1800).select("submission_id")


@query("suppress_double_submits_stream", "T1", SUPPRESS_SQL, "submission_id")
def suppress_double_submits_stream(spark, d):
    """The submissions in three deliveries, every third one in the first: most arrive behind later ones."""
    base = shared_dir(spark, "submits")
    rows = submissions(spark, d)
    # A delivery is as many files as there are cores to write and read them.
    files = spark.sparkContext.defaultParallelism
    for part in range(3):
        rows.filter(F.pmod("submission_id", F.lit(3)) == 2 - part).repartition(files, "submission_id").write.mode("append").parquet(f"{base}/in")
    live = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{base}/in")
    with state_on_disk(spark):
        ST.judge_submissions_stream(live, 1800).writeStream.outputMode("append").format("parquet").option("path", f"{base}/out") \
            .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return ST.accepted_submissions(rows, spark.read.parquet(f"{base}/out")).select("submission_id")


def _rows_as_files(df, path, parts=4):
    df.repartition(parts).write.parquet(path)
    return path


@query("monthly_activity_stream", "T4 A6", """
SELECT a.settlement_currency, strftime(txn_date, '%Y-%m') AS month, coalesce(sum(amount_aed) FILTER (WHERE direction = 'spend'), 0) AS spend,
  coalesce(sum(amount_aed) FILTER (WHERE direction = 'funding'), 0) AS funding FROM fx_transactions t JOIN fx_accounts a USING (card_id)
WHERE t.entry_type = 'source_transaction' AND t.status <> 'voided' GROUP BY 1, 2""", "settlement_currency month $spend $funding")
def monthly_activity_stream(spark, d):
    base = shared_dir(spark, "activity")
    t = transactions(spark, d).select("card_id", "txn_date", "entry_type", "status", "direction", "amount_aed")
    _rows_as_files(t, f"{base}/in")
    live = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    out = f"{base}/out"

    def keep(batch, batch_id):
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    ST.monthly_activity_stream(live, accounts(spark, d)).writeStream.outputMode("update").foreachBatch(keep) \
        .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    every = spark.read.parquet(out)
    return every.groupBy("settlement_currency", "month").agg(
        F.max_by("spend", "batch").alias("spend"), F.max_by("funding", "batch").alias("funding"))


def _decided(spark, d):
    """The log after two micro-batches: the first decisions of all rows, then the second ones."""
    base = shared_dir(spark, "events")
    j = decisions(spark, d)
    for part in range(2):
        j.filter(F.pmod("decision_id", F.lit(2)) == part).coalesce(1).write.mode("append").parquet(f"{base}/in")
    live = spark.readStream.schema(j.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    schema = ", ".join(f"{n} {t}" for n, t in ST.decision_log(ST.judge_decisions(
        transactions(spark, d), accounts(spark, d), j)).dtypes)
    spark.createDataFrame([], schema).write.parquet(f"{base}/log/start")
    step = ST.ledger_events(f"{base}/log", lambda s: transactions(s, d), lambda s: accounts(s, d), schema)
    live.writeStream.foreachBatch(step).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").schema(schema).parquet(f"{base}/log")


@query("ledger_events", "T3 I8", f"""
SELECT transaction_id, coalesce(goal2, s1) AS status FROM ({DECIDED})""", "transaction_id status")
def ledger_events(spark, d):
    return ST.current_status(transactions(spark, d), _decided(spark, d)).select("transaction_id", "status")


@query("ledger_event_log", "T3", f"""
SELECT transaction_id * 2 AS decision_id, status AS from_status, s1 AS to_status FROM ({DECIDED}) WHERE error1 IS NULL
UNION ALL SELECT transaction_id * 2 + 1, s1, goal2 FROM ({DECIDED}) WHERE n = 2 AND goal2 IS NOT NULL""", "decision_id from_status to_status")
def ledger_event_log(spark, d):
    return _decided(spark, d).select("decision_id", "from_status", "to_status")


@query("incremental_import", "T2 I2 I6", f"""
SELECT count(*) AS added, CAST(sum(abs(f.amount_aed)) AS DECIMAL(28,2)) AS amount FROM ({CLASSIFY_SQL}) q JOIN fx_file f ON f.line = q.line
WHERE outcome IN ('new', 'missing_copy') AND f.supplier_raw IS NOT NULL AND f.amount_aed <> 0""", "#added $amount")
def incremental_import(spark, d):
    base = shared_dir(spark, "ledger")
    held = transactions(spark, d).select(
        "transaction_id", "card_id", "txn_date", "entry_type", "status", "direction", "amount_aed", "supplier_raw", "description",
        "payment_ref", "req_number", "source_sheet", "source_row", "created_at")
    held.write.parquet(f"{base}/rows/start")
    lines = upload_lines(spark, d)
    _rows_as_files(lines, f"{base}/in", 2)

    def to_batch(fresh):
        return fresh.select(
            (F.col("line") + 1_000_000_000_000).alias("submission_id"), "card_id", "txn_date",
            F.when(F.col("amount_aed") < 0, "purchase").otherwise("funding").alias("kind"), F.abs("amount_aed").alias("amount"),
            F.col("supplier_raw").alias("supplier"), "req_number", "payment_ref",
            F.col("txn_date").cast("timestamp_ntz").alias("submitted_at"))

    live = spark.readStream.schema(lines.schema).parquet(f"{base}/in")
    # The same file offered twice: the second time nothing is new.
    for round_ in (0, 1):
        step = ST.incremental_import(f"{base}/rows", to_batch, held.schema)
        live.writeStream.foreachBatch(lambda df, i, r=round_: step(df, 10 * r + i)).option(
            "checkpointLocation", f"{base}/checkpoint-{round_}").trigger(availableNow=True).start().awaitTermination()
    grown = spark.read.schema(held.schema).option("recursiveFileLookup", "true").parquet(f"{base}/rows")
    return grown.filter(F.col("transaction_id") >= 1_000_000_000_000).agg(
        F.count(F.lit(1)).alias("added"), F.sum(F.abs("amount_aed")).cast("decimal(28,2)").alias("amount"))
