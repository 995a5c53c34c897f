"""Runnable queries: printed balances, bank order, standing checks and audit trails."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import accounts, statement_lines, submissions, table, transactions
from ..functions.amounts import implied_rate
from ..functions.dates import swapped
from ..operators import balances as B
from ..operators import chains as C
from ..operators import checks as Q
from ..operators import filters as L
from ..operators import matching as M
from ..operators import statistics as S

from ..schema import WORKBOOK_CURRENCIES
from .filters_and_totals import MONTHS
from .registry import query
from .sql_parts import BALANCES, SIGNATURE


def order_number():
    """A whole number that grows with (date, id): the row a line stands on."""
    return F.datediff("txn_date", F.lit("1990-01-01").cast("date")).cast("bigint") * 10_000_000_000 + F.col("transaction_id")


ORDER_SQL = "(CAST(date_diff('day', DATE '1990-01-01', txn_date) AS BIGINT) * 10000000000 + transaction_id)"

BANK_ORDER = """
SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY p.earliest NULLS FIRST, p.sheet NULLS FIRST, p.line NULLS FIRST, p.id NULLS FIRST,
  loose, loose_date NULLS FIRST, transaction_id) AS line_no FROM (
SELECT * EXCLUDE (place), coalesce(place, max(place) OVER (PARTITION BY card_id ORDER BY txn_date, loose, transaction_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS p, CASE WHEN loose THEN txn_date END AS loose_date FROM (
  SELECT s.*, s.statement_balance IS NULL AS loose,
    CASE WHEN s.statement_balance IS NOT NULL THEN {'earliest': v.earliest, 'sheet': coalesce(s.source_sheet, ''),
      'line': v.way * coalesce(s.source_row, 0), 'id': v.way * s.transaction_id} END AS place
  FROM fx_statement s LEFT JOIN (
    SELECT card_id, sh, min(txn_date) AS earliest, CASE WHEN
       count(*) FILTER (WHERE abs(sb - (below + amount_aed)) < 0.005) > count(*) FILTER (WHERE abs(sb - (above + amount_aed)) < 0.005)
       THEN -1 ELSE 1 END AS way,
       count(*) FILTER (WHERE abs(sb - (above + amount_aed)) < 0.005) AS forward,
       count(*) FILTER (WHERE abs(sb - (below + amount_aed)) < 0.005) AS backward
    FROM (SELECT card_id, coalesce(source_sheet, '') AS sh, txn_date, amount_aed, statement_balance AS sb,
      lag(statement_balance) OVER w AS above, lead(statement_balance) OVER w AS below FROM fx_statement
      WHERE statement_balance IS NOT NULL
      WINDOW w AS (PARTITION BY card_id, coalesce(source_sheet, '') ORDER BY coalesce(source_row, 0), transaction_id))
    GROUP BY card_id, sh) v ON v.card_id = s.card_id AND v.sh = coalesce(s.source_sheet, '')))
"""


def _statements(spark, d):
    return statement_lines(spark, d), accounts(spark, d)


@query("bank_order", "O3 W6", f"SELECT card_id, transaction_id, line_no FROM ({BANK_ORDER})", "card_id transaction_id #line_no")
def bank_order(spark, d):
    return C.bank_order(statement_lines(spark, d)).select("card_id", "transaction_id", "line_no")


@query("sheet_starts", "W6 O4", """
SELECT transaction_id, source_sheet, min(txn_date) OVER (PARTITION BY card_id, source_sheet) AS sheet_start,
  substring(source_sheet, 4, 4) || substring(source_sheet, 1, 2) AS sheet_month FROM fx_transactions""",
       "transaction_id source_sheet @sheet_start sheet_month")
def sheet_starts(spark, d):
    from ..functions.dates import sheet_month
    return C.sheet_starts(transactions(spark, d)).select(
        "transaction_id", "source_sheet", "sheet_start", sheet_month(F.col("source_sheet")).alias("sheet_month"))


CHAIN = f"""
SELECT *, abs(running_balance - statement_balance) < 0.005 AS agrees FROM (
SELECT o.*, a.opening_balance + sum(amount_aed) OVER (PARTITION BY o.card_id ORDER BY line_no) AS running_balance
FROM ({BANK_ORDER}) o JOIN fx_accounts a ON a.card_id = o.card_id WHERE statement_balance IS NOT NULL)"""


@query("chain_lines", "W2 W3", f"SELECT card_id, transaction_id, line_no, running_balance, statement_balance, agrees FROM ({CHAIN})",
       "card_id transaction_id #line_no $running_balance $statement_balance agrees")
def chain_lines(spark, d):
    return C.chain_lines(*_statements(spark, d)).select(
        "card_id", "transaction_id", "line_no", "running_balance", "statement_balance", "agrees")


@query("chain_check", "W3", f"""
SELECT card_id, count(*) AS lines, count(*) FILTER (WHERE agrees) AS agreed, min(line_no) FILTER (WHERE NOT agrees) AS first_break_line,
  arg_min(txn_date, line_no) FILTER (WHERE NOT agrees) AS first_break_date,
  arg_min(running_balance, line_no) FILTER (WHERE NOT agrees) AS ledger_says,
  arg_min(statement_balance, line_no) FILTER (WHERE NOT agrees) AS bank_says
FROM ({CHAIN}) GROUP BY card_id""",
       "card_id #lines #agreed #first_break_line @first_break_date $ledger_says $bank_says")
def chain_check(spark, d):
    return C.chain_check(*_statements(spark, d))


RESYNC = """
SELECT *, printed - moved AS lvl FROM (SELECT s.transaction_id, s.card_id, s.txn_date, s.statement_balance AS printed,
  (s.transaction_id // 10) % 101 = 0 AS reseed, a.opening_balance AS opening,
  sum(s.amount_aed) OVER (PARTITION BY s.card_id ORDER BY s.txn_date, s.transaction_id) AS moved
FROM fx_statement s JOIN fx_accounts a ON a.card_id = s.card_id WHERE s.included_in_source_balance) WHERE printed IS NOT NULL"""


@query("chain_breaks_resync", "W4", f"""
SELECT transaction_id, card_id, computed, printed, computed - printed AS delta,
  CASE WHEN reseed THEN 'reseed' WHEN abs(computed - printed) > 0.005 THEN 'mismatch' ELSE 'ok' END AS kind FROM (
SELECT *, coalesce(lag(lvl) OVER (PARTITION BY card_id ORDER BY txn_date, transaction_id), opening) + moved AS computed FROM ({RESYNC}))""",
       "transaction_id card_id $computed $printed $delta kind")
def chain_breaks_resync(spark, d):
    s, a = _statements(spark, d)
    s = s.withColumn("reseed_balance", F.when(F.floor(F.col("transaction_id") / 10) % 101 == 0, F.col("statement_balance")))
    return C.chain_breaks_resync(s, a, ["txn_date", "transaction_id"]).select(
        "transaction_id", "card_id", "computed", "printed", "delta", "kind")


@query("balance_voting", "W12 H5", f"""
SELECT file, debit_lowers, credit_lowers, CASE WHEN greatest(debit_lowers, credit_lowers) >= 3
   AND greatest(debit_lowers, credit_lowers) > 2 * least(debit_lowers, credit_lowers)
   THEN CASE WHEN debit_lowers > credit_lowers THEN 'debit' ELSE 'credit' END END AS lowers FROM (
SELECT file,
  count(*) FILTER (WHERE down AND abs(b - (pb - d + c)) < 0.005) + count(*) FILTER (WHERE up AND abs(pb - (b - pd + pc)) < 0.005) AS debit_lowers,
  count(*) FILTER (WHERE down AND NOT abs(b - (pb - d + c)) < 0.005 AND abs(b - (pb + d - c)) < 0.005)
  + count(*) FILTER (WHERE up AND NOT abs(pb - (b - pd + pc)) < 0.005 AND abs(pb - (b + pd - pc)) < 0.005) AS credit_lowers
FROM (SELECT *, d <> 0 OR c <> 0 AS down, pd <> 0 OR pc <> 0 AS up FROM (
  SELECT *, lag(b) OVER w AS pb, lag(d) OVER w AS pd, lag(c) OVER w AS pc FROM (
    SELECT card_id AS file, CASE WHEN card_id % 4 < 2 THEN {ORDER_SQL} ELSE -{ORDER_SQL} END AS r,
      CASE WHEN (amount_aed < 0) = (card_id % 2 = 0) THEN abs(amount_aed) ELSE 0 END AS d,
      CASE WHEN (amount_aed < 0) = (card_id % 2 = 0) THEN 0 ELSE abs(amount_aed) END AS c, statement_balance AS b
    FROM fx_statement WHERE statement_balance IS NOT NULL)
  WINDOW w AS (PARTITION BY file ORDER BY r)) WHERE pb IS NOT NULL) GROUP BY file)""",
       "file #debit_lowers #credit_lowers lowers")
def balance_voting(spark, d):
    as_debit = (F.col("amount_aed") < 0) == (F.col("card_id") % 2 == 0)
    size = F.abs("amount_aed")
    lines = statement_lines(spark, d).select(
        F.col("card_id").alias("file"), F.lit("all").alias("sheet"),
        F.when(F.col("card_id") % 4 < 2, order_number()).otherwise(-order_number()).alias("row"),
        F.when(as_debit, size).alias("debit"), F.when(~as_debit, size).alias("credit"),
        F.col("statement_balance").alias("balance"))
    return C.balance_voting(lines).drop("sheet")


DATED = f"""
SELECT card_id AS file, {ORDER_SQL} AS row, CASE WHEN card_id % 3 = 0 AND day(txn_date) <= 12 AND (transaction_id // 10) % 4 <> 0
  THEN make_date(year(txn_date), day(txn_date), month(txn_date)) ELSE txn_date END AS date,
  CASE WHEN (transaction_id // 10) % 4 = 0 THEN 'text' ELSE 'datetime' END AS kind FROM fx_transactions"""
BRACKETED = f"""
SELECT *, kind = 'text' OR day(date) > 12 AS certain,
  last_value(CASE WHEN kind = 'text' OR day(date) > 12 THEN date END IGNORE NULLS) OVER (PARTITION BY file ORDER BY row
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS date_before,
  first_value(CASE WHEN kind = 'text' OR day(date) > 12 THEN date END IGNORE NULLS) OVER (PARTITION BY file ORDER BY row
    ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS date_after,
  CASE WHEN day(date) <= 12 THEN make_date(year(date), day(date), month(date)) END AS turned
FROM ({DATED})"""


def _dated(spark, d):
    text = F.floor(F.col("transaction_id") / 10) % 4 == 0
    turn = (F.col("card_id") % 3 == 0) & (F.dayofmonth("txn_date") <= 12) & ~text
    return transactions(spark, d).select(
        F.col("card_id").alias("file"), F.lit("all").alias("sheet"), order_number().alias("row"),
        F.when(turn, swapped(F.col("txn_date"))).otherwise(F.col("txn_date")).alias("date"),
        F.when(text, "text").otherwise("datetime").alias("kind"))


@query("bracket_dates", "W9", f"SELECT file, row, date, date_before, date_after FROM ({BRACKETED})",
       "file row @date @date_before @date_after")
def bracket_dates(spark, d):
    rows = _dated(spark, d)
    rows = rows.withColumn("certain", (F.col("kind") == "text") | (F.dayofmonth("date") > 12))
    return C.bracket_dates(rows).select("file", "row", "date", "date_before", "date_after")


@query("date_audit", "Q14", f"""
SELECT *, CASE WHEN fits_swapped > 0 AND fits_as_is = 0 THEN 'transposed' WHEN fits_as_is > 0 AND fits_swapped = 0 THEN 'as_written'
  WHEN ambiguous = 0 THEN 'none' ELSE 'mixed' END AS verdict FROM (
SELECT file, count(*) FILTER (WHERE kind = 'datetime') AS datetimes, count(*) FILTER (WHERE kind = 'text') AS texts,
  count(*) FILTER (WHERE NOT certain) AS ambiguous, count(*) FILTER (WHERE NOT certain AND f1 AND NOT f2) AS fits_as_is,
  count(*) FILTER (WHERE NOT certain AND f2 AND NOT f1) AS fits_swapped, count(*) FILTER (WHERE NOT certain AND f1 = f2) AS fits_neither
FROM (SELECT *, (date_before IS NULL OR date >= date_before) AND (date_after IS NULL OR date <= date_after) AS f1,
  turned IS NOT NULL AND (date_before IS NULL OR turned >= date_before) AND (date_after IS NULL OR turned <= date_after) AS f2
  FROM ({BRACKETED})) GROUP BY file)""",
       "file #datetimes #texts #ambiguous #fits_as_is #fits_swapped #fits_neither verdict")
def date_audit(spark, d):
    return C.date_audit(_dated(spark, d)).drop("sheet")


LAST_STATED = """
SELECT card_id, arg_max(transaction_id, k) AS transaction_id, arg_max(txn_date, k) AS txn_date, arg_max(amount_aed, k) AS amount_aed,
  arg_max(statement_balance, k) AS statement_balance, arg_max(coalesce(supplier_raw, ''), k) AS supplier_raw FROM (
SELECT *, row(txn_date, coalesce(source_row, -1), created_at, transaction_id) AS k FROM fx_statement
WHERE statement_balance IS NOT NULL) GROUP BY card_id"""


@query("latest_stated", "J5 W8", f"SELECT * FROM ({LAST_STATED})",
       "card_id transaction_id @txn_date $amount_aed $statement_balance")
def latest_stated(spark, d):
    return C.latest_stated(statement_lines(spark, d)).select(
        "card_id", "transaction_id", "txn_date", "amount_aed", "statement_balance")


def _daily(last: str) -> str:
    return f"""
SELECT l.card_id, a.card_name AS account, a.settlement_currency AS currency, l.txn_date AS last_transaction_date,
  coalesce(l.supplier_raw, '') AS last_transaction, l.amount_aed AS last_amount, l.statement_balance AS bank_says, b.ledger_balance AS ledger_says,
  l.statement_balance - b.ledger_balance AS difference,
  (SELECT count(*) FROM fx_statement x WHERE x.card_id = l.card_id AND x.statement_balance IS NULL) AS rows_without_a_stated_balance
FROM ({last}) l JOIN fx_accounts a ON a.card_id = l.card_id JOIN ({BALANCES}) b ON b.card_id = l.card_id"""


DAILY_COLUMNS = ("card_id account currency @last_transaction_date last_transaction $last_amount $bank_says $ledger_says "
                 "$difference #rows_without_a_stated_balance")


@query("bank_daily_check", "Q7 J5 J6", _daily(LAST_STATED), DAILY_COLUMNS)
def bank_daily_check(spark, d):
    s, a = _statements(spark, d)
    return C.bank_daily_check(s, a, B.account_balances(transactions(spark, d), a))


@query("bank_daily_check_in_bank_order", "Q7", _daily(f"""
SELECT card_id, arg_max(txn_date, k) AS txn_date, arg_max(amount_aed, k) AS amount_aed, arg_max(statement_balance, k) AS statement_balance,
  arg_max(coalesce(supplier_raw, ''), k) AS supplier_raw FROM (SELECT *, row(txn_date, line_no) AS k FROM ({BANK_ORDER})
WHERE statement_balance IS NOT NULL) GROUP BY card_id"""), DAILY_COLUMNS)
def bank_daily_check_in_bank_order(spark, d):
    s, a = _statements(spark, d)
    return C.bank_daily_check(s, a, B.account_balances(transactions(spark, d), a), order="bank")


@query("account_chain_audit", "Q11", f"""
SELECT r.card_id, a.card_name, a.settlement_currency, row_count, row_count - coalesce(lines, 0) AS unprinted, coalesce(lines, 0) AS lines,
  coalesce(agreed, 0) AS agreed, last_printed, a.opening_balance + moved AS balance_now,
  CASE WHEN last_printed IS NOT NULL THEN abs(a.opening_balance + moved - last_printed) < 0.005 END AS ends_on_printed,
  payments_out, payments_in, missing_request, missing_value
FROM (SELECT card_id, count(*) AS row_count, sum(amount_aed) AS moved, count(*) FILTER (WHERE amount_aed < 0) AS payments_out,
  count(*) FILTER (WHERE amount_aed >= 0) AS payments_in,
  count(*) FILTER (WHERE amount_aed < 0 AND trim(coalesce(req_number, '')) = '') AS missing_request,
  coalesce(sum(-amount_aed) FILTER (WHERE amount_aed < 0 AND trim(coalesce(req_number, '')) = ''), 0) AS missing_value
  FROM fx_statement GROUP BY card_id) r JOIN fx_accounts a ON a.card_id = r.card_id
LEFT JOIN (SELECT card_id, count(*) AS lines, count(*) FILTER (WHERE agrees) AS agreed, arg_max(statement_balance, line_no) AS last_printed
  FROM ({CHAIN}) GROUP BY card_id) c ON c.card_id = r.card_id""",
       "card_id card_name settlement_currency #row_count #unprinted #lines #agreed $last_printed $balance_now ends_on_printed "
       "#payments_out #payments_in #missing_request $missing_value")
def account_chain_audit(spark, d):
    return C.account_chain_audit(*_statements(spark, d))


@query("statement_reconciliation", "Q10", """
SELECT s.card_id, s.last_day, a.opening_balance + coalesce(m.moved, 0) AS ledger_at_last_day, s.closing,
  a.opening_balance + coalesce(m.moved, 0) - s.closing AS gap,
  coalesce(abs(a.opening_balance + coalesce(m.moved, 0) - s.closing) < 0.005, FALSE) AS agrees,
  s.card_id % 11 <> 0 AS all_rows_read, coalesce(g.n, 0) AS identical_groups
FROM (SELECT card_id, max(txn_date) AS last_day, arg_max(statement_balance, row(txn_date, transaction_id)) AS closing
  FROM fx_statement WHERE statement_balance IS NOT NULL AND txn_date <= DATE '1999-06-30' GROUP BY card_id) s
JOIN fx_accounts a ON a.card_id = s.card_id
LEFT JOIN (SELECT s2.card_id, sum(t.amount_aed) AS moved FROM fx_statement t JOIN (
   SELECT card_id, max(txn_date) AS last_day FROM fx_statement WHERE statement_balance IS NOT NULL AND txn_date <= DATE '1999-06-30'
   GROUP BY card_id) s2 ON s2.card_id = t.card_id AND t.txn_date <= s2.last_day GROUP BY s2.card_id) m ON m.card_id = s.card_id
LEFT JOIN (SELECT card_id, count(*) AS n FROM (SELECT card_id, txn_date, amount_aed, supplier_raw FROM fx_statement
   GROUP BY 1, 2, 3, 4 HAVING count(*) > 1) GROUP BY card_id) g ON g.card_id = s.card_id""",
       "card_id @last_day $ledger_at_last_day $closing $gap agrees all_rows_read #identical_groups")
def statement_reconciliation(spark, d):
    s, a = _statements(spark, d)
    printed = s.filter((F.col("statement_balance").isNotNull()) & (F.col("txn_date") <= F.lit("1999-06-30").cast("date")))
    facts = printed.groupBy("card_id").agg(
        F.max("txn_date").alias("last_day"), F.count(F.lit(1)).alias("rows_stated"),
        F.max_by("statement_balance", F.struct("txn_date", "transaction_id")).alias("closing"))
    facts = facts.withColumn("rows_read", F.col("rows_stated") - F.when(F.col("card_id") % 11 == 0, 1).otherwise(0))
    return C.statement_reconciliation(s, a, facts)


@query("out_of_month", "I17", """
SELECT transaction_id, source_sheet, CASE WHEN odd THEN shifted END AS sheet_date, coalesce(odd, FALSE) AS out_of_month,
  CASE WHEN odd THEN try_cast(belongs || '-' || lpad(CAST(day(shifted) AS VARCHAR), 2, '0') AS DATE) ELSE shifted END AS txn_date
FROM (SELECT *, source_sheet IS NOT NULL AND strftime(shifted, '%Y-%m') <> belongs AS odd FROM (
  SELECT transaction_id, source_sheet, substring(source_sheet, 4, 4) || '-' || substring(source_sheet, 1, 2) AS belongs,
    CASE WHEN (transaction_id // 10) % 37 = 0 THEN CAST(txn_date + INTERVAL 1 YEAR AS DATE) ELSE txn_date END AS shifted FROM fx_transactions))""",
       "transaction_id source_sheet @sheet_date out_of_month @txn_date")
def out_of_month(spark, d):
    late = F.floor(F.col("transaction_id") / 10) % 37 == 0
    rows = transactions(spark, d).withColumn(
        "txn_date", F.when(late, F.add_months("txn_date", 12)).otherwise(F.col("txn_date")))
    return C.out_of_month(rows).select("transaction_id", "source_sheet", "sheet_date", "out_of_month", "txn_date")


MONTH_LINES = f"""
SELECT s.card_id, strftime(s.txn_date, '%Y-%m') AS month, {ORDER_SQL.replace('txn_date', 's.txn_date').replace('transaction_id', 's.transaction_id')} AS seq,
  CASE WHEN month(s.txn_date) % 5 = 0 THEN NULL ELSE m.opening + CASE WHEN month(s.txn_date) % 7 = 0 THEN 1 ELSE 0 END END AS opening,
  CASE WHEN amount_aed < 0 THEN -amount_aed END AS debit, CASE WHEN amount_aed >= 0 THEN amount_aed END AS credit, statement_balance AS balance
FROM fx_statement s JOIN ({MONTHS}) m ON m.card_id = s.card_id AND m.month = strftime(s.txn_date, '%Y-%m')"""


@query("import_months", "I18", f"""
SELECT *, coalesce(abs(opening - carried) > 0.005, FALSE) AS join_break FROM (
SELECT *, last_value(closing IGNORE NULLS) OVER (PARTITION BY card_id ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carried FROM (
SELECT card_id, month, max(opening) AS opening, count(*) AS row_count,
  count(*) FILTER (WHERE balance IS NOT NULL AND start IS NOT NULL AND abs(start + moved - balance) >= 0.005) AS chain_breaks,
  arg_max_null(coalesce(balance, start + moved), seq) AS closing
FROM (SELECT *, coalesce(last_value(balance - moved IGNORE NULLS) OVER (PARTITION BY card_id, month ORDER BY seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), opening) AS start FROM (
  SELECT *, sum(coalesce(credit, 0) - coalesce(debit, 0)) OVER (PARTITION BY card_id, month ORDER BY seq) AS moved FROM ({MONTH_LINES})))
GROUP BY card_id, month))""",
       "card_id month $opening #row_count #chain_breaks $closing $carried join_break")
def import_months(spark, d):
    s, a = _statements(spark, d)
    months = B.bank_months(transactions(spark, d), a).select("card_id", "month", F.col("opening").alias("_open"))
    m = F.month("txn_date")
    lines = s.withColumn("month", F.date_format("txn_date", "yyyy-MM")).join(months, ["card_id", "month"]).select(
        "card_id", "month", order_number().alias("seq"),
        F.when(m % 5 != 0, F.col("_open") + F.when(m % 7 == 0, 1).otherwise(0)).alias("opening"),
        F.when(F.col("amount_aed") < 0, -F.col("amount_aed")).alias("debit"),
        F.when(F.col("amount_aed") >= 0, F.col("amount_aed")).alias("credit"), F.col("statement_balance").alias("balance"))
    return C.import_months(lines)


# ---------------------------------------------------------------- checks

@query("row_violations", "Q1", """
SELECT transaction_id, card_id, unnest(list_filter([
  CASE WHEN NOT ((entry_type = 'source_transaction' AND direction IS NOT NULL) OR (entry_type = 'reconciliation_adjustment' AND direction IS NULL))
    THEN 'direction_required_for_transactions' END,
  CASE WHEN NOT (direction IS NULL OR (direction = 'spend' AND amount_aed <= 0) OR (direction = 'funding' AND amount_aed >= 0))
    THEN 'amount_sign_matches_direction' END,
  CASE WHEN NOT (entry_type <> 'reconciliation_adjustment' OR (description IS NOT NULL AND review_reason IS NOT NULL)) THEN 'adjustment_is_explained' END,
  CASE WHEN NOT (exchange_rate IS NULL OR status = 'needs_review' OR (currency IS NOT NULL AND original_amount IS NOT NULL)) THEN 'conversion_is_complete' END,
  CASE WHEN NOT (NOT date_repaired OR source_date_raw IS NOT NULL) THEN 'repair_keeps_original' END,
  CASE WHEN currency = 'AED' AND exchange_rate IS NOT NULL THEN 'no_rate_on_base_currency' END], lambda x: x IS NOT NULL)) AS rule
FROM (SELECT * REPLACE (CASE WHEN transaction_id % 900 = 0 THEN NULL ELSE source_date_raw END AS source_date_raw,
  CASE WHEN transaction_id % 1900 = 0 THEN 'funding' ELSE direction END AS direction, transaction_id % 140 = 0 AS date_repaired) FROM fx_transactions)""",
       "transaction_id card_id rule")
def row_violations(spark, d):
    i = F.col("transaction_id")
    damaged = transactions(spark, d).withColumns({
        "source_date_raw": F.when(i % 900 != 0, F.col("source_date_raw")),
        "direction": F.when(i % 1900 == 0, "funding").otherwise(F.col("direction")), "date_repaired": i % 140 == 0})
    return Q.row_violations(damaged)


STRAY = "CASE WHEN transaction_id % 1700 = 0 THEN NULL WHEN transaction_id % 1300 = 0 THEN card_id + 1000000000 ELSE card_id END"


@query("rows_of_unknown_accounts", "Q1 J1", f"""
SELECT transaction_id, card_id, 'account_exists' AS rule FROM (SELECT transaction_id, {STRAY} AS card_id FROM fx_transactions) t
WHERE NOT EXISTS (SELECT 1 FROM fx_accounts a WHERE a.card_id = t.card_id)""", "transaction_id card_id rule")
def rows_of_unknown_accounts(spark, d):
    return Q.rows_of_unknown_accounts(transactions(spark, d).withColumn("card_id", F.expr(STRAY)), accounts(spark, d))


GROUPS = """
SELECT t.card_id, a.card_name, t.txn_date, t.amount_aed, coalesce(supplier_raw, description, '') AS supplier, coalesce(payment_ref, '') AS payment_ref,
  count(*) AS copies, count(DISTINCT coalesce(source_sheet, 'manual entry')) AS distinct_sources, min(created_at) AS first_entered,
  max(created_at) AS last_entered, abs(t.amount_aed) * (count(*) - 1) AS amount_at_risk,
  count(DISTINCT coalesce(source_sheet, 'manual entry')) > 1 OR max(created_at) - min(created_at) > INTERVAL 1 MINUTE AS entered_separately
FROM fx_transactions t JOIN fx_accounts a USING (card_id) WHERE t.entry_type = 'source_transaction' AND t.status <> 'voided'
GROUP BY t.card_id, a.card_name, t.txn_date, t.amount_aed, coalesce(supplier_raw, description, ''), coalesce(payment_ref, '')
HAVING count(*) > 1"""
GROUP_COLUMNS = ("card_id card_name @txn_date $amount_aed supplier payment_ref #copies #distinct_sources !first_entered !last_entered "
                 "$amount_at_risk entered_separately")


@query("possible_duplicates", "Q2", GROUPS, GROUP_COLUMNS)
def possible_duplicates(spark, d):
    return Q.possible_duplicates(transactions(spark, d), accounts(spark, d))


@query("duplicate_members", "A22 Q2", """
SELECT * FROM (SELECT card_id, txn_date, amount_aed, coalesce(supplier_raw, description, '') AS supplier, coalesce(payment_ref, '') AS payment_ref,
  count(*) OVER g AS copies, row_number() OVER (PARTITION BY card_id, txn_date, amount_aed, coalesce(supplier_raw, description, ''), coalesce(payment_ref, '')
   ORDER BY source_row NULLS LAST, created_at, transaction_id) AS member_no, transaction_id, coalesce(source_row, 0) AS source_row
FROM fx_transactions WHERE entry_type = 'source_transaction' AND status <> 'voided'
WINDOW g AS (PARTITION BY card_id, txn_date, amount_aed, coalesce(supplier_raw, description, ''), coalesce(payment_ref, ''))) WHERE copies > 1""",
       "card_id @txn_date $amount_aed supplier payment_ref #copies #member_no transaction_id #source_row")
def duplicate_members(spark, d):
    return Q.duplicate_members(transactions(spark, d))


@query("split_duplicates", "Q3", f"SELECT *, CASE WHEN entered_separately THEN 'separate' ELSE 'expected' END AS verdict FROM ({GROUPS})",
       GROUP_COLUMNS + " verdict")
def split_duplicates(spark, d):
    return Q.split_duplicates(Q.possible_duplicates(transactions(spark, d), accounts(spark, d)))


@query("duplicates_by_risk", "O5", GROUPS, GROUP_COLUMNS)
def duplicates_by_risk(spark, d):
    return Q.duplicates_by_risk(Q.possible_duplicates(transactions(spark, d), accounts(spark, d)))


@query("suspect_amounts", "Q4 J3 W10", """
SELECT * FROM (SELECT t.transaction_id, t.card_id, a.card_name, t.txn_date, t.supplier, t.amount_aed, o.transaction_id AS compare_with_id,
  o.txn_date AS compare_with_date, o.amount_aed AS compare_with_amount, CAST(round(abs(t.amount_aed) / abs(o.amount_aed)) AS BIGINT) AS factor,
  o.txn_date = t.txn_date AS same_day, abs(date_diff('day', o.txn_date, t.txn_date)) AS days_apart, t.currency, t.source_sheet, t.source_row,
  row_number() OVER (PARTITION BY t.transaction_id ORDER BY (o.txn_date = t.txn_date) DESC, abs(date_diff('day', o.txn_date, t.txn_date)), o.transaction_id) AS rn
FROM (SELECT *, coalesce(supplier_raw, description, '') AS supplier FROM fx_transactions WHERE entry_type = 'source_transaction' AND status <> 'voided') t
JOIN (SELECT *, coalesce(supplier_raw, description, '') AS supplier FROM fx_transactions WHERE entry_type = 'source_transaction' AND status <> 'voided') o
  ON o.card_id = t.card_id AND o.supplier = t.supplier AND o.transaction_id <> t.transaction_id AND abs(o.amount_aed) > 0
  AND abs(t.amount_aed) > abs(o.amount_aed) AND abs(t.amount_aed) >= 500
  AND abs(abs(t.amount_aed) / abs(o.amount_aed) - round(abs(t.amount_aed) / abs(o.amount_aed))) < 0.005
  AND round(abs(t.amount_aed) / abs(o.amount_aed)) IN (10, 100, 1000)
JOIN fx_accounts a ON a.card_id = t.card_id) WHERE rn = 1""",
       "transaction_id card_id card_name @txn_date supplier $amount_aed compare_with_id @compare_with_date $compare_with_amount #factor "
       "same_day #days_apart currency source_sheet source_row")
def suspect_amounts(spark, d):
    return Q.suspect_amounts(transactions(spark, d), accounts(spark, d))


RATED = """(SELECT *, CASE WHEN original_amount > 0 THEN CAST(round(CAST(abs(amount_aed) AS DOUBLE) / CAST(original_amount AS DOUBLE), 10) AS DECIMAL(20,10)) END
  AS normalized_exchange_rate FROM fx_transactions)"""


def rated(spark, d):
    return transactions(spark, d).withColumn(
        "normalized_exchange_rate", implied_rate(F.col("amount_aed"), F.col("original_amount")))


MEDIAN = f"""
SELECT currency, strftime(txn_date, '%Y-%m') AS month, count(*) AS n, median(CAST(normalized_exchange_rate AS DOUBLE)) AS median_rate
FROM {RATED} WHERE entry_type = 'source_transaction' AND status <> 'voided' AND normalized_exchange_rate > 0 AND currency IS NOT NULL
GROUP BY 1, 2 HAVING count(*) >= 4"""


@query("monthly_median_rate", "A23", MEDIAN, "currency month #n $median_rate")
def monthly_median_rate(spark, d):
    return S.monthly_median(rated(spark, d))


@query("suspect_rates", "Q5 J4", f"""
SELECT t.transaction_id, t.card_id, a.card_name, t.txn_date, coalesce(supplier_raw, description, '') AS supplier, t.currency, t.original_amount,
  t.amount_aed, round(normalized_exchange_rate, 6) AS settled_rate, round(m.median_rate, 6) AS usual_rate,
  round(CAST(normalized_exchange_rate AS DOUBLE) / m.median_rate, 2) AS times_usual, m.n AS comparable_rows, t.source_sheet, t.source_row
FROM {RATED} t JOIN fx_accounts a USING (card_id) JOIN ({MEDIAN}) m ON m.currency = t.currency AND m.month = strftime(t.txn_date, '%Y-%m')
WHERE t.entry_type = 'source_transaction' AND t.status <> 'voided' AND m.median_rate > 0
  AND (normalized_exchange_rate > m.median_rate * 5 OR normalized_exchange_rate < m.median_rate / 5)""",
       "transaction_id card_id card_name @txn_date supplier currency $original_amount $amount_aed $settled_rate $usual_rate $times_usual "
       "#comparable_rows source_sheet source_row")
def suspect_rates(spark, d):
    return Q.suspect_rates(rated(spark, d), accounts(spark, d))


@query("usual_rate", "A24", """
SELECT settlement_currency, currency, n AS samples, CAST(r AS DECIMAL(20,10)) AS usual_rate FROM (
SELECT a.settlement_currency, t.currency, t.exchange_rate AS r, count(*) OVER (PARTITION BY a.settlement_currency, t.currency) AS n,
  row_number() OVER (PARTITION BY a.settlement_currency, t.currency ORDER BY t.exchange_rate, t.transaction_id) AS k
FROM (SELECT * REPLACE (CAST(exchange_rate * (1 + (transaction_id % 97) / 100.0) AS DECIMAL(20,10)) AS exchange_rate) FROM fx_transactions) t
JOIN fx_accounts a USING (card_id) WHERE t.exchange_rate > 0 AND t.currency IS NOT NULL) WHERE k = n // 2 + 1 AND n >= 3""",
       "settlement_currency currency #samples $usual_rate")
def usual_rate(spark, d):
    spread = F.col("exchange_rate") * (1 + (F.col("transaction_id") % 97).cast("decimal(4,0)") / F.lit(100).cast("decimal(3,0)"))
    rows = transactions(spark, d).withColumn("exchange_rate", spread.cast("decimal(20,10)"))
    return S.usual_rate(rows, accounts(spark, d))


@query("implied_rate_bands", "A18", """
SELECT currency, count(*) AS row_count, sum(original_amount) AS paid, sum(abs(amount_aed)) AS cost,
  round(min(CAST(abs(amount_aed) AS DOUBLE) / CAST(original_amount AS DOUBLE)), 6) AS lowest,
  round(max(CAST(abs(amount_aed) AS DOUBLE) / CAST(original_amount AS DOUBLE)), 6) AS highest,
  max(CAST(abs(amount_aed) AS DOUBLE) / CAST(original_amount AS DOUBLE)) / min(CAST(abs(amount_aed) AS DOUBLE) / CAST(original_amount AS DOUBLE)) > 1.5 AS suspicious
FROM fx_transactions WHERE currency IS NOT NULL AND original_amount <> 0 GROUP BY 1""",
       "currency #row_count $paid $cost $lowest $highest suspicious")
def implied_rate_bands(spark, d):
    rows = transactions(spark, d).filter("currency IS NOT NULL AND original_amount <> 0")
    return S.implied_rate_bands(rows.select("currency", "original_amount", F.abs("amount_aed").alias("settled")))


@query("rows_before_opening", "Q6", """
SELECT t.transaction_id, t.card_id, a.card_name, t.txn_date, a.opening_date, date_diff('day', t.txn_date, a.opening_date) AS days_before,
  coalesce(t.supplier_raw, t.description, '') AS supplier, t.amount_aed, t.currency, t.status, coalesce(t.source_sheet, 'entered by hand') AS came_from
FROM fx_transactions t JOIN fx_accounts a USING (card_id) WHERE t.txn_date < a.opening_date AND t.status <> 'voided'""",
       "transaction_id card_id card_name @txn_date @opening_date #days_before supplier $amount_aed currency status came_from")
def rows_before_opening(spark, d):
    return Q.rows_before_opening(transactions(spark, d), accounts(spark, d))


@query("review_queue", "Q8", """
SELECT t.*, a.card_name FROM fx_transactions t JOIN fx_accounts a USING (card_id)
WHERE t.status IN ('needs_review', 'excluded_from_source_balance') OR t.entry_type = 'reconciliation_adjustment'""",
       "transaction_id card_name source_sheet source_row @txn_date supplier_raw $amount_aed currency currency_raw entry_type status review_reason description")
def review_queue(spark, d):
    return Q.review_queue(transactions(spark, d), accounts(spark, d))


KIND = """CASE WHEN entry_type = 'reconciliation_adjustment' THEN 'manual_balance_adjustment'
  WHEN t.status = 'excluded_from_source_balance' THEN 'excluded_from_source_balance'
  WHEN contains(coalesce(review_reason, ''), 'rate_without_currency') THEN 'rate_without_currency'
  WHEN contains(coalesce(review_reason, ''), 'rate_denominator_mismatch') THEN 'rate_mismatch'
  WHEN contains(coalesce(review_reason, ''), 'rate_formula_unexpected') THEN 'rate_hardcoded'
  WHEN regexp_matches(coalesce(review_reason, ''), 'currency_unparseable|currency_unrecognised') THEN 'currency_unreadable' ELSE 'other' END"""
OPEN = f"""
SELECT t.transaction_id, t.card_id, a.card_name, t.txn_date, t.amount_aed, t.status, {KIND} AS kind,
  coalesce(review_reason, 'Flagged during import') AS reason FROM fx_transactions t JOIN fx_accounts a USING (card_id)
WHERE t.status IN ('needs_review', 'excluded_from_source_balance')
  OR (t.entry_type = 'reconciliation_adjustment' AND t.status NOT IN ('confirmed', 'voided'))"""


@query("open_review_items", "Q9 X14", OPEN, "transaction_id card_id card_name @txn_date $amount_aed status kind reason")
def open_review_items(spark, d):
    return Q.open_review_items(transactions(spark, d), accounts(spark, d))


OCCURRENCE = f"""
SELECT *, encode_hex FROM (SELECT *, sha256(signature || '|#' || CAST(occurrence AS VARCHAR)) AS encode_hex FROM (
SELECT *, row_number() OVER (PARTITION BY signature ORDER BY coalesce(source_row, 0), transaction_id) AS occurrence FROM (
SELECT *, {SIGNATURE} AS signature FROM fx_transactions)))"""


@query("assign_occurrence", "W1 X10", f"SELECT transaction_id, occurrence, encode_hex AS dedup_key FROM ({OCCURRENCE})",
       "transaction_id #occurrence dedup_key")
def assign_occurrence(spark, d):
    return Q.assign_occurrence(transactions(spark, d)).select("transaction_id", "occurrence", "dedup_key")


@query("occurrence_integrity", "Q15", f"""
SELECT card_id, txn_date, amount_aed, coalesce(supplier_raw, '') AS supplier, coalesce(payment_ref, '') AS payment_ref, coalesce(req_number, '') AS req_number,
  count(*) AS copies, max(occ) AS highest, count(DISTINCT occ) AS distinct_numbers FROM (
SELECT *, occurrence + CASE WHEN transaction_id % 46 = 1 THEN 1 ELSE 0 END AS occ FROM ({OCCURRENCE}) WHERE entry_type = 'source_transaction' AND status <> 'voided')
GROUP BY 1, 2, 3, 4, 5, 6 HAVING count(*) > 1 AND (max(occ) <> count(*) OR count(DISTINCT occ) <> count(*))""",
       "card_id @txn_date $amount_aed supplier payment_ref req_number #copies #highest #distinct_numbers")
def occurrence_integrity(spark, d):
    numbered = Q.assign_occurrence(transactions(spark, d))
    return Q.occurrence_integrity(numbered.withColumn(
        "occurrence", F.col("occurrence") + F.when(F.col("transaction_id") % 46 == 1, 1).otherwise(0)))


@query("duplicate_keys", "Q1", f"""
SELECT dedup_key, count(*) AS row_count FROM (SELECT sha256({SIGNATURE} || '|#1') AS dedup_key FROM fx_transactions) GROUP BY 1 HAVING count(*) > 1""",
       "dedup_key #row_count")
def duplicate_keys(spark, d):
    from ..functions.keys import content_signature, dedup_key
    # Keys built without numbering the copies, which is what the check is for.
    return Q.duplicate_keys(transactions(spark, d).withColumn("dedup_key", dedup_key(content_signature(), F.lit(1))))


# ------------------------------------------------------------ audit trails

CORRECTIONS = """
SELECT transaction_id, created_at + INTERVAL 1 DAY AS created_at,
  CASE WHEN source_sheet IS NULL AND transaction_id % 3 <> 0 THEN 'created' ELSE 'status_changed' END AS action,
  CASE WHEN transaction_id % 4 = 0 THEN NULL ELSE 'user' || CAST(transaction_id % 4 AS VARCHAR) || '@example.com' END AS actor,
  'because of ' || status AS rationale, review_reason AS note, 'needs_review' AS from_status, status AS to_status
FROM fx_transactions WHERE status <> 'confirmed' OR source_sheet IS NULL"""
CARD_AUDIT = """
SELECT card_name, CASE WHEN status = 'inactive' THEN 'deactivated' ELSE 'created' END AS action, CAST(NULL AS VARCHAR) AS actor,
  CASE WHEN card_id % 2 = 0 THEN 'opened by the bank' END AS reason, TIMESTAMP '1994-01-01 08:00:00' AS created_at FROM fx_accounts"""
ACCESS = """
SELECT s_name AS target, CASE WHEN s_suppkey % 3 = 0 THEN 'revoked' ELSE 'granted' END AS action, 'owner@example.com' AS actor,
  CAST(NULL AS VARCHAR) AS rationale, TIMESTAMP '1994-06-01 08:00:00' AS created_at FROM supplier"""
LOG = f"""
SELECT c.created_at, 'transaction' AS area, c.action, coalesce(c.actor, 'an admin') AS actor, a.card_name, t.transaction_id,
  coalesce(t.supplier_raw, t.description, '(no supplier)') AS subject, t.amount_aed, t.txn_date, c.rationale, c.note, c.from_status, c.to_status
FROM ({CORRECTIONS}) c JOIN fx_transactions t ON t.transaction_id = c.transaction_id JOIN fx_accounts a ON a.card_id = t.card_id
UNION ALL SELECT created_at, 'card', action, coalesce(actor, 'the system'), card_name, NULL, card_name, NULL, NULL, coalesce(reason, 'Card ' || action), NULL, NULL, NULL FROM ({CARD_AUDIT})
UNION ALL SELECT created_at, 'access', action, coalesce(actor, 'the system'), NULL, NULL, target, NULL, NULL, coalesce(rationale, 'Write access ' || action), NULL, NULL, NULL FROM ({ACCESS})"""
LOG_COLUMNS = "!created_at area action actor card_name transaction_id subject $amount_aed @txn_date rationale note from_status to_status"


def corrections(spark, d):
    t = F.col("transaction_id")
    return transactions(spark, d).filter("status <> 'confirmed' OR source_sheet IS NULL").select(
        "transaction_id", (F.col("created_at") + F.expr("INTERVAL '1' DAY")).alias("created_at"),
        F.when(F.col("source_sheet").isNull() & (t % 3 != 0), "created").otherwise("status_changed").alias("action"),
        F.when(t % 4 != 0, F.concat(F.lit("user"), (t % 4).cast("string"), F.lit("@example.com"))).alias("actor"),
        F.concat(F.lit("because of "), F.col("status")).alias("rationale"), F.col("review_reason").alias("note"),
        F.lit("needs_review").alias("from_status"), F.col("status").alias("to_status"))


def feed(spark, d):
    a = accounts(spark, d)
    none = F.lit(None).cast("string")
    cards = a.select("card_name", F.when(F.col("status") == "inactive", "deactivated").otherwise("created").alias("action"),
                     none.alias("actor"), F.when(F.col("card_id") % 2 == 0, "opened by the bank").alias("reason"),
                     F.lit("1994-01-01 08:00:00").cast("timestamp_ntz").alias("created_at"))
    access = table(spark, d, "supplier").select(
        F.col("s_name").alias("target"), F.when(F.col("s_suppkey") % 3 == 0, "revoked").otherwise("granted").alias("action"),
        F.lit("owner@example.com").alias("actor"), none.alias("rationale"),
        F.lit("1994-06-01 08:00:00").cast("timestamp_ntz").alias("created_at"))
    return Q.activity_log(corrections(spark, d), cards, access, transactions(spark, d), a)


@query("activity_log", "U1", LOG, LOG_COLUMNS)
def activity_log(spark, d):
    return feed(spark, d)


@query("latest_activity", "O2", f"SELECT * FROM ({LOG}) ORDER BY created_at DESC, area, subject, transaction_id NULLS FIRST LIMIT 400", LOG_COLUMNS)
def latest_activity(spark, d):
    return Q.latest_activity(feed(spark, d), 400)


@query("filter_log", "F14", f"""SELECT * FROM ({LOG}) WHERE area = 'transaction' AND actor = 'user1@example.com'
AND contains(lower(concat_ws(' ', coalesce(subject, ''), coalesce(card_name, ''), coalesce(rationale, ''), actor, coalesce(note, ''))), 'voided')""",
       LOG_COLUMNS)
def filter_log(spark, d):
    return L.filter_log(feed(spark, d), "transaction", "user1@example.com", " Voided ")


@query("option_lists", "F15", f"""
SELECT DISTINCT 'currency' AS list, coalesce(currency, 'unknown') AS option FROM fx_transactions
UNION ALL SELECT DISTINCT 'actor', actor FROM ({LOG})""", "list option")
def option_lists(spark, d):
    return L.option_lists(transactions(spark, d), feed(spark, d))


@query("transaction_history", "Q25", f"SELECT * FROM ({LOG}) WHERE transaction_id = 130", LOG_COLUMNS)
def transaction_history(spark, d):
    return Q.transaction_history(feed(spark, d), 130)


@query("unexplained_status_changes", "Q16 J7", f"""
SELECT transaction_id, card_id, source_row, status_then, status FROM (
SELECT *, CASE WHEN transaction_id % 7 = 0 THEN 'needs_review' ELSE status END AS status_then FROM fx_transactions)
WHERE status_then <> status AND transaction_id NOT IN (SELECT transaction_id FROM ({CORRECTIONS}))""",
       "transaction_id card_id source_row status_then status")
def unexplained_status_changes(spark, d):
    now = Q.assign_occurrence(transactions(spark, d))
    then = now.select("dedup_key", F.when(F.col("transaction_id") % 7 == 0, "needs_review").otherwise(F.col("status")).alias("status"))
    return Q.unexplained_status_changes(now, then, corrections(spark, d))


@query("unaudited_rows", "Q17", f"""
SELECT transaction_id, card_id, txn_date, amount_aed FROM fx_transactions WHERE source_sheet IS NULL
AND transaction_id NOT IN (SELECT transaction_id FROM ({CORRECTIONS}) WHERE action = 'created')""",
       "transaction_id card_id @txn_date $amount_aed")
def unaudited_rows(spark, d):
    return Q.unaudited_rows(transactions(spark, d), corrections(spark, d))


@query("three_way_balances", "Q18 J18", f"""
SELECT card_id, card_name, source_balance, ledger_balance, view AS fresh_equals_view, ext AS fresh_equals_import, corrections,
  CASE WHEN NOT view THEN 'broken' WHEN ext THEN 'agrees' WHEN corrections > 0 THEN 'explained' ELSE 'unexplained' END AS verdict FROM (
SELECT b.card_id, b.card_name, b.source_balance, b.ledger_balance, TRUE AS view, coalesce(l.n, 0) AS corrections,
  abs(b.source_balance - i.source_balance) < 0.005 AND abs(b.ledger_balance - i.ledger_balance) < 0.005 AS ext
FROM ({BALANCES}) b JOIN ({BALANCES.replace("t.status <> 'voided'", "TRUE")}) i ON i.card_id = b.card_id
LEFT JOIN (SELECT card_id, count(*) AS n FROM ({CORRECTIONS}) c JOIN fx_transactions USING (transaction_id) GROUP BY 1) l ON l.card_id = b.card_id)""",
       "card_id card_name $source_balance $ledger_balance fresh_equals_view fresh_equals_import #corrections verdict")
def three_way_balances(spark, d):
    t, a = transactions(spark, d), accounts(spark, d)
    # Fresh sums by another route: counted rows, signed by the account, summed.
    counted = L.in_balance(t, a).join(a.select("card_id", "balance_sign"), "card_id")
    sums = counted.groupBy("card_id").agg(
        F.sum(F.when(F.col("included_in_source_balance"), F.col("balance_sign") * F.col("amount_aed"))).alias("s"),
        F.sum(F.when(F.col("entry_type") == "source_transaction", F.col("balance_sign") * F.col("amount_aed"))).alias("l"))
    fresh = a.join(sums, "card_id", "left").select(
        "card_id", (F.col("opening_balance") + F.coalesce("s", F.lit(0))).alias("source_balance"),
        (F.col("opening_balance") + F.coalesce("l", F.lit(0))).alias("ledger_balance"))
    # At import nothing had been voided yet.
    summary = B.account_balances(t.withColumn("status", F.lit("confirmed")), a)
    return Q.three_way_balances(B.account_balances(t, a), fresh, summary, Q.log_counts(corrections(spark, d), t))


@query("duplicate_candidates", "Q19", """
SELECT source_sheet AS sheet, strftime(txn_date, '%d/%m/%Y') AS date_text, upper(trim(coalesce(supplier_raw, ''))) AS supplier, amount_aed AS amount, count(*) AS row_count
FROM fx_transactions GROUP BY 1, 2, 3, 4 HAVING count(*) > 1""", "sheet date_text supplier $amount #row_count")
def duplicate_candidates(spark, d):
    return Q.duplicate_candidates(transactions(spark, d).select(
        F.col("source_sheet").alias("sheet"), F.date_format("txn_date", "dd/MM/yyyy").alias("date_text"),
        F.col("supplier_raw").alias("supplier"), F.col("amount_aed").alias("amount")))


@query("rate_consistency", "Q21", """
SELECT transaction_id, currency, implied FROM (SELECT *, round(original_amount * exchange_rate, 2) AS implied FROM fx_transactions
WHERE original_amount > 0 AND exchange_rate > 0 AND abs(amount_aed) > 0) WHERE abs(implied - abs(amount_aed)) > 0.01""",
       "transaction_id currency $implied")
def rate_consistency(spark, d):
    return Q.rate_consistency(transactions(spark, d)).select("transaction_id", "currency", "implied")


@query("currency_integrity", "Q23", """
SELECT currency, count(*) AS row_count FROM (SELECT CASE WHEN transaction_id % 1000 = 0 THEN 'GPB' ELSE currency END AS currency FROM fx_transactions)
WHERE currency NOT IN ('USD', 'EUR', 'JPY') GROUP BY 1""", "currency #row_count")
def currency_integrity(spark, d):
    known = spark.createDataFrame([(c,) for c in WORKBOOK_CURRENCIES], "code string")
    rows = transactions(spark, d).withColumn(
        "currency", F.when(F.col("transaction_id") % 1000 == 0, "GPB").otherwise(F.col("currency")))
    return Q.currency_integrity(rows, known)


@query("rate_checks", "Q13 X24", """
SELECT sheet, row, formula, unnest(list_filter([
  CASE WHEN NOT simple THEN 'rate_formula_unexpected' END, CASE WHEN simple AND at_row <> row THEN 'rate_row_mismatch' END,
  CASE WHEN simple AND abs(den - CAST(original_amount AS DOUBLE)) > 1e-9 THEN 'rate_denominator_mismatch' END,
  CASE WHEN simple AND original_amount IS NULL AND currency IS NULL THEN 'rate_without_currency' END,
  CASE WHEN simple AND abs(num / den - cached) > 1e-6 THEN 'rate_cached_value_wrong' END], lambda x: x IS NOT NULL)) AS kind
FROM (SELECT *, ok % 11 <> 0 AS simple, CASE WHEN ok % 7 = 0 THEN row + 1 ELSE row END AS at_row,
  CASE WHEN ok % 5 = 4 THEN CAST(ok % 900 + 1 AS DOUBLE) WHEN ok % 9 = 0 THEN CAST(ok % 900 + 2 AS DOUBLE) ELSE coalesce(CAST(original_amount AS DOUBLE), 3) END AS den
  FROM (SELECT source_sheet AS sheet, transaction_id % 100000 AS row, currency, original_amount, transaction_id // 10 AS ok,
    CAST(abs(amount_aed) AS DOUBLE) AS num, coalesce(CAST(exchange_rate AS DOUBLE), 1) AS cached,
    CASE WHEN (transaction_id // 10) % 11 = 0 THEN '=100/20' ELSE '=E' || CAST(CASE WHEN (transaction_id // 10) % 7 = 0 THEN transaction_id % 100000 + 1 ELSE transaction_id % 100000 END AS VARCHAR)
      || '/' || CASE WHEN (transaction_id // 10) % 5 = 4 THEN CAST((transaction_id // 10) % 900 + 1 AS VARCHAR) WHEN (transaction_id // 10) % 9 = 0 THEN CAST((transaction_id // 10) % 900 + 2 AS VARCHAR)
        ELSE coalesce(CAST(original_amount AS VARCHAR), '3') END END AS formula FROM fx_transactions))""",
       "sheet #row formula kind")
def rate_checks(spark, d):
    ok = F.floor(F.col("transaction_id") / 10)
    row = F.col("transaction_id") % 100000
    den = (F.when(ok % 5 == 4, (ok % 900 + 1).cast("string")).when(ok % 9 == 0, (ok % 900 + 2).cast("string"))
           .otherwise(F.coalesce(F.col("original_amount").cast("string"), F.lit("3"))))
    formula = F.when(ok % 11 == 0, "=100/20").otherwise(
        F.concat(F.lit("=E"), (row + F.when(ok % 7 == 0, 1).otherwise(0)).cast("string"), F.lit("/"), den))
    return Q.rate_checks(transactions(spark, d).select(
        F.col("source_sheet").alias("sheet"), row.alias("row"), formula.alias("formula"),
        F.coalesce(F.col("exchange_rate").cast("double"), F.lit(1.0)).alias("cached"),
        F.abs("amount_aed").alias("numerator"), "original_amount", "currency"))


@query("figure_scan", "U2", f"""
SELECT row_id, source, value FROM (
SELECT card_id AS row_id, 'account_balances.source' AS source, source_balance AS value FROM ({BALANCES}) UNION ALL
SELECT card_id, 'account_balances.ledger', ledger_balance FROM ({BALANCES}) UNION ALL
SELECT card_id, 'account_balances.difference', reconciliation_difference FROM ({BALANCES}) UNION ALL
SELECT card_id, 'account_balances.opening', opening_balance FROM ({BALANCES}) UNION ALL
SELECT card_id, 'account_balances.spend', total_spend FROM ({BALANCES}) UNION ALL
SELECT card_id, 'account_balances.funding', total_funding FROM ({BALANCES}) UNION ALL
SELECT card_id, 'account_balances.adjustments', review_adjustments_total FROM ({BALANCES}) UNION ALL
SELECT transaction_id, 'transactions.amount_aed', amount_aed FROM fx_transactions) WHERE abs(value) < 0.005""", "row_id source $value")
def figure_scan(spark, d):
    t = transactions(spark, d)
    return Q.figure_scan(B.account_balances(t, accounts(spark, d)), t, 0)


@query("set_difference", "U3 J8", """
SELECT DISTINCT card_id, txn_date, amount_aed FROM fx_transactions
EXCEPT SELECT card_id, txn_date, amount_aed FROM fx_transactions WHERE status <> 'voided'""", "card_id @txn_date $amount_aed")
def set_difference(spark, d):
    t = transactions(spark, d)
    return M.set_difference(t, t.filter("status <> 'voided'"), ["card_id", "txn_date", "amount_aed"])


@query("compare_snapshots", "U4", """
SELECT transaction_id, unnest(list_filter([
  CASE WHEN transaction_id % 53 = 0 AND status <> 'confirmed' THEN {'field': 'status', 'was': status, 'became': 'confirmed'} END,
  CASE WHEN transaction_id % 59 = 0 AND payment_ref IS NOT NULL THEN {'field': 'payment_ref', 'was': payment_ref, 'became': NULL} END,
  CASE WHEN transaction_id % 61 = 0 THEN {'field': 'amount_aed', 'was': CAST(amount_aed AS VARCHAR), 'became': CAST(CAST(amount_aed + 1 AS DECIMAL(18,2)) AS VARCHAR)} END],
  lambda x: x IS NOT NULL), recursive := true) FROM fx_transactions WHERE entry_type = 'source_transaction'
UNION ALL SELECT transaction_id, '(row)', 'present', NULL FROM fx_transactions WHERE entry_type <> 'source_transaction'""",
       "transaction_id field was became")
def compare_snapshots(spark, d):
    i = F.col("transaction_id")
    whole = transactions(spark, d)
    columns = ["transaction_id", "status", "payment_ref", "amount_aed", "currency"]
    t = whole.select(*columns)
    damaged = whole.filter("entry_type = 'source_transaction'").select(*columns).withColumns({
        "status": F.when(i % 53 == 0, "confirmed").otherwise(F.col("status")),
        "payment_ref": F.when(i % 59 != 0, F.col("payment_ref")),
        "amount_aed": (F.col("amount_aed") + F.when(i % 61 == 0, 1).otherwise(0)).cast("decimal(18,2)")})
    return Q.compare_snapshots(t, damaged, "transaction_id")
