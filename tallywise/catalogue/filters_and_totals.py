"""Runnable queries: filters, searches, balances and totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import accounts, statement_lines, transactions
from ..operators import balances as B
from ..operators import filters as L
from .registry import query
from .sql_parts import BALANCE_COLUMNS, BALANCES, SPEND, SUPPLIER_NAME, TOTAL_COLUMNS, TOTALS

BRIEF = ["transaction_id", "card_id", "txn_date", "amount_aed", "currency", "status", "req_number"]
BRIEF_SQL = "transaction_id card_id @txn_date $amount_aed currency status req_number"


def _brief(df):
    return df.select(*BRIEF)


def _where(cond: str, source: str = "fx_transactions") -> str:
    return f"SELECT {', '.join(BRIEF)} FROM {source} WHERE {cond}"


@query("account_balances", "A1 J1 J2 F13", BALANCES, BALANCE_COLUMNS)
def account_balances(spark, d):
    return B.account_balances(transactions(spark, d), accounts(spark, d))


@query("spend_by_currency", "A2", SPEND,
       "card_id card_name currency #transaction_count $total_original_amount $total_settled_aed $min_rate $max_rate")
def spend_by_currency(spark, d):
    return B.spend_by_currency(transactions(spark, d), accounts(spark, d))


@query("spend_by_currency_overall", "A3", f"""
SELECT currency, sum(transaction_count) AS transaction_count, sum(total_original_amount) AS total_original_amount,
  sum(total_settled_aed) AS total_settled_aed FROM ({SPEND}) s JOIN fx_accounts a USING (card_id)
WHERE a.settlement_currency = 'AED' GROUP BY currency""",
       "currency #transaction_count $total_original_amount $total_settled_aed")
def spend_by_currency_overall(spark, d):
    a = accounts(spark, d)
    return B.spend_by_currency_overall(B.spend_by_currency(transactions(spark, d), a), a, "AED")


@query("ledger_totals", "A4", f"""
SELECT settlement_currency, sum(ledger_balance) AS live_balance, sum(source_balance) AS source_balance,
  sum(reconciliation_difference) AS reconciliation_difference, count(*) AS card_count
FROM ({BALANCES}) WHERE tracks_balance GROUP BY settlement_currency""",
       "settlement_currency $live_balance $source_balance $reconciliation_difference #card_count")
def ledger_totals(spark, d):
    return B.ledger_totals(B.account_balances(transactions(spark, d), accounts(spark, d)))


@query("ledger_counts", "A4", f"""
SELECT count(*) AS card_count, sum(transaction_count) AS transaction_count, sum(needs_review_count) AS needs_review,
  sum(excluded_count) AS excluded, count(*) FILTER (WHERE tracks_balance AND abs(reconciliation_difference) > 0.005) AS cards_with_difference
FROM ({BALANCES})""", "#card_count #transaction_count #needs_review #excluded #cards_with_difference")
def ledger_counts(spark, d):
    return B.ledger_counts(B.account_balances(transactions(spark, d), accounts(spark, d)))


@query("accounts_with_difference", "A5",
       f"SELECT * FROM ({BALANCES}) WHERE tracks_balance AND abs(reconciliation_difference) > 0.005", BALANCE_COLUMNS)
def accounts_with_difference(spark, d):
    return B.accounts_with_difference(B.account_balances(transactions(spark, d), accounts(spark, d)))


@query("negative_accounts", "Q22", f"SELECT * FROM ({BALANCES}) WHERE ledger_balance < 0", BALANCE_COLUMNS)
def negative_accounts(spark, d):
    return B.negative_accounts(B.account_balances(transactions(spark, d), accounts(spark, d)))


MONTHLY = """
SELECT strftime(txn_date, '%Y-%m') AS month, coalesce(sum(amount_aed) FILTER (WHERE direction = 'spend'), 0) AS spend,
  coalesce(sum(amount_aed) FILTER (WHERE direction = 'funding'), 0) AS funding
FROM fx_transactions t JOIN fx_accounts a USING (card_id)
WHERE a.settlement_currency = 'AED' AND t.entry_type = 'source_transaction' {voided} GROUP BY 1 ORDER BY month DESC LIMIT 6"""


@query("activity_by_month", "A6 O2 X23", MONTHLY.format(voided="AND t.status <> 'voided'"), "month $spend $funding")
def activity_by_month(spark, d):
    return B.activity_by_month(transactions(spark, d), accounts(spark, d))


@query("activity_by_month_with_voided", "A6", MONTHLY.format(voided=""), "month $spend $funding")
def activity_by_month_with_voided(spark, d):
    return B.activity_by_month(transactions(spark, d), accounts(spark, d), include_voided=True)


@query("top_suppliers", "A7 O2", rf"""
SELECT {SUPPLIER_NAME} AS supplier, count(*) AS row_count, sum(amount_aed) AS settled
FROM fx_transactions t JOIN fx_accounts a USING (card_id)
WHERE a.settlement_currency = 'AED' AND t.direction = 'spend' AND trim(coalesce(t.supplier_raw, '')) <> '' AND t.status <> 'voided'
GROUP BY 1 ORDER BY settled, supplier LIMIT 8""", "supplier #row_count $settled")
def top_suppliers(spark, d):
    return B.top_suppliers(transactions(spark, d), accounts(spark, d))


@query("result_totals", "A8", f"""
SELECT a.settlement_currency, {TOTALS} FROM fx_transactions t JOIN fx_accounts a USING (card_id)
WHERE t.status <> 'voided' GROUP BY 1""", "settlement_currency " + TOTAL_COLUMNS)
def result_totals(spark, d):
    return B.result_totals(transactions(spark, d), accounts(spark, d))


@query("result_totals_by_currency", "A9", """
SELECT currency, sum(abs(original_amount) * CASE WHEN amount_aed < 0 THEN 1 ELSE -1 END) AS amount, count(*) AS row_count
FROM fx_transactions WHERE status <> 'voided' AND entry_type <> 'reconciliation_adjustment' AND currency IS NOT NULL
  AND coalesce(original_amount, 0) <> 0 GROUP BY 1""", "currency $amount #row_count")
def result_totals_by_currency(spark, d):
    return B.result_totals_by_currency(transactions(spark, d))


@query("settlement_currencies", "A10", """
SELECT settlement_currency, count(*) OVER () = 1 AS single_total FROM (
  SELECT DISTINCT a.settlement_currency FROM fx_transactions t JOIN fx_accounts a USING (card_id) WHERE t.status <> 'voided')""",
       "settlement_currency single_total")
def settlement_currencies(spark, d):
    return B.settlement_currencies(transactions(spark, d), accounts(spark, d))


@query("totals_by_reference", "A11", f"""
SELECT upper(trim(req_number)) AS reference, a.settlement_currency, {TOTALS.replace("count(*) AS row_count", "count(*) AS row_count")}
FROM fx_transactions t JOIN fx_accounts a USING (card_id)
WHERE t.status <> 'voided' AND trim(coalesce(req_number, '')) <> '' GROUP BY 1, 2""",
       "reference settlement_currency " + TOTAL_COLUMNS)
def totals_by_reference(spark, d):
    live = transactions(spark, d).filter("status <> 'voided'")
    return B.totals_by_reference(live, accounts(spark, d))


@query("bank_period", "A12", """
SELECT p.card_id, p.card_name, p.opening, p.paid_out, p.came_in, p.closing, p.last_day,
  (SELECT bool_or(abs(s.statement_balance - p.closing) < 0.005) FROM fx_statement s
    WHERE s.card_id = p.card_id AND s.txn_date = p.last_day AND s.statement_balance IS NOT NULL) AS bank_agrees
FROM (SELECT *, opening - paid_out + came_in AS closing FROM (
  SELECT a.card_id, a.card_name,
    a.opening_balance + coalesce(sum(s.amount_aed) FILTER (WHERE s.txn_date < DATE '1997-03-01'), 0) AS opening,
    coalesce(sum(-s.amount_aed) FILTER (WHERE s.txn_date >= DATE '1997-03-01' AND s.amount_aed < 0), 0) AS paid_out,
    coalesce(sum(s.amount_aed) FILTER (WHERE s.txn_date >= DATE '1997-03-01' AND s.amount_aed >= 0), 0) AS came_in,
    max(s.txn_date) FILTER (WHERE s.txn_date >= DATE '1997-03-01') AS last_day
  FROM fx_accounts a LEFT JOIN fx_statement s ON s.card_id = a.card_id AND s.txn_date <= DATE '1998-02-28'
  WHERE a.card_type = 'bank_account' GROUP BY a.card_id, a.card_name, a.opening_balance)) p""",
       "card_id card_name $opening $paid_out $came_in $closing @last_day bank_agrees")
def bank_period(spark, d):
    bank = accounts(spark, d).filter("card_type = 'bank_account'")
    return B.bank_period(statement_lines(spark, d), bank, "1997-03-01", "1998-02-28")


MONTHS = """
SELECT card_id, card_name, settlement_currency, month, closing - came_in + paid_out AS opening, paid_out, came_in, closing, row_count, last_day
FROM (SELECT m.*, a.card_name, a.settlement_currency,
  a.opening_balance + sum(came_in - paid_out) OVER (PARTITION BY m.card_id ORDER BY month) AS closing
FROM (SELECT card_id, strftime(txn_date, '%Y-%m') AS month, coalesce(sum(-amount_aed) FILTER (WHERE amount_aed < 0), 0) AS paid_out,
  coalesce(sum(amount_aed) FILTER (WHERE amount_aed >= 0), 0) AS came_in, count(*) AS row_count, max(txn_date) AS last_day
  FROM fx_transactions WHERE status <> 'voided' GROUP BY 1, 2) m JOIN fx_accounts a USING (card_id))"""


@query("bank_months", "A13", MONTHS,
       "card_id card_name settlement_currency month $opening $paid_out $came_in $closing #row_count @last_day")
def bank_months(spark, d):
    return B.bank_months(transactions(spark, d), accounts(spark, d))


@query("month_continuity", "Q12", f"""
SELECT * FROM (SELECT * REPLACE (opening + CASE WHEN month LIKE '%-07' THEN 1 ELSE 0 END AS opening),
  lag(closing) OVER (PARTITION BY card_id ORDER BY month) AS closed_before FROM ({MONTHS}))
WHERE abs(opening - closed_before) > 0.005""",
       "card_id card_name settlement_currency month $opening $paid_out $came_in $closing #row_count @last_day $closed_before")
def month_continuity(spark, d):
    # July sheets are taken to open one unit off.
    months = B.bank_months(transactions(spark, d), accounts(spark, d))
    return B.month_continuity(months.withColumn(
        "opening", F.col("opening") + F.when(F.col("month").endswith("-07"), 1).otherwise(0)))


@query("extraction_summary", "A14", """
SELECT a.card_id, a.opening_balance, a.opening_balance + inc AS source_balance, a.opening_balance + led AS ledger_balance,
  inc - led AS reconciliation_difference, total_spend, total_funding, review_adjustments_total, needs_review, excluded
FROM fx_accounts a JOIN (SELECT a.card_id,
  coalesce(sum(amount_aed) FILTER (WHERE t.status <> 'voided' AND included_in_source_balance), 0) AS inc,
  coalesce(sum(amount_aed) FILTER (WHERE t.status <> 'voided' AND entry_type = 'source_transaction'), 0) AS led,
  coalesce(sum(amount_aed) FILTER (WHERE t.status <> 'voided' AND direction = 'spend'), 0) AS total_spend,
  coalesce(sum(amount_aed) FILTER (WHERE t.status <> 'voided' AND direction = 'funding'), 0) AS total_funding,
  coalesce(sum(amount_aed) FILTER (WHERE t.status <> 'voided' AND entry_type = 'reconciliation_adjustment'), 0) AS review_adjustments_total,
  count(*) FILTER (WHERE t.status = 'needs_review') AS needs_review,
  count(*) FILTER (WHERE t.status = 'excluded_from_source_balance') AS excluded
  FROM fx_accounts a LEFT JOIN fx_transactions t USING (card_id) GROUP BY a.card_id) s USING (card_id)""",
       "card_id $opening_balance $source_balance $ledger_balance $reconciliation_difference $total_spend $total_funding "
       "$review_adjustments_total #needs_review #excluded")
def extraction_summary(spark, d):
    return B.extraction_summary(transactions(spark, d), accounts(spark, d))


@query("running_balance", "W2", """
SELECT t.card_id, t.transaction_id, t.txn_date, a.opening_balance + sum(t.amount_aed) OVER (PARTITION BY t.card_id
  ORDER BY t.txn_date, t.transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_balance
FROM fx_transactions t JOIN fx_accounts a USING (card_id) WHERE t.status <> 'voided'""",
       "card_id transaction_id @txn_date $running_balance")
def running_balance(spark, d):
    live = transactions(spark, d).filter("status <> 'voided'") \
        .select("card_id", "transaction_id", "txn_date", "amount_aed")
    return B.running_balance(live, accounts(spark, d)).select(
        "card_id", "transaction_id", "txn_date", "running_balance")


@query("balance_history", "W5", """
SELECT t.card_id, t.transaction_id, t.txn_date, a.opening_balance + sum(t.amount_aed) OVER (PARTITION BY t.card_id
  ORDER BY t.txn_date, t.transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS balance
FROM fx_transactions t JOIN fx_accounts a USING (card_id)
WHERE t.status <> 'voided' AND t.entry_type = 'source_transaction'""", "card_id transaction_id @txn_date $balance")
def balance_history(spark, d):
    return B.balance_history(transactions(spark, d), accounts(spark, d))


# ------------------------------------------------------------------ filters

@query("filter_accounts", "F1", _where("card_id IN (7, 8, 11)"), BRIEF_SQL)
def filter_accounts(spark, d):
    return _brief(L.filter_accounts(transactions(spark, d), [7, 8, 11]))


@query("filter_currency", "F2", _where("coalesce(currency, 'unknown') IN ('JPY', 'unknown')"), BRIEF_SQL)
def filter_currency(spark, d):
    return _brief(L.filter_currency(transactions(spark, d), ["JPY", "unknown"]))


@query("filter_status", "F3", _where("status IN ('needs_review', 'voided')"), BRIEF_SQL)
def filter_status(spark, d):
    return _brief(L.filter_status(transactions(spark, d), ["needs_review", "voided"]))


@query("filter_kind", "F4", _where("CASE WHEN entry_type = 'reconciliation_adjustment' THEN 'adjustment' "
                                   "ELSE coalesce(direction, 'adjustment') END IN ('funding', 'adjustment')"), BRIEF_SQL)
def filter_kind(spark, d):
    return _brief(L.filter_kind(transactions(spark, d), ["funding", "adjustment"]))


@query("filter_supplier", "F5", _where(f"{SUPPLIER_NAME} IN ('SUPPLIER 12', 'SUPPLIER 40')"), BRIEF_SQL)
def filter_supplier(spark, d):
    return _brief(L.filter_supplier(transactions(spark, d), ["SUPPLIER 12", "SUPPLIER 40"]))


@query("filter_dates", "F6", _where("txn_date BETWEEN DATE '1996-02-01' AND DATE '1997-01-31'"), BRIEF_SQL)
def filter_dates(spark, d):
    return _brief(L.filter_dates(transactions(spark, d), "1996-02-01", "1997-01-31"))


@query("filter_missing_request", "F7", _where("trim(coalesce(req_number, '')) = '' AND amount_aed < 0"), BRIEF_SQL)
def filter_missing_request(spark, d):
    return _brief(L.filter_missing(transactions(spark, d), "req_number"))


@query("filter_missing_lpo", "F7", _where("trim(coalesce(lpo_number, '')) = ''"), BRIEF_SQL)
def filter_missing_lpo(spark, d):
    return _brief(L.filter_missing(transactions(spark, d), "lpo_number"))


@query("filter_bank_charges_only", "F8", _where("upper(trim(coalesce(req_number, ''))) = 'BAC'"), BRIEF_SQL)
def filter_bank_charges_only(spark, d):
    return _brief(L.filter_bank_charges(transactions(spark, d), "only"))


@query("filter_bank_charges_hide", "F8", _where("upper(trim(coalesce(req_number, ''))) <> 'BAC'"), BRIEF_SQL)
def filter_bank_charges_hide(spark, d):
    return _brief(L.filter_bank_charges(transactions(spark, d), "hide"))


@query("filter_source_manual", "F9", _where("coalesce(source_sheet, '') = ''"), BRIEF_SQL)
def filter_source_manual(spark, d):
    return _brief(L.filter_source(transactions(spark, d), "manual"))


HAYSTACK = f"""lower(concat_ws(' ' || chr(1) || ' ', nullif(a.card_name, ''), nullif({SUPPLIER_NAME}, ''), nullif(supplier_raw, ''),
  nullif(req_number, ''), nullif(payment_ref, ''), nullif(invoice, ''), nullif(lpo_number, ''), crm, client, sales_operation, account,
  event_end, currency, currency_raw, source_date_raw, description, notes, review_reason, rate_review_note, source_sheet,
  'row ' || CAST(source_row AS VARCHAR)))"""
HAY = f"SELECT t.*, {HAYSTACK} AS hay FROM fx_transactions t JOIN fx_accounts a USING (card_id)"


@query("search", "F10 J1", f"""SELECT {', '.join(BRIEF)} FROM ({HAY})
WHERE contains(hay, 'supplier 1') AND contains(hay, 'sa 9') AND contains(hay, 'pay')""", BRIEF_SQL)
def search(spark, d):
    return _brief(L.search(transactions(spark, d), accounts(spark, d), 'Supplier "SA 9" PAY').filter(
        F.contains(L.haystack(F.lit("")), F.lit("supplier 1"))))


@query("apply_filters", "F11", f"""SELECT {', '.join(BRIEF)} FROM ({HAY})
WHERE coalesce(currency, 'unknown') IN ('USD', 'EUR') AND status IN ('confirmed', 'needs_review') AND direction = 'spend'
  AND entry_type <> 'reconciliation_adjustment' AND txn_date >= DATE '1996-01-01' AND trim(coalesce(payment_ref, '')) = ''
  AND upper(trim(coalesce(req_number, ''))) <> 'BAC' AND coalesce(source_sheet, '') <> ''
  AND contains(hay, 'customer') AND contains(hay, 'req 1')""", BRIEF_SQL)
def apply_filters(spark, d):
    f = L.Filters(query='customer "REQ 1"', currencies=["USD", "EUR"], statuses=["confirmed", "needs_review"],
                  kinds=["spend"], date_from="1996-01-01", missing="payment_ref", bank_charges="hide",
                  source="imported")
    return _brief(L.apply_filters(transactions(spark, d), accounts(spark, d), f))


@query("search_text", "F12", """
SELECT transaction_id, search_text, card_name || ' ' || search_text AS full_search_text FROM (
SELECT t.transaction_id, a.card_name, concat_ws(' ', coalesce(supplier_raw, ''), coalesce(req_number, ''), coalesce(lpo_number, ''),
  coalesce(payment_ref, ''), coalesce(invoice, ''), coalesce(account, ''), coalesce(crm, ''), coalesce(client, ''),
  coalesce(sales_operation, ''), coalesce(event_end, ''), coalesce(currency_raw, ''), coalesce(source_date_raw, ''),
  coalesce(description, ''), coalesce(notes, '')) AS search_text
FROM fx_transactions t JOIN fx_accounts a USING (card_id))""", "transaction_id search_text full_search_text")
def search_text(spark, d):
    return L.search_text(transactions(spark, d), accounts(spark, d)).select(
        "transaction_id", "search_text", "full_search_text")


@query("in_balance", "F13", f"""SELECT {', '.join('t.' + b for b in BRIEF)} FROM fx_transactions t JOIN fx_accounts a USING (card_id)
WHERE t.status <> 'voided' AND (a.opening_date IS NULL OR t.txn_date >= a.opening_date)""", BRIEF_SQL)
def in_balance(spark, d):
    return _brief(L.in_balance(transactions(spark, d), accounts(spark, d)))
