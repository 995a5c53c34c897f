"""SQL pieces several counterparts share."""

BALANCES = """
SELECT c.card_id, c.card_name, c.settlement_currency, c.opening_balance, c.opening_date, c.balance_sign, c.tracks_balance,
  c.opening_balance + c.balance_sign * coalesce(sum(t.amount_aed) FILTER (WHERE t.included_in_source_balance AND t.status <> 'voided'), 0) AS source_balance,
  c.opening_balance + c.balance_sign * coalesce(sum(t.amount_aed) FILTER (WHERE t.entry_type = 'source_transaction' AND t.status <> 'voided'), 0) AS ledger_balance,
  c.balance_sign * (coalesce(sum(t.amount_aed) FILTER (WHERE t.included_in_source_balance AND t.status <> 'voided'), 0)
    - coalesce(sum(t.amount_aed) FILTER (WHERE t.entry_type = 'source_transaction' AND t.status <> 'voided'), 0)) AS reconciliation_difference,
  coalesce(sum(t.amount_aed) FILTER (WHERE t.entry_type = 'reconciliation_adjustment' AND t.status <> 'voided'), 0) AS review_adjustments_total,
  count(*) FILTER (WHERE t.entry_type = 'reconciliation_adjustment' AND t.status <> 'voided') AS review_adjustments_count,
  coalesce(sum(t.amount_aed) FILTER (WHERE t.direction = 'spend' AND t.status <> 'voided'), 0) AS total_spend,
  coalesce(sum(t.amount_aed) FILTER (WHERE t.direction = 'funding' AND t.status <> 'voided'), 0) AS total_funding,
  count(*) FILTER (WHERE t.entry_type = 'source_transaction' AND t.status <> 'voided') AS transaction_count,
  count(*) FILTER (WHERE t.status = 'needs_review') AS needs_review_count,
  count(*) FILTER (WHERE t.status = 'excluded_from_source_balance') AS excluded_count,
  min(t.txn_date) FILTER (WHERE t.status <> 'voided') AS first_transaction,
  max(t.txn_date) FILTER (WHERE t.status <> 'voided') AS last_transaction
FROM fx_accounts c LEFT JOIN fx_transactions t ON t.card_id = c.card_id AND (c.opening_date IS NULL OR t.txn_date >= c.opening_date)
GROUP BY c.card_id, c.card_name, c.settlement_currency, c.opening_balance, c.opening_date, c.balance_sign, c.tracks_balance
"""

BALANCE_COLUMNS = """card_id card_name settlement_currency $opening_balance @opening_date #balance_sign tracks_balance
$source_balance $ledger_balance $reconciliation_difference $review_adjustments_total #review_adjustments_count
$total_spend $total_funding #transaction_count #needs_review_count #excluded_count @first_transaction @last_transaction"""

SPEND = """
SELECT t.card_id, c.card_name, t.currency, count(*) AS transaction_count, sum(t.original_amount) AS total_original_amount,
  sum(t.amount_aed) AS total_settled_aed, min(t.exchange_rate) AS min_rate, max(t.exchange_rate) AS max_rate
FROM fx_transactions t JOIN fx_accounts c ON c.card_id = t.card_id
WHERE t.currency IS NOT NULL AND t.direction = 'spend' AND t.entry_type = 'source_transaction' AND t.status <> 'voided'
  AND (c.opening_date IS NULL OR t.txn_date >= c.opening_date)
GROUP BY t.card_id, c.card_name, t.currency
"""

TOTALS = """
  coalesce(sum(-amount_aed) FILTER (WHERE entry_type <> 'reconciliation_adjustment' AND amount_aed < 0), 0) AS spent,
  coalesce(sum(amount_aed) FILTER (WHERE entry_type <> 'reconciliation_adjustment' AND amount_aed > 0), 0) AS received,
  coalesce(sum(-amount_aed) FILTER (WHERE entry_type <> 'reconciliation_adjustment'), 0) AS net,
  count(*) AS row_count,
  count(*) FILTER (WHERE entry_type <> 'reconciliation_adjustment' AND amount_aed < 0) AS spend_rows,
  count(*) FILTER (WHERE entry_type <> 'reconciliation_adjustment' AND amount_aed > 0) AS received_rows,
  coalesce(sum(amount_aed) FILTER (WHERE entry_type = 'reconciliation_adjustment'), 0) AS adjustments,
  count(*) FILTER (WHERE entry_type = 'reconciliation_adjustment') AS adjustment_rows
"""
TOTAL_COLUMNS = "$spent $received $net #row_count #spend_rows #received_rows $adjustments #adjustment_rows"

# Stripping a country code, in DuckDB's regular expressions.
SUPPLIER_NAME = r"regexp_replace(supplier_raw, '\s\d{3}\s*$', '')"

NARRATIVE_LINES = r"list_filter(list_transform(string_split({c}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


def lines(c: str) -> str:
    return NARRATIVE_LINES.format(c=c)


def voucher(c: str) -> str:
    return rf"list_filter({lines(c)}, lambda x: regexp_full_match(x, '[A-Z]{{3,5}}\d{{4,6}}'))[-1]"


def flatten(c: str) -> str:
    return rf"lower(trim(regexp_replace({c}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')))"


def supplier_key(c: str) -> str:
    c = f"coalesce({c}, '')"
    noise = r"'(?i)^value date\s*:|^incoming instant payment$|^system generated$|^sab icorp$'"
    told = f"array_to_string(list_filter({lines(c)}, lambda x: NOT regexp_matches(x, {noise})), ' ')"
    bare = rf"regexp_replace({c}, '\s+\d{{3}}\s*$', '')"
    return (f"CASE WHEN contains({c}, chr(10)) AND {voucher(c)} IS NOT NULL THEN 'voucher:' || lower({voucher(c)}) "
            f"WHEN contains({c}, chr(10)) THEN {flatten(told)} ELSE {flatten(bare)} END")


COPY_KEY = supplier_key("coalesce(supplier_raw, {d})")


def copy_key(alias: str = "", description: bool = True) -> str:
    p = f"{alias}." if alias else ""
    inner = f"coalesce({p}supplier_raw, {p}description)" if description else f"{p}supplier_raw"
    return supplier_key(inner)


SIGNATURE = ("concat_ws('|', CAST(card_id AS VARCHAR), coalesce(CAST(txn_date AS VARCHAR), ''), "
             "coalesce(CAST(amount_aed AS VARCHAR), ''), upper(coalesce(supplier_raw, '')), "
             "upper(trim(coalesce(payment_ref, ''))), upper(trim(coalesce(req_number, ''))), "
             "coalesce(direction, entry_type))")
