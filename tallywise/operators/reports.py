"""Reports and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import (bank_charge_line, country_code, is_bac, is_blank, is_placeholder, is_settled_line,
                              text_or_empty, without_country, workflow_note)
from ..plans.scan import running_sum, scan, walk
from ..schema import ADJUSTMENT, MONEY, MONEY_SUM, TOLERANCE
from .chains import in_bank_order
from .filters import supplier_name, with_account


def bank_charges(txn: DataFrame, acct: DataFrame) -> DataFrame:
    """Per bank account: BAC rows and their cost, and how its charge lines are marked."""
    live = txn.filter("status <> 'voided'")
    charge, bac, blank = bank_charge_line(F.col("supplier_raw")), is_bac(F.col("req_number")), is_blank(F.col("req_number"))
    per = live.groupBy("card_id").agg(
        F.count_if(bac).alias("bac_rows"),
        F.coalesce(F.sum(F.when(bac, -F.col("amount_aed"))), F.lit(0)).cast(MONEY_SUM).alias("bac_cost"),
        F.count_if(charge).alias("charge_lines"), F.count_if(charge & bac).alias("marked"),
        F.count_if(charge & blank).alias("unmarked"), F.count_if(charge & ~bac & ~blank).alias("own_reference"),
        F.count_if(~charge & bac).alias("bac_not_charges"))
    return with_account(per, acct.filter("card_type = 'bank_account'"), "card_name", "settlement_currency")


def missing_references(txn: DataFrame, acct: DataFrame) -> DataFrame:
    """Per account: payments out that carry no request number, and their value."""
    open_ = txn.filter("status <> 'voided' AND amount_aed < 0").filter(is_blank(F.col("req_number")))
    per = open_.groupBy("card_id").agg(
        F.count(F.lit(1)).alias("row_count"), (-F.sum("amount_aed")).cast(MONEY_SUM).alias("value"),
        F.min("txn_date").alias("first_day"), F.max("txn_date").alias("last_day"))
    return with_account(per, acct, "card_name", "settlement_currency")


def review_counts(queue: DataFrame) -> DataFrame:
    return queue.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def open_items_by_account(queue: DataFrame, balances: DataFrame) -> DataFrame:
    """Accounts with open reviews, or whose source and ledger balances differ."""
    per = queue.groupBy("card_id").agg(F.count(F.lit(1)).alias("open_items"))
    rows = balances.select("card_id", "card_name", "settlement_currency", "reconciliation_difference").join(per, "card_id", "left")
    rows = rows.withColumn("open_items", F.coalesce("open_items", F.lit(0)))
    return rows.filter((F.col("open_items") > 0)
                       | (F.abs("reconciliation_difference") > F.lit(TOLERANCE).cast("decimal(4,3)")))


def sort_transactions(txn: DataFrame, acct: DataFrame, key: str, direction: str = "asc") -> DataFrame:
    """Sorted as the screen sorts: blanks as empty text, the id following the direction."""
    named = txn.join(acct.select("card_id", F.col("card_name").alias("_name")), "card_id", "left")
    value = {"date": F.coalesce(F.col("txn_date").cast("string"), F.lit("")), "amount": F.abs("amount_aed"),
             "supplier": F.lower(F.coalesce(supplier_name(), F.lit(""))), "card": F.lower(F.coalesce("_name", F.lit(""))),
             "status": F.col("status")}[key]
    way = F.asc if direction == "asc" else F.desc
    return named.withColumn("_v", value).orderBy(way("_v"), way("transaction_id")).drop("_v", "_name")


def export_columns(txn: DataFrame, acct: DataFrame, *extra: str) -> DataFrame:
    """The export: numbers as numbers, ISO dates, one row per transaction."""
    named = txn.join(acct.select("card_id", "card_name"), "card_id", "left")
    held = set(named.columns)
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in held else F.lit("")
    number = lambda c, t: F.col(c).cast(t) if c in held else F.lit(None).cast(t)
    kind = (F.when(F.col("entry_type") == ADJUSTMENT, "Reconciliation adjustment").when(F.col("direction") == "spend", "Spend")
            .when(F.col("direction") == "funding", "Funding").otherwise(""))
    columns = {
        "Ledger ID": F.col("transaction_id"), "Card": blank("card_name"), "Date": blank("txn_date"),
        "Supplier": F.coalesce(without_country(F.col("supplier_raw")), F.col("description"), F.lit("")),
        "AED settlement": F.col("amount_aed"), "Type": kind, "Request number": blank("req_number"),
        "Payment reference": blank("payment_ref"), "LPO number": blank("lpo_number"), "Invoice": blank("invoice"),
        "CRM": blank("crm"), "Client": blank("client"), "Account": blank("account"), "Sales operation": blank("sales_operation"),
        "Original currency": blank("currency"), "Original amount": F.col("original_amount"),
        "Exchange rate (source)": F.col("exchange_rate"),
        "Exchange rate (normalized)": number("normalized_exchange_rate", "decimal(20,10)"),
        "Supplier country": F.coalesce(country_code(F.col("supplier_raw")), F.lit("")),
        "Status": F.regexp_replace("status", "_", " "),
        "In source balance": F.when(F.col("included_in_source_balance"), "Yes").otherwise("No"),
        "Source row": F.col("source_row"), "Source date (raw)": blank("source_date_raw"),
        "Source currency text": blank("currency_raw"), "Rate formula (source)": blank("exchange_rate_formula"),
        "Date repaired": F.when(F.col("date_repaired"), "Yes").otherwise(""),
        "Occurrence": F.coalesce(F.col("occurrence"), F.lit(1)) if "occurrence" in held else F.lit(1),
        "Source sheet": F.coalesce("source_sheet", F.lit("manual entry")), "Review note": blank("rate_review_note"),
        "Review reason": blank("review_reason"), "Notes": blank("notes")}
    return named.select(*[c.alias(n) for n, c in columns.items()], *extra)


def export_transactions(txn: DataFrame, acct: DataFrame, path: str, key: str = "date", direction: str = "desc") -> None:
    """Write the export as CSV files, sorted as viewed (range-partitioned, one sorted file per task).

    The order is numbered before the accounts are joined, which undoes it, and restored last.
    """
    viewed = sort_transactions(txn, acct, key, direction).withColumn("_at", F.monotonically_increasing_id())
    export_columns(viewed, acct, "_at").orderBy("_at").drop("_at") \
        .write.mode("overwrite").option("header", True).option("quoteAll", False).option("escape", '"').csv(path)


def account_summary(txn: DataFrame, balances: DataFrame) -> DataFrame:
    """The export's summary table: every account, with or without rows."""
    n = txn.groupBy("card_id").agg(F.count(F.lit(1)).alias("transactions"))
    return balances.join(n, "card_id", "left").select(
        "card_id", "card_name", F.coalesce("transactions", F.lit(0)).alias("transactions"), "opening_balance",
        F.col("source_balance").alias("statement_balance"), "ledger_balance", F.col("reconciliation_difference").alias("difference"),
        F.col("total_spend").alias("spend"), F.col("total_funding").alias("funding"), "opening_date",
        F.col("last_transaction").alias("last_activity"))


def export_by_account(txn: DataFrame, acct: DataFrame, balances: DataFrame, path: str, buckets: int = 256) -> None:
    """One export split by account, and a summary that lists every account.

    Folders hold a fixed number of account buckets, so a ledger of a hundred
    million accounts does not make a hundred million folders; inside a bucket
    rows are clustered by account.  The summary has the accounts without rows.
    """
    rows = export_columns(txn, acct)
    bucket = F.pmod(F.xxhash64("Card"), F.lit(buckets))
    rows.withColumn("account_bucket", bucket).repartitionByRange("account_bucket", "Card", "Date", "Ledger ID") \
        .sortWithinPartitions("account_bucket", "Card", F.desc("Date"), "Ledger ID") \
        .write.mode("overwrite").partitionBy("account_bucket").parquet(f"{path}/transactions")
    account_summary(txn, balances).write.mode("overwrite").parquet(f"{path}/summary")


def reconciliation_sheets(txn: DataFrame, acct: DataFrame) -> DataFrame:
    """Bank accounts as month sheets: an opening line, then the lines as the bank
    printed them, split into debit and credit, with the running balance and
    whether each amount is settled.

    ``seq`` 0 is the opening line of a month.
    """
    bank = acct.filter("card_type = 'bank_account'")
    live = txn.filter("status <> 'voided' AND txn_date IS NOT NULL").join(bank.select("card_id"), "card_id", "left_semi")
    lines = in_bank_order(live, bank).withColumn("month", F.date_format("txn_date", "yyyy-MM"))
    months = lines.groupBy("card_id", "month").agg(F.sum("amount_aed").alias("_moved"))
    opened = walk(months, ["card_id"], ["month"], [running_sum("_upto", F.col("_moved"))])
    opening = with_account(opened, bank, "card_name", "opening_balance").select(
        "card_id", "month", "card_name",
        (F.col("opening_balance") + F.col("_upto") - F.col("_moved")).cast(MONEY_SUM).alias("_opening"))
    out = F.col("amount_aed") < 0
    # Inside its month a line stands at its month's opening plus what moved since.
    inside = scan(lines.drop("opening_balance", "running_balance"), ["card_id", "month"], ["line_no"],
                  [running_sum("_in", F.col("amount_aed"))]).join(opening, ["card_id", "month"])
    body = inside.select(
        "card_id", "card_name", "month", F.col("line_no").alias("seq"), "transaction_id", F.col("txn_date").alias("day"),
        F.when(is_placeholder(F.col("supplier_raw")), "").otherwise(F.coalesce("supplier_raw", F.lit(""))).alias("description"),
        F.when(out, F.abs("amount_aed")).alias("debit"), F.when(~out, F.abs("amount_aed")).alias("credit"),
        (F.col("_opening") + F.col("_in")).cast(MONEY_SUM).alias("balance"), workflow_note(F.col("notes")).alias("workflow"),
        text_or_empty(F.col("req_number")).alias("reference"),
        is_settled_line(F.col("amount_aed"), F.col("req_number")).alias("settled"))
    first = opening.select("card_id", "card_name", "month", F.lit(0).cast("bigint").alias("seq"), F.col("_opening").alias("balance"))
    return body.unionByName(first, allowMissingColumns=True)


def export_reconciliation(txn: DataFrame, acct: DataFrame, path: str) -> None:
    """Month sheets on disk, one folder per month, sorted by account and line."""
    sheets = reconciliation_sheets(txn, acct)
    sheets.repartitionByRange("month", "card_id", "seq").sortWithinPartitions("month", "card_id", "seq") \
        .write.mode("overwrite").partitionBy("month").parquet(path)


SAMPLE_FIELDS = ["entry_type", "status", "review_reason", "rate_review_note", "description", "source_sheet", "source_row",
                 "txn_date", "source_date_raw", "supplier_raw", "direction", "currency", "original_amount", "currency_raw",
                 "exchange_rate", "normalized_exchange_rate", "exchange_rate_formula", "occurrence", "req_number", "lpo_number",
                 "invoice", "payment_ref", "account", "crm", "client", "sales_operation", "event_end", "notes"]


EXTRACT_PARTS = ("transactions", "cards", "spendByCurrency")


def sample_extract(txn: DataFrame, balances: DataFrame, spend: DataFrame) -> DataFrame:
    """The published extract as JSON lines: ``part`` and ``json``, empty fields left out."""
    full = lambda c: F.when(F.col(c).cast("string") != "", F.col(c))
    held = [c for c in SAMPLE_FIELDS if c in txn.columns]
    rows = txn.select(F.lit("transactions").alias("part"), F.to_json(F.struct(
        F.col("transaction_id").alias("id"), F.col("card_id").alias("cardId"), "amount_aed", "included_in_source_balance",
        F.when(F.col("date_repaired"), True).alias("date_repaired"),
        F.when(without_country(F.col("supplier_raw")) != "", without_country(F.col("supplier_raw"))).alias("supplier"),
        country_code(F.col("supplier_raw")).alias("supplier_country"), *[full(c).alias(c) for c in held])).alias("json"))
    cards = balances.select(F.lit("cards").alias("part"), F.to_json(F.struct(*balances.columns)).alias("json"))
    spent = spend.select(F.lit("spendByCurrency").alias("part"), F.to_json(F.struct(
        F.col("card_id").alias("cardId"), "currency", F.col("transaction_count").alias("count"),
        F.col("total_original_amount").cast(MONEY_SUM).alias("originalTotal"), F.col("total_settled_aed").alias("aedTotal"))).alias("json"))
    return cards.unionByName(rows).unionByName(spent)


__all__ = ["bank_charges", "missing_references", "review_counts", "open_items_by_account", "sort_transactions",
           "export_columns", "export_transactions", "account_summary", "export_by_account", "reconciliation_sheets",
           "export_reconciliation", "sample_extract", "MONEY"]
