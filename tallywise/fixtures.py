"""Accounts, transactions, statements, files and submissions read off the test tables.

The tables know nothing of ledgers, so these projections read one off them:
customers and suppliers are accounts, orders are transactions.  Every row of a
table is projected; nothing is sampled.  ``FIXTURE_SQL`` states the same
projections in DuckDB's dialect for the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.scan import running_sum, walk
from .schema import MONEY


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    currency = "CASE {k} % 4 WHEN 0 THEN 'AED' WHEN 1 THEN 'SAR' WHEN 2 THEN 'EUR' ELSE 'USD' END AS settlement_currency"
    customers = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS card_id", "c_name AS card_name",
        "CASE c_mktsegment WHEN 'BUILDING' THEN 'bank_account' WHEN 'FURNITURE' THEN 'payment_account' ELSE 'card' END AS card_type",
        currency.format(k="c_nationkey"),
        "CAST(CASE WHEN c_mktsegment = 'FURNITURE' THEN 0 ELSE c_acctbal END AS DECIMAL(18,2)) AS opening_balance",
        "CASE c_custkey % 3 WHEN 0 THEN DATE '1995-06-01' WHEN 1 THEN DATE '1995-01-01' END AS opening_date",
        "CASE WHEN c_mktsegment NOT IN ('BUILDING', 'FURNITURE') AND c_custkey % 7 = 0 THEN -1 ELSE 1 END AS balance_sign",
        "c_mktsegment <> 'FURNITURE' AS tracks_balance",
        "CASE WHEN c_custkey % 10 = 9 THEN 'inactive' ELSE 'active' END AS status",
        "concat('ISSUER ', c_nationkey) AS bank_issuer",
        "CASE WHEN c_custkey % 4 <> 3 THEN lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') END AS account_reference",
        "CASE WHEN c_mktsegment = 'BUILDING' THEN NULL WHEN c_custkey % 2 = 0 THEN 'DEBIT' ELSE 'CREDIT' END AS decreasing_header")
    # Suppliers stand for accounts that never moved.
    idle = table(spark, sf_dir, "supplier").selectExpr(
        "-s_suppkey - 1 AS card_id", "s_name AS card_name", "'card' AS card_type", currency.format(k="s_nationkey"),
        "CAST(s_acctbal AS DECIMAL(18,2)) AS opening_balance", "CAST(NULL AS DATE) AS opening_date", "1 AS balance_sign",
        "true AS tracks_balance", "'active' AS status", "concat('ISSUER ', s_nationkey) AS bank_issuer",
        "CAST(NULL AS STRING) AS account_reference", "'DEBIT' AS decreasing_header")
    return customers.unionByName(idle)


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order, a second copy of some and a tenfold slip of others."""
    base = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS ok", "o_custkey AS card_id", "CAST(o_orderdate AS DATE) AS txn_date", "o_orderpriority AS crm",
        "o_orderstatus AS os", "CAST(o_totalprice AS DECIMAL(18,2)) AS price",
        "explode(filter(array(0, CASE WHEN o_orderkey % 23 = 0 THEN 1 END, CASE WHEN o_orderkey % 29 = 0 THEN 2 END), x -> x IS NOT NULL)) AS k")
    base = base.selectExpr(
        "*", "ok * 10 + k AS transaction_id", "CAST(price * CASE WHEN k = 2 THEN 10 ELSE 1 END AS DECIMAL(18,2)) AS mag",
        "k = 1 AND ok % 2 = 0 AS manual", "day(txn_date) * 10000000000000 + ok * 10 + k AS line_key")
    return base.selectExpr(
        "transaction_id", "card_id", "txn_date",
        "CASE WHEN ok % 97 = 0 THEN 'reconciliation_adjustment' ELSE 'source_transaction' END AS entry_type",
        "CASE WHEN ok % 13 = 0 THEN 'voided' WHEN ok % 17 = 0 THEN 'needs_review' WHEN ok % 19 = 0 THEN 'excluded_from_source_balance' ELSE 'confirmed' END AS status",
        """CASE WHEN ok % 17 = 0 OR ok % 97 = 0 THEN CASE ok % 6 WHEN 0 THEN 'rate_without_currency: no code'
           WHEN 1 THEN 'rate_denominator_mismatch: 2 and 3' WHEN 2 THEN 'rate_formula_unexpected: =1/2'
           WHEN 3 THEN "currency_unparseable: '??'" WHEN 4 THEN "currency_unrecognised: 'XYZ'" ELSE "date_invalid: '31/02'" END END AS review_reason""",
        "CASE WHEN ok % 97 = 0 THEN 'Balance typed over in the sheet' END AS description",
        "CASE WHEN ok % 97 = 0 THEN NULL WHEN os = 'F' THEN 'funding' ELSE 'spend' END AS direction",
        "CAST(CASE WHEN os = 'F' THEN mag ELSE -mag END AS DECIMAL(18,2)) AS amount_aed",
        "ok % 19 <> 0 AS included_in_source_balance",
        "CASE ok % 5 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'JPY' END AS currency",
        """CASE ok % 5 WHEN 0 THEN CAST(mag * 0.25BD AS DECIMAL(18,4)) WHEN 1 THEN CAST(mag * 0.20BD AS DECIMAL(18,4))
           WHEN 2 THEN CAST(mag * CASE WHEN ok % 41 = 0 THEN 4 ELSE 40 END AS DECIMAL(18,4)) END AS original_amount""",
        "CASE ok % 5 WHEN 0 THEN concat('USD  ', CAST(mag * 0.25BD AS DECIMAL(18,4))) WHEN 3 THEN 'XYZ 500' END AS currency_raw",
        """CAST(CASE WHEN ok % 5 = 0 THEN 4BD WHEN ok % 5 = 1 THEN 5BD WHEN ok % 5 = 2 THEN 0.025BD WHEN ok % 5 = 3 AND ok % 37 = 0 THEN 3.6725BD
           WHEN ok % 5 = 4 AND ok % 31 = 0 THEN 1BD END AS DECIMAL(20,10)) AS exchange_rate""",
        "CASE WHEN ok % 5 = 0 THEN concat('=E5/', ok) END AS exchange_rate_formula",
        """CASE WHEN ok % 97 = 0 THEN NULL
           WHEN ok % 10 = 3 THEN concat('CHARGES AND FEES', char(10), 'VALUE DATE: 01 JAN', char(10), 'TRF', lpad(CAST(ok % 9000 AS STRING), 4, '0'))
           WHEN ok % 10 = 7 THEN concat('TRANSFER', char(10), 'VALUE DATE : X', char(10), 'ACME TRADING ', ok % 40)
           ELSE concat('SUPPLIER ', ok % 50, CASE WHEN ok % 4 = 0 THEN ' 840' ELSE '' END) END AS supplier_raw""",
        "CASE ok % 6 WHEN 0 THEN NULL WHEN 1 THEN 'BAC' WHEN 2 THEN 'bac ' ELSE concat('SA 9 | REQ ', ok % 300) END AS req_number",
        "CASE ok % 3 WHEN 1 THEN '  ' WHEN 2 THEN concat('LPO ', ok % 90) END AS lpo_number",
        "CASE WHEN ok % 4 <> 1 THEN concat('INV-', ok % 1000) END AS invoice",
        "CASE WHEN ok % 3 <> 0 THEN concat('PAY ', ok % 700) END AS payment_ref",
        "concat('ACC ', ok % 8) AS account", "crm", "concat('CLIENT ', ok % 120) AS client", "CAST(NULL AS STRING) AS event_end",
        "CASE WHEN ok % 9 = 0 THEN 'Gala Dinner' END AS sales_operation",
        "CASE WHEN ok % 6 = 5 THEN concat('sheet note: done ', ok % 7, ' — the sheet dated this x') END AS notes",
        "CASE WHEN NOT manual THEN date_format(txn_date, 'MM-yyyy') END AS source_sheet",
        # Odd accounts print their newest line first.
        "CASE WHEN manual THEN NULL WHEN card_id % 2 = 0 THEN line_key ELSE 1000000000000000 - line_key END AS source_row",
        "CASE WHEN ok % 71 = 0 THEN date_format(txn_date, 'dd/MM/yyyy') END AS source_date_raw",
        "ok % 142 = 0 AS date_repaired", "CASE WHEN ok % 53 = 0 THEN 'normalized rate calculated' END AS rate_review_note",
        "CAST(txn_date AS TIMESTAMP_NTZ) + make_dt_interval(0, 0, 0, ok % 80000 + CASE WHEN k = 1 THEN 30 + 60 * (ok % 2) ELSE 0 END) AS created_at")


def statement_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bank rows with the balance the bank printed: some missing, some one off."""
    t = transactions(spark, sf_dir).filter("status <> 'voided'")
    a = accounts(spark, sf_dir).filter("card_type = 'bank_account'").select("card_id", "opening_balance")
    rows = t.join(a, "card_id")
    rows = walk(rows, ["card_id"], ["txn_date", "transaction_id"], [running_sum("moved", F.col("amount_aed"))])
    ok = F.floor(F.col("transaction_id") / 10)
    return rows.withColumn(
        "statement_balance",
        F.when((ok % 53 != 0) & F.col("source_sheet").isNotNull(),
               F.col("opening_balance") + F.col("moved") + F.when(ok % 101 == 0, 1).otherwise(0)).cast(MONEY),
    ).drop("opening_balance", "moved")


def upload_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet listing the whole ledger again: extra copies, shifted and swapped dates."""
    from .functions.dates import swapped
    ok = F.floor(F.col("transaction_id") / 10)
    t = transactions(spark, sf_dir).filter("entry_type = 'source_transaction'")
    extra = F.when(ok % 31 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return t.withColumn("n", F.explode(extra)).select(
        (F.col("transaction_id") * 10 + F.col("n")).alias("line"), "card_id", "amount_aed",
        "supplier_raw", "req_number", "payment_ref", "direction", "entry_type",
        F.when(ok % 43 == 0, F.date_add("txn_date", 3))
        .when((ok % 7 == 0) & (F.dayofmonth("txn_date") <= 12), swapped(F.col("txn_date")))
        .otherwise(F.col("txn_date")).alias("txn_date"))


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("submission_id"), (F.col("user_id") % 5).alias("card_id"),
        F.col("ts").alias("submitted_at"), F.col("ts").cast("date").alias("txn_date"),
        F.when(e == "purchase", "purchase").when(e == "error", "fee").when(e == "signup", "funding")
        .when(e == "view", "view").otherwise("refund").alias("kind"),
        (10 * (1 + F.floor(F.col("value") / 200))).cast(MONEY).alias("amount"),
        F.concat(F.lit("SUPPLIER "), (F.col("user_id") % 2).cast("string")).alias("supplier"),
        (F.col("event_id") % 11 == 0).alias("allow_duplicate"))


FIXTURE_SQL = """
fx_accounts AS (
SELECT c_custkey AS card_id, c_name AS card_name,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'bank_account' WHEN 'FURNITURE' THEN 'payment_account' ELSE 'card' END AS card_type,
  CASE c_nationkey % 4 WHEN 0 THEN 'AED' WHEN 1 THEN 'SAR' WHEN 2 THEN 'EUR' ELSE 'USD' END AS settlement_currency,
  CASE WHEN c_mktsegment = 'FURNITURE' THEN CAST(0 AS DECIMAL(18,2)) ELSE CAST(c_acctbal AS DECIMAL(18,2)) END AS opening_balance,
  CASE c_custkey % 3 WHEN 0 THEN DATE '1995-06-01' WHEN 1 THEN DATE '1995-01-01' ELSE CAST(NULL AS DATE) END AS opening_date,
  CASE WHEN c_mktsegment NOT IN ('BUILDING','FURNITURE') AND c_custkey % 7 = 0 THEN -1 ELSE 1 END AS balance_sign,
  c_mktsegment <> 'FURNITURE' AS tracks_balance,
  CASE WHEN c_custkey % 10 = 9 THEN 'inactive' ELSE 'active' END AS status,
  'ISSUER ' || CAST(c_nationkey AS VARCHAR) AS bank_issuer,
  CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') END AS account_reference,
  CASE WHEN c_mktsegment = 'BUILDING' THEN NULL WHEN c_custkey % 2 = 0 THEN 'DEBIT' ELSE 'CREDIT' END AS decreasing_header
FROM customer
UNION ALL
SELECT -s_suppkey - 1, s_name, 'card',
  CASE s_nationkey % 4 WHEN 0 THEN 'AED' WHEN 1 THEN 'SAR' WHEN 2 THEN 'EUR' ELSE 'USD' END,
  CAST(s_acctbal AS DECIMAL(18,2)), CAST(NULL AS DATE), 1, TRUE, 'active',
  'ISSUER ' || CAST(s_nationkey AS VARCHAR), NULL, 'DEBIT'
FROM supplier),
fx_base AS (
SELECT o_orderkey * 10 + r.k AS transaction_id, o_orderkey AS ok, r.k AS k, o_custkey AS card_id,
  CAST(o_orderdate AS DATE) AS txn_date, o_orderpriority AS crm,
  CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CASE WHEN r.k = 2 THEN 10 ELSE 1 END AS DECIMAL(18,2)) AS mag,
  o_orderstatus AS os, (r.k = 1 AND o_orderkey % 2 = 0) AS manual
FROM orders
JOIN (VALUES (0),(1),(2)) AS r(k)
  ON r.k = 0 OR (r.k = 1 AND o_orderkey % 23 = 0) OR (r.k = 2 AND o_orderkey % 29 = 0)),
fx_transactions AS (
SELECT transaction_id, card_id, txn_date,
  CASE WHEN ok % 97 = 0 THEN 'reconciliation_adjustment' ELSE 'source_transaction' END AS entry_type,
  CASE WHEN ok % 13 = 0 THEN 'voided' WHEN ok % 17 = 0 THEN 'needs_review'
       WHEN ok % 19 = 0 THEN 'excluded_from_source_balance' ELSE 'confirmed' END AS status,
  CASE WHEN ok % 17 = 0 OR ok % 97 = 0 THEN CASE ok % 6 WHEN 0 THEN 'rate_without_currency: no code'
       WHEN 1 THEN 'rate_denominator_mismatch: 2 and 3' WHEN 2 THEN 'rate_formula_unexpected: =1/2'
       WHEN 3 THEN 'currency_unparseable: ''??''' WHEN 4 THEN 'currency_unrecognised: ''XYZ'''
       ELSE 'date_invalid: ''31/02''' END END AS review_reason,
  CASE WHEN ok % 97 = 0 THEN 'Balance typed over in the sheet' END AS description,
  CASE WHEN ok % 97 = 0 THEN NULL WHEN os = 'F' THEN 'funding' ELSE 'spend' END AS direction,
  CAST(CASE WHEN os = 'F' THEN mag ELSE -mag END AS DECIMAL(18,2)) AS amount_aed,
  ok % 19 <> 0 AS included_in_source_balance,
  CASE ok % 5 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'JPY' ELSE NULL END AS currency,
  CASE ok % 5 WHEN 0 THEN CAST(mag * 0.25 AS DECIMAL(18,4)) WHEN 1 THEN CAST(mag * 0.20 AS DECIMAL(18,4))
       WHEN 2 THEN CAST(mag * CASE WHEN ok % 41 = 0 THEN 4 ELSE 40 END AS DECIMAL(18,4)) ELSE NULL END AS original_amount,
  CASE ok % 5 WHEN 0 THEN 'USD  ' || CAST(CAST(mag * 0.25 AS DECIMAL(18,4)) AS VARCHAR) WHEN 3 THEN 'XYZ 500' END AS currency_raw,
  CAST(CASE WHEN ok % 5 = 0 THEN 4 WHEN ok % 5 = 1 THEN 5 WHEN ok % 5 = 2 THEN 0.025
       WHEN ok % 5 = 3 AND ok % 37 = 0 THEN 3.6725 WHEN ok % 5 = 4 AND ok % 31 = 0 THEN 1 END AS DECIMAL(20,10)) AS exchange_rate,
  CASE WHEN ok % 5 = 0 THEN '=E5/' || CAST(ok AS VARCHAR) END AS exchange_rate_formula,
  CASE WHEN ok % 97 = 0 THEN NULL
       WHEN ok % 10 = 3 THEN 'CHARGES AND FEES' || chr(10) || 'VALUE DATE: 01 JAN' || chr(10) || 'TRF' || lpad(CAST(ok % 9000 AS VARCHAR), 4, '0')
       WHEN ok % 10 = 7 THEN 'TRANSFER' || chr(10) || 'VALUE DATE : X' || chr(10) || 'ACME TRADING ' || CAST(ok % 40 AS VARCHAR)
       ELSE 'SUPPLIER ' || CAST(ok % 50 AS VARCHAR) || CASE WHEN ok % 4 = 0 THEN ' 840' ELSE '' END END AS supplier_raw,
  CASE ok % 6 WHEN 0 THEN NULL WHEN 1 THEN 'BAC' WHEN 2 THEN 'bac ' ELSE 'SA 9 | REQ ' || CAST(ok % 300 AS VARCHAR) END AS req_number,
  CASE ok % 3 WHEN 1 THEN '  ' WHEN 2 THEN 'LPO ' || CAST(ok % 90 AS VARCHAR) END AS lpo_number,
  CASE WHEN ok % 4 <> 1 THEN 'INV-' || CAST(ok % 1000 AS VARCHAR) END AS invoice,
  CASE WHEN ok % 3 = 0 THEN NULL ELSE 'PAY ' || CAST(ok % 700 AS VARCHAR) END AS payment_ref,
  'ACC ' || CAST(ok % 8 AS VARCHAR) AS account, crm,
  'CLIENT ' || CAST(ok % 120 AS VARCHAR) AS client, CAST(NULL AS VARCHAR) AS event_end,
  CASE WHEN ok % 9 = 0 THEN 'Gala Dinner' END AS sales_operation,
  CASE WHEN ok % 6 = 5 THEN 'sheet note: done ' || CAST(ok % 7 AS VARCHAR) || ' — the sheet dated this x' END AS notes,
  CASE WHEN manual THEN NULL ELSE strftime(txn_date, '%m-%Y') END AS source_sheet,
  CASE WHEN manual THEN NULL WHEN card_id % 2 = 0 THEN day(txn_date) * 10000000000000 + transaction_id
       ELSE 1000000000000000 - (day(txn_date) * 10000000000000 + transaction_id) END AS source_row,
  CASE WHEN ok % 71 = 0 THEN strftime(txn_date, '%d/%m/%Y') END AS source_date_raw,
  ok % 142 = 0 AS date_repaired,
  CASE WHEN ok % 53 = 0 THEN 'normalized rate calculated' END AS rate_review_note,
  CAST(txn_date AS TIMESTAMP) + to_seconds(CAST(ok % 80000 + CASE WHEN k = 1 THEN 30 + 60 * (ok % 2) ELSE 0 END AS BIGINT)) AS created_at
FROM fx_base),
fx_statement AS (
SELECT t.*, CASE WHEN (transaction_id // 10) % 53 = 0 OR t.source_sheet IS NULL THEN NULL
  ELSE CAST(a.opening_balance + sum(t.amount_aed) OVER (PARTITION BY t.card_id ORDER BY t.txn_date, t.transaction_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
       + CASE WHEN (transaction_id // 10) % 101 = 0 THEN 1 ELSE 0 END AS DECIMAL(18,2)) END AS statement_balance
FROM fx_transactions t JOIN fx_accounts a ON a.card_id = t.card_id
WHERE a.card_type = 'bank_account' AND t.status <> 'voided'),
fx_file AS (
SELECT f.transaction_id * 10 + c.n AS line, f.card_id, f.amount_aed, f.supplier_raw, f.req_number, f.payment_ref,
  f.direction, f.entry_type,
  CASE WHEN (f.transaction_id // 10) % 43 = 0 THEN CAST(f.txn_date + 3 AS DATE)
       WHEN (f.transaction_id // 10) % 7 = 0 AND day(f.txn_date) <= 12
         THEN make_date(year(f.txn_date), day(f.txn_date), month(f.txn_date))
       ELSE f.txn_date END AS txn_date
FROM fx_transactions f
JOIN (VALUES (0),(1)) AS c(n) ON c.n = 0 OR (f.transaction_id // 10) % 31 = 0
WHERE f.entry_type = 'source_transaction'),
fx_submissions AS (
SELECT event_id AS submission_id, user_id % 5 AS card_id, ts AS submitted_at, CAST(ts AS DATE) AS txn_date,
  CASE event_type WHEN 'purchase' THEN 'purchase' WHEN 'error' THEN 'fee' WHEN 'signup' THEN 'funding'
       WHEN 'view' THEN 'view' ELSE 'refund' END AS kind,
  CAST(10 * (1 + floor(value / 200)) AS DECIMAL(18,2)) AS amount,
  'SUPPLIER ' || CAST(user_id % 2 AS VARCHAR) AS supplier,
  event_id % 11 = 0 AS allow_duplicate
FROM events)
"""
