"""Runnable queries: recognising rows already held, and reading cell values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import accounts, statement_lines, table, transactions, upload_lines
from ..functions import amounts as A
from ..functions import dates as D
from ..functions import keys as K
from ..functions import text as X
from ..operators import balances as B
from ..operators import matching as M
from .registry import query
from .sql_parts import BALANCES, SIGNATURE, supplier_key, voucher

FILE_KEY = supplier_key("f.supplier_raw")
LEDGER_KEY = supplier_key("coalesce(supplier_raw, description)")
CENTS = "CAST(round(abs({p}amount_aed) * 100) AS BIGINT)"

HELD = f"""SELECT transaction_id, card_id, txn_date AS day, {CENTS.format(p='')} AS cents, {LEDGER_KEY} AS skey, amount_aed < 0 AS money_out,
  status, contains(trim(coalesce(supplier_raw, description, '')), chr(10)) AS narrative FROM fx_transactions"""
LINES = f"""SELECT f.line, f.card_id, f.txn_date AS day, {CENTS.format(p='f.')} AS cents, {FILE_KEY} AS skey, f.amount_aed < 0 AS money_out,
  contains(trim(coalesce(f.supplier_raw, '')), chr(10)) AS narrative FROM fx_file f"""
COUNTED = f"""
SELECT l.*, h.transaction_id AS held_id, coalesce(n.held, 0) AS held FROM (
  SELECT *, row_number() OVER (PARTITION BY card_id, day, cents, skey ORDER BY line) AS copy,
    nullif(min(line) OVER (PARTITION BY card_id, day, cents, skey), line) AS repeat_of FROM ({LINES})) l
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY card_id, day, cents, skey ORDER BY transaction_id) AS copy FROM ({HELD})) h
  USING (card_id, day, cents, skey, copy)
LEFT JOIN (SELECT card_id, day, cents, skey, count(*) AS held FROM ({HELD}) GROUP BY 1, 2, 3, 4) n USING (card_id, day, cents, skey)"""


@query("counted_match", "J10 W11", f"SELECT line, copy, held, repeat_of, held_id FROM ({COUNTED})", "line #copy #held repeat_of held_id")
def counted_match(spark, d):
    key = {"day": F.col("txn_date"), "cents": M.cents(F.col("amount_aed"))}
    lines = upload_lines(spark, d).withColumns({**key, "skey": X.supplier_key(F.col("supplier_raw"))})
    ledger = M.cut_lineage(transactions(spark, d).select("transaction_id", "card_id", *[v.alias(k) for k, v in key.items()], K.copy_key().alias("skey")))
    return M.counted_match(lines, ledger, ["card_id", "day", "cents", "skey"]).select(
        "line", "copy", "held", "repeat_of", "held_id")


CLASSIFIED = f"""
SELECT q.line, CASE WHEN held_id IS NOT NULL THEN 'held' WHEN swapped_id IS NOT NULL THEN 'held_swapped' WHEN claimed IS NOT NULL THEN 'held_other_date'
    WHEN fits > 1 THEN 'several_near' WHEN held > 0 THEN 'missing_copy' ELSE 'new' END AS outcome,
  coalesce(held_id, swapped_id, claimed) AS duplicate_of, copy, held, repeat_of
FROM second q LEFT JOIN (
  SELECT line, count(*) AS fits, CASE WHEN count(*) = 1 AND line = min(line) OVER (PARTITION BY min(transaction_id)) THEN min(transaction_id) END AS claimed
  FROM (SELECT l.line, p.transaction_id FROM second l JOIN pool p ON l.card_id = p.card_id AND l.cents = p.cents AND l.money_out = p.money_out
     AND l.skey = p.skey AND abs(date_diff('day', l.day, p.day)) <= 7
   WHERE l.narrative AND l.held_id IS NULL AND l.swapped_id IS NULL) GROUP BY line) c ON c.line = q.line"""
CLASSIFY_SQL = f"""
WITH second AS MATERIALIZED (SELECT c.*, s.swapped_id FROM ({COUNTED}) c LEFT JOIN (SELECT card_id, day AS on_day, cents, skey, min(transaction_id) AS swapped_id FROM ({HELD}) GROUP BY 1, 2, 3, 4) s
    ON c.held = 0 AND day(c.day) <= 12 AND day(c.day) <> month(c.day) AND s.card_id = c.card_id AND s.cents = c.cents AND s.skey = c.skey
    AND s.on_day = CASE WHEN day(c.day) <= 12 THEN make_date(year(c.day), day(c.day), month(c.day)) END),
pool AS MATERIALIZED (SELECT * FROM ({HELD}) h WHERE status <> 'voided' AND narrative
  AND transaction_id NOT IN (SELECT coalesce(held_id, swapped_id) FROM second WHERE coalesce(held_id, swapped_id) IS NOT NULL))
{CLASSIFIED}"""


@query("classify_duplicates", "I2 J10 J11 J12 W11", CLASSIFY_SQL, "line outcome duplicate_of #copy #held repeat_of")
def classify_duplicates(spark, d):
    return M.classify_duplicates(upload_lines(spark, d), transactions(spark, d)).select(
        "line", "outcome", "duplicate_of", "copy", "held", "repeat_of")


@query("match_by_balance", "J13", """
SELECT l.line, coalesce(n, 0) AS balance_rows, CASE WHEN n = 1 THEN id END AS held_id FROM (
SELECT transaction_id AS line, card_id, CASE WHEN transaction_id % 9 = 0 THEN statement_balance + 5 ELSE statement_balance END AS balance FROM fx_statement
WHERE statement_balance IS NOT NULL) l LEFT JOIN (SELECT card_id, statement_balance AS b, count(*) AS n, min(transaction_id) AS id FROM fx_statement
WHERE statement_balance IS NOT NULL GROUP BY 1, 2) s ON s.card_id = l.card_id AND s.b = l.balance""", "line #balance_rows held_id")
def match_by_balance(spark, d):
    s = statement_lines(spark, d)
    lines = s.filter("statement_balance IS NOT NULL").select(
        F.col("transaction_id").alias("line"), "card_id",
        (F.col("statement_balance") + F.when(F.col("transaction_id") % 9 == 0, 5).otherwise(0)).alias("balance"))
    return M.match_by_balance(lines, s).select("line", "balance_rows", "held_id")


@query("match_by_id", "J14", """
SELECT line, CASE WHEN error IS NULL THEN id END AS held_id, error FROM (
SELECT l.line, t.transaction_id AS id, CASE WHEN gid = '' THEN 'The line gives no id.'
  WHEN min(l.line) OVER (PARTITION BY gid) <> l.line THEN 'Given before, in line ' || CAST(min(l.line) OVER (PARTITION BY gid) AS VARCHAR)
  WHEN t.transaction_id IS NULL THEN 'The ledger has no row of this id.'
  WHEN t.card_id <> l.card_id THEN 'The row of this id is in another account.' END AS error
FROM (SELECT line, card_id + CASE WHEN line % 13 = 0 THEN 1 ELSE 0 END AS card_id,
   CASE WHEN line % 17 = 0 THEN '' WHEN line % 19 = 0 THEN 'x' || CAST(line AS VARCHAR) ELSE CAST(line // 10 AS VARCHAR) END AS gid FROM fx_file) l
LEFT JOIN fx_transactions t ON CAST(t.transaction_id AS VARCHAR) = l.gid)""", "line held_id error")
def match_by_id(spark, d):
    line = F.col("line")
    lines = upload_lines(spark, d).select(
        "line", (F.col("card_id") + F.when(line % 13 == 0, 1).otherwise(0)).alias("card_id"),
        F.when(line % 17 == 0, "  ").when(line % 19 == 0, F.concat(F.lit("x"), line.cast("string")))
        .otherwise(F.floor(line / 10).cast("string")).alias("ledger_id"))
    return M.match_by_id(lines, transactions(spark, d)).select("line", "held_id", "error")


VOUCHED = f"""
SELECT r.transaction_id, r.voucher, b.bank_date, CASE WHEN b.line IS NULL THEN 'unmatched' WHEN b.bank_date = r.txn_date THEN 'agrees' ELSE 'date_differs' END AS outcome
FROM (SELECT *, row_number() OVER (PARTITION BY card_id, voucher, amount_aed ORDER BY transaction_id) AS k FROM (
  SELECT t.transaction_id, t.card_id, t.txn_date, t.amount_aed, {voucher("coalesce(t.supplier_raw, '')")} AS voucher
  FROM fx_transactions t JOIN span s ON s.card_id = t.card_id AND t.txn_date BETWEEN s.lo - 7 AND s.hi + 7 WHERE t.status <> 'voided')) r
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY card_id, voucher, amount_aed ORDER BY line) AS k FROM stated WHERE voucher IS NOT NULL) b
  ON b.card_id = r.card_id AND b.voucher = r.voucher AND b.amount_aed = r.amount_aed AND b.k = r.k"""


@query("match_by_voucher", "J15", f"""
WITH stated AS (SELECT line, card_id, amount_aed, txn_date AS bank_date, {voucher("coalesce(supplier_raw, '')")} AS voucher FROM fx_file),
span AS (SELECT card_id, min(bank_date) AS lo, max(bank_date) AS hi FROM stated GROUP BY 1) {VOUCHED}""",
       "transaction_id voucher @bank_date outcome")
def match_by_voucher(spark, d):
    statement = upload_lines(spark, d).withColumnRenamed("txn_date", "bank_date")
    return M.match_by_voucher(transactions(spark, d), statement).select("transaction_id", "voucher", "bank_date", "outcome")


@query("resolve_accounts", "J16", """
SELECT s.statement_id, CASE WHEN n.k > 0 THEN n.card_id WHEN r.k > 0 THEN r.card_id ELSE i.card_id END AS card_id,
  CASE WHEN n.k > 1 THEN 'ambiguous name' WHEN n.k = 1 THEN 'name' WHEN r.k > 1 THEN 'ambiguous reference' WHEN r.k = 1 THEN 'reference'
    WHEN i.card_id IS NOT NULL THEN 'issuer and currency' END AS resolved_by
FROM (SELECT card_id AS statement_id, CASE WHEN card_id % 3 = 0 THEN card_name ELSE 'BANK ' || CAST(card_id AS VARCHAR) END AS nm,
  CASE WHEN card_id % 2 = 0 AND account_reference IS NOT NULL THEN '99' || account_reference ELSE 'ZZ' END AS num, bank_issuer, settlement_currency FROM fx_accounts) s
LEFT JOIN (SELECT card_name, CASE WHEN count(*) = 1 THEN min(card_id) END AS card_id, count(*) AS k FROM fx_accounts GROUP BY 1) n ON n.card_name = s.nm
LEFT JOIN (SELECT account_reference AS ref, CASE WHEN count(*) = 1 THEN min(card_id) END AS card_id, count(*) AS k FROM fx_accounts WHERE account_reference IS NOT NULL GROUP BY 1) r ON right(s.num, 4) = r.ref
LEFT JOIN (SELECT bank_issuer, settlement_currency, min(card_id) AS card_id FROM fx_accounts WHERE status = 'active' GROUP BY 1, 2 HAVING count(*) = 1) i
  ON i.bank_issuer = s.bank_issuer AND i.settlement_currency = s.settlement_currency""", "statement_id card_id resolved_by")
def resolve_accounts(spark, d):
    a, c = accounts(spark, d), F.col("card_id")
    statements = a.select(
        c.alias("statement_id"),
        F.when(c % 3 == 0, F.col("card_name")).otherwise(F.concat(F.lit("BANK "), c.cast("string"))).alias("account_name"),
        F.when((c % 2 == 0) & F.col("account_reference").isNotNull(), F.concat(F.lit("99"), "account_reference"))
        .otherwise("ZZ").alias("account_number"), "bank_issuer", F.col("settlement_currency").alias("currency"))
    return M.resolve_accounts(statements, a).select("statement_id", "card_id", "resolved_by")


@query("match_sheet_accounts", "J17", """
SELECT sheet, card_id FROM (SELECT s.sheet, a.card_id, row_number() OVER (PARTITION BY s.sheet ORDER BY length(a.key) DESC, a.card_id) AS k FROM (
  SELECT DISTINCT CASE WHEN card_id % 5 = 0 THEN 'Sheet ' || CAST(card_id AS VARCHAR) ELSE 'Copy of ' || lower(card_name) || '0 (old)' END AS sheet FROM fx_accounts) s
LEFT JOIN (SELECT card_id, upper(trim(card_name)) AS key FROM fx_accounts) a ON contains(upper(s.sheet || ' statements.xlsx'), a.key)) WHERE k = 1""",
       "sheet card_id")
def match_sheet_accounts(spark, d):
    a, c = accounts(spark, d), F.col("card_id")
    sheets = a.select(
        F.lit("statements.xlsx").alias("file"),
        F.when(c % 5 == 0, F.concat(F.lit("Sheet "), c.cast("string")))
        .otherwise(F.concat(F.lit("Copy of "), F.lower("card_name"), F.lit("0 (old)"))).alias("sheet")).distinct()
    return M.match_sheet_accounts(sheets, a).select("sheet", "card_id")


@query("cross_check", "J18", f"""
SELECT b.card_id, unnest([{{'figure': 'source_balance', 'left_value': CAST(b.source_balance AS DOUBLE), 'right_value': CAST(x.s AS DOUBLE), 'verdict': CASE WHEN x.card_id IS NULL THEN 'missing on the right' WHEN abs(b.source_balance - x.s) < 0.005 THEN 'agrees' ELSE 'differs' END}},
  {{'figure': 'ledger_balance', 'left_value': CAST(b.ledger_balance AS DOUBLE), 'right_value': CAST(x.l AS DOUBLE), 'verdict': CASE WHEN x.card_id IS NULL THEN 'missing on the right' WHEN abs(b.ledger_balance - x.l) < 0.005 THEN 'agrees' ELSE 'differs' END}}], recursive := true)
FROM ({BALANCES}) b LEFT JOIN (SELECT card_id, source_balance + CASE WHEN card_id % 9 = 0 THEN 1 ELSE 0 END AS s, ledger_balance AS l FROM ({BALANCES}) WHERE transaction_count > 0) x ON x.card_id = b.card_id""",
       "card_id figure left_value right_value verdict")
def cross_check(spark, d):
    b = B.account_balances(transactions(spark, d), accounts(spark, d))
    other = b.filter("transaction_count > 0").withColumn(
        "source_balance", F.col("source_balance") + F.when(F.col("card_id") % 9 == 0, 1).otherwise(0))
    return M.cross_check(b, other, "card_id", ["source_balance", "ledger_balance"])


@query("find_duplicates_of", "Q20", f"""
SELECT transaction_id, signature FROM (SELECT *, {SIGNATURE} AS signature FROM fx_transactions)
WHERE signature IN (SELECT {SIGNATURE} FROM fx_file)""", "transaction_id signature")
def find_duplicates_of(spark, d):
    return M.find_duplicates_of(transactions(spark, d), upload_lines(spark, d)).select("transaction_id", "signature")


SUPPLIERS_SQL = """SELECT s_suppkey AS supplier_id, 'SUPPLIER ' || CAST(s_suppkey % 50 AS VARCHAR) AS name,
  CASE WHEN s_suppkey % 2 = 0 THEN '840' END AS country_code, TIMESTAMP '2020-01-01' + to_days(CAST(100 - s_suppkey % 7 AS INTEGER)) AS created_at FROM supplier"""


def suppliers(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        k.alias("supplier_id"), F.concat(F.lit("SUPPLIER "), (k % 50).cast("string")).alias("name"),
        F.when(k % 2 == 0, "840").alias("country_code"),
        F.date_add(F.lit("2020-01-01").cast("date"), (100 - k % 7).cast("int")).cast("timestamp_ntz").alias("created_at"))


@query("canonical_suppliers", "W7", f"""
SELECT *, first_value(supplier_id) OVER (PARTITION BY name, coalesce(country_code, '') ORDER BY created_at, supplier_id) AS keep_id FROM ({SUPPLIERS_SQL})""",
       "supplier_id name country_code keep_id")
def canonical_suppliers(spark, d):
    return M.canonical_suppliers(suppliers(spark, d)).select("supplier_id", "name", "country_code", "keep_id")


SUPPLIED = "CASE WHEN transaction_id % 11 > 0 THEN 1 + transaction_id % 97 END"


@query("repoint_suppliers", "W7", f"""
SELECT transaction_id, coalesce(keep_id, t.supplier_id) AS supplier_id FROM (SELECT transaction_id, {SUPPLIED} AS supplier_id FROM fx_transactions) t
LEFT JOIN (SELECT supplier_id, first_value(supplier_id) OVER (PARTITION BY name, coalesce(country_code, '') ORDER BY created_at, supplier_id) AS keep_id
  FROM ({SUPPLIERS_SQL})) s ON s.supplier_id = t.supplier_id""", "transaction_id supplier_id")
def repoint_suppliers(spark, d):
    rows = transactions(spark, d).withColumn("supplier_id", F.expr(SUPPLIED))
    return M.repoint_suppliers(rows, suppliers(spark, d)).select("transaction_id", "supplier_id")


NAME_SQL = r"trim(regexp_replace(supplier_raw, '\s\d{3}\s*$', ''))"
CODE_SQL = r"nullif(regexp_extract(supplier_raw, '\s(\d{3})\s*$', 1), '')"


@query("match_suppliers", "J9", f"""
SELECT t.transaction_id, min(s.supplier_id) AS supplier_id FROM (SELECT transaction_id, regexp_replace({NAME_SQL}, '\\s+', ' ', 'g') AS n, {CODE_SQL} AS c FROM fx_transactions) t
LEFT JOIN ({SUPPLIERS_SQL}) s ON s.name = t.n AND s.country_code IS NOT DISTINCT FROM t.c GROUP BY 1""", "transaction_id supplier_id")
def match_suppliers(spark, d):
    s = suppliers(spark, d)
    unique = s.groupBy("name", "country_code").agg(F.min("supplier_id").alias("supplier_id"))
    rows = transactions(spark, d).withColumn("_s", X.split_supplier(F.col("supplier_raw"))) \
        .select("transaction_id", F.col("_s.name").alias("supplier"), F.col("_s.country").alias("supplier_country"))
    return M.match_suppliers(rows, unique).select("transaction_id", "supplier_id")


@query("upsert_suppliers", "J9 J8 X7", f"""
SELECT DISTINCT regexp_replace({NAME_SQL}, '\\s+', ' ', 'g') AS name, {CODE_SQL} AS country_code FROM fx_transactions t WHERE supplier_raw IS NOT NULL
EXCEPT SELECT name, country_code FROM ({SUPPLIERS_SQL})""", "name country_code")
def upsert_suppliers(spark, d):
    wanted = transactions(spark, d).withColumn("_s", X.split_supplier(F.col("supplier_raw"))) \
        .select(F.col("_s.name").alias("supplier"), F.col("_s.country").alias("supplier_country"))
    return M.upsert_suppliers(suppliers(spark, d), wanted)


@query("rows_of_known_suppliers", "J7", """
SELECT DISTINCT t.transaction_id FROM fx_transactions t WHERE t.supplier_raw IN (SELECT 'SUPPLIER ' || CAST(s_suppkey AS VARCHAR) FROM supplier)""", "transaction_id")
def rows_of_known_suppliers(spark, d):
    known = table(spark, d, "supplier").select(F.concat(F.lit("SUPPLIER "), F.col("s_suppkey").cast("string")).alias("supplier_raw"))
    return M.keep_known(transactions(spark, d), known, ["supplier_raw"]).select("transaction_id")


# ------------------------------------------------------------- cell values

def _written(a):
    """An amount as nine different people write it."""
    i = F.col("transaction_id") % 9
    whole, cents = F.floor(a).cast("bigint"), F.lpad((F.round(a * 100).cast("bigint") % 100).cast("string"), 2, "0")
    thousands, rest = F.floor(whole / 1000).cast("string"), F.lpad((whole % 1000).cast("string"), 3, "0")
    join = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    text = a.cast("string")
    return (F.when(i == 0, text).when(i == 1, join("AED ", text)).when(i == 2, join("(", text, ")"))
            .when(i == 3, F.regexp_replace(text, r"\.", ",")).when(i == 4, join("  ", text, " "))
            .when(i == 5, join(F.round(a * 100).cast("bigint").cast("string"), "E-2"))
            .when(i == 6, "n/a").when(i == 7, join(thousands, ".", rest, ",", cents)).otherwise(join(thousands, ",", rest, ".", cents)))


@query("parse_amount", "X1", """
SELECT transaction_id, CASE transaction_id % 9 WHEN 6 THEN NULL WHEN 2 THEN -abs(amount_aed) ELSE abs(amount_aed) END AS amount FROM fx_transactions""",
       "transaction_id $amount")
def parse_amount(spark, d):
    return transactions(spark, d).select("transaction_id", A.parse_amount(_written(F.abs("amount_aed"))).alias("amount"))


def _dated_text(date):
    i = F.col("transaction_id") % 9
    f = lambda p: F.date_format(date, p)
    return (F.when(i == 0, f("yyyy-MM-dd")).when(i == 1, f("dd/MM/yyyy")).when(i == 2, f("MM.dd.yyyy"))
            .when(i == 3, F.datediff(date, F.lit("1899-12-30").cast("date")).cast("string"))
            .when(i == 4, f("d MMM yyyy")).when(i == 5, f("MMMM d, yyyy")).when(i == 6, F.lit("31/02/2001"))
            .when(i == 7, f("yyyy/MM/dd")).otherwise(F.concat(f("yyyy-MM-dd"), F.lit(" 00:00:00"))))


@query("parse_date", "X2 X3", """
SELECT transaction_id, CASE transaction_id % 9 WHEN 6 THEN NULL ELSE txn_date END AS iso,
  transaction_id % 9 IN (1, 2) AND day(txn_date) <= 12 AS ambiguous FROM fx_transactions""", "transaction_id @iso ambiguous")
def parse_date(spark, d):
    read = D.parse_date(_dated_text(F.col("txn_date")), F.col("transaction_id") % 9 != 2)
    return transactions(spark, d).withColumn("_r", read).select(
        "transaction_id", F.col("_r.iso").alias("iso"), F.coalesce("_r.ambiguous", F.lit(False)).alias("ambiguous"))


@query("serial_to_date", "X3", """
SELECT transaction_id, CASE WHEN transaction_id % 2 = 0 THEN DATE '1970-01-01' + CAST(transaction_id % 100 - CASE WHEN transaction_id % 100 > 60 THEN 25569 ELSE 25568 END AS INTEGER)
  ELSE txn_date END AS day FROM (SELECT *, transaction_id % 100 AS n FROM fx_transactions)""".replace("CASE WHEN transaction_id % 2 = 0 THEN DATE", "CASE WHEN transaction_id % 2 = 0 AND n = 0 THEN NULL WHEN transaction_id % 2 = 0 THEN DATE"),
       "transaction_id @day")
def serial_to_date(spark, d):
    i = F.col("transaction_id")
    serial = F.when(i % 2 == 0, (i % 100).cast("double")).otherwise(
        F.datediff("txn_date", F.lit("1899-12-30").cast("date")) + F.lit(0.25))
    return transactions(spark, d).select("transaction_id", D.serial_to_date(serial).alias("day"))


@query("infer_day_first", "X4", """
SELECT card_id AS sheet, NOT (mfirst AND NOT dfirst) AS day_first, dfirst AND mfirst AS conflict, dfirst OR mfirst AS proven FROM (
SELECT card_id, bool_or(style = 0 AND day(txn_date) > 12) AS dfirst, bool_or(style = 1 AND day(txn_date) > 12) AS mfirst
FROM (SELECT *, CASE WHEN card_id % 3 = 0 THEN 0 WHEN card_id % 3 = 1 THEN 1 ELSE transaction_id % 2 END AS style FROM fx_transactions) GROUP BY 1)""",
       "sheet day_first conflict proven")
def infer_day_first(spark, d):
    from ..operators.sheets import infer_day_first as infer
    c = F.col("card_id") % 3
    day_style = (c == 0) | ((c == 2) & (F.col("transaction_id") % 2 == 0))
    rows = transactions(spark, d).select(
        F.col("card_id").alias("sheet"),
        F.when(day_style, F.date_format("txn_date", "dd/MM/yyyy")).otherwise(F.date_format("txn_date", "MM/dd/yyyy")).alias("date_text"))
    return infer(rows, ["sheet"])


@query("repair_transposed", "X5", """
SELECT transaction_id, CASE WHEN due THEN make_date(year(txn_date), day(txn_date), month(txn_date)) ELSE txn_date END AS date, due AS repaired,
  CASE WHEN due THEN 'Excel read the source as month/day; day and month transposed back (' || strftime(txn_date, '%Y-%m-%d') || ' -> '
   || strftime(make_date(year(txn_date), day(txn_date), month(txn_date)), '%Y-%m-%d') || ')' END AS note
FROM (SELECT *, card_id % 2 = 0 AND day(txn_date) <= 12 AS due FROM fx_transactions)""", "transaction_id @date repaired note")
def repair_transposed(spark, d):
    fixed = D.repair_transposed(F.col("txn_date"), F.col("card_id") % 2 == 0)
    return transactions(spark, d).withColumn("_f", fixed).select("transaction_id", "_f.date", "_f.repaired", "_f.note")


@query("parse_currency_cell", "X6", """
SELECT transaction_id, CASE ok5 WHEN 0 THEN 'USD' WHEN 3 THEN 'XYZ' END AS code, CASE ok5 WHEN 0 THEN CAST(original_amount AS DOUBLE) WHEN 3 THEN 500
  WHEN 4 THEN 12.5 END AS amount FROM (SELECT *, (transaction_id // 10) % 5 AS ok5 FROM fx_transactions)""", "transaction_id code amount")
def parse_currency_cell(spark, d):
    raw = F.when(F.floor(F.col("transaction_id") / 10) % 5 == 4, "12.50").otherwise(F.col("currency_raw"))
    return transactions(spark, d).withColumn("_c", A.parse_currency_cell(raw)).select(
        "transaction_id", "_c.code", "_c.amount")


@query("supplier_parts", "X7 X8 X9", f"""
SELECT transaction_id, regexp_replace({NAME_SQL}, '\\s+', ' ', 'g') AS name, {CODE_SQL} AS country, {supplier_key('supplier_raw')} AS skey,
  {voucher("coalesce(supplier_raw, '')")} AS voucher FROM fx_transactions""", "transaction_id name country skey voucher")
def supplier_parts(spark, d):
    raw = F.col("supplier_raw")
    return transactions(spark, d).withColumn("_s", X.split_supplier(raw)).select(
        "transaction_id", "_s.name", "_s.country", X.supplier_key(raw).alias("skey"), X.voucher_of(raw).alias("voucher"))


KINDS_SQL = """SELECT *, CASE transaction_id % 5 WHEN 0 THEN 'purchase' WHEN 1 THEN 'fee' WHEN 2 THEN 'refund' WHEN 3 THEN 'funding' ELSE 'reconciliation_adjustment' END AS kind FROM fx_transactions"""


@query("kinds_and_signs", "X11 X18", f"""
SELECT t.transaction_id, kind, CASE WHEN kind IN ('purchase', 'fee') THEN 'spend' WHEN kind IN ('refund', 'funding') THEN 'funding' END AS way,
  CASE WHEN kind IN ('purchase', 'fee') THEN -abs(amount_aed) WHEN kind IN ('refund', 'funding') THEN abs(amount_aed) ELSE amount_aed END AS effect,
  a.opening_balance + a.balance_sign * CASE WHEN kind IN ('purchase', 'fee') THEN -abs(amount_aed) WHEN kind IN ('refund', 'funding') THEN abs(amount_aed) ELSE amount_aed END AS lands_on
FROM ({KINDS_SQL}) t JOIN fx_accounts a USING (card_id)""", "transaction_id kind way $effect $lands_on")
def kinds_and_signs(spark, d):
    i = F.col("transaction_id") % 5
    kind = (F.when(i == 0, "purchase").when(i == 1, "fee").when(i == 2, "refund").when(i == 3, "funding")
            .otherwise("reconciliation_adjustment"))
    rows = transactions(spark, d).join(accounts(spark, d).select("card_id", "opening_balance", "balance_sign"), "card_id")
    effect = A.signed_effect(kind, F.col("amount_aed"))
    return rows.select("transaction_id", kind.alias("kind"), A.direction_for(kind).alias("way"), effect.alias("effect"),
                       A.project_balance(F.col("opening_balance"), F.col("balance_sign"), effect).alias("lands_on"))


@query("money_in_kind", "X12", """
SELECT transaction_id, CASE transaction_id % 4 WHEN 0 THEN 'refund' WHEN 1 THEN 'refund' ELSE 'funding' END AS kind FROM fx_transactions""", "transaction_id kind")
def money_in_kind(spark, d):
    i = F.col("transaction_id") % 4
    words = (F.when(i == 0, F.concat(F.lit("Refunded by "), F.coalesce("supplier_raw", F.lit(""))))
             .when(i == 1, "CREDIT NOTE 12").when(i == 2, "PAYMENT RECD.-INTERNET BANKING").otherwise("nonrefundable fare"))
    return transactions(spark, d).select("transaction_id", X.money_in_kind(words).alias("kind"))


BLANKED = "SELECT t.* REPLACE (CASE WHEN transaction_id // 10 % 4 = 1 THEN ' ' ELSE req_number END AS req_number) FROM fx_transactions t"


def blanked(spark, d):
    return transactions(spark, d).withColumn(
        "req_number", F.when(F.floor(F.col("transaction_id") / 10) % 4 == 1, " ").otherwise(F.col("req_number")))


@query("bank_charge_reference", "X13", f"""
SELECT transaction_id, CASE WHEN trim(coalesce(req_number, '')) = '' AND a.card_type = 'bank_account' AND starts_with(supplier_raw, 'CHARGES AND FEES')
  THEN 'BAC' ELSE req_number END AS reference FROM ({BLANKED}) t JOIN fx_accounts a USING (card_id)""", "transaction_id reference")
def bank_charge_reference(spark, d):
    rows = blanked(spark, d).join(accounts(spark, d).select("card_id", "card_type"), "card_id")
    return rows.select("transaction_id", X.bank_charge_reference(
        F.col("supplier_raw"), F.col("req_number"), F.col("card_type")).alias("reference"))


_W = {k: v.replace("'", "''") for k, v in K.ACCEPTED.items()}


@query("review_rationale", "X15", f"""
SELECT transaction_id, CASE WHEN status = 'excluded_from_source_balance' THEN '{_W["excluded"]}' WHEN entry_type = 'reconciliation_adjustment' THEN '{_W["adjustment"]}'
  WHEN contains(coalesce(rate_review_note, ''), 'normalized rate') OR contains(coalesce(review_reason, ''), 'rate_denominator_mismatch') THEN '{_W["rate"]}'
  WHEN contains(coalesce(review_reason, ''), 'rate_without_currency') THEN '{_W["no_currency"]}'
  WHEN regexp_matches(coalesce(review_reason, ''), 'currency_unparseable|currency_unrecognised') THEN '{_W["unreadable"]}'
  WHEN contains(coalesce(review_reason, ''), 'rate_formula_unexpected') THEN '{_W["hardcoded"]}' ELSE '{_W["other"]}' END AS rationale FROM fx_transactions""",
       "transaction_id rationale")
def review_rationale(spark, d):
    return transactions(spark, d).select("transaction_id", K.review_rationale().alias("rationale"))


@query("implied_rate", "X16", """
SELECT transaction_id, CASE WHEN original_amount > 0 THEN round(CAST(abs(amount_aed) AS DOUBLE) / CAST(original_amount AS DOUBLE), 10) END AS rate FROM fx_transactions""",
       "transaction_id rate")
def implied_rate(spark, d):
    return transactions(spark, d).select("transaction_id", A.implied_rate(F.col("amount_aed"), F.col("original_amount")).alias("rate"))


@query("edited_text", "X17", """
SELECT transaction_id, CASE transaction_id % 3 WHEN 0 THEN payment_ref WHEN 1 THEN NULL ELSE 'NEW 1' END AS value FROM fx_transactions""", "transaction_id value")
def edited_text(spark, d):
    i = F.col("transaction_id") % 3
    new = F.when(i == 1, "   ").when(i == 2, " NEW 1 ")
    return transactions(spark, d).select("transaction_id", X.edited_text(new, F.col("payment_ref")).alias("value"))


@query("settled_lines", "X19 X20 X21", """
SELECT transaction_id, amount_aed > 0 OR (trim(coalesce(req_number, '')) <> '' AND upper(trim(req_number)) <> 'BAC') AS settled,
  CASE WHEN notes IS NULL THEN '' ELSE 'done ' || CAST((transaction_id // 10) % 7 AS VARCHAR) END AS workflow,
  CASE WHEN trim(coalesce(lpo_number, '')) <> '' THEN trim(lpo_number) WHEN upper(trim(req_number)) = 'BAC' THEN trim(req_number) END AS reference,
  CASE WHEN trim(coalesce(req_number, '')) <> '' AND upper(trim(req_number)) <> 'BAC' THEN trim(req_number) END AS note FROM fx_transactions""",
       "transaction_id settled workflow reference note")
def settled_lines(spark, d):
    return transactions(spark, d).withColumn("_r", X.reference_from(F.col("lpo_number"), F.col("req_number"))).select(
        "transaction_id", X.is_settled_line(F.col("amount_aed"), F.col("req_number")).alias("settled"),
        X.workflow_note(F.col("notes")).alias("workflow"), "_r.reference", "_r.note")


@query("round_to_minor_units", "X22", """
SELECT transaction_id, CASE currency WHEN 'JPY' THEN round(original_amount, 0) ELSE round(original_amount, 2) END AS amount FROM fx_transactions""", "transaction_id $amount")
def round_to_minor_units(spark, d):
    return transactions(spark, d).select(
        "transaction_id", A.round_to_minor_units(F.col("original_amount"), F.col("currency")).alias("amount"))


@query("change_set", "X25", """
SELECT transaction_id, unnest(list_filter([
  CASE WHEN transaction_id % 3 = 0 AND currency IS DISTINCT FROM 'USD' THEN {'field': 'currency', 'was': currency, 'became': 'USD'} END,
  CASE WHEN transaction_id % 4 = 0 AND payment_ref IS NOT NULL THEN {'field': 'payment_ref', 'was': payment_ref, 'became': NULL} END], lambda x: x IS NOT NULL), recursive := true)
FROM fx_transactions""", "transaction_id field was became")
def change_set(spark, d):
    i = F.col("transaction_id")
    changes = K.change_set({
        "currency": (F.col("currency"), F.when(i % 3 == 0, "USD").otherwise(F.col("currency"))),
        "payment_ref": (F.col("payment_ref"), F.when(i % 4 != 0, F.col("payment_ref")))})
    return transactions(spark, d).select("transaction_id", F.explode(changes).alias("field", "v")) \
        .select("transaction_id", "field", F.col("v.from").alias("was"), F.col("v.to").alias("became"))
