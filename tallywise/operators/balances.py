"""Balances and totals per account, currency, month and period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import month_key
from ..functions.text import is_blank
from ..plans.scan import Measure, running_sum, scan, walk
from ..schema import ADJUSTMENT, MONEY, MONEY_SUM, SOURCE, TOLERANCE
from .filters import supplier_name, with_account

def _live() -> Column:
    return F.col("status") != "voided"


def _sum_if(cond: Column, value: str = "amount_aed") -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col(value))), F.lit(0)).cast(MONEY_SUM)


def _zero(col: str) -> Column:
    return F.coalesce(F.sum(col), F.lit(0))


def daily_movements(txn: DataFrame) -> DataFrame:
    """One row per account and day.

    Folding by day before anything is joined keeps a crowded account down to
    as many rows as it has days, and the sums are combined on the map side.
    """
    live = _live()
    return txn.groupBy("card_id", "txn_date").agg(
        _sum_if(live & F.col("included_in_source_balance")).alias("included"),
        _sum_if(live & (F.col("entry_type") == SOURCE)).alias("ledger"),
        _sum_if(live & (F.col("entry_type") == ADJUSTMENT)).alias("adjusted"),
        _sum_if(live & (F.col("direction") == "spend")).alias("spend"),
        _sum_if(live & (F.col("direction") == "funding")).alias("funding"),
        F.count_if(live & (F.col("entry_type") == ADJUSTMENT)).alias("n_adjusted"),
        F.count_if(live & (F.col("entry_type") == SOURCE)).alias("n_rows"),
        F.count_if(F.col("status") == "needs_review").alias("n_review"),
        F.count_if(F.col("status") == "excluded_from_source_balance").alias("n_excluded"),
        F.count_if(live).alias("n_live"),
    )


def account_balances(txn: DataFrame, acct: DataFrame) -> DataFrame:
    """Every account's balances, totals and counts; accounts without rows are kept.

    The amount keeps its economic sign.  Only the three balances follow the
    account's ``balance_sign``.
    """
    opened = F.col("opening_date").isNull() | (F.col("txn_date") >= F.col("opening_date"))
    facts = ["card_id", "card_name", "settlement_currency", "opening_balance", "opening_date",
             "balance_sign", "tracks_balance"]
    days = daily_movements(txn).join(acct.select("card_id", "opening_date"), "card_id").filter(opened)
    dated = F.when(F.col("n_live") > 0, F.col("txn_date"))
    per_account = days.groupBy("card_id").agg(
        *[F.sum(c).alias(c) for c in ("included", "ledger", "adjusted", "spend", "funding",
                                      "n_adjusted", "n_rows", "n_review", "n_excluded")],
        F.min(dated).alias("first_transaction"), F.max(dated).alias("last_transaction"))
    whole = acct.select(*facts).join(per_account, "card_id", "left")
    z = lambda c: F.coalesce(c, F.lit(0))
    sign = F.col("balance_sign")
    money = lambda c: c.cast(MONEY_SUM)
    return whole.select(
        *facts,
        money(F.col("opening_balance") + sign * z("included")).alias("source_balance"),
        money(F.col("opening_balance") + sign * z("ledger")).alias("ledger_balance"),
        money(sign * (z("included") - z("ledger"))).alias("reconciliation_difference"),
        money(z("adjusted")).alias("review_adjustments_total"),
        z("n_adjusted").alias("review_adjustments_count"),
        money(z("spend")).alias("total_spend"), money(z("funding")).alias("total_funding"),
        z("n_rows").alias("transaction_count"), z("n_review").alias("needs_review_count"),
        z("n_excluded").alias("excluded_count"), "first_transaction", "last_transaction")


def spend_by_currency(txn: DataFrame, acct: DataFrame) -> DataFrame:
    """Spend per account and original currency; amounts never cross a currency."""
    spend = txn.filter(_live() & (F.col("direction") == "spend") & (F.col("entry_type") == SOURCE)
                       & F.col("currency").isNotNull())
    days = spend.groupBy("card_id", "currency", "txn_date").agg(
        F.count(F.lit(1)).alias("n"), F.sum("original_amount").alias("original"),
        F.sum("amount_aed").alias("settled"), F.min("exchange_rate").alias("lo"),
        F.max("exchange_rate").alias("hi"))
    opened = F.col("opening_date").isNull() | (F.col("txn_date") >= F.col("opening_date"))
    kept = days.join(acct.select("card_id", "card_name", "opening_date"), "card_id").filter(opened)
    return kept.groupBy("card_id", "card_name", "currency").agg(
        F.sum("n").alias("transaction_count"),
        F.sum("original").cast("decimal(28,4)").alias("total_original_amount"),
        F.sum("settled").cast(MONEY_SUM).alias("total_settled_aed"),
        F.min("lo").alias("min_rate"), F.max("hi").alias("max_rate"))


def spend_by_currency_overall(per_account: DataFrame, acct: DataFrame, settlement: str) -> DataFrame:
    """Merged over the accounts of one settlement currency, busiest first."""
    same = acct.filter(F.col("settlement_currency") == settlement).select("card_id")
    return per_account.join(same, "card_id", "left_semi").groupBy("currency").agg(
        F.sum("transaction_count").alias("transaction_count"),
        F.sum("total_original_amount").cast("decimal(28,4)").alias("total_original_amount"),
        F.sum("total_settled_aed").cast(MONEY_SUM).alias("total_settled_aed"),
    ).orderBy(F.desc("transaction_count"), "currency")


def ledger_totals(balances: DataFrame) -> DataFrame:
    """Balances per settlement currency, of accounts that keep one."""
    return balances.filter("tracks_balance").groupBy("settlement_currency").agg(
        F.sum("ledger_balance").cast(MONEY_SUM).alias("live_balance"),
        F.sum("source_balance").cast(MONEY_SUM).alias("source_balance"),
        F.sum("reconciliation_difference").cast(MONEY_SUM).alias("reconciliation_difference"),
        F.count(F.lit(1)).alias("card_count"),
    ).orderBy(F.desc("card_count"), "settlement_currency")


def ledger_counts(balances: DataFrame) -> DataFrame:
    """Counts over every account: a row is a row whatever it settled in."""
    return balances.agg(
        F.count(F.lit(1)).alias("card_count"), _zero("transaction_count").alias("transaction_count"),
        _zero("needs_review_count").alias("needs_review"), _zero("excluded_count").alias("excluded"),
        F.count_if(differs()).alias("cards_with_difference"))


def differs() -> Column:
    return F.col("tracks_balance") & (F.abs("reconciliation_difference") > F.lit(TOLERANCE).cast("decimal(4,3)"))


def accounts_with_difference(balances: DataFrame) -> DataFrame:
    return balances.filter(differs())


def negative_accounts(balances: DataFrame) -> DataFrame:
    return balances.filter(F.col("ledger_balance") < 0)


def _settling_in(txn: DataFrame, acct: DataFrame, currency: str) -> DataFrame:
    return txn.join(acct.filter(F.col("settlement_currency") == currency).select("card_id"),
                    "card_id", "left_semi")


def activity_by_month(txn: DataFrame, acct: DataFrame, n: int = 6, currency: str = "AED",
                      include_voided: bool = False) -> DataFrame:
    """Spend and funding per month, newest first; the two are never netted."""
    rows = txn.filter((F.col("entry_type") == SOURCE) & F.col("txn_date").isNotNull())
    if not include_voided:
        rows = rows.filter(_live())
    return (_settling_in(rows, acct, currency).groupBy(month_key(F.col("txn_date")).alias("month"))
            .agg(_sum_if(F.col("direction") == "spend").alias("spend"),
                 _sum_if(F.col("direction") == "funding").alias("funding"))
            .orderBy(F.desc("month")).limit(n))


def top_suppliers(txn: DataFrame, acct: DataFrame, n: int = 8, currency: str = "AED",
                  include_voided: bool = False) -> DataFrame:
    """Where the money went, largest spend first."""
    rows = txn.filter((F.col("direction") == "spend") & ~is_blank(F.col("supplier_raw")))
    if not include_voided:
        rows = rows.filter(_live())
    return (_settling_in(rows, acct, currency).groupBy(supplier_name().alias("supplier"))
            .agg(F.count(F.lit(1)).alias("row_count"), F.sum("amount_aed").cast(MONEY_SUM).alias("settled"))
            .orderBy("settled", "supplier").limit(n))


def _result_columns() -> list[Column]:
    live, source = _live(), F.col("entry_type") != ADJUSTMENT
    out, back = F.col("amount_aed") < 0, F.col("amount_aed") > 0
    spent, received = _sum_if(live & source & out), _sum_if(live & source & back)
    return [
        (-spent).cast(MONEY_SUM).alias("spent"), received.alias("received"),
        (-spent - received).cast(MONEY_SUM).alias("net"), F.count_if(live).alias("row_count"),
        F.count_if(live & source & out).alias("spend_rows"),
        F.count_if(live & source & back).alias("received_rows"),
        _sum_if(live & ~source).alias("adjustments"), F.count_if(live & ~source).alias("adjustment_rows")]


def result_totals(txn: DataFrame, acct: DataFrame) -> DataFrame:
    """What a set of rows comes to, one line per settlement currency.

    Rows are folded per account first, so the join to the accounts carries one
    row per account.
    """
    folded = txn.groupBy("card_id").agg(*_result_columns())
    names = ["spent", "received", "net", "row_count", "spend_rows", "received_rows",
             "adjustments", "adjustment_rows"]
    money = {"spent", "received", "net", "adjustments"}
    return with_account(folded, acct, "settlement_currency").groupBy("settlement_currency").agg(
        *[(F.sum(c).cast(MONEY_SUM) if c in money else F.sum(c)).alias(c) for c in names])


def result_totals_by_currency(txn: DataFrame) -> DataFrame:
    """Original amounts netted inside each currency, largest first."""
    rows = txn.filter(_live() & (F.col("entry_type") != ADJUSTMENT)
                      & F.col("currency").isNotNull() & (F.coalesce("original_amount", F.lit(0)) != 0))
    signed = F.abs("original_amount") * F.when(F.col("amount_aed") < 0, 1).otherwise(-1)
    return rows.groupBy("currency").agg(
        F.sum(signed).cast("decimal(28,4)").alias("amount"), F.count(F.lit(1)).alias("row_count"),
    ).orderBy(F.desc(F.abs("amount")), "currency")


def settlement_currencies(txn: DataFrame, acct: DataFrame) -> DataFrame:
    """The settlement currencies of a result; one total only where there is one."""
    cards = txn.filter(_live()).select("card_id").distinct()
    found = with_account(cards, acct, "settlement_currency").select("settlement_currency").distinct()
    # A handful of codes: the window runs over distinct currencies only.
    from pyspark.sql import Window
    return found.withColumn("single_total", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))) == 1)


def totals_by_reference(txn: DataFrame, acct: DataFrame) -> DataFrame:
    """What a booking cost in the end: paid, returned and net per request number."""
    rows = txn.filter(~is_blank(F.col("req_number")))
    folded = rows.groupBy("card_id", F.upper(F.trim("req_number")).alias("reference")).agg(*_result_columns())
    names = ["spent", "received", "net", "row_count", "spend_rows", "received_rows",
             "adjustments", "adjustment_rows"]
    money = {"spent", "received", "net", "adjustments"}
    return with_account(folded, acct, "settlement_currency").groupBy("reference", "settlement_currency").agg(
        *[(F.sum(c).cast(MONEY_SUM) if c in money else F.sum(c)).alias(c) for c in names])


def bank_period(txn: DataFrame, acct: DataFrame, date_from: str, date_to: str) -> DataFrame:
    """Opening, paid out, came in, closing, and whether the bank printed that closing.

    ``bank_agrees`` is null where the last day carries no printed balance.
    """
    lo, hi = F.lit(date_from).cast("date"), F.lit(date_to).cast("date")
    day = F.col("txn_date")
    rows = txn.filter(_live() & (day <= hi))
    days = rows.groupBy("card_id", "txn_date").agg(
        _sum_if(F.col("amount_aed") < 0).alias("out"), _sum_if(F.col("amount_aed") >= 0).alias("inn"))
    sums = days.groupBy("card_id").agg(
        F.sum(F.when(day < lo, F.col("out") + F.col("inn"))).alias("before"),
        F.sum(F.when(day >= lo, -F.col("out"))).alias("paid_out"),
        F.sum(F.when(day >= lo, F.col("inn"))).alias("came_in"),
        F.max(F.when(day >= lo, day)).alias("last_day"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    base = acct.select("card_id", "card_name", "opening_balance").join(sums, "card_id", "left").select(
        "card_id", "card_name", (F.col("opening_balance") + z("before")).cast(MONEY_SUM).alias("opening"),
        z("paid_out").cast(MONEY_SUM).alias("paid_out"), z("came_in").cast(MONEY_SUM).alias("came_in"), "last_day")
    base = base.withColumn("closing", (F.col("opening") - F.col("paid_out") + F.col("came_in")).cast(MONEY_SUM))
    # Only the balances printed on the last day are compared, and only distinct ones.
    printed = rows.filter((day >= lo) & F.col("statement_balance").isNotNull()) \
        .select("card_id", F.col("txn_date").alias("last_day"), "statement_balance").distinct()
    agreed = base.select("card_id", "last_day", "closing").join(printed, ["card_id", "last_day"]) \
        .groupBy("card_id").agg(F.bool_or(
            F.abs(F.col("statement_balance") - F.col("closing")) < F.lit(TOLERANCE).cast("decimal(4,3)"))
            .alias("bank_agrees"))
    return base.join(agreed, "card_id", "left")


def bank_months(txn: DataFrame, acct: DataFrame) -> DataFrame:
    """Every account month by month; each opening is the closing before it.

    Months are summed first, so the running sum walks months, not rows.
    """
    rows = txn.filter(_live() & F.col("txn_date").isNotNull())
    months = rows.groupBy("card_id", month_key(F.col("txn_date")).alias("month")).agg(
        (-_sum_if(F.col("amount_aed") < 0)).cast(MONEY_SUM).alias("paid_out"),
        _sum_if(F.col("amount_aed") >= 0).alias("came_in"), F.count(F.lit(1)).alias("row_count"),
        F.max("txn_date").alias("last_day"))
    moved = walk(months, ["card_id"], ["month"],
                 [running_sum("moved", F.col("came_in") - F.col("paid_out"))])
    named = with_account(moved, acct, "card_name", "settlement_currency", "opening_balance")
    return named.select(
        "card_id", "card_name", "settlement_currency", "month",
        (F.col("opening_balance") + F.col("moved") - F.col("came_in") + F.col("paid_out")).cast(MONEY_SUM).alias("opening"),
        "paid_out", "came_in", (F.col("opening_balance") + F.col("moved")).cast(MONEY_SUM).alias("closing"),
        "row_count", "last_day")


def extraction_summary(txn: DataFrame, opening: DataFrame) -> DataFrame:
    """Balances and counts of a freshly read sheet, before it is stored.

    ``opening`` holds ``card_id, opening_balance``.
    """
    live = _live()
    sums = txn.groupBy("card_id").agg(
        _sum_if(live & F.col("included_in_source_balance")).alias("included"),
        _sum_if(live & (F.col("entry_type") == SOURCE)).alias("ledger"),
        _sum_if(live & (F.col("direction") == "spend")).alias("total_spend"),
        _sum_if(live & (F.col("direction") == "funding")).alias("total_funding"),
        _sum_if(live & (F.col("entry_type") == ADJUSTMENT)).alias("review_adjustments_total"),
        F.count_if(F.col("status") == "needs_review").alias("needs_review"),
        F.count_if(F.col("status") == "excluded_from_source_balance").alias("excluded"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast(MONEY_SUM)
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    start = F.coalesce("opening_balance", F.lit(0))
    return opening.select("card_id", "opening_balance").join(sums, "card_id", "left").select(
        "card_id", start.cast(MONEY_SUM).alias("opening_balance"),
        (start + z("included")).cast(MONEY_SUM).alias("source_balance"),
        (start + z("ledger")).cast(MONEY_SUM).alias("ledger_balance"),
        (z("included") - z("ledger")).cast(MONEY_SUM).alias("reconciliation_difference"),
        z("total_spend").alias("total_spend"), z("total_funding").alias("total_funding"),
        z("review_adjustments_total").alias("review_adjustments_total"), n("needs_review"), n("excluded"))


def running_balance(txn: DataFrame, acct: DataFrame, order=("txn_date", "transaction_id"),
                    use_sign: bool = False) -> DataFrame:
    """The balance after every line, in the given order.

    No task walks a crowded account: it is cut into ranges of the order.
    """
    step = F.col("amount_aed") * F.col("balance_sign") if use_sign else F.col("amount_aed")
    columns = ("opening_balance", "balance_sign") if use_sign else ("opening_balance",)
    rows = with_account(txn, acct, *columns)
    moved = scan(rows, ["card_id"], list(order), [running_sum("_moved", step)])
    return moved.withColumn("running_balance", (F.col("opening_balance") + F.col("_moved")).cast(MONEY_SUM)) \
        .drop("_moved", *columns)


def balance_history(txn: DataFrame, acct: DataFrame, include_voided: bool = False) -> DataFrame:
    """Points of a balance chart: dated source transactions, oldest first."""
    rows = txn.filter((F.col("entry_type") == SOURCE) & F.col("txn_date").isNotNull())
    if not include_voided:
        rows = rows.filter(_live())
    return running_balance(rows.select("card_id", "txn_date", "transaction_id", "amount_aed"), acct).select(
        "card_id", "transaction_id", "txn_date", F.col("running_balance").cast(MONEY_SUM).alias("balance"))


def month_continuity(months: DataFrame) -> DataFrame:
    """Months that do not open where the one before closed."""
    linked = walk(months, ["card_id"], ["month"],
                  [Measure("closed_before", "prev", F.col("closing"), MONEY_SUM)])
    return linked.filter(F.abs(F.col("opening") - F.col("closed_before")) > F.lit(TOLERANCE).cast("decimal(4,3)"))


def as_money(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast(MONEY) for n in names})
