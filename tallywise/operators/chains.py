"""The order a bank printed its lines in, and what its printed balances prove.

O3, W3, W4, W6, W9, W12, Q7, Q10, Q11, Q14, I17, I18.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import month_key, swapped
from ..functions.text import is_blank
from ..plans.scan import Measure, cut_lineage, numbered, place, running_sum, scan, unplaced, walk
from ..schema import MONEY, MONEY_SUM, TOLERANCE
from .filters import with_account

def near(a: Column, b: Column) -> Column:
    """Same figure to within half a cent; false where either is missing."""
    return F.coalesce(F.abs(a - b) < F.lit(TOLERANCE).cast("decimal(4,3)"), F.lit(False))


def sheet_direction(printed: DataFrame) -> DataFrame:
    """Per account and sheet: forward, or backward where more balances chain that way."""
    chained = scan(
        printed, ["card_id", "_sheet"], ["_row", "transaction_id"],
        [Measure("_above", "prev", F.col("statement_balance"), MONEY),
         Measure("_below", "next", F.col("statement_balance"), MONEY)])
    balance, amount = F.col("statement_balance"), F.col("amount_aed")
    return chained.groupBy("card_id", "_sheet").agg(
        F.count_if(near(balance, F.col("_above") + amount)).alias("forward"),
        F.count_if(near(balance, F.col("_below") + amount)).alias("backward"),
        F.min("txn_date").alias("earliest"))


def _sheeted(txn: DataFrame) -> DataFrame:
    return txn.withColumns({"_sheet": F.coalesce("source_sheet", F.lit("")),
                            "_row": F.coalesce(F.col("source_row").cast("bigint"), F.lit(0).cast("bigint"))})


PLACE = "struct<earliest:date,sheet:string,line:bigint,id:bigint>"


LINE = ["card_id", "transaction_id", "txn_date", "amount_aed", "statement_balance"]


def bank_order(txn: DataFrame) -> DataFrame:
    """Number each account's lines as the bank printed them (``line_no``).

    Each sheet runs in the direction its own arithmetic holds; sheets follow
    the earliest day they cover.  A line without a printed balance goes behind
    the last placed line dated on or before it.
    """
    return txn.join(_lined(txn).select("transaction_id", "line_no"), "transaction_id").select(*txn.columns, "line_no")


def _lined(txn: DataFrame) -> DataFrame:
    """``LINE`` and ``line_no``, with the columns of ``place`` for scans along ``line_no``.

    Lines are put into three orders, so only what the orders need is carried; that is
    written first, since every scan reads its input three times.
    """
    rows = cut_lineage(_sheeted(txn).select(*LINE, "_sheet", "_row"))
    has = F.col("statement_balance").isNotNull()
    votes = sheet_direction(rows.filter(has))
    way = F.when(F.col("backward") > F.col("forward"), -1).otherwise(1)
    voted = rows.join(votes.select("card_id", "_sheet", way.alias("_way"), "earliest"), ["card_id", "_sheet"], "left")
    both = voted.withColumn("_place", F.when(has, F.struct(
        F.col("earliest"), F.col("_sheet").alias("sheet"), (F.col("_way") * F.col("_row")).alias("line"),
        (F.col("_way") * F.col("transaction_id")).alias("id")).cast(PLACE))) \
        .select(*LINE, "_place", F.col("_place").isNull().alias("_loose"))
    anchored = cut_lineage(scan(both, ["card_id"], ["txn_date", "_loose", "transaction_id"],
                                [Measure("_anchor", "max", F.col("_place"), PLACE)]))
    at = F.coalesce("_place", "_anchor")
    order = [at["earliest"], at["sheet"], at["line"], at["id"], F.col("_loose"), F.when(F.col("_loose"), F.col("txn_date")),
             F.col("transaction_id")]
    return numbered(place(anchored, ["card_id"], order), ["card_id"], order, "line_no").drop("_place", "_anchor", "_loose")


def in_bank_order(txn: DataFrame, acct: DataFrame) -> DataFrame:
    """Bank-ordered lines with the ledger's own running balance beside each."""
    run = scan(_lined(txn), ["card_id"], ["line_no"], [running_sum("_moved", F.col("amount_aed"))])
    rows = with_account(txn.join(run.select("transaction_id", "line_no", "_moved"), "transaction_id"), acct, "opening_balance")
    return rows.withColumn("running_balance", (F.col("opening_balance") + F.col("_moved")).cast(MONEY_SUM)) \
        .select(*txn.columns, "line_no", "opening_balance", "running_balance")


def _chain(txn: DataFrame, acct: DataFrame) -> DataFrame:
    """Every printed line against the running total of the printed lines."""
    printed = _lined(txn).filter(F.col("statement_balance").isNotNull())
    run = unplaced(scan(printed, ["card_id"], ["line_no"], [running_sum("_moved", F.col("amount_aed"))]))
    total = (F.col("opening_balance") + F.col("_moved")).cast(MONEY_SUM)
    return with_account(run, acct, "opening_balance").withColumn("running_balance", total) \
        .withColumn("agrees", near(F.col("running_balance"), F.col("statement_balance"))).drop("_moved", "opening_balance")


def chain_lines(txn: DataFrame, acct: DataFrame) -> DataFrame:
    """Every printed balance against the running total of the printed lines."""
    figures = ["line_no", "running_balance", "agrees"]
    return txn.join(_chain(txn, acct).select("transaction_id", *figures), "transaction_id").select(*txn.columns, *figures)


def chain_check(txn: DataFrame, acct: DataFrame) -> DataFrame:
    """Per account: lines walked, lines agreeing, and the first break."""
    lines = _chain(txn, acct)
    broken = F.when(~F.col("agrees"), F.col("line_no"))
    return lines.groupBy("card_id").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if("agrees").alias("agreed"),
        F.min(broken).alias("first_break_line"), F.min_by("txn_date", broken).alias("first_break_date"),
        F.min_by("running_balance", broken).alias("ledger_says"),
        F.min_by("statement_balance", broken).alias("bank_says"))


def chain_breaks_resync(rows: DataFrame, opening: DataFrame, order: Sequence[str], blocks: Sequence[Column] = (),
                        keys: Sequence[str] = ("card_id",)) -> DataFrame:
    """Printed balances checked from the figure printed before them.

    One mistake is one finding: after a break the printed figure is taken over.
    A ``reseed_balance`` is taken over without being checked.  Rows without an
    amount, or outside the sheet's own balance, are not part of the chain.
    Returns every printed or reseeded row with ``computed``, ``printed``,
    ``delta`` and ``kind`` (``ok``, ``mismatch``, ``reseed``).  ``blocks``, which once
    cut crowded keys, changes nothing: scans find their own cuts.
    """
    keys = list(keys)
    if "reseed_balance" not in rows.columns:
        rows = rows.withColumn("reseed_balance", F.lit(None).cast(MONEY))
    counted = rows.filter(F.col("amount_aed").isNotNull() & F.col("included_in_source_balance"))
    counted = counted.join(opening.select(*keys, F.col("opening_balance").alias("_opening")), keys)
    printed = F.coalesce("reseed_balance", "statement_balance")
    walked = scan(place(counted, keys, list(order)), keys, list(order), [running_sum("_moved", F.col("amount_aed"))])
    # Printed figure minus everything moved so far: constant while the chain holds.
    walked = walked.filter(printed.isNotNull()).withColumn("_level", (printed - F.col("_moved")).cast(MONEY_SUM))
    based = unplaced(scan(walked, keys, list(order), [Measure("_base", "prev", F.col("_level"), MONEY_SUM)]))
    computed = (F.coalesce("_base", "_opening") + F.col("_moved")).cast(MONEY_SUM)
    return based.withColumns({
        "computed": computed, "printed": printed.cast(MONEY_SUM), "delta": (computed - printed).cast(MONEY_SUM),
        "kind": F.when(F.col("reseed_balance").isNotNull(), "reseed")
        .when(F.abs(computed - printed) > F.lit(TOLERANCE).cast("decimal(4,3)"), "mismatch").otherwise("ok"),
    }).drop("_moved", "_level", "_base", "_opening")


def sheet_starts(txn: DataFrame) -> DataFrame:
    """The first day of each sheet, beside every row: what orders the sheets."""
    starts = txn.groupBy("card_id", "source_sheet").agg(F.min("txn_date").alias("sheet_start"))
    same = [txn["card_id"] == starts["card_id"], txn["source_sheet"].eqNullSafe(starts["source_sheet"])]
    return txn.join(starts, same, "left").drop(starts["card_id"]).drop(starts["source_sheet"])


def balance_voting(lines: DataFrame) -> DataFrame:
    """Which money column lowers the balance, by each sheet's own arithmetic.

    ``lines`` holds ``file, sheet, row, debit, credit, balance``.  Each pair of
    neighbours votes in both reading orders.  ``lowers`` is ``debit`` or
    ``credit``, or null where fewer than three pairs agree or the other reading
    holds on half as many or more.
    """
    num = "decimal(28,4)"
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast(num)
    rows = lines.filter(F.col("balance").isNotNull()).select(
        "file", "sheet", "row", z("debit").alias("d"), z("credit").alias("c"), F.col("balance").cast(num).alias("b"))
    line = F.struct("d", "c", "b")
    paired = scan(rows, ["file", "sheet"], ["row"],
                  [Measure("p", "prev", line, f"struct<d:{num},c:{num},b:{num}>")])
    paired = paired.filter(F.col("p").isNotNull())
    p = lambda x: F.col("p")[x]
    d, c, b = F.col("d"), F.col("c"), F.col("b")
    down = (d != 0) | (c != 0)
    up = (p("d") != 0) | (p("c") != 0)
    down_debit = down & near(b, p("b") - d + c)
    down_credit = down & ~near(b, p("b") - d + c) & near(b, p("b") + d - c)
    up_debit = up & near(p("b"), b - p("d") + p("c"))
    up_credit = up & ~near(p("b"), b - p("d") + p("c")) & near(p("b"), b + p("d") - p("c"))
    votes = paired.groupBy("file", "sheet").agg(
        (F.count_if(down_debit) + F.count_if(up_debit)).alias("debit_lowers"),
        (F.count_if(down_credit) + F.count_if(up_credit)).alias("credit_lowers"))
    held, other = F.greatest("debit_lowers", "credit_lowers"), F.least("debit_lowers", "credit_lowers")
    return votes.withColumn("lowers", F.when((held >= 3) & (held > other * 2),
                                             F.when(F.col("debit_lowers") > F.col("credit_lowers"), "debit")
                                             .otherwise("credit")))


def bracket_dates(rows: DataFrame) -> DataFrame:
    """Nearest certain date above and below every row of a sheet.

    ``rows`` holds ``file, sheet, row, date, certain``.
    """
    sure = F.when(F.col("certain"), F.col("date"))
    return scan(rows, ["file", "sheet"], ["row"],
                [Measure("date_before", "prev", sure, "date"), Measure("date_after", "next", sure, "date")])


def date_audit(rows: DataFrame) -> DataFrame:
    """Per sheet: do the ambiguous dates read as written, or transposed?

    ``rows`` holds ``file, sheet, row, date, kind`` with kind ``datetime`` or
    ``text``; a date cell whose day is 12 or less is ambiguous.
    """
    day = F.dayofmonth("date")
    rows = rows.filter(F.col("date").isNotNull()).withColumn(
        "certain", (F.col("kind") == "text") | (day > 12))
    seen = bracket_dates(rows)

    def fits(x: Column) -> Column:
        return (x.isNotNull() & (F.col("date_before").isNull() | (x >= F.col("date_before")))
                & (F.col("date_after").isNull() | (x <= F.col("date_after"))))

    as_is, turned = fits(F.col("date")), fits(swapped(F.col("date")))
    open_ = ~F.col("certain")
    sheets = seen.groupBy("file", "sheet").agg(
        F.count_if(F.col("kind") == "datetime").alias("datetimes"), F.count_if(F.col("kind") == "text").alias("texts"),
        F.count_if(open_).alias("ambiguous"), F.count_if(open_ & as_is & ~turned).alias("fits_as_is"),
        F.count_if(open_ & turned & ~as_is).alias("fits_swapped"),
        F.count_if(open_ & (as_is == turned)).alias("fits_neither"))
    return sheets.withColumn(
        "verdict", F.when((F.col("fits_swapped") > 0) & (F.col("fits_as_is") == 0), "transposed")
        .when((F.col("fits_as_is") > 0) & (F.col("fits_swapped") == 0), "as_written")
        .when(F.col("ambiguous") == 0, "none").otherwise("mixed"))


def _last_stated() -> Column:
    return F.when(F.col("statement_balance").isNotNull() & F.col("txn_date").isNotNull(),
                  F.struct("txn_date", "source_row", "created_at", "transaction_id"))


def latest_stated(txn: DataFrame) -> DataFrame:
    """The last line of each account that carries a printed balance.

    One aggregate with a partial step: no account is ever sorted.
    """
    facts = F.struct("transaction_id", "txn_date", "amount_aed", "statement_balance", "supplier_raw")
    live = txn.filter("status <> 'voided'")
    return live.groupBy("card_id").agg(
        F.max_by(facts, _last_stated()).alias("_l"),
        F.count_if(F.col("statement_balance").isNull()).alias("rows_without_a_stated_balance")) \
        .filter(F.col("_l").isNotNull()).select("card_id", "_l.*", "rows_without_a_stated_balance")


def bank_daily_check(txn: DataFrame, acct: DataFrame, balances: DataFrame, order: str = "source_row") -> DataFrame:
    """What the bank last printed against what the ledger holds.

    ``order='source_row'`` takes the highest row number of the last day;
    ``'bank'`` the line the bank really printed last.
    """
    if order == "bank":
        lined = bank_order(txn.filter("status <> 'voided'"))
        lined = lined.withColumns({"source_row": F.col("line_no"), "status": F.lit("confirmed")})
        last = latest_stated(lined)
    else:
        last = latest_stated(txn)
    named = last.join(acct.select("card_id", "card_name", "settlement_currency"), "card_id")
    return named.join(balances.select("card_id", "ledger_balance"), "card_id").select(
        "card_id", F.col("card_name").alias("account"), F.col("settlement_currency").alias("currency"),
        F.col("txn_date").alias("last_transaction_date"),
        F.coalesce("supplier_raw", F.lit("")).alias("last_transaction"),
        F.col("amount_aed").alias("last_amount"), F.col("statement_balance").alias("bank_says"),
        F.col("ledger_balance").alias("ledger_says"),
        F.round(F.col("statement_balance") - F.col("ledger_balance"), 2).cast(MONEY_SUM).alias("difference"),
        "rows_without_a_stated_balance")


def account_chain_audit(txn: DataFrame, acct: DataFrame) -> DataFrame:
    """The whole bank audit: chain, last printed against balance now, open requests."""
    live = txn.filter("status <> 'voided'")
    lines = _chain(live, acct)
    chain = lines.groupBy("card_id").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if("agrees").alias("agreed"),
        F.max_by("statement_balance", "line_no").alias("last_printed"))
    out = F.col("amount_aed") < 0
    open_ = out & is_blank(F.col("req_number"))
    rows = live.groupBy("card_id").agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if(out).alias("payments_out"),
        F.count_if(~out).alias("payments_in"), F.count_if(open_).alias("missing_request"),
        F.coalesce(F.sum(F.when(open_, -F.col("amount_aed"))), F.lit(0)).cast(MONEY_SUM).alias("missing_value"),
        F.sum("amount_aed").cast(MONEY_SUM).alias("moved"))
    joined = with_account(rows.join(chain, "card_id", "left"), acct, "card_name", "settlement_currency", "opening_balance")
    now = (F.col("opening_balance") + F.col("moved")).cast(MONEY_SUM)
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return joined.select(
        "card_id", "card_name", "settlement_currency", "row_count",
        (F.col("row_count") - n("lines")).alias("unprinted"), n("lines").alias("lines"), n("agreed").alias("agreed"),
        "last_printed", now.alias("balance_now"),
        F.when(F.col("last_printed").isNotNull(), near(now, F.col("last_printed"))).alias("ends_on_printed"),
        "payments_out", "payments_in", "missing_request", "missing_value")


def statement_reconciliation(txn: DataFrame, acct: DataFrame, statements: DataFrame) -> DataFrame:
    """The ledger as at each statement's last day against the closing it prints.

    ``statements`` holds ``card_id, last_day, closing, rows_stated, rows_read``.
    Also counts identical groups on the account, which an import must not add to.
    """
    live = txn.filter("status <> 'voided'")
    days = live.groupBy("card_id", "txn_date").agg(F.sum("amount_aed").cast(MONEY_SUM).alias("moved"))
    upto = days.join(statements.select("card_id", "last_day"), "card_id") \
        .filter(F.col("txn_date") <= F.col("last_day")).groupBy("card_id", "last_day").agg(F.sum("moved").alias("moved"))
    doubled = live.groupBy("card_id", "txn_date", "amount_aed", "supplier_raw").agg(F.count(F.lit(1)).alias("n")) \
        .filter("n > 1").groupBy("card_id").agg(F.count(F.lit(1)).alias("identical_groups"))
    base = with_account(statements.join(upto, ["card_id", "last_day"], "left"), acct, "opening_balance") \
        .join(doubled, "card_id", "left")
    held = (F.col("opening_balance") + F.coalesce("moved", F.lit(0))).cast(MONEY_SUM)
    return base.select(
        "card_id", "last_day", held.alias("ledger_at_last_day"), F.col("closing").cast(MONEY_SUM).alias("closing"),
        (held - F.col("closing")).cast(MONEY_SUM).alias("gap"), near(held, F.col("closing")).alias("agrees"),
        (F.col("rows_read") == F.col("rows_stated")).alias("all_rows_read"),
        F.coalesce("identical_groups", F.lit(0)).alias("identical_groups"))


def out_of_month(rows: DataFrame) -> DataFrame:
    """Rows dated outside the month their sheet is for.

    The sheet's name (``MM-YYYY …``) gives the month, the row its day.
    """
    name = F.col("source_sheet")
    belongs = F.concat_ws("-", F.substring(name, 4, 4), F.substring(name, 1, 2))
    odd = name.isNotNull() & (month_key(F.col("txn_date")) != belongs)
    fixed = F.concat_ws("-", belongs, F.lpad(F.dayofmonth("txn_date").cast("string"), 2, "0")).try_cast("date")
    return rows.withColumns({
        "out_of_month": F.coalesce(odd, F.lit(False)),
        "sheet_date": F.when(odd, F.col("txn_date")),
        "txn_date": F.when(odd, fixed).otherwise(F.col("txn_date"))})


def import_months(lines: DataFrame) -> DataFrame:
    """Month sheets: does each chain hold, and does each open where the last closed?

    ``lines`` holds ``card_id, month, seq, opening, debit, credit, balance`` with
    ``opening`` on every row of a month (null where the sheet states none).
    """
    step = (F.coalesce("credit", F.lit(0)) - F.coalesce("debit", F.lit(0))).cast(MONEY_SUM)
    walked = scan(place(lines, ["card_id", "month"], ["seq"]), ["card_id", "month"], ["seq"], [running_sum("_moved", step)])
    walked = walked.withColumn("_level", (F.col("balance") - F.col("_moved")).cast(MONEY_SUM))
    based = scan(walked, ["card_id", "month"], ["seq"], [Measure("_base", "prev", F.col("_level"), MONEY_SUM)])
    start = F.coalesce("_base", "opening")
    broke = F.col("balance").isNotNull() & start.isNotNull() & ~near(start + F.col("_moved"), F.col("balance"))
    months = based.groupBy("card_id", "month").agg(
        F.max("opening").alias("opening"), F.count(F.lit(1)).alias("row_count"), F.count_if(broke).alias("chain_breaks"),
        F.max_by(F.coalesce("balance", (F.coalesce("_base", "opening") + F.col("_moved")).cast(MONEY_SUM)), "seq").cast(MONEY_SUM).alias("closing"))
    linked = walk(months, ["card_id"], ["month"],
                  [Measure("carried", "prev", F.col("closing"), MONEY_SUM)])
    return linked.withColumn("join_break", F.coalesce(F.abs(F.col("opening") - F.col("carried"))
                                                      > F.lit(TOLERANCE).cast("decimal(4,3)"), F.lit(False)))
