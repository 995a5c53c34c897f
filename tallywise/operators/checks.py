"""Standing checks over the ledger."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import (content_signature, dedup_key, rate_formula_denominator, review_kind,
                              shown_supplier)
from ..functions.text import is_blank
from ..plans.scan import Measure, cut_lineage, numbered, walk
from ..schema import (ADJUSTMENT, DIRECTIONS, ENTRY_TYPES, MONEY_SUM, RATE, SOURCE, STATUSES, TOLERANCE)
from .filters import with_account
from .matching import cross_check, only_new
from .statistics import monthly_median


def row_rules() -> dict[str, Column]:
    """Every row rule as a condition that must hold; null counts as holding."""
    c = F.col
    return {
        "amount_is_known": c("amount_aed").isNotNull(),
        "known_entry_type": c("entry_type").isin(ENTRY_TYPES),
        "known_status": c("status").isin(STATUSES),
        "known_direction": c("direction").isin(DIRECTIONS),
        "direction_required_for_transactions":
            ((c("entry_type") == SOURCE) & c("direction").isNotNull())
            | ((c("entry_type") == ADJUSTMENT) & c("direction").isNull()),
        "amount_sign_matches_direction":
            c("direction").isNull() | ((c("direction") == "spend") & (c("amount_aed") <= 0))
            | ((c("direction") == "funding") & (c("amount_aed") >= 0)),
        "adjustment_is_explained":
            (c("entry_type") != ADJUSTMENT) | (c("description").isNotNull() & c("review_reason").isNotNull()),
        "conversion_is_complete":
            c("exchange_rate").isNull() | (c("status") == "needs_review") | c("rate_accepted_incomplete")
            | (c("currency").isNotNull() & c("original_amount").isNotNull()),
        "repair_keeps_original": ~c("date_repaired") | c("source_date_raw").isNotNull(),
        "no_rate_on_base_currency": ~((c("currency") == "AED") & c("exchange_rate").isNotNull()),
        "occurrence_starts_at_one": c("occurrence") >= 1,
    }


def row_violations(txn: DataFrame) -> DataFrame:
    """One row per broken rule."""
    if "rate_accepted_incomplete" not in txn.columns:
        txn = txn.withColumn("rate_accepted_incomplete", F.lit(False))
    if "occurrence" not in txn.columns:
        txn = txn.withColumn("occurrence", F.lit(1))
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(rule)) for rule, ok in row_rules().items()]),
                      lambda x: x.isNotNull())
    return txn.select("transaction_id", "card_id", F.explode(broken).alias("rule"))


def rows_of_unknown_accounts(txn: DataFrame, acct: DataFrame) -> DataFrame:
    """Rows whose account is missing or not in ``acct``, as violations of ``account_exists``.

    Operators that join accounts leave such rows out.  The accounts that occur are
    compared, not the rows, so a crowded account is one row of the join.
    """
    used = txn.select("card_id").distinct()
    unknown = used.join(acct.select("card_id"), "card_id", "left_anti").withColumnRenamed("card_id", "_unknown")
    return txn.join(unknown, F.col("card_id").eqNullSafe(F.col("_unknown")), "left_semi").select(
        "transaction_id", "card_id", F.lit("account_exists").alias("rule"))


def duplicate_keys(txn: DataFrame) -> DataFrame:
    """Dedup keys held by more than one row."""
    return txn.groupBy("dedup_key").agg(F.count(F.lit(1)).alias("row_count")).filter("row_count > 1")


def account_violations(acct: DataFrame) -> DataFrame:
    """Accounts whose balance convention is neither available nor drawn."""
    return acct.filter(~F.col("balance_sign").isin(-1, 1))


# ---------------------------------------------------------------- duplicates

def _alike(txn: DataFrame) -> DataFrame:
    return txn.filter((F.col("entry_type") == SOURCE) & (F.col("status") != "voided")).withColumns({
        "supplier": shown_supplier(), "_pay": F.coalesce("payment_ref", F.lit(""))})


ALIKE = ["card_id", "txn_date", "amount_aed", "supplier", "_pay"]


def possible_duplicates(txn: DataFrame, acct: DataFrame) -> DataFrame:
    """Groups of rows that could be one charge, with the money at stake.

    Counts, sources and entry times are plain aggregates with a partial step.
    The rows of a group come from ``duplicate_members``, one row each: a group
    may be too large for an array.
    """
    groups = _alike(txn).groupBy(*ALIKE).agg(
        F.count(F.lit(1)).alias("copies"),
        F.count_distinct(F.coalesce("source_sheet", F.lit("manual entry"))).alias("distinct_sources"),
        F.min("created_at").alias("first_entered"), F.max("created_at").alias("last_entered")).filter("copies > 1")
    apart = F.col("last_entered") - F.col("first_entered") > F.expr("INTERVAL '1' MINUTE")
    return with_account(groups, acct, "card_name").select(
        "card_id", "card_name", "txn_date", "amount_aed", "supplier", F.col("_pay").alias("payment_ref"),
        "copies", "distinct_sources", "first_entered", "last_entered",
        (F.abs("amount_aed") * (F.col("copies") - 1)).cast(MONEY_SUM).alias("amount_at_risk"),
        ((F.col("distinct_sources") > 1) | apart).alias("entered_separately"))


def duplicate_members(txn: DataFrame) -> DataFrame:
    """Every row of every duplicate group, numbered in source and entry order."""
    rows = _alike(txn)
    groups = rows.groupBy(*ALIKE).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    g = groups.select(*[F.col(c).alias(f"_g{c}") for c in ALIKE], "copies")
    same = rows.join(g, [F.col(c).eqNullSafe(F.col(f"_g{c}")) for c in ALIKE]).drop(*[f"_g{c}" for c in ALIKE])
    # Rows without a source row come last.
    rank = F.coalesce(F.col("source_row").cast("bigint"), F.lit(2**62))
    return numbered(same, ALIKE, [rank, F.col("created_at"), F.col("transaction_id")], "member_no").select(
        "card_id", "txn_date", "amount_aed", "supplier", F.col("_pay").alias("payment_ref"), "copies", "member_no",
        "transaction_id", F.coalesce("source_row", F.lit(0)).alias("source_row"))


def split_duplicates(groups: DataFrame) -> DataFrame:
    """Entered separately (the pattern of a mistake) or listed together (of a repeat)."""
    return groups.withColumn("verdict", F.when(F.col("entered_separately"), "separate").otherwise("expected"))


def duplicates_by_risk(groups: DataFrame) -> DataFrame:
    return groups.orderBy(F.desc("amount_at_risk"), "card_id", "txn_date", "supplier", "payment_ref")


# ------------------------------------------------------------ decimal slips

FACTORS = (10, 100, 1000)
SLIP = 0.005


def _cell(x: Column, factor: int) -> Column:
    """Amounts on a logarithmic grid; half the width of the factor's band is one cell."""
    width = math.log((factor + SLIP) / (factor - SLIP)) / 2
    return F.floor(F.log(x) / F.lit(width)).cast("bigint")


def _amount_cells(amounts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells in which an amount looks for its partners, and cells in which it is found.

    A band join with a grid for each factor: the partners of an amount lie in a band
    two cells wide, so three cells are looked up, of which the band fills two thirds
    or more.  Only a factor that leads to an amount inside the span of the same account
    and supplier is dealt out.
    """
    span = amounts.filter("cents > 0").groupBy("card_id", "supplier").agg(F.min("cents").alias("_least"), F.max("cents").alias("_most"))
    within = amounts.filter("cents > 0").join(span.filter("_most > 9 * _least"), ["card_id", "supplier"])
    a = F.col("cents").cast("double")

    def band(f: int) -> Column:
        cells = F.sequence(_cell(a / (f + SLIP) * (1 - 1e-12), f), _cell(a / (f - SLIP) * (1 + 1e-12), f))
        return F.transform(cells, lambda c: F.struct(F.lit(f).alias("factor"), c.alias("cell")))

    def own(f: int) -> Column:
        return F.array(F.struct(F.lit(f).alias("factor"), _cell(a, f).alias("cell")))

    def dealt(cells, reaches) -> Column:
        parts = F.array(*[F.when(reaches(f - 1), cells(f)) for f in FACTORS])
        return F.inline(F.flatten(F.filter(parts, lambda p: p.isNotNull())))

    big = within.filter("cents >= 50000").select(
        "card_id", "supplier", F.col("cents").alias("big"), dealt(band, lambda f: F.col("cents") > f * F.col("_least")))
    small = within.select(
        "card_id", "supplier", F.col("cents").alias("small"), dealt(own, lambda f: F.col("_most") > f * F.col("cents")))
    return big, small


def _amount_pairs(amounts: DataFrame) -> DataFrame:
    """Amounts of one account and supplier that are 10, 100 or 1000 times another."""
    big, small = _amount_cells(amounts)
    met = big.join(small, ["card_id", "supplier", "factor", "cell"])
    # The ratio is compared in whole cents: |big / small − f| < 0.005.
    close = F.abs(F.col("big") - F.col("factor") * F.col("small")).cast("decimal(38,3)") < \
        F.col("small").cast("decimal(30,0)") * F.lit(SLIP).cast("decimal(4,3)")
    return met.filter(close).select("card_id", "supplier", "big", "small", F.col("factor").cast("bigint").alias("factor"))


def suspect_amounts(txn: DataFrame, acct: DataFrame) -> DataFrame:
    """Amounts that look like a misplaced decimal point, each with its best comparison.

    Best is: same day, then nearest day, then lowest id.  Rows are folded to one
    per (account, supplier, amount, day); amounts are paired on a grid; and the
    nearest day is found by walking days in order, so a supplier charged a
    billion times produces neither pairs nor a crowded task.
    """
    rows = txn.filter((F.col("entry_type") == SOURCE) & (F.col("status") != "voided")).withColumns({
        "supplier": shown_supplier(), "cents": F.round(F.abs("amount_aed") * 100).cast("bigint")})
    partner = F.struct(F.col("transaction_id").alias("id"), F.col("amount_aed").alias("amount"))
    # Four steps read the folded days: they are written once.
    days = cut_lineage(rows.groupBy("card_id", "supplier", "cents", "txn_date").agg(F.min(partner).alias("held")))
    amounts = days.select("card_id", "supplier", "cents").distinct()
    pairs = _amount_pairs(amounts)

    asks = days.withColumnRenamed("cents", "big").join(pairs, ["card_id", "supplier", "big"]).select(
        "card_id", "supplier", "small", "txn_date", "big", "factor")
    wanted = pairs.select("card_id", "supplier", "small").distinct()
    offers = days.withColumnRenamed("cents", "small").join(wanted, ["card_id", "supplier", "small"], "left_semi")
    offer = F.struct(F.col("txn_date").alias("day"), F.col("held")["id"].alias("id"), F.col("held")["amount"].alias("amount"))
    kind = "struct<day:date,id:bigint,amount:decimal(18,2)>"
    # The days of one amount are few by what they are, asked or charged: a plain window orders them.
    events = offers.select("card_id", "supplier", "small", "txn_date", offer.cast(kind).alias("offer"), F.lit(0).alias("asks")) \
        .unionByName(asks.select("card_id", "supplier", "small", "txn_date", F.lit(None).cast(kind).alias("offer"),
                                 F.lit(1).alias("asks")).distinct())
    near = walk(events, ["card_id", "supplier", "small"], ["txn_date", "asks"],
                [Measure("before", "prev", F.col("offer"), kind), Measure("after", "next", F.col("offer"), kind)]) \
        .filter("asks = 1").select("card_id", "supplier", "small", F.struct("txn_date").alias("_on"), "before", "after")
    # Inside a struct a missing date meets a missing date.
    walked = asks.withColumn("_on", F.struct("txn_date")).join(near, ["card_id", "supplier", "small", "_on"])

    def ranked(o: str) -> Column:
        day = F.col(o)["day"]
        apart = F.abs(F.datediff(day, "txn_date"))
        return F.when(F.col(o).isNotNull(), F.struct(
            (~F.coalesce(day == F.col("txn_date"), F.lit(False))).alias("other_day"),
            F.coalesce(apart, F.lit(2**30)).alias("apart"), F.col(o)["id"].alias("id"), day.alias("day"),
            F.col(o)["amount"].alias("amount"), F.col("factor").alias("factor")))

    best = walked.groupBy("card_id", "supplier", F.col("big").alias("cents"), "txn_date").agg(
        F.min(F.least(ranked("before"), ranked("after"))).alias("b"))
    keys = ["card_id", "supplier", "cents"]
    b = best.select(*keys, F.col("txn_date").alias("_day"), "b")
    found = rows.join(b, [rows[k] == b[k] for k in keys] + [rows["txn_date"].eqNullSafe(b["_day"])]) \
        .drop(*[b[k] for k in keys])
    return with_account(found, acct, "card_name").select(
        "transaction_id", "card_id", "card_name", "txn_date", "supplier", "amount_aed",
        F.col("b.id").alias("compare_with_id"), F.col("b.day").alias("compare_with_date"),
        F.col("b.amount").alias("compare_with_amount"), F.col("b.factor").alias("factor"),
        (~F.col("b.other_day")).alias("same_day"),
        F.abs(F.datediff("b.day", "txn_date")).alias("days_apart"), "currency", "source_sheet", "source_row")


def suspect_rates(txn: DataFrame, acct: DataFrame) -> DataFrame:
    """Settled rates over five times, or under a fifth of, the month's median."""
    usual = monthly_median(txn).filter("median_rate > 0")
    rate = F.col("normalized_exchange_rate")
    rows = txn.filter((F.col("entry_type") == SOURCE) & (F.col("status") != "voided") & rate.isNotNull()) \
        .withColumn("month", F.date_format("txn_date", "yyyy-MM")).join(usual, ["currency", "month"])
    odd = rows.filter((rate > F.col("median_rate") * 5) | (rate < F.col("median_rate") / 5))
    return with_account(odd, acct, "card_name").select(
        "transaction_id", "card_id", "card_name", "txn_date", shown_supplier().alias("supplier"), "currency",
        "original_amount", "amount_aed", F.round(rate, 6).alias("settled_rate"),
        F.round("median_rate", 6).alias("usual_rate"),
        F.round(rate.cast("double") / F.col("median_rate").cast("double"), 2).alias("times_usual"),
        F.col("n").alias("comparable_rows"), "source_sheet", "source_row")


# ------------------------------------------------------------------- queues

def rows_before_opening(txn: DataFrame, acct: DataFrame) -> DataFrame:
    """Stored rows the balance does not count, because the account was not open yet."""
    rows = with_account(txn.filter("status <> 'voided'"), acct, "card_name", "opening_date") \
        .filter(F.col("txn_date") < F.col("opening_date"))
    return rows.select(
        "transaction_id", "card_id", "card_name", "txn_date", "opening_date",
        F.datediff("opening_date", "txn_date").alias("days_before"), shown_supplier().alias("supplier"),
        "amount_aed", "currency", "status", F.coalesce("source_sheet", F.lit("entered by hand")).alias("came_from"))


def review_queue(txn: DataFrame, acct: DataFrame) -> DataFrame:
    """Everything flagged, and every adjustment, settled or not."""
    rows = txn.filter(F.col("status").isin("needs_review", "excluded_from_source_balance")
                      | (F.col("entry_type") == ADJUSTMENT))
    return with_account(rows, acct, "card_name").select(
        "transaction_id", "card_name", "source_sheet", "source_row", "txn_date", "supplier_raw", "amount_aed",
        "currency", "currency_raw", "entry_type", "status", "review_reason", "description")


def open_review_items(txn: DataFrame, acct: DataFrame) -> DataFrame:
    """What still waits for a decision, newest first, with the kind of question."""
    undecided = (F.col("entry_type") == ADJUSTMENT) & ~F.col("status").isin("confirmed", "voided")
    rows = txn.filter(F.col("status").isin("needs_review", "excluded_from_source_balance") | undecided)
    return with_account(rows, acct, "card_name").select(
        "transaction_id", "card_id", "card_name", "txn_date", "amount_aed", "status", review_kind().alias("kind"),
        F.coalesce("review_reason", F.lit("Flagged during import")).alias("reason")) \
        .orderBy(F.desc_nulls_last("txn_date"), "transaction_id")


# ------------------------------------------------------------- occurrences

def assign_occurrence(txn: DataFrame) -> DataFrame:
    """Number the copies of each content signature and derive the dedup key."""
    rank = F.coalesce(F.col("source_row").cast("bigint"), F.lit(0).cast("bigint"))
    signed = txn.withColumn("signature", content_signature())
    counted = numbered(signed, ["signature"], [rank, F.col("transaction_id")], "occurrence")
    return counted.withColumn("dedup_key", dedup_key(F.col("signature"), F.col("occurrence"))).drop("signature")


def occurrence_integrity(txn: DataFrame) -> DataFrame:
    """Repeated charges not numbered 1 … n without gap or repeat."""
    keys = {"card_id": F.col("card_id"), "txn_date": F.col("txn_date"), "amount_aed": F.col("amount_aed"),
            "supplier": F.coalesce("supplier_raw", F.lit("")), "payment_ref": F.coalesce("payment_ref", F.lit("")),
            "req_number": F.coalesce("req_number", F.lit(""))}
    rows = txn.filter((F.col("entry_type") == SOURCE) & (F.col("status") != "voided"))
    groups = rows.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(
        F.count(F.lit(1)).alias("copies"), F.max("occurrence").alias("highest"),
        F.count_distinct("occurrence").alias("distinct_numbers"))
    return groups.filter((F.col("copies") > 1) & ((F.col("highest") != F.col("copies"))
                                                  | (F.col("distinct_numbers") != F.col("copies"))))


# ------------------------------------------------------------- audit trails

def unexplained_status_changes(ledger: DataFrame, baseline: DataFrame, log: DataFrame) -> DataFrame:
    """Rows whose status moved since ``baseline`` (dedup_key, status) with no recorded decision."""
    then = baseline.select("dedup_key", F.col("status").alias("status_then"))
    moved = ledger.join(then, "dedup_key").filter("status <> status_then")
    return moved.join(log.select("transaction_id").distinct(), "transaction_id", "left_anti").select(
        "transaction_id", "card_id", "source_row", "status_then", "status")


def unaudited_rows(txn: DataFrame, log: DataFrame) -> DataFrame:
    """Rows from no sheet that no ``created`` event accounts for."""
    created = log.filter("action = 'created'").select("transaction_id").distinct()
    return txn.filter(F.col("source_sheet").isNull()).join(created, "transaction_id", "left_anti") \
        .select("transaction_id", "card_id", "txn_date", "amount_aed")


def three_way_balances(balances: DataFrame, fresh: DataFrame, summary: DataFrame, log_by_account: DataFrame) -> DataFrame:
    """Each balance derived three ways; a difference from the import needs corrections on record.

    ``fresh`` and ``summary`` hold ``card_id, source_balance, ledger_balance``;
    ``log_by_account`` holds ``card_id, corrections``.
    """
    f = fresh.select("card_id", F.col("source_balance").alias("f_source"), F.col("ledger_balance").alias("f_ledger"))
    s = summary.select("card_id", F.col("source_balance").alias("s_source"), F.col("ledger_balance").alias("s_ledger"))
    rows = balances.select("card_id", "card_name", "source_balance", "ledger_balance") \
        .join(f, "card_id", "full_outer").join(s, "card_id", "full_outer").join(log_by_account, "card_id", "left")
    tol = F.lit(TOLERANCE).cast("decimal(4,3)")
    same = lambda a, b: F.coalesce(F.abs(F.col(a) - F.col(b)) < tol, F.lit(False))
    view = same("f_source", "source_balance") & same("f_ledger", "ledger_balance")
    extract = same("f_source", "s_source") & same("f_ledger", "s_ledger")
    n = F.coalesce("corrections", F.lit(0))
    return rows.select(
        "card_id", "card_name", "source_balance", "ledger_balance", view.alias("fresh_equals_view"),
        extract.alias("fresh_equals_import"), n.alias("corrections"),
        F.when(~view, "broken").when(extract, "agrees").when(n > 0, "explained").otherwise("unexplained").alias("verdict"))


def duplicate_candidates(rows: DataFrame) -> DataFrame:
    """Rows of raw sheets that share date, supplier and amount."""
    return rows.groupBy("sheet", "date_text", F.upper(F.trim(F.coalesce("supplier", F.lit("")))).alias("supplier"), "amount") \
        .agg(F.count(F.lit(1)).alias("row_count")).filter("row_count > 1")


def rate_consistency(rows: DataFrame) -> DataFrame:
    """Original times rate against what was settled, more than a cent apart."""
    implied = F.round(F.col("original_amount") * F.col("exchange_rate"), 2).cast(MONEY_SUM)
    return rows.filter((F.col("original_amount") > 0) & (F.col("exchange_rate") > 0)
                       & (F.abs("amount_aed") > 0)).withColumn("implied", implied) \
        .filter(F.abs(F.col("implied") - F.abs("amount_aed")) > F.lit(0.01).cast("decimal(4,2)"))


def currency_integrity(txn: DataFrame, currencies: DataFrame) -> DataFrame:
    """Codes in use that the currency table does not know."""
    used = txn.filter(F.col("currency").isNotNull()).groupBy("currency").agg(F.count(F.lit(1)).alias("row_count"))
    return used.join(currencies.select(F.col("code").alias("currency")), "currency", "left_anti")


def rate_checks(rows: DataFrame) -> DataFrame:
    """What is wrong with the conversion formulas of raw rows, one row per finding.

    ``rows`` holds ``sheet, row, formula, cached, numerator, original_amount,
    currency``: the formula text, the value cached for it, the value of the cell
    it divides, and what the currency cell says.
    """
    formula = F.col("formula")
    divided = r"^=\s*[A-Z]+(\d+)\s*/\s*[\d,.]+\s*$"
    simple = formula.rlike(divided)
    at = F.when(simple, F.regexp_extract(formula, divided, 1)).try_cast("bigint")
    den = rate_formula_denominator(formula)
    off = lambda a, b, tol: F.abs(a.cast("double") - b.cast("double")) > tol
    kinds = [
        F.when(~simple, "rate_formula_unexpected"),
        F.when(simple & (at != F.col("row")), "rate_row_mismatch"),
        F.when(simple & den.isNull(), "rate_denominator_unparseable"),
        F.when(off(den, F.col("original_amount"), 1e-9), "rate_denominator_mismatch"),
        F.when(simple & F.col("original_amount").isNull() & F.col("currency").isNull(), "rate_without_currency"),
        F.when((den != 0) & off(F.col("numerator").cast("double") / F.nullif(den, F.lit(0)).cast("double"), F.col("cached"), 1e-6),
               "rate_cached_value_wrong"),
    ]
    found = F.filter(F.array(*kinds), lambda x: x.isNotNull())
    return rows.filter(formula.startswith("=")).select("sheet", "row", "formula", F.explode(found).alias("kind"))


# ------------------------------------------------------------------ the feed

def activity_log(corrections: DataFrame, card_audit: DataFrame, access_audit: DataFrame, txn: DataFrame,
                 acct: DataFrame) -> DataFrame:
    """Every event in the system in one feed: transactions, accounts, access."""
    facts = txn.select("transaction_id", "card_id", "supplier_raw", "description", "amount_aed", "txn_date")
    named = with_account(corrections.join(facts, "transaction_id"), acct, "card_name")
    none = lambda t: F.lit(None).cast(t)
    rows = named.select(
        "created_at", F.lit("transaction").alias("area"), "action",
        F.coalesce("actor", F.lit("an admin")).alias("actor"), "card_name", "transaction_id",
        F.coalesce("supplier_raw", "description", F.lit("(no supplier)")).alias("subject"), "amount_aed", "txn_date",
        "rationale", "note", "from_status", "to_status")
    cards = card_audit.select(
        "created_at", F.lit("card").alias("area"), "action", F.coalesce("actor", F.lit("the system")).alias("actor"),
        "card_name", none("bigint").alias("transaction_id"), F.col("card_name").alias("subject"),
        none("decimal(18,2)").alias("amount_aed"), none("date").alias("txn_date"),
        F.coalesce("reason", F.concat(F.lit("Card "), F.col("action"))).alias("rationale"), none("string").alias("note"),
        none("string").alias("from_status"), none("string").alias("to_status"))
    access = access_audit.select(
        "created_at", F.lit("access").alias("area"), "action", F.coalesce("actor", F.lit("the system")).alias("actor"),
        none("string").alias("card_name"), none("bigint").alias("transaction_id"), F.col("target").alias("subject"),
        none("decimal(18,2)").alias("amount_aed"), none("date").alias("txn_date"),
        F.coalesce("rationale", F.concat(F.lit("Write access "), F.col("action"))).alias("rationale"),
        none("string").alias("note"), none("string").alias("from_status"), none("string").alias("to_status"))
    return rows.unionByName(cards).unionByName(access)


def latest_activity(log: DataFrame, n: int = 400) -> DataFrame:
    return log.orderBy(F.desc("created_at"), "area", "subject", "transaction_id").limit(n)


def transaction_history(log: DataFrame, transaction_id) -> DataFrame:
    """How one row came to say what it says, oldest event first."""
    return log.filter(F.col("transaction_id") == F.lit(transaction_id)).orderBy("created_at", "action")


def figure_scan(balances: DataFrame, txn: DataFrame, forbidden: float) -> DataFrame:
    """Every figure the system can produce, searched for one that must not appear."""
    names = {"source": "source_balance", "ledger": "ledger_balance", "difference": "reconciliation_difference",
             "opening": "opening_balance", "spend": "total_spend", "funding": "total_funding",
             "adjustments": "review_adjustments_total"}
    stacked = balances.select("card_id", F.explode(F.array(*[
        F.struct(F.lit(f"account_balances.{k}").alias("source"), F.col(c).cast(MONEY_SUM).alias("value"))
        for k, c in names.items()])).alias("f")).select(F.col("card_id").alias("row_id"), "f.source", "f.value")
    rows = txn.select(F.col("transaction_id").alias("row_id"), F.lit("transactions.amount_aed").alias("source"),
                      F.col("amount_aed").cast(MONEY_SUM).alias("value"))
    away = F.abs(F.col("value") - F.lit(str(forbidden)).cast(MONEY_SUM))
    return stacked.unionByName(rows).filter(away < F.lit(TOLERANCE).cast("decimal(4,3)"))


def compare_snapshots(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Column for column: what differs between two versions of a table.

    Rows present on one side only are reported once, under ``(row)``.
    """
    columns = [c for c in (columns or before.columns) if c != key]
    pack = lambda df, side: df.select(F.col(key).alias("_k"), F.struct(*[F.col(c).cast("string").alias(c) for c in columns]).alias(side))
    both = pack(before, "b").join(pack(after, "a"), "_k", "full_outer")
    cells = [F.struct(F.lit(c).alias("field"), F.col("b")[c].alias("was"), F.col("a")[c].alias("became")) for c in columns]
    moved = F.filter(F.array(*cells), lambda x: ~x["was"].eqNullSafe(x["became"]))
    lost = lambda was, became: F.array(F.struct(F.lit("(row)").alias("field"), F.lit(was).alias("was"), F.lit(became).alias("became")))
    diff = (F.when(F.col("a").isNull(), lost("present", None)).when(F.col("b").isNull(), lost(None, "present"))
            .otherwise(moved))
    return both.select(F.col("_k").alias(key), F.explode(diff).alias("d")).select(key, "d.*")


def log_counts(corrections: DataFrame, txn: DataFrame) -> DataFrame:
    """Recorded corrections per account."""
    per_row = corrections.groupBy("transaction_id").agg(F.count(F.lit(1)).alias("n"))
    return txn.select("transaction_id", "card_id").join(per_row, "transaction_id") \
        .groupBy("card_id").agg(F.sum("n").alias("corrections"))


__all__ = [n for n in dir() if not n.startswith("_")]
