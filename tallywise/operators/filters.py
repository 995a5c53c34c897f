"""Filters, searches and pick lists over transactions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import shown_supplier
from ..functions.text import is_bac, is_blank, matches_query, without_country
from ..schema import ADJUSTMENT


def supplier_name() -> Column:
    """The merchant without its country code."""
    return without_country(F.col("supplier_raw"))


def filter_accounts(txn: DataFrame, ids: Sequence) -> DataFrame:
    return txn.filter(F.col("card_id").isin(list(ids)))


def filter_currency(txn: DataFrame, codes: Sequence[str]) -> DataFrame:
    """``unknown`` picks the rows no currency could be assigned to."""
    return txn.filter(F.coalesce("currency", F.lit("unknown")).isin(list(codes)))


def filter_status(txn: DataFrame, statuses: Sequence[str]) -> DataFrame:
    return txn.filter(F.col("status").isin(list(statuses)))


def row_kind() -> Column:
    return (F.when(F.col("entry_type") == ADJUSTMENT, "adjustment")
            .otherwise(F.coalesce("direction", F.lit("adjustment"))))


def filter_kind(txn: DataFrame, kinds: Sequence[str]) -> DataFrame:
    return txn.filter(row_kind().isin(list(kinds)))


def filter_supplier(txn: DataFrame, names: Sequence[str]) -> DataFrame:
    return txn.filter(supplier_name().isin(list(names)))


def filter_dates(txn: DataFrame, date_from=None, date_to=None) -> DataFrame:
    """Both ends count; a row without a date meets no bound."""
    if date_from is not None:
        txn = txn.filter(F.col("txn_date") >= F.lit(date_from).cast("date"))
    if date_to is not None:
        txn = txn.filter(F.col("txn_date") <= F.lit(date_to).cast("date"))
    return txn


def filter_missing(txn: DataFrame, name: str) -> DataFrame:
    """Rows where a field was never filled in; for requests only money out."""
    blank = is_blank(F.col(name))
    if name == "req_number":
        blank = blank & (F.col("amount_aed") < 0)
    return txn.filter(blank)


def filter_bank_charges(txn: DataFrame, mode: str) -> DataFrame:
    """``only`` and ``hide`` split the table in two."""
    bac = is_bac(F.col("req_number"))
    return txn.filter(bac if mode == "only" else ~bac)


def filter_source(txn: DataFrame, mode: str) -> DataFrame:
    imported = F.coalesce(F.col("source_sheet"), F.lit("")) != ""
    return txn.filter(imported if mode == "imported" else ~imported)


SEARCHED = ["req_number", "payment_ref", "invoice", "lpo_number", "crm", "client", "sales_operation",
            "account", "event_end", "currency", "currency_raw", "source_date_raw", "description",
            "notes", "review_reason", "rate_review_note", "source_sheet"]


def haystack(card_name: Column) -> Column:
    """Everything a search looks at, lower case, one string."""
    parts = [card_name, supplier_name(), F.col("supplier_raw"), *[F.col(c) for c in SEARCHED],
             F.concat(F.lit("row "), F.col("source_row").cast("string"))]
    return F.lower(F.concat_ws(" \x01 ", *[F.when(p != "", p) for p in parts]))


def with_account(txn: DataFrame, acct: DataFrame, *columns: str) -> DataFrame:
    """Account facts beside each row.  The join side is Spark's choice: the
    accounts grow with the data, so they are not broadcast by hand."""
    return txn.join(acct.select("card_id", *columns), "card_id")


def with_known_currency(rows: DataFrame, code: Column, currencies: DataFrame | Sequence[str]) -> DataFrame:
    """Adds ``_known``: whether ``code`` is in a list of codes or a table with a column ``code``."""
    if isinstance(currencies, DataFrame):
        listed = currencies.select(F.col("code").alias("_code"), F.lit(True).alias("_known")).distinct()
        return rows.join(listed, code == F.col("_code"), "left").drop("_code") \
            .withColumn("_known", F.coalesce("_known", F.lit(False)))
    return rows.withColumn("_known", F.coalesce(code.isin(list(currencies)), F.lit(False)))


def search(txn: DataFrame, acct: DataFrame, query: str) -> DataFrame:
    if not query.strip():
        return txn
    named = txn.join(acct.select("card_id", F.col("card_name").alias("_name")), "card_id", "left")
    return named.filter(matches_query(haystack(F.coalesce("_name", F.lit(""))), query)).drop("_name")


@dataclass(frozen=True)
class Filters:
    query: str = ""
    card_ids: Sequence = ()
    currencies: Sequence[str] = ()
    statuses: Sequence[str] = ()
    kinds: Sequence[str] = ()
    suppliers: Sequence[str] = ()
    date_from: str | None = None
    date_to: str | None = None
    source: str = "all"
    missing: str = ""
    bank_charges: str = ""
    extra: dict = field(default_factory=dict)


def apply_filters(txn: DataFrame, acct: DataFrame, f: Filters) -> DataFrame:
    """All set filters at once; the free-text search, the dear one, comes last."""
    if f.card_ids:
        txn = filter_accounts(txn, f.card_ids)
    if f.currencies:
        txn = filter_currency(txn, f.currencies)
    if f.statuses:
        txn = filter_status(txn, f.statuses)
    if f.kinds:
        txn = filter_kind(txn, f.kinds)
    if f.suppliers:
        txn = filter_supplier(txn, f.suppliers)
    txn = filter_dates(txn, f.date_from, f.date_to)
    if f.missing:
        txn = filter_missing(txn, f.missing)
    if f.bank_charges:
        txn = filter_bank_charges(txn, f.bank_charges)
    if f.source != "all":
        txn = filter_source(txn, f.source)
    return search(txn, acct, f.query)


STORED_SEARCH = ["supplier_raw", "req_number", "lpo_number", "payment_ref", "invoice", "account", "crm",
                 "client", "sales_operation", "event_end", "currency_raw", "source_date_raw",
                 "description", "notes"]


def search_text(txn: DataFrame, acct: DataFrame) -> DataFrame:
    """The stored search column and its account-prefixed form."""
    text = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in STORED_SEARCH])
    return (with_account(txn, acct, "card_name").withColumn("search_text", text)
            .withColumn("full_search_text", F.concat_ws(" ", "card_name", "search_text")))


def in_balance(txn: DataFrame, acct: DataFrame) -> DataFrame:
    """Rows that count: not voided, and not dated before the account opened."""
    opened = F.col("opening_date").isNull() | (F.col("txn_date") >= F.col("opening_date"))
    return with_account(txn.filter("status <> 'voided'"), acct, "opening_date") \
        .filter(opened).drop("opening_date")


def filter_log(log: DataFrame, area: str = "all", actor: str = "all", query: str = "") -> DataFrame:
    """The history screen: one area, one actor, words anywhere in the event."""
    if area != "all":
        log = log.filter(F.col("area") == area)
    if actor != "all":
        log = log.filter(F.col("actor") == actor)
    words = query.strip().lower()
    if words:
        text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in
                                          ("subject", "card_name", "rationale", "actor", "note")]))
        log = log.filter(F.contains(text, F.lit(words)))
    return log


def option_lists(txn: DataFrame, log: DataFrame) -> DataFrame:
    """What the currency and actor pick lists offer."""
    currencies = txn.select(F.lit("currency").alias("list"),
                            F.coalesce("currency", F.lit("unknown")).alias("option"))
    actors = log.select(F.lit("actor").alias("list"), F.col("actor").alias("option"))
    return currencies.unionByName(actors).distinct()


def labelled(txn: DataFrame) -> DataFrame:
    return txn.withColumn("supplier", shown_supplier())
