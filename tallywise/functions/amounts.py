"""Numbers as people and banks write them, currencies, rates and signs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import MONEY, NO_MINOR_UNIT, PARSED_NUMBER, RATE, THREE_DECIMALS
from .text import let, squeeze


def parse_amount(col: Column) -> Column:
    """``1,234.56``, ``1.234,56``, ``(500)``, ``AED 12`` or ``7.6E-2``; else null."""
    def plain(kept: Column) -> Column:
        def decide(comma: Column, dot: Column) -> Column:
            # The separator nearest the end is the decimal one.  One comma becomes
            # the point; a second one makes the text unreadable.
            european = (comma > 0) & ((dot == 0) | (comma < dot))
            return F.when(european, F.regexp_replace(F.regexp_replace(kept, r"\.", ""), r"^([^,]*),", "$1.")) \
                .otherwise(F.regexp_replace(kept, ",", ""))
        return let(F.reverse(kept), lambda back: decide(F.instr(back, ","), F.instr(back, ".")))

    def number(inner: Column) -> Column:
        return let(F.regexp_replace(inner, r"(?U)\s", ""), lambda packed: F.when(
            packed.rlike(r"^[+-]?\d+([.,]\d+)?[eE][+-]?\d+$"), F.regexp_replace(packed, ",", "."))
            .otherwise(let(F.regexp_replace(inner, r"[^\d.,\-]", ""), plain))).try_cast(PARSED_NUMBER)

    return let(squeeze(col), lambda text: F.when(
        text.rlike(r"^\(.*\)$"), -F.abs(number(F.regexp_replace(text, r"^\(|\)$", "")))).otherwise(number(text)))


def parse_currency_cell(col: Column) -> Column:
    """struct(code, amount, raw) of a cell such as ``USD  240``."""
    pattern = r"^([A-Za-z]{3})\b[\s:]*(.*)$"

    def cell(text: Column) -> Column:
        coded = text.rlike(pattern)
        return F.struct(
            F.when(coded, F.upper(F.regexp_extract(text, pattern, 1))).alias("code"),
            parse_amount(F.when(coded, F.regexp_extract(text, pattern, 2)).otherwise(text)).alias("amount"),
            text.alias("raw"))

    return let(squeeze(F.coalesce(col, F.lit(""))), cell)


def round_to_minor_units(amount: Column, currency: Column) -> Column:
    """Rounded to the decimals the currency is written with; two when unknown."""
    return (F.when(F.coalesce(currency.isin(NO_MINOR_UNIT), F.lit(False)), F.round(amount, 0))
            .when(F.coalesce(currency.isin(THREE_DECIMALS), F.lit(False)), F.round(amount, 3))
            .otherwise(F.round(amount, 2)))


def implied_rate(settled: Column, original: Column) -> Column:
    """Settled amount per unit of the original currency; null without one."""
    return F.when(original > 0, F.round(F.abs(settled).cast("decimal(28,4)") / original, 10)).cast(RATE)


def direction_for(kind: Column) -> Column:
    return (F.when(kind.isin("purchase", "fee"), F.lit("spend"))
            .when(kind.isin("refund", "funding"), F.lit("funding")))


def signed_effect(kind: Column, amount: Column) -> Column:
    """Spending lowers, money in raises, an adjustment counts as entered."""
    way = direction_for(kind)
    return F.when(way == "spend", -F.abs(amount)).when(way == "funding", F.abs(amount)).otherwise(amount)


def project_balance(balance: Column, sign: Column, signed_total: Column) -> Column:
    """Where an account lands once ``signed_total`` is booked on it."""
    return F.round(balance + sign * signed_total, 2)


def as_money(col: Column) -> Column:
    return col.cast(MONEY)
