"""Exact order statistics without gathering a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import month_key
from ..plans.scan import Measure, scan
from ..schema import RATE


def at_positions(df: DataFrame, keys: Sequence[str], value: str, positions: dict[str, Column]) -> DataFrame:
    """The values standing at 1-based ``positions`` (expressions over ``n``).

    Equal values are counted first, then the counts are summed along the value
    order in blocks, so a group of any size never meets in one task.  Returns
    ``keys, n`` and one column per position.
    """
    keys = list(keys)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    v = F.col(value)
    upto = scan(counted, keys, [v],
                [Measure("_upto", "sum", F.col("_c"), "bigint")])
    sizes = counted.groupBy(*keys).agg(F.sum("_c").alias("n"))
    placed = upto.join(sizes, keys)
    hit = lambda p: (F.col("_upto") >= p) & (F.col("_upto") - F.col("_c") < p)
    return placed.groupBy(*keys, "n").agg(
        *[F.min(F.when(hit(p), v)).alias(name) for name, p in positions.items()])


def monthly_median(txn: DataFrame, at_least: int = 4) -> DataFrame:
    """Interpolating median of the settled rate per currency and month."""
    rows = txn.filter((F.col("entry_type") == "source_transaction") & (F.col("status") != "voided")
                      & (F.col("normalized_exchange_rate") > 0) & F.col("currency").isNotNull()
                      & F.col("txn_date").isNotNull()) \
        .select("currency", month_key(F.col("txn_date")).alias("month"), "normalized_exchange_rate")
    half = (F.col("n") - 1) / 2
    mid = at_positions(rows, ["currency", "month"], "normalized_exchange_rate",
                       {"lo": F.floor(half) + 1, "hi": F.ceil(half) + 1})
    return mid.filter(F.col("n") >= at_least).select(
        "currency", "month", "n", ((F.col("lo") + F.col("hi")) / 2).cast("decimal(28,10)").alias("median_rate"))


def usual_rate(txn: DataFrame, acct: DataFrame, at_least: int = 3) -> DataFrame:
    """Upper median of the known rates per settlement currency and currency."""
    known = txn.filter((F.col("exchange_rate") > 0) & F.col("currency").isNotNull()) \
        .groupBy("card_id", "currency", "exchange_rate").agg(F.count(F.lit(1)).alias("_n"))
    rows = known.join(acct.select("card_id", "settlement_currency"), "card_id") \
        .groupBy("settlement_currency", "currency", "exchange_rate").agg(F.sum("_n").alias("_n"))
    keys = ["settlement_currency", "currency"]
    v = F.col("exchange_rate")
    upto = scan(rows, keys, [v],
                [Measure("_upto", "sum", F.col("_n"), "bigint")])
    placed = upto.join(rows.groupBy(*keys).agg(F.sum("_n").alias("samples")), keys)
    want = F.floor(F.col("samples") / 2) + 1
    hit = (F.col("_upto") >= want) & (F.col("_upto") - F.col("_n") < want)
    return placed.filter(hit & (F.col("samples") >= at_least)).select(
        *keys, "samples", v.cast(RATE).alias("usual_rate"))


def implied_rate_bands(rows: DataFrame) -> DataFrame:
    """Per currency: what was paid, what it cost and the rates that implies.

    ``rows`` holds ``currency, original_amount, settled``.  A currency whose
    highest rate is over one and a half times its lowest is marked.
    """
    rate = F.when(F.col("original_amount") != 0, F.col("settled").cast("double") / F.col("original_amount").cast("double"))
    return rows.groupBy("currency").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("original_amount").alias("paid"),
        F.sum("settled").alias("cost"), F.round(F.min(rate), 6).alias("lowest"),
        F.round(F.max(rate), 6).alias("highest"), (F.max(rate) / F.min(rate) > 1.5).alias("suspicious"))
