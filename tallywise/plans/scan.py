"""Ordered scans over keys that may hold any share of the rows.

A plain window puts a whole key in one task.  ``scan`` gives the same answers from
ranges of each key's order, by one plan at every size:

1. **Cuts.**  Points ``(key, order)`` are dealt into ``SPLITS`` hash buckets and each
   bucket keeps the point of least hash: an even sample that has at most ``SPLITS``
   points whatever the data, found by partial aggregation.  A key gets cuts in
   proportion to its rows; a key that got none has few rows.
2. **Blocks.**  A row's block is the number of its key's cuts at or below it: the row
   meets the stretch of ``STRETCH`` cuts it falls into, then the cut.  The stretches come
   from the sample, so its bound allows to broadcast them.
3. **Summaries.**  Rows of keys with cuts are summarised per block (at most
   ``2 * SPLITS`` summaries), carried forward or back along the key, and broadcast.
4. **Windows** over ``(key, block)`` finish the job, each adding what was carried in.

All of it runs when the query runs; nothing runs while it is built.  ``place`` does
steps 1 and 2 alone: scans of the same keys along the same order can share its columns,
and then share one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir

#: Cuts at most, over all keys: blocks hold about one in so many of all rows.
SPLITS = 4096
STRETCH = 64

BLOCK, EDGE = "_block", "_edge"


@dataclass(frozen=True)
class Measure:
    """One scanned output column.

    kind: ``sum`` and ``max`` run up to and including the row, ``sum_before``
    stops in front of it, ``prev`` and ``next`` are the nearest non-null value
    strictly before or after it.
    """

    name: str
    kind: str
    value: Column
    dtype: str


def running_sum(name: str, value: Column, dtype: str = "decimal(28,2)") -> Measure:
    return Measure(name, "sum", value, dtype)


def position(name: str) -> Measure:
    """1, 2, 3 … along the order."""
    return Measure(name, "sum", F.lit(1), "bigint")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder; a lost executor costs no recomputation."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession, "checkpoints"))
    return df.checkpoint(eager=True)


def _columns(order: Sequence[Column | str]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def _cuts(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], splits: int) -> DataFrame:
    """One row for each key that has cuts: ``_scan_k0`` … and ``cuts`` in order."""
    at = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(_columns(order))])
    names = [f"_scan_k{i}" for i in range(len(keys))]
    points = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], at.alias("at"))
    dealt = points.withColumn("h", F.xxhash64(*names, "at"))
    sample = dealt.groupBy(F.pmod("h", F.lit(splits)).alias("b")).agg(F.min_by(F.struct(*names, "at"), "h").alias("p"))
    return sample.select("p.*").groupBy(*names).agg(F.sort_array(F.collect_list("at")).alias("cuts"))


def _same(keys: Sequence[str]) -> Column:
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_scan_k{i}"))
    return same


def _reached(cuts: str, most: int) -> Column:
    """How many of the sorted ``cuts`` are at or below ``_at``; 0 without cuts."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(most.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(
        F.get(F.col(cuts), n + step - 1) <= F.col("_scan_at"), n + step).otherwise(n))


def place(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], splits: int = SPLITS) -> DataFrame:
    """Add the row's block along ``order`` within its key, and whether its key has more than one."""
    names = [f"_scan_k{i}" for i in range(len(keys))]
    cuts = _cuts(df, keys, order, splits)
    stretches = F.ceil(F.size("cuts") / F.lit(STRETCH)).cast("int")
    part = F.col("_scan_part") * STRETCH
    tables = cuts.select(*names, "cuts", F.explode(F.sequence(F.lit(0), stretches - 1)).alias("_scan_part")).select(
        *names, part.alias("_scan_passed"), F.when(part > 0, F.get("cuts", part)).alias("_scan_from"),
        F.get("cuts", part + STRETCH).alias("_scan_to"), F.slice("cuts", part + 1, F.lit(STRETCH)).alias("_scan_cuts"))
    at = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(_columns(order))])
    within = (F.col("_scan_from").isNull() | (F.col("_scan_from") <= F.col("_scan_at"))) & (F.col("_scan_to").isNull() | (F.col("_scan_at") < F.col("_scan_to")))
    found = df.withColumn("_scan_at", at).join(F.broadcast(tables), _same(keys) & within, "left")
    return found.withColumns({BLOCK: F.coalesce("_scan_passed", F.lit(0)) + _reached("_scan_cuts", STRETCH),
                              EDGE: F.col("_scan_passed").isNotNull()}).select(*df.columns, BLOCK, EDGE)


def _summary(m: Measure, order: Column) -> Column:
    v = F.col(f"_scan_m_{m.name}")
    if m.kind in ("sum", "sum_before"):
        return F.sum(v).cast(m.dtype)
    if m.kind == "max":
        return F.max(v)
    pick = F.max_by if m.kind == "prev" else F.min_by
    return pick(v, F.when(v.isNotNull(), order))


def _over(m: Measure, value: Column, window, whole_rows: bool) -> Column:
    """The measure of ``value`` along ``window``; ``whole_rows``: up to the row itself where the kind includes it."""
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    upto = window.rowsBetween(Window.unboundedPreceding, 0) if whole_rows else before
    if m.kind == "sum":
        return F.sum(value).over(upto)
    if m.kind == "sum_before":
        return F.sum(value).over(before)
    if m.kind == "max":
        return F.max(value).over(upto)
    if m.kind == "prev":
        return F.last(value, ignorenulls=True).over(before)
    return F.first(value, ignorenulls=True).over(window.rowsBetween(1, Window.unboundedFollowing))


def _joined(m: Measure, here: Column, carried: Column) -> Column:
    if m.kind in ("sum", "sum_before"):
        zero = F.lit(0).cast(m.dtype)
        return (F.coalesce(here, zero) + F.coalesce(carried, zero)).cast(m.dtype)
    if m.kind == "max":
        return F.greatest(here, carried)
    return F.coalesce(here, carried)


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], measures: Sequence[Measure],
         splits: int = SPLITS) -> DataFrame:
    """Add one column per measure, computed along ``order`` within ``keys``.

    ``order`` is ascending and complete (no ties).  Rows that ``place`` has placed
    along this order, or along one it refines, keep their place columns.
    """
    keys = list(keys)
    placed = BLOCK in df.columns
    base = df if placed else place(df, keys, order, splits)
    outputs = [m.name for m in measures]
    names = [c for c in base.columns if c not in outputs]
    okeys = [f"_scan_o{i}" for i in range(len(order))]
    base = base.withColumns({**{f"_scan_m_{m.name}": m.value.cast(m.dtype) for m in measures},
                             **dict(zip(okeys, _columns(order)))})

    totals = base.filter(EDGE).groupBy(*keys, BLOCK).agg(
        *[_summary(m, F.struct(*okeys)).alias(f"_scan_m_{m.name}") for m in measures])
    along = Window.partitionBy(*keys).orderBy(BLOCK)
    carried = totals.select(
        *[F.col(k).alias(f"_scan_k{i}") for i, k in enumerate(keys)], F.col(BLOCK).alias("_scan_into"),
        *[_over(m, F.col(f"_scan_m_{m.name}"), along, False).alias(f"_scan_c_{m.name}") for m in measures])

    window = Window.partitionBy(*keys, BLOCK).orderBy(*okeys)
    here = base.select("*", *[_over(m, F.col(f"_scan_m_{m.name}"), window, True).alias(f"_scan_h_{m.name}") for m in measures])
    same = _same(keys) & (F.col(BLOCK) == F.col("_scan_into"))
    met = here.join(F.broadcast(carried), same, "left")
    return met.select(*[c for c in names if placed or c not in (BLOCK, EDGE)], *[
        _joined(m, F.col(f"_scan_h_{m.name}"), F.col(f"_scan_c_{m.name}")).alias(m.name) for m in measures])


def walk(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], measures: Sequence[Measure]) -> DataFrame:
    """``scan`` for keys whose rows are few by what they are, such as the months of an account: one plain window."""
    window = Window.partitionBy(*keys).orderBy(*order)
    outputs = {m.name: _over(m, m.value.cast(m.dtype), window, True) for m in measures}
    zero = {m.name for m in measures if m.kind in ("sum", "sum_before")}
    return df.withColumns({n: F.coalesce(c, F.lit(0)) if n in zero else c for n, c in outputs.items()}) \
        .withColumns({m.name: F.col(m.name).cast(m.dtype) for m in measures})


def unplaced(df: DataFrame) -> DataFrame:
    """Without the columns of ``place``."""
    return df.drop(BLOCK, EDGE)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str,
             splits: int = SPLITS) -> DataFrame:
    """``row_number`` that survives a crowded key."""
    return scan(df, keys, order, [position(name)], splits)
