"""Ordered scans: cutting a crowded key into blocks changes nothing but the plan."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallywise.operators.statistics import at_positions
from tallywise.plans.scan import BLOCK, Measure, numbered, place, running_sum, scan, unplaced


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(7)
    data = []
    for i in range(600):
        key = "hot" if i % 3 else f"k{rnd.randrange(20)}"
        data.append((key, rnd.randrange(12), i, rnd.randrange(-50, 50), rnd.choice([None, rnd.randrange(9)])))
    return spark.createDataFrame(data, "k string, day int, id long, v int, w int").cache()


def measures():
    return [running_sum("run", F.col("v"), "bigint"), Measure("before", "sum_before", F.col("v"), "bigint"),
            Measure("top", "max", F.col("w"), "int"), Measure("prev", "prev", F.col("w"), "int"),
            Measure("next", "next", F.col("w"), "int")]


def plain(rows):
    w = Window.partitionBy("k").orderBy("day", "id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(
        "id", F.sum("v").over(upto).alias("run"),
        F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.max("w").over(upto).alias("top"),
        F.last("w", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("prev"),
        F.first("w", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("next"))


@pytest.mark.parametrize("splits", [64, 256, 4096])
def test_blocks_equal_plain_windows(rows, splits):
    got = scan(rows, ["k"], ["day", "id"], measures(), splits).select("id", "run", "before", "top", "prev", "next")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, plain(rows).collect()), key=str)


def test_null_keys_and_orders(spark):
    data = [(None if i % 3 else "a", None if i % 5 == 0 else i % 7, i, i, None) for i in range(300)]
    df = spark.createDataFrame(data, "k string, day int, id long, v int, w int")
    got = scan(df, ["k"], ["day", "id"], measures(), 64).select("id", "run", "before", "top", "prev", "next")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, plain(df).collect()), key=str)


def test_hashed_ids_of_one_key_are_cut_evenly(spark):
    """Nine tenths of the rows on one key, ordered by hashed ids: no block holds much."""
    df = spark.range(100_000).select(F.when(F.col("id") % 10 > 0, 0).otherwise(F.col("id")).alias("k"), F.xxhash64("id").alias("id"))
    sizes = [r["count"] for r in place(df, ["k"], ["id"], 1024).groupBy("k", BLOCK).count().collect()]
    assert sum(sizes) == 100_000 and max(sizes) < 100_000 / 1024 * 15


def test_nothing_runs_while_a_scan_is_built(spark, rows):
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "building")
    scan(rows, ["k"], ["day", "id"], measures())
    assert not jobs.getJobIdsForGroup("building")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_placed_rows_are_scanned_twice_over_one_order(rows):
    placed = place(rows, ["k"], ["day", "id"], 64)
    once = scan(placed, ["k"], ["day", "id"], measures()[:1])
    twice = unplaced(scan(once, ["k"], ["day", "id"], [Measure("prev", "prev", F.col("run"), "bigint")]))
    for key in ("hot", "k1"):
        run = sorted(((r.day, r.id, r.run, r.prev) for r in twice.collect() if r.k == key), key=lambda r: r[:2])
        assert [r[3] for r in run[1:]] == [r[2] for r in run[:-1]]


def test_numbering_does_not_depend_on_partitions(spark, rows):
    out = []
    for n in ("3", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = numbered(rows, ["k"], ["day", "id"], "n", 64)
        out.append(sorted((r.id, r.n) for r in got.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert out[0] == out[1]


def test_positions_in_a_crowded_group(spark):
    rnd = random.Random(3)
    values = [rnd.randrange(1, 90_000_000) / 10_000 for _ in range(401)]
    df = spark.createDataFrame([("a", v) for v in values], "g string, v double").withColumn("v", F.col("v").cast("decimal(20,10)"))
    row = at_positions(df, ["g"], "v", {"mid": F.floor(F.col("n") / 2) + 1, "low": F.lit(1), "high": F.col("n")}).first()
    ordered = sorted(values)
    assert (float(row.mid), float(row.low), float(row.high), row.n) == (ordered[200], ordered[0], ordered[-1], 401)
