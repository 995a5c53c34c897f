"""Sharding by a two-pass external shuffle.

Pass one scatters rows into buckets by seeded hashes.  A row's shard is the one whose
hash with the row's id is highest, so the id and the number of shards decide, and one
more shard takes rows from all others and moves nothing else.  A shard is cut into
buckets small enough for memory by another seeded hash.

Pass two takes one bucket at a time, puts its rows in a fixed order, shuffles them by
Fisher-Yates with the seed, and numbers them.  A bucket's first slot is the number of
rows in the shard's buckets before it.

The shuffle draws from a generator that starts anew in every partition, so buckets
are dealt to a fixed number of partitions and sorted there: a task that is run again
repeats its order.

Nulls and edge cases: a null text is an empty one; a null id is dealt by the text
alone; rows that repeat differ in nothing and take neighbouring draws; a row may be
larger than a bucket is meant to be; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

SEED = 20260101
#: Row bytes meant for one bucket.
BUCKET_BYTES = 16 << 20


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """The shard whose seeded hash with ``key`` is highest."""
    draws = [F.struct(F.xxhash64(key, F.lit(seed), F.lit(s)).alias("draw"), F.lit(s).alias("shard")) for s in range(shards)]
    return (F.greatest(*draws) if shards > 1 else draws[0])["shard"]


def scatter(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """``docs`` as ``row``, with its size, its shard now and with one more shard, and a draw for its bucket."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.concat(F.lit("text "), F.md5(text.cast("binary"))))
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        shard_of(key, shards, seed).alias("shard"), shard_of(key, shards + 1, seed).alias("grown_shard"),
        F.xxhash64(key, F.lit(seed + 1)).alias("draw"))


def _shuffled(scattered: DataFrame, payload: list[str], shards: int, seed: int, bucket_bytes: int) -> DataFrame:
    total = scattered.agg(F.sum("size")).first()[0] or 0
    cuts = max(1, -(-total // (shards * bucket_bytes)))
    buckets = shards * cuts
    rows = scattered.withColumn("bucket", (F.col("shard") * cuts + F.pmod(F.xxhash64("draw"), F.lit(cuts))).cast("int"))

    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # A table of buckets, not of rows.
    first = counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))

    held = rows.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("draw", *payload))).alias("rows"))
    dealt = held.join(first, "bucket").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.select("first", F.posexplode(F.shuffle("rows", F.lit(seed))).alias("at", "x")).select(
        *[F.col(f"x.{c}").alias(c) for c in payload], (F.col("first") + F.col("at")).alias("slot"))


def assign(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED,
           bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per document: its shard, its slot there, and its shard if there were one more."""
    scattered = scatter(docs, shards, id_col, text_col, seed).withColumn("doc_id", F.col(f"row.`{id_col}`"))
    payload = ["doc_id", "size", "text_crc32", "shard", "grown_shard"]
    placed = _shuffled(materialise(scattered.select(*payload, "draw"), "scattered"), payload, shards, seed, bucket_bytes)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write(docs: DataFrame, path: str, shards: int, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED,
          bucket_bytes: int = BUCKET_BYTES) -> None:
    """Writes whole rows to ``path``, one folder per shard, each file a run of slots in order."""
    scattered = scatter(docs, shards, id_col, text_col, seed)
    placed = _shuffled(scattered, ["row", "shard"], shards, seed, bucket_bytes)
    placed.select("row.*", F.col("slot").alias("_slot"), F.col("shard").alias("_shard")) \
        .write.partitionBy("_shard").parquet(path)
