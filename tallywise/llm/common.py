"""Helpers the text operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: White space between words: space and the controls from tab to carriage return.
GAP = r"[\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there.

    A table that several jobs read is computed once, and a lost executor costs
    only the files it had not finished.
    """
    path = shared_dir(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: str, name: str, body: str) -> str:
    """SQL that evaluates ``value`` once and uses it as ``name`` in ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def words(text: Column) -> Column:
    """The words of a text; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP + "+"), "")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so the words of few texts are objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def look_up(rows: DataFrame, keys: list[str], spread: list[str], table: DataFrame, salts: int = 256) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row a key; rows without a match stay.

    A key may hold any share of the rows: they are dealt by key and a salt taken from
    the columns ``spread``, and each key meets ``table`` once a salt.  Both inputs are
    read twice and once, so hand in written tables where they are dear.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
    answers = salted.select(*keys, "_salt").distinct().join(table, keys)
    return salted.join(answers, [*keys, "_salt"], "left").drop("_salt")
