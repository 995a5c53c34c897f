"""From raw documents to packed training sequences, one operator a stage.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and
read again as the next one's ``docs``.  All but the last return the columns of
``documents``:

1. quality rules: documents that the rules reject go;
2. MinHash near-dedup: one document of each group of near-duplicates stays;
3. substring dedup: passages that occur more than once are taken out of the texts;
4. secret scans: secrets are masked in the texts;
5. best-fit packing: documents become pieces of token sequences.

Nulls and edge cases are those of the operators: a row without text is rejected by the
first stage; an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallywise.llm import minhash, packing, quality_rules, secret_scan, substring_dedup
from tallywise.llm.common import documents, materialise


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.reject_rows(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.strip_repeats(docs, window=50)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("quality rules", good_documents), ("MinHash near-dedup", one_of_each), ("substring dedup", without_repeats),
          ("secret scans", without_secrets), ("best-fit packing", packed)]

#: SQL can state neither the estimate over shingle sets nor the packing; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
