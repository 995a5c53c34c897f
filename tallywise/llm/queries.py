"""The operators as queries over ``documents``, with their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (archives, collocations, minhash, packing, ppm, quality_rules, secret_scan, shuffle, substring_dedup,
               surrogates, tries, unigram, winnowing)
from .common import documents


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(documents(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         "kept", F.round("quality", 4).alias("quality"))


def op2_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(documents(spark, sf_dir))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(documents(spark, sf_dir))


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace(documents(spark, sf_dir))


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compare_edited(documents(spark, sf_dir))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.components(documents(spark, sf_dir), shingle=4)


def op7_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return shuffle.assign(docs.select("doc_id", "text"), shards=40)


def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substring_dedup.remove_repeats(documents(spark, sf_dir), window=35)
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.round_trip(documents(spark, sf_dir))


def op11_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.shared_prefixes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(documents(spark, sf_dir), sample_by=("doc_id", "text"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_ppm_score, op3_secret_scan, op4_surrogates, op5_winnowing,
                                   op6_minhash, op7_shuffle, op8_best_fit, op9_substring_dedup, op10_pieces, op11_archives, op12_prefix_trie,
                                   op13_collocations, pipeline)}
ORACLE = {"op1_quality_rules": quality_rules.oracle(), "op11_archives": archives.oracle(), "op12_prefix_trie": tries.oracle(),
          "op13_collocations": collocations.oracle()}
