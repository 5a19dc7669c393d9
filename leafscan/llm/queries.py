"""The operators bound to the driver's tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import fuzzylines, hashtree, lattice, mil, mixing, oracles, rules, simhash, substring, tiling, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SHARDS = 16


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality(table(spark, sf_dir, "documents"))


def op4_attention_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mil.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.documents_scored(table(spark, sf_dir, "documents"))


def op7_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzylines.deduplicated(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashtree.shard(table(spark, sf_dir, "documents"), hashtree.even_tree(SHARDS), hashtree.even_tree(SHARDS + 1))


QUERIES = {f.__name__: f for f in (op1_warc, op2_compact_windows, op3_quality_rules, op4_attention_mil, op5_mixing, op6_lattice, op7_fuzzy_lines, op8_simhash, op9_tiling, op10_hash_tree)}
ORACLES = {"op1_warc": oracles.OP1, "op3_quality_rules": oracles.op3(rules.STOP_WORDS), "op10_hash_tree": oracles.op10(hashtree.even_tree(SHARDS), hashtree.even_tree(SHARDS + 1))}
