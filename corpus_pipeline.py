"""Pipeline over ``documents``: quality rules, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept; all but the last
return the columns of ``docs``.  doc_id names a document: rows with equal ids share its fate, and the
near-duplicate stage leaves one of them.  A row with a null doc_id is named by a hash of its values,
above 2^62, so it is judged like any other and yields to a copy that has an id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafscan.llm import hashtree, mixing, rules, simhash, tiling
from leafscan.llm.storage import saved

SHARDS = 16


def _named(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__id``: doc_id, or for null a hash of the row above 2^62."""
    own = F.xxhash64(*docs.columns).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    return docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), own))


def _by_id(named: DataFrame) -> DataFrame:
    """The same rows with ``__id`` as doc_id, for an operator."""
    return named.withColumn("doc_id", F.col("__id")).drop("__id")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; null and empty texts are rejected."""
    judged = rules.judged(docs.withColumn("__row", F.struct(*docs.columns)))
    return judged.where("kept").select("__row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the least id stays."""
    named = _named(docs)
    found = simhash.near_duplicates(_by_id(named))
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__id")).distinct()
    left = named.join(gone, "__id", "left_anti").select(*named.columns)
    # these read the ids alone
    if docs.where("doc_id is null").isEmpty() and docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return left.select(*docs.columns)
    return left.groupBy("__id").agg(F.min(F.struct(*docs.columns)).alias("r")).select("r.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover an item of ``benchmark`` go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    named = _named(docs)
    leaked = tiling.leaks(_by_id(named), benchmark).select(F.col("doc_id").alias("__id")).distinct()
    return named.join(leaked, "__id", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the calibrated draw leaves out go."""
    named = _named(docs)
    out = mixing.mix(_by_id(named)).where(~F.col("kept")).select(F.col("doc_id").alias("__id")).distinct()
    return named.join(out, "__id", "left_anti").select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document left."""
    return hashtree.shard(docs, hashtree.even_tree(SHARDS), hashtree.even_tree(SHARDS + 1))


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mix),
    ("sharding", sharding),
]

#: Fingerprint components and tilings are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result is stored in the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, name.replace(" ", "-"))
    return docs
