"""The corpus pipeline: language ID, toxicity, near-duplicates, decontamination, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame that is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridframe.llm import decontaminate, language, near_dup, packing, toxicity
from gridframe.session import scratch_path


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; rejected ones go."""
    found = language.identify(docs.select(F.struct("*").alias("doc"), "text"), language.fit(docs), keep=["doc"])
    return found.where(~F.col("rejected")).select("doc.*")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic; those with a score of 0.5 or more go."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.classify(docs.select(F.struct("*").alias("doc"), "text"), model, keep=["doc"])
    return scored.where("predicted = 0").select("doc.*")


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that of the least id. Two texts
    of one id are two documents; rows that repeat id and text are one. Rows without
    an id have no class and stay."""
    keyed = docs.where(F.col("doc_id").isNotNull()).withColumn("_gf_key", F.xxhash64("doc_id", F.col("text").isNull(), "text"))
    ids = keyed.groupBy("_gf_key").agg(F.min("doc_id").alias("low"))
    classes = near_dup.near_duplicates(keyed, id_col="_gf_key").select(F.col("doc_id").alias("_gf_key"), "class_id")
    stay = classes.join(ids, "_gf_key").groupBy("class_id").agg(F.min(F.struct("low", "_gf_key")).alias("first")).select("first._gf_key")
    chosen = keyed.join(stay, "_gf_key", "left_semi").dropDuplicates(["_gf_key"]).select(docs.columns)
    return chosen.union(docs.where(F.col("doc_id").isNull()))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item. Rows without an id are
    judged under a stand-in id of their text."""
    named = docs.withColumn("_gf_id", F.coalesce("doc_id", F.xxhash64("text")))
    found = decontaminate.contaminated(named, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="_gf_id")
    dirty = found.select(F.col("doc_id").alias("_gf_id")).distinct()
    return named.join(dirty, "_gf_id", "left_anti").select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents in packed windows."""
    return packing.pack(docs)


STAGES = [
    ("language", language_stage),
    ("toxicity", toxicity_stage),
    ("near_dup", near_dup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: classifiers, signatures and tokenizers are not SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        path = scratch_path(spark, f"pipeline-{i}-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
