"""A corpus from documents to packed training rows, in stages that each write a table for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from signalbox.llm import decontaminate, hostrules, minhash, mixing, packing
from signalbox.llm.staging import staged


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose host passes them too."""
    return hostrules.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by five-word shingles at a similarity of 0.8 or more, and of each doc_id."""
    return minhash.one_row_each(minhash.deduplicated(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of `benchmark`."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Smaller sources repeated, up to twice, towards equal weights; no document is left out. Rows come in random order."""
    mixed = mixing.mix_sources(docs, repetition=2.0).repartitionByRange("_order").sortWithinPartitions("_order")
    return mixed.select(*docs.columns)


def token_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of 2048 token ids."""
    return packing.packed_rows(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("token_packing", token_packing),
]
#: Signatures, permutations and token ids are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
