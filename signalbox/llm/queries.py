"""One registered query per operator, over whole tables with production settings, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbox.llm import audit, decontaminate, disclosure, hostrules, linecrf, minhash, mixing, negatives, packing, pstable, quotes, repeats, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


@query("op1_minhash")
def op1_minhash(spark, sf):
    return minhash.near_duplicates(_read(spark, sf, "documents"), k=4)


@query("op6_repeats")
def op6_repeats(spark, sf):
    return repeats.remove_repeats(_read(spark, sf, "documents"), with_text=False)


@query("op5_mixing")
def op5_mixing(spark, sf):
    mixed = mixing.mix_sources(_read(spark, sf, "documents"), repetition=2.0)
    return mixed.select(
        "doc_id",
        "source",
        F.col("_epoch").alias("epoch"),
        F.col("_block").alias("block"),
        F.col("_tokens").alias("n_tokens"),
        F.col("_weight").alias("weight"),
        F.col("_order").alias("shuffle_key"),
    )


@query("op7_decontaminate")
def op7_decontaminate(spark, sf):
    return decontaminate.find_leaks(_read(spark, sf, "documents"), _read(spark, sf, "benchmark"))


@query("op9_packing")
def op9_packing(spark, sf):
    return packing.packed_rows(_read(spark, sf, "documents"))


@query("op4_hostrules", hostrules.ORACLE)
def op4_hostrules(spark, sf):
    return hostrules.judged(_read(spark, sf, "documents"), carry=("doc_id",))


@query("op2_toxicity")
def op2_toxicity(spark, sf):
    scored = toxicity.toxicity(_read(spark, sf, "documents"), _read(spark, sf, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query("op3_linecrf")
def op3_linecrf(spark, sf):
    scored = linecrf.quality(_read(spark, sf, "documents"), _read(spark, sf, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query("op10_disclosure")
def op10_disclosure(spark, sf):
    return disclosure.sanitised(_read(spark, sf, "documents"), with_text=False)


@query("op8_quotes", quotes.ORACLE)
def op8_quotes(spark, sf):
    linked = quotes.link_quotes(_read(spark, sf, "conversations"))
    return linked.withColumn("text_md5", F.md5("text")).drop("text")


@query("op12_audit", audit.ORACLE)
def op12_audit(spark, sf):
    return audit.audit_documents(_read(spark, sf, "documents"), _read(spark, sf, "labels"))


@query("op13_negatives", negatives.ORACLE)
def op13_negatives(spark, sf):
    return negatives.hard_negatives(negatives.shifted_labels(_read(spark, sf, "embeddings")), "vec_id % 50 = 0")


@query("op11_pstable", pstable.ORACLE)
def op11_pstable(spark, sf):
    return pstable.near_vectors(_read(spark, sf, "embeddings"), cosine=0.95)
