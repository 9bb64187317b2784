"""Labelled documents and fits over them: whole tables, cut into shards that tasks learn from, and bounded samples."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalbox.llm.staging import staged

#: Labelled documents that one task learns from at a time, about.
SHARD = 8_000
#: Pieces that the scores of one language are cut into to be ordered.
_SLOTS = 256

def held_out(doc_id) -> F.Column:
    """True for a quarter of all documents, by the checksum of the id; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def known_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y) of every document with a label 0 or 1 that is not held out; of several labels the largest."""
    known = labels.where(f"doc_id IS NOT NULL AND {label} IS NOT NULL").groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    return known.where(~held_out("doc_id") & F.col("y").isin(0, 1))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, shard: int = SHARD) -> DataFrame:
    """(shard, doc_id, text, lang, y) of every labelled document that is not held out.

    Which shard a document is in depends on its id and the number of labels alone, not on files or
    partitions. Of rows that repeat an id the smallest by text (then by lang) is taken, null before any other.
    """
    known = known_labels(labels, label)
    shards = max(1, -(-known.count() // shard))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.cast("string").alias("lang"))
    rows = rows.where(F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    met = rows.join(known, "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("first"), F.min("y").alias("y"))
    return met.select(F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"), "doc_id", "first.text", "first.lang", "y")


def sample(docs: DataFrame, labels: DataFrame, label: str, each: int) -> tuple[pd.DataFrame, np.ndarray]:
    """(text, lang, y) of at most `each` labelled documents of each class, and weights to undo the choice.

    Only documents that are not held out are taken, in the order of a hash of their ids. The ids
    are chosen from `labels` alone, so what is broadcast to find their texts is bounded by `each`.
    Null labels and ids are passed over; an id with several labels counts with the largest. Of rows
    that repeat an id the smallest by text (then by lang) is taken, null before any other, so at most
    2 * `each` rows reach the driver.
    """
    known = labels.where(f"doc_id IS NOT NULL AND {label} IS NOT NULL").groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    known = known.where(~held_out("doc_id"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect() if r["y"] in (0, 1)}
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each) for y in (0, 1)]
    chosen = F.broadcast(parts[0].union(parts[1]))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.cast("string").alias("lang"))
    met = rows.join(chosen, "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("first"), F.min("y").alias("y"))
    found = met.select("doc_id", "first.text", "first.lang", "y").toPandas().sort_values("doc_id", ignore_index=True)
    weight = np.ones(len(found))
    for y in (0, 1):
        taken = (found["y"] == y).to_numpy()
        if taken.any():
            weight[taken] = counts[y] / taken.sum()
    return found[["text", "lang", "y"]], weight


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights and, last, the bias of a ridge logistic regression, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    if not len(x):
        return w
    weight = weight / weight.mean()
    keep = np.full(len(w), ridge)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (weight * (p - y)) + keep * w)
        size = np.abs(step).max()
        w -= step * min(1, 5 / max(size, 1e-12))
        if size < 1e-8:
            break
    return w


def logistic(x: list[str], w: np.ndarray) -> F.Column:
    """The probability that weights of `fit_logistic` give to a row with columns `x`."""
    z = F.lit(float(w[-1]))
    for name, value in zip(x, w[:-1], strict=True):
        z = z + F.col(name) * float(value)
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))


def fit_logistic_table(rows: DataFrame, x: list[str], ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """`fit_logistic` over a table with columns `x` and `y`, which Spark sums for each Newton step."""
    w = np.zeros(len(x) + 1)
    keep = np.full(len(w), ridge)
    inputs = [*map(F.col, x), F.lit(1.0)]
    some = [(i, j) for i in range(len(w)) for j in range(i + 1)]
    for _ in range(steps):
        p = rows.withColumn("p", logistic(x, w))
        slopes = [F.sum(inputs[i] * (F.col("p") - F.col("y"))) for i in range(len(w))]
        bends = [F.sum(inputs[i] * inputs[j] * F.col("p") * (1 - F.col("p"))) for i, j in some]
        sums = [v or 0.0 for v in p.agg(*slopes, *bends).first()]
        curve = np.zeros((len(w), len(w)))
        for (i, j), v in zip(some, sums[len(w) :], strict=True):
            curve[i, j] = curve[j, i] = v
        step = np.linalg.solve(curve + np.diag(keep), np.array(sums[: len(w)]) + keep * w)
        size = np.abs(step).max()
        w -= step * min(1, 5 / max(size, 1e-12))
        if size < 1e-8:
            break
    return w


def best_thresholds(rows: DataFrame, least: int = 20, slots: int = _SLOTS) -> DataFrame:
    """(lang, threshold): half-way below the score from which on F1 is best, over all of `rows` (lang, score, y).

    The row with a null lang is that of all rows; a language with fewer than `least` rows of either
    class has none. Scores are ordered within `slots` pieces of about equal size, and the counts of the
    pieces above are added, so no task orders all scores of a language.
    """
    keys = F.array(F.lit(""), F.concat(F.lit("="), F.col("lang")))
    keyed = rows.select(F.explode(keys).alias("key"), "score", "y").where("key IS NOT NULL")
    met = staged(keyed.groupBy("key", "score").agg(F.sum("y").alias("hits"), F.count("y").alias("n")), "scores")
    edges = staged(met.groupBy("key").agg(F.percentile_approx("score", [i / slots for i in range(1, slots)], 10_000).alias("edges")), "score_edges")
    slot = F.size(F.filter("edges", lambda e: e <= F.col("score")))
    met = staged(met.join(edges, "key").select("key", "score", "hits", "n", slot.alias("slot")), "score_slots")
    down = Window.partitionBy("key").orderBy(F.desc("slot"))
    above = down.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("key")
    pieces = met.groupBy("key", "slot").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n"), F.max("score").alias("top"))
    pieces = pieces.select(
        "key", "slot", F.coalesce(F.sum("hits").over(above), F.lit(0)).alias("hits_above"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n_above"),
        F.lead("top", 1, 0.0).over(down).alias("below"), F.sum("hits").over(whole).alias("all_hits"), F.sum("n").over(whole).alias("all_n"),
    )
    within = Window.partitionBy("key", "slot").orderBy(F.desc("score"))
    met = met.join(pieces, ["key", "slot"])
    f1 = 2 * (F.sum("hits").over(within) + F.col("hits_above")) / (F.sum("n").over(within) + F.col("n_above") + F.col("all_hits"))
    met = met.select("key", "score", "all_hits", "all_n", f1.alias("f1"), F.coalesce(F.lead("score").over(within), "below").alias("next"))
    best = met.groupBy("key").agg(F.max(F.struct("f1", "score", "next")).alias("best"), F.first("all_hits").alias("hits"), F.first("all_n").alias("n"))
    best = best.where((F.col("key") == "") | (F.least(F.col("hits"), F.col("n") - F.col("hits")) >= least))
    lang = F.when(F.col("key") != "", F.substring("key", 2, 1 << 30))
    return staged(best.select(lang.alias("lang"), ((F.col("best.score") + F.col("best.next")) / 2).alias("threshold")), "thresholds")
