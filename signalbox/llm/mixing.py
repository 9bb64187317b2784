"""Sources mixed to target weights: shares to a power, and whole documents drawn block by block."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from signalbox.llm.staging import staged

#: Documents of a block, and exponents tried in one pass over the table of sources.
BLOCK_DOCS, TRIED, PASSES = 1_000, 33, 4


def word_count(text: Column) -> Column:
    """Words between white space; a null text has none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, "[ \t\n\x0b\f\r]+"))).cast("long")


def find_exponent(sources: DataFrame, entropy: float | None = None, repetition: float | None = None) -> float:
    """The exponent in 0..1, closest to 1, whose shares have the `entropy` (as a fraction of the largest
    possible) or, of those that repeat no source more than `repetition` times, the smallest.

    `sources` has (share). Each pass cuts the interval into `TRIED` - 1 parts by one aggregation,
    so only `TRIED` numbers reach the driver and any number of sources can be handled. Without a
    target the exponent is 1; a target out of reach gives the nearest end, 0 or 1.
    """
    if entropy is None and repetition is None:
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        tried = [low + (high - low) * i / (TRIED - 1) for i in range(TRIED)]
        logs = F.log("share")
        sums = []
        for i, x in enumerate(tried):
            power = F.exp(x * logs)
            sums += [F.sum(power).alias(f"z{i}"), F.sum(power * logs).alias(f"l{i}")]
        row = sources.agg(*sums, F.count(F.lit(1)).alias("n"), F.min("share").alias("least"), F.max("share").alias("most")).first()
        if row["n"] < 2:
            return 1.0

        def fits(i: int, x: float) -> bool:
            """True from the sought exponent upwards (repetition), or downwards (entropy)."""
            if entropy is not None:
                return math.log(row[f"z{i}"]) - x * row[f"l{i}"] / row[f"z{i}"] >= entropy * math.log(row["n"])
            return (row["most"] / row["least"]) ** (1 - x) <= repetition

        good = [i for i, x in enumerate(tried) if fits(i, x)]
        if entropy is not None:
            if not good:
                return low
            i = max(good)
            low, high = tried[i], tried[min(i + 1, TRIED - 1)]
        else:
            if not good:
                return high
            i = min(good)
            low, high = tried[max(i - 1, 0)], tried[i]
    return low if entropy is not None else high


def mix_sources(
    docs: DataFrame, entropy: float | None = None, repetition: float | None = None, budget: int | None = None, seed: int = 7, block_docs: int = BLOCK_DOCS
) -> DataFrame:
    """`docs` (doc_id, text, source and any others) with rows repeated, or left out, to meet the weights.

    A source's weight is its share of the tokens to the power of `find_exponent`, made to sum to 1.
    It gets weight * budget tokens; the default `budget` is the smallest for which no source loses
    a document. Of a source to be seen 2.3 times, every document comes twice, and of each block of
    about `block_docs` documents a random permutation is taken until 0.3 of the block's tokens are
    reached, to the nearest document. Blocks are random parts of a source, so a source with a third
    of all rows is spread over many tasks, and every block keeps its own budget.

    Added columns: `_epoch` (1, 2, ...), `_block`, `_tokens`, `_weight`, `_order` (a random number by
    which to shuffle). Tokens are words. A null source is a source of its own; rows without words
    take no part in the weights and come once. Rows that repeat a document are drawn on their own,
    in no order of importance. Columns of these names in `docs` are replaced.
    """
    docs = docs.drop("_epoch", "_block", "_tokens", "_weight", "_order").withColumn("_tokens", word_count(F.col("text")))
    counted = docs.where("_tokens > 0").groupBy(F.col("source").alias("_source"))
    sources = staged(counted.agg(F.sum("_tokens").alias("_total"), F.count(F.lit(1)).alias("_docs")), "sources")
    total = sources.agg(F.sum("_total").alias("t")).first()["t"] or 1
    sources = sources.withColumn("share", F.col("_total") / F.lit(total))
    x = find_exponent(sources, entropy, repetition)
    power = F.pow("share", F.lit(x))
    z, least = sources.agg(F.sum(power), F.min(F.pow("share", F.lit(x - 1)))).first()
    z, least = z or 1.0, least or 1.0
    times = power / F.col("share") / F.lit(least) if budget is None else power / F.lit(z) * F.lit(float(budget)) / F.col("_total")
    sources = sources.select(
        "_source",
        (power / F.lit(z)).alias("_weight"),
        F.round(times, 9).alias("_times"),
        F.ceil(F.col("_docs") / block_docs).cast("int").alias("_blocks"),
    )
    rows = docs.join(sources, F.col("source").eqNullSafe(F.col("_source")), "left")
    rows = rows.withColumn("_order", F.xxhash64(F.lit(seed), "doc_id", "text"))
    rows = rows.withColumn("_block", F.when(F.col("_tokens") > 0, F.pmod(F.xxhash64(F.lit(seed + 1), "_order"), F.col("_blocks")).cast("int")))
    # Rows without words are dealt by their number alone; they need no window's order.
    spread = F.when(F.col("_tokens") > 0, F.lit(0)).otherwise(F.pmod("_order", F.lit(1 << 20)))
    block = Window.partitionBy("source", "_block", spread)
    before = F.sum("_tokens").over(block.orderBy("_order", "doc_id", "_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_tokens")
    part = F.col("_times") - F.floor("_times")
    drawn = before + F.col("_tokens") / 2 <= part * F.sum("_tokens").over(block)
    copies = F.floor("_times") + F.when(drawn & (part > 0), 1).otherwise(0)
    rows = rows.withColumn("_epoch", F.when(F.col("_tokens") > 0, copies.cast("int")).otherwise(1))
    rows = rows.where("_epoch > 0").withColumn("_epoch", F.explode(F.sequence(F.lit(1), "_epoch")))
    return rows.withColumn("_order", F.xxhash64("_order", "_epoch")).drop("_source", "_times", "_blocks")
