"""Connected components of an edge table: union-find inside each task, star contraction between tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbox.llm.staging import staged


def _forest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over one task's edges: one edge from each node to its smallest relative there."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for part in parts:
        for u, v in zip(part["u"].tolist(), part["v"].tolist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if root(x) != x]
    for i in range(0, len(nodes), 100_000):
        part = nodes[i : i + 100_000]
        yield pd.DataFrame({"u": part, "v": [root(x) for x in part]})


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of `edges` (u, v: long) that is not its component's smallest.

    The component is the smallest node reachable. Each round hangs every node's neighbours
    under the smallest of them, first the larger ones, then the smaller ones, until nothing
    changes; the number of rounds grows with the logarithm of the longest path. Only a count
    and a checksum reach the driver.
    """
    stars = staged(edges.where("u IS NOT NULL AND v IS NOT NULL AND u != v").select("u", "v").mapInPandas(_forest, "u long, v long"), "forest")
    sign = None
    while True:
        sums = stars.select(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sums == sign:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
        sign = sums
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        stars = staged(
            small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(small.select("u", F.col("m").alias("v"))).where("u != v").distinct(),
            "stars",
        )
