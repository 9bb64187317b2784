"""A join that holds up when one key has a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16


def salted_join(
    big: DataFrame,
    unique: DataFrame,
    keys: list[str],
    how: str,
    spread: Column,
    salts: int = SALTS,
) -> DataFrame:
    """Join `big` with `unique` (at most one narrow row per key), cutting keys into `salts`.

    `spread` is a column of `big` that varies within a key. `how` is inner, left,
    left_semi or left_anti, seen from `big`. There is no broadcast hint: adaptive
    execution measures `unique` and broadcasts it if it is small; if it is not,
    a hot key is spread over `salts` tasks, and further by the skew-join rule.
    """
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copies = unique.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")
