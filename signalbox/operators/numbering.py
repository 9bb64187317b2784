"""Numbering rows in time order without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on `keys` in which NULL equals NULL; the keys come once, from the left."""
    renamed = right.withColumnsRenamed({k: f"_{k}_right" for k in keys})
    on = [left[k].eqNullSafe(renamed[f"_{k}_right"]) for k in keys]
    return left.join(renamed, on, how).drop(*(f"_{k}_right" for k in keys))


def numbered(df: DataFrame, out: str, ts: str, *ties: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Add `out` = 1, 2, ... in order of (`ts`, `ties`), over all rows or per `keys`.

    Rows are counted per second before any shuffle; the counts give every second
    its starting number, first day by day, then within the day. Only rows of one
    second are sorted together, so neither the whole table nor a hot key ends up
    in one task. The only ungrouped window holds one row per calendar day. Rows
    without time, or with a NULL key, are numbered too; those without time first.
    """
    keys = list(keys)
    stamped = df.withColumns(
        {"_day": F.date_trunc("day", ts), "_sec": F.date_trunc("second", ts)}
    )
    per_second = stamped.groupBy(*keys, "_day", "_sec").agg(F.count(F.lit(1)).alias("_n"))
    per_day = per_second.groupBy(*keys, "_day").agg(F.sum("_n").alias("_n"))
    before = (Window.unboundedPreceding, -1)
    days = per_day.select(
        *keys,
        "_day",
        F.coalesce(
            F.sum("_n").over(Window.partitionBy(*keys).orderBy("_day").rowsBetween(*before)),
            F.lit(0),
        ).alias("_day_base"),
    )
    seconds = per_second.withColumn(
        "_sec_base",
        F.coalesce(
            F.sum("_n").over(Window.partitionBy(*keys, "_day").orderBy("_sec").rowsBetween(*before)),
            F.lit(0),
        ),
    )
    bases = null_safe_join(seconds, days, [*keys, "_day"]).select(
        *keys, "_sec", (F.col("_sec_base") + F.col("_day_base")).alias("_base")
    )
    within = F.row_number().over(Window.partitionBy(*keys, "_sec").orderBy(ts, *ties))
    return (
        null_safe_join(stamped, bases, [*keys, "_sec"])
        .withColumn(out, (F.col("_base") + within).cast("bigint"))
        .select(*df.columns, out)
    )
