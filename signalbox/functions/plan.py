"""Control over how often an expression is computed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column) -> Column:
    """`value`, computed in one place only.

    A filter above a projection is normally pushed through it by copying the
    expressions it refers to. For columns that build on each other (JSON parts,
    redaction steps) the copies multiply with every layer, in the plan and at
    run time. The partition id test is always true, but counts as
    non-deterministic, and filters stay above such a projection. Filters on
    input columns belong before these stages, where they reach the scan.
    """
    return F.when(F.spark_partition_id() >= 0, value)
