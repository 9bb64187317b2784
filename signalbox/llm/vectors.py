"""Vector columns as plain bytes, and one row for each id."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbox.llm.staging import staged


def sound(vector: Column) -> Column:
    """True for a vector without null and non-finite components; null for a null vector."""
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def one_of_each(rows: DataFrame, key: str, *by: str) -> DataFrame:
    """`rows` (written before: read twice) with, of those that repeat `key`, only the smallest by the columns `by`, which are all others.

    Repeated keys are found without the other columns; only their rows are aggregated, task by task first.
    """
    twice = staged(rows.groupBy(key).count().where("count > 1").select(key), "repeated_keys")
    again = rows.join(twice, key, "left_semi").groupBy(key).agg(F.min(F.struct(*by)).alias("least"))
    return rows.join(twice, key, "left_anti").select(key, *by).union(again.select(key, *(F.col("least")[c] for c in by)))


def _packed(batches: Iterator[pa.RecordBatch], dtype: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = batch.column("v")
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(dtype)
        ends = np.concatenate([[0], np.cumsum(vectors.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        raw = [flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(raw, pa.binary())], ["vec_id", "v"])


def packed(rows: DataFrame, dtype: str) -> DataFrame:
    """(vec_id, v binary) of (vec_id, v array) without null components."""
    return rows.mapInArrow(partial(_packed, dtype=dtype), "vec_id long, v binary")


def units(raw, dtype: str, dims: int) -> np.ndarray:
    """Packed vectors as rows of length 1, in double precision; shorter ones are filled up with zeros."""
    out = np.zeros((len(raw), dims))
    for i, one in enumerate(raw):
        v = np.frombuffer(one, dtype)
        out[i, : len(v)] = v
    out /= np.abs(out).max(axis=1, initial=1e-320, keepdims=True)
    out /= np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out


def added(group: pd.DataFrame, key: str, value: str) -> pd.DataFrame:
    """The sum of the packed double vectors of one key, made length 1."""
    total = np.sum([np.frombuffer(x, "<f8") for x in group[value]], axis=0)
    size = np.sqrt((total * total).sum())
    return pd.DataFrame({key: group[key].iloc[:1].to_numpy(), value: [(total / size if size else total).tobytes()]})
