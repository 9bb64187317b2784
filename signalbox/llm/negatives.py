"""Hard negatives: rows of another label that score close to, but below, an anchor's positives.

Rows are cut into slabs by their first coordinate, the first step of sort-tile-recursive packing;
each slab is one block, packed further within its task into an R-tree over all rows of the block. A
node's minimum bounding box gives an interval that holds the inner product of an anchor with every
row below it: coordinate by coordinate the smaller and the larger end. A best-first queue takes the
boxes by their upper ends and drops those outside the score windows and those strictly below the
k-th best score so far; a box level with it stays, as a smaller id wins a tie.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalbox.llm.staging import staged
from signalbox.llm.vectors import one_of_each, sound

#: Rows of one block, anchors that meet a block in one task, rows of a leaf and children of a node.
BLOCK, ANCHORS, LEAF, FAN = 8192, 1024, 512, 8
#: More cells than this share tasks.
MAX_TASKS = 10_000
_EXACT, _EXACT_FLOAT, _INT, _LONG = 2.0**53, 2.0**24, 2**31 - 1, 2**63 - 1


def tile_order(x: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Sort-tile-recursive order of the rows of `x`: sorted by a coordinate, cut into slabs, each slab by the next one."""
    pages = -(-len(x) // leaf)
    dims = min(x.shape[1], max(1, math.ceil(math.log2(max(2, pages)))))

    def tile(rows: np.ndarray, d: int) -> np.ndarray:
        here = -(-len(rows) // leaf)
        if here <= 1 or d >= dims:
            return rows
        rows = rows[np.argsort(x[rows, d], kind="stable")]
        slabs = max(1, round(here ** (1 / (dims - d))))
        size = leaf * -(-here // slabs)
        return np.concatenate([tile(rows[i : i + size], d + 1) for i in range(0, len(rows), size)])

    return tile(np.arange(len(x)), 0) if x.shape[1] else np.arange(len(x))


class RTree:
    """An R-tree packed by `tile_order`; `x` are whole numbers as doubles."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, leaf: int = LEAF, fan: int = FAN):
        order = tile_order(x, leaf)
        self.x, self.ids, self.labels, self.leaf, self.fan = x[order], ids[order], labels[order], leaf, fan
        self.most = float(np.abs(x).max(initial=0)) * x.shape[1]
        self.x32 = self.x.astype(np.float32)
        at = np.arange(0, len(x), leaf)
        self.boxes = [(np.minimum.reduceat(self.x, at), np.maximum.reduceat(self.x, at))] if len(x) else []
        while self.boxes and len(self.boxes[-1][0]) > 1:
            low, high = self.boxes[-1]
            at = np.arange(0, len(low), fan)
            self.boxes.append((np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))

    def interval(self, level: int, first: int, last: int, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper ends of the scores below the nodes first .. last - 1 of a level."""
        low, high = (side[first:last] for side in self.boxes[level])
        if self.most * np.abs(q).max(initial=0) >= _EXACT:
            return np.full(last - first, -np.inf), np.full(last - first, np.inf)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        return low @ up + high @ down, high @ up + low @ down

    def scores(self, rows: slice, q: np.ndarray) -> np.ndarray:
        """Exact inner products, as floats while these cannot round, then by whole numbers, cut to the ends of a long."""
        size = self.most * np.abs(q).max(initial=0)
        if size < _EXACT_FLOAT:
            return self.x32[rows] @ q.astype(np.float32)
        if size < _EXACT:
            return self.x[rows] @ q
        whole = [[int(v) for v in row] for row in self.x[rows]]
        other = [int(v) for v in q]
        return np.array([max(-_LONG - 1, min(_LONG, sum(a * b for a, b in zip(row, other, strict=True)))) for row in whole], np.int64)

    def search(self, q: np.ndarray, windows: list[tuple[int, int]], k: int, able) -> tuple[list[list[tuple[int, int]]], int]:
        """For each window (lowest, highest score) the first k (score, id) by higher score, then smaller id.

        `able(ids, labels)` says which rows count. Also returned: how many leaves were opened.
        """
        best: list[list[tuple[int, int]]] = [[] for _ in windows]
        need = [low for low, _ in windows]
        least, most, opened = min(need, default=0), max((high for _, high in windows), default=0), 0
        heap: list[tuple[float, int, int]] = [(-math.inf, len(self.boxes) - 1, 0)] if self.boxes and windows else []
        while heap and -heap[0][0] >= least:
            _, level, node = heapq.heappop(heap)
            if level:
                first, last = node * self.fan, min((node + 1) * self.fan, len(self.boxes[level - 1][0]))
                down, up = self.interval(level - 1, first, last, q)
                for i in np.flatnonzero((up >= least) & (down <= most)).tolist():
                    if any(up[i] >= n and down[i] <= high for n, (_, high) in zip(need, windows, strict=True)):
                        heapq.heappush(heap, (-float(up[i]), level - 1, first + i))
                continue
            opened += 1
            rows = slice(node * self.leaf, (node + 1) * self.leaf)
            score = self.scores(rows, q)
            at = np.flatnonzero((score >= least) & (score <= most))
            at = at[able(self.ids[rows][at], self.labels[rows][at])]
            if not len(at):
                continue
            score, ids = score[at].astype(np.int64), self.ids[rows][at]
            for w, (_, high) in enumerate(windows):
                hit = (score >= need[w]) & (score <= high)
                if hit.any():
                    best[w] = sorted([*best[w], *zip(score[hit].tolist(), ids[hit].tolist(), strict=True)], key=lambda x: (-x[0], x[1]))[:k]
                    if len(best[w]) == k:
                        need[w] = max(need[w], best[w][-1][0])
            least = min(need)
        return best, opened


def _whole(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = batch.column("vector")
        flat = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
        flat = np.clip(flat, -_INT, _INT).astype("<i4")
        ends = np.concatenate([[0], np.cumsum(vectors.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        raw = [flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        first = [int(flat[a]) if b > a else 0 for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), batch.column("label"), pa.array(first, pa.int32()), pa.array(raw, pa.binary())], ["vec_id", "label", "first", "q"]
        )


def _matrix(parts: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(parts), dims))
    for i, raw in enumerate(parts):
        v = np.frombuffer(raw, "<i4")
        out[i, : len(v)] = v
    return out


def _both(anchors: pd.DataFrame, rows: pd.DataFrame) -> tuple[RTree, np.ndarray]:
    dims = max(len(raw) // 4 for part in (anchors["anchor_q"], rows["q"]) for raw in part)
    return RTree(_matrix(rows["q"], dims), rows["vec_id"].to_numpy(), rows["label"].to_numpy()), _matrix(anchors["anchor_q"], dims)


def _near_same(anchors: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """A block's first k rows of each anchor's own label."""
    found = []
    if len(anchors) and len(rows):
        tree, q = _both(anchors, rows)
        for own, label, v in zip(anchors["anchor_id"].tolist(), anchors["own_label"].tolist(), q, strict=True):
            (best,), _ = tree.search(v, [(-_LONG - 1, _LONG)], k, lambda ids, labels: (labels == label) & (ids != own))  # noqa: B023
            found += [(own, i, s) for s, i in best]
    return pd.DataFrame(found, columns=["anchor_id", "positive_id", "positive_score"]).astype("int64")


def _near_other(anchors: pd.DataFrame, rows: pd.DataFrame, k: int, low: int, high: int) -> pd.DataFrame:
    """A block's first k rows of other labels in the window of each of an anchor's positives."""
    found = []
    if len(anchors) and len(rows):
        tree, q = _both(anchors, rows)
        for own, label, v, ids, scores in zip(anchors["anchor_id"].tolist(), anchors["own_label"].tolist(), q, anchors["positive_ids"], anchors["positive_scores"], strict=True):
            # low * p <= 100 * s <= high * p, in whole numbers.
            windows = [(-(-low * int(p) // 100), high * int(p) // 100) for p in scores]
            best, _ = tree.search(v, windows, k, lambda _, labels: labels != label)  # noqa: B023
            found += [(own, int(p), int(ps), i, s) for p, ps, each in zip(ids, scores, best, strict=True) for s, i in each]
    return pd.DataFrame(found, columns=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]).astype("int64")


def whole_vectors(rows: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id long, label long, first int, q binary) of the rows of `rows` (vec_id, label, embedding) that take part.

    q holds floor(scale * x) of each component as a little-endian int, cut to the ends of an int. Left out are rows
    with a null id, label or vector and those with a null or non-finite component. Of rows that repeat a vec_id the
    smallest by (label, first, q) stands for all.
    """
    vector = F.col("embedding").cast("array<double>")
    known = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), vector.alias("vector"), sound(vector).alias("sound"))
    known = known.where("vec_id IS NOT NULL AND label IS NOT NULL AND sound").select("vec_id", "label", "vector")
    packed = staged(known.mapInArrow(partial(_whole, scale=scale), "vec_id long, label long, first int, q binary"), "vectors")
    return one_of_each(packed, "vec_id", "label", "first", "q")


def hard_negatives(rows: DataFrame, is_anchor: Column | str, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of all anchors of `rows`.

    `rows` has vec_id, label and embedding; `is_anchor` is a condition on vec_id and label. The score of two rows is the
    inner product of floor(scale * x). An anchor's positives are its first `positives` other rows of the same
    label; for each, the first `negatives` rows of other labels with low * p <= 100 * s <= high * p are returned (p: the
    positive's score, s: the negative's). Higher scores come first, ties by the smaller vec_id.

    Rows left out and repeated ids: see `whole_vectors`. Missing components of a shorter vector count as zero. An anchor without
    positives, and a positive without a row in its window (as any with a score below zero), have no rows. Scores are exact, cut
    to the ends of a long. Other columns are not looked at; an empty table gives none.

    Every anchor is searched in every block of rows, one task for a block and a block of anchors: the search is exact, so
    the work grows with anchors times rows where boxes prune nothing. Per block a task returns at most `positives` or
    `positives * negatives` rows of an anchor.
    """
    whole = whole_vectors(rows, scale)
    parts = max(1, -(-whole.count() // BLOCK))
    # The id after the coordinate: equal vectors are dealt over slabs, too.
    blocks = staged(whole.repartitionByRange(parts, "first", "vec_id").select(F.spark_partition_id().alias("block"), "vec_id", "label", "q"), "vector_blocks")
    chosen = blocks.where(is_anchor)
    n_blocks, n_anchors = blocks.select(F.max("block")).first()[0], chosen.count()
    groups = max(1, -(-n_anchors // ANCHORS))
    tasks = min(MAX_TASKS, groups * ((n_blocks or 0) + 1))
    dealt = blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).repartition(tasks, "block", "group")
    # Names of their own: both sides of the cells come from one table.
    in_group = F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("in_group")
    chosen = chosen.select(F.col("vec_id").alias("anchor_id"), F.col("label").alias("own_label"), F.col("q").alias("anchor_q"), in_group)

    def meet(anchors: DataFrame, search, schema: str) -> DataFrame:
        everywhere = anchors.withColumn("in_block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks or 0)))).repartition(tasks, "in_block", "in_group")
        cells = everywhere.groupBy("in_block", "in_group").cogroup(dealt.groupBy("block", "group"))
        return cells.applyInPandas(lambda anchors, rows: search(anchors, rows), schema)

    first = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = meet(chosen, partial(_near_same, k=positives), "anchor_id long, positive_id long, positive_score long")
    near = near.withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives)
    found = staged(near, "positives").groupBy("anchor_id").agg(
        F.collect_list("positive_id").alias("positive_ids"), F.collect_list("positive_score").alias("positive_scores")
    )
    schema = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    hard = meet(chosen.join(found, "anchor_id"), partial(_near_other, k=negatives, low=low, high=high), schema)
    last = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = hard.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def shifted_labels(embeddings: DataFrame) -> DataFrame:
    """`embeddings` with the label one higher, modulo 10, where vec_id is divisible by 7."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return embeddings.select("vec_id", label.alias("label"), "embedding")


ORACLE = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM rows a, rows b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 3
"""
