"""Texts to token ids, packed into rows of fixed width by best fit decreasing."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END_ID = 50256
#: Fixed value: the pattern this vocabulary's ranks were made for.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SCHEMA = (
    "partition int, block int, bin int, n_tokens int, ids binary, cu_seqlens array<int>, "
    "position_resets array<int>, doc_ids array<long>, doc_offsets array<long>"
)


@lru_cache(4)
def _tokenizer(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str, path: str = VOCABULARY) -> np.ndarray:
    """The ids of a whole text."""
    return _tokenizer(path).encode_to_numpy(text)


def best_fit_decreasing(sizes: list[int], width: int) -> list[list[int]]:
    """Items (by index) of each bin of capacity `width`; every item goes to the fullest bin it fits in.

    A segment tree over the free capacities 0..width tells the smallest one of at least an item's
    size that some bin has, in O(log width).
    """
    leaves = 1 << width.bit_length()
    tree = [0] * (2 * leaves)  # bins below each node
    free: list[list[int]] = [[] for _ in range(width + 1)]
    bins: list[list[int]] = []

    def count(capacity: int, by: int) -> None:
        node = leaves + capacity
        while node:
            tree[node] += by
            node >>= 1

    def smallest(capacity: int) -> int:
        node = leaves + capacity
        if tree[node]:
            return capacity
        while node > 1:  # up to the first node with bins on its right, then down on the left
            if not node & 1 and tree[node + 1]:
                node += 1
                while node < leaves:
                    node = 2 * node if tree[2 * node] else 2 * node + 1
                return node - leaves
            node >>= 1
        return -1

    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        capacity = smallest(sizes[item])
        if capacity < 0:
            capacity = width
            bins.append([])
            target = len(bins) - 1
        else:
            target = free[capacity].pop()
            count(capacity, -1)
        bins[target].append(item)
        rest = capacity - sizes[item]
        free[rest].append(target)
        count(rest, 1)
    return bins


def _pack_block(segments: list[tuple[int | None, int, np.ndarray]], width: int, kind: str, pad: int, partition: int, block: int) -> pa.RecordBatch:
    bins = best_fit_decreasing([len(s[2]) for s in segments], width)
    ids, lengths, docs, offsets = [], [], [], []
    for items in bins:
        row = np.full(width, pad, kind)
        ends = np.cumsum([0] + [len(segments[i][2]) for i in items])
        for i, at in zip(items, ends, strict=False):
            row[at : at + len(segments[i][2])] = segments[i][2]
        ids.append(row.tobytes())
        lengths.append(ends.tolist())
        docs.append([segments[i][0] for i in items])
        offsets.append([segments[i][1] for i in items])
    n = len(bins)
    columns = {
        "partition": pa.array([partition] * n, pa.int32()),
        "block": pa.array([block] * n, pa.int32()),
        "bin": pa.array(range(n), pa.int32()),
        "n_tokens": pa.array([x[-1] for x in lengths], pa.int32()),
        "ids": pa.array(ids, pa.binary()),
        "cu_seqlens": pa.array(lengths, pa.list_(pa.int32())),
        "position_resets": pa.array([x[:-1] for x in lengths], pa.list_(pa.int32())),
        "doc_ids": pa.array(docs, pa.list_(pa.int64())),
        "doc_offsets": pa.array(offsets, pa.list_(pa.int64())),
    }
    return pa.RecordBatch.from_pydict(columns)


def _pack(batches: Iterator[pa.RecordBatch], width: int, path: str, end_id: int | None, kind: str, block_tokens: int) -> Iterator[pa.RecordBatch]:
    partition, block, size = TaskContext.get().partitionId(), 0, 0
    segments: list[tuple[int | None, int, np.ndarray]] = []
    tail = np.array([] if end_id is None else [end_id], "<u4")
    pad = 0 if end_id is None else end_id
    for batch in batches:
        ids, texts = batch.column("doc_id"), batch.column("text")
        for i in range(batch.num_rows):
            tokens = np.concatenate([token_ids(texts[i].as_py() or "", path), tail]).astype(kind)
            for at in range(0, len(tokens), width):
                if size >= block_tokens:
                    yield _pack_block(segments, width, kind, pad, partition, block)
                    segments, block, size = [], block + 1, 0
                segments.append((ids[i].as_py(), at, tokens[at : at + width]))
                size += len(segments[-1][2])
    if segments:
        yield _pack_block(segments, width, kind, pad, partition, block)


def packed_rows(
    docs: DataFrame, width: int = 2048, path: str = VOCABULARY, end_id: int | None = END_ID, kind: str = "<u2", block_tokens: int = 4 << 20
) -> DataFrame:
    """Rows of `width` token ids of all texts of `docs` (doc_id, text).

    `ids` holds one row of the id matrix (`kind`, little-endian, padded with `end_id`), `cu_seqlens`
    the borders of its segments from 0 to `n_tokens`, `position_resets` where positions start from 0
    again, `doc_ids` and `doc_offsets` each segment's document and its place among that document's
    ids. A document longer than `width` is cut into segments; nothing is left out, and segments put
    together by document and offset give the ids of the text, with `end_id` behind each document.

    Each task packs its own rows, about `block_tokens` ids at a time, without a shuffle; rows are
    numbered by (partition, block, bin). Null and empty texts are documents of `end_id` alone, or
    give no segment if `end_id` is None. doc_id may be null or repeat; repeated documents are packed
    each time. Further columns are not looked at. `kind` must hold every id. `path` names the
    vocabulary file on every executor.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    work = partial(_pack, width=width, path=path, end_id=end_id, kind=kind, block_tokens=block_tokens)
    return rows.mapInArrow(work, _SCHEMA)


def write_packed(packed: DataFrame, path: str) -> None:
    """Packed rows as Parquet, one file per task, each with its rows in order."""
    packed.write.parquet(path)


def segments(packed: DataFrame, kind: str = "<u2") -> DataFrame:
    """(doc_id, doc_offset, ids array<int>) of each segment of packed rows: the way back."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"doc_id": [], "doc_offset": [], "ids": []}
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], kind)
                for a, b, doc, at in zip(row["cu_seqlens"], row["cu_seqlens"][1:], row["doc_ids"], row["doc_offsets"], strict=False):
                    out["doc_id"].append(doc)
                    out["doc_offset"].append(at)
                    out["ids"].append(ids[a:b].astype(np.int32).tolist())
            yield pa.RecordBatch.from_pydict(out, pa.schema([("doc_id", pa.int64()), ("doc_offset", pa.int64()), ("ids", pa.list_(pa.int32()))]))

    return packed.select("ids", "cu_seqlens", "doc_ids", "doc_offsets").mapInArrow(cut, "doc_id long, doc_offset long, ids array<int>")
