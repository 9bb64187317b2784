"""Near-duplicate removal by SuperMinHash: banding, verification on full sets, union-find grouping.

A signature of SuperMinHash has one value per slot. Every element walks through its own random
permutation of the slots; in step j it offers the slot it stands on the value j + r, 0 <= r < 1.
The smallest offer stays. As each element visits each slot once, slots of one signature are
negatively correlated, which lowers the variance of the similarity estimate; and once every slot
of a text is taken, later steps cannot improve any, so long texts stop after one or two steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbox.llm.bytesops import U, mix, shingle_sets, text_chunks
from signalbox.llm.graph import components
from signalbox.llm.staging import staged

#: 32 bands of 4: a pair of similarity 0.8 shares no band with probability (1 - 0.8**4)**32 < 5e-8.
BANDS, ROWS = 32, 4
#: From so many classes on, a bucket that is not yet one component is checked in blocks of BLOCK classes.
DENSE, BLOCK = 32, 512
_FREE = U(0xFFFFFFFFFFFFFFFF)
_STEP = 0x9E3779B97F4A7C15


def signatures(hashes: np.ndarray, sizes: np.ndarray, slots: int, block: int = 1 << 15) -> np.ndarray:
    """SuperMinHash signatures (texts x slots) of sets given one after the other; empty sets stay free."""
    out = np.full((len(sizes), slots), _FREE, np.uint64)
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        begin = int(ends[lo] - sizes[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, begin + block, side="right")))
        _fill(out[lo:hi], hashes[begin : int(ends[hi - 1])], np.repeat(np.arange(hi - lo), sizes[lo:hi]), slots)
        lo = hi
    return out


def _fill(out: np.ndarray, h: np.ndarray, doc: np.ndarray, slots: int) -> None:
    flat, places = out.reshape(-1), None
    for j in range(slots):
        if not len(h):
            return
        random = mix(h + U((j + 1) * _STEP & 0xFFFFFFFFFFFFFFFF))
        offer = U(j << 32) | (random >> U(32))
        k = (j + (((random & U(0xFFFFFFFF)) * U(slots - j)) >> U(32))).astype(np.int64)
        if places is None:
            slot = k
        else:
            each = np.arange(len(h))
            slot = places[each, k].astype(np.int64)
            places[each, k] = places[:, j]
        at = doc * slots + slot
        better = flat[at] > offer
        np.minimum.at(flat, at[better], offer[better])
        open_doc = (out == _FREE).any(axis=1)
        rest = open_doc[doc]
        if places is None:
            places = np.tile(np.arange(slots, dtype=np.uint16), (int(rest.sum()), 1))
            places[np.arange(len(places)), k[rest]] = 0
        else:
            places = places[rest]
        h, doc = h[rest], doc[rest]


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per text and band; the band's number is part of it."""
    parts = sig.reshape(len(sig), bands, rows)
    keys = np.zeros((len(sig), bands), np.uint64) + mix(np.arange(bands, dtype=np.uint64) + U(_STEP))
    for r in range(rows):
        keys = mix(keys * U(0xD1342543DE82EF95) + parts[:, :, r])
    return keys


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _sketch(batches: Iterator[pa.RecordBatch], k: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id")
        for lo, hi, buf, offsets in text_chunks(batch.column("text")):
            hashes, sizes, _ = shingle_sets(buf, offsets, k)
            keys = band_keys(signatures(hashes, sizes, bands * rows), bands, rows)
            some = sizes > 0
            at = np.concatenate([[0], np.cumsum(sizes)[:-1]])[some]
            marks = []
            for salt in (1, 2):
                sums = np.zeros(len(sizes), np.uint64)
                if some.any():
                    sums[some] = np.add.reduceat(mix(hashes + U(salt * _STEP & 0xFFFFFFFFFFFFFFFF)), at)
                marks.append(pa.array(mix(sums + sizes.astype(np.uint64)).view(np.int64), mask=~some))
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(lo, hi - lo),
                    pa.array(sizes),
                    *marks,
                    _lists(keys[some].ravel().view(np.int64), some * bands),
                ],
                ["doc_id", "n_shingles", "set_a", "set_b", "bands"],
            )


def _confirm(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both = pa.concat_arrays([batch.column("text_u").cast(pa.large_string()), batch.column("text_v").cast(pa.large_string())])
        sets: list[np.ndarray] = []
        for _, _, buf, offsets in text_chunks(both):
            hashes, sizes, _ = shingle_sets(buf, offsets, k)
            sets += np.split(hashes, np.cumsum(sizes)[:-1])
        n = batch.num_rows
        keep = np.zeros(n, bool)
        for i in range(n):
            a, b = sets[i], sets[n + i]
            if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                continue
            merged = np.sort(np.concatenate([a, b]))
            shared = int((merged[1:] == merged[:-1]).sum())
            keep[i] = shared and 100 * shared >= percent * (len(a) + len(b) - shared)
        yield batch.select(["u", "v"]).filter(pa.array(keep))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of `docs` (doc_id, text).

    Texts are linked if 100 * |intersection| >= percent * |union| of their sets of k-word shingles,
    and a component is what links connect; `component_id` is its smallest doc_id. Steps:

    1. One pass makes each row's signature and band keys. Rows with equal sets are one class from
       then on, found with map-side aggregation, so a group of copies of any size is one row.
    2. In each bucket (equal band key) every class is checked against the bucket's smallest class.
    3. Buckets whose classes are still in several components are checked in full: small ones pair
       by pair, those of `DENSE` classes or more block against block, where a task counts the shared
       shingles of two blocks as matrix products and returns only links that connect components.
    4. Links are confirmed on whole sets, made again from the texts.

    A null or blank text has an empty set and no links. A row with a null doc_id has no links, a
    null component and is kept. Rows that repeat a doc_id are one document with several texts.
    Further columns of `docs` are not looked at.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = partial(_sketch, k=k, bands=bands, rows=rows)
    sigs = staged(docs.mapInArrow(sketch, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"), "signatures")
    known = sigs.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # Written first: used twice, and the join with its copies can then be split where a class is hot.
    classes = staged(known.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "classes")
    buckets = staged(classes.select("rep", F.explode("bands").alias("key")), "buckets")
    copies = (
        known.join(classes.select("set_a", "set_b", "rep"), ["set_a", "set_b"])
        .where("doc_id != rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).distinct()
    )
    shared = buckets.groupBy("key").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).where("lead != last")
    members = staged(buckets.join(shared.select("key", "lead"), "key").select("key", "rep", "lead"), "shared_buckets")
    stars = staged(members.where("rep != lead").select(F.col("lead").alias("u"), F.col("rep").alias("v")).distinct(), "candidates")
    ends = stars.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct()
    # The same way at every size: the texts meet their candidates by a shuffle.
    bodies = staged(docs.join(ends.hint("merge"), "doc_id", "left_semi"), "bodies")
    links = staged(_checked(stars, bodies, k, percent).union(copies), "links")
    first = components(links)

    labels = members.join(first, F.col("rep") == F.col("node"), "left").select("key", "rep", "lead", F.coalesce("component", "rep").alias("c"))
    split = labels.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("n"))
    rest = staged(labels.join(split.where("low != high").select("key", "n"), "key"), "split_buckets")
    few = rest.where(F.col("n") < DENSE)
    pairs = few.join(few.select("key", F.col("rep").alias("v"), F.col("c").alias("d")), "key").where("c != d AND rep < v")
    pairs = staged(pairs.select(F.col("rep").alias("u"), "v").distinct().join(stars, ["u", "v"], "left_anti"), "split_pairs")
    many = rest.where(F.col("n") >= DENSE).select("lead", "rep", "c").distinct()
    more = staged(_checked(pairs, bodies, k, percent).union(_dense_links(many, bodies, k, percent)), "more_links")
    whole = components(first.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more))
    out = sigs.join(whole, F.col("doc_id") == F.col("node"), "left")
    return out.select(
        "doc_id",
        "n_shingles",
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce("component", "doc_id").eqNullSafe(F.col("doc_id")).alias("kept"),
    )


def _checked(pairs: DataFrame, bodies: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose texts are similar enough."""
    left = bodies.select(F.col("doc_id").alias("u"), F.col("text").alias("text_u"))
    right = bodies.select(F.col("doc_id").alias("v"), F.col("text").alias("text_v"))
    both = pairs.hint("merge").join(left, "u").hint("merge").join(right, "v").select("u", "v", "text_u", "text_v")
    return both.mapInArrow(partial(_confirm, k=k, percent=percent), "u long, v long")


def _dense_links(members: DataFrame, bodies: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between components within each group of `members` (lead, rep, c), block against block.

    Each member is sent to one task per block of its group, so tasks stay bounded and no pair is a row.
    """
    sizes = members.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(sizes, "lead").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("lead", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "c")
    texts = bodies.select(F.col("doc_id").alias("rep"), "text")
    return dealt.join(texts, "rep").groupBy("lead", "i", "j").applyInPandas(partial(_block_links, k=k, percent=percent), "u long, v long")


def _block_links(group: pd.DataFrame, k: int, percent: int) -> pd.DataFrame:
    texts = pa.array(group["text"], pa.large_string())
    sets: list[np.ndarray] = []
    for _, _, buf, offsets in text_chunks(texts):
        hashes, sizes, _ = shingle_sets(buf, offsets, k)
        sets += np.split(hashes, np.cumsum(sizes)[:-1])
    size = np.array([len(x) for x in sets])
    _, column, found = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    common = found[column] > 1
    row, column = row[common], column[common]
    # Shingles of one text alone are in no intersection: with too many of them a text has no partner.
    able = 100 * np.bincount(row, minlength=len(sets)) >= percent * size
    row, column = row[able[row]], np.unique(column[able[row]], return_inverse=True)[1]
    own, other = (able & (group["own"].to_numpy() == group[x].to_numpy()) for x in ("i", "j"))
    left, right = np.flatnonzero(own), np.flatnonzero(other)
    shared = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [start, start + 4096])
        part = np.zeros((len(sets), 4096), np.float32)
        part[row[a:b], column[a:b] - start] = 1
        shared += part[left] @ part[right].T
    union = size[left][:, None] + size[right][None, :] - shared
    c, rep = group["c"].to_numpy(), group["rep"].to_numpy()
    x, y = np.nonzero((100 * shared >= percent * union) & (c[left][:, None] != c[right][None, :]))
    near = pd.DataFrame({"u": rep[left[x]], "v": rep[right[y]], "c": c[left[x]], "d": c[right[y]]})
    return near.drop_duplicates(["c", "d"])[["u", "v"]]


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` to keep, with all their columns: those of one doc_id of each component.

    Rows with a null doc_id stay, as do rows without words. All rows that repeat a kept doc_id stay
    too; `one_row_each` takes one of them.
    """
    gone = near_duplicates(docs, **options).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == F.col("_gone"), "left_anti")


def one_row_each(docs: DataFrame) -> DataFrame:
    """One row of each doc_id, the smallest by text (null before any other, then by a hash of the
    other columns), and of the rows with a null doc_id one for each text.

    The smallest is a partial aggregate, so a group of any size is one row of each task. Texts of
    null ids are grouped by their digest.
    """
    others = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")]
    tie = F.xxhash64(*others) if others else F.lit(0)
    orphan = F.when(F.col("doc_id").isNull(), F.coalesce(F.sha2("text", 256), F.lit("")))
    by, row = F.struct("text", tie.alias("tie")).alias("_by"), F.struct(*docs.columns).alias("_row")
    rows = docs.select(F.col("doc_id").alias("_id"), orphan.alias("_orphan"), by, row)
    return rows.groupBy("_id", "_orphan").agg(F.min_by("_row", "_by").alias("_row")).select("_row.*")
