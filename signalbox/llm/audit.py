"""How filters interact: what each removes after any others, from sorted lists of failing ids.

Rows are sorted by part and id within each task and taken in ranges. In a range each filter has one
posting list per part, the sorted places of the rows that fail it; lists of one filter lie end to
end, so one merge serves every part. For each filter and each set of filters before it, unions and
differences of the lists come from galloping merges, and their sizes, cut at the borders of the
parts, are summed over the ranges. An order of filters only looks up the sizes of its prefixes.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbox.llm.staging import staged

_STRIDE = 64
_SIZES = ("n", "failing", "removed", "after", "alone", "good", "toxic")


def places(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each element of sorted `a`, how many of sorted `b` are smaller.

    Gallops through `b`: from one stride of `a` to the next the reach doubles until it holds the
    stride's end; only that stretch is searched, so long runs of `b` alone are jumped over.
    """
    out, low = np.empty(len(a), np.int64), 0
    for start in range(0, len(a), _STRIDE):
        some = a[start : start + _STRIDE]
        reach = 1
        while low + reach < len(b) and b[low + reach] < some[-1]:
            reach *= 2
        found = low + np.searchsorted(b[low : low + reach + 1], some)
        out[start : start + _STRIDE] = found
        low = int(found[-1])
    return out


def minus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The elements of `a` that are not in `b`; both sorted and without repeats."""
    if not len(a) or not len(b):
        return a
    at = places(a, b)
    return a[b[np.minimum(at, len(b) - 1)] != a]


def union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The elements of either, sorted; the shorter list gallops through the longer one."""
    if len(a) < len(b):
        a, b = b, a
    new = minus(b, a)
    return np.insert(a, places(new, a), new) if len(new) else a


def interactions(lists: list[np.ndarray], good: np.ndarray, toxic: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(filter, set of earlier filters as bits, sizes per part) of one range.

    `bounds` are the places where parts begin, and the range's end; sizes are as in `_SIZES`.
    """
    count = lambda x: np.diff(np.searchsorted(x, bounds))
    k, n = len(lists), np.diff(bounds)
    every = [np.zeros(0, np.int64)]
    for seen in range(1, 1 << k):
        top = seen.bit_length() - 1
        every.append(union(every[seen ^ (1 << top)], lists[top]))
    for f, own in enumerate(lists):
        failing, rest = count(own), {0: own}
        others = [s for s in range(1 << k) if not s >> f & 1]
        for seen in others[1:]:
            top = seen.bit_length() - 1
            rest[seen] = minus(rest[seen ^ (1 << top)], lists[top])
        alone = count(rest[others[-1]])
        for seen in others:
            gone = rest[seen]
            lost = [count(gone) - count(minus(gone, marked)) for marked in (good, toxic)]
            yield f, seen, np.column_stack([n, failing, count(gone), n - count(every[seen | 1 << f]), alone, *lost])


def _sized(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch.column("_part")
        runs = part.dictionary_encode()
        code = runs.indices.to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        lists = [np.flatnonzero(batch.column(f"_f{i}").to_numpy(zero_copy_only=False)) for i in range(k)]
        good, toxic = (np.flatnonzero(batch.column(c).to_numpy(zero_copy_only=False)) for c in ("_good", "_toxic"))
        names = part.take(pa.array(starts))
        for f, seen, sizes in interactions(lists, good, toxic, np.append(starts, batch.num_rows)):
            same = [pa.array(np.full(len(starts), x, np.int32)) for x in (f, seen)]
            yield pa.RecordBatch.from_arrays([names, *same, *(pa.array(x) for x in sizes.T)], ["_part", "_filter", "_seen", *_SIZES])


def audit(rows: DataFrame, part: str, key: str, filters: dict[str, str], good: str, toxic: str) -> DataFrame:
    """For each value of `part`, every order of `filters` and every step of it, what happens to its rows.

    `filters` names boolean columns of `rows` (true: the row fails) by one letter each; up to 6 filters, as every order
    is reported. Returned: part, filter_order, step (from 1), and the long counts kept, removed, redundant,
    unique_fails, good_lost, toxic_lost and shapley (what the step's filter removes, summed over all orders).
    `key` is the id that lists are sorted by. A null part counts as the empty string, a null flag as false;
    each row counts, repeated ones too; an empty table has no parts. Other columns are not looked at.
    """
    if not 0 < len(filters) <= 6:
        raise ValueError("from 1 to 6 filters")
    flag = lambda c, name: F.coalesce(F.col(c).cast("boolean"), F.lit(False)).alias(name)
    flags = [flag(c, f"_f{i}") for i, c in enumerate(filters.values())]
    named = F.coalesce(F.col(part).cast("string"), F.lit("")).alias("_part")
    lists = rows.select(named, F.col(key).alias("_key"), *flags, flag(good, "_good"), flag(toxic, "_toxic")).sortWithinPartitions("_part", "_key")
    schema = "_part string, _filter int, _seen int, " + ", ".join(f"{c} long" for c in _SIZES)
    sums = lists.mapInArrow(partial(_sized, k=len(filters)), schema).groupBy("_part", "_filter", "_seen").agg(*(F.sum(c).alias(c) for c in _SIZES))
    return _orders(sums, list(filters))


def _orders(sums: DataFrame, names: list[str]) -> DataFrame:
    """Steps of all orders from the sizes of their prefixes: each (filter, set before it) lists its own steps."""
    k = len(names)
    steps: dict[tuple[int, int], list[tuple[str, int]]] = {}
    for order in itertools.permutations(range(k)):
        seen = 0
        for step, f in enumerate(order, 1):
            steps.setdefault((f, seen), []).append(("".join(names[i] for i in order), step))
            seen |= 1 << f
    # All orders of at most 6 letters: a table of fixed size, small enough for every task.
    table = sums.sparkSession.createDataFrame([(f, s, o, n) for (f, s), found in steps.items() for o, n in found], "_filter int, _seen int, filter_order string, step int")
    # A filter meets each set before it in (set)! * (k - 1 - set)! orders.
    weight: Column = F.lit(0).cast("long")
    for size in range(k):
        weight = F.when(F.bit_count("_seen") == size, F.lit(math.factorial(size) * math.factorial(k - 1 - size)).cast("long")).otherwise(weight)
    whole = sums.groupBy("_part", "_filter").agg(F.sum(F.col("removed") * weight).alias("shapley"))
    return sums.join(whole, ["_part", "_filter"]).join(F.broadcast(table), ["_filter", "_seen"]).select(
        F.col("_part").alias("part"),
        "filter_order",
        "step",
        F.col("after").alias("kept"),
        "removed",
        (F.col("failing") - F.col("removed")).alias("redundant"),
        F.col("alone").alias("unique_fails"),
        F.col("good").alias("good_lost"),
        F.col("toxic").alias("toxic_lost"),
        "shapley",
    )


def document_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, source, A, B, C, D, E, good, toxic) of every row of `docs` (doc_id, text, source): what it fails, and its labels.

    A: under 200 words; B: under half of its words are different; C: over 2 % of its characters are `A` to `Z`; D: it holds
    one of `#$%&*|`; E: the same text stands under a smaller doc_id, in any source. Words are
    `[^\\x20\\x09-\\x0D]+`; a null text is an empty one. A null doc_id is neither smaller than another nor has
    smaller ones; rows of one doc_id are no copies of each other. Of several labels of a doc_id any 1 counts.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    wide = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        text.alias("_text"),
        words.alias("_words"),
        capitals.alias("_capitals"),
    )
    narrow = staged(
        wide.select(
            "doc_id",
            "source",
            (F.size("_words") < 200).alias("A"),
            (100 * F.size(F.array_distinct("_words")) < 50 * F.size("_words")).alias("B"),
            (100 * F.col("_capitals") > 2 * F.length("_text")).alias("C"),
            F.col("_text").rlike(r"[#$%&*|]").alias("D"),
            F.unhex(F.sha2("_text", 256)).alias("_digest"),
        ),
        "filter_flags",
    )
    # Both small tables are written first, so that their joins can be split where a text or an id is hot.
    copies = narrow.groupBy("_digest").agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last")).where("_first < _last")
    copies = staged(copies.select("_digest", "_first"), "filter_copies")
    marked = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    marked = staged(marked.where("good OR toxic"), "filter_labels")
    return narrow.join(copies, "_digest", "left").join(marked, "doc_id", "left").select(
        "doc_id", "source", "A", "B", "C", "D", F.coalesce(F.col("_first") < F.col("doc_id"), F.lit(False)).alias("E"), "good", "toxic"
    )


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`audit` of the five `document_filters` by source."""
    return audit(document_filters(docs, labels), "source", "doc_id", {c: c for c in "ABCDE"}, "good", "toxic")


ORACLE = r"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), marked AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), flags AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
  FROM words LEFT JOIN marked USING (doc_id)
), classes AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM flags GROUP BY part, fails
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS f, filter_order[1:step - 1] AS earlier
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5])::INTEGER AS step)
), met AS (
  SELECT part, filter_order, step, f, n, good, toxic, fails,
         contains(fails, f) AS failing,
         len(list_intersect(string_split(fails, ''), string_split(earlier, ''))) > 0 AND earlier <> '' AND fails <> '' AS gone
  FROM classes, steps
), counted AS (
  SELECT part, filter_order, step, f,
         coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (failing AND NOT gone), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (failing AND gone), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (fails = f), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (failing AND NOT gone), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (failing AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM met GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM counted
"""
