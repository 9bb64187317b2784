"""Exact removal of long repeated byte strings with a run-length compressed suffix index.

A string of `length` bytes that starts in two places selects the same anchor in both: the
`GRAM`-byte substring with the smallest hash. So the strings of one anchor (a run of starts, its
*context*) are compared with those of equal anchors only, wherever in the corpus they stand.
Contexts of one anchor meet in one block; each block is indexed by its Burrows-Wheeler transform,
kept as runs with the suffix positions at both ends of each run, from which the longest match of
every position with any other is streamed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbox.llm.bytesops import U, Rolling, mix, text_chunks
from signalbox.llm.staging import staged

LENGTH, GRAM = 200, 64
#: Bytes of contexts indexed together, and contexts of one anchor from which on windows are counted one by one.
BLOCK_BYTES, HOT_CONTEXTS = 2 << 20, 20_000
_END = 0xFF  # never a byte of UTF-8
_LOW = U(0xFFFFFFFF)


def anchors(buf: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """(text, anchor hash, context hash, first start, starts) of each run of starts with one anchor."""
    none = np.zeros(0, np.int64)
    sizes = np.diff(offsets)
    if not (sizes >= length).any():
        return none, none, none, none, none
    rolling = Rolling(buf)
    grams = rolling.grams(gram)
    key = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    width = length - gram + 1
    rows = np.full((-(-len(key) // width) + 1) * width, ~U(0))
    rows[: len(key)] = key
    rows = rows.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: len(key)], ahead[width - 1 : width - 1 + len(key)])
    inside = np.zeros(len(buf) + 1, np.int64)
    long = sizes >= length
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, (offsets[1:] - length + 1)[long], -1)
    start = np.flatnonzero(np.cumsum(inside)[: len(buf)] > 0)
    at = (least[start] & _LOW).astype(np.int64)
    head = np.concatenate([[True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)])
    first = np.flatnonzero(head)
    lo, last = start[first], start[np.concatenate([first[1:], [len(start)]]) - 1]
    at = at[first]
    context = mix(rolling.of(lo, last + length) + (at - lo).astype(np.uint64))
    text = np.searchsorted(offsets, lo, side="right") - 1
    return text, grams[at].view(np.int64), context.view(np.int64), lo - offsets[text], last - lo + 1


def _occurrences(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bodies = batch.column("body")
        for lo, _, buf, offsets in text_chunks(batch.column("text")):
            text, anchor, context, start, n = anchors(buf, offsets, length, gram)
            if len(text):
                yield pa.RecordBatch.from_arrays(
                    [bodies.take(pa.array(text + lo)), pa.array(anchor), pa.array(context), pa.array(start, pa.int32()), pa.array(n, pa.int32())],
                    ["body", "anchor", "context", "lo", "n"],
                )


def suffix_order(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order, by prefix doubling, and the first eight bytes of each as a number."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    words = np.zeros(n, np.uint64)
    for j in range(8):
        words = (words << U(8)) | padded[j : j + n]
    order = np.argsort(words, kind="stable")
    head = np.concatenate([[True], words[order[1:]] != words[order[:-1]]])
    rank = np.zeros(n + 1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0)) + 1
    single = head & np.concatenate([head[1:], [True]])
    open_, depth = np.flatnonzero(~single), 8
    while len(open_) and depth < 2 * n:
        suffix = order[open_]
        key = (rank[suffix] << 32) | rank[np.minimum(suffix + depth, n)]
        by = np.argsort(key, kind="stable")
        key, suffix = key[by], suffix[by]
        order[open_] = suffix
        head = np.concatenate([[True], key[1:] != key[:-1]])
        rank[suffix] = np.maximum.accumulate(np.where(head, open_, 0)) + 1
        open_ = open_[~(head & np.concatenate([head[1:], [True]]))]
        depth *= 2
    return order, words


def _common(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The length of the common prefix of the suffixes at a and b, eight bytes a step."""
    n, out, on = len(words), np.zeros(len(a), np.int64), np.arange(len(a))
    step = 0
    while len(on):
        x, y = a[on] + step, b[on] + step
        inside = np.maximum(x, y) < n
        differ = np.full(len(on), U(1) << U(63))
        differ[inside] = words[x[inside]] ^ words[y[inside]]
        same = differ == 0
        stop = on[~same]
        # Leading equal bytes: the exponent of a float tells the highest set bit; byte borders are exact.
        left = differ[~same]
        lead = np.zeros(len(left), np.int64)
        for j in range(1, 8):
            lead += left < (U(1) << U(64 - 8 * j))
        out[stop] = np.minimum(step + lead, n - np.maximum(a[stop], b[stop]))
        on, step = on[same], step + 8
    return out


def longest_matches(text: np.ndarray) -> np.ndarray:
    """For each position the longest string that starts there and at some other position.

    Only at the ends of a run of the transform is a suffix compared with its neighbour in suffix
    order. In between, the neighbours of a position are those of the position before it, moved by
    one, and the match is one byte shorter; so the sampled values are streamed through the text.
    """
    n = len(text)
    if n < 2:
        return np.zeros(n, np.int64)
    order, words = suffix_order(text)
    before = np.where(order > 0, text[order - 1].astype(np.int16), -1)
    border = np.flatnonzero(before[1:] != before[:-1])  # a run ends at border, the next begins behind it
    common = _common(words, order[border], order[border + 1])
    out = np.zeros(n, np.int64)
    for at, end in ((order[border + 1], order[0]), (order[border], order[-1])):
        value = np.full(n, -1, np.int64)
        value[at] = common + at
        value[end] = end  # no neighbour on this side
        sample = np.maximum.accumulate(np.where(value >= 0, np.arange(n), -1))
        known = sample >= 0
        np.maximum(out, np.where(known, value[sample] - np.arange(n), 0), out=out)
    return out


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


_RANGES = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))


def _index_block(rows: list[tuple], length: int) -> pa.RecordBatch:
    """Ranges of repeated starts of each single context of a block."""
    parts, starts, at = [], [], 0
    for _, _, _, body in rows:
        parts += [body, b"\xff"]
        starts.append(at)
        at += len(body) + 1
    match = longest_matches(np.frombuffer(b"".join(parts), np.uint8)) >= length
    out = [[], [], []]
    for (anchor, context, n, body), at in zip(rows, starts, strict=True):
        if n > 1:
            continue
        s, e = _runs(match[at : at + len(body) - length + 1])
        if len(s):
            out[0].append(anchor)
            out[1].append(context)
            out[2].append([{"s": x, "e": y} for x, y in zip(s.tolist(), e.tolist(), strict=True)])
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], _RANGES)], ["anchor", "context", "ranges"])


def _index(batches: Iterator[pa.RecordBatch], length: int, block: int) -> Iterator[pa.RecordBatch]:
    """Blocks of whole anchor groups from rows sorted by anchor and context."""
    rows, size = [], 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "context", "n", "bytes")), strict=True):
            if size >= block and row[0] != rows[-1][0]:
                yield _index_block(rows, length)
                rows, size = [], 0
            if not rows or rows[-1][:2] != row[:2]:
                rows.append(row)
                size += len(row[3]) + 1
    if rows:
        yield _index_block(rows, length)


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the contexts that a text stands for."""
    schema = pa.schema([("anchor", pa.int64()), ("context", pa.int64()), ("n", pa.int64()), ("bytes", pa.binary())])
    for batch in batches:
        rows = {c: [] for c in schema.names}
        for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
            raw = text.encode()
            for w in wanted:
                rows["anchor"].append(w["anchor"])
                rows["context"].append(w["context"])
                rows["n"].append(w["copies"])
                rows["bytes"].append(raw[w["lo"] : w["lo"] + w["n"] - 1 + length])
        yield pa.RecordBatch.from_pydict(rows, schema)


def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Every window of every context as a hash, for anchors with too many contexts for a block."""
    for batch in batches:
        bodies = batch.column("bytes").to_pylist()
        for i, body in enumerate(bodies):
            n = len(body) - length + 1
            hashes = Rolling(np.frombuffer(body, np.uint8)).grams(length)
            one = lambda c: pa.array(np.full(n, batch.column(c)[i].as_py()))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [one("anchor"), one("context"), one("n"), pa.array(np.arange(n), pa.int32()), pa.array(hashes.view(np.int64))],
                ["anchor", "context", "n", "s", "w"],
            )


def _kept(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")}
        for text, marks in zip(batch.column("text").to_pylist(), batch.column("marks").to_pylist(), strict=True):
            raw = (text or "").encode()
            gone = np.zeros(len(raw) + 1, np.int32)
            for m in marks or ():
                gone[m["b"]] += 1
                gone[m["e"]] -= 1
            s, e = _runs(np.cumsum(gone[:-1]) > 0)
            left, at, digest = [], 0, sha256()
            for x, y in zip(s.tolist(), e.tolist(), strict=True):
                left.append(raw[at:x])
                at = y
            left.append(raw[at:])
            for part in left:
                digest.update(part)
            out["n_bytes"].append(len(raw))
            out["n_removed"].append(int((e - s).sum()))
            out["n_spans"].append(len(s))
            out["kept_sha256"].append(digest.hexdigest())
            out["kept_text"].append(b"".join(left).decode(errors="replace") if with_text and text is not None else None)
        if not with_text:
            del out["kept_text"]
        made = pa.RecordBatch.from_pydict(out, pa.schema([(c, pa.string() if c.startswith("kept") else pa.int64()) for c in out]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made.columns], ["doc_id", *made.schema.names])


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = True, hot: int = HOT_CONTEXTS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept_text]) of every row of `docs` (doc_id, text).

    A byte is removed if a string of `length` bytes covers it that also starts anywhere else, in
    any row; rows that repeat a text count as separate places. `kept_text` replaces characters
    that a removal cut in two. A null text reads as empty and keeps a null `kept_text`; texts
    shorter than `length` keep all. doc_id may be null or repeat; further columns are not looked at.

    Equal texts are known by their digest, so a text with many copies is marked once; equal
    contexts of an anchor are one row of the index with a count. An anchor with more than `hot`
    different contexts is settled by counting its windows' hashes, spread over all tasks.
    """
    body = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("string")))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), body.alias("body"))
    found = docs.select("body", "text").mapInArrow(
        partial(_occurrences, length=length, gram=gram), "body binary, anchor long, context long, lo int, n int"
    )
    found = staged(found, "anchors")
    # Written first: the join then stands on two plain shuffles, which can be split where an anchor is hot.
    again = staged(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("anchor"), "again")
    found = staged(found.join(again, "anchor", "left_semi"), "repeated_anchors")
    contexts = found.groupBy("anchor", "context").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("body", "lo", "n")).alias("place"))
    contexts = staged(contexts, "contexts")
    groups = contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("k"), F.min("copies").alias("fewest")).where("k > 1 AND fewest = 1")
    mixed = contexts.join(groups.select("anchor", "k"), "anchor").select("anchor", "context", "copies", "k", "place.*")
    wanted = mixed.groupBy("body").agg(F.collect_list(F.struct("anchor", "context", "copies", "lo", "n")).alias("wanted"))
    owners = docs.groupBy("body").agg(F.min("doc_id").alias("owner"))
    texts = docs.join(wanted.join(owners, "body").withColumnRenamed("body", "own"), (F.col("body") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("owner")))
    cut = texts.select("text", "wanted").mapInArrow(partial(_cut, length=length), "anchor long, context long, n long, bytes binary")
    large = groups.where(F.col("k") > hot).select("anchor")
    cut = staged(cut, "context_bytes")
    rest = cut.join(large, "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor", "context")
    ranges = "anchor long, context long, ranges array<struct<s:int,e:int>>"
    parts = rest.mapInArrow(partial(_index, length=length, block=BLOCK_BYTES), ranges)
    windows = cut.join(large, "anchor", "left_semi").dropDuplicates(["anchor", "context"])
    windows = windows.mapInArrow(partial(_windows, length=length), "anchor long, context long, n long, s int, w long")
    twice = windows.groupBy("anchor", "w").agg(F.sum("n").alias("c")).where("c > 1").select("anchor", "w")
    single = windows.where("n = 1").join(twice, ["anchor", "w"], "left_semi")
    single = single.select("anchor", "context", F.array(F.struct("s", (F.col("s") + 1).alias("e"))).alias("ranges"))
    # A context with several copies repeats as a whole.
    whole = contexts.where("copies > 1").select("anchor", "context", F.array(F.struct(F.lit(0).alias("s"), F.col("place.n").alias("e"))).alias("ranges"))
    marked = parts.union(single).union(whole)
    places = found.dropDuplicates(["body", "lo"]).select("body", "anchor", "context", "lo")
    marks = places.join(marked, ["anchor", "context"]).select("body", "lo", F.explode("ranges").alias("r"))
    marks = marks.select("body", (F.col("lo") + F.col("r.s")).alias("b"), (F.col("lo") + F.col("r.e") - 1 + length).alias("e"))
    marks = marks.groupBy(F.col("body").alias("own")).agg(F.collect_list(F.struct("b", "e")).alias("marks"))
    out = docs.join(marks, F.col("body") == F.col("own"), "left").select("doc_id", "text", "marks")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text
    return out.mapInArrow(partial(_kept, with_text=with_text), schema)
