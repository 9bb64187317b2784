"""Benchmark items found in documents within an edit budget: pigeonhole pieces, then bit-parallel distance.

A passage within k edits of an item leaves at least one of k + 1 pieces of the item untouched. So
the pieces are searched exactly, all at once, and only places around a hit are measured.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edits allowed per character of an item, and the characters of items searched in one pass.
RATE, BLOCK_CHARS = 0.05, 4 << 20

_AUTOMATA: dict[int, tuple] = {}


def normalised(text: str) -> str:
    """Lower case, any run of white space one space."""
    return " ".join(text.lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): `budget` + 1 pieces of about equal length that cover the item."""
    n = budget + 1
    borders = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(borders, borders[1:], strict=False)]


def nearest(item: str, text: str) -> tuple[int, int]:
    """(distance, end) of the substring of `text` with the fewest edits to `item`; the first such end.

    Myers' algorithm: a column of the edit matrix as two bit vectors of its vertical differences.
    """
    m = len(item)
    ones, top = (1 << m) - 1, 1 << (m - 1)
    at: dict[str, int] = {}
    for i, c in enumerate(item):
        at[c] = at.get(c, 0) | 1 << i
    plus, minus, score = ones, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = at.get(c, 0)
        zero = ((((eq & plus) + plus) ^ plus) | eq | minus) & ones
        up = minus | (~(zero | plus) & ones)
        down = plus & zero
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1) & ones
        down = (down << 1) & ones
        plus = down | (~(zero | up) & ones)
        minus = up & zero
        if score < best:
            best, end = score, j + 1
    return best, end


def _automaton(items: list[tuple[int, str, int]]):
    """Piece -> [(item number, offset)]."""
    places: dict[str, list[tuple[int, int]]] = {}
    for i, (_, text, budget) in enumerate(items):
        for offset, piece in pieces(text, budget):
            places.setdefault(piece, []).append((i, offset))
    found = ahocorasick.Automaton()
    for piece, where in places.items():
        found.add_word(piece, (len(piece), where))
    found.make_automaton()
    return found


def matches(text: str, items: list[tuple[int, str, int]], automaton) -> list[tuple[int, int, int, int]]:
    """(item number, distance, start, end) of the best place of each item within its budget."""
    starts: dict[int, set[int]] = {}
    for last, (size, where) in automaton.iter(text):
        for i, offset in where:
            starts.setdefault(i, set()).add(last - size + 1 - offset)
    out = []
    for i, where in starts.items():
        _, item, budget = items[i]
        best = None
        where = sorted(where)
        while where:
            n = 1
            while n < len(where) and where[n] - where[n - 1] <= 2 * budget:
                n += 1
            lo, hi = max(0, where[0] - budget), where[n - 1] + len(item) + budget
            distance, end = nearest(item, text[lo:hi])
            if distance <= budget and (best is None or distance < best[0]):
                back, size = nearest(item[::-1], text[lo : lo + end][::-1])
                best = (distance, lo + end - size, lo + end)
            where = where[n:]
        if best:
            out.append((i, *best))
    return out


def _search(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    items = shared.value
    if id(items) not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[id(items)] = (items, _automaton(items))
    automaton = _AUTOMATA[id(items)][1]
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
    for batch in batches:
        out = {c: [] for c in schema.names}
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            for i, distance, start, end in matches(normalised(text.as_py() or ""), items, automaton):
                for c, v in zip(schema.names, (doc, items[i][0], distance, start, end), strict=True):
                    out[c].append(v)
        yield pa.RecordBatch.from_pydict(out, schema)


def _blocks(rows: Iterable, rate: float, most: int) -> Iterator[list[tuple[int, str, int]]]:
    block, size = [], 0
    for item_id, text in rows:
        text = normalised(text)
        if not text:
            continue
        if block and size + len(text) > most:
            yield block
            block, size = [], 0
        block.append((item_id, text, int(len(text) * rate)))
        size += len(text)
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, start, end): the best place of each item in each row of `docs`.

    Compared are normalised texts, to which `start` and `end` refer; up to rate * length edits of
    single characters are allowed. Items are read in blocks of at most `block_chars` characters (a
    longer item alone), and each block, whose size is thus bounded, is broadcast for one pass over
    the documents. Null or blank items and texts match nothing. Rows that repeat an item or a
    document are reported each time; doc_id may be null. Further columns are not looked at.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.where("text IS NOT NULL").select("item_id", "text").orderBy("item_id", "text")
    out = spark.createDataFrame([], "doc_id long, item_id long, distance int, start long, end long")
    for block in _blocks(items.toLocalIterator(), rate, block_chars):
        shared = spark.sparkContext.broadcast(block)
        out = out.union(rows.mapInArrow(lambda batches, s=shared: _search(batches, s), out.schema))
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, with all their columns, in which no benchmark item is found.

    Rows that share a doc_id with a found one go too; rows with a null doc_id stay.
    """
    leaks = find_leaks(docs, benchmark, **options).select(F.col("doc_id").alias("_leak")).distinct()
    return docs.join(leaks, docs["doc_id"] == F.col("_leak"), "left_anti")
