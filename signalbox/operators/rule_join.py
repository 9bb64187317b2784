"""A rule table too long for a plan, joined with messages: neither side passes the driver.

Every rule has one key: which of direction, method and tool it names, their values, and a hash of a literal that one of
its patterns requires, the one that the fewest rules share. A message has the keys of its own values and of the
literals that occur in its text, which a bitmap of all rules' literals tells. What meets in the join are candidates, few per
message, whose patterns Spark then matches. Messages of equal content are judged once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbox.functions.regex import PatternError, linear_match_all, needs_linear_matcher, required_literals, to_java
from signalbox.operators.skew import salted_join
from signalbox.session import work_dir

#: Bytes of a literal that are looked for, and of text hashed at a time.
_LONGEST, _WINDOW = 16, 1 << 20
#: Bits of the bitmap per rule, and at most: beyond that there are more candidates, and no other results.
_BITS_EACH, _MOST_BITS = 16, 1 << 26
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def rule_rest() -> Column:
    """What orders rules of equal `ord` and name."""
    return F.to_json(F.struct("action", "methods", "tools", "direction", "patterns"))


def _mixed(h):
    """Hashes whose low bits depend on every byte."""
    if isinstance(h, int):
        h = ((h ^ (h >> 32)) * 0xD6E8FEB86659FD93) & _MASK
        return h ^ (h >> 32)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _literal_hash(literal: bytes) -> int:
    h = 0
    for c in reversed(literal):
        h = (h * _BASE + c + 1) & _MASK
    h = _mixed(h ^ len(literal))
    return h - (1 << 64) if h >> 63 else h


def found_literals(data: np.ndarray, offsets: np.ndarray, lengths: list[int], bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the substrings of these lengths whose hash is in the bitmap, each once, in order."""
    texts, hashes = [], []
    mask, longest = np.uint64(len(bitmap) * 64 - 1), max(lengths, default=0)
    base, inverse = (np.full(min(_WINDOW, len(data)) + longest + 1, step, np.uint64) for step in (_BASE, _INVERSE))
    base[0] = inverse[0] = 1
    base, inverse = np.cumprod(base), np.cumprod(inverse)
    for lo in range(0, len(data), _WINDOW):
        part = data[lo : lo + _WINDOW + longest]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * base[: len(part)])])
        starts = np.arange(min(_WINDOW, len(part)))
        text = np.searchsorted(offsets, lo + starts, side="right") - 1
        room = offsets[text + 1] - lo - starts
        for length in lengths:
            at = starts[room >= length]
            h = _mixed((sums[at + length] - sums[at]) * inverse[at] ^ np.uint64(length))
            bit = h & mask
            hit = (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) > 0
            texts.append(text[at[hit]])
            hashes.append(h[hit].view(np.int64))
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    texts, hashes = np.concatenate(texts), np.concatenate(hashes)
    order = np.lexsort((hashes, texts))
    texts, hashes = texts[order], hashes[order]
    new = np.ones(len(texts), bool)
    new[1:] = (texts[1:] != texts[:-1]) | (hashes[1:] != hashes[:-1])
    return texts[new], hashes[new]


def _found_column(text: Column, lengths: list[int], bitmap: np.ndarray) -> Column:
    @F.pandas_udf("array<bigint>")
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in parts:
            texts = pa.array(values, pa.large_string(), from_pandas=True)
            texts = texts.fill_null("")
            offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
            owner, hashes = found_literals(data, offsets - offsets[0], lengths, bitmap)
            yield pd.Series(np.split(hashes, np.searchsorted(owner, np.arange(1, len(texts)))) if len(texts) else [], dtype=object)

    return found(text)


def _translated(lists: pd.Series) -> pd.DataFrame:
    """Patterns for Spark's matcher and for the linear one, the literals they require, and whether one is not valid."""
    out = []
    for own in lists:
        patterns = list(dict.fromkeys(own)) if own is not None else []
        try:
            linear = [p for p in patterns if needs_linear_matcher(p)]
            java = [to_java(p) for p in patterns]
            literals = {t.encode()[:_LONGEST] for p in patterns for t in required_literals(p)}
            fast = [j for j, p in zip(java, patterns, strict=True) if p not in linear]
            out.append((fast, linear, java, [{"literal": t, "hash": _literal_hash(t)} for t in sorted(literals)], False))
        except PatternError:
            out.append(([], [], [], [], True))
    return pd.DataFrame(out, columns=["java", "linear", "every", "literals", "bad"])


_TRANSLATED = "java array<string>, linear array<string>, every array<string>, literals array<struct<literal: binary, hash: bigint>>, bad boolean"


@dataclass(frozen=True)
class OrderedRules:
    """The rules as a written table: `_rule` (ord, name, rest, action) orders them, `_id` names them."""

    rows: DataFrame

    def valid(self) -> bool:
        """Every pattern compiles."""
        try:
            compiled = F.size(F.filter("every", lambda p: F.rlike(F.lit(""), p)))
            return not self.rows.agg(F.max("bad"), F.sum(compiled)).first()[0]
        except PySparkException:
            return False


def ordered_rules(rules_df: DataFrame) -> OrderedRules:
    name, action = F.coalesce("name", F.lit("")), F.coalesce("action", F.lit(""))
    # A rule table may be one file, and patterns take long to look through: spread over all tasks.
    named = rules_df.withColumn("name", name).repartition(4 * rules_df.sparkSession.sparkContext.defaultParallelism)
    rows = named.select(
        F.monotonically_increasing_id().alias("_id"),
        F.struct("ord", "name", rule_rest().alias("rest"), action.alias("action")).alias("_rule"),
        F.when(F.col("direction") != "", F.col("direction")).alias("direction"),
        F.array_distinct(F.coalesce("methods", F.array().cast("array<string>"))).alias("methods"),
        F.array_distinct(F.coalesce("tools", F.array().cast("array<string>"))).alias("tools"),
        F.pandas_udf(_translated, _TRANSLATED)("patterns").alias("t"),
    ).select("*", "t.*").drop("t")
    path = work_dir(rules_df.sparkSession, "rules")
    rows.write.parquet(path)
    return OrderedRules(rules_df.sparkSession.read.schema(rows.schema).parquet(path))


def content_keys(payload: str) -> tuple[Column, Column]:
    """Two hashes that tell contents apart; a null counts as a value of its own."""
    values = [F.col("direction"), F.col("method"), F.col("tool_name"), F.col(payload)]
    parts = [c for v in values for c in (v.isNull(), v)]
    return F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *parts)


def _bitmap(hashes: DataFrame, n: int) -> np.ndarray:
    bits = 1 << 12
    while bits < min(n * _BITS_EACH, _MOST_BITS):
        bits *= 2
    bit = F.col("hash").bitwiseAND(F.lit(bits - 1))
    words = hashes.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(hash & 63 AS INT))")).alias("set")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words["word"].to_numpy()] = words["set"].to_numpy().view(np.uint64)
    return out


def rules_met(messages: DataFrame, rules: OrderedRules, payload: str) -> DataFrame:
    """(_c1, _c2, _met) of the contents, named by `content_keys`, that meet a rule: the `_rule`s met, in no order.

    `messages` has the keys as `_c1` and `_c2`, null where no rule is to be met.
    """
    spark = messages.sparkSession
    literals = rules.rows.select("_id", F.explode("literals").alias("l")).select("_id", "l.*")
    shared = literals.groupBy("literal").agg(F.count(F.lit(1)).alias("n"))
    rank = F.struct("n", (-F.length("literal")).alias("length"), "literal", "hash")
    chosen = salted_join(literals, shared, ["literal"], "inner", F.col("_id")).groupBy("_id").agg(F.min(rank).alias("l"))
    chosen = chosen.select("_id", "l.literal", "l.hash")
    keyed = rules.rows.drop("literals", "every", "bad").join(chosen, "_id", "left")
    names = {"direction": F.col("direction").isNotNull(), "method": F.size("methods") > 0, "tool": F.size("tools") > 0, "hash": F.col("hash").isNotNull()}
    shape = sum((F.when(named, 1 << i).otherwise(0) for i, named in enumerate(names.values())), F.lit(0))
    path = work_dir(spark, "rule_keys")
    keyed = keyed.withColumn("shape", shape).withColumn("method", F.explode_outer("methods")).withColumn("tool", F.explode_outer("tools"))
    keyed = keyed.withColumn("_key", F.xxhash64("shape", "direction", "method", "tool", "hash"))
    keyed.write.parquet(path)
    keyed = spark.read.schema(keyed.schema).parquet(path)
    about = keyed.agg(
        F.collect_set("shape").alias("shapes"), F.collect_set(F.length("literal")).alias("lengths"), F.count_distinct("hash").alias("n"), F.max(F.size("linear") > 0).alias("linear")
    ).first()
    lengths = sorted(about["lengths"])
    bitmap = _bitmap(keyed.where("hash IS NOT NULL").select("hash").distinct(), about["n"])

    content = messages.where("_c1 IS NOT NULL").select("_c1", "_c2", "direction", "method", "tool_name", F.col(payload).alias("_text"))
    content = content.dropDuplicates(["_c1", "_c2"])
    none = F.lit(None)

    def key(shape: int, found: Column) -> Column:
        method, tool = F.coalesce("method", F.lit("")), F.when(F.col("tool_name") != "", F.col("tool_name"))
        values = [F.col("direction"), method, tool, found]
        kinds = ["string", "string", "string", "bigint"]
        return F.xxhash64(F.lit(shape), *(v if shape >> i & 1 else none.cast(k) for i, (v, k) in enumerate(zip(values, kinds, strict=True))))

    def keys(shape: int) -> Column:
        return F.transform("_found", lambda h: key(shape, h)) if shape & 8 else F.array(key(shape, none.cast("bigint")))

    every = F.concat(*map(keys, sorted(about["shapes"]))) if about["shapes"] else F.array().cast("array<bigint>")
    hits = content.withColumn("_found", _found_column(F.col("_text"), lengths, bitmap) if lengths else F.array().cast("array<bigint>"))
    hits = hits.select("_c1", "_c2", F.explode(every).alias("_key"))
    able = keyed.drop("literal", "hash").withColumnsRenamed({"direction": "_direction", "method": "_method", "tool": "_tool"})
    candidates = content.join(hits.join(able, "_key"), ["_c1", "_c2"])
    right = (F.col("_direction").isNull() | (F.col("_direction") == F.col("direction"))) & (
        (F.size("methods") == 0) | (F.col("_method") == F.coalesce("method", F.lit("")))
    )
    right &= (F.size("tools") == 0) | F.col("_tool").eqNullSafe(F.when(F.col("tool_name") != "", F.col("tool_name")))
    right &= F.coalesce(F.forall("java", lambda p: F.rlike(F.col("_text"), p)), F.lit(False))
    candidates = candidates.where(right)
    if about["linear"]:
        candidates = candidates.where(linear_match_all(F.col("linear"), F.col("_text")))
    return candidates.groupBy("_c1", "_c2").agg(F.collect_list("_rule").alias("_met"))
