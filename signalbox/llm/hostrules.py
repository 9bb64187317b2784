"""Quality rules judged per document and per host, in column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbox.functions.plan import once
from signalbox.llm.staging import staged

MIN_WORDS, MAX_REPEATED_PERCENT, MAX_HOST_RATE = 50, 50, 0.5
_SPACE = " \t\n\x0b\f\r"
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(_SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{_SPACE}]+"))


def with_metrics(docs: DataFrame) -> DataFrame:
    """`docs` (text and any others) with `METRICS` (long) and `base_failed`.

    A word is a run of characters other than 0x20 and 0x09-0x0D. A null text reads as empty and
    fails, having too few words. `n_repeat_words` counts the words in windows of three words that
    the text holds twice or more: windows are hashed to 64 bits, sorted with their places, and the
    places with an equal neighbour cover the words counted. Every step is its own projection, as a
    column used inside a lambda is computed anew for each element otherwise.
    """
    rows = docs.withColumn("_text", once(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    rows = rows.withColumn("_words", once(_words(F.col("_text"))))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.length(F.btrim(x, F.lit(_SPACE))) > 0)
    rows = rows.withColumn("_lines", once(lines))
    window = lambda x, i: F.xxhash64(x, F.get("_words", i + 1), F.get("_words", i + 2))
    hashes = F.when(F.size("_words") > 3, F.slice(F.transform("_words", window), F.lit(1), F.size("_words") - 2))
    rows = rows.withColumn("_windows", once(hashes))
    rows = rows.withColumn("_again", once(F.size(F.array_distinct("_windows")) < F.size("_windows")))
    placed = F.array_sort(F.transform("_windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    rows = rows.withColumn("_sorted", once(F.when(F.col("_again"), placed)))
    twice = F.filter(
        "_sorted",
        lambda x, k: (x["h"] == F.get("_sorted", k - 1)["h"]) | (x["h"] == F.get("_sorted", k + 1)["h"]),
    )
    covered = F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    rows = rows.select(
        *docs.columns,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_again"), F.size(F.array_distinct(covered))).otherwise(0).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def host_rates(rows: DataFrame, host: str = "source") -> DataFrame:
    """(host, n_docs, n_failed, fail_rate): each host's share of failed documents, shrunk.

    The prior is a beta distribution fitted to the hosts' own rates by mean m and variance v, with
    strength s = m (1 - m) / v - 1, so the rate of a host with few documents stays near that of all.
    Without spread between hosts, every rate is m; where the fit has no positive strength, s is 1.
    Only m and v reach the driver. A null host is a host of its own.
    """
    hosts = rows.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed")
    )
    rate = F.col("n_failed") / F.col("n_docs")
    m, v = hosts.agg(F.avg(rate), F.var_pop(rate)).first()
    if m is None:
        m, v = 0.0, 0.0
    if v > 1e-12:
        strength = m * (1 - m) / v - 1
        strength = strength if strength > 0 else 1.0
        shrunk = (F.col("n_failed") + F.lit(m * strength)) / (F.col("n_docs") + F.lit(strength))
    else:
        shrunk = F.lit(float(m))
    return hosts.withColumn("fail_rate", shrunk)


def judged(docs: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE, carry: tuple[str, ...] | None = None) -> DataFrame:
    """`docs` (text, the host column and any others) with metrics, `base_failed`, `host_rejected` and `kept`.

    A document is kept if it passes the rules itself and its host's shrunk rate of failures is at
    most `max_rate`. Rows are counted as they are, repeated ones too. Columns of `docs` with the
    names of results are replaced; `carry` names the columns to go on with (default: all). Metrics
    are written once, for the counts by host and for the join of verdicts; the table of hosts is
    aggregated first, and the join is left to the engine, which splits hosts with many documents.
    """
    made = {*METRICS, "base_failed", "host_rejected", "kept", "_host", "_rate"}
    keep = [c for c in (docs.columns if carry is None else carry) if c not in made]
    rows = docs.select(*dict.fromkeys([*keep, "text", host]))
    rows = staged(with_metrics(rows).select(*dict.fromkeys([*keep, host]), *METRICS, "base_failed"), "metrics")
    rates = host_rates(rows, host).select(F.col("host").alias("_host"), F.col("fail_rate").alias("_rate"))
    rows = rows.join(rates, F.col(host).eqNullSafe(F.col("_host")), "left")
    rejected = F.col("_rate") > max_rate
    return rows.select(*keep, *METRICS, "base_failed", rejected.alias("host_rejected"), (~F.col("base_failed") & ~rejected).alias("kept"))


def accepted(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that `judged` keeps, with the columns of `docs`."""
    return judged(docs, **options).where("kept").select(*docs.columns)


ORACLE = f"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0b\\f\\r]')) AS lines
  FROM documents),
win AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM w, unnest(range(1, len(words) - 1)) t(i)),
dup AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM dup, unnest([0, 1, 2]) u(d) GROUP BY doc_id),
m AS (
  SELECT doc_id, source, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS f FROM b GROUP BY source),
p AS (SELECT avg(f / n) AS m, var_pop(f / n) AS v FROM h),
s AS (SELECT m, v, CASE WHEN v > 1e-12 AND m * (1 - m) / v - 1 > 0 THEN m * (1 - m) / v - 1 ELSE 1 END AS s FROM p),
r AS (SELECT source, CASE WHEN v > 1e-12 THEN (f + m * s) / (n + s) ELSE m END > {MAX_HOST_RATE} AS host_rejected FROM h, s)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, host_rejected,
  NOT base_failed AND NOT host_rejected AS kept
FROM b JOIN r ON b.source IS NOT DISTINCT FROM r.source"""
