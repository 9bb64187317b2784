"""Redaction of secrets and personal data in text and in JSON string values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbox import schemas as S
from signalbox.functions import redact, rpc
from signalbox.functions.plan import once
from signalbox.operators.messages import in_chain

# JSON text as tokens: a string (with the colon behind it, if it is a key), or
# what lies between strings. Possessive, so long strings cost no stack.
_TOKENS = r'"(?:[^"\\]++|\\.)*+"(?:\s*+:)?|[^"]++'


def scrub_text(df: DataFrame, column: str, custom_patterns=()) -> DataFrame:
    """Redact `column` and add `scrub_count`, the redactions summed over all patterns."""
    patterns = redact.build_patterns(df.sparkSession, custom_patterns)
    df, counts = redact.redact_steps(df, column, patterns)
    return df.withColumn("scrub_count", F.coalesce(redact.total(counts), F.lit(0))).drop(*counts)


def scrub_label_counts(df: DataFrame, column: str, custom_patterns=()) -> DataFrame:
    """Redact `column` and add `label_counts`, a map from label to redactions (hits only)."""
    patterns = redact.build_patterns(df.sparkSession, custom_patterns)
    df, counts = redact.redact_steps(df, column, patterns)
    return _with_label_counts(df, patterns, counts)


def _with_label_counts(df: DataFrame, patterns, counts: list[str]) -> DataFrame:
    labels: dict[str, list[Column]] = {}
    for pattern, count in zip(patterns, counts, strict=True):
        labels.setdefault(pattern.label, []).append(F.col(count))
    pairs = [
        F.struct(
            F.lit(label).alias("label"),
            reduce(lambda a, b: a + b, cols).cast("bigint").alias("n"),
        )
        for label, cols in labels.items()
    ]
    hits = F.filter(F.array(*pairs), lambda p: p["n"] > 0)
    return df.withColumn("label_counts", hits).drop(*counts)


def scrub_json(
    df: DataFrame,
    column: str = "payload",
    custom_patterns=(),
    active: Column | None = None,
    known_json: bool = False,
    label_counts: bool = False,
) -> DataFrame:
    """Redact string values at any depth of a JSON text and add `scrub_count`.

    Keys, numbers and layout keep their text; only changed strings are written
    anew. Text that is not JSON is redacted as plain text. `active` limits the
    work to some rows, `known_json` skips the check of rows already parsed.
    """
    patterns = redact.build_patterns(df.sparkSession, custom_patterns)
    kept = df.columns
    text = F.col(column)
    wanted = redact.raw_test(text, patterns)
    if active is not None:
        wanted = active & wanted
    df = df.withColumn("_walk", once(F.coalesce(wanted, F.lit(False))))
    if known_json:
        df = df.withColumn("_json", F.col("_walk"))
    else:
        df = (
            df.withColumn("_mark", F.when(F.col("_walk"), F.crc32(text)))
            .withColumn("_w", once(F.when(F.col("_walk"), rpc.wrapped(text, F.col("_mark")))))
            .withColumn("_json", once(F.col("_walk") & rpc.is_whole(F.col("_w"), F.col("_mark"))))
            .drop("_w", "_mark")
        )
    df = (
        df.withColumn(
            "_tokens",
            once(F.when(F.col("_json"), F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0)))),
        )
        .withColumn("_before", once(F.transform("_tokens", _value_of)))
        .withColumn("_after", F.col("_before"))
    )
    df, counts = redact.redact_value_steps(df, "_after", patterns)
    df = df.withColumns({f"_v{c}": F.col(c) for c in counts}).drop(*counts)
    if known_json:
        sums = [f"_v{c}" for c in counts]
    else:
        plain = F.col("_walk") & ~F.col("_json")
        df, plain_counts = redact.redact_steps(df, column, patterns, active=plain)
        df = df.withColumns({f"_v{c}": F.col(f"_v{c}") + F.coalesce(F.col(c), F.lit(0)) for c in plain_counts})
        df = df.drop(*plain_counts)
        sums = [f"_v{c}" for c in counts]
    rebuilt = F.array_join(
        F.zip_with(
            F.arrays_zip("_tokens", "_before"),
            "_after",
            lambda old, new: F.when(old["_before"].eqNullSafe(new), old["_tokens"]).otherwise(
                rpc.json_text(new)
            ),
        ),
        "",
    )
    df = df.withColumn("scrub_count", once(redact.total(sums))).withColumn(
        column, F.when(F.col("_json") & (F.col("scrub_count") > 0), rebuilt).otherwise(text)
    )
    extra = ["scrub_count"]
    if label_counts:
        df = _with_label_counts(df, patterns, sums)
        extra.append("label_counts")
    return df.select(*kept, *[c for c in extra if c not in kept])


def _value_of(token: Column) -> Column:
    """The content of a string token that is a value; NULL for keys and punctuation."""
    inner = token.substr(F.lit(2), F.length(token) - 2)
    decoded = F.get(
        F.from_json(F.concat(F.lit("["), token, F.lit("]")), "array<string>"), F.lit(0)
    )
    is_value = token.startswith('"') & ~token.endswith(":")
    return F.when(is_value, F.when(token.contains("\\"), decoded).otherwise(inner))


def scrub_messages(df: DataFrame, enabled: bool = True, custom_patterns=(), **options) -> DataFrame:
    """The scrub stage: redact what servers send, and only that."""
    if not enabled:
        return df if "scrub_count" in df.columns else df.withColumn("scrub_count", F.lit(0))
    incoming = F.col("direction") == S.SERVER_TO_HOST
    parsed = {"status", "parse_error"} <= set(df.columns)
    return scrub_json(
        df,
        custom_patterns=custom_patterns,
        active=in_chain() & incoming if parsed else incoming,
        known_json=parsed,
        **options,
    )


def pii_report(df: DataFrame, *keys: str) -> DataFrame:
    """Redactions per label, and per `keys` if given, from rows with `label_counts`."""
    return (
        df.select(*keys, F.explode("label_counts").alias("hit"))
        .groupBy(*keys, F.col("hit.label").alias("label"))
        .agg(F.sum("hit.n").alias("redactions"))
    )
