"""Redaction patterns and the per-pattern steps that apply them.

Patterns run in order, each on the text the one before left. Every step is its
own projection, so that neither the text nor the count of a step is computed
twice and the plan grows by one node per pattern.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbox.functions.plan import once
from signalbox.functions.regex import (
    PatternError,
    checked,
    is_context_free,
    linear_count,
    linear_count_each,
    linear_match,
    linear_replace,
    linear_replace_each,
    needs_linear_matcher,
)

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Pattern:
    """`java` finds what is redacted; no text without all of `hints` contains a hit."""

    label: str
    java: str
    hints: tuple[str, ...] = ()
    # A cheap test on raw JSON text: no hit in any value unless this is found in
    # the text around it. None: the values must be looked at.
    raw: str | None = None
    # The mark it leaves is itself a hit, so that equal text may have hits.
    finds_own_mark: bool = False
    # As written, where only a linear-time matcher can be trusted with it.
    linear: str | None = None


# What counts as a secret or personal data, in order of application.
API_KEY_PATTERNS = (
    ("sk-[A-Za-z0-9_-]{20,}", "sk-"),
    ("ghp_[A-Za-z0-9]{36,}", "ghp_"),
    ("gho_[A-Za-z0-9]{36,}", "gho_"),
    ("ghu_[A-Za-z0-9]{36,}", "ghu_"),
    ("ghs_[A-Za-z0-9]{36,}", "ghs_"),
    ("ghr_[A-Za-z0-9]{36,}", "ghr_"),
    ("AKIA[0-9A-Z]{16}", "AKIA"),
)
# [a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,} as Java matches it in linear time:
# a match can only begin where a run of name characters begins, or right after
# the match before (\G), and a run never gives characters back.
EMAIL = (
    r"(?:(?<![a-zA-Z0-9._%+\-])|\G)[a-zA-Z0-9._%+\-]++@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
)
# \b\d{3}-\d{2}-\d{4}\b and \b(?:\d{1,3}\.){3}\d{1,3}\b with ASCII word boundaries.
SSN = r"(?<![A-Za-z0-9_])\d{3}-\d{2}-\d{4}(?![A-Za-z0-9_])"
IPV4 = r"(?<![A-Za-z0-9_])(?:\d{1,3}\.){3}\d{1,3}(?![A-Za-z0-9_])"

DEFAULT_PATTERNS = tuple(
    Pattern("api_key", java, (hint,), hint) for java, hint in API_KEY_PATTERNS
) + (
    Pattern("email", EMAIL, ("@",), "@"),
    Pattern("ssn", SSN, ("-",), r"\d{3}-\d{2}-\d{4}"),
    Pattern("ip_address", IPV4, (".",), r"\d\.\d{1,3}\.\d{1,3}\.\d"),
)


def build_patterns(spark: SparkSession, custom=()) -> tuple[Pattern, ...]:
    """Defaults followed by custom patterns; an invalid one is skipped, a hard one goes to the linear-time matcher."""
    out = list(DEFAULT_PATTERNS)
    for c in custom:
        try:
            (java,) = checked(spark, [c.pattern])
        except PatternError as exc:
            log.warning("custom pattern %r skipped: %s", c.name, exc)
            continue
        hard = c.pattern if needs_linear_matcher(c.pattern) else None
        own = spark._jvm.java.util.regex.Pattern.compile(java).matcher(mark(c.label)).find()
        raw = java if is_context_free(c.pattern) and not hard else None
        out.append(Pattern(c.label, java, raw=raw, finds_own_mark=own, linear=hard))
    return tuple(out)


def mark(label: str) -> str:
    return f"[REDACTED:{label}]"


def replacement(label: str) -> str:
    """The mark, safe as a regex replacement."""
    return mark(label).replace("\\", "\\\\").replace("$", "\\$")


def _hit(text: Column, pattern: Pattern) -> Column:
    """The pattern is found; literal tests first, they are much cheaper."""
    if pattern.linear:
        return linear_match(pattern.linear, text)
    tests = [text.contains(h) for h in pattern.hints] + [text.rlike(pattern.java)]
    return reduce(lambda a, b: a & b, tests)


def redact_steps(
    df: DataFrame, text: str, patterns: tuple[Pattern, ...], active: Column | None = None
) -> tuple[DataFrame, list[str]]:
    """Redact column `text` in place; also returns one count column per pattern."""
    counts = []
    for i, pattern in enumerate(patterns):
        hit, count = "_hit", f"_n{i}"
        # A matcher outside of Spark sees no text of rows that are not active.
        seen = F.col(text) if active is None or not pattern.linear else F.when(active, F.col(text))
        test = _hit(seen, pattern)
        if active is not None:
            test = active & test
        df = df.withColumn(hit, once(test))
        found = F.when(F.col(hit), F.col(text))
        if pattern.linear:
            number, cleaned = linear_count(pattern.linear, found), linear_replace(pattern.linear, mark(pattern.label), found)
        else:
            number = F.regexp_count(F.col(text), F.lit(pattern.java))
            cleaned = F.regexp_replace(F.col(text), pattern.java, replacement(pattern.label))
        df = df.withColumns(
            {
                count: F.when(F.col(hit), number).otherwise(0),
                text: F.when(F.col(hit), cleaned).otherwise(F.col(text)),
            }
        )
        counts.append(count)
    return df.drop("_hit"), counts


def redact_value_steps(
    df: DataFrame, values: str, patterns: tuple[Pattern, ...]
) -> tuple[DataFrame, list[str]]:
    """The same over a column of type array<string>."""
    counts = []
    for i, pattern in enumerate(patterns):
        count = f"_n{i}"
        if pattern.linear:
            cleaned = linear_replace_each(pattern.linear, mark(pattern.label), F.col(values))
        else:
            cleaned = F.transform(values, _cleaner(pattern))
        df = df.withColumn("_next", once(cleaned))
        touched = F.lit(True) if pattern.finds_own_mark else ~F.col(values).eqNullSafe(F.col("_next"))
        df = df.withColumns(
            {
                count: F.when(touched, linear_count_each(pattern.linear, F.when(touched, F.col(values))) if pattern.linear else _tally(values, pattern)).otherwise(0),
                values: F.col("_next"),
            }
        )
        counts.append(count)
    return df.drop("_next"), counts


def _tally(values: str, pattern: Pattern) -> Column:
    def add(acc: Column, x: Column) -> Column:
        return acc + F.coalesce(F.regexp_count(x, F.lit(pattern.java)), F.lit(0))

    return F.coalesce(F.aggregate(values, F.lit(0), add), F.lit(0))


def _cleaner(pattern: Pattern):
    def clean(x: Column) -> Column:
        cleaned = F.regexp_replace(x, pattern.java, replacement(pattern.label))
        return F.when(_hit(x, pattern), cleaned).otherwise(x)

    return clean


def raw_test(payload: Column, patterns: tuple[Pattern, ...]) -> Column:
    """False only if no string value inside the JSON text can contain a hit.

    An escape can hide any character, so text with \\u escapes is always looked
    at; for custom patterns, any escape makes the values differ from the text.
    """
    tests: list[Column] = [payload.contains("\\u")]
    customs = patterns[len(DEFAULT_PATTERNS):]
    if customs:
        tests.append(payload.contains("\\"))
    for p in patterns:
        if p.raw is None:
            return F.lit(True)
        tests.append(payload.contains(p.raw) if p.hints == (p.raw,) else payload.rlike(p.raw))
    return reduce(lambda a, b: a | b, tests)


def total(counts: list[str]) -> Column:
    return reduce(lambda a, b: a + b, (F.col(c) for c in counts), F.lit(0)).cast("int")


