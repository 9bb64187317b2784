"""Captured traffic in: raw lines, and enveloped rows; rules and patterns as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbox import schemas as S
from signalbox.operators.policy import RULES_PER_PART, CustomPattern, Policy, check_rules, read_rule_parts

MAX_MESSAGE_BYTES = 10 * 1024 * 1024


def clean_lines(df: DataFrame, line: str = "value", max_bytes: int = MAX_MESSAGE_BYTES) -> DataFrame:
    """Lines to payloads: one trailing CR goes, empty lines are skipped, others stay.

    Lines of blanks are not empty; they fail to parse later. Lines at or over the
    size limit are kept and marked `oversize`.
    """
    text = F.col(line)
    body = F.when(text.endswith("\r"), F.left(text, F.length(text) - 1)).otherwise(text)
    return (
        df.withColumn("payload", body)
        .where(F.col("payload") != "")
        .withColumn("oversize", F.octet_length("payload") >= max_bytes)
        .drop(*([line] if line != "payload" else []))
    )


def read_capture(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Newline-delimited captures; folders like `session_id=s1/direction=...` give columns."""
    reader = (spark.readStream if streaming else spark.read).option("lineSep", "\n")
    return clean_lines(reader.text(path))


def read_envelopes(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Captures with one JSON envelope per line: seq, ts, session_id, direction, payload."""
    reader = spark.readStream if streaming else spark.read
    return clean_lines(reader.schema(S.RAW_MESSAGES).json(path), "payload")


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """The rule table from JSON lines; `ord` is the rule order."""
    return spark.read.schema(S.RULES).json(path)


def read_custom_patterns(spark: SparkSession, path: str) -> list[CustomPattern]:
    """Custom redaction patterns from JSON lines, in `ord` order."""
    rows = spark.read.schema(S.CUSTOM_PATTERNS).json(path).orderBy("ord").collect()
    return [CustomPattern(r["name"], r["pattern"], r["label"]) for r in rows]


def read_policy(
    spark: SparkSession, rules: str, patterns: str | None = None, scrub: bool = False, max_rules: int = RULES_PER_PART
) -> Policy:
    """A `Policy` from files: rules, custom redaction patterns and whether redaction is on.

    Stops at a bad rule pattern, naming rule and pattern, before any job over messages starts. A bad custom
    pattern is skipped with a warning when redaction is set up. A `Policy` lives on the driver: more than
    `max_rules` rules are an error here, and belong in `enforce_policy` as a table (`read_rules`).
    """
    parts = read_rule_parts(read_rules(spark, rules), max_rules)
    found = next(parts, [])
    if next(parts, None):
        raise ValueError(f"more than {max_rules} rules in {rules}: hand them to enforce_policy as a table")
    check_rules(found)
    custom = read_custom_patterns(spark, patterns) if patterns else []
    return Policy(tuple(found), scrub, tuple(custom))
