"""The inputs the registered queries run on, all derived from the given tables."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbox import schemas as S
from signalbox.operators.approvals import approval_requests
from signalbox.operators.messages import open_messages, to_log_rows
from signalbox.operators.policy import CustomPattern, Rule, enforce_policy
from signalbox.operators.tools import PruneConfig, tool_usage_counts
from signalbox.session import work_dir
from signalbox.sources import traffic as T
from signalbox.sources.tables import register_tools, staged

RULES = [
    Rule("block-early-deletes", S.DENY, ("tools/call",), ("delete_file",), patterns=(r'"k": [0-9]\b',)),
    Rule("review-deletes", S.REQUIRE_APPROVAL, ("tools/call",), ("delete_file",)),
    Rule("audit-calls", S.AUDIT, ("tools/call",)),
    Rule("watch-errors", S.AUDIT, direction=S.SERVER_TO_HOST, patterns=("-32603", r'"k": \d*5\b')),
    Rule("note-listings", "note", ("tools/list",)),
]
CUSTOM = (
    CustomPattern("hex-token", r"\b[0-9a-f]{40}\b", "hex_token"),
    CustomPattern("broken", "[unclosed", "never"),
)
LIST_TTL = timedelta(days=7)
REVIEW_TIMEOUT = timedelta(minutes=10)
RECENT_SESSIONS = 40
PRUNE_UNUSED = PruneConfig(unused_sessions=RECENT_SESSIONS, always_keep=("list_dir",))
PRUNE_TOP = PruneConfig(keep_top_k=3, always_keep=("run_shell",))


def events(spark: SparkSession, sf: str) -> DataFrame:
    return T.table(spark, sf, "events")


def raw(spark: SparkSession, sf: str) -> DataFrame:
    return T.traffic(events(spark, sf))


def opened(spark: SparkSession, sf: str) -> DataFrame:
    return open_messages(raw(spark, sf))


def enforced(spark: SparkSession, sf: str) -> DataFrame:
    return enforce_policy(opened(spark, sf), RULES)


def logged(spark: SparkSession, sf: str, keep: Column | None = None) -> DataFrame:
    """Log rows of all traffic, or of what `keep` selects before anything is parsed."""
    messages = raw(spark, sf)
    if keep is not None:
        messages = messages.where(keep)
    return to_log_rows(enforce_policy(open_messages(messages), RULES))


def calls(spark: SparkSession, sf: str) -> DataFrame:
    return T.tool_calls(events(spark, sf))


def registry(spark: SparkSession, sf: str) -> DataFrame:
    seen = register_tools(T.sightings(events(spark, sf)))
    idle = seen.groupBy("session_id").agg(F.min("first_seen").alias("first_seen")).select(
        "session_id",
        F.lit("idle_tool").alias("tool_name"),
        F.lit("a tool that is listed in every session but that no message ever calls").alias("description"),
        "first_seen",
    )
    return seen.unionByName(idle)


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Review requests, written once: they are few, and finding them costs a full parse."""
    found = approval_requests(enforced(spark, sf)).withColumn("id", T.request_id(F.col("seq")))
    return staged(found, work_dir(spark, "requests"))


def staged_messages(df: DataFrame, name: str = "messages") -> DataFrame:
    """Messages that a query uses several times, parsed once and read by column."""
    return staged(df, work_dir(df.sparkSession, name))


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    return T.decisions(events(spark, sf))


def usage(spark: SparkSession, sf: str, last_n: int) -> DataFrame:
    return tool_usage_counts(opened(spark, sf), T.sessions(events(spark, sf)), last_n)


def rule_table(spark: SparkSession, sf: str) -> DataFrame:
    """A rule per event type and a rule per value of k, over the tool calls of `calls`."""
    ev = events(spark, sf)
    text = "array<string>"
    actions = F.array(*(F.lit(a) for a in (S.AUDIT, S.REQUIRE_APPROVAL, S.DENY, "note")))
    per_k = ev.select("k").distinct().select(
        F.col("k").cast("int").alias("ord"),
        F.concat(F.lit("k-"), "k").alias("name"),
        F.get(actions, (F.col("k") % 4).cast("int")).alias("action"),
        F.array(F.lit("tools/call")).alias("methods"),
        F.array().cast(text).alias("tools"),
        F.lit("").alias("direction"),
        F.array(F.concat(F.lit('"k": '), "k", F.lit(r"\b"))).alias("patterns"),
    )
    tools = F.array(F.lit("delete_file"))
    extra = ev.agg(F.max("k").alias("top")).select(
        (F.col("top") + 1).cast("int").alias("ord"),
        F.lit("deletes").alias("name"),
        F.lit(S.REQUIRE_APPROVAL).alias("action"),
        F.array().cast(text).alias("methods"),
        tools.alias("tools"),
        F.lit(S.HOST_TO_SERVER).alias("direction"),
        F.array().cast(text).alias("patterns"),
    )
    return per_k.unionByName(extra)
