"""The whole chain over a capture: policy, redaction, review, listings, tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbox.operators import tools as tools_ops
from signalbox.operators.approvals import (
    DEFAULT_TIMEOUT,
    apply_approvals,
    approval_requests,
    resolve_approvals,
)
from signalbox.operators.chain import block_responses, run_chain
from signalbox.operators.correlate import DEFAULT_TTL, list_responses
from signalbox.operators.messages import in_chain, open_messages, to_log_rows
from signalbox.operators.policy import Policy, enforce_policy
from signalbox.operators.scrub import scrub_messages
from signalbox.sources.tables import register_tools, staged


@dataclass(frozen=True)
class Governed:
    outcomes: DataFrame  # every input row with status, annotations and final payload
    messages: DataFrame  # the message table
    approvals: DataFrame | None  # requests with their outcome
    registry: DataFrame  # tools seen, per session
    prune_marks: DataFrame | None  # entries of listings with `keep`
    replies: DataFrame  # errors for the senders of blocked messages


def screen(raw: DataFrame, policy: Policy) -> DataFrame:
    """The stateless stages: parse, policy (on the text as sent), then redaction."""
    return run_chain(
        open_messages(raw),
        lambda df: enforce_policy(df, list(policy.rules)),
        lambda df: scrub_messages(df, policy.scrub, policy.active_patterns()),
    )


def govern(
    raw: DataFrame,
    policy: Policy,
    decisions: DataFrame | None = None,
    timeout: timedelta = DEFAULT_TIMEOUT,
    prune: tools_ops.PruneConfig = tools_ops.PruneConfig(),
    usage: DataFrame | None = None,
    protected_sessions: DataFrame | None = None,
    ttl: timedelta = DEFAULT_TTL,
    stage_dir: str | None = None,
    request_ids: Callable[[DataFrame], DataFrame] | None = None,
) -> Governed:
    """Run the chain over raw messages (unique `seq` within a session).

    The screened rows are used several times: for requests, for pairing (narrow
    columns only), for listings, and for the rest. `stage_dir` writes them once
    as files, so that payloads are parsed and redacted once and each later use
    reads just its columns; leave it out only for small inputs.

    `decisions` without effect on a message lets it time out; None skips review,
    as if everything were approved. `usage` are the call counts pruning goes by.
    `protected_sessions` (session_id) see all tools. `request_ids` renames the
    review requests where decisions know them by other ids.
    """
    screened = screen(raw, policy)
    if stage_dir:
        screened = staged(screened, f"{stage_dir}/screened")

    approvals = None
    reviewed = screened
    if decisions is not None:
        requests = approval_requests(screened)
        if request_ids:
            requests = request_ids(requests)
        approvals = resolve_approvals(requests, decisions, timeout)
        reviewed = apply_approvals(screened, approvals)

    listings = list_responses(reviewed, ttl)
    if stage_dir:
        listings = staged(listings, f"{stage_dir}/listings")
    registry = register_tools(tools_ops.extract_tools(listings))

    marks = None
    outcomes = reviewed.withColumn("tools_pruned", F.lit(None).cast("int"))
    if prune.enabled:
        prunable = listings
        if protected_sessions is not None:
            prunable = listings.join(protected_sessions, "session_id", "left_anti")
        marks = tools_ops.prune_tools(tools_ops.tool_entries(prunable), usage, prune)
        outcomes = replace_listings(reviewed, tools_ops.rebuild_list_responses(prunable, marks))

    return Governed(
        outcomes=outcomes,
        messages=to_log_rows(outcomes),
        approvals=approvals,
        registry=registry,
        prune_marks=marks,
        replies=block_responses(outcomes),
    )


def replace_listings(df: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Put rebuilt listing texts in place; only responses with tools are joined."""
    new = rebuilt.select("session_id", "seq", F.col("payload").alias("_payload"), "tools_pruned")
    carriers = in_chain() & F.col("lists_tools")
    replaced = (
        df.where(carriers)
        .join(new, ["session_id", "seq"], "left")
        .withColumn("payload", F.coalesce("_payload", "payload"))
        .drop("_payload")
    )
    rest = df.where(~carriers).withColumn("tools_pruned", F.lit(None).cast("int"))
    return rest.unionByName(replaced.select(*rest.columns))


def first_session(sessions: DataFrame) -> DataFrame:
    """The session that started first, as `protected_sessions`: it sees every tool."""
    return sessions.agg(F.min(F.struct("started_at", "id")).alias("_first")).select(
        F.col("_first.id").alias("session_id")
    )
