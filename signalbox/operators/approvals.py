"""Human review as data: requests, decisions, timeouts."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbox import schemas as S
from signalbox.operators.correlate import micros
from signalbox.operators.messages import in_chain
from signalbox.operators.numbering import null_safe_join, numbered

DEFAULT_TIMEOUT = timedelta(seconds=60)
HISTORY_LIMIT = 100


def effective_timeout(timeout: timedelta) -> timedelta:
    return timeout if timeout > timedelta(0) else DEFAULT_TIMEOUT


def deadline(ts: Column, timeout: timedelta) -> Column:
    return (ts + F.lit(effective_timeout(timeout))).cast("timestamp")


def waits_for_review() -> Column:
    return in_chain() & F.coalesce(F.col("policy_action") == S.REQUIRE_APPROVAL, F.lit(False))


def approval_requests(df: DataFrame, ids: str = "key") -> DataFrame:
    """Requests for the messages a rule holds back, with `seq` to find them again.

    `ids`: "key" names a request by session and sequence number, which needs no
    ordering; "global" and "session" number requests `apr-1`, `apr-2`, ... in
    time order over everything or within the session.
    """
    requests = df.where(waits_for_review()).select(
        "ts",
        "session_id",
        "direction",
        "method",
        "tool_name",
        F.col("policy_rule").alias("rule_name"),
        "payload",
        F.lit(S.PENDING).alias("decision"),
        F.lit(None).cast("timestamp").alias("decided_at"),
        "seq",
    )
    return name_requests(requests, ids)


def name_requests(requests: DataFrame, ids: str) -> DataFrame:
    """The ids of `approval_requests`. Numbering reads the requests twice: stage them."""
    if ids == "key":
        return requests.withColumn("id", F.concat_ws("-", "session_id", "seq"))
    requests = requests.drop("id")
    keys = ("session_id",) if ids == "session" else ()
    return (
        numbered(requests, "_n", "ts", "session_id", "seq", keys=keys)
        .withColumn("id", F.concat(F.lit("apr-"), F.col("_n").cast("string")))
        .drop("_n")
    )


def first_decisions(requests: DataFrame, decisions: DataFrame, timeout: timedelta) -> DataFrame:
    """Per request id the decision that took effect: the first one made while it was pending.

    Time is cut into slots as long as the timeout, so a request's window touches its own slot and the next one,
    and decisions on one id that come over a long time meet in different tasks. The minimum is taken
    in each of them first, and adaptive execution can split an (id, slot) that is hot in itself.
    """
    span = micros(effective_timeout(timeout))
    slot = lambda ts: F.floor(F.unix_micros(ts) / F.lit(span)).cast("bigint")
    windows = requests.select("id", F.col("ts").alias("_from"), deadline(F.col("ts"), timeout).alias("_to"))
    # The slots of both ends: float division rounds, in the same way for all times of a slot's border.
    windows = windows.withColumn("_slot", F.explode(F.sequence(slot(F.col("_from")), slot(F.col("_to")))))
    made = decisions.select(F.col("approval_id").alias("id"), "decided_at", "approved", "decision_seq")
    return (
        made.withColumn("_slot", slot(F.col("decided_at")))
        .join(windows, ["id", "_slot"])
        .where(F.col("decided_at").between(F.col("_from"), F.col("_to")))
        .groupBy("id")
        .agg(F.min(F.struct("decided_at", "decision_seq", "approved")).alias("first"))
    )


def resolve_approvals(
    requests: DataFrame, decisions: DataFrame, timeout: timedelta = DEFAULT_TIMEOUT
) -> DataFrame:
    """Requests with their outcome: approved, denied, or timeout at the deadline."""
    first = first_decisions(requests, decisions, timeout)
    decided = F.col("first").isNotNull()
    return (
        requests.drop("decision", "decided_at")
        .join(first, "id", "left")
        .withColumns(
            {
                "decision": F.when(F.col("first.approved"), S.APPROVED)
                .when(decided, S.DENIED)
                .otherwise(S.TIMEOUT),
                "decided_at": F.when(decided, F.col("first.decided_at")).otherwise(
                    deadline(F.col("ts"), timeout)
                ),
            }
        )
        .drop("first")
    )


def apply_approvals(messages: DataFrame, resolved: DataFrame) -> DataFrame:
    """Forward what was approved; block what was denied, timed out or never resolved.

    Only messages that wait for review are joined; all others pass by the shuffle.
    """
    outcome = resolved.select("session_id", "seq", F.col("decision").alias("_decision"))
    rule = F.concat(F.lit(" (rule: "), F.col("policy_rule"), F.lit(")"))
    approved = F.coalesce(F.col("_decision") == S.APPROVED, F.lit(False))
    reason = (
        F.when(F.col("_decision") == S.DENIED, F.concat(F.lit("denied by human review"), rule))
        .when(F.col("_decision") == S.TIMEOUT, F.concat(F.lit("approval timed out"), rule))
        .otherwise("context cancelled while awaiting approval")
    )
    held = (
        messages.where(waits_for_review())
        .transform(lambda held: null_safe_join(held, outcome, ["session_id", "seq"], "left"))
        .withColumns(
            {
                "status": F.when(approved, S.FORWARDED).otherwise(S.BLOCKED),
                "block_reason": F.when(~approved, reason),
            }
        )
        .select(*messages.columns)
    )
    return messages.where(~waits_for_review()).unionByName(held)


def pending_approvals(
    requests: DataFrame,
    decisions: DataFrame,
    as_of: datetime | str,
    timeout: timedelta = DEFAULT_TIMEOUT,
) -> DataFrame:
    """Requests made, undecided and unexpired at `as_of`."""
    now = F.lit(as_of).cast("timestamp")
    made = requests.where((F.col("ts") <= now) & (now < deadline(F.col("ts"), timeout)))
    so_far = decisions.where(F.col("decided_at") <= now)
    return made.join(first_decisions(made, so_far, timeout), "id", "left_anti")


def pending_count(*args, **kwargs) -> DataFrame:
    """One row: how many approvals are pending."""
    return pending_approvals(*args, **kwargs).agg(F.count(F.lit(1)).alias("approval_pending"))


def approval_history(approvals: DataFrame, session: str | None = None) -> DataFrame:
    """The 100 newest approvals, of one session if given."""
    if session:
        approvals = approvals.where(F.col("session_id") == session)
    return approvals.orderBy(F.desc("ts"), F.desc("id")).limit(HISTORY_LIMIT)


def approval_events(requests: DataFrame, resolved: DataFrame) -> DataFrame:
    """One `requested` event per request and one `resolved` event per outcome."""
    requested = requests.withColumns(
        {
            "type": F.lit("requested"),
            "event_ts": F.col("ts"),
            "decision": F.lit(S.PENDING),
            "decided_at": F.lit(None).cast("timestamp"),
        }
    )
    done = resolved.withColumns({"type": F.lit("resolved"), "event_ts": F.col("decided_at")})
    columns = ["type", "event_ts", *[f.name for f in S.APPROVALS]]
    return requested.select(*columns).unionByName(done.select(*columns))


def rejected(
    requests: DataFrame, decisions: DataFrame, timeout: timedelta = DEFAULT_TIMEOUT
) -> DataFrame:
    """Decisions without effect: the id is unknown, not yet or no longer pending. `decision_seq` is unique within an id."""
    won = first_decisions(requests, decisions, timeout).select(
        F.col("id").alias("approval_id"), F.col("first.decision_seq").alias("decision_seq")
    )
    message = F.concat(
        F.lit('approval request "'), F.col("approval_id"), F.lit('" not found or already resolved')
    )
    # Every decision has a number of its own, so no key is hot here.
    return decisions.join(won, ["approval_id", "decision_seq"], "left_anti").withColumn("error", message)
