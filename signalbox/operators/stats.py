"""Reports over the message table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbox import schemas as S
from signalbox.functions import rpc

DEFAULT_LIMIT = 200
FEED_LIMIT = 100
TOP_METHODS = 20


def query_messages(
    df: DataFrame,
    session_id: str | None = None,
    direction: str | None = None,
    method: str | None = None,
    kind: str | None = None,
    since: datetime | str | None = None,
    limit: int = 0,
    offset: int = 0,
) -> DataFrame:
    """Newest messages first, by the filters that are set; 200 if no limit is given.

    On a stored table `since` also skips the partitions of earlier days. Filters
    reach the scan of a stored table; rows still to be parsed are best filtered
    before `open_messages`.
    """
    for name, value in (
        ("session_id", session_id),
        ("direction", direction),
        ("method", method),
        ("kind", kind),
    ):
        if value:
            df = df.where(F.col(name) == value)
    if since is not None:
        start = F.lit(since).cast("timestamp")
        df = df.where(F.col("ts") >= start)
        if "date" in df.columns:
            df = df.where(F.col("date") >= F.to_date(start))
    df = df.orderBy(F.desc("id"))
    if offset > 0:
        df = df.offset(offset)
    return df.limit(limit if limit > 0 else DEFAULT_LIMIT)


def find_message(df: DataFrame, message_id: int, day: str | None = None) -> DataFrame:
    """The message as a DataFrame of at most one row; of a stored table only `day`, if given."""
    found = df.where(F.col("id") == message_id)
    return found.where(F.col("date") == F.lit(day).cast("date")) if day else found


def get_message(df: DataFrame, message_id: int):
    """The message as a Row; an error if there is none."""
    row = find_message(df, message_id).first()
    if row is None:
        raise LookupError(f"no message with id {message_id}")
    return row


def recent_feed(df: DataFrame) -> DataFrame:
    return query_messages(df, limit=FEED_LIMIT)


def _total(col: str, name: str):
    return F.coalesce(F.sum(F.col(col).cast("bigint")), F.lit(0)).alias(name)


def totals() -> list:
    return [
        F.count(F.lit(1)).alias("total_messages"),
        _total("size_bytes", "total_bytes"),
        _total("blocked", "blocked_count"),
        _total("scrub_count", "scrub_count"),
        _total("audit", "audit_count"),
    ]


def kinds() -> list:
    return [F.count_if(F.col("kind") == kind).alias(f"{kind}_count") for kind in S.KINDS]


def of_session(df: DataFrame, session: str | None) -> DataFrame:
    return df.where(F.col("session_id") == session) if session else df


def stats_totals(df: DataFrame, session: str | None = None) -> DataFrame:
    """One row: messages, bytes, blocked, scrubbed items, audited; 0 where there is none."""
    return of_session(df, session).agg(*totals())


def kind_counts(df: DataFrame, session: str | None = None) -> DataFrame:
    """One row: messages per kind; other kinds are not counted."""
    return of_session(df, session).agg(*kinds())


def method_counts(df: DataFrame, session: str | None = None, top: int = TOP_METHODS) -> DataFrame:
    """The most frequent methods; equal counts in order of the name."""
    return (
        of_session(df, session)
        .where(rpc.nonempty(F.col("method")))
        .groupBy("method")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .orderBy(F.desc("cnt"), "method")
        .limit(top)
    )


def stats(df: DataFrame, session: str | None = None, pending: DataFrame | None = None) -> DataFrame:
    """One row with totals, kinds, the top methods as a map, and open approvals.

    `pending` is a one-row frame with `approval_pending`.
    """
    counts = of_session(df, session).agg(*totals(), *kinds())
    methods = method_counts(df, session).agg(
        F.map_from_entries(F.collect_list(F.struct("method", "cnt"))).alias("method_counts")
    )
    one = F.lit(True)
    out = counts.join(F.broadcast(methods), one, "left")
    if pending is None:
        return out.withColumn("approval_pending", F.lit(0).cast("bigint"))
    return out.join(F.broadcast(pending), one, "left")


def stats_by_session(df: DataFrame) -> DataFrame:
    """Totals and kinds of every session at once."""
    return df.groupBy("session_id").agg(*totals(), *kinds())
