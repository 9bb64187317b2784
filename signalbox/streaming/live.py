"""The chain and its reports on live streams.

Stateless stages are the batch functions themselves. State lives in Spark's own
stores or, for pairing listings, in written tables per batch; restarts continue
from the checkpoint without loss or repetition.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from signalbox import schemas as S
from signalbox.operators.approvals import DEFAULT_TIMEOUT, effective_timeout, resolve_approvals
from signalbox.operators.correlate import DEFAULT_TTL, match_events, micros
from signalbox.operators.messages import to_log_rows
from signalbox.operators.policy import Policy
from signalbox.operators.stats import stats_by_session
from signalbox.operators.tools import calls, listed_usage
from signalbox.plans.governed import screen
from signalbox.sources.tables import to_storage

Sink = Callable[[DataFrame, int], None]

FLUSH_EVERY = "500 milliseconds"
# Files and reports gain nothing from half-second batches.
WRITE_EVERY = "30 seconds"
REPORT_EVERY = "1 minute"
LATENESS = timedelta(minutes=10)


def _seconds(span: timedelta) -> str:
    return f"{micros(span)} microseconds"


def stream_messages(raw: DataFrame, policy: Policy) -> DataFrame:
    """Log rows of a raw message stream: parsed, checked, redacted."""
    return to_log_rows(screen(raw, policy))


def start(writer, checkpoint: str, once: bool, every: str = FLUSH_EVERY) -> StreamingQuery:
    """`once` works off what is there and ends; else a batch follows each span `every`."""
    writer = writer.option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if once else {"processingTime": every}
    return writer.trigger(**trigger).start()


def append_messages(
    rows: DataFrame, path: str, checkpoint: str, once: bool = False, every: str = WRITE_EVERY
) -> StreamingQuery:
    """Append log rows to the message table, each exactly once.

    Every batch adds a file per day; `tables.compact_messages` writes such days anew.
    """
    writer = to_storage(rows).writeStream.partitionBy("date").format("parquet").option("path", path)
    return start(writer, checkpoint, once, every)


def fan_out(
    df: DataFrame, sinks: dict[str, Sink], checkpoint: str, once: bool = False, every: str = FLUSH_EVERY
) -> StreamingQuery:
    """Hand every batch to all sinks. None misses rows; a slow one holds up the next batch.

    A sink gets the batch and its number, and may get the same number again after
    a failure: it should overwrite what it wrote under that number.
    """

    def deliver(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for sink in sinks.values():
                sink(batch, batch_id)
        finally:
            batch.unpersist()

    return start(df.writeStream.foreachBatch(deliver), checkpoint, once, every)


def batch_table(path: str, select: Callable[[DataFrame], DataFrame] = lambda df: df) -> Sink:
    """A sink that keeps one folder per batch number, so a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        select(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def report_versions(path: str) -> Sink:
    """A sink that keeps one version per batch, for `latest_version` to read.

    A version appears when it is complete, and none is taken away, so a reader
    never meets a half-written report.
    """

    def write(report: DataFrame, batch_id: int) -> None:
        report.write.mode("overwrite").parquet(f"{path}/version={batch_id}")

    return write


def latest_version(spark: SparkSession, path: str) -> DataFrame:
    """The newest report of `report_versions`; only its files are read."""
    versions = spark.read.parquet(path)
    newest = versions.agg(F.max("version")).first()[0]
    return versions.where(F.col("version") == newest).drop("version")


def live_stats(messages: DataFrame) -> DataFrame:
    """Running totals and kinds per session, for update or complete output."""
    return stats_by_session(messages)


def live_tool_analytics(
    messages: DataFrame,
    registry: DataFrame,
    sink: Sink,
    checkpoint: str,
    once: bool = False,
    every: str = REPORT_EVERY,
) -> StreamingQuery:
    """Running tool analytics: each batch hands the current report to `sink`.

    Usage is kept per (tool, session), so that counting sessions stays exact.
    """
    per_session = (
        calls(messages)
        .groupBy("tool_name", "session_id")
        .agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
    )

    def report(state: DataFrame, batch_id: int) -> None:
        usage = state.groupBy("tool_name").agg(
            F.sum("n").alias("call_count"),
            F.count(F.lit(1)).alias("sessions_used"),
            F.max("last").alias("last_used"),
        )
        sink(listed_usage(registry, usage), batch_id)

    return start(per_session.writeStream.outputMode("complete").foreachBatch(report), checkpoint, once, every)


class ListPairing:
    """`correlate_lists` on a stream of `list_events` rows.

    Rows may arrive out of order within `lateness`. Each batch closes the rows
    older than that, pairs them with the batch operator, and keeps as written
    state the rows still open and the requests still pending. State and results
    are files under `root`, named by batch, so a repeated batch replaces its own
    output. Rows that come after their time was closed cannot change what was
    reported; they are kept under `late`.
    """

    COLUMNS = "session_id STRING, msg_id STRING, ts TIMESTAMP, seq BIGINT, is_request BOOLEAN"

    def __init__(self, root: str, ttl: timedelta = DEFAULT_TTL, lateness: timedelta = LATENESS):
        self.root, self.ttl, self.lateness = root, ttl, lateness

    def start(
        self, events: DataFrame, checkpoint: str, once: bool = False, every: str = REPORT_EVERY
    ) -> StreamingQuery:
        """Results wait for `lateness` anyway, so batches may well be minutes apart."""
        return start(events.writeStream.foreachBatch(self.take), checkpoint, once, every)

    def take(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        held, closed_to = self._state(spark, batch_id - 1)
        new = batch.select("session_id", "msg_id", "ts", "seq", "is_request").persist()
        try:
            newest = new.agg(F.max("ts")).first()[0]
            upto = closed_to
            if newest is not None:
                upto = max(newest - self.lateness, closed_to or newest - self.lateness)
            fresh = new
            if closed_to is not None:
                fresh = new.where(F.col("ts") > F.lit(closed_to))
                late = new.where(F.col("ts") <= F.lit(closed_to))
                late.write.mode("overwrite").parquet(f"{self.root}/late/batch={batch_id}")
            self._close(held.unionByName(fresh), upto, batch_id)
        finally:
            new.unpersist()

    def _close(self, rows: DataFrame, upto, batch_id: int) -> None:
        spark = rows.sparkSession
        is_closed = F.col("ts") <= F.lit(upto) if upto is not None else F.lit(False)
        closed = rows.where(is_closed)
        match_events(closed, self.ttl).write.mode("overwrite").parquet(
            f"{self.root}/matches/batch={batch_id}"
        )
        last = closed.groupBy("session_id", "msg_id").agg(
            F.max(F.struct("ts", "seq", "is_request")).alias("last")
        )
        pending = last.where("last.is_request").select("session_id", "msg_id", "last.*")
        if upto is not None:
            pending = pending.where(F.col("ts") >= F.lit(upto - self.ttl))
        slot = f"{self.root}/state/{batch_id % 2}"
        rows.where(~is_closed).unionByName(pending).write.mode("overwrite").parquet(f"{slot}/rows")
        spark.createDataFrame([(batch_id, upto)], "batch BIGINT, upto TIMESTAMP").write.mode(
            "overwrite"
        ).parquet(f"{slot}/mark")

    def _state(self, spark: SparkSession, batch_id: int):
        if batch_id < 0:
            return spark.createDataFrame([], self.COLUMNS), None
        slot = f"{self.root}/state/{batch_id % 2}"
        mark = spark.read.schema("batch BIGINT, upto TIMESTAMP").parquet(f"{slot}/mark").first()
        if mark is None or mark["batch"] != batch_id:
            raise RuntimeError(f"state of batch {batch_id} is missing under {slot}")
        return spark.read.schema(self.COLUMNS).parquet(f"{slot}/rows"), mark["upto"]

    def matches(self, spark: SparkSession) -> DataFrame:
        """What has been paired so far."""
        return spark.read.parquet(f"{self.root}/matches").drop("batch")

    def pending(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """What would be paired if no more rows came: the open end of the stream."""
        held, _ = self._state(spark, batch_id)
        return match_events(held, self.ttl)


def resolve_stream(
    requests: DataFrame,
    decisions: DataFrame,
    timeout: timedelta = DEFAULT_TIMEOUT,
    lateness: timedelta = LATENESS,
    salts: int = 4,
) -> DataFrame:
    """`resolve_approvals` on streams of requests and decisions, for append output.

    A left outer interval join: what stays without partner until both streams
    have passed its deadline has timed out. Requests are copied to `salts` parts
    and decisions spread over them, so that many decisions on one id do not meet
    in one task; the earliest over all parts counts.
    """
    wait = effective_timeout(timeout)
    asked = (
        requests.withWatermark("ts", _seconds(lateness))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        .drop("decision", "decided_at")
    )
    made = decisions.withWatermark("decided_at", _seconds(lateness)).select(
        F.col("approval_id"),
        F.col("decided_at"),
        F.col("approved"),
        F.col("decision_seq"),
        F.pmod(F.xxhash64("decision_seq"), F.lit(salts)).cast("int").alias("made_salt"),
    )
    joined = asked.join(
        made,
        (F.col("id") == F.col("approval_id"))
        & (F.col("salt") == F.col("made_salt"))
        & (F.col("decided_at") >= F.col("ts"))
        & (F.col("decided_at") <= F.col("ts") + F.lit(wait)),
        "leftOuter",
    )
    about = [c for c in asked.columns if c != "salt"]
    decided = F.when(
        F.col("approval_id").isNotNull(), F.struct("decided_at", "decision_seq", "approved")
    )
    first = F.col("first")
    return (
        joined.groupBy(*about)
        .agg(F.min(decided).alias("first"))
        .select(
            *about,
            F.when(first["approved"], S.APPROVED)
            .when(first.isNotNull(), S.DENIED)
            .otherwise(S.TIMEOUT)
            .alias("decision"),
            F.coalesce(first["decided_at"], (F.col("ts") + F.lit(wait)).cast("timestamp")).alias("decided_at"),
        )
    )


def open_at_end(
    requests: DataFrame,
    decisions: DataFrame,
    written: DataFrame,
    timeout: timedelta = DEFAULT_TIMEOUT,
    lateness: timedelta = LATENESS,
) -> DataFrame:
    """What `resolve_stream` could not yet write when its streams end, resolved from the stored tables.

    A request stays in state until later events of both streams pass its deadline by `lateness`, which
    at the end of the input never comes. Requests that were passed are not filled in: what the
    stream lost stays missing. Watermarks are whole milliseconds, in the join and in the aggregation.
    """
    newest = [requests.agg(F.max("ts")).first()[0], decisions.agg(F.max("decided_at")).first()[0]]
    rest = requests.join(written.select("id").distinct(), "id", "left_anti")
    if None not in newest:
        due = F.col("ts") + F.lit(effective_timeout(timeout)) + F.lit(lateness + timedelta(milliseconds=2))
        rest = rest.where(F.col("ts").isNull() | (due >= F.lit(min(newest))))
    return resolve_approvals(rest, decisions, timeout)


def register_stream(tools: DataFrame) -> DataFrame:
    """The running tool registry of `extract_tools` rows, for update or complete output.

    The first sighting by (ts, seq, pos) wins, also among rows of one batch.
    """
    return (
        tools.groupBy("session_id", "tool_name")
        .agg(F.min(F.struct("ts", "seq", "pos", "description")).alias("first"))
        .select(
            "session_id",
            "tool_name",
            F.col("first.description").alias("description"),
            F.col("first.ts").alias("first_seen"),
        )
    )


def new_tools(tools: DataFrame, horizon: timedelta | None = None) -> DataFrame:
    """Each (session, tool) once, when first seen, for append output.

    `horizon` bounds the state where sessions end: a tool seen again after that
    long is reported anew.
    """
    keys = ["session_id", "tool_name"]
    if horizon is None:
        return tools.dropDuplicates(keys)
    return tools.withWatermark("ts", _seconds(horizon)).dropDuplicatesWithinWatermark(keys)
