"""The whole chain on live traffic: held messages, decisions, pairing and pruning, batch by batch.

Policy and redaction need no memory. What does is kept as tables beside the stream: messages that
wait for review, decisions that can still matter, listing events not yet paired, and responses whose
listing is not yet known to be one. Event time drives all of it: a clock trails the newest message by
`lateness`, and whatever the clock has passed is settled by the batch operators themselves.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from signalbox import schemas as S
from signalbox.operators import tools as tools_ops
from signalbox.operators.approvals import DEFAULT_TIMEOUT, apply_approvals, approval_requests, effective_timeout, resolve_approvals, waits_for_review
from signalbox.operators.chain import block_responses
from signalbox.operators.correlate import DEFAULT_TTL, list_events, match_events
from signalbox.operators.messages import in_chain, to_log_rows
from signalbox.operators.numbering import null_safe_join
from signalbox.operators.policy import Policy
from signalbox.plans.governed import replace_listings, screen
from signalbox.sources.tables import STORED, from_storage, register_tools, staged, to_storage
from signalbox.streaming.live import LATENESS, REPORT_EVERY, start

_MARK = "batch BIGINT, clock TIMESTAMP, paired_to TIMESTAMP"
_EVENTS = "session_id STRING, msg_id STRING, ts TIMESTAMP, seq BIGINT, is_request BOOLEAN"
_TOOLS = "session_id STRING, tool_name STRING, description STRING, ts TIMESTAMP, seq BIGINT, pos BIGINT"
_KEY = ["session_id", "seq"]
#: Later than any event: the clock once the input has ended.
_END = datetime(9999, 1, 1)


def chain_input(raw: DataFrame, decisions: DataFrame) -> DataFrame:
    """Raw messages and decisions as one stream, so that a batch is a cut through both."""
    made = [f.name for f in S.DECISIONS]
    messages = raw.select(*(f.name for f in S.RAW_MESSAGES), *(F.lit(None).cast(S.DECISIONS[c].dataType).alias(c) for c in made), F.lit(True).alias("is_message"))
    return messages.unionByName(
        decisions.select(*made, F.lit(False).alias("is_message")), allowMissingColumns=True
    )


class GovernedStream:
    """`govern` on a stream of `chain_input` rows.

    A message is logged as soon as its outcome is certain: at once, if nothing holds it; when the clock has passed its
    decision or its deadline, if it waits for review; and when the clock has passed it by the review timeout, if it
    carries a tool listing (only then no earlier request can still be released). Rows may arrive out of order within
    `lateness`; together with `finish`, the tables then hold what `govern` gives for all rows. A later message still gets
    its outcome, but its listing is not paired any more, and a later decision counts only for what is still held.

    Every batch writes its own folder of each table under `root`, and its state into one of two slots, so a repeated batch
    replaces what it wrote and a restart goes on from the last whole one. State is as large as what came within
    timeout, lateness and (listing requests only) `ttl`. Rows need a `seq` unique within their session; rows without
    a time are held by `finish` only, if anything holds them.
    """

    def __init__(
        self,
        root: str,
        policy: Policy,
        timeout: timedelta = DEFAULT_TIMEOUT,
        prune: tools_ops.PruneConfig = tools_ops.PruneConfig(),
        usage: DataFrame | None = None,
        protected_sessions: DataFrame | None = None,
        ttl: timedelta = DEFAULT_TTL,
        lateness: timedelta = LATENESS,
        request_ids: Callable[[DataFrame], DataFrame] | None = None,
    ):
        self.root, self.policy, self.timeout, self.prune, self.usage = root, policy, effective_timeout(timeout), prune, usage
        self.protected, self.ttl, self.lateness, self.request_ids = protected_sessions, ttl, lateness, request_ids

    def start(self, rows: DataFrame, checkpoint: str, once: bool = False, every: str = REPORT_EVERY) -> StreamingQuery:
        return start(rows.writeStream.foreachBatch(self.take), checkpoint, once, every)

    def take(self, batch: DataFrame, batch_id: int) -> None:
        raw = batch.where("is_message").select(*(f.name for f in S.RAW_MESSAGES))
        made = batch.where("NOT is_message").select(*(f.name for f in S.DECISIONS))
        self._advance(raw, made, batch_id, end=False)

    def finish(self, spark: SparkSession) -> None:
        """The input has ended: settle what is still open, as a batch of its own after the last one."""
        try:
            last = spark.read.schema(_MARK).parquet(f"{self.root}/state/*/mark").agg(F.max("batch")).first()[0]
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            last = -1
        self._advance(spark.createDataFrame([], S.RAW_MESSAGES), spark.createDataFrame([], S.DECISIONS), last + 1, end=True)

    def _advance(self, raw: DataFrame, made: DataFrame, batch_id: int, end: bool) -> None:
        spark = raw.sparkSession
        work, slot = f"{self.root}/work/{batch_id % 2}", f"{self.root}/state/{batch_id % 2}"
        # Spread first: a batch may come from one file, and then one task would parse and screen all of it.
        new = staged(screen(raw.repartition(*_KEY), self.policy), f"{work}/screened")
        clock, paired_before = self._mark(spark, batch_id - 1)
        newest = new.agg(F.max("ts")).first()[0]
        if newest is not None:
            clock = max(newest - self.lateness, clock or newest - self.lateness)
        clock = _END if end else clock
        paired_to = clock - self.timeout if clock else None
        upto = lambda limit, column="ts": F.lit(True) if end else F.coalesce(F.col(column) <= F.lit(limit).cast("timestamp"), F.lit(False))

        # Review: what the clock has passed is certain, as every earlier decision has arrived.
        made = staged(self._read(spark, batch_id - 1, "decisions", S.DECISIONS).unionByName(made), f"{work}/decisions")
        waiting = self._read(spark, batch_id - 1, "held", new.schema).unionByName(new.where(waits_for_review()))
        waiting = staged(waiting, f"{work}/waiting")
        requests = approval_requests(waiting)
        if self.request_ids:
            requests = self.request_ids(requests)
        resolved = resolve_approvals(requests, made, self.timeout).where(upto(clock, "decided_at"))
        settled = staged(resolved.select(*(f.name for f in S.APPROVALS), "seq"), f"{self.root}/approvals/batch={batch_id}")
        keys = settled.select(*_KEY)
        released = apply_approvals(null_safe_join(waiting, keys, _KEY, "left_semi"), settled)
        passed = staged(new.where(~waits_for_review()).unionByName(released), f"{work}/passed")

        # Listings: events up to `paired_to` are complete, since nothing so old is still held.
        late = F.coalesce(F.col("ts") <= F.lit(paired_before).cast("timestamp"), F.lit(False))
        events = self._read(spark, batch_id - 1, "events", _EVENTS).unionByName(list_events(passed).where(~late))
        closed = events.where(upto(paired_to))
        matches = match_events(closed, self.ttl).select(*_KEY, "request_seq", "request_ts")
        carries = in_chain() & F.coalesce(F.col("lists_tools"), F.lit(False))
        carriers = staged(self._read(spark, batch_id - 1, "carriers", new.schema).unionByName(passed.where(carries & ~late)), f"{work}/carriers")
        ready = carriers.where(upto(paired_to))
        listings = staged(ready.join(matches, _KEY), f"{work}/listings")
        tools_ops.extract_tools(listings).write.mode("overwrite").parquet(f"{self.root}/tools/batch={batch_id}")
        unpruned = F.lit(None).cast("int").alias("tools_pruned")
        outcomes = ready.select("*", unpruned)
        if self.prune.enabled:
            prunable = listings.join(self.protected, "session_id", "left_anti") if self.protected is not None else listings
            marks = tools_ops.prune_tools(tools_ops.tool_entries(prunable), self.usage, self.prune)
            outcomes = replace_listings(ready, tools_ops.rebuild_list_responses(prunable, marks))
        outcomes = passed.where(~carries | late).select("*", unpruned).unionByName(outcomes)
        to_storage(to_log_rows(outcomes)).write.mode("overwrite").parquet(f"{self.root}/messages/batch={batch_id}")
        block_responses(passed).write.mode("overwrite").parquet(f"{self.root}/replies/batch={batch_id}")

        # What the next batch needs; the mark comes last and makes the slot valid.
        open_requests = closed.groupBy("session_id", "msg_id").agg(F.max(F.struct("ts", "seq", "is_request")).alias("last"))
        open_requests = open_requests.where("last.is_request").select("session_id", "msg_id", "last.*")
        if paired_to is not None:
            open_requests = open_requests.where(F.col("ts") >= F.lit(paired_to - self.ttl).cast("timestamp"))
            made = made.where(F.col("decided_at") >= F.lit(clock - self.timeout).cast("timestamp"))
        for name, rows in {
            "held": null_safe_join(waiting, keys, _KEY, "left_anti"),
            "decisions": made,
            "events": events.where(~upto(paired_to)).unionByName(open_requests),
            "carriers": carriers.where(~upto(paired_to)),
        }.items():
            rows.write.mode("overwrite").parquet(f"{slot}/{name}")
        spark.createDataFrame([(batch_id, clock, paired_to)], _MARK).write.mode("overwrite").parquet(f"{slot}/mark")

    def _mark(self, spark: SparkSession, batch_id: int):
        if batch_id < 0:
            return None, None
        mark = spark.read.schema(_MARK).parquet(f"{self.root}/state/{batch_id % 2}/mark").first()
        if mark is None or mark["batch"] != batch_id:
            raise RuntimeError(f"state of batch {batch_id} is missing under {self.root}/state")
        return mark["clock"], mark["paired_to"]

    def _read(self, spark: SparkSession, batch_id: int, name: str, schema) -> DataFrame:
        if batch_id < 0:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{self.root}/state/{batch_id % 2}/{name}")

    def messages(self, spark: SparkSession) -> DataFrame:
        """The message table so far."""
        return from_storage(spark.read.schema(STORED).parquet(f"{self.root}/messages")).drop("date")

    def approvals(self, spark: SparkSession) -> DataFrame:
        """Requests settled so far, with their outcome."""
        schema = T.StructType([*S.APPROVALS.fields, T.StructField("seq", T.LongType())])
        return spark.read.schema(schema).parquet(f"{self.root}/approvals")

    def registry(self, spark: SparkSession) -> DataFrame:
        """The tool registry so far."""
        return register_tools(spark.read.schema(_TOOLS).parquet(f"{self.root}/tools"))

    def replies(self, spark: SparkSession) -> DataFrame:
        """Errors for the senders of blocked messages so far."""
        return spark.read.schema("session_id STRING, seq BIGINT, ts TIMESTAMP, direction STRING, payload STRING").parquet(f"{self.root}/replies")
