"""Pairing tools/list requests with their responses."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalbox import schemas as S
from signalbox.operators.messages import in_chain

DEFAULT_TTL = timedelta(minutes=5)
# One block of slots spans at least the time to live, so what can still match
# lies in the same block or the one before.
_SLOTS_PER_BLOCK = 257
_SLOTS_PER_TTL = 256


def micros(span: timedelta) -> int:
    return span // timedelta(microseconds=1)


def list_events(df: DataFrame) -> DataFrame:
    """The narrow rows that matter: list requests and all successful responses, with id."""
    request = (F.col("direction") == S.HOST_TO_SERVER) & (F.col("method") == "tools/list")
    response = (F.col("direction") == S.SERVER_TO_HOST) & (F.col("kind") == S.RESPONSE)
    if {"status", "parse_error"} <= set(df.columns):
        df = df.where(in_chain())
    return df.where(F.col("msg_id").isNotNull() & (request | response)).select(
        "session_id", "msg_id", "ts", "seq", F.coalesce(request, F.lit(False)).alias("is_request")
    )


def correlate_lists(df: DataFrame, ttl: timedelta = DEFAULT_TTL) -> DataFrame:
    """One row per response that answers a pending tools/list request.

    Per (session, id) in order of (ts, seq): a request sent again replaces the
    pending one, the first response consumes it, errors do not, and a request
    older than `ttl` has expired. So a response matches exactly if the event
    right before it is a request, not more than `ttl` ago.
    """
    return match_events(list_events(df), ttl)


def match_events(events: DataFrame, ttl: timedelta) -> DataFrame:
    """`correlate_lists` on rows already narrowed by `list_events`.

    Events of one (session, id) are ordered within short time slots only. What
    came last before a slot is carried in from the slots before it, found among
    one row per slot. No group thus grows with the traffic of a hot key, payloads
    are not moved, and the two uses of the events share one shuffle.
    """
    key = ["session_id", "msg_id"]
    slot_us = max(1, -(-micros(ttl) // _SLOTS_PER_TTL))  # up, so that a block is never shorter than the ttl
    slot = F.floor(F.unix_micros("ts") / F.lit(slot_us)).cast("bigint")
    # The join below implies these tests for one of its sides; stated for both,
    # they leave the two with the same shuffle, which then runs once.
    known = F.col("session_id").isNotNull() & F.col("msg_id").isNotNull() & F.col("slot").isNotNull()
    slotted = events.withColumn("slot", slot).where(known).repartition(*key, "slot")
    last = F.struct("ts", "seq", "is_request")
    block = F.floor(F.col("slot") / F.lit(_SLOTS_PER_BLOCK)).cast("bigint")

    # Every slot is seen from its own block and from the next one, so that the slot
    # before it is always at hand.
    slots = (
        slotted.groupBy(*key, "slot")
        .agg(F.max(last).alias("last"))
        .withColumn("own", block)
        .withColumn("block", F.explode(F.array(F.col("own"), F.col("own") + 1)))
    )
    in_order = Window.partitionBy(*key, "block").orderBy("slot")
    carried = (
        slots.withColumn("carried", F.lag("last").over(in_order))
        .where((F.col("block") == F.col("own")) & F.col("carried.is_request"))
        .select(*key, "slot", "carried")
    )
    in_slot = Window.partitionBy(*key, "slot").orderBy("ts", "seq")
    previous = F.coalesce(F.lag(last).over(in_slot), F.col("carried"))
    return (
        slotted.join(carried, [*key, "slot"], "left")
        .withColumn("prev", previous)
        .where(~F.col("is_request") & F.col("prev.is_request") & within(F.col("prev.ts"), F.col("ts"), ttl))
        .select(
            "session_id",
            "msg_id",
            "seq",
            F.col("ts").alias("response_ts"),
            F.col("prev.seq").alias("request_seq"),
            F.col("prev.ts").alias("request_ts"),
        )
    )


def within(start: Column, end: Column, span: timedelta) -> Column:
    return F.unix_micros(end) - F.unix_micros(start) <= F.lit(micros(span))


def list_responses(df: DataFrame, ttl: timedelta = DEFAULT_TTL) -> DataFrame:
    """The matched responses with their payload, and `request_ts`.

    Only responses that carry a tool array are moved for the join.
    """
    matches = correlate_lists(df, ttl).select("session_id", "seq", "request_seq", "request_ts")
    carriers = df.where(in_chain() & F.col("lists_tools"))
    return carriers.join(matches, ["session_id", "seq"])
