"""Stages in order, and what becomes of the messages they stop."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbox import schemas as S
from signalbox.functions import rpc
from signalbox.operators.messages import in_chain

Stage = Callable[[DataFrame], DataFrame]

INVALID_REQUEST = -32600  # fixed value: the error code of a blocked message


def run_chain(df: DataFrame, *stages: Stage) -> DataFrame:
    """Run the stages on `open_messages` rows. Each sees what the one before left."""
    return reduce(DataFrame.transform, stages, df)


def stage(
    modify: Column | None = None,
    drop: Column | None = None,
    block: Column | None = None,
    reason: Column | str = "blocked",
) -> Stage:
    """A stage from columns: a new payload, who to drop silently, who to block and why.

    It acts on rows still in the chain; block wins over drop, and both over modify.
    """
    no = F.lit(False)
    blocks = F.coalesce(block, no) if block is not None else no
    drops = F.coalesce(drop, no) if drop is not None else no
    why = F.lit(reason) if isinstance(reason, str) else reason

    def apply(df: DataFrame) -> DataFrame:
        payload, status = F.col("payload"), F.col("status")
        outcome = F.when(blocks, S.BLOCKED).when(drops, S.DROPPED).otherwise(S.FORWARDED)
        df = df.withColumn("_outcome", F.when(in_chain(), outcome))
        passed = F.col("_outcome") == S.FORWARDED
        return df.withColumns(
            {
                "payload": F.when(passed, modify).otherwise(payload) if modify is not None else payload,
                "status": F.coalesce("_outcome", status),
                "block_reason": F.when(F.col("_outcome") == S.BLOCKED, why).otherwise(F.col("block_reason")),
            }
        ).drop("_outcome")

    return apply


def block_responses(df: DataFrame) -> DataFrame:
    """The JSON-RPC errors that tell senders of blocked messages; none for notifications."""
    text = F.concat(
        F.lit('{"jsonrpc":"2.0","id":'),
        F.col("msg_id"),
        F.lit(f',"error":{{"code":{INVALID_REQUEST},"message":'),
        rpc.json_text(F.col("block_reason")),
        F.lit("}}"),
    )
    back = F.when(F.col("direction") == S.HOST_TO_SERVER, S.SERVER_TO_HOST).otherwise(S.HOST_TO_SERVER)
    return df.where((F.col("status") == S.BLOCKED) & F.col("msg_id").isNotNull()).select(
        "session_id", "seq", "ts", back.alias("direction"), text.alias("payload")
    )


def split_outcomes(df: DataFrame, stage_dir: str | None = None) -> dict[str, DataFrame]:
    """Forwarded, blocked and dropped messages; together they are the input.

    With `stage_dir` the chain behind `df` runs once: its rows are written there by
    status, and each part reads only its own files.
    """
    if stage_dir:
        df.write.partitionBy("status").parquet(stage_dir)
        df = df.sparkSession.read.schema(df.schema).parquet(stage_dir).select(*df.columns)
    return {name: df.where(F.col("status") == name) for name in (S.FORWARDED, S.BLOCKED, S.DROPPED)}
