"""Agent traffic derived from general event, conversation and document tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbox import schemas as S
from signalbox.functions import rpc

# Fixed value: the listing a `click` stands for; % is replaced by k % 3.
TOOL_LISTING = (
    '[{"name":"read_file","description":"read v%","inputSchema":{"type":"object","path":"p"}},'
    '{"name":"write_file","description":"write v%"},'
    '{"name":"delete_file","description":"delete a file"},'
    '{"name":"list_dir"},'
    '{"name":"search","description":"search v%","limit":7},'
    '{"name":"run_shell","description":"run a command"}]'
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return typed_events(df) if name == "events" else df


def typed_events(events: DataFrame) -> DataFrame:
    """Events with the number `k` of their props and a session-zone timestamp."""
    return events.withColumns(
        {
            "ts": F.col("ts").cast("timestamp"),
            "k": F.get_json_object("props", "$.k").cast("bigint"),
        }
    )


def traffic(events: DataFrame) -> DataFrame:
    """Raw messages, one per event: list requests and responses, calls, notices, errors."""
    kind, k = F.col("event_type"), F.col("k").cast("string")
    head = F.concat(F.lit('{"jsonrpc":"2.0","id":'), k)
    listing = F.replace(F.lit(TOOL_LISTING), F.lit("%"), (F.col("k") % 3).cast("string"))
    tool = F.when(F.col("value") > 50, "delete_file").otherwise("write_file")
    payload = (
        F.when(kind == "view", F.concat(head, F.lit(',"method":"tools/list"}')))
        .when(
            kind == "click",
            F.concat(head, F.lit(',"result":{"tools":'), listing, F.lit(',"nextCursor":"c"}}')),
        )
        .when(
            kind == "purchase",
            F.concat(
                head,
                F.lit(',"method":"tools/call","params":{"name":"'),
                tool,
                F.lit('","arguments":'),
                F.col("props"),
                F.lit("}}"),
            ),
        )
        .when(kind == "signup", F.lit('{"jsonrpc":"2.0","method":"notifications/initialized"}'))
        .otherwise(
            F.concat(head, F.lit(',"error":{"code":-32603,"message":"internal error","data":'), F.col("props"), F.lit("}}"))
        )
    )
    return events.select(
        F.col("event_id").alias("seq"),
        "ts",
        F.col("user_id").cast("string").alias("session_id"),
        F.when(kind.isin("click", "error"), S.SERVER_TO_HOST).otherwise(S.HOST_TO_SERVER).alias("direction"),
        payload.alias("payload"),
    )


def tool_calls(events: DataFrame) -> DataFrame:
    """Message rows, one per event, in which every event is a call of the tool it names."""
    return events.select(
        F.col("event_id").alias("id"),
        "ts",
        F.col("user_id").cast("string").alias("session_id"),
        F.lit(S.HOST_TO_SERVER).alias("direction"),
        F.lit("tools/call").alias("method"),
        F.col("event_type").alias("tool_name"),
    )


def session_marks(events: DataFrame) -> DataFrame:
    """Session events: every event may start or end its session."""
    return events.select(
        F.col("user_id").cast("string").alias("id"),
        F.col("ts").alias("started_at"),
        F.col("ts").alias("ended_at"),
        F.concat(F.lit("server-"), "event_type").alias("command"),
        F.array("event_type").alias("args"),
    )


def sessions(events: DataFrame) -> DataFrame:
    return events.groupBy(F.col("user_id").cast("string").alias("id")).agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("ended_at")
    )


def sightings(events: DataFrame) -> DataFrame:
    """Tool sightings: every event shows its tool; `view` goes by two descriptions."""
    two = F.when((F.col("event_type") == "view") & (F.col("k") % 2 == 1), "second").otherwise("first")
    return events.select(
        F.col("user_id").cast("string").alias("session_id"),
        F.col("event_type").alias("tool_name"),
        F.concat_ws(" ", "event_type", two).alias("description"),
        "ts",
        F.col("event_id").alias("seq"),
        F.lit(0).cast("bigint").alias("pos"),
    )


def request_id(seq: Column) -> Column:
    return F.concat(F.lit("req-"), seq.cast("string"))


def decisions(events: DataFrame) -> DataFrame:
    """Decisions, one per `click`, on the request of an event shortly before it.

    Some of these events are no requests, and some requests are decided twice or late.
    """
    k = F.col("k")
    return events.where(F.col("event_type") == "click").select(
        request_id(F.col("event_id") - 1 - k % 3).alias("approval_id"),
        F.col("ts").alias("decided_at"),
        (k % 2 == 0).alias("approved"),
        F.col("event_id").alias("decision_seq"),
    )


def chat(conversations: DataFrame) -> DataFrame:
    """Conversation turns as messages; what the assistant says comes from the server."""
    out = F.col("role") == "assistant"
    text = rpc.json_text(F.col("text"))
    payload = F.when(
        out,
        F.concat(F.lit('{"jsonrpc":"2.0","id":'), F.col("turn"), F.lit(',"result":{"content":'), text, F.lit("}}")),
    ).otherwise(
        F.concat(
            F.lit('{"jsonrpc":"2.0","id":'),
            F.col("turn"),
            F.lit(',"method":"chat/'),
            F.col("role"),
            F.lit('","params":{"text":'),
            text,
            F.lit("}}"),
        )
    )
    return conversations.select(
        F.col("turn").alias("seq"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 100 + F.col("turn")).alias("ts"),
        F.col("conv_id").cast("string").alias("session_id"),
        F.when(out, S.SERVER_TO_HOST).otherwise(S.HOST_TO_SERVER).alias("direction"),
        payload.alias("payload"),
    )


def document_messages(documents: DataFrame) -> DataFrame:
    """Documents as tool results, one session per source."""
    payload = F.concat(
        F.lit('{"jsonrpc":"2.0","id":'),
        F.col("doc_id"),
        F.lit(',"result":{"lang":'),
        rpc.json_text(F.col("lang")),
        F.lit(',"content":[{"type":"text","text":'),
        rpc.json_text(F.col("text")),
        F.lit("}]}}"),
    )
    return documents.select(
        F.col("doc_id").alias("seq"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id")).alias("ts"),
        F.col("source").alias("session_id"),
        F.lit(S.SERVER_TO_HOST).alias("direction"),
        payload.alias("payload"),
    )
