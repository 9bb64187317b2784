"""JSON-RPC columns: parse, classify, name the tool, measure, lay out log rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbox import schemas as S
from signalbox.functions import deep, rpc
from signalbox.functions.plan import once
from signalbox.session import prepare


def parse_messages(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Add `v`, `msg_id`, `method` and `parse_error`.

    `msg_id` is the raw JSON text of the id, so `"1"` and `1` differ and `null`
    counts as present. A line fails to parse if it is not one JSON object (or
    null), or if a field with a fixed type holds another type. Such lines are
    forwarded untouched by later stages and never logged. Nesting and long numbers
    are no reason to fail, and change nothing in what is accepted: beyond what the plain
    parser takes, `v` holds the envelope alone (see `deep`).
    """
    prepare(df.sparkSession)
    v, p = F.col("v"), F.col(payload)
    code = F.coalesce(rpc.type_of(rpc.part(v, "$.error.code")), F.lit("VOID"))
    error = rpc.part(v, "$.error")
    good_error = F.is_variant_null(error) | (
        rpc.is_object(v, "$.error")
        & code.isin("BIGINT", "VOID")
        & rpc.is_text_or_absent(v, "$.error.message")
    )
    well_typed = (
        rpc.is_text_or_absent(v, "$.jsonrpc")
        & rpc.is_text_or_absent(v, "$.method")
        & (error.isNull() | good_error)
    )
    return (
        df.withColumn("_mark", F.crc32(p))
        .withColumn("_w", once(rpc.wrapped(p, F.col("_mark"))))
        .withColumn("v", F.when(rpc.is_whole(F.col("_w"), F.col("_mark")), rpc.part(F.col("_w"), "$[0]")))
        .withColumn("v", once(F.when(rpc.starts_object(p) | F.is_variant_null(v), v)))
        .withColumn("_deep", once(F.when(v.isNull() & rpc.starts_object(p), deep.is_json(p, F.col("_mark")))))
        .withColumn("_deep", once(F.when(F.col("_deep"), F.expr(deep.envelope(f"`{payload}`")))))
        .withColumn("v", once(F.coalesce(v, F.try_parse_json(F.col("_deep.text")))))
        .withColumn("parse_error", once(~F.coalesce(v.isNotNull() & well_typed, F.lit(False))))
        .withColumn("v", once(F.when(~F.col("parse_error"), v)))
        .withColumns(
            {
                "msg_id": F.when(v.isNotNull(), F.coalesce(F.col("_deep.id"), F.to_json(rpc.part(v, "$.id")))),
                "method": rpc.text_at(v, "$.method"),
            }
        )
        .withColumn("method", rpc.unless_empty(F.col("method")))
        .drop("_mark", "_w", "_deep")
    )


def classify_kind(df: DataFrame) -> DataFrame:
    """Add `kind`. A method decides first: a message with method and error is a request."""
    error = rpc.part(F.col("v"), "$.error")
    has_method = rpc.nonempty(F.col("method"))
    has_error = error.isNotNull() & ~F.is_variant_null(error)
    return df.withColumn(
        "kind",
        F.when(F.col("parse_error"), F.lit(None).cast("string"))
        .when(has_method & F.col("msg_id").isNotNull(), S.REQUEST)
        .when(has_method, S.NOTIFICATION)
        .when(has_error, S.ERROR)
        .otherwise(S.RESPONSE),
    )


def tool_name(df: DataFrame) -> DataFrame:
    """Add `tool_name`: `params.name` of a tools/call if it is a string, else NULL."""
    called = F.when(F.col("method") == "tools/call", rpc.text_at(F.col("v"), "$.params.name"))
    return df.withColumn("tool_name", called).withColumn("tool_name", rpc.unless_empty(F.col("tool_name")))


def rpc_error_fields(df: DataFrame) -> DataFrame:
    """Add `error_code`, `error_message` and `error_data` (raw JSON text)."""
    v = F.col("v")
    return df.withColumns(
        {
            "error_code": F.try_variant_get(v, "$.error.code", "bigint"),
            "error_message": F.try_variant_get(v, "$.error.message", "string"),
            "error_data": F.to_json(rpc.part(v, "$.error.data")),
        }
    )


def with_size(df: DataFrame) -> DataFrame:
    """Add `size_bytes`, the bytes of the payload as it will be logged."""
    return df.withColumn("size_bytes", F.octet_length("payload").cast("bigint"))


def open_messages(df: DataFrame) -> DataFrame:
    """Raw rows to rows ready for the chain: parsed, classified, status `forwarded`.

    `lists_tools` marks responses that carry a tool array, so that later stages
    touch only those. The parsed value itself is not kept.
    """
    tools = F.try_variant_get(F.col("v"), "$.result.tools", "array<variant>")
    return (
        tool_name(classify_kind(parse_messages(df)))
        .withColumn("lists_tools", (F.col("kind") == S.RESPONSE) & tools.isNotNull())
        .withColumn("status", once(F.lit(S.FORWARDED)))
        .withColumn("block_reason", F.lit(None).cast("string"))
        .drop("v")
    )


def in_chain() -> Column:
    """Rows a stage may act on: still forwarded, and parsed."""
    return (F.col("status") == S.FORWARDED) & ~F.col("parse_error")


def to_log_rows(df: DataFrame) -> DataFrame:
    """The `messages` layout. Unparsed lines and dropped messages are not logged."""
    have = set(df.columns)

    def col(name: str, kind: str, default=None) -> Column:
        value = F.col(name) if name in have else F.lit(None)
        value = value.cast(kind)
        return F.coalesce(value, F.lit(default).cast(kind)) if default is not None else value

    if "parse_error" in have:
        df = df.where(~F.col("parse_error"))
    status = F.col("status") if "status" in have else F.lit(S.FORWARDED)
    rules = col("matched_rules", "array<string>")
    return with_size(df.where(status != S.DROPPED)).select(
        (F.col("id") if "id" in have else F.col("seq")).cast("bigint").alias("id"),
        "ts",
        "session_id",
        "direction",
        "kind",
        col("method", "string").alias("method"),
        col("msg_id", "string").alias("msg_id"),
        "payload",
        "size_bytes",
        (status == S.BLOCKED).alias("blocked"),
        col("audit", "boolean", False).alias("audit"),
        col("scrub_count", "int", 0).alias("scrub_count"),
        F.when(F.size(rules) > 0, rules).alias("matched_rules"),
        F.when(rpc.nonempty(col("tool_name", "string")), col("tool_name", "string")).alias("tool_name"),
        F.when(rpc.nonempty(col("policy_action", "string")), col("policy_action", "string")).alias(
            "policy_action"
        ),
        col("policy_rule", "string").alias("policy_rule"),
        col("block_reason", "string").alias("block_reason"),
        status.alias("status"),
        col("tools_pruned", "int").alias("tools_pruned"),
    )


# The labels a report shows for the two directions.
DIRECTION_LABELS = {
    S.HOST_TO_SERVER: "Host → Server",
    S.SERVER_TO_HOST: "Server → Host",
}
PREVIEW_CHARS = 80


def feed_view(df: DataFrame) -> DataFrame:
    """Report columns of a message: times, direction label, preview and status flags."""
    outgoing = F.col("direction") == S.HOST_TO_SERVER
    preview = F.when(
        F.length("payload") > PREVIEW_CHARS,
        F.concat(F.substring("payload", 1, PREVIEW_CHARS), F.lit("...")),
    ).otherwise(F.col("payload"))
    flags = F.array_join(
        F.array_compact(
            F.array(
                F.when(F.col("blocked"), "Blocked"),
                F.when(F.col("audit"), "Audit"),
                F.when(F.col("scrub_count") > 0, "Scrubbed"),
            )
        ),
        " ",
    )
    dash = F.lit("-")
    return df.select(
        "id",
        F.date_format("ts", "HH:mm:ss.SSS").alias("time"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("full_time"),
        F.when(outgoing, DIRECTION_LABELS[S.HOST_TO_SERVER])
        .otherwise(DIRECTION_LABELS[S.SERVER_TO_HOST])
        .alias("direction_label"),
        "kind",
        F.when(rpc.nonempty(F.col("method")), F.col("method")).otherwise(dash).alias("method"),
        F.when(rpc.nonempty(F.col("msg_id")), F.col("msg_id")).otherwise(dash).alias("msg_id"),
        "session_id",
        preview.alias("preview"),
        F.col("size_bytes").cast("bigint").alias("size_bytes"),
        flags.alias("flags"),
        F.col("tool_name"),
        F.col("policy_action"),
        F.array_join(F.coalesce("matched_rules", F.array().cast("array<string>")), ", ").alias("rules"),
    )
