"""The tool registry, tool usage, and pruning of tool listings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalbox.functions import deep, rpc
from signalbox.functions.plan import once
from signalbox.operators.skew import salted_join
from signalbox.session import prepare


@dataclass(frozen=True)
class PruneConfig:
    """`unused_sessions`: drop tools without a call in the last N sessions (0 = off).
    `keep_top_k`: keep only the K most used (0 = off). `always_keep`: never dropped."""

    unused_sessions: int = 0
    keep_top_k: int = 0
    always_keep: tuple[str, ...] = ()

    @property
    def enabled(self) -> bool:
        return self.unused_sessions > 0 or self.keep_top_k > 0


def tool_entries(responses: DataFrame) -> DataFrame:
    """One row per entry of `result.tools`: position, name, description, and what decodes.

    `named` entries are objects (or null) whose name is a string or absent;
    `described` ones also have a string or absent description. Listings and entries
    beyond what the plain parser takes decode alike (see `deep`).
    """
    prepare(responses.sparkSession)
    tool = F.col("tool")
    kept = ["session_id", "seq", "ts"]
    is_struct = F.is_variant_null(tool) | rpc.is_object(tool, "$")
    named = is_struct & rpc.is_text_or_absent(tool, "$.name")
    described = named & rpc.is_text_or_absent(tool, "$.description")
    return (
        responses.withColumn("_value", once(F.try_parse_json("payload")))
        .withColumn("_text", once(F.when(F.col("_value").isNull(), F.expr(deep.fields("payload", ("result.tools",)))["result__tools"])))
        .withColumn(
            "_tools",
            F.when(F.col("_value").isNotNull(), F.try_variant_get("_value", "$.result.tools", "array<variant>")).otherwise(
                F.expr(f"transform({deep.tool_list('_text')}, x -> {deep.entry('x')})")
            ),
        )
        .select(*kept, F.posexplode("_tools").alias("pos", "tool"))
        .select(
            *kept,
            F.col("pos").cast("bigint").alias("pos"),
            named.alias("named"),
            described.alias("described"),
            F.when(named, F.coalesce(rpc.text_at(tool, "$.name"), F.lit(""))).alias("tool_name"),
            F.when(described, F.coalesce(rpc.text_at(tool, "$.description"), F.lit(""))).alias(
                "description"
            ),
        )
    )


def extract_tools(responses: DataFrame) -> DataFrame:
    """Registrable tools of matched list responses; entries that do not decode are skipped.

    A missing name decodes to the empty string and is registered.
    """
    return (
        tool_entries(responses)
        .where("described")
        .select("session_id", "tool_name", "description", "ts", "seq", "pos")
    )


def calls(messages: DataFrame) -> DataFrame:
    return messages.where(rpc.nonempty(F.col("tool_name")))


def last_sessions(sessions: DataFrame, n: int) -> DataFrame:
    """Ids of the `n` sessions started last; ties go to the larger id."""
    return (
        sessions.orderBy(F.desc("started_at"), F.desc("id"))
        .limit(n)
        .select(F.col("id").alias("session_id"))
    )


def tool_usage_counts(messages: DataFrame, sessions: DataFrame, last_n: int = 0) -> DataFrame:
    """Calls per tool, over all messages or those of the last `last_n` sessions.

    Calls of sessions missing from `sessions` drop out only when scoped.
    """
    used = calls(messages)
    if last_n > 0:
        used = used.join(last_sessions(sessions, last_n), "session_id", "left_semi")
    return used.groupBy("tool_name").agg(F.count(F.lit(1)).alias("cnt"))


def usage_by_tool(messages: DataFrame) -> DataFrame:
    """Per tool: calls, sessions and last use."""
    return (
        calls(messages)
        .groupBy("tool_name")
        .agg(
            F.count(F.lit(1)).alias("call_count"),
            F.count_distinct("session_id").alias("sessions_used"),
            F.max("ts").alias("last_used"),
        )
    )


def tool_analytics(registry: DataFrame, messages: DataFrame, session: str | None = None) -> DataFrame:
    """Every registered (tool, description) with its calls, sessions and last use.

    The session filter restricts which tools are listed, not whose calls count.
    Two descriptions of one tool give two rows, each with the full counts.
    """
    return listed_usage(registry, usage_by_tool(messages), session)


def listed_usage(registry: DataFrame, usage: DataFrame, session: str | None = None) -> DataFrame:
    """The registered tools with their usage; zero where there is none."""
    if session:
        registry = registry.where(F.col("session_id") == session)
    return (
        registry.select("tool_name", "description")
        .distinct()
        .join(usage, "tool_name", "left")
        .select(
            "tool_name",
            "description",
            F.coalesce("call_count", F.lit(0)).alias("call_count"),
            F.coalesce("sessions_used", F.lit(0)).alias("sessions_used"),
            "last_used",
        )
        .orderBy(F.desc("call_count"), "tool_name", "description")
    )


def tool_summary(analytics: DataFrame) -> DataFrame:
    """One row: tools available, used and pruned (`is_pruned`, if the column is there)."""
    pruned = F.count_if("is_pruned") if "is_pruned" in analytics.columns else F.lit(0).cast("bigint")
    return analytics.agg(
        F.count(F.lit(1)).alias("total_available"),
        F.count_if(F.col("call_count") > 0).alias("total_used"),
        pruned.alias("total_pruned"),
    )


DESCRIPTION_CHARS = 60


def tool_status(analytics: DataFrame) -> DataFrame:
    """Report columns of a tool: pruned / active / unused, and `never` if not used."""
    pruned = F.col("is_pruned") if "is_pruned" in analytics.columns else F.lit(False)
    return analytics.select(
        "tool_name",
        F.when(
            F.length("description") > DESCRIPTION_CHARS,
            F.concat(F.substring("description", 1, DESCRIPTION_CHARS), F.lit("...")),
        )
        .otherwise(F.col("description"))
        .alias("description"),
        "call_count",
        "sessions_used",
        F.coalesce(F.date_format("last_used", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit("never")).alias(
            "last_used"
        ),
        F.when(pruned, "pruned").when(F.col("call_count") > 0, "active").otherwise("unused").alias("status"),
    )


def mark_pruned(analytics: DataFrame, prune_marks: DataFrame) -> DataFrame:
    """Add `is_pruned`: the tool was dropped from some listing."""
    dropped = prune_marks.where(~F.col("keep")).select("tool_name").distinct()
    return analytics.join(dropped.withColumn("_dropped", F.lit(True)), "tool_name", "left").select(
        *analytics.columns, F.coalesce("_dropped", F.lit(False)).alias("is_pruned")
    )


def prune_tools(tools: DataFrame, usage: DataFrame, config: PruneConfig) -> DataFrame:
    """Add `keep` to the entries of each listing (session_id, seq).

    `usage` has the counts of the sessions the config looks at. Entries that do
    not decode are kept. A name is kept or dropped as a whole, even if listed
    twice. Equal counts rank by position.
    """
    if not config.enabled:
        return tools.withColumn("keep", F.lit(True))
    listing = Window.partitionBy("session_id", "seq")
    always = F.coalesce(F.col("tool_name").isin(*config.always_keep), F.lit(False))
    counted = salted_join(
        tools, usage, ["tool_name"], "left", F.struct("session_id", "seq")
    ).withColumn("cnt", F.coalesce("cnt", F.lit(0)))
    base = always | (F.col("cnt") > 0) if config.unused_sessions > 0 else F.lit(True)
    keep: Column = base
    if config.keep_top_k > 0:
        candidate = F.col("named") & base & ~always
        rank = F.row_number().over(
            listing.orderBy(F.desc("_candidate"), F.desc("cnt"), "pos")
        )
        counted = counted.withColumn("_candidate", candidate).withColumn(
            "_top", F.col("_candidate") & (rank <= config.keep_top_k)
        )
        by_name = Window.partitionBy("session_id", "seq", "tool_name")
        keep = always | F.max("_top").over(by_name)
    return counted.withColumn("keep", ~F.col("named") | keep).select(*tools.columns, "keep")


def rebuild_list_responses(responses: DataFrame, marks: DataFrame) -> DataFrame:
    """Replace `result.tools` of the listings by their kept entries.

    Undecodable entries come first, then the kept tools in list order; other
    fields of the result stay, sorted by name. If nothing is dropped the text is
    unchanged; if nothing is kept, `tools` is null. Adds `tools_pruned`.
    """
    prepare(responses.sparkSession)
    per_listing = marks.groupBy("session_id", "seq").agg(
        F.count_if(~F.col("keep")).cast("int").alias("tools_pruned"),
        F.sort_array(
            F.collect_list(F.when(F.col("keep"), F.struct("named", "pos")))
        ).alias("_order"),
    )
    v, p = F.col("_v"), F.col("payload")
    texts = F.when(v.isNotNull(), F.from_json(F.get_json_object(p, "$.result.tools"), "array<string>")).otherwise(F.expr(deep.tool_list("_parts.result__tools")))
    values = F.try_variant_get(v, "$.result.tools", "array<variant>")

    def entry(slot: Column) -> Column:
        at = slot["pos"].cast("int")
        value = F.get("_tools", at)
        return F.when(v.isNull() | rpc.is_object(value, "$"), F.get("_texts", at)).otherwise(F.to_json(value))

    kept = F.when(F.size("_order") == 0, "null").otherwise(
        F.concat(F.lit("["), F.array_join(F.transform("_order", entry), ","), F.lit("]"))
    )
    fields = F.map_entries(F.try_variant_get(v, "$.result", "map<string,variant>"))
    parsed = F.transform(fields, lambda e: F.struct(e["key"].alias("key"), F.to_json(e["value"]).alias("text")))
    others = F.filter(F.when(v.isNotNull(), parsed).otherwise(F.expr(deep.last_of_each(deep.members("_parts.result")))), lambda e: e["key"] != "tools")
    all_fields = F.array_sort(F.concat(others, F.array(F.struct(F.lit("tools").alias("key"), kept.alias("text")))))
    result = F.array_join(
        F.transform(all_fields, lambda e: F.concat(rpc.json_text(e["key"]), F.lit(":"), e["text"])), ","
    )
    own_id = F.when(v.isNotNull(), F.to_json(rpc.part(v, "$.id"))).otherwise(F.col("_parts.id"))
    rebuilt = F.concat(F.lit('{"jsonrpc":"2.0","id":'), own_id, F.lit(',"result":{'), result, F.lit("}}"))
    changed = F.coalesce("tools_pruned", F.lit(0)) > 0
    return (
        responses.join(per_listing, ["session_id", "seq"], "left")
        .withColumn("_v", once(F.when(changed, F.try_parse_json("payload"))))
        .withColumn("_parts", once(F.when(changed & v.isNull(), F.expr(deep.fields("payload", ("id", "result", "result.tools"))))))
        .withColumns({"_texts": once(F.when(changed, texts)), "_tools": values})
        .withColumn("payload", F.when(changed, rebuilt).otherwise(F.col("payload")))
        .select(*responses.columns, F.when(changed, F.col("tools_pruned")).alias("tools_pruned"))
    )
