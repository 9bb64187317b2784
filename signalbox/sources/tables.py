"""The written tables: messages, sessions, approvals, tool registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalbox import schemas as S


def sessions_from_events(df: DataFrame) -> DataFrame:
    """One row per session id: first start (with its command and args), last end."""
    begun = F.col("started_at").isNotNull()
    first = F.min(F.when(begun, F.struct("started_at", "command", "args")))
    return (
        df.groupBy("id")
        .agg(first.alias("_first"), F.max("ended_at").alias("ended_at"))
        .select(
            "id",
            F.col("_first.started_at").alias("started_at"),
            "ended_at",
            F.col("_first.command").alias("command"),
            F.col("_first.args").alias("args"),
        )
    )


def upsert_latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last written row per key. Rows are reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    return (
        df.groupBy(*keys)
        .agg(F.max(F.struct(*order, *rest)).alias("_last"))
        .select(*keys, "_last.*")
        .select(*df.columns)
    )


def register_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first written row per key; later ones are ignored."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    return (
        df.groupBy(*keys)
        .agg(F.min(F.struct(*order, *rest)).alias("_first"))
        .select(*keys, "_first.*")
        .select(*df.columns)
    )


def register_tools(tools: DataFrame) -> DataFrame:
    """The tool registry from `extract_tools` rows: first description and sighting win."""
    return register_first(tools, ["session_id", "tool_name"], ["ts", "seq", "pos"]).select(
        "session_id", "tool_name", "description", F.col("ts").alias("first_seen")
    )


# What older message tables lack, and what they read as then.
_ADDED_COLUMNS = {"blocked": False, "audit": False, "scrub_count": 0}


def conform_messages(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Any older message table in today's layout, and columns to `keep`; missing columns take their defaults."""
    have = set(df.columns)
    out = []
    for f in S.MESSAGES:
        value = F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
        if f.name in _ADDED_COLUMNS:
            value = F.coalesce(value, F.lit(_ADDED_COLUMNS[f.name]).cast(f.dataType))
        out.append(value.alias(f.name))
    return df.select(*out, *keep)


def to_storage(df: DataFrame) -> DataFrame:
    """Message rows as stored: rule names as JSON text, nothing empty, and the day."""
    rules = F.when(F.size("matched_rules") > 0, F.to_json("matched_rules"))

    def unset(name: str):
        return F.when(F.col(name) != "", F.col(name))

    return conform_messages(df).withColumns(
        {
            "matched_rules": rules,
            "tool_name": unset("tool_name"),
            "policy_action": unset("policy_action"),
            "date": F.to_date("ts"),
        }
    )


def from_storage(df: DataFrame) -> DataFrame:
    """Stored rows as messages, with the day they are stored under as a further column."""
    return conform_messages(df.withColumn("matched_rules", F.from_json("matched_rules", "array<string>")), ("date",))


#: The stored layout: rule names as JSON text, and the day as partition.
STORED = T.StructType(
    [T.StructField(f.name, T.StringType() if f.name == "matched_rules" else f.dataType) for f in S.MESSAGES]
    + [T.StructField("date", T.DateType())]
)


def write_messages(df: DataFrame, path: str, mode: str = "append") -> None:
    """Append to the message table, partitioned by day.

    Rebalancing gives files of even size per day and splits a day that is too
    big for one task; within a file rows lie by session, so that the row-group
    statistics serve session filters, and a bloom filter serves lookups by id.
    """
    (
        to_storage(df)
        .hint("rebalance", F.col("date"))
        .sortWithinPartitions("date", "session_id", "id")
        .write.mode(mode)
        .option("parquet.bloom.filter.enabled#id", "true")
        .partitionBy("date")
        .parquet(path)
    )


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """The message table, whichever version of the layout its files have.

    The stored layout is given to the reader, so no file is opened to learn it;
    columns that older files lack read as NULL and take their defaults.
    """
    return from_storage(spark.read.schema(STORED).parquet(path))


def compact_messages(spark: SparkSession, path: str, to: str, days: list[str]) -> None:
    """Days of a message table, for instance many small files of a stream, written anew under `to`."""
    rows = spark.read.schema(STORED).parquet(path).where(F.col("date").isin([F.lit(d).cast("date") for d in days]))
    write_messages(from_storage(rows), to)


def merge_latest(stored: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """A stored table with new rows: per key the last written row, new or old."""
    return upsert_latest(stored.unionByName(new.select(*stored.columns)), keys, order)


def merge_first(stored: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """A stored table with new rows whose key it does not have; stored rows stay as they are."""
    fresh = register_first(new.select(*stored.columns), keys, order)
    return stored.unionByName(fresh.join(stored.select(*keys), keys, "left_anti"))


def merge_sessions(stored: DataFrame, events: DataFrame) -> DataFrame:
    """Stored sessions with later session events: the first start stays, the last end wins."""
    new = sessions_from_events(events)
    rows = stored.select("id", "started_at", "command", "args", "ended_at").unionByName(new)
    return sessions_from_events(rows).select(*stored.columns)


def staged(df: DataFrame, path: str) -> DataFrame:
    """Write and read back: later uses read columns from files instead of recomputing."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
