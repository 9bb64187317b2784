"""Messages linked to what they quote, and conversations in reply order without quotes, in column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from signalbox.functions.plan import once
from signalbox.llm.staging import staged

_PREFIX = r"^(?:[ \t]*>)+"
_INTRODUCTION = r"(?i)\bwrote:[ \t]*$"
#: Turns of one conversation that are searched together for the last original of a line.
SLOT = 1024


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _PREFIX, 0), "[^>]+", ""))


def _normal(line: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(F.regexp_replace(line, _PREFIX, ""), r"[ \t\r]+", " ")))


def parsed(messages: DataFrame) -> DataFrame:
    """`messages` with `_lines`: (level, hash of the normalised line, line) of each line of the text.

    The level is the number of `>` a line begins with, blanks between them aside. Normalised is a
    line without them, in lower case, with single blanks; a blank line's hash is null.
    """
    lines = F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n")
    each = F.transform(
        lines,
        lambda x: F.struct(
            _level(x).alias("level"), F.when(_normal(x) != "", F.xxhash64(_normal(x))).alias("h"), x.alias("line")
        ),
    )
    return messages.withColumn("_lines", once(each))


def _own_text() -> Column:
    """Lines of level 0, less one that only introduces the quote behind it."""

    def keep(x: Column, i: Column) -> Column:
        introduces = x["line"].rlike(_INTRODUCTION) & (F.coalesce(F.get("_lines", i + 1)["level"], F.lit(0)) > 0)
        return (x["level"] == 0) & ~introduces

    return F.btrim(F.array_join(F.transform(F.filter("_lines", keep), lambda x: x["line"]), "\n"), F.lit("\n"))


def _last_originals(own: DataFrame, quoted: DataFrame) -> DataFrame:
    """`quoted` (conv_id, h, turn, level) with `origin`: the last earlier turn that has the line itself.

    An as-of join in two steps: the latest original of each slot of turns is carried to later slots,
    and within a slot rows are ordered. A line that fills a conversation is so cut into slots.
    """
    sought = quoted.select("conv_id", "h").distinct()
    own = own.join(sought, ["conv_id", "h"], "left_semi").select("conv_id", "h", "turn", F.col("turn").alias("own"), F.lit(None).cast("int").alias("level"))
    rows = own.unionByName(quoted.withColumn("own", F.lit(None).cast("long"))).withColumn("slot", F.floor(F.col("turn") / SLOT))
    slots = rows.groupBy("conv_id", "h", "slot").agg(F.max("own").alias("last"))
    earlier = Window.partitionBy("conv_id", "h").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select("conv_id", "h", "slot", F.max("last").over(earlier).alias("carried"))
    within = Window.partitionBy("conv_id", "h", "slot").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("near", F.max("own").over(within)).where("level IS NOT NULL").join(slots, ["conv_id", "h", "slot"])
    return rows.select("conv_id", "h", "turn", "level", F.coalesce("near", "carried").alias("origin")).where("origin IS NOT NULL")


def link_quotes(messages: DataFrame) -> DataFrame:
    """`messages` (conv_id, turn, text and any others) in reply order, with quotes taken out of `text`.

    Added: `quoted_lines`, `quote_levels` (the deepest), `reply_to` (the turn quoted, or null) and
    `anchor_turn`, the turn reached by following `reply_to`. Sorted by (conv_id, anchor_turn, turn),
    each reply stands behind what it answers; rows are not gathered by conversation, however long.

    Each quoted line is looked up in its conversation, where the last earlier turn with that line
    outside of quotes has it. A message replies to the turn that has most of its quoted lines of the
    lowest level that is found at all; the later one if two have as many. Null texts read as empty
    and become empty; rows without conv_id or turn have no links, with their own turn as anchor. Rows
    that repeat (conv_id, turn) are one message in several parts: they share quotes and links.
    Columns of `messages` with the names of results are replaced.
    """
    made = ("quoted_lines", "quote_levels", "reply_to", "anchor_turn")
    keep = [c for c in messages.columns if c not in made]
    # All other columns travel as one, so that no name of theirs meets one that is used on the way.
    others = [c for c in keep if c not in ("conv_id", "turn", "text")]
    carried = [F.struct(*others).alias("_carried")] if others else []
    rows = parsed(messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "text", *carried))
    hashes = F.transform("_lines", lambda x: F.struct(x["level"].alias("level"), x["h"].alias("h")))
    rows = rows.withColumns(
        {
            "text": _own_text(),
            "quoted_lines": F.size(F.filter("_lines", lambda x: x["level"] > 0)),
            "quote_levels": F.array_max(F.transform("_lines", lambda x: x["level"])),
            "_hashes": F.filter(hashes, lambda x: x["h"].isNotNull()),
        }
    ).drop("_lines")
    rows = staged(rows, "messages")
    lines = rows.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", F.explode("_hashes").alias("l"))
    lines = lines.select("conv_id", "turn", F.col("l.level").alias("level"), F.col("l.h").alias("h"))
    own = lines.where("level = 0").select("conv_id", "turn", "h").distinct()
    quoted = lines.where("level > 0").select("conv_id", "h", "turn", "level").distinct()
    found = _last_originals(own, quoted)
    votes = found.groupBy("conv_id", "turn", "level", "origin").agg(F.count(F.lit(1)).alias("n"))
    # The least of (level, -lines, -turn) is the choice.
    best = votes.groupBy("conv_id", "turn").agg(F.min(F.struct("level", (-F.col("n")).alias("n"), (-F.col("origin")).alias("o"))).alias("b"))
    links = staged(best.select("conv_id", "turn", (-F.col("b")["o"]).alias("reply_to")), "links")
    anchors = _anchors(links)
    out = rows.drop("_hashes").join(links, ["conv_id", "turn"], "left").join(anchors, ["conv_id", "turn"], "left")
    back = [F.col("_carried")[c].alias(c) if c in others else F.col(c) for c in keep]
    return out.select(*back, "quoted_lines", "quote_levels", "reply_to", F.coalesce("anchor", "turn").alias("anchor_turn"))


def _anchors(links: DataFrame) -> DataFrame:
    """(conv_id, turn, anchor) of each link, by pointer jumping: every round doubles the steps taken."""
    ends = links.select("conv_id", "turn", F.col("reply_to").alias("anchor"))
    while True:
        ahead = ends.select("conv_id", F.col("turn").alias("anchor"), F.col("anchor").alias("next"))
        jumped = ends.join(ahead, ["conv_id", "anchor"], "left")
        moved = staged(jumped.select("conv_id", "turn", F.coalesce("next", "anchor").alias("anchor"), F.col("next").isNotNull().alias("moved")), "anchors")
        ends = moved.select("conv_id", "turn", "anchor")
        if moved.where("moved").isEmpty():
            return ends


ORACLE = r"""
WITH RECURSIVE l AS (
  SELECT conv_id, turn, i, line, regexp_extract(line, '^(?:[ \t]*>)+') AS pre
  FROM (SELECT conv_id, turn, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
      generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM conversations)),
p AS (
  SELECT conv_id, turn, i, line, length(pre) - length(replace(pre, '>', '')) AS level,
    lower(trim(regexp_replace(substr(line, length(pre) + 1), '[ \t\r]+', ' ', 'g'))) AS norm FROM l),
k AS (SELECT *, lead(level, 1, 0) OVER (PARTITION BY conv_id, turn ORDER BY i) AS following FROM p),
t AS (
  SELECT conv_id, turn, count(*) FILTER (level > 0) AS quoted_lines, max(level) AS quote_levels,
    coalesce(trim(string_agg(line, chr(10) ORDER BY i) FILTER (level = 0 AND NOT (following > 0 AND regexp_matches(line, '(?i)\bwrote:[ \t]*$'))), chr(10)), '') AS text
  FROM k GROUP BY conv_id, turn),
o AS (SELECT DISTINCT conv_id, turn, norm FROM p WHERE level = 0 AND norm <> ''),
q AS (SELECT DISTINCT conv_id, turn, level, norm FROM p WHERE level > 0 AND norm <> ''),
f AS (SELECT q.conv_id, q.turn, q.level, q.norm, max(o.turn) AS origin FROM q JOIN o ON o.conv_id = q.conv_id AND o.norm = q.norm AND o.turn < q.turn GROUP BY ALL),
v AS (SELECT conv_id, turn, level, origin, count(*) AS n FROM f GROUP BY ALL),
r AS (SELECT conv_id, turn, origin AS reply_to FROM v QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, n DESC, origin DESC) = 1),
a AS (
  SELECT conv_id, turn, reply_to AS anchor FROM r
  UNION ALL SELECT a.conv_id, a.turn, r.reply_to FROM a JOIN r ON r.conv_id = a.conv_id AND r.turn = a.anchor)
SELECT c.conv_id, c.turn, c.role, md5(t.text) AS text_md5, CAST(quoted_lines AS INTEGER) AS quoted_lines, CAST(quote_levels AS INTEGER) AS quote_levels,
  reply_to, coalesce(anchor, c.turn) AS anchor_turn
FROM conversations c JOIN t USING (conv_id, turn) LEFT JOIN r USING (conv_id, turn)
LEFT JOIN (SELECT conv_id, turn, min(anchor) AS anchor FROM a GROUP BY ALL) m USING (conv_id, turn)"""
