"""Every operator as a named query over the given tables, with its check in SQL.

A query without SQL has no value check: it is listed with the reason.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbox import schemas as S
from signalbox.operators import approvals as A
from signalbox.operators import chain as C
from signalbox.operators import correlate as J
from signalbox.operators import messages as P
from signalbox.operators import policy as R
from signalbox.operators import scrub as D
from signalbox.operators import stats as Q
from signalbox.operators import tools as U
from signalbox.plans import governed
from signalbox.plans import inputs as I
from signalbox.plans import oracle as O
from signalbox.session import work_dir
from signalbox.sources import capture, tables
from signalbox.sources import traffic as T
from signalbox.streaming import live as L
from signalbox.streaming.governed import GovernedStream, chain_input

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


# --- sources, sinks, table maintenance ---------------------------------------------------


@query(
    "clean_lines",  # S1
    """WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
    SELECT doc_id, count(*) AS n_lines, CAST(sum(octet_length(encode(line))) AS BIGINT) AS n_bytes,
      CAST(sum(CASE WHEN octet_length(encode(line)) >= 200 THEN 1 ELSE 0 END) AS BIGINT) AS n_oversize
    FROM lines WHERE line <> '' GROUP BY doc_id""",
)
def clean_lines(spark, sf):
    lines = T.table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("value"))
    return (
        capture.clean_lines(lines, max_bytes=200)
        .groupBy("doc_id")
        .agg(
            F.count(F.lit(1)).alias("n_lines"),
            F.sum(F.octet_length("payload")).cast("bigint").alias("n_bytes"),
            F.count_if("oversize").alias("n_oversize"),
        )
    )


@query(
    "stored_messages",  # S2
    O.sql(
        """SELECT id, session_id, tool_name, policy_action, CAST(date_trunc('day', ts) AS DATE) AS date,
      CASE WHEN rules IS NOT NULL THEN '["' || replace(rules, ',', '","') || '"]' END AS matched_rules
    FROM logged""",
        "logged",
    ),
)
def stored_messages(spark, sf):
    return tables.to_storage(I.logged(spark, sf)).select(
        "id", "session_id", "tool_name", "policy_action", "date", "matched_rules"
    )


@query(
    "read_envelopes",  # S1
    O.sql("SELECT seq, ts, session_id, direction, payload FROM traffic", "traffic"),
)
def read_envelopes(spark, sf):
    path = work_dir(spark, "capture")
    I.raw(spark, sf).write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)
    return capture.read_envelopes(spark, path).drop("oversize")


@query(
    "message_table",  # S2
    O.sql(
        """SELECT id, ts, session_id, direction, kind, method, msg_id, payload, size_bytes, blocked, audit,
      scrub_count, rules, tool_name, policy_action, policy_rule, block_reason, status FROM logged""",
        "logged",
    ),
)
def message_table(spark, sf):
    path = work_dir(spark, "message_table")
    tables.write_messages(I.logged(spark, sf), path)
    return _log_columns(tables.read_messages(spark, path))


@query(
    "sessions_from_events",  # S3
    O.sql(
        """SELECT CAST(user_id AS VARCHAR) AS id, min(ts) AS started_at, max(ts) AS ended_at,
      'server-' || arg_min(event_type, ts) AS command, arg_min(event_type, ts) AS args
    FROM ev GROUP BY user_id""",
        "ev",
    ),
)
def sessions_from_events(spark, sf):
    return tables.sessions_from_events(T.session_marks(I.events(spark, sf))).withColumn(
        "args", F.array_join("args", ",")
    )


@query(
    "upsert_latest",  # S4
    O.sql(
        """SELECT id, session_id, decision, written FROM (
      SELECT *, row_number() OVER (PARTITION BY id ORDER BY written DESC, decision DESC) AS rn FROM (
        SELECT id, session_id, 'pending' AS decision, ts AS written FROM requests
        UNION ALL SELECT id, session_id, decision, decided_at FROM resolved)) WHERE rn = 1""",
        "resolved",
    ),
)
def upsert_latest(spark, sf):
    requests = I.requests(spark, sf)
    resolved = A.resolve_approvals(requests, I.decisions(spark, sf), I.REVIEW_TIMEOUT)
    writes = A.approval_events(requests, resolved).select(
        "id", "session_id", "decision", F.col("event_ts").alias("written")
    )
    return tables.upsert_latest(writes, ["id"], ["written"])


@query("register_first", O.sql("SELECT * FROM seen", "seen"))  # S5
def register_first(spark, sf):
    return tables.register_tools(T.sightings(I.events(spark, sf)))


@query(
    "conform_messages",  # S6
    O.sql(
        """SELECT id, session_id, tool_name, CAST(NULL AS VARCHAR) AS policy_action, FALSE AS blocked,
      FALSE AS audit, CAST(0 AS BIGINT) AS scrub_count, CAST(NULL AS VARCHAR) AS rules FROM calls""",
        "calls",
    ),
)
def conform_messages(spark, sf):
    return tables.conform_messages(I.calls(spark, sf)).select(
        "id",
        "session_id",
        "tool_name",
        "policy_action",
        "blocked",
        "audit",
        F.col("scrub_count").cast("bigint").alias("scrub_count"),
        F.array_join("matched_rules", ",").alias("rules"),
    )


# --- JSON-RPC columns --------------------------------------------------------------------


def damaged(spark, sf) -> DataFrame:
    """Traffic in which three of ten messages are cut short, followed by junk, or wrapped."""
    p, nth = F.col("payload"), F.col("seq") % 10
    return I.raw(spark, sf).withColumn(
        "payload",
        F.when(nth == 0, F.left(p, F.length(p) - 1))
        .when(nth == 1, F.concat(p, F.lit(' {"id":1}')))
        .when(nth == 2, F.concat(F.lit("["), p, F.lit("]")))
        .otherwise(F.concat(F.lit("  "), p, F.lit(" "))),
    )


@query(
    "parse_messages",  # P1
    O.sql(
        """SELECT seq, seq % 10 IN (0, 1, 2) AS parse_error,
      CASE WHEN seq % 10 NOT IN (0, 1, 2) THEN method END AS method,
      CASE WHEN seq % 10 NOT IN (0, 1, 2) THEN msg_id END AS msg_id FROM traffic""",
        "traffic",
    ),
)
def parse_messages(spark, sf):
    return P.parse_messages(damaged(spark, sf)).select("seq", "parse_error", "method", "msg_id")


@query("classify_kind", O.sql("SELECT seq, kind FROM traffic", "traffic"))  # P2
def classify_kind(spark, sf):
    return P.classify_kind(P.parse_messages(I.raw(spark, sf))).select("seq", "kind")


@query("tool_name", O.sql("SELECT seq, method, tool_name FROM traffic", "traffic"))  # P3
def tool_name(spark, sf):
    return P.tool_name(P.parse_messages(I.raw(spark, sf))).select("seq", "method", "tool_name")


@query(
    "rpc_error_fields",  # P4
    O.sql(
        """SELECT seq, CASE WHEN kind = 'error' THEN CAST(-32603 AS BIGINT) END AS error_code,
      CASE WHEN kind = 'error' THEN 'internal error' END AS error_message,
      CASE WHEN kind = 'error' THEN '{"k":' || k || '}' END AS error_data FROM traffic""",
        "traffic",
    ),
)
def rpc_error_fields(spark, sf):
    return P.rpc_error_fields(P.parse_messages(I.raw(spark, sf))).select(
        "seq", "error_code", "error_message", "error_data"
    )


@query("with_size", O.sql("SELECT id, size_bytes FROM logged", "logged"))  # P5
def with_size(spark, sf):
    return P.with_size(I.raw(spark, sf)).select(F.col("seq").alias("id"), "size_bytes")


_LOG_SQL = """SELECT id, ts, session_id, direction, kind, method, msg_id, payload, size_bytes, blocked, audit,
      scrub_count, rules, tool_name, policy_action, policy_rule, block_reason, status FROM logged"""


def _log_columns(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {"rules": F.array_join("matched_rules", ","), "scrub_count": F.col("scrub_count").cast("bigint")}
    ).drop("matched_rules", "tools_pruned", "date")


@query("to_log_rows", O.sql(_LOG_SQL, "logged"))  # P6
def to_log_rows(spark, sf):
    return _log_columns(I.logged(spark, sf))


@query(
    "feed_view",  # P7
    O.sql(
        """SELECT id, strftime(ts, '%H:%M:%S.%g') AS time, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS full_time,
      CASE WHEN direction = 'host_to_server' THEN 'Host → Server' ELSE 'Server → Host' END AS direction_label,
      kind, coalesce(method, '-') AS method, coalesce(msg_id, '-') AS msg_id, session_id,
      CASE WHEN length(payload) > 80 THEN left(payload, 80) || '...' ELSE payload END AS preview, size_bytes,
      concat_ws(' ', CASE WHEN blocked THEN 'Blocked' END, CASE WHEN audit THEN 'Audit' END) AS flags,
      tool_name, policy_action, coalesce(replace(rules, ',', ', '), '') AS rules FROM logged""",
        "logged",
    ),
)
def feed_view(spark, sf):
    return P.feed_view(I.logged(spark, sf))


# --- policy ------------------------------------------------------------------------------


@query(
    "rule_condition",  # R1
    O.sql("SELECT seq, h1, h2, h3, h4, h5 FROM hits", "hits"),
)
def rule_condition(spark, sf):
    conditions = [F.coalesce(R.rule_condition(r), F.lit(False)).alias(f"h{i}") for i, r in enumerate(I.RULES, 1)]
    return I.opened(spark, sf).select("seq", *conditions)


@query(
    "evaluate_policy",  # R2
    O.sql("SELECT seq, rules, policy_action, deny_rule, approval_rule FROM policy", "policy"),
)
def evaluate_policy(spark, sf):
    return R.evaluate_policy(I.opened(spark, sf), I.RULES).select(
        "seq", F.array_join("matched_rules", ",").alias("rules"), "policy_action", "deny_rule", "approval_rule"
    )


@query(
    "enforce_policy",  # R3
    O.sql("SELECT seq, status, block_reason, audit, policy_rule, policy_action, rules FROM logged", "logged"),
)
def enforce_policy(spark, sf):
    return I.enforced(spark, sf).select(
        "seq",
        "status",
        "block_reason",
        "audit",
        "policy_rule",
        "policy_action",
        F.array_join("matched_rules", ",").alias("rules"),
    )


@query(
    "rule_hit_counts",  # R5
    O.sql(
        """SELECT rule_name, policy_action, count(*) AS hits FROM (
      SELECT unnest(string_split(rules, ',')) AS rule_name, policy_action FROM policy WHERE rules IS NOT NULL)
    GROUP BY rule_name, policy_action""",
        "policy",
    ),
)
def rule_hit_counts(spark, sf):
    return R.rule_hit_counts(I.logged(spark, sf))


@query(
    "read_rules",  # S7
    """WITH k AS (SELECT DISTINCT CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events)
    SELECT k AS ord, 'k-' || k AS name, CASE k % 4 WHEN 0 THEN 'audit' WHEN 1 THEN 'require_approval'
      WHEN 2 THEN 'deny' ELSE 'note' END AS action, 'tools/call' AS methods, '"k": ' || k || '\\b' AS patterns FROM k
    UNION ALL SELECT max(k) + 1, 'deletes', 'require_approval', '', '' FROM k""",
)
def read_rules(spark, sf):
    return _rules_from_file(spark, sf).select(
        F.col("ord").cast("bigint").alias("ord"),
        "name",
        "action",
        F.array_join("methods", ",").alias("methods"),
        F.array_join("patterns", ",").alias("patterns"),
    )


def _rules_from_file(spark, sf) -> DataFrame:
    path = work_dir(spark, "rules")
    I.rule_table(spark, sf).write.json(path)
    return capture.read_rules(spark, path)


_TABLE_SQL = O.sql(
    r"""SELECT seq,
      nullif(concat_ws(',', CASE WHEN c THEN 'k-' || k END, CASE WHEN d THEN 'deletes' END), '') AS rules,
      CASE WHEN c AND k % 4 = 2 THEN 'deny' WHEN d OR (c AND k % 4 = 1) THEN 'require_approval'
        WHEN c AND k % 4 = 0 THEN 'audit' END AS policy_action,
      CASE WHEN c AND k % 4 = 2 THEN 'k-' || k END AS deny_rule,
      CASE WHEN d AND NOT (c AND k % 4 = 2) THEN 'deletes' WHEN c AND k % 4 = 1 THEN 'k-' || k END AS approval_rule
    FROM (SELECT seq, k, coalesce(method = 'tools/call', FALSE) AS c, coalesce(tool_name = 'delete_file', FALSE) AS d
      FROM traffic)""",
    "traffic",
)


@query("evaluate_policy_table", _TABLE_SQL)  # R6, J5
def evaluate_policy_table(spark, sf):
    return R.evaluate_policy_table(I.opened(spark, sf), _rules_from_file(spark, sf)).select(
        "seq", F.array_join("matched_rules", ",").alias("rules"), "policy_action", "deny_rule", "approval_rule"
    )


@query("policy_from_files", _TABLE_SQL)  # S7
def policy_from_files(spark, sf):
    path = work_dir(spark, "policy_rules")
    I.rule_table(spark, sf).write.json(path)
    policy = capture.read_policy(spark, path)
    return R.evaluate_policy(I.opened(spark, sf), list(policy.rules)).select(
        "seq", F.array_join("matched_rules", ",").alias("rules"), "policy_action", "deny_rule", "approval_rule"
    )


@query(
    "evaluate_policy_many_rules",  # R6: a rule per customer, so that rules grow with the tables, too
    O.sql(
        """SELECT seq, CASE WHEN hit THEN 'c-' || k END AS rules, CASE WHEN NOT hit THEN NULL WHEN k % 3 = 0 THEN 'deny' ELSE 'audit' END AS policy_action
    FROM (SELECT seq, k, coalesce(method = 'tools/call' AND tool_name = CASE WHEN k % 2 = 0 THEN 'delete_file' ELSE 'write_file' END
        AND k IN (SELECT c_custkey FROM customer), FALSE) AS hit FROM traffic)""",
        "traffic",
    ),
)
def evaluate_policy_many_rules(spark, sf):
    key = F.col("c_custkey")
    text = "array<string>"
    rules = T.table(spark, sf, "customer").select(
        key.cast("int").alias("ord"),
        F.concat(F.lit("c-"), key).alias("name"),
        F.when(key % 3 == 0, S.DENY).otherwise(S.AUDIT).alias("action"),
        F.array(F.lit("tools/call")).alias("methods"),
        F.when(key % 2 == 0, F.array(F.lit("delete_file"))).otherwise(F.array(F.lit("write_file"))).cast(text).alias("tools"),
        F.lit("").alias("direction"),
        F.array(F.concat(F.lit(r'"k":\s'), key, F.lit(r"\b"))).alias("patterns"),
    )
    found = R.evaluate_policy_table(I.opened(spark, sf), rules)
    return found.select("seq", F.array_join("matched_rules", ",").alias("rules"), "policy_action")


@query(
    "deep_messages",  # P1, R3: nesting beyond what a plain parser takes
    O.sql(
        """SELECT seq, tool_name, CASE WHEN tool_name = 'delete_file' THEN 'blocked' ELSE 'forwarded' END AS status,
      CASE WHEN tool_name = 'delete_file' THEN 'blocked by policy rule "no-deletes"' END AS block_reason
    FROM traffic WHERE event_type = 'purchase'""",
        "traffic",
    ),
)
def deep_messages(spark, sf):
    """Calls with arguments 990 to 1,009, or 5,000, levels deep."""
    calls = I.events(spark, sf).where("event_type = 'purchase'")
    levels = F.when(F.col("k") % 50 == 0, 5000).otherwise((990 + F.col("k") % 20).cast("int"))
    deep = F.concat(F.repeat(F.lit("["), levels), F.repeat(F.lit("]"), levels), F.lit("}}"))
    raw = T.traffic(calls.withColumn("levels", levels)).join(calls.select(F.col("event_id").alias("seq"), deep.alias("deep")), "seq")
    head = F.regexp_extract("payload", '^.*"arguments":', 0)
    raw = raw.withColumn("payload", F.concat(head, "deep")).drop("deep")
    rules = [R.Rule("no-deletes", S.DENY, ("tools/call",), ("delete_file",))]
    return R.enforce_policy(P.open_messages(raw), rules).select("seq", "tool_name", "status", "block_reason")


@query(
    "deep_acceptance",  # P1: the same is accepted, with the same ids and listings, 3 and 1,500 levels deep
    O.sql(
        """SELECT event_id AS seq, v IN (2, 3, 4, 7) AS parse_error,
      CASE v WHEN 0 THEN '"' || k || '"' WHEN 1 THEN CAST(k AS VARCHAR) WHEN 5 THEN 'null' WHEN 6 THEN CAST(k AS VARCHAR) END AS msg_id,
      CASE WHEN v IN (0, 1, 5) THEN 'request' WHEN v = 6 THEN 'response' END AS kind,
      coalesce(v = 6, FALSE) AS lists_tools, CASE WHEN v = 6 THEN 't' || k END AS listed
    FROM (SELECT *, event_id % 8 AS v FROM ev)""",
        "ev",
    ),
)
def deep_acceptance(spark, sf):
    levels = F.when(F.col("event_id") % 9 == 0, 1500).otherwise(3)
    nested = F.concat(F.lit('{"deep":'), F.repeat(F.lit("["), levels), F.repeat(F.lit("]"), levels))
    k = F.col("k").cast("string")
    rest = [
        F.concat(F.lit(',"id":"'), k, F.lit('","method":"m"}')),
        F.concat(F.lit(',"id":'), k, F.lit(',"method":"m"}')),
        F.lit(",'id':1}"),
        F.lit(',"id":1,"result":NaN}'),
        F.concat(F.lit(',"id":'), k, F.lit(',"method":5}')),
        F.lit(',"id":null,"method":"m"}'),
        F.concat(F.lit(',"id":'), k, F.lit(',"result":{"tools":[{"name":"t'), k, F.lit('"}]}}')),
        F.concat(F.lit(',"id":"'), k, F.lit('","error":{"code":1.5}}')),
    ]
    events = I.events(spark, sf)
    payload = F.concat(nested, F.get(F.array(*rest), (F.col("event_id") % 8).cast("int")))
    texts = events.select(F.col("event_id").alias("seq"), payload.alias("text"))
    raw = T.traffic(events).join(texts, "seq").withColumn("payload", F.col("text")).drop("text")
    opened = I.staged_messages(P.open_messages(raw.withColumn("direction", F.lit(S.SERVER_TO_HOST))), "deep")
    listed = U.extract_tools(opened.where("lists_tools")).select("session_id", "seq", F.col("tool_name").alias("listed"))
    found = opened.join(listed, ["session_id", "seq"], "left")
    return found.select("seq", "parse_error", "msg_id", "kind", F.coalesce("lists_tools", F.lit(False)).alias("lists_tools"), "listed")


_HARD = (r'(?:"k"|"q"|x)+: (?:[0-9]|y)*5\b', r"(.|\n)*delete_file", r'(.*?,){2}"params')


@query(
    "evaluate_policy_linear",  # R1: patterns a backtracking matcher cannot be trusted with
    O.sql(
        f"""SELECT seq, nullif(concat_ws(',', CASE WHEN regexp_matches(payload, '{_HARD[0]}') THEN 'fives' END,
      CASE WHEN method = 'tools/call' AND regexp_matches(payload, '{_HARD[1]}') THEN 'deletes' END,
      CASE WHEN regexp_matches(payload, '{_HARD[2]}') THEN 'late' END), '') AS rules FROM traffic""",
        "traffic",
    ),
)
def evaluate_policy_linear(spark, sf):
    rules = [
        R.Rule("fives", S.AUDIT, patterns=(_HARD[0],)),
        R.Rule("deletes", S.DENY, ("tools/call",), patterns=(_HARD[1],)),
        R.Rule("late", S.AUDIT, patterns=(_HARD[2],)),
    ]
    found = R.evaluate_policy(I.opened(spark, sf), rules)
    return found.select("seq", F.array_join("matched_rules", ",").alias("rules"))


# --- redaction ---------------------------------------------------------------------------


@query(
    "scrub_text",  # D1
    f"WITH {O.scrubbed('documents', 'doc_id', 'text')} SELECT doc_id, md5(text) AS text_md5 FROM scrubbed",
)
def scrub_text(spark, sf):
    docs = T.table(spark, sf, "documents").select("doc_id", "text")
    return D.scrub_text(docs, "text").select("doc_id", F.md5("text").alias("text_md5"))


@query(
    "scrub_count",  # D2
    f"WITH {O.scrubbed('pages', 'page_id', 'html')} "
    f"SELECT page_id, {O.total()} AS scrub_count, md5(text) AS html_md5 FROM scrubbed",
)
def scrub_count(spark, sf):
    pages = T.table(spark, sf, "pages").select("page_id", "html")
    return D.scrub_text(pages, "html").select(
        "page_id", F.col("scrub_count").cast("bigint").alias("scrub_count"), F.md5("html").alias("html_md5")
    )


_WITH_TOKEN = (*O.PII, O.HEX_TOKEN)


@query(
    "custom_patterns",  # D3
    f"WITH {O.scrubbed('documents', 'doc_id', 'text', _WITH_TOKEN)} "
    f"SELECT doc_id, {O.total(_WITH_TOKEN)} AS scrub_count, md5(text) AS text_md5 FROM scrubbed",
)
def custom_patterns(spark, sf):
    docs = T.table(spark, sf, "documents").select("doc_id", "text")
    return D.scrub_text(docs, "text", I.CUSTOM).select(
        "doc_id", F.col("scrub_count").cast("bigint").alias("scrub_count"), F.md5("text").alias("text_md5")
    )


_DOC_PAYLOAD = """md5('{"jsonrpc":"2.0","id":' || doc_id || ',"result":{"lang":' || to_json(lang) ||
      ',"content":[{"type":"text","text":' || to_json(text) || '}]}}')"""


@query(
    "scrub_json",  # D4
    f"WITH {O.scrubbed('documents', 'doc_id, lang', 'text', _WITH_TOKEN)} "
    f"SELECT doc_id, {O.total(_WITH_TOKEN)} AS scrub_count, {_DOC_PAYLOAD} AS payload_md5 FROM scrubbed",
)
def scrub_json(spark, sf):
    docs = T.document_messages(T.table(spark, sf, "documents"))
    return D.scrub_json(docs, custom_patterns=I.CUSTOM).select(
        F.col("seq").alias("doc_id"),
        F.col("scrub_count").cast("bigint").alias("scrub_count"),
        F.md5("payload").alias("payload_md5"),
    )


@query(
    "scrub_messages",  # D5
    O.sql("", "chat").rstrip()
    + ",\n"
    + O.scrubbed("chat", "session_id, seq, role, direction, text AS original", "text")
    + f"""
    SELECT session_id, seq, CASE WHEN role = 'assistant' THEN {O.total()} ELSE 0 END AS scrub_count,
      md5(CASE WHEN role = 'assistant' THEN '{{"jsonrpc":"2.0","id":' || seq || ',"result":{{"content":' || to_json(text) || '}}}}'
      ELSE '{{"jsonrpc":"2.0","id":' || seq || ',"method":"chat/' || role || '","params":{{"text":' || to_json(original)
        || '}}}}' END) AS payload_md5
    FROM scrubbed""",
)
def scrub_messages(spark, sf):
    opened = P.open_messages(T.chat(T.table(spark, sf, "conversations")))
    return D.scrub_messages(opened).select(
        "session_id",
        "seq",
        F.col("scrub_count").cast("bigint").alias("scrub_count"),
        F.md5("payload").alias("payload_md5"),
    )


@query(
    "pii_report",  # D6
    f"WITH {O.scrubbed('documents', 'source', 'text')} "
    "SELECT session_id, label, CAST(sum(n) AS BIGINT) AS redactions FROM ("
    f"{O.label_rows('source AS session_id, ')}) GROUP BY session_id, label HAVING sum(n) > 0",
)
def pii_report(spark, sf):
    docs = T.document_messages(T.table(spark, sf, "documents"))
    return D.pii_report(D.scrub_messages(P.open_messages(docs), label_counts=True), "session_id")


# --- pairing of listings -----------------------------------------------------------------


@query(
    "correlate_lists",  # J3
    O.sql(
        """SELECT session_id, msg_id, seq, ts AS response_ts, request_seq, request_ts FROM matched""", "matched"
    ),
)
def correlate_lists(spark, sf):
    return J.correlate_lists(I.opened(spark, sf), I.LIST_TTL)


# --- approvals ---------------------------------------------------------------------------


@query(
    "approval_requests",  # A1
    O.sql(
        """SELECT 'apr-' || row_number() OVER (ORDER BY ts, session_id, seq) AS id, ts, session_id, direction, method,
      tool_name, rule_name, payload, 'pending' AS decision FROM requests""",
        "requests",
    ),
)
def approval_requests(spark, sf):
    return A.name_requests(I.requests(spark, sf), "global").drop("decided_at", "seq")


@query(
    "approval_requests_by_session",  # A1, numbered within the session
    O.sql(
        """SELECT 'apr-' || row_number() OVER (PARTITION BY session_id ORDER BY ts, seq) AS id, session_id, seq
    FROM requests""",
        "requests",
    ),
)
def approval_requests_by_session(spark, sf):
    return A.name_requests(I.requests(spark, sf), "session").select("id", "session_id", "seq")


@query(
    "resolve_approvals",  # A2, J4
    O.sql("SELECT id, session_id, seq, tool_name, rule_name, ts, decision, decided_at FROM resolved", "resolved"),
)
def resolve_approvals(spark, sf):
    return A.resolve_approvals(I.requests(spark, sf), I.decisions(spark, sf), I.REVIEW_TIMEOUT).select(
        "id", "session_id", "seq", "tool_name", "rule_name", "ts", "decision", "decided_at"
    )


_REASON = """CASE WHEN l.policy_action = 'deny' THEN l.block_reason
      WHEN r.decision = 'denied' THEN 'denied by human review (rule: ' || r.rule_name || ')'
      WHEN r.decision = 'timeout' THEN 'approval timed out (rule: ' || r.rule_name || ')' END"""


@query(
    "apply_approvals",  # A3
    O.sql(
        f"""SELECT l.seq, l.session_id, CASE WHEN {_REASON} IS NULL THEN 'forwarded' ELSE 'blocked' END AS status,
      {_REASON} AS block_reason FROM logged l LEFT JOIN resolved r ON r.seq = l.seq""",
        "resolved",
    ),
)
def apply_approvals(spark, sf):
    messages = I.staged_messages(I.enforced(spark, sf))
    requests = A.approval_requests(messages).withColumn("id", T.request_id(F.col("seq")))
    resolved = A.resolve_approvals(requests, I.decisions(spark, sf), I.REVIEW_TIMEOUT)
    return A.apply_approvals(messages, resolved).select("seq", "session_id", "status", "block_reason")


_AS_OF = "2024-01-15 12:00:00"
_PENDING_SQL = f"""SELECT %s FROM requests q WHERE q.ts <= TIMESTAMP '{_AS_OF}'
      AND TIMESTAMP '{_AS_OF}' < q.ts + INTERVAL 2 DAY AND NOT EXISTS (SELECT 1 FROM decisions d
        WHERE d.approval_id = q.id AND d.decided_at >= q.ts AND d.decided_at <= TIMESTAMP '{_AS_OF}')"""


@query("pending_approvals", O.sql(_PENDING_SQL % "id, session_id, seq, tool_name", "requests", "decisions"))  # A4
def pending_approvals(spark, sf):
    return A.pending_approvals(
        I.requests(spark, sf), I.decisions(spark, sf), _AS_OF, A.timedelta(days=2)
    ).select("id", "session_id", "seq", "tool_name")


@query(
    "pending_count", O.sql(_PENDING_SQL % "count(*) AS approval_pending", "requests", "decisions")  # A4
)
def pending_count(spark, sf):
    return A.pending_count(I.requests(spark, sf), I.decisions(spark, sf), _AS_OF, A.timedelta(days=2))


@query(
    "approval_history",  # A5
    O.sql(
        """SELECT id, ts, session_id, decision, decided_at FROM resolved ORDER BY ts DESC, id DESC LIMIT 100""",
        "resolved",
    ),
)
def approval_history(spark, sf):
    resolved = A.resolve_approvals(I.requests(spark, sf), I.decisions(spark, sf), I.REVIEW_TIMEOUT)
    return A.approval_history(resolved).select("id", "ts", "session_id", "decision", "decided_at")


@query(
    "approval_events",  # A6
    O.sql(
        """SELECT 'requested' AS type, ts AS event_ts, id, tool_name, 'pending' AS decision FROM requests
    UNION ALL SELECT 'resolved', decided_at, id, tool_name, decision FROM resolved""",
        "resolved",
    ),
)
def approval_events(spark, sf):
    requests = I.requests(spark, sf)
    resolved = A.resolve_approvals(requests, I.decisions(spark, sf), I.REVIEW_TIMEOUT)
    return A.approval_events(requests, resolved).select("type", "event_ts", "id", "tool_name", "decision")


@query(
    "rejected_decisions",  # A7
    O.sql(
        """SELECT approval_id, decided_at, approved, decision_seq,
      'approval request "' || approval_id || '" not found or already resolved' AS error
    FROM decisions WHERE decision_seq NOT IN (SELECT decision_seq FROM first)""",
        "first",
    ),
)
def rejected_decisions(spark, sf):
    return A.rejected(I.requests(spark, sf), I.decisions(spark, sf), I.REVIEW_TIMEOUT)


# --- chain -------------------------------------------------------------------------------


def _stages():
    return [
        lambda df: R.enforce_policy(df, I.RULES),
        C.stage(
            modify=F.replace(F.col("payload"), F.lit("nextCursor"), F.lit("cursor")),
            drop=F.col("kind") == S.NOTIFICATION,
            block=F.col("payload").contains('"id":7'),
            reason="no sevens",
        ),
    ]


_CHAIN = """chained AS (SELECT seq, session_id, ts, direction, msg_id, CASE WHEN status = 'blocked' THEN status
      WHEN contains(payload, '"id":7') THEN 'blocked' WHEN kind = 'notification' THEN 'dropped'
      ELSE 'forwarded' END AS status,
    CASE WHEN status = 'blocked' THEN block_reason WHEN contains(payload, '"id":7') THEN 'no sevens' END AS block_reason,
    CASE WHEN status = 'forwarded' AND NOT contains(payload, '"id":7')
      THEN replace(payload, 'nextCursor', 'cursor') ELSE payload END AS payload FROM logged)"""


@query(
    "run_chain",  # C1, C2
    O.sql("", "logged").rstrip()
    + ",\n"
    + _CHAIN
    + "\nSELECT seq, status, block_reason, md5(payload) AS payload_md5 FROM chained",
)
def run_chain(spark, sf):
    return C.run_chain(I.opened(spark, sf), *_stages()).select(
        "seq", "status", "block_reason", F.md5("payload").alias("payload_md5")
    )


@query(
    "block_responses",  # C3
    O.sql("", "logged").rstrip()
    + ",\n"
    + _CHAIN
    + """
    SELECT session_id, seq, ts, CASE WHEN direction = 'host_to_server' THEN 'server_to_host' ELSE 'host_to_server' END
      AS direction, '{"jsonrpc":"2.0","id":' || msg_id || ',"error":{"code":-32600,"message":"' ||
      replace(block_reason, '"', '\\"') || '"}}' AS payload
    FROM chained WHERE status = 'blocked' AND msg_id IS NOT NULL""",
)
def block_responses(spark, sf):
    return C.block_responses(C.run_chain(I.opened(spark, sf), *_stages()))


@query(
    "split_outcomes",  # C4
    O.sql("", "logged").rstrip()
    + ",\n"
    + _CHAIN
    + "\nSELECT status AS outcome, count(*) AS n_messages FROM chained GROUP BY status",
)
def split_outcomes(spark, sf):
    rows = C.run_chain(I.opened(spark, sf), *_stages()).drop("v")
    parts = C.split_outcomes(rows, work_dir(spark, "outcomes"))
    counts = [
        df.groupBy(F.lit(name).alias("outcome")).agg(F.count(F.lit(1)).alias("n_messages"))
        for name, df in parts.items()
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


# --- tools -------------------------------------------------------------------------------


def _listings(messages: DataFrame) -> DataFrame:
    return I.staged_messages(J.list_responses(messages, I.LIST_TTL), "listings")


@query(
    "extract_tools",  # U1
    O.sql("SELECT session_id, seq, ts, CAST(pos AS BIGINT) AS pos, tool_name, description FROM tools", "tools"),
)
def extract_tools(spark, sf):
    return U.extract_tools(_listings(I.staged_messages(I.opened(spark, sf))))


@query("tool_usage_counts", O.sql("SELECT tool_name, count(*) AS cnt FROM calls GROUP BY tool_name", "calls"))  # U2
def tool_usage_counts(spark, sf):
    return U.tool_usage_counts(I.calls(spark, sf), T.sessions(I.events(spark, sf)))


@query(
    "tool_usage_recent_sessions",  # U2, J2
    O.sql(
        """SELECT tool_name, count(*) AS cnt FROM calls WHERE session_id IN (
      SELECT id FROM sessions ORDER BY started_at DESC, id DESC LIMIT 40) GROUP BY tool_name""",
        "calls",
        "sessions",
    ),
)
def tool_usage_recent_sessions(spark, sf):
    return U.tool_usage_counts(I.calls(spark, sf), T.sessions(I.events(spark, sf)), I.RECENT_SESSIONS)


@query("tool_analytics", O.sql("SELECT * FROM analytics", "analytics"))  # U3, J1
def tool_analytics(spark, sf):
    return U.tool_analytics(I.registry(spark, sf), I.calls(spark, sf))


@query(
    "tool_analytics_of_session",  # U3
    O.sql(
        """SELECT * FROM analytics WHERE (tool_name, description) IN (
      SELECT (tool_name, description) FROM registry WHERE session_id = '7')""",
        "analytics",
    ),
)
def tool_analytics_of_session(spark, sf):
    return U.tool_analytics(I.registry(spark, sf), I.calls(spark, sf), "7")


@query(
    "tool_summary",  # U4
    O.sql(
        """SELECT count(*) AS total_available, CAST(sum(CASE WHEN call_count > 0 THEN 1 ELSE 0 END) AS BIGINT) AS total_used,
      CAST(0 AS BIGINT) AS total_pruned FROM analytics""",
        "analytics",
    ),
)
def tool_summary(spark, sf):
    return U.tool_summary(U.tool_analytics(I.registry(spark, sf), I.calls(spark, sf)))


@query(
    "tool_status",  # U5
    O.sql(
        """SELECT tool_name, CASE WHEN length(description) > 60 THEN left(description, 60) || '...' ELSE description END
      AS description, call_count, sessions_used, coalesce(strftime(last_used, '%Y-%m-%d %H:%M:%S.%g'), 'never') AS last_used,
      CASE WHEN call_count > 0 THEN 'active' ELSE 'unused' END AS status FROM analytics""",
        "analytics",
    ),
)
def tool_status(spark, sf):
    return U.tool_status(U.tool_analytics(I.registry(spark, sf), I.calls(spark, sf)))


_PRUNE_SQL = "SELECT session_id, seq, CAST(pos AS BIGINT) AS pos, tool_name, keep FROM %s"


@query("prune_tools_unused", O.sql(_PRUNE_SQL % "pruned_unused", "pruned_unused"))  # U6
def prune_tools_unused(spark, sf):
    messages = I.staged_messages(I.opened(spark, sf))
    usage = U.tool_usage_counts(messages, T.sessions(I.events(spark, sf)), I.RECENT_SESSIONS)
    return U.prune_tools(U.tool_entries(_listings(messages)), usage, I.PRUNE_UNUSED).select(
        "session_id", "seq", "pos", "tool_name", "keep"
    )


@query("prune_tools_top_k", O.sql(_PRUNE_SQL % "pruned_top", "pruned_top"))  # U6
def prune_tools_top_k(spark, sf):
    messages = I.staged_messages(I.opened(spark, sf))
    usage = U.tool_usage_counts(messages, T.sessions(I.events(spark, sf)))
    return U.prune_tools(U.tool_entries(_listings(messages)), usage, I.PRUNE_TOP).select(
        "session_id", "seq", "pos", "tool_name", "keep"
    )


_REBUILT_TOP = """SELECT session_id, seq, CAST(sum(CASE WHEN keep THEN 0 ELSE 1 END) AS BIGINT) AS tools_pruned,
      '{"jsonrpc":"2.0","id":' || any_value(k) || ',"result":{"nextCursor":"c","tools":[' ||
      string_agg(text, ',' ORDER BY pos) FILTER (WHERE keep) || ']}}' AS payload FROM pruned_top GROUP BY session_id, seq"""


@query("rebuild_list_responses", O.sql(_REBUILT_TOP, "pruned_top"))  # U7
def rebuild_list_responses(spark, sf):
    messages = I.staged_messages(I.opened(spark, sf))
    listings = _listings(messages)
    usage = U.tool_usage_counts(messages, T.sessions(I.events(spark, sf)))
    marks = U.prune_tools(U.tool_entries(listings), usage, I.PRUNE_TOP)
    return U.rebuild_list_responses(listings, marks).select(
        "session_id", "seq", F.col("tools_pruned").cast("bigint").alias("tools_pruned"), "payload"
    )


@query(
    "pruned_tool_summary",  # U4, U5 with pruning
    O.sql(
        """SELECT a.tool_name, a.call_count, a.tool_name IN (SELECT tool_name FROM pruned_top WHERE NOT keep) AS is_pruned
    FROM (SELECT r.tool_name, coalesce(max(u.cnt), 0) AS call_count FROM (SELECT DISTINCT tool_name, description FROM tools) r
      LEFT JOIN all_usage u ON u.tool_name = r.tool_name GROUP BY r.tool_name, r.description) a""",
        "pruned_top",
    ),
)
def pruned_tool_summary(spark, sf):
    messages = I.staged_messages(I.opened(spark, sf))
    entries = U.tool_entries(_listings(messages))
    usage = U.tool_usage_counts(messages, T.sessions(I.events(spark, sf)))
    marks = U.prune_tools(entries, usage, I.PRUNE_TOP)
    analytics = U.tool_analytics(
        entries.where("described").select("session_id", "tool_name", "description"), messages
    )
    return U.mark_pruned(analytics, marks).select("tool_name", "call_count", "is_pruned")


# --- reports -----------------------------------------------------------------------------


# The reports with filters run on messages still to be parsed here, so the filter
# is also given to the input; on the written table it reaches the scan by itself.
_SINCE = "2024-01-10 00:00:00"


@query(
    "query_messages",  # Q1
    O.sql(
        _LOG_SQL
        + """ WHERE direction = 'host_to_server' AND method = 'tools/call' AND kind = 'request'
      AND ts >= TIMESTAMP '2024-01-10 00:00:00' ORDER BY id DESC LIMIT 50 OFFSET 25""",
        "logged",
    ),
)
def query_messages(spark, sf):
    return _log_columns(
        Q.query_messages(
            I.logged(spark, sf, (F.col("direction") == S.HOST_TO_SERVER) & (F.col("ts") >= _SINCE)),
            direction=S.HOST_TO_SERVER,
            method="tools/call",
            kind=S.REQUEST,
            since=_SINCE,
            limit=50,
            offset=25,
        )
    )


@query(
    "query_session",  # Q1
    O.sql("SELECT id, kind, method FROM traffic WHERE session_id = '8' ORDER BY id DESC LIMIT 200", "traffic"),
)
def query_session(spark, sf):
    return Q.query_messages(I.logged(spark, sf, F.col("session_id") == "8"), session_id="8").select("id", "kind", "method")


@query("get_message", O.sql(_LOG_SQL + " WHERE id = 777", "logged"))  # Q2
def get_message(spark, sf):
    return _log_columns(Q.find_message(I.logged(spark, sf, F.col("seq") == 777), 777))


_TOTALS = """count(*) AS total_messages, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS total_bytes,
      CAST(coalesce(sum(CAST(blocked AS INT)), 0) AS BIGINT) AS blocked_count,
      CAST(coalesce(sum(scrub_count), 0) AS BIGINT) AS scrub_count,
      CAST(coalesce(sum(CAST(audit AS INT)), 0) AS BIGINT) AS audit_count"""
_KINDS = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS {k}_count" for k in S.KINDS)


@query("stats_totals", O.sql(f"SELECT {_TOTALS} FROM logged", "logged"))  # Q3
def stats_totals(spark, sf):
    return Q.stats_totals(I.logged(spark, sf))


@query("kind_counts", O.sql(f"SELECT {_KINDS} FROM logged WHERE session_id = '42'", "logged"))  # Q4
def kind_counts(spark, sf):
    return Q.kind_counts(I.logged(spark, sf, F.col("session_id") == "42"), "42")


@query(
    "method_counts",  # Q5
    O.sql(
        """SELECT method, count(*) AS cnt FROM logged WHERE method IS NOT NULL AND method <> ''
    GROUP BY method ORDER BY cnt DESC, method LIMIT 20""",
        "logged",
    ),
)
def method_counts(spark, sf):
    return Q.method_counts(I.logged(spark, sf))


@query(
    "stats",  # Q6
    O.sql("", "logged", "decisions").rstrip()
    + f""", methods AS (SELECT method, count(*) AS cnt FROM logged WHERE method IS NOT NULL GROUP BY method)
    SELECT t.*, (SELECT string_agg(method || '=' || cnt, ',' ORDER BY method) FROM methods) AS method_counts,
      p.approval_pending FROM (SELECT {_TOTALS}, {_KINDS} FROM logged) t,
      ({_PENDING_SQL.replace("requests q", "(SELECT 'req-' || seq AS id, ts FROM logged WHERE policy_action = 'require_approval') q") % "count(*) AS approval_pending"}) p""",
)
def stats(spark, sf):
    messages = I.logged(spark, sf)
    pending = A.pending_count(I.requests(spark, sf), I.decisions(spark, sf), _AS_OF, A.timedelta(days=2))
    pairs = F.transform(
        F.array_sort(F.map_entries("method_counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"])
    )
    return Q.stats(messages, pending=pending).withColumn("method_counts", F.array_join(pairs, ","))


@query("recent_feed", O.sql(_LOG_SQL + " ORDER BY id DESC LIMIT 100", "logged"))  # Q7
def recent_feed(spark, sf):
    return _log_columns(Q.recent_feed(I.logged(spark, sf)))


@query(
    "stats_by_session",  # Q8
    O.sql(f"SELECT session_id, {_TOTALS}, {_KINDS} FROM logged GROUP BY session_id", "logged"),
)
def stats_by_session(spark, sf):
    return Q.stats_by_session(I.logged(spark, sf))


# --- everything together -----------------------------------------------------------------


@query(
    "governed_messages",
    O.sql(
        f"""SELECT l.seq AS id, l.session_id, l.kind, l.rules, l.policy_action, l.audit,
      CASE WHEN {_REASON} IS NULL THEN 'forwarded' ELSE 'blocked' END AS status, {_REASON} AS block_reason,
      p.tools_pruned, md5(coalesce(p.payload, l.payload)) AS payload_md5,
      CAST(octet_length(encode(coalesce(p.payload, l.payload))) AS BIGINT) AS size_bytes
    FROM logged l LEFT JOIN resolved r ON r.seq = l.seq LEFT JOIN ({_REBUILT_TOP}) p ON p.seq = l.seq""",
        "resolved",
        "pruned_top",
    ),
)
def governed_messages(spark, sf):
    out = governed.govern(
        I.raw(spark, sf),
        R.Policy(tuple(I.RULES), scrub=True),
        decisions=I.decisions(spark, sf),
        timeout=I.REVIEW_TIMEOUT,
        prune=I.PRUNE_TOP,
        usage=I.usage(spark, sf, 0),
        ttl=I.LIST_TTL,
        request_ids=lambda df: df.withColumn("id", T.request_id(F.col("seq"))),
        stage_dir=work_dir(spark, "governed"),
    )
    return _governed_columns(out.messages)


def _governed_columns(messages: DataFrame) -> DataFrame:
    return messages.select(
        "id",
        "session_id",
        "kind",
        F.array_join("matched_rules", ",").alias("rules"),
        "policy_action",
        "audit",
        "status",
        "block_reason",
        F.col("tools_pruned").cast("bigint").alias("tools_pruned"),
        F.md5("payload").alias("payload_md5"),
        "size_bytes",
    )


# --- the written tables, read again ---------------------------------------------------------


def _stored(spark, sf, name: str) -> DataFrame:
    path = work_dir(spark, name)
    tables.write_messages(I.logged(spark, sf), path)
    return tables.read_messages(spark, path)


@query(
    "stored_query_messages",  # Q1 on S2
    O.sql(
        _LOG_SQL + " WHERE kind = 'request' AND ts >= TIMESTAMP '2024-01-20 06:00:00' ORDER BY id DESC LIMIT 500", "logged"
    ),
)
def stored_query_messages(spark, sf):
    stored = _stored(spark, sf, "stored_query")
    return _log_columns(Q.query_messages(stored, kind="request", since="2024-01-20 06:00:00", limit=500))


@query(
    "stored_stats",  # Q8 on S2
    O.sql(f"SELECT session_id, {_TOTALS}, {_KINDS} FROM logged GROUP BY session_id", "logged"),
)
def stored_stats(spark, sf):
    return Q.stats_by_session(_stored(spark, sf, "stored_stats"))


_HALF = "2024-01-15 12:00:00"


@query("merge_sessions", ORACLE["sessions_from_events"])  # S3 into a stored table
def merge_sessions(spark, sf):
    marks = T.session_marks(I.events(spark, sf))
    first = F.col("started_at") < F.lit(_HALF).cast("timestamp")
    stored = tables.staged(tables.sessions_from_events(marks.where(first)), work_dir(spark, "sessions"))
    return tables.merge_sessions(stored, marks.where(~first)).withColumn("args", F.array_join("args", ","))


@query("merge_registry", O.sql("SELECT * FROM seen", "seen"))  # S5 into a stored table
def merge_registry(spark, sf):
    seen = T.sightings(I.events(spark, sf))
    first = F.col("ts") < F.lit(_HALF).cast("timestamp")
    stored = tables.staged(tables.register_tools(seen.where(first)), work_dir(spark, "registry"))
    new = tables.register_tools(seen.where(~first))
    return tables.merge_first(stored, new, ["session_id", "tool_name"], ["first_seen"])


@query(
    "merge_approvals",  # S4 into a stored table
    O.sql("SELECT id, session_id, decision, decided_at FROM resolved", "resolved"),
)
def merge_approvals(spark, sf):
    requests = I.requests(spark, sf)
    columns = ["id", "session_id", "decision", "decided_at"]
    stored = tables.staged(requests.select(*columns), work_dir(spark, "approvals"))
    resolved = A.resolve_approvals(requests, I.decisions(spark, sf), I.REVIEW_TIMEOUT)
    return tables.merge_latest(stored, resolved, ["id"], ["decided_at"])


# What the notes below hold by k % 4, and the mark that is left of it.
_NOTES = (
    ("ann.{k}@post.example.net", "[REDACTED:email]"),
    ("10.0.7.{k}", "[REDACTED:ip_address]"),
    ("907-11-1{k}", "[REDACTED:ssn]"),
    ("sk-abcdefghijklmnopqrst{k}", "[REDACTED:api_key]"),
)


def _note_sql(which: int) -> str:
    k = "lpad(CAST(k % 200 AS STRING), 3, '0')"
    cases = " ".join(f"WHEN {i} THEN '{n[which]}'" for i, n in enumerate(_NOTES))
    return f"replace(CASE CAST(k % 4 AS INT) {cases} END, '{{k}}', {k})"


@query(
    "screen_secrets",  # D5, C2, P6: secrets in both directions, redacted in one
    O.sql(
        f"""SELECT id, direction, scrub_count, size_bytes, md5(payload) AS payload_md5, blocked FROM (
      SELECT id, direction, blocked, CAST(CASE WHEN direction = 'server_to_host' THEN 1 ELSE 0 END AS BIGINT) AS scrub_count,
        text AS payload, CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes FROM (
        SELECT *, '{{"note":"' || CASE WHEN direction = 'server_to_host' THEN {_note_sql(1)} ELSE {_note_sql(0)} END || '",'
          || substr(payload, 2) AS text FROM logged WHERE event_type <> 'signup'))""",
        "logged",
    ),
)
def screen_secrets(spark, sf):
    events = I.events(spark, sf).where("event_type <> 'signup'")
    notes = events.select(F.col("event_id").alias("seq"), F.expr(_note_sql(0)).alias("note"))
    raw = T.traffic(events).join(notes, "seq")
    raw = raw.withColumn("payload", F.concat(F.lit('{"note":"'), "note", F.lit('",'), F.substring("payload", 2, 2**31 - 1))).drop("note")
    rows = P.to_log_rows(governed.screen(raw, R.Policy(tuple(I.RULES), scrub=True)))
    return rows.select("id", "direction", F.col("scrub_count").cast("bigint").alias("scrub_count"), "size_bytes", F.md5("payload").alias("payload_md5"), "blocked")


# --- streams: the events table read as a stream, to its end ------------------------------


_STREAM_FILES = 3
_ROW_GROUP_BYTES = 1 << 20


def _event_parts(spark, sf) -> list[DataFrame]:
    """The events cut by time into one part per micro-batch, so that state is carried.

    Events without a time are in the first part.
    """
    events = spark.read.parquet(f"{sf}/events.parquet")
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    parts = []
    for i in range(_STREAM_FILES):
        part = events
        if low is None:
            part = events.where(F.lit(i == 0))
        else:
            if i > 0:
                part = part.where(F.col("ts") >= F.lit(low + (high - low) * i / _STREAM_FILES))
            if i + 1 < _STREAM_FILES:
                before = F.col("ts") < F.lit(low + (high - low) * (i + 1) / _STREAM_FILES)
                part = part.where(before | F.col("ts").isNull() if i == 0 else before)
        parts.append(part)
    return parts


def _event_stream(spark, sf) -> DataFrame:
    """The events as files of consecutive times, one per micro-batch.

    Their row groups are small, so that many tasks can share a batch however many rows it has.
    """
    path = work_dir(spark, "event_files")
    parts = _event_parts(spark, sf)
    for part in parts:
        part.coalesce(1).write.mode("append").option("parquet.block.size", _ROW_GROUP_BYTES).parquet(path)
    reader = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1)
    return T.typed_events(reader.parquet(path))


def _log_stream(spark, sf) -> DataFrame:
    return L.stream_messages(T.traffic(_event_stream(spark, sf)), R.Policy(tuple(I.RULES), scrub=True))


def _finish(streaming_query) -> None:
    streaming_query.awaitTermination()


@query("stream_messages", O.sql(_LOG_SQL, "logged"))  # T1
def stream_messages(spark, sf):
    root = work_dir(spark, "stream_messages")
    _finish(L.append_messages(_log_stream(spark, sf), f"{root}/messages", f"{root}/checkpoint", once=True))
    return _log_columns(tables.read_messages(spark, f"{root}/messages"))


@query("stream_governed", ORACLE["governed_messages"])  # T1: the whole chain, review and pruning included
def stream_governed(spark, sf):
    """Three parts of the events, each its own folder and start of the stream: two restarts from state."""
    root, path = work_dir(spark, "stream_governed"), work_dir(spark, "governed_events")
    usage = tables.staged(I.usage(spark, sf, 0), f"{root}/usage")
    chain = GovernedStream(
        root, R.Policy(tuple(I.RULES), scrub=True), I.REVIEW_TIMEOUT, I.PRUNE_TOP, usage, ttl=I.LIST_TTL,
        request_ids=lambda df: df.withColumn("id", T.request_id(F.col("seq"))),
    )
    parts = _event_parts(spark, sf)
    for n, part in enumerate(parts):
        part.write.parquet(f"{path}/part={n}")
        events = T.typed_events(spark.readStream.schema(parts[0].schema).parquet(f"{path}/part=*"))
        _finish(chain.start(chain_input(T.traffic(events), T.decisions(events)), f"{root}/checkpoint", once=True))
    chain.finish(spark)
    return _governed_columns(chain.messages(spark))


@query(
    "fan_out",  # T3
    O.sql(
        """SELECT 'all' AS sink, count(*) AS n_messages FROM logged
    UNION ALL SELECT 'blocked', count(*) FROM logged WHERE blocked
    UNION ALL SELECT 'audited', count(*) FROM logged WHERE audit""",
        "logged",
    ),
)
def fan_out(spark, sf):
    root = work_dir(spark, "fan_out")
    sinks = {
        "all": L.batch_table(f"{root}/all"),
        "blocked": L.batch_table(f"{root}/blocked", lambda df: df.where("blocked")),
        "audited": L.batch_table(f"{root}/audited", lambda df: df.where("audit")),
    }
    _finish(L.fan_out(_log_stream(spark, sf), sinks, f"{root}/checkpoint", once=True))
    counts = [
        spark.read.parquet(f"{root}/{name}").groupBy(F.lit(name).alias("sink")).agg(F.count(F.lit(1)).alias("n_messages"))
        for name in sinks
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(
    "live_stats", O.sql(f"SELECT session_id, {_TOTALS}, {_KINDS} FROM logged GROUP BY session_id", "logged")  # T4
)
def live_stats(spark, sf):
    root = work_dir(spark, "live_stats")
    write = L.report_versions(f"{root}/stats")
    running = L.live_stats(_log_stream(spark, sf)).writeStream.outputMode("complete").foreachBatch(write)
    _finish(L.start(running, f"{root}/checkpoint", once=True))
    return L.latest_version(spark, f"{root}/stats")


@query("live_tool_analytics", O.sql("SELECT * FROM analytics", "analytics"))  # T4
def live_tool_analytics(spark, sf):
    root = work_dir(spark, "live_tool_analytics")
    write = L.report_versions(f"{root}/report")
    messages = T.tool_calls(_event_stream(spark, sf))
    _finish(L.live_tool_analytics(messages, I.registry(spark, sf), write, f"{root}/checkpoint", once=True))
    return L.latest_version(spark, f"{root}/report")


@query(
    "stream_correlation",  # T5
    O.sql(
        "SELECT session_id, msg_id, seq, ts AS response_ts, request_seq, request_ts FROM matched", "matched"
    ),
)
def stream_correlation(spark, sf):
    root = work_dir(spark, "stream_correlation")
    events = J.list_events(P.open_messages(T.traffic(_event_stream(spark, sf))))
    pairing = L.ListPairing(root, I.LIST_TTL)
    run = pairing.start(events, f"{root}/checkpoint", once=True)
    _finish(run)
    last = run.lastProgress["batchId"]
    return pairing.matches(spark).unionByName(pairing.pending(spark, last))


@query("stream_approvals", O.sql("SELECT id, session_id, seq, ts, decision, decided_at FROM resolved", "resolved"))  # T6
def stream_approvals(spark, sf):
    root = work_dir(spark, "stream_approvals")
    policy_rows = R.enforce_policy(P.open_messages(T.traffic(_event_stream(spark, sf))), I.RULES)
    requests = A.approval_requests(policy_rows).withColumn("id", T.request_id(F.col("seq"))).drop("payload")
    resolved = L.resolve_stream(requests, T.decisions(_event_stream(spark, sf)), I.REVIEW_TIMEOUT)
    writer = resolved.writeStream.format("parquet").option("path", f"{root}/resolved")
    _finish(L.start(writer, f"{root}/checkpoint", once=True))
    written = spark.read.schema(resolved.schema).parquet(f"{root}/resolved")
    rest = L.open_at_end(I.requests(spark, sf), I.decisions(spark, sf), written, I.REVIEW_TIMEOUT)
    columns = ["id", "session_id", "seq", "ts", "decision", "decided_at"]
    return written.select(*columns).unionByName(rest.select(*columns))


@query("stream_registry", O.sql("SELECT * FROM seen", "seen"))  # T7
def stream_registry(spark, sf):
    root = work_dir(spark, "stream_registry")
    write = L.report_versions(f"{root}/registry")
    running = L.register_stream(T.sightings(_event_stream(spark, sf)))
    _finish(L.start(running.writeStream.outputMode("complete").foreachBatch(write), f"{root}/checkpoint", once=True))
    return L.latest_version(spark, f"{root}/registry")


@query(
    "stream_new_tools",  # T7
    O.sql("SELECT session_id, tool_name FROM seen", "seen"),
)
def stream_new_tools(spark, sf):
    root = work_dir(spark, "stream_new_tools")
    seen = L.new_tools(T.sightings(_event_stream(spark, sf))).select("session_id", "tool_name")
    _finish(L.start(seen.writeStream.format("parquet").option("path", f"{root}/seen"), f"{root}/checkpoint", once=True))
    return spark.read.parquet(f"{root}/seen")
