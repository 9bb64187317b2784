"""Common table expressions the check queries share."""

from __future__ import annotations

from signalbox.sources.traffic import TOOL_LISTING

_EV = """ev AS (SELECT event_id, ts, user_id, event_type, value, props,
  CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events)"""

_TRAFFIC = f"""traffic AS (SELECT event_id AS seq, event_id AS id, ts, CAST(user_id AS VARCHAR) AS session_id, k,
  value, props, event_type,
  CASE WHEN event_type IN ('click', 'error') THEN 'server_to_host' ELSE 'host_to_server' END AS direction,
  CASE event_type WHEN 'click' THEN 'response' WHEN 'error' THEN 'error'
    WHEN 'signup' THEN 'notification' ELSE 'request' END AS kind,
  CASE event_type WHEN 'view' THEN 'tools/list' WHEN 'purchase' THEN 'tools/call'
    WHEN 'signup' THEN 'notifications/initialized' END AS method,
  CASE WHEN event_type <> 'signup' THEN CAST(k AS VARCHAR) END AS msg_id,
  CASE WHEN event_type = 'purchase' THEN CASE WHEN value > 50 THEN 'delete_file' ELSE 'write_file' END END AS tool_name,
  CASE event_type
    WHEN 'view' THEN '{{"jsonrpc":"2.0","id":' || k || ',"method":"tools/list"}}'
    WHEN 'click' THEN '{{"jsonrpc":"2.0","id":' || k || ',"result":{{"tools":' ||
      replace('{TOOL_LISTING}', '%', CAST(k % 3 AS VARCHAR)) || ',"nextCursor":"c"}}}}'
    WHEN 'purchase' THEN '{{"jsonrpc":"2.0","id":' || k || ',"method":"tools/call","params":{{"name":"' ||
      CASE WHEN value > 50 THEN 'delete_file' ELSE 'write_file' END || '","arguments":' || props || '}}}}'
    WHEN 'signup' THEN '{{"jsonrpc":"2.0","method":"notifications/initialized"}}'
    ELSE '{{"jsonrpc":"2.0","id":' || k || ',"error":{{"code":-32603,"message":"internal error","data":' || props || '}}}}'
  END AS payload FROM ev)"""

_HITS = r"""hits AS (SELECT *,
  (coalesce(method, '') = 'tools/call' AND coalesce(tool_name, '') = 'delete_file'
    AND regexp_matches(payload, '"k": [0-9]\b')) AS h1,
  (coalesce(method, '') = 'tools/call' AND coalesce(tool_name, '') = 'delete_file') AS h2,
  (coalesce(method, '') = 'tools/call') AS h3,
  (direction = 'server_to_host' AND regexp_matches(payload, '-32603')
    AND regexp_matches(payload, '"k": \d*5\b')) AS h4,
  (coalesce(method, '') = 'tools/list') AS h5 FROM traffic)"""

_POLICY = """policy AS (SELECT *,
  nullif(concat_ws(',', CASE WHEN h1 THEN 'block-early-deletes' END, CASE WHEN h2 THEN 'review-deletes' END,
    CASE WHEN h3 THEN 'audit-calls' END, CASE WHEN h4 THEN 'watch-errors' END,
    CASE WHEN h5 THEN 'note-listings' END), '') AS rules,
  CASE WHEN h1 THEN 'deny' WHEN h2 THEN 'require_approval' WHEN h3 OR h4 THEN 'audit' END AS policy_action,
  CASE WHEN h1 THEN 'block-early-deletes' END AS deny_rule,
  CASE WHEN h2 AND NOT h1 THEN 'review-deletes' END AS approval_rule FROM hits)"""

_LOGGED = """logged AS (SELECT *, CAST(octet_length(encode(payload)) AS BIGINT) AS size_bytes,
  coalesce(policy_action = 'deny', FALSE) AS blocked,
  coalesce(policy_action = 'audit', FALSE) AS audit, CAST(0 AS BIGINT) AS scrub_count,
  CASE WHEN policy_action = 'deny' THEN 'blocked' ELSE 'forwarded' END AS status,
  coalesce(deny_rule, approval_rule) AS policy_rule,
  CASE WHEN policy_action = 'deny' THEN 'blocked by policy rule "' || deny_rule || '"' END AS block_reason
  FROM policy)"""

_CALLS = """calls AS (SELECT event_id AS id, ts, CAST(user_id AS VARCHAR) AS session_id, event_type AS tool_name FROM ev)"""

_SESSIONS = """sessions AS (SELECT CAST(user_id AS VARCHAR) AS id, min(ts) AS started_at, max(ts) AS ended_at
  FROM ev GROUP BY user_id)"""

_SEEN = """seen AS (SELECT session_id, tool_name, description, ts AS first_seen FROM (
  SELECT CAST(user_id AS VARCHAR) AS session_id, event_type AS tool_name, ts,
    event_type || CASE WHEN event_type = 'view' AND k % 2 = 1 THEN ' second' ELSE ' first' END AS description,
    row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM ev) WHERE rn = 1)"""

_REGISTRY = """registry AS (SELECT * FROM seen UNION ALL SELECT session_id, 'idle_tool',
  'a tool that is listed in every session but that no message ever calls', min(first_seen) FROM seen GROUP BY session_id)"""

_ANALYTICS = """analytics AS (SELECT r.tool_name, r.description, coalesce(u.call_count, 0) AS call_count,
  coalesce(u.sessions_used, 0) AS sessions_used, u.last_used
  FROM (SELECT DISTINCT tool_name, description FROM registry) r LEFT JOIN (
    SELECT tool_name, count(*) AS call_count, count(DISTINCT session_id) AS sessions_used, max(ts) AS last_used
    FROM calls WHERE tool_name IS NOT NULL AND tool_name <> '' GROUP BY tool_name) u ON r.tool_name = u.tool_name)"""

_REQUESTS = """requests AS (SELECT 'req-' || seq AS id, ts, session_id, direction, method, tool_name,
  policy_rule AS rule_name, payload, seq FROM logged WHERE policy_action = 'require_approval')"""

_DECISIONS = """decisions AS (SELECT 'req-' || (event_id - 1 - k % 3) AS approval_id, ts AS decided_at,
  k % 2 = 0 AS approved, event_id AS decision_seq FROM ev WHERE event_type = 'click')"""

_FIRST = """first AS (SELECT * FROM (SELECT r.id, d.decided_at, d.approved, d.decision_seq,
  row_number() OVER (PARTITION BY r.id ORDER BY d.decided_at, d.decision_seq) AS rn
  FROM requests r JOIN decisions d ON d.approval_id = r.id AND d.decided_at >= r.ts
    AND d.decided_at <= r.ts + INTERVAL 10 MINUTE) WHERE rn = 1)"""

_RESOLVED = """resolved AS (SELECT r.*, CASE WHEN f.approved THEN 'approved' WHEN f.id IS NOT NULL THEN 'denied'
  ELSE 'timeout' END AS decision, coalesce(f.decided_at, r.ts + INTERVAL 10 MINUTE) AS decided_at
  FROM requests r LEFT JOIN first f ON f.id = r.id)"""

_MATCHED = """matched AS (SELECT * FROM (SELECT *, lag(event_type) OVER w AS prev_type, lag(ts) OVER w AS request_ts,
  lag(seq) OVER w AS request_seq FROM traffic WHERE event_type IN ('view', 'click')
  WINDOW w AS (PARTITION BY session_id, k ORDER BY ts, seq))
  WHERE event_type = 'click' AND prev_type = 'view' AND ts - request_ts <= INTERVAL 7 DAY)"""

_TOOLS = """tools AS (SELECT m.session_id, m.seq, m.ts, m.k, t.pos, t.tool_name,
  replace(t.description, '%', CAST(m.k % 3 AS VARCHAR)) AS description,
  replace(t.text, '%', CAST(m.k % 3 AS VARCHAR)) AS text
  FROM matched m CROSS JOIN (VALUES
    (0, 'read_file', 'read v%', '{"name":"read_file","description":"read v%","inputSchema":{"type":"object","path":"p"}}'),
    (1, 'write_file', 'write v%', '{"name":"write_file","description":"write v%"}'),
    (2, 'delete_file', 'delete a file', '{"name":"delete_file","description":"delete a file"}'),
    (3, 'list_dir', '', '{"name":"list_dir"}'),
    (4, 'search', 'search v%', '{"name":"search","description":"search v%","limit":7}'),
    (5, 'run_shell', 'run a command', '{"name":"run_shell","description":"run a command"}')
  ) t(pos, tool_name, description, text))"""

_RECENT_USAGE = """recent_usage AS (SELECT tool_name, count(*) AS cnt FROM traffic
  WHERE tool_name IS NOT NULL AND session_id IN (SELECT id FROM sessions ORDER BY started_at DESC, id DESC LIMIT 40)
  GROUP BY tool_name)"""

_ALL_USAGE = """all_usage AS (SELECT tool_name, count(*) AS cnt FROM traffic WHERE tool_name IS NOT NULL GROUP BY tool_name)"""

_PRUNED_UNUSED = """pruned_unused AS (SELECT t.*, (t.tool_name = 'list_dir' OR coalesce(u.cnt, 0) > 0) AS keep
  FROM tools t LEFT JOIN recent_usage u ON u.tool_name = t.tool_name)"""

_PRUNED_TOP = """pruned_top AS (SELECT *, (tool_name = 'run_shell' OR rn <= 3) AS keep FROM (
  SELECT t.*, row_number() OVER (PARTITION BY t.session_id, t.seq
    ORDER BY CASE WHEN t.tool_name = 'run_shell' THEN 1 ELSE 0 END, coalesce(u.cnt, 0) DESC, t.pos) AS rn
  FROM tools t LEFT JOIN all_usage u ON u.tool_name = t.tool_name))"""

_CHAT = """chat AS (SELECT turn AS seq, CAST(conv_id AS VARCHAR) AS session_id, role, text,
  TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 SECOND * CAST(conv_id * 100 + turn AS BIGINT) AS ts,
  CASE WHEN role = 'assistant' THEN 'server_to_host' ELSE 'host_to_server' END AS direction FROM conversations)"""

_CTES = {
    "ev": (_EV, ()),
    "traffic": (_TRAFFIC, ("ev",)),
    "hits": (_HITS, ("traffic",)),
    "policy": (_POLICY, ("hits",)),
    "logged": (_LOGGED, ("policy",)),
    "calls": (_CALLS, ("ev",)),
    "sessions": (_SESSIONS, ("ev",)),
    "seen": (_SEEN, ("ev",)),
    "registry": (_REGISTRY, ("seen",)),
    "analytics": (_ANALYTICS, ("registry", "calls")),
    "requests": (_REQUESTS, ("logged",)),
    "decisions": (_DECISIONS, ("ev",)),
    "first": (_FIRST, ("requests", "decisions")),
    "resolved": (_RESOLVED, ("first",)),
    "matched": (_MATCHED, ("traffic",)),
    "tools": (_TOOLS, ("matched",)),
    "recent_usage": (_RECENT_USAGE, ("traffic", "sessions")),
    "all_usage": (_ALL_USAGE, ("traffic",)),
    "pruned_unused": (_PRUNED_UNUSED, ("tools", "recent_usage")),
    "pruned_top": (_PRUNED_TOP, ("tools", "all_usage")),
    "chat": (_CHAT, ()),
}

# The redaction patterns as a linear-time engine takes them.
PII = (
    ("api_key", "sk-[A-Za-z0-9_-]{20,}"),
    ("api_key", "ghp_[A-Za-z0-9]{36,}"),
    ("api_key", "gho_[A-Za-z0-9]{36,}"),
    ("api_key", "ghu_[A-Za-z0-9]{36,}"),
    ("api_key", "ghs_[A-Za-z0-9]{36,}"),
    ("api_key", "ghr_[A-Za-z0-9]{36,}"),
    ("api_key", "AKIA[0-9A-Z]{16}"),
    ("email", r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("ip_address", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
)
HEX_TOKEN = ("hex_token", r"\b[0-9a-f]{40}\b")


def sql(body: str, *needs: str) -> str:
    """`body` with the common table expressions it needs, and those they need."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for dep in _CTES[name][1]:
            add(dep)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        add(name)
    ctes = ",\n".join(_CTES[n][0] for n in ordered)
    return f"WITH {ctes}\n{body}" if ctes else body


def scrubbed(source: str, keys: str, text: str, patterns=PII) -> str:
    """CTEs t0, t1, ... that redact pattern by pattern; the last one is `scrubbed`.

    It has the keys, `text`, and n0, n1, ... with the matches per pattern.
    """
    parts = [f"t0 AS (SELECT {keys}, {text} AS text FROM {source})"]
    for i, (label, pattern) in enumerate(patterns):
        old = ", ".join(f"n{j}" for j in range(i))
        parts.append(
            f"t{i + 1} AS (SELECT {keys}{', ' + old if old else ''}, "
            f"CAST(len(regexp_extract_all(text, '{pattern}')) AS BIGINT) AS n{i}, "
            f"regexp_replace(text, '{pattern}', '[REDACTED:{label}]', 'g') AS text FROM t{i})"
        )
    parts.append(f"scrubbed AS (SELECT * FROM t{len(patterns)})")
    return ",\n".join(parts)


def total(patterns=PII) -> str:
    return " + ".join(f"n{i}" for i in range(len(patterns)))


def label_rows(keys: str, patterns=PII) -> str:
    """One row per label: the matches of its patterns, by `keys`."""
    return " UNION ALL ".join(
        f"SELECT {keys}'{label}' AS label, n{i} AS n FROM scrubbed" for i, (label, _) in enumerate(patterns)
    )
