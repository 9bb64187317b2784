"""Table schemas and the closed value sets used in their string columns."""

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

HOST_TO_SERVER = "host_to_server"
SERVER_TO_HOST = "server_to_host"

REQUEST = "request"
RESPONSE = "response"
NOTIFICATION = "notification"
ERROR = "error"
KINDS = (REQUEST, RESPONSE, NOTIFICATION, ERROR)

DENY = "deny"
REQUIRE_APPROVAL = "require_approval"
AUDIT = "audit"

PENDING = "pending"
APPROVED = "approved"
DENIED = "denied"
TIMEOUT = "timeout"

FORWARDED = "forwarded"
BLOCKED = "blocked"
DROPPED = "dropped"

_TYPES = {
    "BIGINT": LongType(),
    "INT": IntegerType(),
    "STRING": StringType(),
    "BOOLEAN": BooleanType(),
    "TIMESTAMP": TimestampType(),
    "ARRAY<STRING>": ArrayType(StringType()),
}


def _table(columns: str) -> StructType:
    """A schema from `name TYPE, ...`; unlike DDL parsing it needs no running session."""
    pairs = (column.split() for column in columns.split(","))
    return StructType([StructField(name, _TYPES[kind]) for name, kind in pairs])


RAW_MESSAGES = _table(
    "seq BIGINT, ts TIMESTAMP, session_id STRING, direction STRING, payload STRING"
)

MESSAGES = _table(
    "id BIGINT, ts TIMESTAMP, session_id STRING, direction STRING, kind STRING, "
    "method STRING, msg_id STRING, payload STRING, size_bytes BIGINT, "
    "blocked BOOLEAN, audit BOOLEAN, scrub_count INT, matched_rules ARRAY<STRING>, "
    "tool_name STRING, policy_action STRING, policy_rule STRING, "
    "block_reason STRING, status STRING, tools_pruned INT"
)

SESSIONS = _table(
    "id STRING, started_at TIMESTAMP, ended_at TIMESTAMP, command STRING, "
    "args ARRAY<STRING>"
)

APPROVALS = _table(
    "id STRING, ts TIMESTAMP, session_id STRING, direction STRING, method STRING, "
    "tool_name STRING, rule_name STRING, payload STRING, decision STRING, "
    "decided_at TIMESTAMP"
)

# decision_seq is the arrival number of the decision; it makes "first" exact.
DECISIONS = _table(
    "approval_id STRING, decided_at TIMESTAMP, approved BOOLEAN, decision_seq BIGINT"
)

TOOL_REGISTRY = _table(
    "session_id STRING, tool_name STRING, description STRING, first_seen TIMESTAMP"
)

RULES = _table(
    "ord INT, name STRING, action STRING, methods ARRAY<STRING>, tools ARRAY<STRING>, "
    "direction STRING, patterns ARRAY<STRING>"
)

CUSTOM_PATTERNS = _table("ord INT, name STRING, pattern STRING, label STRING")
