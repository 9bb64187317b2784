import itertools
import time

import pytest
from pyspark.sql import functions as F

from signalbox.functions import deep
from signalbox.operators import messages as P
from signalbox.operators.policy import Rule, enforce_policy
from tests.helpers import H2S, S2H, by_seq, call, raw

FIELDS = {"method": '"m/x"', "id": "40", "error": '{"code":7}'}


def _kind(present):
    """The kind of a message by the fields it has: a method decides, then an error."""
    if "method" in present:
        return "request" if "id" in present else "notification"
    return "error" if "error" in present else "response"


#: Every presence of method, id and error.
GRID = [
    (
        "{" + ",".join(f'"{k}":{FIELDS[k]}' for k in present) + "}",
        False,
        _kind(present),
        "40" if "id" in present else None,
        "m/x" if "method" in present else None,
    )
    for n in range(4)
    for present in itertools.combinations(FIELDS, n)
]
CASES = [
    # payload, parse_error, kind, msg_id, method
    *GRID,
    ("{half a line", True, None, None, None),
    ('{"id":null,"method":"m"}', False, "request", "null", "m"),
    ('{"id":"1","method":"m"}', False, "request", '"1"', "m"),
    ('{"id":1.0,"method":"m"}', False, "request", "1", "m"),
    ('{"id":1,"error":null}', False, "response", "1", None),
    ('{"id":1,"method":"m","error":{"code":1,"message":"x"}}', False, "request", "1", "m"),
    ('{"id":1,"method":"a","method":"b"}', False, "request", "1", "b"),
    ('{"id":1,"method":5}', True, None, None, None),
    ('{"id":1,"method":null}', False, "response", "1", None),
    ('{"id":1,"method":""}', False, "response", "1", None),
    ('{"id":1,"error":"text"}', True, None, None, None),
    ('{"id":1,"error":{"code":1.5}}', True, None, None, None),
    ('{"id":1,"error":{"code":"1"}}', True, None, None, None),
    ('{"jsonrpc":2,"id":1}', True, None, None, None),
    ('[{"id":1}]', True, None, None, None),
    ("null", False, "response", None, None),
    ("7", True, None, None, None),
    ('{"id":1} x', True, None, None, None),
    ('{"id":1} {"id":2}', True, None, None, None),
    ('{"id":1},{"id":2}', True, None, None, None),
    ('{"id":1}] x', True, None, None, None),
    ('  {"id":1}\t', False, "response", "1", None),
    ("   ", True, None, None, None),
]


MORE = [
    ("{'id':1,'method':'tools/list'}", True, None, None, None),
    ('{"id":1,"result":NaN}', True, None, None, None),
    ('{"id":1,"result":-Infinity}', True, None, None, None),
    ('{"id":01}', True, None, None, None),
    ('{id:1}', True, None, None, None),
    ('{"id":1,}', True, None, None, None),
    ('{"id":1 "method":"m"}', True, None, None, None),
    ('{"id":"\\x"}', True, None, None, None),
    ('{"id":1}/* */', True, None, None, None),
    ('{"\\u0069d":5,"meth\\u006fd":"a\\"b"}', False, "request", "5", 'a"b'),
    ('{"id":"5","method":"m"}', False, "request", '"5"', "m"),
    ('{"id":"true","method":"m"}', False, "request", '"true"', "m"),
    ('{"id":true,"method":"m"}', False, "request", "true", "m"),
    ('{"id":[1,{"a":"]"}],"method":"m"}', False, "request", '[1,{"a":"]"}]', "m"),
    ('{"id":{},"method":"m"}', False, "request", "{}", "m"),
    ('{"id":1,"method":["m"]}', True, None, None, None),
    ('{"id":1,"error":[]}', True, None, None, None),
    ('{"id":1,"error":{"code":5},"error":{"message":"x"}}', False, "error", "1", None),
    ('{"id":1,"error":{"code":1.5},"error":null}', False, "response", "1", None),
    ('{"id":1,"error":{"message":["x"]}}', True, None, None, None),
    ('{"id":1,"error":{"data":{"code":"no"}}}', False, "error", "1", None),
    ('{"params":{"id":7,"method":"no"},"id":1}', False, "response", "1", None),
    ('{"id":1,"x":"a \\"id\\":2, {[","method":"m"}', False, "request", "1", "m"),
    ('{"id": "a, b:c" ,\n"method" : "m" }', False, "request", '"a, b:c"', "m"),
]


@pytest.mark.parametrize("levels", [0, 1500, 30_000])
def test_parse_and_kind(spark, levels):
    """The same at every depth: objects get a first member that the plain parser refuses."""
    cases = CASES + MORE
    nested = '{"deep":' + "[" * levels + "]" * levels

    def at_depth(text):
        at = text.find("{")
        if not levels or at < 0:
            return text
        rest = text[at + 1 :]
        return text[:at] + nested + ("," if rest.strip()[:1] != "}" else "") + rest

    df = P.classify_kind(P.parse_messages(raw(spark, [(H2S, at_depth(c[0])) for c in cases])))
    got = by_seq(df, "parse_error", "kind", "msg_id", "method")
    for i, case in enumerate(cases):
        assert got[i] == case[1:], case[0]


@pytest.mark.parametrize("levels", [1, 1500])
def test_listings_and_errors_at_any_depth(spark, levels):
    inner = "[" * levels + "]" * levels
    rows = [
        f'{{"id":1,"result":{{"deep":{inner},"tools":[{{"name":"a"}}]}}}}',
        f'{{"id":1,"result":{{"deep":{inner},"tools":{{"name":"a"}}}}}}',
        f'{{"id":1,"result":{{"tools":[],"deep":{inner}}},"result":{{}}}}',
        f'{{"id":1,"result":[{{"tools":[{inner}]}}]}}',
        f'{{"id":1,"method":"tools/call","params":{{"name":"x","name":"run","arguments":{inner}}}}}',
        f'{{"id":1,"method":"tools/call","params":{{"arguments":{{"name":"no","x":{inner}}}}}}}',
        f'{{"id":1,"method":"tools/call","params":[{{"name":{inner}}}]}}',
        f'{{"id":{"9" * 1200},"method":"tools/call","params":{{"name":"run"}}}}',
    ]
    got = by_seq(P.open_messages(raw(spark, [(S2H, r) for r in rows])), "lists_tools", "tool_name", "kind")
    assert [got[i] for i in range(len(rows))] == [
        (True, None, "response"), (False, None, "response"), (False, None, "response"), (False, None, "response"),
        (False, "run", "request"), (False, None, "request"), (False, None, "request"), (False, "run", "request"),
    ]
    ids = by_seq(P.parse_messages(raw(spark, [(S2H, rows[-1])])), "msg_id")
    assert ids[0] == "9" * 1200


DEEP = [
    ("[" * 1005 + "]" * 1005, True),
    ("[" * 5000 + "]" * 5000, True),
    ('{"a":' * 20_000 + "1" + "}" * 20_000, True),
    ("1" * 1200, True),
    ("[" * 1005 + "]" * 1004, False),
    ("[" * 5000 + "]" * 4999, False),
]


def test_size_is_no_way_past_the_policy(spark):
    rules = [Rule("no-jobs", "deny", ("tools/call",), ("start_job",))]
    rows = [(H2S, call("start_job", id_='"x"', args=args)) for args, _ in DEEP]
    rows += [(H2S, call("start_job", args="[" * n + "]" * n) + " x") for n in (1005, 5000)]
    rows += [(H2S, '{"method":5,"params":[' + "[" * 5000 + "]" * 5000 + "]}")]
    df = enforce_policy(P.open_messages(raw(spark, rows)), rules)
    got = by_seq(df, "parse_error", "status", "msg_id", "kind")
    for i, (_, valid) in enumerate(DEEP):
        assert got[i] == ((False, "blocked", '"x"', "request") if valid else (True, "forwarded", None, None)), i
    assert got[len(DEEP)][0] and got[len(DEEP) + 1][0]
    assert got[len(DEEP) + 2] == (True, "forwarded", None, None)


def test_tool_name(spark):
    payloads = [
        call("write_file"),
        '{"id":1,"method":"tools/call","params":{"arguments":{}}}',
        '{"id":1,"method":"tools/call"}',
        '{"id":1,"method":"tools/call","params":{"name":5}}',
        '{"id":1,"method":"tools/call","params":[1]}',
        '{"id":1,"method":"tools/call","params":{"name":""}}',
        '{"id":1,"method":"other","params":{"name":"x"}}',
    ]
    got = by_seq(P.tool_name(P.parse_messages(raw(spark, [(H2S, p) for p in payloads]))), "tool_name")
    assert [got[i] for i in range(len(payloads))] == ["write_file", None, None, None, None, None, None]


def test_error_fields(spark):
    p = '{"id":1,"error":{"code":-32600,"message":"bad","data":{"b":1,"a":[2]}}}'
    row = P.rpc_error_fields(P.parse_messages(raw(spark, [(S2H, p)]))).first()
    assert (row.error_code, row.error_message, row.error_data) == (-32600, "bad", '{"a":[2],"b":1}')


def test_log_rows_and_size(spark):
    df = P.open_messages(raw(spark, [(H2S, call("é")), (H2S, "junk")]))
    rows = P.to_log_rows(df).collect()
    assert len(rows) == 1  # unparsed lines are not logged
    row = rows[0]
    assert row.size_bytes == len(call("é").encode())
    assert (row.blocked, row.audit, row.scrub_count, row.matched_rules, row.policy_action) == (
        False, False, 0, None, None,
    )
    assert row.tool_name == "é"


def test_feed_view(spark):
    long = '{"id":1,"result":"' + "x" * 200 + '"}'
    df = P.to_log_rows(P.open_messages(raw(spark, [(S2H, long, "s1", 1.2345)])))
    df = df.withColumns({"blocked": F.lit(True), "scrub_count": F.lit(2)})
    row = P.feed_view(df).first()
    assert row.time == "12:00:01.234"
    assert row.preview == long[:80] + "..."
    assert (row.method, row.flags, row.direction_label) == ("-", "Blocked Scrubbed", "Server → Host")


def test_filters_do_not_multiply_the_parse(spark):
    df = P.open_messages(raw(spark, [(H2S, call("a"))])).where((F.col("kind") == "request") & (F.col("tool_name") == "a"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 3  # the payload; of one that is too deep the id and the envelope


def test_deep_levels_cost_little(spark):
    """What lies below the second level is passed over; what follows it, and brackets that open together, are read as ever."""
    n = 1_000_000
    texts = ['{"a":' + "[" * n + "]" * n + ',"params":{"x":[{"name":0}],"name":"t"},"id":[[7]]}', '{"params":{"name":"[{","x":{"name":1}}}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = df.select("i", F.expr(deep.fields("t", ("id", "params.name"))).alias("f")).select("i", "f.*")
    found.where("i = 1").collect()
    began = time.monotonic()
    got = [tuple(r)[1:] for r in sorted(found.collect())]
    assert time.monotonic() - began < 4  # 6.7 s when every token renewed the whole state, 1.8 s since
    assert got == [("[[7]]", '"t"'), (None, '"[{"')]
    lists = spark.createDataFrame([('[[{"a":1}],[[2]],3]',), ('[{"b":[1]},"[["]',)], "t string")
    assert [r[0] for r in lists.select(F.expr(deep.tool_list("t"))).collect()] == [['[{"a":1}]', "[[2]]", "3"], ['{"b":[1]}', '"[["']]
