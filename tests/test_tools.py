import json
import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from signalbox.operators import correlate as J
from signalbox.operators import messages as P
from signalbox.operators import tools as U
from signalbox.operators.policy import Policy, Rule
from signalbox.plans.governed import first_session, govern
from signalbox.sources import tables
from tests.helpers import H2S, S2H, at, by_seq, call, list_request, list_response, named, raw


def matched(spark, rows, ttl=J.DEFAULT_TTL):
    return by_seq(J.correlate_lists(P.open_messages(raw(spark, rows)), ttl), "request_seq")


def test_pairing_rules(spark):
    ok = list_response(named("a"))
    err = '{"id":1,"error":{"code":1,"message":"x"}}'
    assert matched(spark, [(H2S, list_request()), (S2H, ok)]) == {1: 0}
    assert matched(spark, [(H2S, list_request()), (S2H, ok), (S2H, ok)]) == {1: 0}  # consumed
    assert matched(spark, [(H2S, list_request()), (H2S, list_request()), (S2H, ok)]) == {2: 1}  # replaced
    assert matched(spark, [(H2S, list_request()), (S2H, err), (S2H, ok)]) == {2: 0}  # errors do not consume
    assert matched(spark, [(H2S, list_request()), (S2H, list_response([], 99))]) == {}
    assert matched(spark, [(H2S, list_request('"1"')), (S2H, ok)]) == {}  # "1" is not 1
    assert matched(spark, [(S2H, list_request()), (S2H, ok)]) == {}  # wrong direction
    assert matched(spark, [(H2S, list_request(), "s1", 0), (S2H, ok, "s2", 1)]) == {}
    assert matched(spark, [(H2S, list_request(), "s1", 0), (S2H, ok, "s1", 300)]) == {1: 0}
    assert matched(spark, [(H2S, list_request(), "s1", 0), (S2H, ok, "s1", 300.1)]) == {}
    assert matched(spark, [(H2S, '{"method":"tools/list"}'), (S2H, '{"result":{}}')]) == {}


def brute(rows, ttl):
    pending, out = {}, {}
    for session, msg, ts, seq, is_request in sorted(rows, key=lambda r: (r[2], r[3])):
        if is_request:
            pending[session, msg] = (ts, seq)
        else:
            hit = pending.pop((session, msg), None)
            if hit and ts - hit[0] <= ttl:
                out[seq] = hit[1]
    return out


@pytest.mark.parametrize("ttl,span", [(300, 3000), (300, 200_000), (0.0001, 0.01), (0.000511, 0.01), (0.001, 0.02), (7 * 86400, 30 * 86400)])
def test_pairing_matches_brute_force(spark, ttl, span):
    """One key has a third of all rows; times collide and cross slots and blocks."""
    rng = random.Random(int(span))
    rows = []
    for seq in range(1500):
        session, msg = ("hot", "1") if rng.random() < 0.34 else (rng.choice("abc"), rng.choice("12"))
        seconds = rng.uniform(0, span) if rng.random() < 0.7 else rng.choice([0, ttl, span / 2, span])
        rows.append((session, msg, at(round(seconds, 6)), seq, rng.random() < 0.5))
    df = spark.createDataFrame(rows, "session_id string, msg_id string, ts timestamp, seq bigint, is_request boolean")
    assert by_seq(J.match_events(df, timedelta(seconds=ttl)), "request_seq") == brute(rows, timedelta(seconds=ttl))


def test_pairing_reads_its_events_once(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = P.open_messages(raw(spark, [(H2S, list_request()), (S2H, list_response(named("a")))]))
        plan = J.correlate_lists(df)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ReusedExchange") == 1 and plan.count("parseJson") == 3
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_extraction_and_registry(spark):
    odd = ['"s"', '{"name":5}', "null", '{"description":"no name"}', '{"name":"d","description":7}', '{"name":"n"}', "[1]"]
    rows = [
        (H2S, list_request(1)),
        (S2H, list_response(named("a", "b") + odd, 1)),
        (H2S, list_request(2)),
        (S2H, list_response(['{"name":"a","description":"later"}'], 2)),
        (H2S, list_request(3)),
        (S2H, '{"jsonrpc":"2.0","id":3,"result":"not-an-object"}'),
        (H2S, list_request(4)),
        (S2H, '{"jsonrpc":"2.0","id":4,"result":{"tools":{"a":1}}}'),
    ]
    tools = U.extract_tools(J.list_responses(P.open_messages(raw(spark, rows))))
    got = {(r.seq, r.tool_name, r.description) for r in tools.collect()}
    assert got == {(1, "a", "a tool"), (1, "b", "b tool"), (1, "", ""), (1, "", "no name"), (1, "n", ""), (3, "a", "later")}
    registry = {r.tool_name: (r.description, r.first_seen) for r in tables.register_tools(tools).collect()}
    assert registry == {"a": ("a tool", at(1)), "b": ("b tool", at(1)), "": ("", at(1)), "n": ("", at(1))}


A, B, C, D = "read_file", "write_file", "delete_file", "d"
PRUNING = [
    # tools, usage, config, kept
    ([A, B, C], {A: 5}, U.PruneConfig(3), [A]),
    ([A, B, C], {A: 5}, U.PruneConfig(3, 0, (C,)), [A, C]),
    (["a", "b", "c", "d"], dict(a=10, b=5, c=3, d=1), U.PruneConfig(0, 2), ["a", "b"]),
    (["a", "b", "c", "d"], dict(a=10, b=5, c=3, d=1), U.PruneConfig(0, 1, ("d",)), ["a", "d"]),
    (["a", "b", "c"], {}, U.PruneConfig(3), []),
    (["a", "b", "c"], {}, U.PruneConfig(0, 2), ["a", "b"]),
    (["a", "b", "a", "c"], dict(a=1, b=3, c=2), U.PruneConfig(0, 2), ["b", "c"]),
    (["a", "b", "a", "c"], dict(a=3, b=2, c=1), U.PruneConfig(0, 1), ["a", "a"]),
    (["a", "b"], {}, U.PruneConfig(), ["a", "b"]),
    (["a", "b", "c", "d"], dict(a=1, b=2), U.PruneConfig(2, 1), ["b"]),
]


@pytest.mark.parametrize("tools,usage,config,kept", PRUNING)
def test_pruning(spark, tools, usage, config, kept):
    rows = [(H2S, list_request()), (S2H, list_response(named(*tools)))]
    listings = J.list_responses(P.open_messages(raw(spark, rows)))
    counts = spark.createDataFrame(list(usage.items()), "tool_name string, cnt bigint")
    marks = U.prune_tools(U.tool_entries(listings), counts, config)
    assert [r.tool_name for r in marks.where("keep").orderBy("pos").collect()] == kept
    row = U.rebuild_list_responses(listings, marks).first()
    if len(kept) == len(tools):
        assert (row.payload, row.tools_pruned) == (rows[1][1], None)
    else:
        result = json.loads(row.payload)["result"]
        assert [t["name"] for t in result["tools"] or []] == kept
        assert result["nextCursor"] == "abc" and row.tools_pruned == len(tools) - len(kept)
        assert kept or '"tools":null' in row.payload


def test_rebuilding_keeps_texts(spark):
    odd = ['"s"', "7", '{"name":"gone"}', '{"name":5,"z":1}', '{"name":"read_file","inputSchema":{"z":{"y":[1,2]},"a":"é\\"<"}}', "null"]
    payload = '{"jsonrpc":"2.0","id":"x","result":{"tools":[%s],"a":{"q":1},"z":null}}' % ",".join(odd)
    listings = J.list_responses(P.open_messages(raw(spark, [(H2S, list_request('"x"')), (S2H, payload)])))
    usage = spark.createDataFrame([("read_file", 1)], "tool_name string, cnt bigint")
    marks = U.prune_tools(U.tool_entries(listings), usage, U.PruneConfig(3))
    row = U.rebuild_list_responses(listings, marks).first()
    # what does not decode comes first; the null entry has an empty, unused name
    assert row.payload == (
        '{"jsonrpc":"2.0","id":"x","result":{"a":{"q":1},"tools":["s",7,{"name":5,"z":1},'
        '{"name":"read_file","inputSchema":{"z":{"y":[1,2]},"a":"é\\"<"}}],"z":null}}'
    )
    assert row.tools_pruned == 2


def test_analytics(spark):
    registry = spark.createDataFrame(
        [("s1", A, "one", at(0)), ("s2", A, "two", at(1)), ("s1", B, "w", at(0)), ("s2", C, "x" * 70, at(0))],
        "session_id string, tool_name string, description string, first_seen timestamp",
    )
    messages = spark.createDataFrame(
        [("s1", A, at(1)), ("s2", A, at(2)), ("s9", B, at(3)), ("s1", "", at(4)), ("s1", None, at(5))],
        "session_id string, tool_name string, ts timestamp",
    )
    rows = [tuple(r) for r in U.tool_analytics(registry, messages).collect()]
    assert rows == [
        (A, "one", 2, 2, at(2)), (A, "two", 2, 2, at(2)), (B, "w", 1, 1, at(3)), (C, "x" * 70, 0, 0, None),
    ]
    assert [r[0] for r in U.tool_analytics(registry, messages, "s1").collect()] == [A, B]
    analytics = U.tool_analytics(registry, messages)
    assert tuple(U.tool_summary(analytics).first()) == (4, 3, 0)
    status = {r.tool_name: (r.status, r.last_used, len(r.description)) for r in U.tool_status(analytics).collect()}
    assert status[C] == ("unused", "never", 63) and status[B][0] == "active"
    sessions = spark.createDataFrame([("s1", at(0)), ("s2", at(9)), ("s3", at(9))], "id string, started_at timestamp")

    def counts(n):
        return {r.tool_name: r.cnt for r in U.tool_usage_counts(messages, sessions, n).collect()}

    assert counts(0) == {A: 2, B: 1}  # s9 is no known session: counted only when not scoped
    assert counts(2) == {A: 1} and counts(3) == {A: 2} and counts(1) == {}


def test_whole_chain(spark):
    secret = '{"jsonrpc":"2.0","id":5,"result":{"content":"write to a@b.com"}}'
    tools = named(A, B) + ['{"name":"mail","description":"asks a@b.com"}']
    rows = [
        (H2S, list_request(1), "s1", 0), (S2H, list_response(tools, 1), "s1", 1),
        (H2S, call(A, 2), "s1", 2), (H2S, call(C, 3), "s1", 3), (H2S, call("run_shell", 4), "s1", 4),
        (S2H, secret, "s1", 5), (H2S, "junk", "s1", 6), (H2S, '{"method":"n"}', "s1", 7),
    ]
    policy = Policy((Rule("sh", "deny", tools=("run_shell",)), Rule("del", "require_approval", tools=(C,)), Rule("au", "audit", ("tools/call",))), scrub=True)
    decisions = spark.createDataFrame([("s1-3", at(10), True, 0)], "approval_id string, decided_at timestamp, approved boolean, decision_seq bigint")
    usage = spark.createDataFrame([(A, 3)], "tool_name string, cnt bigint")
    out = govern(raw(spark, rows), policy, decisions, prune=U.PruneConfig(1), usage=usage)
    log = {r.id: r for r in out.messages.collect()}
    assert set(log) == set(range(8)) - {6}
    assert json.loads(log[1].payload)["result"]["tools"] == json.loads(f"[{tools[0]}]")
    assert log[1].tools_pruned == 2 and log[1].scrub_count == 1
    assert log[1].size_bytes == len(log[1].payload)
    assert log[2].audit and not log[2].blocked
    assert log[3].status == "forwarded" and log[3].policy_action == "require_approval"
    assert log[4].blocked and log[4].block_reason == 'blocked by policy rule "sh"'
    assert "[REDACTED:email]" in log[5].payload
    # neither the registry nor the rebuilt listing leaks what was redacted
    assert {r.tool_name: r.description for r in out.registry.collect()}["mail"] == "asks [REDACTED:email]"
    assert out.outcomes.count() == len(rows)
    assert out.outcomes.where(F.col("payload") == "junk").first().status == "forwarded"
    assert out.replies.count() == 1
    first = first_session(spark.createDataFrame([("s1", at(0)), ("s2", at(5))], "id string, started_at timestamp"))
    spared = govern(raw(spark, rows), policy, decisions, prune=U.PruneConfig(1), usage=usage, protected_sessions=first)
    assert spared.messages.where("tools_pruned > 0").count() == 0


def test_short_ttl_at_every_offset(spark):
    from datetime import timedelta

    rows = [(f"s{i}", "1", at(i * 0.000031 + d), d > 0, i * 2 + (d > 0)) for i in range(17) for d in (0, 0.0005)]
    df = spark.createDataFrame([(s, m, t, not late, q) for s, m, t, late, q in rows], "session_id string, msg_id string, ts timestamp, is_request boolean, seq bigint")
    assert J.match_events(df, timedelta(microseconds=511)).count() == 17


@pytest.mark.parametrize("levels", [1, 1500])
def test_listings_of_any_depth(spark, levels):
    """Entries register and are pruned alike where the plain parser refuses the listing or one entry of it."""
    inner = "[" * levels + "]" * levels
    entries = [
        f'{{"name":"a","description":"A","inputSchema":{inner}}}',
        '{"name":"b","description":"B \\"x\\", [y]"}',
        f'{{"inputSchema":{inner},"description":5,"name":"c"}}',
        f"{inner}",
        '"text, with {"',
        '{"name":"\\u0064","description":null}',
    ]
    payload = f'{{"id":"7","result":{{"z":1,"tools":[{", ".join(entries)}],"a":{inner},"z":{{"k":2}}}}}}'
    df = raw(spark, [(H2S, list_request('"7"')), (S2H, payload)])
    listings = J.list_responses(P.open_messages(df))
    got = sorted((r.pos, r.tool_name, r.description) for r in U.extract_tools(listings).collect())
    assert got == [(0, "a", "A"), (1, "b", 'B "x", [y]'), (5, "d", "")]
    usage = spark.createDataFrame([("b", 3), ("c", 1)], "tool_name string, cnt long")
    marks = U.prune_tools(U.tool_entries(listings), usage, U.PruneConfig(unused_sessions=1))
    row = U.rebuild_list_responses(listings, marks).first()
    assert row.tools_pruned == 2
    kept = [inner, '"text, with {"', entries[1], entries[2]]
    assert row.payload == f'{{"jsonrpc":"2.0","id":"7","result":{{"a":{inner},"tools":[{",".join(kept)}],"z":{{"k":2}}}}}}'
