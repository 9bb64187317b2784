import json

import pytest
from pyspark.sql import functions as F

from signalbox import schemas as S
from signalbox.operators import messages as P
from signalbox.operators import stats as Q
from signalbox.sources import capture, tables
from tests.helpers import H2S, S2H, at, call, raw


def log_table(spark, n=50):
    kinds = ["request", "response", "notification", "error"]
    rows = [
        (i, at(i), f"s{i % 3}", H2S if i % 2 else S2H, kinds[i % 4], "tools/call" if i % 4 == 0 else ("" if i % 4 == 1 else None), 10, i % 5 == 0, i % 2, i % 7 == 0)
        for i in range(n)
    ]
    return spark.createDataFrame(
        rows,
        "id bigint, ts timestamp, session_id string, direction string, kind string, method string, "
        "size_bytes bigint, blocked boolean, scrub_count int, audit boolean",
    )


def test_query_messages(spark):
    df = log_table(spark, 250)
    assert [r.id for r in Q.query_messages(df, limit=3).collect()] == [249, 248, 247]
    assert [r.id for r in Q.query_messages(df, limit=3, offset=2).collect()] == [247, 246, 245]
    assert len(Q.query_messages(df).collect()) == 200
    assert len(Q.query_messages(df, limit=-1, offset=-5).collect()) == 200
    assert len(Q.recent_feed(df).collect()) == 100
    some = Q.query_messages(df, "s0", H2S, kind="error", since=at(100)).collect()
    assert some and all(r.session_id == "s0" and r.kind == "error" and r.ts >= at(100) for r in some)
    assert Q.get_message(df, 7).id == 7
    with pytest.raises(LookupError):
        Q.get_message(df, 9999)


def test_stats(spark):
    df = log_table(spark, 40)
    assert tuple(Q.stats_totals(df).first()) == (40, 400, 8, 20, 6)
    assert tuple(Q.kind_counts(df).first()) == (10, 10, 10, 10)
    assert tuple(Q.stats_totals(df, "none").first()) == (0, 0, 0, 0, 0)
    assert [tuple(r) for r in Q.method_counts(df).collect()] == [("tools/call", 10)]
    row = Q.stats(df).first()
    assert row.method_counts == {"tools/call": 10} and row.approval_pending == 0
    assert Q.stats(df, "none").first().method_counts == {}
    per = {r.session_id: r.total_messages for r in Q.stats_by_session(df).collect()}
    assert per == {"s0": 14, "s1": 13, "s2": 13}
    many = spark.range(60).select(F.concat(F.lit("m"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("method"), F.lit("s").alias("session_id"))
    assert [r.method for r in Q.method_counts(many).collect()] == [f"m{i:02}" for i in range(20)]


def test_message_table_round_trip(spark, tmp_path):
    path = str(tmp_path / "messages")
    rows = P.to_log_rows(P.open_messages(raw(spark, [(H2S, call("a")), (S2H, '{"id":1,"result":1}', "s2", 90_000)])))
    rows = rows.withColumn("matched_rules", F.when(F.col("id") == 0, F.array(F.lit("r1"), F.lit('r"2'))))
    tables.write_messages(rows, path)
    old = rows.limit(1).select("id", "ts", "session_id", "direction", "kind", "method", "msg_id", "payload", "size_bytes")
    old.withColumn("date", F.to_date("ts")).write.mode("append").partitionBy("date").parquet(path)  # an older layout
    back = tables.read_messages(spark, path)
    assert back.drop("date").schema.simpleString() == S.MESSAGES.simpleString()
    got = sorted(back.collect(), key=lambda r: (r.id, r.matched_rules is None))
    assert [r.id for r in got] == [0, 0, 1]
    assert got[0].matched_rules == ["r1", 'r"2'] and got[0].tool_name == "a"
    assert got[1].blocked is False and got[1].scrub_count == 0 and got[1].matched_rules is None
    assert back.where(F.to_date("ts") == "2024-05-02").count() == 1
    recent = Q.query_messages(back, since="2024-05-02 00:00:00")
    assert [r.id for r in recent.collect()] == [1]
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
    assert [r.id for r in Q.find_message(back, 1, day="2024-05-02").collect()] == [1]
    compact = str(tmp_path / "compact")
    tables.compact_messages(spark, path, compact, ["2024-05-01"])
    assert sorted(r.id for r in tables.read_messages(spark, compact).collect()) == [0, 0]


def test_capture_and_rules(spark, tmp_path):
    folder = tmp_path / "cap" / "session_id=s1" / "direction=host_to_server"
    folder.mkdir(parents=True)
    (folder / "a.jsonl").write_bytes(b'{"id":1}\r\n\n   \n\r\n{"id":2}\nxxxxxxxxxxxxxxxxxxxx')
    df = capture.read_capture(spark, str(tmp_path / "cap"))
    got = sorted((r.payload, r.session_id, r.direction, r.oversize) for r in df.collect())
    assert [g[0] for g in got] == ["   ", "xxxxxxxxxxxxxxxxxxxx", '{"id":1}', '{"id":2}']
    assert got[0][1:] == ("s1", "host_to_server", False)
    marked = capture.clean_lines(spark.createDataFrame([("12345",), ("123456",)], "value string"), max_bytes=6)
    assert {r.payload: r.oversize for r in marked.collect()} == {"12345": False, "123456": True}
    env = tmp_path / "env.json"
    env.write_text(json.dumps({"seq": 1, "ts": "2024-05-01T12:00:00.5Z", "session_id": "s", "direction": H2S, "payload": call("a")}) + "\n")
    row = capture.read_envelopes(spark, str(env)).first()
    assert row.ts == at(0.5) and row.payload == call("a")
    rules = tmp_path / "rules.json"
    rules.write_text('{"ord":1,"name":"b","action":"deny","tools":["x"]}\n{"ord":0,"name":"a","action":"audit"}\n')
    table = capture.read_rules(spark, str(rules))
    from signalbox.operators.policy import Rule, read_rule_parts

    assert list(read_rule_parts(table, 5)) == [[Rule("a", "audit"), Rule("b", "deny", tools=("x",))]]
    (tmp_path / "pat.json").write_text('{"ord":0,"name":"n","pattern":"t_[0-9]+","label":"l"}\n')
    assert capture.read_custom_patterns(spark, str(tmp_path / "pat.json"))[0].pattern == "t_[0-9]+"


def test_policy_from_files(spark, tmp_path):
    from signalbox.functions.regex import PatternError
    from signalbox.operators.policy import CustomPattern, Policy, Rule

    rules, patterns = tmp_path / "rules.json", tmp_path / "patterns.json"
    rules.write_text('{"ord":2,"name":"b","action":"deny","patterns":["x+y"]}\n{"ord":1,"name":"a","action":"audit","direction":"host_to_server"}\n')
    patterns.write_text('{"ord":0,"name":"n","pattern":"t_[0-9]+","label":"l"}\n')
    wanted = (Rule("a", "audit", direction=H2S), Rule("b", "deny", patterns=("x+y",)))
    assert capture.read_policy(spark, str(rules)) == Policy(wanted)
    whole = capture.read_policy(spark, str(rules), str(patterns), scrub=True)
    assert whole == Policy(wanted, True, (CustomPattern("n", "t_[0-9]+", "l"),)) and whole.active_patterns()
    assert not capture.read_policy(spark, str(rules), str(patterns)).active_patterns()
    with pytest.raises(ValueError, match="more than 1 rules"):
        capture.read_policy(spark, str(rules), max_rules=1)
    rules.write_text('{"ord":1,"name":"bad one","action":"deny","patterns":["(open"]}\n')
    with pytest.raises(PatternError, match="bad one"):
        capture.read_policy(spark, str(rules))
    rules.write_text("")
    assert capture.read_policy(spark, str(rules)) == Policy()


def test_merges(spark):
    stored = spark.createDataFrame([("s1", at(5), None, "srv", ["-a"]), ("s3", at(1), at(2), "y", [])], S.SESSIONS)
    events = spark.createDataFrame([("s1", at(7), None, "later", ["-b"]), ("s1", None, at(9), None, None), ("s2", at(3), None, "x", [])], S.SESSIONS)
    got = {r.id: tuple(r) for r in tables.merge_sessions(stored, events).collect()}
    assert got["s1"] == ("s1", at(5), at(9), "srv", ["-a"]) and got["s3"][2] == at(2) and set(got) == {"s1", "s2", "s3"}
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, o int, v string")
    new = spark.createDataFrame([("a", 0, "n"), ("a", 3, "z"), ("c", 1, "w"), ("c", 2, "u")], "k string, o int, v string")
    assert {tuple(r) for r in tables.merge_latest(old, new, ["k"], ["o"]).collect()} == {("a", 3, "z"), ("b", 2, "y"), ("c", 2, "u")}
    assert {tuple(r) for r in tables.merge_first(old, new, ["k"], ["o"]).collect()} == {("a", 1, "x"), ("b", 2, "y"), ("c", 1, "w")}


def test_sessions_and_upserts(spark):
    rows = [("s1", at(0), None, "srv", ["-a"]), ("s1", None, at(9), None, None), ("s2", at(1), None, "x", [])]
    df = spark.createDataFrame(rows, S.SESSIONS)
    got = {r.id: tuple(r) for r in tables.sessions_from_events(df).collect()}
    assert got == {"s1": ("s1", at(0), at(9), "srv", ["-a"]), "s2": ("s2", at(1), None, "x", [])}
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, None)], "k string, o int, v string")
    assert {tuple(r) for r in tables.upsert_latest(df, ["k"], ["o"]).collect()} == {("a", 3, "z"), ("b", 1, None)}
    assert {tuple(r) for r in tables.register_first(df, ["k"], ["o"]).collect()} == {("a", 1, "x"), ("b", 1, None)}
