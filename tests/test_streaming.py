from datetime import timedelta

from pyspark.sql import functions as F

import pyarrow.parquet as pq

from signalbox import schemas as S
from signalbox.operators import approvals as A
from signalbox.operators import correlate as J
from signalbox.operators import messages as P
from signalbox.operators.policy import Policy, Rule
from signalbox.plans import catalog
from signalbox.plans.governed import screen
from signalbox.sources import tables
from signalbox.operators.tools import PruneConfig
from signalbox.plans.governed import govern
from signalbox.streaming import live as L
from signalbox.streaming.governed import GovernedStream, chain_input
from tests.helpers import H2S, S2H, at, by_seq, call, list_request, list_response, named, raw

POLICY = Policy((Rule("no", "deny", tools=("run_shell",)), Rule("au", "audit", ("tools/call",))), scrub=True)
EVENTS = "session_id string, msg_id string, ts timestamp, seq bigint, is_request boolean"


def feed(df, folder, n):
    """Add a file to the folder a stream watches."""
    df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/part={n}")


def source(spark, folder, schema):
    return spark.readStream.schema(schema).parquet(f"{folder}/part=*")


def test_log_equals_batch_across_restarts(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ckpt"))
    parts = [
        raw(spark, [(H2S, call("run_shell")), (S2H, '{"id":1,"result":"a@b.com"}')]),
        raw(spark, [(H2S, call("read"), "s2", 5), (H2S, "junk", "s2", 6)]).withColumn("seq", F.col("seq") + 10),
    ]
    for i, part in enumerate(parts):
        feed(part, src, i)
        rows = L.stream_messages(source(spark, src, S.RAW_MESSAGES), POLICY)
        L.append_messages(rows, out, ckpt, once=True).awaitTermination()
    got = {r.id: r for r in tables.read_messages(spark, out).drop("date").collect()}
    batch = P.to_log_rows(screen(parts[0].union(parts[1]), POLICY)).collect()
    assert {r.id: r for r in batch} == got and len(got) == 3
    assert got[0].blocked and got[1].scrub_count == 1 and got[10].audit


def test_fan_out_repeats_replace(spark, tmp_path):
    src = str(tmp_path / "src")
    feed(raw(spark, [(H2S, call("a")), (H2S, call("b"))]), src, 0)
    seen = []
    sinks = {
        "one": L.batch_table(str(tmp_path / "one")),
        "two": L.batch_table(str(tmp_path / "two"), lambda df: df.where("seq = 1")),
        "note": lambda df, n: seen.append((n, df.count())),
    }
    for ckpt in ("c1", "c2"):  # a second start from scratch delivers batch 0 again
        L.fan_out(source(spark, src, S.RAW_MESSAGES), sinks, str(tmp_path / ckpt), once=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "one")).count() == 2
    assert spark.read.parquet(str(tmp_path / "two")).count() == 1
    assert seen == [(0, 2), (0, 2)]


def test_pairing_over_batches(spark, tmp_path):
    """Out of order within the lateness, across batches, with a repeat after a failure."""
    ttl, late = timedelta(seconds=300), timedelta(seconds=60)
    pairing = L.ListPairing(str(tmp_path / "pairing"), ttl, late)
    batches = [
        [("s", "1", 0, 0, True), ("s", "2", 50, 1, True)],
        [("s", "2", 40, 2, False), ("s", "1", 100, 3, False)],  # 2@40 precedes its request: no match
        [("s", "2", 90, 4, False), ("s", "3", 130, 5, True)],
        [("s", "3", 500, 6, False), ("s", "4", 501, 7, True)],  # 3 has expired
        [("s", "9", 100, 8, True), ("s", "4", 505, 9, False)],  # 9 comes too late
        [("s", "5", 1200, 10, True), ("s", "5", 1201, 11, False)],
    ]
    rows = [(s, m, at(t), q, r) for b in batches for s, m, t, q, r in b]
    for n, b in enumerate(batches):
        df = spark.createDataFrame([(s, m, at(t), q, r) for s, m, t, q, r in b], EVENTS)
        pairing.take(df, n)
        if n == 2:
            pairing.take(df, n)
    got = by_seq(pairing.matches(spark).unionByName(pairing.pending(spark, len(batches) - 1)), "request_seq")
    on_time = spark.createDataFrame([r for r in rows if r[3] != 8], EVENTS)
    assert got == by_seq(J.match_events(on_time, ttl), "request_seq") == {3: 0, 4: 1, 9: 7, 11: 10}
    late_rows = spark.read.parquet(str(tmp_path / "pairing" / "late"))
    assert [r.seq for r in late_rows.collect()] == [8]


def test_pairing_as_a_stream(spark, tmp_path):
    src, ckpt = str(tmp_path / "src"), str(tmp_path / "ckpt")
    pairing = L.ListPairing(str(tmp_path / "pairing"))
    parts = [[(H2S, list_request(1), "s", 0)], [(S2H, list_response(named("a"), 1), "s", 5)], [(H2S, list_request(2), "s", 5000)]]
    for n, rows in enumerate(parts):
        feed(raw(spark, rows).withColumn("seq", F.lit(n).cast("bigint")), src, n)
        events = J.list_events(P.open_messages(source(spark, src, S.RAW_MESSAGES)))
        pairing.start(events, ckpt, once=True).awaitTermination()
    assert by_seq(pairing.matches(spark), "request_seq") == {1: 0}


def test_approvals_stream_equals_batch(spark, tmp_path):
    src, dec, out, ckpt = (str(tmp_path / n) for n in ("req", "dec", "out", "ckpt"))
    requests = spark.createDataFrame(
        [(f"r{i}", at(i * 10), "s", i) for i in range(6)] + [("end", at(9000), "s", 99)],
        "id string, ts timestamp, session_id string, seq bigint",
    )
    made = [("r0", 5, True), ("r0", 4, False), ("r1", 9, True), ("r2", 85, True), ("r3", 90, False), ("zz", 1, True), ("none", 9000, True)]
    decisions = spark.createDataFrame([(i, at(t), ok, n) for n, (i, t, ok) in enumerate(made)], S.DECISIONS)
    feed(requests, src, 0)
    feed(decisions, dec, 0)
    stream = L.resolve_stream(source(spark, src, requests.schema), source(spark, dec, S.DECISIONS))
    L.start(stream.writeStream.format("parquet").option("path", out), ckpt, once=True).awaitTermination()
    got = by_seq(spark.read.parquet(out), "decision", "decided_at")
    want = by_seq(A.resolve_approvals(requests, decisions), "decision", "decided_at")
    want.pop(99)  # still open: its deadline lies ahead of both streams
    assert got == want
    assert got[0] == ("denied", at(4)) and got[1] == ("timeout", at(70)) and got[2] == ("timeout", at(80))


def test_live_reports(spark, tmp_path):
    src = str(tmp_path / "src")
    feed(raw(spark, [(H2S, call("a"), "s1"), (H2S, call("a"), "s2"), (S2H, '{"id":1,"result":1}', "s1")]), src, 0)
    registry = spark.createDataFrame([("a", "d"), ("b", "e")], "tool_name string, description string")
    report = str(tmp_path / "report")
    messages = L.stream_messages(source(spark, src, S.RAW_MESSAGES), POLICY)
    sink = lambda df, n: df.write.mode("overwrite").parquet(report)
    L.live_tool_analytics(messages, registry, sink, str(tmp_path / "c"), once=True).awaitTermination()
    got = {r.tool_name: (r.call_count, r.sessions_used) for r in spark.read.parquet(report).collect()}
    assert got == {"a": (2, 2), "b": (0, 0)}


def test_registry_streams(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    schema = "session_id string, tool_name string, description string, ts timestamp, seq bigint, pos bigint"
    rows = [("s", "a", "second", at(2), 1, 0), ("s", "a", "first", at(1), 0, 0), ("t", "a", "other", at(9), 0, 0)]
    df = spark.createDataFrame(rows, schema)
    feed(df, src, 0)
    got = {}
    keep = lambda b, n: got.update({(r.session_id, r.tool_name): r.description for r in b.collect()})
    running = L.register_stream(source(spark, src, df.schema))
    L.start(running.writeStream.outputMode("update").foreachBatch(keep), str(tmp_path / "c"), once=True).awaitTermination()
    assert got == {("s", "a"): "first", ("t", "a"): "other"}
    for horizon in (None, timedelta(hours=1)):
        seen = L.new_tools(source(spark, src, df.schema), horizon).select("session_id", "tool_name")
        target = f"{out}-{horizon is None}"
        L.start(seen.writeStream.format("parquet").option("path", target), target + "-c", once=True).awaitTermination()
        assert spark.read.parquet(target).count() == 2


def test_open_at_end_does_not_fill_in_what_the_stream_lost(spark):
    rows = [("lost", 0), ("written", 0), ("open", 100), ("newest", 101), ("untimed", None)]
    at = "CASE WHEN m IS NOT NULL THEN TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(0, 0, m) END"
    requests = spark.createDataFrame(rows, "id string, m int").selectExpr("id", f"{at} AS ts")
    decisions = spark.createDataFrame([("other", 101, True, 1)], "approval_id string, m int, approved boolean, decision_seq long")
    decisions = decisions.selectExpr("approval_id", f"{at} AS decided_at", "approved", "decision_seq")
    rest = L.open_at_end(requests, decisions, requests.where("id = 'written'"))
    assert sorted(r.id for r in rest.collect()) == ["newest", "open", "untimed"]


def test_event_stream_has_every_event(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(50)
    untimed = events.withColumn("ts", F.when(F.col("event_id") % 5 > 0, F.col("ts")))
    for name, rows in {"some": untimed, "none": untimed.withColumn("ts", F.lit(None).cast(events.schema["ts"].dataType)), "empty": events.limit(0)}.items():
        rows.write.parquet(f"{tmp_path}/{name}/events.parquet")
        writer = catalog._event_stream(spark, f"{tmp_path}/{name}").writeStream.format("parquet").option("path", f"{tmp_path}/{name}/out")
        L.start(writer, f"{tmp_path}/{name}/checkpoint", once=True).awaitTermination()
        out = spark.read.schema("event_id long").parquet(f"{tmp_path}/{name}/out")
        want = spark.read.parquet(f"{tmp_path}/{name}/events.parquet")
        assert sorted(r.event_id for r in out.collect()) == sorted(r.event_id for r in want.collect())


REVIEWED = Policy((Rule("hold-lists", "require_approval", ("tools/list",)), Rule("hold", "require_approval", tools=("rm",)), Rule("no", "deny", tools=("run_shell",))), scrub=True)


def _chain_rows():
    """(arrival, row) of messages and (arrival, row) of decisions: decided, denied, timed out, late and repeated."""
    rows, made = [], []

    def add(arrival, seconds, direction, payload, session="s1"):
        rows.append((arrival, (len(rows), at(seconds), session, direction, payload)))
        return len(rows) - 1

    def decide(arrival, seq, seconds, approved, session="s1"):
        made.append((arrival, (f"{session}-{seq}", at(seconds), approved, len(made))))

    listing = list_response(named("a", "b", "c"))
    first = add(0, 0, H2S, list_request())
    add(0, 20, S2H, listing)  # its request is approved after it came
    decide(1, first, 30, True)
    denied = add(0, 5, H2S, list_request(2))
    add(1, 25, S2H, list_response(named("b", "d"), 2))  # its request is denied: no listing
    decide(1, denied, 24, False)
    decide(1, denied, 26, True)
    call_seq = add(1, 40, H2S, call("rm", 3))
    decide(2, call_seq, 101, True)  # after the deadline
    other = add(2, 35, H2S, call("rm", 4))  # out of order
    decide(2, other, 95, True)  # exactly at the deadline
    add(0, 1, H2S, call("run_shell", 5))
    add(1, 41, H2S, "no json")
    add(1, 50, S2H, '{"id":9,"result":"mail a@b.com"}')
    late_list = add(1, 60, H2S, list_request(6), "s2")
    decide(2, late_list, 61, True, "s2")
    add(2, 70, S2H, list_response(named("a", "x"), 6), "s2")
    add(2, 72, S2H, list_response(named("a", "x"), 6), "s2")  # its request is used up
    end = add(2, 400, H2S, list_request(7))
    add(2, 401, S2H, list_response(named("c"), 7))
    decide(2, end, 402, True)
    rows.append((1, (len(rows), None, "s1", H2S, call("rm", 8))))
    return rows, made


def test_governed_stream_equals_the_batch_chain(spark, tmp_path):
    rows, made = _chain_rows()
    usage = spark.createDataFrame([("a", 5), ("b", 1)], "tool_name string, cnt long")
    prune = PruneConfig(unused_sessions=1)
    raws = lambda n=None: spark.createDataFrame([r for a, r in rows if n in (None, a)], S.RAW_MESSAGES)
    decided = lambda n=None: spark.createDataFrame([d for a, d in made if n in (None, a)], S.DECISIONS)
    batch = govern(raws(), REVIEWED, decided(), timedelta(seconds=60), prune, usage, stage_dir=str(tmp_path / "batch"))
    root, src = str(tmp_path / "chain"), str(tmp_path / "src")

    def chain():
        return GovernedStream(root, REVIEWED, timedelta(seconds=60), prune, usage, lateness=timedelta(seconds=40))

    def flat(df, *cols):
        return sorted(repr([r[c] for c in cols]) for r in df.collect())

    columns = [f.name for f in S.MESSAGES]
    for n in range(3):
        inputs = chain_input(raws(n), decided(n))
        feed(inputs, src, n)
        chain().start(source(spark, src, inputs.schema), str(tmp_path / "ckpt"), once=True).awaitTermination()
        if n == 1:
            early = chain().messages(spark).count()
            chain().take(inputs, 1)  # a batch that is run again replaces itself
            assert chain().messages(spark).count() == early
            # What nothing holds is logged at once, the rest is not there yet.
            assert 0 < early < P.to_log_rows(screen(raws(0).union(raws(1)), REVIEWED)).count()
    chain().finish(spark)
    assert flat(chain().messages(spark), *columns) == flat(batch.messages, *columns)
    assert flat(chain().approvals(spark), "id", "decision", "decided_at") == flat(batch.approvals, "id", "decision", "decided_at")
    assert flat(chain().registry(spark), *(f.name for f in S.TOOL_REGISTRY)) == flat(batch.registry, *(f.name for f in S.TOOL_REGISTRY))
    assert flat(chain().replies(spark), "seq", "payload") == flat(batch.replies, "seq", "payload")
    assert {r.tools_pruned for r in batch.messages.collect()} == {1, None}
    assert {r.decision for r in batch.approvals.collect()} == {"approved", "denied", "timeout"}


def test_governed_stream_without_input(spark, tmp_path):
    chain = GovernedStream(str(tmp_path / "none"), REVIEWED)
    chain.finish(spark)
    assert chain.messages(spark).count() == chain.approvals(spark).count() == chain.registry(spark).count() == 0


def test_governed_stream_screens_a_file_in_many_tasks(spark, tmp_path):
    """A batch whose rows all come from one file is spread before it is parsed and screened."""
    rows = [(i, None, f"s{i % 5}", H2S, call("rm", i)) for i in range(200)]
    inputs = chain_input(spark.createDataFrame(rows, S.RAW_MESSAGES), spark.createDataFrame([], S.DECISIONS))
    inputs.coalesce(1).write.parquet(str(tmp_path / "src"))
    one = spark.read.schema(inputs.schema).parquet(str(tmp_path / "src"))
    root, conf = tmp_path / "chain", "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(conf, "true")
    spark.conf.set(conf, "false")  # 200 rows would be too few to share
    try:
        GovernedStream(str(root), REVIEWED).take(one, 0)
    finally:
        spark.conf.set(conf, before)
    assert len(list((root / "work/0/screened").glob("*.parquet"))) > 1
    assert spark.read.parquet(str(root / "work/0/screened")).count() == 200


def test_many_tasks_can_share_a_batch(spark, tmp_path, monkeypatch):
    """The file of a micro-batch comes in many row groups, not in one that a single task must read."""
    events = spark.range(600_000).selectExpr(
        "id AS event_id", "timestamp_seconds(1704067200 + id) AS ts", "id % 977 AS user_id", "'click' AS event_type", "rand(1) AS value", "concat('{\"k\": ', id % 100, '}') AS props"
    )
    events.write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(catalog, "work_dir", lambda spark, name: str(tmp_path / name))
    catalog._event_stream(spark, str(tmp_path))
    files = list((tmp_path / "event_files").glob("*.parquet"))
    assert len(files) == 3 and min(pq.ParquetFile(f).num_row_groups for f in files) > 1
