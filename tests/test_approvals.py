import random
from datetime import timedelta

from pyspark.sql import functions as F

from signalbox import schemas as S
from signalbox.operators import approvals as A
from signalbox.operators import messages as P
from signalbox.operators.numbering import numbered
from signalbox.operators.policy import Rule, enforce_policy
from tests.helpers import H2S, at, by_seq, call, raw

RULES = [Rule("hold", "require_approval", ("tools/call",), ("delete_file",)), Rule("no", "deny", tools=("run_shell",))]


def held(spark):
    rows = [(H2S, call("delete_file", i), "s1" if i < 3 else "s2", i * 100) for i in range(6)]
    rows += [(H2S, call("read_file"), "s1", 10), (H2S, call("run_shell"), "s1", 20)]
    return enforce_policy(P.open_messages(raw(spark, rows)), RULES)


def decide(spark, *rows):
    full = [(i, at(t), ok, n) for n, (i, t, ok) in enumerate(rows)]
    return spark.createDataFrame(full, S.DECISIONS)


def test_lifecycle(spark):
    messages = held(spark)
    requests = A.approval_requests(messages)
    assert {r.id for r in requests.collect()} == {"s1-0", "s1-1", "s1-2", "s2-3", "s2-4", "s2-5"}
    decisions = decide(
        spark,
        ("s1-0", 5, True),
        ("s1-0", 6, False),  # already resolved
        ("s1-1", 90, True),  # before the request
        ("s1-1", 130, False),
        ("s1-2", 261, True),  # too late
        ("s2-3", 360, True),  # at the deadline
        ("nobody", 10, True),
    )
    resolved = A.resolve_approvals(requests, decisions, timedelta(0))  # 0 means the default of 60 s
    got = by_seq(resolved, "decision", "decided_at")
    assert got == {
        0: ("approved", at(5)),
        1: ("denied", at(130)),
        2: ("timeout", at(260)),
        3: ("approved", at(360)),
        4: ("timeout", at(460)),
        5: ("timeout", at(560)),
    }
    out = by_seq(A.apply_approvals(messages, resolved), "status", "block_reason")
    assert out[0] == ("forwarded", None)
    assert out[1] == ("blocked", "denied by human review (rule: hold)")
    assert out[2] == ("blocked", "approval timed out (rule: hold)")
    assert out[6] == ("forwarded", None)
    assert out[7] == ("blocked", 'blocked by policy rule "no"')
    assert len(out) == 8
    bad = {r.decision_seq: r.error for r in A.rejected(requests, decisions, timedelta(0)).collect()}
    assert set(bad) == {1, 2, 4, 6}
    assert bad[6] == 'approval request "nobody" not found or already resolved'
    events = A.approval_events(requests, resolved).collect()
    assert sorted(e.type for e in events) == ["requested"] * 6 + ["resolved"] * 6
    assert all(e.decision == "pending" for e in events if e.type == "requested")
    pend = {r.id for r in A.pending_approvals(requests, decisions, at(330), timedelta(seconds=300)).collect()}
    assert pend == {"s1-2", "s2-3"} - {"s1-2"}  # s1-2 was approved at 261
    assert A.pending_count(requests, decisions, at(330), timedelta(seconds=300)).first()[0] == 1
    newest = [r.seq for r in A.approval_history(resolved).collect()]
    assert newest == [5, 4, 3, 2, 1, 0]
    assert [r.seq for r in A.approval_history(resolved, "s1").collect()] == [2, 1, 0]


def test_unresolved_messages_do_not_pass(spark):
    messages = held(spark)
    nothing = A.resolve_approvals(A.approval_requests(messages).limit(0), decide(spark, ("x", 1, True)))
    out = by_seq(A.apply_approvals(messages, nothing), "status", "block_reason")
    assert out[0] == ("blocked", "context cancelled while awaiting approval")


def test_numbering_matches_a_full_sort(spark):
    rng = random.Random(3)
    rows = [(i, at(rng.choice([0, 0.5, 1, 90_000, rng.randrange(400_000)])), rng.choice(["hot", "hot", "x", "y"])) for i in range(400)]
    df = spark.createDataFrame(rows, "seq bigint, ts timestamp, session_id string")
    for keys in ((), ("session_id",)):
        want, counts = {}, {}
        for seq, ts, session in sorted(rows, key=lambda r: (r[1], r[0])):
            group = session if keys else None
            counts[group] = counts.get(group, 0) + 1
            want[seq] = counts[group]
        assert by_seq(numbered(df, "n", "ts", "seq", keys=keys), "n") == want


def test_ids_in_submit_order(spark):
    messages = held(spark)
    ids = by_seq(A.approval_requests(messages, ids="global"), "id")
    assert [ids[i] for i in range(6)] == [f"apr-{i + 1}" for i in range(6)]
    ids = by_seq(A.approval_requests(messages, ids="session"), "id")
    assert [ids[i] for i in range(6)] == ["apr-1", "apr-2", "apr-3"] * 2


def test_rows_without_time_or_session(spark):
    rows = [(1, None, "a"), (2, at(1), None), (3, at(0), "a"), (4, None, None)]
    df = spark.createDataFrame(rows, "seq bigint, ts timestamp, session_id string")
    assert by_seq(numbered(df, "n", "ts", "seq"), "n") == {1: 1, 4: 2, 3: 3, 2: 4}
    assert set(by_seq(numbered(df, "n", "ts", "seq", keys=("session_id",)), "n")) == {1, 2, 3, 4}
    messages = held(spark).withColumn("session_id", F.lit(None).cast("string"))
    requests = A.approval_requests(messages, ids="global")
    made = requests.select(F.col("id").alias("approval_id"), F.col("ts").alias("decided_at"), F.lit(True).alias("approved"), F.col("seq").alias("decision_seq"))
    out = A.apply_approvals(messages, A.resolve_approvals(requests, made))
    held_back = out.where((F.col("policy_action") == "require_approval") & (F.col("status") == S.BLOCKED))
    assert held_back.count() == 0


def test_first_decision_over_slots(spark):
    """Many decisions on few ids, at and around the borders of slots, against a walk over all of them."""
    rnd = random.Random(8)
    timeout = timedelta(seconds=60)
    asked = {f"r{i}": at(rnd.choice([0, 30, 59.999999, 60, 60.000001, 90, 119.999999, 120])) for i in range(40)}
    made = [(f"r{rnd.randrange(44)}", at(rnd.choice([0, 30, 60, 90, 119.999999, 120, 149, 150, 180, 180.000001, 400])), rnd.random() < 0.5, n) for n in range(400)]
    made += [("r1", at(rnd.uniform(0, 5000)), True, 1000 + n) for n in range(3000)]
    requests = spark.createDataFrame([(i, ts) for i, ts in asked.items()] + [("none", None)], "id string, ts timestamp")
    decisions = spark.createDataFrame(made, S.DECISIONS)
    want = {}
    for i, ts in asked.items():
        able = sorted((d, seq, ok) for r, d, ok, seq in made if r == i and ts <= d <= ts + timeout)
        if able:
            want[i] = able[0]
    got = A.first_decisions(requests, decisions, timeout)
    assert {r.id: tuple(r["first"][c] for c in ("decided_at", "decision_seq", "approved")) for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and "sequence" in plan
    won = {(i, seq) for i, (_, seq, _) in want.items()}
    lost = {(r.approval_id, r.decision_seq) for r in A.rejected(requests, decisions, timeout).collect()}
    assert lost == {(r, seq) for r, _, _, seq in made} - won
