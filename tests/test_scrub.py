import json

import pytest
from pyspark.sql import functions as F

from signalbox.operators import messages as P
from signalbox.operators import scrub as D
from signalbox.operators.policy import CustomPattern, Policy
from tests.helpers import H2S, S2H, by_seq, raw

KEY = "sk-" + "q7Zk2" * 6
TEXTS = [
    (f"key {KEY}.", "key [REDACTED:api_key].", 1),
    ("ghp_" + "Wd40x" * 8, "[REDACTED:api_key]", 1),
    ("AKIA" + "QX7R" * 4, "[REDACTED:api_key]", 1),
    ("write to nora@post.example.net today", "write to [REDACTED:email] today", 1),
    ("no 907-11-2468", "no [REDACTED:ssn]", 1),
    ("é907-11-2468", "é[REDACTED:ssn]", 1),
    ("x907-11-2468", "x907-11-2468", 0),
    ("node 172.20.4.9", "node [REDACTED:ip_address]", 1),
    ("1.2.3.4.5.6.7.8", "[REDACTED:ip_address].[REDACTED:ip_address]", 2),
    ("a@b.com.x@y.org", "[REDACTED:email][REDACTED:email]", 2),
    ("a@b@c.de f@g.h", "a@[REDACTED:email] f@g.h", 1),
    (f"{KEY} and li@lab.example.org", "[REDACTED:api_key] and [REDACTED:email]", 2),
    ("nothing here", "nothing here", 0),
]


def test_text(spark):
    df = spark.createDataFrame([(i, t[0]) for i, t in enumerate(TEXTS)], "seq bigint, text string")
    got = by_seq(D.scrub_text(df, "text"), "text", "scrub_count")
    for i, (_, want, n) in enumerate(TEXTS):
        assert got[i] == (want, n), TEXTS[i][0]
    again = D.scrub_text(D.scrub_text(df, "text").drop("scrub_count"), "text")
    assert all(n == 0 for n in by_seq(again, "scrub_count").values())


PAYLOADS = [
    # payload, expected payload, count
    ('{"email":"li@lab.example.org"}', '{"email":"[REDACTED:email]"}', 1),
    ('{"a@b.com": "x", "n": 1.50}', '{"a@b.com": "x", "n": 1.50}', 0),
    ('{"result":{"data":[{"secret":"%s"},["1.2.3.4",null,true]]}}' % KEY,
     '{"result":{"data":[{"secret":"[REDACTED:api_key]"},["[REDACTED:ip_address]",null,true]]}}', 2),
    ('{"t":"line\\nnora@post.example.net"}', '{"t":"line\\n[REDACTED:email]"}', 1),
    ('{"t":"nora\\u0040post.example.net"}', '{"t":"[REDACTED:email]"}', 1),
    ('{"t":"say \\"hi\\" to a@b.com", "big":12345678901234567890}',
     '{"t":"say \\"hi\\" to [REDACTED:email]", "big":12345678901234567890}', 1),
    ('{"ip": 1.2, "t":"no match"}', '{"ip": 1.2, "t":"no match"}', 0),
    ('plain text a@b.com 10.0.0.1', 'plain text [REDACTED:email] [REDACTED:ip_address]', 2),
    ('{"t":"a@b.com"} trailing', '{"t":"[REDACTED:email]"} trailing', 1),
    ('"a@b.com"', '"[REDACTED:email]"', 1),
]


def test_json(spark):
    df = spark.createDataFrame([(i, p[0]) for i, p in enumerate(PAYLOADS)], "seq bigint, payload string")
    got = by_seq(D.scrub_json(df), "payload", "scrub_count")
    for i, (payload, want, n) in enumerate(PAYLOADS):
        assert got[i] == (want, n), payload


def test_only_what_servers_send(spark):
    p = '{"id":6,"result":{"content":"Your key is sk-abcdefghij1234567890abcd"}}'
    df = P.open_messages(raw(spark, [(S2H, p), (H2S, p), (S2H, "junk a@b.com")]))
    got = by_seq(D.scrub_messages(df), "payload", "scrub_count")
    assert got[0] == ('{"id":6,"result":{"content":"Your key is [REDACTED:api_key]"}}', 1)
    assert got[1] == (p, 0)
    assert got[2] == ("junk a@b.com", 0)  # unparsed lines bypass the chain
    off = by_seq(D.scrub_messages(df, enabled=False), "payload", "scrub_count")
    assert off[0] == (p, 0)


def test_custom_patterns(spark):
    custom = (
        CustomPattern("t", "tok_[a-zA-Z0-9]{16}", "custom_token"),
        CustomPattern("bad", "[oops", "x"),
        CustomPattern("cash", r"^\d+ EUR$", "cost$1"),
    )
    rows = ['{"result":"token tok_abcdef1234567890"}', '{"result":"12 EUR"}', '{"result":"12 EUR x"}', '{"r":"tok\\u005fabcdef1234567890"}']
    df = spark.createDataFrame(list(enumerate(rows)), "seq bigint, payload string")
    got = by_seq(D.scrub_json(df, custom_patterns=custom), "payload", "scrub_count")
    assert got[0] == ('{"result":"token [REDACTED:custom_token]"}', 1)
    assert got[1] == ('{"result":"[REDACTED:cost$1]"}', 1)
    assert got[2] == (rows[2], 0)
    assert got[3] == ('{"r":"[REDACTED:custom_token]"}', 1)
    assert Policy(scrub=False, custom_patterns=custom).active_patterns() == ()


def test_large_strings(spark):
    """Long values cost neither stack nor quadratic time."""
    body = "x.y-" * 250_000 + " end a@b.com " + "\\n" * 100_000
    payload = '{"result":"' + body + '"}'
    df = spark.createDataFrame([(0, payload)], "seq bigint, payload string")
    row = D.scrub_json(df).first()
    assert row.scrub_count == 1
    assert json.loads(row.payload)["result"] == json.loads(payload)["result"].replace("a@b.com", "[REDACTED:email]")


def test_report(spark):
    rows = [(S2H, '{"id":1,"result":"a@b.com c@d.org 10.0.0.1"}', "s1"), (S2H, '{"id":1,"result":"%s"}' % KEY, "s2")]
    df = D.scrub_messages(P.open_messages(raw(spark, rows)), label_counts=True)
    got = {(r.session_id, r.label): r.redactions for r in D.pii_report(df, "session_id").collect()}
    assert got == {("s1", "email"): 2, ("s1", "ip_address"): 1, ("s2", "api_key"): 1}
    assert df.agg(F.sum("scrub_count")).first()[0] == 4


@pytest.mark.parametrize("n", [30])
def test_random_json_keeps_keys_and_shape(spark, n):
    import random

    rng = random.Random(5)
    words = ["a@b.com", "10.0.0.1", "plain", 'q"uote', "back\\slash", "nl\n", "ünï", KEY, "", " "]

    def value(depth):
        kind = rng.randrange(5 if depth else 2)
        if kind == 3:
            return {rng.choice(words) + str(i): value(depth - 1) for i in range(rng.randrange(4))}
        if kind == 4:
            return [value(depth - 1) for _ in range(rng.randrange(4))]
        return " ".join(rng.choices(words, k=3)) if kind else rng.choice([1, 2.5, None, True])

    docs = [value(4) for _ in range(n)]
    texts = [json.dumps(d, ensure_ascii=rng.random() < 0.5) for d in docs]
    df = spark.createDataFrame(list(enumerate(texts)), "seq bigint, payload string")

    def clean(v):
        if isinstance(v, str):
            return v.replace(KEY, "[REDACTED:api_key]").replace("a@b.com", "[REDACTED:email]").replace("10.0.0.1", "[REDACTED:ip_address]")
        if isinstance(v, dict):
            return {k: clean(x) for k, x in v.items()}
        return [clean(x) for x in v] if isinstance(v, list) else v

    for seq, text in by_seq(D.scrub_json(df), "payload").items():
        assert json.loads(text) == clean(docs[seq])


HARD = (CustomPattern("letters", r"[a-z]*[0-9]*[a-z]*Z", "run\\1"), CustomPattern("pairs", r"(?:ab|cd)+!", "pairs"))


def test_hard_custom_patterns_are_counted_and_replaced(spark):
    """What the backtracking matcher cannot be trusted with goes to the linear one, in plain text and in JSON values."""
    long = "ab" * 500_000
    texts = [f"x1yZ and abcd! {long}", "Z", "abab! cd! ab!", None, "nothing"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = {r.id: (r.t, r.scrub_count) for r in D.scrub_text(df, "t", HARD).collect()}
    run, pairs = "[REDACTED:run\\1]", "[REDACTED:pairs]"
    assert got == {0: (f"{run} and {pairs} {long}", 2), 1: (run, 1), 2: (f"{pairs} {pairs} {pairs}", 3), 3: (None, 0), 4: ("nothing", 0)}
    docs = [{"a": "x1yZ", "Z": ["abab!", {"n": 1, "s": long}]}, {"a": None, "b": "ok"}]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "id int, payload string")
    rows = {r.id: (json.loads(r.payload), r.scrub_count) for r in D.scrub_json(df, custom_patterns=HARD).collect()}
    assert rows == {0: ({"a": run, "Z": [pairs, {"n": 1, "s": long}]}, 2), 1: (docs[1], 0)}
