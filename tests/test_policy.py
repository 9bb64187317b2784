import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalbox import schemas as S
from signalbox.functions.regex import PatternError, checked, needs_linear_matcher, required_literals, to_java
from signalbox.operators import chain as C
from signalbox.operators import messages as P
from signalbox.operators import policy as R
from signalbox.operators import rule_join
from signalbox.operators.policy import Rule
from signalbox.operators.rule_index import RuleIndex
from tests.helpers import H2S, S2H, by_seq, call, list_request, raw

def evaluated(spark, rules, rows, **kw):
    df = P.open_messages(raw(spark, rows))
    return by_seq(R.evaluate_policy(df, rules), "policy_action", "matched_rules", "deny_rule", "approval_rule")


def _meets(rule, direction, method, tool, payload):
    """What a rule means, said anew: all of its set parts hold."""
    return (
        rule.direction in ("", direction)
        and (not rule.methods or (method or "") in rule.methods)
        and (not rule.tools or tool in rule.tools)
        and all(re.search(p, payload) for p in rule.patterns)
    )


def _decided(rules):
    denied = next((i for i, r in enumerate(rules) if r.action == "deny"), None)
    held = [r.name for r in rules[:denied] if r.action == "require_approval"]
    actions = {r.action for r in rules}
    action = next((a for a in ("deny", "require_approval", "audit") if a in actions), None)
    return action, [r.name for r in rules] or None, None if denied is None else rules[denied].name, held[-1] if held else None


def _random_rules(rnd, n):
    words = ["alpha", "be.ta", "ga(m)", '"k": 1', '"k": 17', "é"]
    pattern = lambda: rnd.choice([re.escape(rnd.choice(words)), rnd.choice(words[:1]) + r"\d*", r"(?:be|ga)", r"\d{3}", "a?lph", r"k\": 1\b", "(?i)ALPHA", "x|alpha"])
    some = lambda values, most: tuple(rnd.sample(values, rnd.randint(0, most)))
    return [
        Rule(
            f"r{i}",
            rnd.choice(["deny", "require_approval", "audit", "other"]),
            some(["tools/call", "tools/list", ""], 2),
            some(["t1", "t2", "t3"], 2),
            rnd.choice(["", "", H2S, S2H]),
            tuple(pattern() for _ in range(rnd.randint(0, 2))),
        )
        for i in range(n)
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_rules_mean_what_they_say(spark, seed):
    """Random rules in both forms against their meaning; the table in parts, with and without the automaton."""
    rnd = random.Random(seed)
    rules = _random_rules(rnd, 60)
    texts = ["alpha1", "be.ta ga(m)", '{\\"k\\": 17}', '\\"k\\": 1 123', "é", "ALPHA", "none"]
    rows = [(rnd.choice([H2S, S2H]), call(rnd.choice(["t1", "t2", "t4", ""]), args=f'"{rnd.choice(texts)}"')) for _ in range(40)]
    rows += [(H2S, list_request()), (S2H, '{"id":1,"result":"alpha"}'), (S2H, "no json alpha")]
    df = P.open_messages(raw(spark, rows))
    known = {r.seq: r for r in df.collect()}
    want = {
        i: (None, None, None, None) if m.parse_error else _decided([r for r in rules if _meets(r, m.direction, m.method, m.tool_name, m.payload)])
        for i, m in known.items()
    }
    columns = ("policy_action", "matched_rules", "deny_rule", "approval_rule")
    assert by_seq(R.evaluate_policy(df, rules), *columns) == want
    listed = [(o, r.name, r.action, list(r.methods), list(r.tools), r.direction, list(r.patterns)) for o, r in enumerate(rules)]
    table = spark.createDataFrame(listed, S.RULES)
    for size in (1000, 25):
        assert by_seq(R.evaluate_policy_table(df, table, part_rules=size), *columns) == want, size
    index = RuleIndex([(r.direction, r.methods, r.tools, r.patterns) for r in rules])
    match = index.matcher()
    one_by_one = {i: match(m.direction, m.method, m.tool_name, m.payload) for i, m in known.items()}
    assert max(map(len, one_by_one.values())) < len(rules) / 2
    for i, m in known.items():
        hits = {n for n, r in enumerate(rules) if _meets(r, m.direction, m.method, m.tool_name, m.payload)}
        assert hits <= set(one_by_one[i]) and one_by_one[i] == sorted(set(one_by_one[i]))


def test_a_long_rule_table_stays_off_the_driver(spark, monkeypatch):
    """Beyond `part_rules` no rule is read to the driver; slow patterns, copies of messages and rules, and nulls count as ever."""
    rows = [(H2S, call(f"t{i % 2}", args=f'"k {i % 7} aaZ"')) for i in range(30)] + [(H2S, None), (S2H, '{"id":1}')]
    rules = [(i % 9, f"r{i}", ("deny", "audit", "require_approval", None)[i % 4], ["tools/call"][: i % 2], ["t1", "t0", "t0"][: i % 4], "", [rf"k\s{i % 9}\b"]) for i in range(36)]
    rules += [(None, "slow", "audit", None, None, None, [r".*Z", "aa"]), (5, "twice", "audit", [], [], H2S, []), (5, "twice", "audit", [], [], H2S, [])]
    table = spark.createDataFrame(rules, S.RULES)
    df = P.open_messages(raw(spark, rows))
    df = df.unionByName(df.withColumn("seq", F.col("seq") + 100))
    columns = ("policy_action", "matched_rules", "deny_rule", "approval_rule")
    want = by_seq(R.evaluate_policy_table(df, table), *columns)
    assert sum(len(w[1] or []) for w in want.values()) > 200
    monkeypatch.setattr(R, "read_rule_parts", None)
    assert by_seq(R.evaluate_policy_table(df, table, part_rules=5), *columns) == want


def test_literals_are_found_in_texts():
    """Against plain search, over window borders."""
    rnd = random.Random(5)
    texts = ["".join(rnd.choices("abé", k=n)).encode() for n in (0, 50, 3, 0, 400, 1)]
    literals = {"a".encode(), "bab".encode(), "é".encode(), "aaba".encode(), "éa".encode()}
    known = {rule_join._literal_hash(t): t for t in literals}
    bitmap = np.zeros(1 << 10, np.uint64)
    for h in known:
        bit = h & (len(bitmap) * 64 - 1)
        bitmap[bit >> 6] |= np.uint64(1 << (bit & 63))
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    want = {(i, lit) for i, t in enumerate(texts) for lit in literals if lit in t}
    for window in (7, 1 << 20):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(rule_join, "_WINDOW", window)
            owner, hashes = rule_join.found_literals(np.frombuffer(b"".join(texts), np.uint8), offsets, sorted({len(t) for t in literals}), bitmap)
        found = [(int(i), known[int(h)]) for i, h in zip(owner, hashes) if int(h) in known]
        assert len(found) == len(set(found)) and set(found) == want


def test_required_literals():
    cases = {
        "abc": ["abc"], "ab?c": ["a", "c"], "ab+c": ["ab", "c"], "a|b": [], "(a|b)cd": ["cd"], "(?i)ab": [], r"\.pem$": [".pem"], "ab{0,2}": ["a"],
        r"\Qa.b\E+c": ["a.b", "c"], "[ab]cd.e": ["cd", "e"], "": [], r"\bkey\b": ["key"], r"a\dbc": ["a", "bc"], "x*": [], "(?:ab)?cd": ["cd"],
    }
    assert {p: required_literals(p) for p in cases} == cases


def test_many_patterns_are_compiled_at_once(spark):
    good = [rf"k{i}\b" for i in range(40)]
    assert checked(spark, good) == [to_java(p) for p in good]
    rules = [Rule(f"r{i}", "audit", patterns=(p,)) for i, p in enumerate([*good, "(unclosed"])]
    table = spark.createDataFrame([(i, r.name, r.action, [], [], "", list(r.patterns)) for i, r in enumerate(rules)], S.RULES)
    with pytest.raises(PatternError, match="r40"):
        R.evaluate_policy_table(P.open_messages(raw(spark, [(H2S, call("t"))])), table)


ORDERINGS = [
    [("a", "audit"), ("r", "require_approval"), ("d", "deny")],
    [("d1", "deny"), ("r", "require_approval"), ("d2", "deny")],
    [("r1", "require_approval"), ("r2", "require_approval"), ("a", "audit")],
    [("x", "mystery")],
    [("r1", "require_approval"), ("d", "deny"), ("r2", "require_approval")],
    [],
]
EXPECTED = [
    ("deny", ["a", "r", "d"], "d", "r"),
    ("deny", ["d1", "r", "d2"], "d1", None),
    ("require_approval", ["r1", "r2", "a"], None, "r2"),
    (None, ["x"], None, None),
    ("deny", ["r1", "d", "r2"], "d", "r1"),
    (None, None, None, None),
]


@pytest.mark.parametrize("i", range(len(ORDERINGS)))
def test_precedence_in_both_forms(spark, i):
    rules = [Rule(n, a) for n, a in ORDERINGS[i]]
    assert evaluated(spark, rules, [(H2S, call("t"))])[0] == EXPECTED[i]
    table = spark.createDataFrame(
        [(o, r.name, r.action, [], None, None, []) for o, r in enumerate(rules)], S.RULES
    )
    df = P.open_messages(raw(spark, [(H2S, call("t"))]))
    for size in (1, 2, 1000):
        out = R.evaluate_policy_table(df, table, part_rules=size)
        got = by_seq(out, "policy_action", "matched_rules", "deny_rule", "approval_rule")
        assert got[0] == EXPECTED[i], size


def test_one_rule_table_one_answer(spark):
    """Equal `ord` and a NULL name give the same result wherever a part ends."""
    rows = [(1, "c", "audit"), (2, "e", "deny"), (2, "d", "audit"), (2, None, "deny"), (3, "z", "require_approval")]
    table = spark.createDataFrame([(o, n, a, [], None, None, []) for o, n, a in rows], S.RULES).repartition(3)
    df = P.open_messages(raw(spark, [(H2S, call("t"))]))
    for size in (1, 2, 3, 5, 1000):
        got = by_seq(R.evaluate_policy_table(df, table, part_rules=size), "policy_action", "matched_rules", "deny_rule", "approval_rule")
        assert got[0] == ("deny", ["c", "", "d", "e", "z"], "", None), size


def test_direction_method_and_tool(spark):
    rules = [
        Rule("dir", "audit", direction=S2H),
        Rule("tool", "audit", tools=("read_file",)),
        Rule("quote", "audit", patterns=("it's \\\\ \"x\"",)),
        Rule("all", "audit", patterns=("alpha", "beta")),
    ]
    rows = [
        (S2H, '{"id":1,"result":"alpha only"}'),
        (H2S, '{"id":1,"method":"m","params":{"name":"read_file"}}'),
        (H2S, '{"id":1,"method":"m","params":"beta alpha"}'),
    ]
    got = evaluated(spark, rules, rows)
    assert [got[i][1] for i in range(3)] == [["dir"], None, ["all"]]
    # SQL quoting keeps the pattern as it is
    df = spark.createDataFrame([('it\'s \\ "x"', "m", "t", H2S)], "payload string, method string, tool_name string, direction string")
    assert df.select(R.rule_condition(rules[2])).first()[0] is True


def test_enforcement_and_replies(spark):
    """Each action's effect on status, annotations, reply and counts; a notification gets no reply."""
    rules = [Rule("odd", "deny", patterns=("[13579]#",)), Rule("three", "require_approval", patterns=("[369]#",)), Rule("seen", "audit", ("n/x",))]
    rows = [(H2S, f'{{"id":"i{n}","method":"n/x","params":"{n}#"}}') for n in range(10)]
    rows += [(H2S, '{"method":"n/x","params":"1#"}'), (H2S, "1#")]
    df = R.enforce_policy(P.open_messages(raw(spark, rows)), rules)
    got = by_seq(df, "status", "audit", "policy_rule", "block_reason")
    for n in range(10):
        if n % 2:
            assert got[n] == ("blocked", False, "odd", 'blocked by policy rule "odd"')
        else:
            assert got[n] == ("forwarded", n != 6, "three" if n == 6 else None, None)
    assert got[10][0] == "blocked" and got[11] == ("forwarded", False, None, None)
    replies = {r.seq: (r.direction, r.payload) for r in C.block_responses(df).collect()}
    assert replies == {
        n: (S2H, f'{{"jsonrpc":"2.0","id":"i{n}","error":{{"code":-32600,"message":"blocked by policy rule \\"odd\\""}}}}') for n in (1, 3, 5, 7, 9)
    }
    hits = {(r.rule_name, r.policy_action): r.hits for r in R.rule_hit_counts(df).collect()}
    assert hits == {("odd", "deny"): 6, ("three", "deny"): 2, ("three", "require_approval"): 1, ("seen", "deny"): 6, ("seen", "require_approval"): 1, ("seen", "audit"): 4}


def test_stages_stop_at_first_block_or_drop(spark):
    rows = [(H2S, call("a")), (H2S, call("b")), (H2S, call("c")), (H2S, "garbage b")]
    p = F.col("payload")
    out = C.run_chain(
        P.open_messages(raw(spark, rows)),
        C.stage(modify=F.replace(p, F.lit('"a"'), F.lit('"z"'))),
        C.stage(drop=p.contains('"b"'), block=p.contains('"c"'), reason="no c"),
        C.stage(modify=F.upper(p), block=p.contains('"z"') & p.contains("nothing")),
    )
    got = by_seq(out, "status", "payload", "block_reason")
    assert got[0] == ("forwarded", call("z").upper(), None)
    assert got[1] == ("dropped", call("b"), None)
    assert got[2] == ("blocked", call("c"), "no c")
    assert got[3] == ("forwarded", "garbage b", None)
    parts = C.split_outcomes(out)
    assert sum(df.count() for df in parts.values()) == len(rows)


SLOW = [r"(?:[a-z]|[0-9])*Z", r"(.|\n)*Z", r"(.*?,){12}P", r"a.*b.*c", r"(a?){30}a{30}", r"(?:x|yy)+"]
#: Time grows with a power of the text's length: runs divided in several ways, or read again from every place in them.
POLYNOMIAL = [r"[a-z]*[a-z]*[a-z]*Z", r"\w+\w+\w+Z", r"a+b?a+b?a+Z", r".*Z", r"a.*b", r"[^,]*,", r"[a-z]+@x", r"\d+x", r"(\w+) (\w+)#", r"x|\s*y", r"a[a-z]{0,900}[a-z]{0,900}Z"]
QUICK = [
    r"(?:\d{4}[- ]?){3}\d{4}", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", r'"k": \d*5\b', r"(abc)?d", r"(a|b)c", r"x(?i)y", r'"a":\s*"[^"]*"',
    r"k=\w+;\s+v=\d+;", r"\d+", r"sk-[\w-]{20,}", r"#(\d+)-(\d+)-", r"[^,]+", r"\bx\d{2,5}y", "",
]


def test_which_patterns_need_a_linear_matcher():
    assert [p for p in SLOW + POLYNOMIAL if not needs_linear_matcher(p)] == []
    assert [p for p in QUICK if needs_linear_matcher(p)] == []


def test_hard_patterns_on_long_payloads_end(spark):
    long = call("t", args='"' + "ab1,\\n" * 200_000 + '"')
    rules = [Rule(p, "audit", ("tools/call",), patterns=(p,)) for p in SLOW[:3]] + [Rule("two", "deny", patterns=(SLOW[0], "tools"))]
    rows = [(H2S, long), (H2S, call("Z")), (S2H, '{"id":1,"result":"Z"}'), (H2S, call("x,,,,,,,,,,,,P"))]
    want = [(None, None), ("deny", [SLOW[0], SLOW[1], "two"]), (None, None), ("audit", [SLOW[2]])]
    df = P.open_messages(raw(spark, rows))
    table = spark.createDataFrame([(i, r.name, r.action, list(r.methods), [], "", list(r.patterns)) for i, r in enumerate(rules)], S.RULES)
    for out in (R.evaluate_policy(df, rules), R.evaluate_policy_table(df, table)):
        got = by_seq(out, "policy_action", "matched_rules")
        assert [got[i] for i in range(4)] == want
    assert [r[0] for r in df.orderBy("seq").select(R.rule_condition(rules[3])).collect()] == [False, True, False, False]


def test_polynomial_patterns_end_on_a_long_text(spark):
    long = call("t", args='"' + "ab" * 500_000 + '"')
    rules = [Rule(p, "audit", patterns=(p,)) for p in POLYNOMIAL[:4]]
    df = P.open_messages(raw(spark, [(H2S, long), (H2S, call("aaZ"))]))
    got = by_seq(R.evaluate_policy(df, rules), "matched_rules")
    assert got == {0: None, 1: [POLYNOMIAL[0], POLYNOMIAL[3]]}


def test_bad_patterns_fail_before_the_job(spark):
    df = P.open_messages(raw(spark, [(H2S, call("a"))]))
    for bad in ("[invalid", "(?=x)", r"(a)\1", "a++", "(?<!x)y", "*a", "(?>a)"):
        with pytest.raises(PatternError, match="'bad-rule'"):
            R.evaluate_policy(df, [Rule("bad-rule", "deny", patterns=(bad,))])


@pytest.mark.parametrize(
    "pattern,text,found",
    [
        (r"\b\d{3}-\d{2}-\d{4}\b", "é123-45-6789", True),
        (r"\b\d{3}-\d{2}-\d{4}\b", "x123-45-6789", False),
        (r"a$", "a\n", False),
        (r"(?m)a$", "a\nb", True),
        (r"a.b", "a\rb", True),
        (r"a\sb", "a\x0bb", False),
        (r"[[:alpha:]]+\d", "ab1", True),
        (r"[a[]", "[", True),
        (r"[a&&b]", "&", True),
        (r"(?P<n>x)y", "xy", True),
        (r"\Qa.b\E", "a.b", True),
        (r"\Qa.b\E", "axb", False),
        (r"(?i)É", "é", True),
        (r"\p{Greek}", "α", True),
        (r"[^\s]b", "\tb", False),
        (r"x{2,}?y", "xxy", True),
    ],
)
def test_pattern_translation(spark, pattern, text, found):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(F.col("t").rlike(to_java(pattern))).first()[0] is found
