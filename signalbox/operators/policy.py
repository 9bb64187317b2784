"""Rules over messages: match, decide, enforce, count.

A rule is the AND of its set parts: direction, method list, tool list, and every
pattern found somewhere in the payload. Among the matching rules deny beats
require_approval beats audit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbox import schemas as S
from signalbox.functions.plan import once
from signalbox.functions.regex import PatternError, checked, linear_match, needs_linear_matcher
from signalbox.operators.messages import in_chain
from signalbox.operators.rule_index import RuleIndex, candidate_rules, literal_array
from signalbox.operators.rule_join import content_keys, ordered_rules, rule_rest, rules_met
from signalbox.session import work_dir
from signalbox.sources.tables import staged


@dataclass(frozen=True)
class Rule:
    name: str
    action: str
    methods: tuple[str, ...] = ()
    tools: tuple[str, ...] = ()
    direction: str = ""
    patterns: tuple[str, ...] = ()


@dataclass(frozen=True)
class CustomPattern:
    name: str
    pattern: str
    label: str


@dataclass(frozen=True)
class Policy:
    rules: tuple[Rule, ...] = ()
    scrub: bool = False
    custom_patterns: tuple[CustomPattern, ...] = field(default=())

    def active_patterns(self) -> tuple[CustomPattern, ...]:
        """Custom patterns count only while the policy's own scrubber is on."""
        return self.custom_patterns if self.scrub else ()


def java_patterns(rule: Rule) -> list[str]:
    """The rule's patterns for Spark; a bad one stops here, naming rule and pattern."""
    if not rule.patterns:
        return []
    try:
        return checked(SparkSession.getActiveSession(), rule.patterns)
    except PatternError as exc:
        raise PatternError(f"rule {rule.name!r}: {exc}") from None


def _all_java_patterns(rules: list[Rule]) -> list[list[str]]:
    """`java_patterns` of many rules: each pattern that occurs is compiled once."""
    distinct = list(dict.fromkeys(p for rule in rules for p in rule.patterns))
    try:
        known = dict(zip(distinct, checked(SparkSession.getActiveSession(), distinct), strict=True))
    except PatternError:
        for rule in rules:
            java_patterns(rule)  # names the rule
        raise
    return [[known[p] for p in rule.patterns] for rule in rules]


def check_rules(rules: list[Rule]) -> None:
    """An error for a rule with a bad pattern, naming both."""
    _all_java_patterns(rules)


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _one_of(column: str, values: tuple[str, ...]) -> str:
    return f"{column} IN ({', '.join(map(_quote, values))})"


def rule_sql(rule: Rule, payload: str = "payload", linear: dict[str, str] | None = None) -> str:
    """The rule as SQL text. Cheap tests come first, patterns last.

    `linear` names the boolean columns that stand for patterns matched elsewhere.
    """
    tests = []
    if rule.direction:
        tests.append(f"direction = {_quote(rule.direction)}")
    if rule.methods:
        tests.append(_one_of("coalesce(method, '')", rule.methods))
    if rule.tools:
        tests.append(_one_of("nullif(tool_name, '')", rule.tools))
    for pattern, java in zip(rule.patterns, java_patterns(rule)):
        own = (linear or {}).get(pattern)
        tests.append(f"`{own}`" if own else f"`{payload}` RLIKE {_quote(java)}")
    return f"coalesce({' AND '.join(tests)}, false)" if tests else "true"


def rule_condition(rule: Rule, payload: str = "payload") -> Column:
    """The rule as a boolean column. From SQL text, as rule lists may be long."""
    java_patterns(rule)
    slow = [p for p in rule.patterns if needs_linear_matcher(p)]
    fast = replace(rule, patterns=tuple(p for p in rule.patterns if p not in slow))
    condition = F.expr(rule_sql(fast, payload))
    if not slow:
        return condition
    return F.coalesce(reduce(lambda a, p: a & linear_match(p, F.col(payload)), slow, condition), F.lit(False))


def _with_linear(df: DataFrame, rules: list[Rule], payload: str) -> tuple[DataFrame, list[dict[str, str]]]:
    """Columns for the patterns that need a linear-time matcher, and by rule which stands for which.

    Only payloads that pass the rule's cheap tests are handed over.
    """
    columns, by_rule = {}, []
    for i, rule in enumerate(rules):
        java_patterns(rule)  # a bad pattern stops here
        names = {}
        cheap = None
        for j, pattern in enumerate(dict.fromkeys(rule.patterns)):
            if needs_linear_matcher(pattern):
                if cheap is None:
                    cheap = _active(df) & F.expr(rule_sql(replace(rule, patterns=())))
                names[pattern] = f"_linear{i}_{j}"
                columns[names[pattern]] = linear_match(pattern, F.when(cheap, F.col(payload)))
        by_rule.append(names)
    return (df.withColumns(columns) if columns else df), by_rule


def _active(df: DataFrame) -> Column:
    return in_chain() if {"status", "parse_error"} <= set(df.columns) else F.lit(True)


def evaluate_policy(df: DataFrame, rules: list[Rule], payload: str = "payload") -> DataFrame:
    """Add `matched_rules`, `policy_action`, `deny_rule`, `approval_rule`.

    `deny_rule` is the first matching deny. `approval_rule` is the last matching
    approval before any deny; it stays set if a deny follows. An action that is
    none of the three adds its name but decides nothing.
    """
    df, linear = _with_linear(df, rules, payload)
    drop = [name for names in linear for name in names.values()]
    active = _active(df)
    hits = {
        f"_hit{i}": once(F.when(active, F.expr(rule_sql(rule, payload, linear[i]))).otherwise(False))
        for i, rule in enumerate(rules)
    }
    names = [F.when(F.col(f"_hit{i}"), F.lit(rule.name)) for i, rule in enumerate(rules)]

    def of(action: str) -> list[int]:
        return [i for i, rule in enumerate(rules) if rule.action == action]

    def first(cols: list[Column]) -> Column:
        return F.coalesce(*cols) if cols else F.lit(None).cast("string")

    def any_of(idx: list[int]) -> Column:
        return reduce(lambda a, b: a | b, (F.col(f"_hit{i}") for i in idx), F.lit(False))

    denies = of(S.DENY)
    approvals = [
        F.when(F.col(f"_hit{i}") & ~any_of([d for d in denies if d < i]), rules[i].name)
        for i in reversed(of(S.REQUIRE_APPROVAL))
    ]
    matched = F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")
    return (
        (df.withColumns(hits) if hits else df)
        .withColumns(
            {
                "matched_rules": F.when(F.size(matched) > 0, matched),
                "deny_rule": first([names[i] for i in denies]),
                "approval_rule": first(approvals),
                "policy_action": F.when(any_of(denies), S.DENY)
                .when(any_of(of(S.REQUIRE_APPROVAL)), S.REQUIRE_APPROVAL)
                .when(any_of(of(S.AUDIT)), S.AUDIT),
            }
        )
        .drop(*hits, *drop)
    )


# A rule table is configuration, but may be long: a policy on the driver has at most so many rules.
RULES_PER_PART = 50_000
# From a table, so many rules at most become part of a plan.
RULES_IN_PLAN = 10_000


def read_rule_parts(rules_df: DataFrame, size: int) -> Iterator[list[Rule]]:
    """The rules in order, as driver objects, `size` at a time.

    Rules with equal `ord` follow each other by name and then by their other parts,
    so one table has one order, wherever a part ends. A NULL name reads as ''.
    """
    rows = rules_df.withColumn("name", F.coalesce("name", F.lit(""))).orderBy("ord", "name", rule_rest()).toLocalIterator()
    while part := list(islice(rows, size)):
        yield [
            Rule(
                r["name"],
                r["action"] or "",
                tuple(r["methods"] or ()),
                tuple(r["tools"] or ()),
                r["direction"] or "",
                tuple(r["patterns"] or ()),
            )
            for r in part
        ]


def evaluate_policy_table(
    df: DataFrame, rules_df: DataFrame, payload: str = "payload", part_rules: int = RULES_IN_PLAN
) -> DataFrame:
    """`evaluate_policy` with the rules as a table, in order of `ord` (see `read_rule_parts`).

    Up to `part_rules` rules become part of the plan, where an index finds each message's
    candidates (see `rule_index`); messages are neither multiplied nor shuffled. A longer table stays a
    table and is joined with the messages (see `rule_join`), so the driver never holds it; only a
    stream takes any table into its plan, part by part. The way changes the plan, never the result.
    """
    parts = read_rule_parts(rules_df, part_rules) if df.isStreaming else None
    if parts is None:
        if rules_df.limit(part_rules + 1).count() > part_rules:
            return _evaluate_joined(df, rules_df, payload)
        parts = read_rule_parts(rules_df, max(part_rules, 1))
    none = F.lit(None).cast("string")
    out = df.withColumns(
        {
            "matched_rules": F.array().cast("array<string>"),
            "deny_rule": none,
            "approval_rule": none,
            "_actions": F.array().cast("array<string>"),
        }
    )
    for part in parts:
        out = _evaluate_part(out, part, payload)
    return out.withColumns({"matched_rules": F.when(F.size("matched_rules") > 0, F.col("matched_rules")), "policy_action": _strongest("_actions")}).drop("_actions")


def _strongest(actions: str) -> Column:
    return (
        F.when(F.array_contains(actions, S.DENY), S.DENY)
        .when(F.array_contains(actions, S.REQUIRE_APPROVAL), S.REQUIRE_APPROVAL)
        .when(F.array_contains(actions, S.AUDIT), S.AUDIT)
    )


def _evaluate_joined(df: DataFrame, rules_df: DataFrame, payload: str) -> DataFrame:
    """The rules met by each distinct content (direction, method, tool, text), joined back to the messages."""
    rules = ordered_rules(rules_df)
    if not rules.valid():
        for part in read_rule_parts(rules_df, RULES_IN_PLAN):
            check_rules(part)  # names the rule
    first, second = content_keys(payload)
    # Written once, as both sides of the join read it: finding these columns may have cost a parse.
    keyed = staged(df.withColumns({"_c1": F.when(_active(df), first), "_c2": F.when(_active(df), second)}), work_dir(df.sparkSession, "judged"))
    met = rules_met(keyed, rules, payload)
    found = F.array_sort("_met")
    met = met.select("_c1", "_c2", F.transform(found, lambda r: r["name"]).alias("matched_rules"), F.transform(found, lambda r: r["action"]).alias("_actions"))
    deny = F.array_position("_actions", S.DENY).cast("int")
    # The last approval before any deny.
    before = F.when(deny > 0, F.slice("_actions", 1, deny - 1)).otherwise(F.col("_actions"))
    back = F.array_position(F.reverse(before), S.REQUIRE_APPROVAL).cast("int")
    met = met.select(
        F.col("_c1").alias("_m1"),
        F.col("_c2").alias("_m2"),
        "matched_rules",
        F.when(deny > 0, F.get("matched_rules", deny - 1)).alias("deny_rule"),
        F.when(back > 0, F.get("matched_rules", F.size(before) - back)).alias("approval_rule"),
        _strongest("_actions").alias("policy_action"),
    )
    return keyed.join(met, (F.col("_c1") == F.col("_m1")) & (F.col("_c2") == F.col("_m2")), "left").drop("_c1", "_c2", "_m1", "_m2")


def _evaluate_part(df: DataFrame, rules: list[Rule], payload: str) -> DataFrame:
    """Add what these rules decide to what the rules before them decided."""
    names = literal_array([r.name for r in rules], "string")
    actions = literal_array([r.action for r in rules], "string")
    # Rules with a pattern for the linear matcher are tested one by one, as in `evaluate_policy`.
    slow = [i for i, r in enumerate(rules) if any(needs_linear_matcher(p) for p in r.patterns)]
    df, linear = _with_linear(df, [rules[i] for i in slow], payload)
    drop = [name for own in linear for name in own.values()]
    cases = (f"CASE WHEN {rule_sql(rules[i], payload, own)} THEN {i} END" for i, own in zip(slow, linear, strict=True))
    others = [r for i, r in enumerate(rules) if i not in set(slow)]
    places = literal_array([i for i in range(len(rules)) if i not in set(slow)], "int")
    patterns = literal_array(_all_java_patterns(others), "array<string>")
    index = RuleIndex([(r.direction, r.methods, r.tools, r.patterns) for r in others])
    text = F.col(payload)
    # A rule's patterns are met if no candidate's pattern is missing; a null text has none.
    met = F.filter("_candidates", lambda i: F.coalesce(F.forall(F.get(patterns, i), lambda p: F.rlike(text, p)), F.lit(False)))
    found = F.transform(met, lambda i: F.get(places, i))
    hits = F.array_sort(F.concat(found, F.array_compact(F.expr(f"array({', '.join(cases)})")))) if slow else found

    def having(action: str) -> Column:
        return F.filter("_matched", lambda i: F.get(actions, i) == action)

    approvals = F.filter(
        having(S.REQUIRE_APPROVAL), lambda i: F.col("_deny").isNull() | (i < F.col("_deny"))
    )
    approval = F.get(names, F.get(approvals, F.size(approvals) - 1))
    none_denied = F.col("deny_rule").isNull()
    return (
        df.withColumn("_candidates", candidate_rules(index, _active(df), text))
        .withColumn("_matched", once(F.when(_active(df), hits).otherwise(F.array().cast("array<int>"))))
        .withColumn("_deny", F.get(having(S.DENY), F.lit(0)))
        .withColumns(
            {
                "approval_rule": F.coalesce(F.when(none_denied, approval), F.col("approval_rule")),
                "deny_rule": F.coalesce(F.col("deny_rule"), F.get(names, F.col("_deny"))),
                "matched_rules": F.concat(
                    "matched_rules", F.transform("_matched", lambda i: F.get(names, i))
                ),
                "_actions": F.array_union(
                    "_actions", F.transform("_matched", lambda i: F.get(actions, i))
                ),
            }
        )
        .drop("_candidates", "_matched", "_deny", *drop)
    )


def _quoted(name: Column) -> Column:
    escaped = F.replace(F.replace(name, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def apply_decision(df: DataFrame) -> DataFrame:
    """Turn an evaluation into status and annotations.

    deny blocks; approval and audit annotate and pass. `audit` is true only if
    audit is the final action.
    """
    action = F.col("policy_action")
    denied = F.coalesce(action == S.DENY, F.lit(False))
    return df.withColumns(
        {
            "audit": F.coalesce(action == S.AUDIT, F.lit(False)),
            "policy_rule": F.when(denied, F.col("deny_rule")).when(
                action == S.REQUIRE_APPROVAL, F.col("approval_rule")
            ),
            "status": F.when(denied, S.BLOCKED).otherwise(F.col("status")),
            "block_reason": F.when(
                denied, F.concat(F.lit("blocked by policy rule "), _quoted(F.col("deny_rule")))
            ).otherwise(F.col("block_reason")),
        }
    ).drop("deny_rule", "approval_rule")


def enforce_policy(df: DataFrame, rules: list[Rule] | DataFrame) -> DataFrame:
    """The policy stage: evaluate the rules (a list or a table) and act on them."""
    if isinstance(rules, DataFrame):
        return apply_decision(evaluate_policy_table(df, rules))
    return apply_decision(evaluate_policy(df, rules))


def rule_hit_counts(df: DataFrame) -> DataFrame:
    """Messages per matched rule and final action."""
    return (
        df.select(F.explode("matched_rules").alias("rule_name"), "policy_action")
        .groupBy("rule_name", "policy_action")
        .agg(F.count(F.lit(1)).alias("hits"))
    )
