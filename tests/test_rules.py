"""Rules given as rows against a row-by-row check, under several hot-key policies; what the plans join."""

import random
import re
from collections import Counter

import pytest
from test_plans import plan_of

from ledgersift.operators import rules
from ledgersift.operators.rules import Rule, RuleError, Source
from ledgersift.operators.skew import SkewPolicy

RULES = [
    Rule("a given", "child", rules.NOT_NULL, "a"),
    Rule("a unique", "child", rules.UNIQUE, "a"),
    Rule("a unique if big", "child", rules.UNIQUE, "a", only_where="b > 5"),
    Rule("p exists", "child", rules.REFERENCES, "p", "parent", "pid"),
    Rule("p exists or is null", "child", rules.FOREIGN_KEY, "p", "parent", "pid", only_where="b <> 3"),
    Rule("has a note", "child", rules.HAS_CHILD, "cid", "note", "child", only_where="a IS NOT NULL"),
    Rule("b in range", "child", rules.CONDITION, argument="b BETWEEN 2 AND 8"),
    Rule("b allowed", "child", rules.DOMAIN, "b", argument="1|2|3|4|5|6|7"),
    Rule("name unique", "parent", rules.UNIQUE, "name"),
    Rule("note without rules of its own kind", "note", rules.CONDITION, argument="true"),
]


def some_rows(seed, n):
    rng = random.Random(seed)

    def maybe(value):
        return None if rng.random() < .15 else value

    parent = [(maybe(k % 40), maybe(f"n{k % 17}")) for k in range(n // 5)]
    child = [(k, maybe("hot" if rng.random() < .4 else f"a{rng.randrange(n)}"),
              maybe(7 if rng.random() < .4 else rng.randrange(60)), maybe(rng.randrange(10))) for k in range(n)]
    note = [(k, maybe(rng.randrange(n))) for k in range(n // 2)]
    return parent, child, note


def broken(parent, child, note):
    """The names of the rules that each row breaks, by table, one row after the other."""
    pids, noted = {p for p, _ in parent}, {c for _, c in note}
    a_n, name_n = Counter(c[1] for c in child), Counter(p[1] for p in parent)
    out = {"child": [], "parent": [], "note": [set() for _ in note]}
    for cid, a, p, b in child:
        shared = a is not None and a_n[a] > 1
        lost = p is None or p not in pids
        out["child"].append({name for name, bad in {
            "a given": a is None, "a unique": shared, "a unique if big": shared and b is not None and b > 5,
            "p exists": lost, "p exists or is null": lost and p is not None and b is not None and b != 3,
            "has a note": a is not None and cid not in noted, "b in range": b is not None and not 2 <= b <= 8,
            "b allowed": b is not None and not 1 <= b <= 7}.items() if bad})
    for _, name in parent:
        out["parent"].append({"name unique"} if name is not None and name_n[name] > 1 else set())
    return out


def tables_of(spark, parent, child, note):
    return {"parent": Source(spark.createDataFrame(parent, "pid long, name string"), ("pid",)),
            "child": Source(spark.createDataFrame(child, "cid long, a string, p long, b int"), ("cid",)),
            "note": Source(spark.createDataFrame(note, "nid long, child long"))}


@pytest.mark.parametrize("seed, n, policy", [(1, 200, None), (2, 300, SkewPolicy(rows_per_task=20)),
                                             (3, 120, SkewPolicy(rows_per_task=1, max_hot_keys=2)), (4, 0, None)])
def test_against_row_by_row(spark, seed, n, policy):
    data = some_rows(seed, n)
    want, tables = broken(*data), tables_of(spark, *data)
    got = {r.table_name: (r.total, r.bad, r.score) for r in rules.quality_score(tables, RULES, policy).collect()}
    assert {t: v[:2] for t, v in got.items()} == {t: (len(r), sum(map(bool, r))) for t, r in want.items()}
    assert all((s is None) == (not total) for total, _, s in got.values())
    each = {(r.table_name, r.rule): r.n for r in rules.rule_counts(tables, RULES, policy).collect()}
    assert each == {(r.table_name, r.rule): sum(r.rule in b for b in want[r.table_name]) for r in RULES}
    rows = rules.rule_violations(tables, RULES, "child", policy).collect()
    assert {r.cid: set(r.broken_rules) for r in rows} == {k: b for k, b in enumerate(want["child"]) if b}
    assert len(rows) == sum(map(bool, want["child"]))
    order = [r.rule for r in RULES]
    assert all(r.broken_rules == sorted(r.broken_rules, key=order.index) for r in rows)


def test_as_many_joins_as_lookups(spark):
    """child asks three other questions than its own uniqueness; parent and note ask none."""
    tables = tables_of(spark, *some_rows(1, 50))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(rules.quality_score(tables, RULES))
        alone = plan_of(rules.quality_score(tables, [r for r in RULES if r.lookup is None or r.kind == rules.UNIQUE]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(re.findall("SortMergeJoin|ShuffledHashJoin", plan)) == 2
    assert "Join" not in alone


def test_rules_from_a_table_and_from_dictionaries(spark):
    given = [{"rule": "x", "table_name": "child", "kind": "not_null", "column_name": "a"}]
    tables = tables_of(spark, *some_rows(5, 30))
    table = spark.createDataFrame([("x", "child", "not_null", "a", None, None, None, None)], rules.RULE_SCHEMA)
    assert rules.rules_of(table) == rules.rules_of(given) == [Rule("x", "child", "not_null", "a")]
    assert rules.quality_score(tables, table).collect() == rules.quality_score(tables, given).collect()
    assert rules.rule_violations(tables, given, "note").count() == 0


@pytest.mark.parametrize("rule, said", [
    (Rule("r", "child", "odd", "a"), "unknown kind"), (Rule("r", "nowhere", rules.NOT_NULL, "a"), "no table"),
    (Rule("r", "child", rules.NOT_NULL, "z"), "no column"), (Rule("r", "child", rules.UNIQUE), "no column"),
    (Rule("r", "child", rules.REFERENCES, "p", "parent", "z"), "no column"),
    (Rule("r", "child", rules.REFERENCES, "p", "gone", "z"), "no table"),
    (Rule("r", "child", rules.DOMAIN, "b"), "argument"), (Rule("r", "child", rules.CONDITION), "argument")])
def test_rules_that_cannot_apply(spark, rule, said):
    with pytest.raises(RuleError, match=said):
        rules.quality_score(tables_of(spark, *some_rows(6, 10)), [rule])


def test_two_rules_of_one_name(spark):
    with pytest.raises(RuleError, match="same name"):
        rules.quality_score(tables_of(spark, *some_rows(6, 10)), [RULES[0], RULES[0]])
