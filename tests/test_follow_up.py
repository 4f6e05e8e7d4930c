"""Snapshots of defects compared, and the trend kept by day, on random ledgers that grow."""

from collections import Counter
from dataclasses import replace
from datetime import date, datetime

import pytest
from fixture import ledger_of, tuples
from pyspark.sql import functions as F
from test_invariants import random_rows
from test_plans import plan_of

from ledgersift.plans import consolidated, follow_up, history, trend


def found(rows):
    """{(rule, key): bag of rows} by plain Python."""
    known = {c[0] for c in rows["customers"]}
    ids, paid = {o[0] for o in rows["orders"]}, {p[1] for p in rows["payments"]}
    active = {p[0]: p[3] for p in rows["products"]}
    emails = Counter(c[2] for c in rows["customers"] if c[2] is not None)
    totals = {o[0]: o[5] for o in rows["orders"]}
    out = {}

    def add(rule, key, row):
        out.setdefault((rule, key), Counter())[row] += 1

    for c in rows["customers"]:
        for rule, bad in (("email shared", emails[c[2]] > 1), ("name missing", c[1] is None),
                          ("email missing", c[2] is None)):
            if bad:
                add(rule, c[0], c[:3])
    for o in rows["orders"]:
        for rule, bad in (("customer unknown", o[1] not in known),
                          ("completed without payment", o[4] == "Completed" and o[0] not in paid),
                          ("total missing", o[5] is None), ("product inactive", active.get(o[2]) is False)):
            if bad:
                add(rule, o[0], o)
    for p in rows["payments"]:
        total = totals.get(p[1])
        if p[1] not in ids:
            add("order unknown", p[0], p)
        elif p[4] == "Paid" and p[3] is not None and total is not None and p[3] != total:
            add("amount differs", p[0], p)
    return out


def later(rows):
    """The ledger some time after: repaired, changed and new rows."""
    after = {role: list(of) for role, of in rows.items()}
    after["customers"] = [(c[0], c[1] or "found", *c[2:]) if c[0] % 3 == 0 else c for c in after["customers"]]
    after["customers"] += [(700 + k, None, "new@x", None) for k in range(3)]
    after["orders"] = [(*o[:3], datetime(2024, 5, 1), *o[4:]) if o[0] % 7 == 0 else o for o in after["orders"]]
    after["orders"] += [(900 + k, 3, 1, None, "Completed", None) for k in range(4)]
    after["payments"] += [(2_000 + o[0], o[0], None, o[5], "Paid") for o in rows["orders"][::5]]
    return after


@pytest.mark.parametrize("seed", [1, 2])
def test_states_against_brute_force(spark, tmp_path, seed):
    rows = random_rows(seed)
    after = later(rows)
    for moment, of in ((date(2024, 1, 1), rows), (date(2024, 7, 1), after)):
        for _ in range(2):  # the same day again replaces itself
            follow_up.write_snapshot(ledger_of(spark, **of), moment, str(tmp_path))
    was, now = (follow_up.snapshot(spark, str(tmp_path), d) for d in (date(2024, 1, 1), date(2024, 7, 1)))
    got = follow_up.follow_up(was, now)
    a, b = found(rows), found(after)
    want = {at: "solved" if at not in b else "new" if at not in a else "open" if a[at] == b[at] else "changed"
            for at in a | b}
    assert {(r.rule, r.key): r.state for r in got.collect()} == want and got.count() == len(want)
    assert set(want.values()) == set(follow_up.STATES)
    summary = {r.rule: (r.new, r.solved, r.open, r.changed) for r in follow_up.follow_up_summary(got).collect()}
    count = Counter((rule, state) for (rule, _), state in want.items())
    assert summary == {rule: tuple(count[rule, s] for s in follow_up.STATES) for rule, _ in want}


def test_a_snapshot_reads_its_own_day(spark, tmp_path):
    for day in (1, 2):
        follow_up.write_snapshot(ledger_of(spark, customers=[(day, None, None, None)]), date(2024, 1, day), str(tmp_path))
    one = follow_up.snapshot(spark, str(tmp_path), date(2024, 1, 2))
    assert "PartitionFilters: [isnotnull(run_date" in plan_of(one)
    assert sorted(tuples(one, "rule", "key")) == [("email missing", 2), ("name missing", 2)]


def test_rows_without_key_and_repeated_keys(spark):
    schema = follow_up.SNAPSHOT_SCHEMA
    was = spark.createDataFrame([("r", None, 1), ("r", 5, 1), ("r", 5, 2), ("s", 6, 1)], schema)
    now = spark.createDataFrame([("r", None, 1), ("r", 5, 2), ("r", 5, 1), ("s", 6, 1), ("s", 6, 1), ("t", None, 4)], schema)
    assert set(tuples(follow_up.follow_up(was, now))) == {("r", None, "open"), ("r", 5, "open"), ("s", 6, "changed"),
                                                          ("t", None, "new")}


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.glob("day=*/part-*")}


@pytest.mark.parametrize("seed", [1, 3])
def test_only_touched_days_are_rewritten(spark, tmp_path, seed):
    whole = ledger_of(spark, **random_rows(seed))
    moment = "2024-02-03 00:00:00"
    path = tmp_path / "days"
    trend.write_days(history.as_of(whole, moment), str(path))
    first = files(path)

    def since(df, column):
        return df.where(F.col(column) >= F.lit(moment).cast("timestamp_ntz"))

    days = trend.touched_days(whole, customers=since(whole.customers, "created_at"),
                              orders=since(whole.orders, "order_date"), payments=since(whole.payments, "payment_date"))
    trend.refresh_days(whole, str(path), days)
    assert sorted(map(str, tuples(trend.trend(spark, str(path))))) == sorted(
        map(str, tuples(consolidated.error_trend(whole))))
    touched = {"__HIVE_DEFAULT_PARTITION__" if d is None else str(d) for (d,) in tuples(days)}
    second = files(path)
    changed = {f.split("/")[0].removeprefix("day=") for f, at in second.items() if first.get(f) != at}
    assert changed <= touched
    # One order of one day: its day alone is written again.
    one = whole.orders.where("order_date IS NOT NULL").orderBy("order_id").limit(1)
    more = replace(whole, orders=whole.orders.unionByName(one.withColumn("order_id", F.lit(5_000).cast("long"))))
    trend.refresh_days(more, str(path), trend.touched_days(more, orders=one))
    again = {f.split("/")[0] for f, at in files(path).items() if second.get(f) != at}
    assert again == {f"day={tuples(one.select(F.to_date('order_date')))[0][0]}"}
    assert sorted(map(str, tuples(trend.trend(spark, str(path))))) == sorted(map(str, tuples(consolidated.error_trend(more))))


def test_a_range_of_days_reads_their_files_only(spark, tmp_path):
    trend.write_days(ledger_of(spark, **random_rows(1)), str(tmp_path))
    some = trend.trend(spark, str(tmp_path), date(2024, 1, 5), date(2024, 1, 9))
    assert "PartitionFilters: [isnotnull(day" in plan_of(some)
    assert {r.period.date() for r in some.collect()} <= {date(2024, 1, d) for d in range(5, 10)}
