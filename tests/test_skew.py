"""Hot keys, NULL keys and duplicated parents: results equal a plain join, tasks stay balanced."""

import random
from collections import Counter

import pytest
from fixture import tuples
from pyspark.sql import functions as F

from ledgersift.operators.duplicates import duplicate_groups, duplicate_members, listing_blocks
from ledgersift.operators.skew import SkewPolicy, expand, hot_keys, match, resolve

SPLIT = SkewPolicy(rows_per_task=20, max_hot_keys=3)


@pytest.fixture(scope="module")
def tables(spark):
    """A third of the children under one key, a sixth under a missing one, a sixth under NULL."""
    rng = random.Random(7)
    children = []
    for i in range(1200):
        key = 1 if i % 3 == 0 else 999 if i % 6 == 1 else None if i % 6 == 2 else rng.randrange(2, 60)
        children.append((i, key, i % 7))
    parents = [(k, f"p{k}") for k in range(1, 80)]
    return (spark.createDataFrame(children, "id long, fk long, v int").repartition(5),
            spark.createDataFrame(parents, "pk long, name string"))


def plain(tables, how):
    child, parent = tables
    return child.join(parent, F.col("fk") == F.col("pk"), how)


@pytest.mark.parametrize("policy", [SkewPolicy(), SPLIT, SkewPolicy(rows_per_task=1)])
def test_resolve_equals_a_left_join(tables, policy):
    child, parent = tables
    ours = resolve(child, parent, "fk", "pk", found="hit", values={"name": "name"}, spread_by=["id"], policy=policy)
    expected = plain(tables, "left").select("id", "fk", "v", F.col("pk").isNotNull(), "name")
    assert Counter(tuples(ours)) == Counter(tuples(expected))


@pytest.mark.parametrize("policy", [SkewPolicy(), SPLIT, SkewPolicy(rows_per_task=1)])
def test_match_equals_an_inner_join(tables, policy):
    child, parent = tables
    ours = match(child, parent, "fk", "pk", values={"name": "name"}, policy=policy)
    assert Counter(tuples(ours)) == Counter(tuples(plain(tables, "inner"), "id", "fk", "v", "name"))


@pytest.mark.parametrize("how", ["inner", "left", "full"])
@pytest.mark.parametrize("policy", [SkewPolicy(), SPLIT, SkewPolicy(rows_per_task=1)])
def test_expand_equals_a_join_from_the_parent(tables, how, policy):
    child, parent = tables
    ours = expand(parent, child, "pk", "fk", how=how, spread_by=["id"], policy=policy)
    expected = parent.join(child, F.col("fk") == F.col("pk"), how)
    assert Counter(tuples(ours, "pk", "name", "id", "fk", "v")) == Counter(tuples(expected))
    assert ours.where("parent_found and child_found").count() == plain(tables, "inner").count()


def test_duplicated_parents_do_not_multiply_children(tables):
    child, parent = tables
    doubled = parent.union(parent.withColumn("name", F.lit("zz")))
    for policy in (SkewPolicy(), SPLIT):
        ours = resolve(child, doubled, "fk", "pk", found="hit", values={"name": "name"}, policy=policy)
        assert ours.count() == child.count()
        assert ours.where("name = 'zz'").count() == 0
        assert match(child, doubled, "fk", "pk", values={"name": "name"}, policy=policy).count() \
            == plain(tables, "inner").count()


def test_hot_keys_are_bounded_and_sized(tables):
    child, _ = tables
    rows = tuples(hot_keys(child, "fk", SPLIT))
    assert len(rows) <= SPLIT.max_hot_keys
    assert (1, 20) in rows and (999, 10) in rows


def test_hot_rows_spread_over_tasks(spark, tables):
    """The hot key's rows must not meet in one partition of the joined result."""
    child, parent = tables
    for joined in (resolve(child, parent, "fk", "pk", found="hit", spread_by=["id"], policy=SPLIT),
                   expand(parent, child, "pk", "fk", how="inner", spread_by=["id"], policy=SPLIT)):
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            sizes = tuples(joined.where("fk = 1").groupBy(F.spark_partition_id()).count())
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        assert sum(n for _, n in sizes) == 400
        assert max(n for _, n in sizes) < 200


def test_members_of_a_hot_group_are_rows(spark):
    rows = [(i, "shared" if i % 3 == 0 else f"k{i // 2}", f"n{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, k string, name string")
    size = Counter(k for _, k, _ in rows)
    for policy in (SkewPolicy(), SPLIT):
        members = duplicate_members(df, "k", "id", "name", policy)
        assert sorted(tuples(members)) == sorted((k, i, name) for i, k, name in rows if size[k] > 1)


def test_a_group_has_one_row_at_any_size(spark):
    df = spark.range(10_011).selectExpr("id", "if(id < 10, 'small', 'large') AS k")
    groups = duplicate_groups(df, "k")
    assert groups.columns == ["k", "n", "n_extra"]
    assert sorted(tuples(groups)) == [("large", 10_001, 10_000), ("small", 10, 9)]


def test_groups_as_text_in_blocks(spark):
    """A hot group fills many blocks, in id order; an ordinary one is one row; NULL names are skipped."""
    rows = [(i, "shared" if i % 3 == 0 else f"k{i // 4}", None if i % 5 == 0 else f"n{i}", i % 7) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, k string, name string, at int").repartition(5, "name")
    members = {}
    for i, k, name, moment in rows:
        members.setdefault(k, []).append((i, name, moment))
    blocks = {}
    for r in listing_blocks(df, "k", "id", "name", "at", block_rows=50, separator="; ").collect():
        blocks.setdefault(r.k, {})[r.block] = r
    assert set(blocks) == {k for k, m in members.items() if len(m) > 1}
    for k, found in blocks.items():
        assert sorted(found) == list(range(len(found)))
        ordered = [found[b] for b in range(len(found))]
        assert "; ".join(r.ids for r in ordered) == "; ".join(str(i) for i, *_ in members[k])
        names = [r.names for r in ordered if r.names is not None]
        assert "; ".join(names) == "; ".join(name for _, name, _ in members[k] if name)
        for r in ordered:
            ids = [int(i) for i in r.ids.split("; ")]
            assert (r.first_id, r.last_id) == (ids[0], ids[-1]) and len(ids) <= 50
            assert (r.n, r.n_extra) == (len(members[k]), len(members[k]) - 1)
            assert (r.first_seen, r.last_seen) == (min(m[2] for m in members[k]), max(m[2] for m in members[k]))
    assert len(blocks["shared"]) >= 6 and all(len(b) == 1 for k, b in blocks.items() if k != "shared")


def test_no_task_gathers_a_hot_group(spark, tmp_path):
    """A third of all rows under one key: the ranges that blocks are cut in stay even."""
    rows = [(i, "shared" if i % 3 == 0 else f"k{i // 6}") for i in range(6_000)]
    df = spark.createDataFrame(rows, "id long, k string")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        listing_blocks(df, "k", "id", block_rows=100, folder=str(tmp_path / "ranges"))
        sizes = [n for _, n in tuples(spark.read.parquet(str(tmp_path / "ranges")).groupBy("_range").count())]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(sizes) > 2 and max(sizes) < 2 * sum(sizes) / len(sizes)


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_results_do_not_depend_on_adaptive_plans(spark, tables, adaptive):
    child, parent = tables
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        ours = tuples(resolve(child, parent, "fk", "pk", found="hit", spread_by=["id"], policy=SPLIT))
        pairs = expand(parent, child, "pk", "fk", how="full", spread_by=["id"], policy=SPLIT).count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert sum(1 for *_, hit in ours if hit) == plain(tables, "inner").count()
    assert pairs == parent.join(child, F.col("fk") == F.col("pk"), "full").count()
