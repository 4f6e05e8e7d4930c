"""Mixing: each source's words against its target, also where rows repeat, and the rows against the plan."""

import collections

import pytest

from ledgersift.llm import mixing
from ledgersift.llm.tables import table

SCHEMA = "doc_id long, text string, source string, shard string, place long"


def words(n):
    return " ".join(["word"] * n)


def brute_targets(size):
    """Shares by weights 1, 2, 3 in order, cut at 3 times the size, the excess shared again."""
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    given, open_, left = {}, list(order), sum(size.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 3 * size[s]]
        for s in over or open_:
            given[s] = 3 * size[s] if over else left * weight[s] / total
        left -= sum(given[s] for s in over)
        open_ = [s for s in open_ if s not in given] if over else []
    return given


def check(docs, mix):
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    size, largest = collections.Counter(), collections.Counter()
    for _, source, text in rows:
        n = len((text or "").split(" ")) if text else 0
        size[source] += n
        largest[source] = max(largest[source], n)
    got = mix.taken().collect()
    assert len(got) == len(rows) and all(r.taken == r.size * r.n_draws <= 3 * r.size for r in got)
    target = brute_targets(size)
    sources = {r.rank: r.source for r in mix.sources.collect()}
    by_source = collections.Counter()
    for r in mix.sized.join(mix.draws, ["rank", "block"]).where("cut IS NULL OR `order` <= cut").collect():
        by_source[sources[r["rank"]]] += r["size"]
    for source in size:
        assert abs(by_source[source] - target[source]) <= max(largest[source], 1), (source, target[source])
    assert sum(r.taken for r in got) == sum(by_source.values())
    drawn = collections.Counter({key: n for key, n in collections.Counter(r.doc_id for r in mix.rows(docs).collect()).items()})
    planned = collections.Counter()
    for r in got:
        planned[r.doc_id] += r.n_draws
    assert drawn == +planned
    return got


@pytest.fixture(scope="module")
def repeated(spark):
    """One source is 2,000 equal rows and 398 short ones, others are small, null or empty."""
    rows = [(1, words(50), "a")] * 2_000 + [(10 + k, words(2), "a") for k in range(398)]
    rows += [(1_000 + k, words(7 + k % 90), "b") for k in range(700)] + [(3_000 + k, words(200), None) for k in range(60)]
    rows += [(5_000 + k, "", "c") for k in range(5)] + [(None, words(9), "d"), (None, words(9), "d"), (7_000, None, "d")]
    return spark.createDataFrame([(i, t, s, "x", 1) for i, t, s in rows], SCHEMA).repartition(6, "doc_id", "text")


def test_repeated_rows_meet_their_target(repeated):
    first = check(repeated, mixing.mixture(repeated))
    again = mixing.mixture(repeated).taken().collect()
    assert sorted(map(str, first)) == sorted(map(str, again))


def test_rows_keep_their_columns(repeated):
    mix = mixing.mixture(repeated)
    rows = mix.rows(repeated)
    assert rows.columns == [*repeated.columns, "__shard"]
    assert {r["shard"] for r in rows.select("shard").distinct().collect()} == {"x"}


def test_files_give_the_same_mix_however_they_are_split(spark, repeated, tmp_path):
    repeated.coalesce(2).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    n_tasks = docs.rdd.getNumPartitions()
    mix = mixing.mixture(docs)
    first = sorted(map(str, check(docs, mix)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        other = spark.read.parquet(str(tmp_path / "docs"))
        assert other.rdd.getNumPartitions() != n_tasks
        assert sorted(map(str, mixing.mixture(other).taken().collect())) == first
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_given_table_meets_its_targets(spark, sf_small):
    docs = table(spark, sf_small, "documents").selectExpr("doc_id", "regexp_replace(trim(text), '[ \\t-\\r]+', ' ') AS text",
                                                          "source")
    check(docs, mixing.mixture(docs))
