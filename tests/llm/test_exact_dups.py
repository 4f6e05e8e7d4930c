"""Exact copies against brute force: every edge, filters of every fill, many slices, a very large group."""

import collections
import hashlib

import pytest
from pyspark.sql import functions as F

from ledgersift.llm import exact_dups

SCHEMA = "doc_id long, text string, digest string, at long, part string"


def edge_rows():
    """Copies, nulls, empty and long texts, repeated rows, null ids, and columns with the operator's own names."""
    texts = [None, "", " ", "a", "A", "a ", "a\n", "é", "é", "x" * 200_000, "x" * 200_000 + "y"]
    rows = [(100 * k + j, t) for k, t in enumerate(texts) for j in range(1 + k % 3)]
    rows += [(5000, "a"), (5000, "a"), (None, "a"), (None, "only null ids"), (None, "only null ids"), (7000, "once")]
    rows += [(8000 + k, f"alone {k}") for k in range(300)] + [(9000 + k, "hot") for k in range(400)]
    return [(i, t, "d", 1, "p") for i, t in rows]


def brute(rows):
    groups = collections.defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    out = collections.Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(t.encode()).hexdigest()
        ids.sort(key=lambda i: (i is not None, i or 0))
        for k, i in enumerate(ids):
            out[i, keep, len(ids), k == len(ids) - 1, sha] += 1
    return out


def got(df):
    return collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.digest.hex()) for r in df.collect())


@pytest.mark.parametrize("filter_bits", [exact_dups.FILTER_BITS, 4096])
def test_groups_equal_brute_force(spark, filter_bits):
    rows = edge_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(exact_dups.exact_groups(df, filter_bits=filter_bits)) == brute(rows)


def test_empty_table(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert exact_dups.exact_groups(nothing).collect() == [] == exact_dups.without_copies(nothing).collect()


@pytest.mark.parametrize("filter_bits", [exact_dups.FILTER_BITS, 4096])
def test_whole_rows_that_stay(spark, filter_bits):
    rows = edge_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    left = exact_dups.without_copies(df, filter_bits=filter_bits)
    assert left.columns == df.columns
    kept = collections.Counter((r.doc_id, r.text or "") for r in left.collect())
    texts = {bytes.fromhex(sha): keep for _, keep, _, _, sha in brute(rows)}
    assert kept == collections.Counter({(texts[hashlib.sha256(t.encode()).digest()], t): 1
                                        for t in {t or "" for _, t, *_ in rows}})


def test_only_what_may_repeat_is_shuffled(spark):
    """Of 20,000 single rows few are taken for copies; of copies none is missed."""
    rows = spark.range(20_500).select(F.when(F.col("id") < 20_000, F.col("id")).otherwise(F.lit(7)).cast("string").alias("t"))
    digests = rows.select(exact_dups.digest_of("t").alias("digest"), "t")
    size = exact_dups._slices(20_500, exact_dups.FILTER_BITS)[1]
    tested = exact_dups.with_maybe(digests, exact_dups.repeated_bits(digests, size), size)
    counts = {r["copy"]: (r["n"], r["maybe"]) for r in tested.groupBy((F.col("t") == "7").alias("copy")).agg(
        F.count("*").alias("n"), F.count_if("maybe").alias("maybe")).collect()}
    assert counts[True] == (501, 501)
    assert counts[False][0] == 19_999 and counts[False][1] < 600


def test_plan_is_made_of_spark_expressions(spark):
    plan = exact_dups.exact_groups(spark.createDataFrame(edge_rows(), SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
