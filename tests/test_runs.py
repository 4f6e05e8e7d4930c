"""What a run leaves behind, and parents without a key in joins that keep all rows."""

import os
from datetime import date

import pytest
from fixture import mini_ledger
from pyspark.sql import functions as F

from ledgersift.operators.skew import NO_HOT_KEYS, SkewPolicy, expand
from ledgersift.session import shared_dir
from ledgersift.sinks.runner import run_all


def test_export_run_removes_its_shared_facts(spark, tmp_path):
    def facts():
        return {name for name in os.listdir(shared_dir(spark).removeprefix("file:")) if name.startswith("audit-")}

    before = facts()
    done = run_all(spark, mini_ledger(spark), str(tmp_path), day=date(2024, 1, 15), share=True)
    assert done.where("status <> 'OK'").isEmpty() and facts() == before


@pytest.mark.parametrize("hot", [NO_HOT_KEYS, "count"])
def test_parents_without_key_stay_once_and_spread(spark, hot):
    parent = spark.createDataFrame([(None if k < 400 else k, f"p{k}") for k in range(420)], "pk long, name string")
    child = spark.createDataFrame([(k, 401 if k % 2 else None) for k in range(60)], "id long, fk long")
    got = expand(parent, child, "pk", "fk", how="full", spread_by=["id"], hot=hot,
                 policy=SkewPolicy(rows_per_task=10, max_hot_keys=3))
    rows = got.collect()
    assert sum(r.parent_found and not r.child_found for r in rows) == 419
    assert sum(r.parent_found and r.child_found for r in rows) == 30
    assert sum(not r.parent_found for r in rows) == 30
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the partitions as they were dealt
    try:
        with_null = (got.where("pk IS NULL AND parent_found").select(F.spark_partition_id().alias("at"))
                     .collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r["at"] for r in with_null}) > 1
