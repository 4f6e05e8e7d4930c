"""The scorecard kept by key: equal to the full audit however the rows arrive, and reading only what a batch touches."""

import random

import pytest
from fixture import ledger_of, tuples
from test_invariants import random_rows

from ledgersift.model import ROLE_SCHEMAS
from ledgersift.plans import scorecard
from ledgersift.streaming import incremental
from ledgersift.streaming.incremental import batches_done, current_scorecard, incremental_scorecard, ledger_arrivals

ROLES = ("customers", "orders", "payments")


def arrive(spark, folder, rows):
    for role in ROLES:
        spark.createDataFrame(rows.get(role, []), ROLE_SCHEMAS[role]).coalesce(1).write.mode("append").parquet(
            f"{folder}/{role}")


def run(spark, folder, state, files=1, buckets=8):
    streams = [spark.readStream.schema(ROLE_SCHEMAS[role]).option("maxFilesPerTrigger", files).parquet(f"{folder}/{role}")
               for role in ROLES]
    incremental_scorecard(ledger_arrivals(*streams), state, buckets=buckets).awaitTermination()


def full(spark, rows):
    return sorted(tuples(scorecard.quality_score(ledger_of(spark, **{r: rows.get(r, []) for r in ROLES}))))


def odd_rows(seed):
    """Random rows with repeated order ids under other customers, and rows without id."""
    rows = random_rows(seed)
    rows["orders"] += [(5, 4, 1, None, "Completed", None), (6, 200, 1, None, "Completed", rows["orders"][0][5])]
    return rows


@pytest.mark.parametrize("seed, runs, files", [(1, 3, 1), (2, 1, 1), (3, 4, 5)])
def test_any_split_equals_the_full_audit(spark, tmp_path, seed, runs, files):
    rng = random.Random(seed)
    left = {role: list(rows) for role, rows in odd_rows(seed).items() if role in ROLES}
    for rows in left.values():
        rng.shuffle(rows)
    so_far = {role: [] for role in ROLES}
    for k in range(runs):
        for _ in range(2):  # files of the same run
            part = {}
            for role in ROLES:
                n = len(left[role]) if k == runs - 1 else rng.randrange(len(left[role]) // 2 + 1)
                part[role], left[role] = left[role][:n], left[role][n:]
                so_far[role] += part[role]
            arrive(spark, tmp_path / "in", part)
        run(spark, tmp_path / "in", str(tmp_path / "state"), files)
        assert sorted(tuples(current_scorecard(spark, str(tmp_path / "state")))) == full(spark, so_far)


def test_a_small_batch_reads_few_rows_and_a_repeated_one_changes_nothing(spark, tmp_path):
    state, n = str(tmp_path / "state"), 3_000
    first = {"customers": [(k, "n", f"e{k}", None) for k in range(n)],
             "orders": [(k, k, 1, None, "Completed", None) for k in range(n)],
             "payments": [(k, k, None, None, "Paid") for k in range(n)]}
    arrive(spark, tmp_path / "in", first)
    run(spark, tmp_path / "in", state, buckets=64)
    second = {"customers": [], "orders": [], "payments": [(n, n + 7, None, None, "Paid")]}
    arrive(spark, tmp_path / "in", second)
    run(spark, tmp_path / "in", state, buckets=64)
    read = {(r.batch, r.measure): r.value for r in batches_done(spark, state).collect()}
    last = max(batch for batch, _ in read)
    assert read[0, "arrivals"] == 3 * n and read[0, "rows_read"] == 0
    assert read[last, "arrivals"] == 1 and 0 < read[last, "rows_read"] < n / 64 * 4
    both = {role: first[role] + second[role] for role in ROLES}
    assert sorted(tuples(current_scorecard(spark, state))) == full(spark, both)
    batch = ledger_arrivals(*[spark.createDataFrame(second[role], ROLE_SCHEMAS[role]) for role in ROLES])
    for _ in range(2):
        incremental._apply(spark, state, 64, batch, last)
        assert sorted(tuples(current_scorecard(spark, state))) == full(spark, both)


def test_before_the_first_arrival(spark, tmp_path):
    arrive(spark, tmp_path / "in", {})
    run(spark, tmp_path / "in", str(tmp_path / "state"))
    nothing = [(t, 0, 0, None, None) for t in ROLES]
    if (tmp_path / "state" / "manifest").exists():
        assert sorted(tuples(current_scorecard(spark, str(tmp_path / "state")))) == nothing


def test_replaced_buckets_are_removed(spark, tmp_path):
    state = tmp_path / "state"
    for k in range(4):
        arrive(spark, tmp_path / "in", {"customers": [(k, None, "same", None)]})
        run(spark, tmp_path / "in", str(state))
    kept = sorted(p.parent.name for p in (state / "emails").glob("batch=*/bucket=*"))
    assert len(kept) <= 3 and "batch=0" not in kept
    assert tuples(current_scorecard(spark, str(state)).where("table_name = 'customers'"), "total", "bad") == [(4, 4)]
