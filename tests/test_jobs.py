"""Sources, sinks, the export runner, history and streaming jobs."""

from datetime import date, datetime
from decimal import Decimal as D
from types import SimpleNamespace

import pytest
from fixture import CUSTOMERS, ORDERS, PAYMENTS, PRODUCTS, ledger_of, mini_ledger, tuples
from pyspark.sql import functions as F

from ledgersift.__main__ import arguments, main
from ledgersift.model import ROLE_SCHEMAS, empty_ledger
from ledgersift.operators.controls import check_domain, check_fk, split_valid
from ledgersift.operators.facts import share_facts
from ledgersift.operators.nulls import check_not_null
from ledgersift.operators.skew import SkewPolicy
from ledgersift.plans import checks, history, impact, scorecard
from ledgersift.plans.catalogue import CHECKS, EXPORTS, Check
from ledgersift.session import shared_dir
from ledgersift.sinks.runner import failed, run_all
from ledgersift.sinks.writers import dated_path, write_result, write_split
from ledgersift.sources.readers import JdbcSource, read_csv, read_parquet, read_tables, with_key_ranges
from ledgersift.streaming.daily import any_arrival, scorecard_job
from ledgersift.streaming.unmatched import unpaid_orders, write_unpaid

DAY = date(2024, 1, 15)


@pytest.fixture(scope="module")
def ledger(spark):
    return mini_ledger(spark)


def test_export_run_writes_ten_dated_files(spark, ledger, tmp_path):
    for share in (False, True):
        done = run_all(spark, ledger, str(tmp_path / str(share)), day=DAY, share=share)
        rows = {r["name"]: (r["rows"], r["status"]) for r in done.collect()}
        assert rows == {name: (n, "OK") for name, n in zip(EXPORTS, (1, 2, 2, 2, 4, 4, 3, 3, 2, 10), strict=True)}
    path = dated_path(str(tmp_path / "True"), "07_data_quality_score", DAY)
    assert path.endswith("07_data_quality_score_20240115.csv")
    back = spark.read.option("header", True).csv(path)
    assert back.columns == list(EXPORTS["07_data_quality_score"].headers)
    assert [r["nombre_tabla"] for r in back.collect()] == ["customers", "orders", "payments"]
    assert len(list((tmp_path / "True" / "07_data_quality_score_20240115.csv").glob("part-*"))) == 1


def test_second_run_of_the_day_replaces_the_first(spark, ledger, tmp_path):
    only = {"02_ordenes_sin_cliente": EXPORTS["02_ordenes_sin_cliente"]}
    for _ in range(2):
        run_all(spark, ledger, str(tmp_path), day=DAY, kind="parquet", exports=only)
    assert spark.read.parquet(dated_path(str(tmp_path), "02_ordenes_sin_cliente", DAY, "parquet")).count() == 2


def test_a_failing_export_does_not_stop_the_rest(spark, ledger, tmp_path):
    def broken(_):
        raise RuntimeError("no such column")

    def fails_while_running(led):
        return led.orders.select(F.raise_error(F.lit("boom")).alias("x"))

    exports = {"a": Check(broken, lambda: []), "b": Check(fails_while_running, lambda: [F.asc("x")]),
               "c": Check(checks.orders_without_customer, lambda: [F.asc("order_id")])}
    done = run_all(spark, ledger, str(tmp_path), day=DAY, exports=exports)
    rows = {r["name"]: (r["rows"], r["status"][:5]) for r in done.collect()}
    assert rows == {"a": (0, "ERROR"), "b": (0, "ERROR"), "c": (2, "OK")}
    assert {r["name"] for r in failed(done).collect()} == {"a", "b"}


def test_shared_settlements_give_the_same_checks(spark, ledger, tmp_path):
    shared = share_facts(ledger, str(tmp_path))
    for check in (checks.orders_without_customer, checks.completed_without_payment, checks.orphan_payments,
                  checks.amount_mismatches, checks.amount_mismatch_summary, scorecard.revenue_at_risk,
                  scorecard.quality_score):
        assert sorted(map(repr, tuples(check(shared)))) == sorted(map(repr, tuples(check(ledger))))


def test_parts_are_sorted_one_by_one(spark, ledger, tmp_path):
    only = {"02_ordenes_sin_cliente": EXPORTS["02_ordenes_sin_cliente"]}
    for sort in ("parts", "none"):
        done = run_all(spark, ledger, str(tmp_path / sort), day=DAY, exports=only, sort_details=sort)
        assert tuples(done, "rows", "status") == [(2, "OK")]
    assert "rangepartitioning" not in str(
        EXPORTS["02_ordenes_sin_cliente"].sorted(ledger, "parts")._jdf.queryExecution().executedPlan().toString())


def test_unknown_kind_is_refused(spark, ledger, tmp_path):
    with pytest.raises(ValueError, match="unknown result kind"):
        write_result(ledger.orders, str(tmp_path / "x"), "xlsx")


def test_csv_and_parquet_sources(spark, ledger, tmp_path):
    for role in ROLE_SCHEMAS:
        getattr(ledger, role).write.option("header", True).csv(str(tmp_path / "c" / f"{role}.csv"))
        getattr(ledger, role).write.parquet(str(tmp_path / "p" / role))
        spark.read.parquet(str(tmp_path / "p" / role)).createOrReplaceTempView(f"t_{role}")
    expected = sorted(tuples(scorecard.quality_score(ledger)))
    sources = (read_csv(spark, str(tmp_path / "c")), read_parquet(spark, str(tmp_path / "p")),
               read_tables(spark, {r: f"t_{r}" for r in ROLE_SCHEMAS}))
    for source in sources:
        assert sorted(tuples(scorecard.quality_score(source))) == expected


def test_jdbc_options_split_by_primary_key():
    source = JdbcSource("jdbc:postgresql://db/ledger", {"user": "u"}, {"orders": "sales.orders"},
                        {"orders": (1, 1000)}, partitions=8)
    assert source.options("orders") == {
        "url": "jdbc:postgresql://db/ledger", "dbtable": "sales.orders", "fetchsize": "10000",
        "preferTimestampNTZ": "true", "user": "u",
        "partitionColumn": "order_id", "lowerBound": "1", "upperBound": "1001", "numPartitions": "8"}
    assert "partitionColumn" not in source.options("payments")


def test_jdbc_ranges_are_asked_for_every_role():
    asked = []

    def ask(options):
        asked.append(options["query"])
        return (None, None) if "products" in options["query"] else (5, 900)

    plain = JdbcSource("jdbc:postgresql://db/ledger", {"user": "u"}, {"orders": "sales.orders"})
    source = with_key_ranges(plain, ask)
    assert "SELECT MIN(order_id) AS low, MAX(order_id) AS high FROM sales.orders" in asked and len(asked) == 4
    for role in ("customers", "orders", "payments"):
        assert source.options(role)["numPartitions"] == "64" and source.options(role)["upperBound"] == "901"
    assert "numPartitions" not in source.options("products")
    full = with_key_ranges(plain, lambda options: (5, 900))
    assert all("numPartitions" in full.options(role) for role in ROLE_SCHEMAS)


def test_controls(spark, ledger):
    assert [r["order_id"] for r in check_domain(ledger.orders, "status", ["Completed", "Pending"]).collect()] == [8]
    nulls = ledger.orders.withColumn("status", F.lit(None).cast("string"))
    assert check_domain(nulls, "status", ["Completed"]).count() == 0
    assert tuples(check_fk(ledger.orders, ledger.customers, "customer_id", "customer_id"), "order_id") == [(3,)]
    broken = check_not_null(ledger.customers, ["name", "email"]).collect()
    assert {r["customer_id"]: r["violations"] for r in broken} == {
        3: ["name"], 4: ["name", "email"], 5: ["email"]}


def test_split_is_a_partition(spark, ledger, tmp_path):
    rules = {"null_total": F.col("total_amount").isNull(), "no_customer": F.col("customer_id").isNull()}
    clean, quarantine = split_valid(ledger.orders, rules)
    assert {r["order_id"]: r["broken_rules"] for r in quarantine.collect()} == {
        4: ["no_customer"], 5: ["null_total"]}
    assert clean.count() + quarantine.count() == len(ORDERS)
    assert clean.columns == ledger.orders.columns
    write_split(ledger.orders, rules, str(tmp_path / "split"))
    back = spark.read.parquet(str(tmp_path / "split"))
    assert sorted(tuples(back.groupBy("verdict").count())) == [("clean", 7), ("quarantine", 2)]


def test_score_history(spark, ledger, tmp_path):
    path = str(tmp_path / "history")
    early = ledger_of(spark, CUSTOMERS[:2], PRODUCTS, ORDERS[:2], PAYMENTS[:3])
    history.append_scorecard(early, date(2024, 1, 1), path)
    history.append_scorecard(ledger, date(2024, 1, 2), path)
    history.append_scorecard(ledger, date(2024, 1, 2), path)
    runs = spark.read.parquet(path)
    assert runs.count() == 6
    change = history.score_change(runs.where("run_date = '2024-01-01'"), runs.where("run_date = '2024-01-02'"))
    assert sorted(tuples(change, "table_name", "score_before", "score_after", "score_delta")) == [
        ("customers", 100.0, 50.0, -50.0), ("orders", 100.0, 55.56, -44.44), ("payments", 100.0, 77.78, -22.22)]
    only_old = history.score_change(runs.where("run_date = '2024-01-01' and table_name = 'orders'"),
                                    runs.where("false"))
    assert tuples(only_old, "table_name", "score_after") == [("orders", None)]


def test_daily_job_audits_only_when_files_arrived(spark, ledger, tmp_path):
    arrivals, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def run():
        stream = spark.readStream.schema(ROLE_SCHEMAS["orders"]).parquet(arrivals)
        scorecard_job(stream, lambda: ledger, out, state, "2024-01-15").awaitTermination()
        return spark.read.parquet(out)

    ledger.orders.write.parquet(arrivals)
    assert run().count() == 3
    assert run().count() == 3
    ledger.orders.write.mode("append").parquet(arrivals)
    assert run().count() == 3
    assert [str(d) for (d,) in tuples(run().select("run_date").distinct())] == ["2024-01-15"]


def test_daily_job_starts_on_arrivals_in_any_table(spark, ledger, tmp_path):
    for role in ("customers", "payments"):
        getattr(ledger, role).limit(0 if role == "payments" else 10).write.parquet(str(tmp_path / role))
    streams = [spark.readStream.schema(ROLE_SCHEMAS[r]).parquet(str(tmp_path / r)) for r in ("customers", "payments")]
    out = str(tmp_path / "out")
    scorecard_job(any_arrival(*streams), lambda: ledger, out, str(tmp_path / "state"), "2024-01-15").awaitTermination()
    assert spark.read.parquet(out).count() == 3


def test_as_of_keeps_undated_rows(spark):
    rows = [(1, 1, 1, None, "Completed", D("5.00")), (2, 1, 1, datetime(2024, 1, 2), "Completed", D("5.00")),
            (3, 1, 1, datetime(2024, 3, 2), "Completed", D("5.00"))]
    early = history.as_of(ledger_of(spark, orders=rows), "2024-02-01 00:00:00")
    assert sorted(tuples(early.orders, "order_id")) == [(1,), (2,)]


def test_streamed_unpaid_orders_wait_for_the_watermark(spark, tmp_path):
    orders, payments, out, state = (str(tmp_path / n) for n in ("orders", "payments", "out", "state"))

    def arrive(order_rows, payment_rows):
        led = ledger_of(spark, orders=order_rows, payments=payment_rows)
        led.orders.coalesce(1).write.mode("append").parquet(orders)
        led.payments.coalesce(1).write.mode("append").parquet(payments)
        streams = [spark.readStream.schema(ROLE_SCHEMAS[r]).parquet(p)
                   for r, p in (("orders", orders), ("payments", payments))]
        write_unpaid(unpaid_orders(*streams, within="10 days", lateness="0 days"), out, state).awaitTermination()
        return sorted(i for (i,) in tuples(spark.read.parquet(out), "order_id"))

    def at(month, d):
        return datetime(2024, month, d)

    first = [(1, 1, 1, at(1, 1), "Completed", D("5.00")), (2, 1, 1, at(1, 2), "Completed", D("5.00")),
             (3, 1, 1, at(1, 2), "Pending", D("5.00")), (9, 1, 1, at(1, 5), "Completed", D("1.00")),
             (5, 1, 1, None, "Completed", D("2.00"))]  # undated: shows up as it arrives
    assert arrive(first, [(1, 1, at(1, 3), D("5.00"), "Failed"), (2, 9, at(1, 5), D("1.00"), "Paid")]) == [5]
    later = [(10, 1, 1, at(3, 1), "Completed", D("1.00"))]
    assert arrive(later, [(3, 10, at(3, 1), D("1.00"), "Paid")]) == [2, 5]


def test_projection_by_period(spark, ledger):
    risk = scorecard.revenue_at_risk(ledger)
    assert tuples(impact.annual_projection(risk)) == [("optimistic", 6.0, D("4260.00")),
                                                      ("conservative", 12.0, D("8520.00"))]
    assert tuples(impact.growth_projection(risk), "amount") == [(D("5716.92"),)]
    assert sorted(tuples(impact.risk_shares(risk), "share_pct")) == [(1.4,), (14.1,), (28.2,), (56.3,)]


class FakeSession:
    """Settings and master of a session, without one."""

    def __init__(self, master, **settings):
        self.settings = settings
        self.conf = self
        self.sparkContext = SimpleNamespace(master=master)

    def get(self, key, default):
        return self.settings.get(key, default)

    def set(self, key, value):
        self.settings[key] = value


def test_shared_folder_is_the_named_one():
    named = FakeSession("yarn", **{"spark.checkpoint.dir": "hdfs://shared"})
    assert shared_dir(named) == "hdfs://shared"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(FakeSession("yarn"))
    local = FakeSession("local[2]")
    assert shared_dir(local) == shared_dir(local)


def test_command_line(spark, ledger, tmp_path, capfd):
    for role in ROLE_SCHEMAS:
        getattr(ledger, role).write.parquet(str(tmp_path / "in" / role))
    source = ["--parquet", str(tmp_path / "in")]
    assert main(["report", *source], spark) == 0
    assert main(["export", *source, "--out", str(tmp_path / "out"), "--kind", "parquet"], spark) == 0
    written = [p.name for p in (tmp_path / "out").iterdir()]
    assert len([name for name in written if not name.startswith("manifest_")]) == len(EXPORTS) == len(written) - 1
    shown = capfd.readouterr().out
    assert "61.11%" in shown and "10_auditoria_consolidada" in shown
    with pytest.raises(SystemExit):
        arguments(["export", "--out", "x"])


def test_empty_ledger_exports(spark, tmp_path):
    done = run_all(spark, empty_ledger(spark), str(tmp_path), day=DAY)
    assert failed(done).count() == 0


def test_shared_facts_hold_under_hot_keys(spark, tmp_path):
    split = mini_ledger(spark, skew=SkewPolicy(rows_per_task=1, max_hot_keys=2))
    shared = share_facts(split, str(tmp_path))
    assert {k for (k,) in tuples(shared.hot("payments", "order_id"), "hot_key")} == {2}
    for name, check in CHECKS.items():
        assert list(map(repr, tuples(check.ordered(shared)))) == list(map(repr, tuples(check.ordered(split)))), name
