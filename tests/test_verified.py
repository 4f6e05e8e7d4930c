"""Files that can be checked, and the whole report."""

from dataclasses import replace
from datetime import date, datetime
from decimal import Decimal as D

import pytest
from fixture import mini_ledger, tuples
from pyspark.sql import functions as F

from ledgersift.model import empty_ledger
from ledgersift.plans import report
from ledgersift.plans.catalogue import EXPORTS, Check
from ledgersift.sinks.runner import run_all
from ledgersift.sinks.verified import Written, read_manifest, read_result, verify, write_manifest, write_verified

DAY = date(2024, 1, 15)


def states(spark, folder):
    return {r["name"]: r.status for r in verify(spark, str(folder), DAY).collect()}


@pytest.mark.parametrize("kind", ["csv", "parquet"])
def test_a_run_can_be_checked_and_damage_is_found(spark, tmp_path, kind):
    def broken(_):
        raise RuntimeError("boom")

    few = {name: EXPORTS[name] for name in ("02_ordenes_sin_cliente", "05_diferencia_monetaria", "07_data_quality_score")}
    done = run_all(spark, mini_ledger(spark), str(tmp_path), day=DAY, kind=kind, exports=few | {"x": Check(broken, list)})
    checked = {r["name"]: r for r in verify(spark, str(tmp_path), DAY).collect()}
    assert {n: (r.rows, r.digest) for n, r in checked.items()} == {r["name"]: (r.rows, r.digest) for r in done.collect()}
    assert {n: r.status for n, r in checked.items()} == dict.fromkeys(few, "OK") | {"x": "ERROR: boom"}
    assert checked["07_data_quality_score"].header == ",".join(EXPORTS["07_data_quality_score"].headers)
    # Another order and other parts of the same rows are the same file; other rows, a lost one or a lost file are not.
    path = str(next(p for p in tmp_path.iterdir() if p.name.startswith("02_")))
    rows = read_result(spark, path, kind)
    kept = [tuple(r) for r in rows.collect()]

    def put(new):
        df = spark.createDataFrame(new, ", ".join(f"`{c}` string" for c in rows.columns)).repartition(3)
        write_verified(df, "x", path, kind)

    put(kept[::-1])
    assert states(spark, tmp_path)["02_ordenes_sin_cliente"] == "OK"
    put([("9", *kept[0][1:]), *kept[1:]])
    assert states(spark, tmp_path)["02_ordenes_sin_cliente"] == "CHANGED"
    put(kept[1:])
    assert states(spark, tmp_path)["02_ordenes_sin_cliente"] == "CHANGED"
    entries = [Written(*r) for r in read_manifest(spark, str(tmp_path), DAY).collect()]
    write_manifest(spark, [replace(e, path=f"{e.path}-gone") if e.name.startswith("05_") else e for e in entries],
                   str(tmp_path), DAY)
    assert states(spark, tmp_path) == {"02_ordenes_sin_cliente": "CHANGED", "05_diferencia_monetaria": "MISSING",
                                       "07_data_quality_score": "OK", "x": "ERROR: boom"}


def test_odd_texts_survive_a_csv_file(spark, tmp_path):
    rows = [(1, ' "quoted", with comma '), (2, ""), (3, None), (4, "two\nlines"), (5, "back\\slash"), (6, "  "), (7, "é\t")]
    df = spark.createDataFrame(rows, "id long, text string")
    for name, part in (("all", df), ("none", df.where("false"))):
        written = write_verified(part, name, str(tmp_path / name), single_file=True)
        back = read_result(spark, written.path, "csv")
        assert sorted(tuples(back)) == sorted((str(i), t) for i, t in (tuples(part)))
        assert written.rows == part.count() and written.header == "id,text"


def test_unknown_kind_is_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="unknown result kind"):
        write_verified(spark.range(1), "x", str(tmp_path / "x"), "xlsx")


def test_the_whole_report(spark):
    made = datetime(2024, 1, 15, 6, 30)
    got = report.full_report(mini_ledger(spark), made).collect()
    head = {r.metric: r.value_text for r in got if r.section == 0}
    assert head == {"generated": "2024-01-15 06:30:00", "scope": "Customers, Products, Orders, Payments",
                    "period from": "2024-01-01", "period to": "2024-01-09"}
    assert [(r.metric, r.value_num, r.value_text) for r in got if r.kind == "detail"] == [("a@x", D("2.00"), "Ana")]
    figures = tuples(report.sectioned_report(mini_ledger(spark)))
    assert sorted(map(str, figures)) == sorted(str(tuple(r)) for r in got if r.section > 0 and r.kind != "detail")
    nothing = report.full_report(empty_ledger(spark), made)
    assert {r.metric: r.value_text for r in nothing.where(F.col("section") == 0).collect()}["period to"] == "N/A"
    assert nothing.where("kind = 'detail'").isEmpty()
