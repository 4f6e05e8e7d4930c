"""The scorecard kept up by deltas: an arrival touches its own email, order and customer, not the whole ledger.

Three tables are kept by key (``keyed_state``):

* ``emails``: customers and missing names by email;
* ``orders``: orders (by customer, missing total, completed) and payments by order id, payments before their order included;
* ``customers``: whether a customer is known, and orders, and those bad by themselves, by customer id.

A batch is summed up by key, added to the buckets it falls into, and the difference these buckets make to the scorecard is
added to its running totals. Orders pass on to ``customers`` what changed by customer, so a customer that arrives late, or an
order's first payment, sets right what was counted before. The totals equal the full audit of all rows so far, however they
were split into batches.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StreamingQuery

from ledgersift.functions.expressions import rows, tally
from ledgersift.model import COMPLETED
from ledgersift.plans.scorecard import scored
from ledgersift.streaming.keyed_state import (KeyedTable, Manifest, advance, merged, read_manifest, remove_replaced,
                                              write_manifest)

TOTALS = ("customers", "bad_customers", "orders", "bad_orders", "payments", "bad_payments")
_ORDER_KEYS = ["order_id", "customer_id", "total_null", "completed"]


def ledger_arrivals(customers: DataFrame, orders: DataFrame, payments: DataFrame) -> DataFrame:
    """One stream of the three tables' new rows, with the columns the scorecard depends on."""
    parts = [customers.select(F.lit("customer").alias("role"), "customer_id", "email",
                              F.col("name").isNull().alias("name_null")),
             orders.select(F.lit("order").alias("role"), "customer_id", "order_id",
                           F.col("total_amount").isNull().alias("total_null"),
                           F.coalesce(F.col("status") == COMPLETED, F.lit(False)).alias("completed")),
             payments.select(F.lit("payment").alias("role"), "order_id")]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _tables(path: str, buckets: int) -> tuple[KeyedTable, KeyedTable, KeyedTable]:
    return (KeyedTable(path, "emails", "email", "email string, n long, name_null long", buckets),
            KeyedTable(path, "orders", "order_id", "order_id long, customer_id long, total_null boolean, "
                       "completed boolean, n long, payments long", buckets),
            KeyedTable(path, "customers", "customer_id", "customer_id long, known long, n long, own_fault long", buckets))


def _sums(df: DataFrame, **measures: Column) -> dict[str, int]:
    """Sums over a frame, 0 where it is empty."""
    row = df.agg(*[F.sum(c).alias(name) for name, c in measures.items()]).first()
    return {name: row[name] or 0 for name in measures}


def _email_sums(emails: DataFrame) -> dict[str, int]:
    shared = F.col("email").isNotNull() & (F.col("n") > 1)
    return _sums(emails, state=F.lit(1), customers=F.col("n"),
                 bad_customers=F.when(shared, F.col("n")).otherwise(F.col("name_null")))


def _with_partners(orders: DataFrame) -> DataFrame:
    """Rows of ``orders`` plus how many orders and payments their id has; a missing id matches nothing."""
    found = F.col("order_id").isNotNull()
    same = W.partitionBy("order_id", F.when(~found, F.xxhash64("customer_id")))
    return orders.select("*", F.when(found, F.sum("n").over(same)).otherwise(F.lit(0)).alias("_orders"),
                         F.when(found, F.sum("payments").over(same)).otherwise(F.lit(0)).alias("_payments"))


def _by_customer(orders: DataFrame, sign: int) -> DataFrame:
    fault = F.col("total_null") | (F.col("completed") & (F.col("_payments") == 0))
    return _with_partners(orders).where("n <> 0").select(
        "customer_id", (F.lit(sign) * F.col("n")).alias("n"),
        (F.lit(sign) * F.when(fault, F.col("n")).otherwise(F.lit(0))).alias("own_fault"))


def _payment_sums(orders: DataFrame) -> dict[str, int]:
    return _sums(_with_partners(orders), state=F.lit(1), payments=F.col("payments"),
                 bad_payments=F.when(F.col("_orders") == 0, F.col("payments")).otherwise(F.lit(0)))


def _customer_sums(customers: DataFrame) -> dict[str, int]:
    known = F.col("customer_id").isNotNull() & (F.col("known") > 0)
    return _sums(customers, state=F.lit(1), orders=F.col("n"),
                 bad_orders=F.when(known, F.col("own_fault")).otherwise(F.col("n")))


def _apply(spark: SparkSession, path: str, buckets: int, arrivals: DataFrame, batch: int) -> None:
    """Adds one batch of arrivals to the state under ``path``."""
    before = read_manifest(spark, path, batch - 1)
    remove_replaced(spark, path, read_manifest(spark, path, batch - 2))
    emails, orders, customers = _tables(path, buckets)
    versions, replaced, measures = dict(before.versions), [], dict(before.measures)
    measures |= {"arrivals": arrivals.count(), "rows_read": 0}

    def step(table: KeyedTable, delta: DataFrame, by: list[str], sums) -> tuple[DataFrame, DataFrame]:
        """Merges a delta into its table and the running totals; the touched buckets before and after."""
        touched = table.touched(delta)
        old = table.read(spark, before.versions.get(table.name, {}), touched)
        new = table.write(merged(old, delta, by), batch)
        was, now = sums(old), sums(new)
        measures["rows_read"] += was["state"]
        for name in now:
            if name != "state":
                measures[name] = measures.get(name, 0) + now[name] - was[name]
        versions[table.name], gone = advance(before, table, touched, batch)
        replaced.extend(gone)
        return old, new

    people = arrivals.where("role = 'customer'")
    step(emails, people.groupBy("email").agg(rows().alias("n"), F.sum(tally(F.col("name_null"))).alias("name_null")),
         ["email"], _email_sums)
    zero = F.lit(0).cast("long")
    bought = (arrivals.where("role = 'order'").groupBy(*_ORDER_KEYS).agg(rows().alias("n"))
              .withColumn("payments", zero))
    paid = (arrivals.where("role = 'payment'").groupBy("order_id").agg(rows().alias("payments")).withColumn("n", zero))
    old, new = step(orders, bought.unionByName(paid, allowMissingColumns=True), _ORDER_KEYS, _payment_sums)
    moved = (_by_customer(new, 1).unionByName(_by_customer(old, -1)).groupBy("customer_id")
             .agg(F.sum("n").alias("n"), F.sum("own_fault").alias("own_fault")).where("n <> 0 OR own_fault <> 0"))
    moved.write.mode("overwrite").parquet(f"{path}/moved/batch={batch}")
    moved = spark.read.schema("customer_id long, n long, own_fault long").parquet(f"{path}/moved/batch={batch}")
    known = people.groupBy("customer_id").agg(rows().alias("known"))
    delta = (known.unionByName(moved, allowMissingColumns=True)
             .select("customer_id", *[F.coalesce(c, zero).alias(c) for c in ("known", "n", "own_fault")]))
    step(customers, delta, ["customer_id"], _customer_sums)
    write_manifest(spark, path, batch, Manifest(versions, tuple(replaced), measures))


def incremental_scorecard(arrivals: DataFrame, path: str, *, buckets: int = 1024) -> StreamingQuery:
    """Adds all arrivals since the last run to the state under ``path``, then stops.

    The stream's checkpoint lies beside the state, since batches are numbered by it; one folder serves one job.
    """
    def add(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            _apply(batch.sparkSession, path, buckets, batch, number)
        finally:
            batch.unpersist()

    return (arrivals.writeStream.foreachBatch(add).option("checkpointLocation", f"{path}/checkpoint")
            .trigger(availableNow=True).start())


def batches_done(spark: SparkSession, path: str) -> DataFrame:
    """batch, measure, value: what each batch counted (arrivals, rows_read) and the totals after it."""
    return spark.read.schema("measure string, value long, batch int").parquet(f"{path}/manifest").where(
        "measure IS NOT NULL").select("batch", "measure", "value")


def current_scorecard(spark: SparkSession, path: str) -> DataFrame:
    """table_name, total, bad, pct, score after the last batch; before the first all tables are empty."""
    done = batches_done(spark, path)
    last = done.agg(F.max("batch").alias("last"))
    total = {m: F.coalesce(F.max(F.when(F.col("measure") == m, F.col("value"))), F.lit(0).cast("long")).alias(m)
             for m in TOTALS}
    row = done.join(F.broadcast(last), F.col("batch") == F.col("last")).agg(*total.values())
    lines = F.array(*[F.struct(F.lit(t).alias("table_name"), F.col(t).alias("total"), F.col(f"bad_{t}").alias("bad"))
                      for t in ("customers", "orders", "payments")])
    return scored(row.select(F.inline(lines)))
