"""The follow-up audit: which defects of an earlier audit are solved, which are still open, and which are new.

A snapshot holds one row for each defect: the rule, the key of the row that breaks it and a fingerprint of that row's
values. Two snapshots are compared by rule and key, so an audit needs no earlier tables, only the snapshot that was
written then.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgersift.functions.expressions import rows
from ledgersift.model import PAID, Ledger
from ledgersift.operators.facts import order_facts, settlements
from ledgersift.operators.skew import resolve

NEW, SOLVED, OPEN, CHANGED = STATES = ("new", "solved", "open", "changed")
SNAPSHOT_SCHEMA = "rule string, key long, fingerprint long"

_CUSTOMER = ("customer_id", "name", "email")
_ORDER = ("order_id", "customer_id", "product_id", "order_date", "status", "total_amount")
_PAYMENT = ("payment_id", "paid_order_id", "payment_date", "payment_amount", "payment_status")


def _broken(df: DataFrame, key: str, values: tuple[str, ...], rules: dict[str, Column]) -> DataFrame:
    """One row for each rule that a row breaks: rule, key, fingerprint of the row's values (NULLs told apart from 0)."""
    marks = [F.coalesce(F.col(v).cast("string"), F.lit("\x1e")) for v in values]
    raised = F.array_compact(F.array(*[F.when(F.coalesce(fault, F.lit(False)), F.lit(name))
                                       for name, fault in rules.items()]))
    return (df.select(F.col(key).alias("key"), F.xxhash64(F.concat_ws("\x1f", *marks)).alias("fingerprint"),
                      raised.alias("rules"))
            .select(F.explode("rules").alias("rule"), "key", "fingerprint"))


def defects(ledger: Ledger) -> DataFrame:
    """Every defect of the ledger: rule, key, fingerprint.

    Three passes find all of them: customers by email, orders with what is known of each, payments with their order.
    A row that breaks several rules is several defects.
    """
    shared = (ledger.customers.where(F.col("email").isNotNull()).groupBy(F.col("email").alias("_email"))
              .agg(rows().alias("_n")).where("_n > 1"))
    customers = resolve(ledger.customers, shared, "email", "_email", found="shared", spread_by=["customer_id"],
                        policy=ledger.skew, unique_parent=True)
    amounts = (F.col("payment_status") == PAID) & (F.col("payment_amount") != F.col("total_amount"))
    return (_broken(customers, "customer_id", _CUSTOMER, {
        "email shared": F.col("shared"), "name missing": F.col("name").isNull(), "email missing": F.col("email").isNull()})
        .unionByName(_broken(order_facts(ledger), "order_id", _ORDER, {
            "customer unknown": ~F.col("customer_found"), "completed without payment": F.col("unpaid"),
            "total missing": F.col("total_amount").isNull(),
            "product inactive": F.col("product_active") == F.lit(False)}))
        .unionByName(_broken(settlements(ledger).where("payment_found"), "payment_id", _PAYMENT, {
            "order unknown": ~F.col("order_found"), "amount differs": F.col("order_found") & amounts})))


def write_snapshot(ledger: Ledger, run_date: date, path: str) -> None:
    """Keeps an audit's defects by run date; the same day again replaces only that day."""
    (defects(ledger).withColumn("run_date", F.lit(run_date)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("run_date").parquet(path))


def snapshot(spark: SparkSession, path: str, run_date: date) -> DataFrame:
    """The defects found on a day; the other days are not read."""
    kept = spark.read.schema(f"{SNAPSHOT_SCHEMA}, run_date date").parquet(path)
    return kept.where(F.col("run_date") == F.lit(run_date)).drop("run_date")


def follow_up(before: DataFrame, after: DataFrame) -> DataFrame:
    """rule, key, state of every defect of either snapshot: ``new``, ``solved``, ``open``, or ``changed`` where the row
    still breaks the rule with other values.

    Rows that share a key, or have none, are compared together, by their number and the sum of their fingerprints.
    """
    def by_key(df: DataFrame, side: str) -> DataFrame:
        return df.groupBy(F.col("rule").alias(f"{side}_rule"), F.col("key").alias(f"{side}_key")).agg(
            rows().alias(f"{side}_n"), F.sum(F.col("fingerprint").cast("decimal(38,0)")).alias(f"{side}_sum"))

    was, now = by_key(before, "was"), by_key(after, "now")
    both = was.join(now, F.col("was_rule").eqNullSafe(F.col("now_rule")) & F.col("was_key").eqNullSafe(F.col("now_key")),
                    "full")
    same = (F.col("was_n") == F.col("now_n")) & (F.col("was_sum") == F.col("now_sum"))
    state = (F.when(F.col("was_n").isNull(), F.lit(NEW)).when(F.col("now_n").isNull(), F.lit(SOLVED))
             .when(same, F.lit(OPEN)).otherwise(F.lit(CHANGED)))
    return both.select(F.coalesce("was_rule", "now_rule").alias("rule"), F.coalesce("was_key", "now_key").alias("key"),
                       state.alias("state"))


def follow_up_summary(compared: DataFrame) -> DataFrame:
    """rule and the number of its defects in each state."""
    return compared.groupBy("rule").agg(*[F.count_if(F.col("state") == s).alias(s) for s in STATES])
