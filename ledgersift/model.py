"""The four ledger roles, their schemas, and the frame bundle the operators work on."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgersift.functions.labels import ENGLISH, Labels
from ledgersift.operators.skew import NO_HOT_KEYS, HotKeys, SkewPolicy, hot_keys

MONEY = T.DecimalType(12, 2)

ROLE_SCHEMAS: dict[str, T.StructType] = {
    "customers": T.StructType([
        T.StructField("customer_id", T.LongType(), False),
        T.StructField("name", T.StringType()),
        T.StructField("email", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
    ]),
    "products": T.StructType([
        T.StructField("product_id", T.LongType(), False),
        T.StructField("product_name", T.StringType(), False),
        T.StructField("price", MONEY, False),
        T.StructField("active", T.BooleanType()),
    ]),
    "orders": T.StructType([
        T.StructField("order_id", T.LongType(), False),
        T.StructField("customer_id", T.LongType()),
        T.StructField("product_id", T.LongType()),
        T.StructField("order_date", T.TimestampNTZType()),
        T.StructField("status", T.StringType()),
        T.StructField("total_amount", MONEY),
    ]),
    "payments": T.StructType([
        T.StructField("payment_id", T.LongType(), False),
        T.StructField("order_id", T.LongType()),
        T.StructField("payment_date", T.TimestampNTZType()),
        T.StructField("payment_amount", MONEY),
        T.StructField("payment_status", T.StringType()),
    ]),
}

# The two status domains of the data model.
ORDER_STATUSES = ("Pending", "Processing", "Completed", "Cancelled")
PAYMENT_STATUSES = ("Paid", "Failed", "Pending")

FOREIGN_KEYS = (("orders", "customer_id"), ("orders", "product_id"), ("payments", "order_id"))

COMPLETED = "Completed"
PAID = "Paid"


class SchemaError(ValueError):
    """A bound table lacks a column its role needs."""


def conform(df: DataFrame, role: str) -> DataFrame:
    """Select the columns of a role and cast them to the role's types."""
    schema = ROLE_SCHEMAS[role]
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise SchemaError(f"{role}: missing column(s) {', '.join(missing)}")
    bound = {f.name: f.dataType for f in df.schema}
    return df.select([
        F.col(f.name) if bound[f.name] == f.dataType else F.col(f.name).cast(f.dataType).alias(f.name)
        for f in schema
    ])


@dataclass(frozen=True)
class Ledger:
    """Customers, products, orders and payments, plus how to word results and treat hot keys.

    ``settled`` optionally holds ``facts.settlements`` of this ledger, already written out; the
    checks that reconcile orders with payments then filter it instead of joining again.
    ``lost_customers`` likewise holds the customer ids that orders name in vain.
    ``paid`` likewise holds ``consolidated.paid_orders`` of all orders.
    ``counted`` likewise holds hot keys already found (see ``facts.share_facts``), and ``sizes``
    the row counts of ``measured``.
    """

    customers: DataFrame
    products: DataFrame
    orders: DataFrame
    payments: DataFrame
    labels: Labels = ENGLISH
    skew: SkewPolicy = field(default_factory=SkewPolicy)
    settled: DataFrame | None = None
    lost_customers: DataFrame | None = None
    paid: DataFrame | None = None
    counted: Mapping[tuple[str, str], HotKeys] = field(default_factory=dict)
    sizes: Mapping[str, int] = field(default_factory=dict)

    @classmethod
    def of(cls, customers: DataFrame, products: DataFrame, orders: DataFrame, payments: DataFrame,
           **options) -> Ledger:
        """Bind any four tables to the roles; names and types are checked here."""
        return cls(conform(customers, "customers"), conform(products, "products"),
                   conform(orders, "orders"), conform(payments, "payments"), **options)

    def measured(self) -> Ledger:
        """The ledger with its row counts known: one job, which reads file footers where it can.

        A table no larger than one task's share has no hot keys, and a small parent may be
        broadcast, so the checks then plan without counting keys. Larger tables keep the general
        plans. Without this call nothing runs before a result is used.
        """
        parts = [getattr(self, role).agg(F.count(F.lit(1)).alias("n")).select(F.lit(role).alias("role"), "n")
                 for role in ROLE_SCHEMAS]
        return replace(self, sizes={r["role"]: r["n"] for r in reduce(DataFrame.unionByName, parts).collect()})

    def small(self, role: str) -> bool:
        """Known to be small enough to broadcast."""
        return self.sizes.get(role, self.skew.broadcast_rows + 1) <= self.skew.broadcast_rows

    def hot(self, role: str, key: str) -> HotKeys:
        """Hot values of a foreign key, counted on its own table: one narrow scan, however large
        the plan that looks the key up."""
        if (role, key) in self.counted:
            return self.counted[role, key]
        if self.sizes.get(role, self.skew.rows_per_task + 1) <= self.skew.rows_per_task:
            return NO_HOT_KEYS
        return hot_keys(getattr(self, role), key, self.skew)

    def worded(self, labels: Labels) -> Ledger:
        return replace(self, labels=labels)


def empty_ledger(spark: SparkSession) -> Ledger:
    """A ledger whose four tables have no rows."""
    return Ledger(**{role: spark.createDataFrame([], schema) for role, schema in ROLE_SCHEMAS.items()})
