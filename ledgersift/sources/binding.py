"""Binds the four ledger roles to the star-schema test tables, with deterministic defects.

The driver tables hold no NULLs, orphans or shared names, so the detectors would find nothing.
The rules below (spelled out in FIXTURES.md) derive a ledger with every kind of defect from them.
Scans stay lazy: a query that reads two columns of a bound table reads only what they come from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgersift.model import Ledger

FAR_AWAY = 1_000_000_000


# The driver's tables; stating their types saves a job per table to infer them.
SOURCE_SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SOURCE_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same table as a file stream."""
    return (spark.readStream.schema(SOURCE_SCHEMAS[name]).option("pathGlobFilter", f"{name}.parquet")
            .parquet(sf_dir))


def bound_customers(customer: DataFrame, orders: DataFrame) -> DataFrame:
    first_order = orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("created_at"))
    owner = F.expr("CASE WHEN c_custkey % 10 = 9 THEN c_custkey - 9 ELSE c_custkey END")
    return (customer.join(first_order, F.col("c_custkey") == F.col("o_custkey"), "left")
            .select(F.col("c_custkey").alias("customer_id"),
                    F.expr("CASE WHEN c_custkey % 17 = 3 THEN NULL ELSE c_name END").alias("name"),
                    F.when(F.expr("c_custkey % 29 = 5"), F.lit(None))
                    .otherwise(F.concat(F.lit("user"), owner.cast("string"), F.lit("@example.com")))
                    .alias("email"),
                    "created_at"))


def bound_products(part: DataFrame) -> DataFrame:
    return part.select(
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"),
        F.col("p_retailprice").cast("decimal(12,2)").alias("price"),
        F.expr("CASE WHEN p_partkey % 40 = 7 THEN NULL ELSE p_size <= 45 END").alias("active"))


def bound_orders(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    first_part = lineitem.groupBy("l_orderkey").agg(F.min("l_partkey").alias("product_id"))
    return (orders.join(first_part, F.col("o_orderkey") == F.col("l_orderkey"), "left")
            .select(F.col("o_orderkey").alias("order_id"),
                    F.expr(f"CASE WHEN o_orderkey % 61 = 7 THEN NULL "
                           f"WHEN o_orderkey % 37 = 0 THEN o_custkey + {FAR_AWAY} "
                           f"ELSE o_custkey END").alias("customer_id"),
                    "product_id",
                    F.expr("CASE WHEN o_orderkey % 79 <> 6 THEN o_orderdate END").alias("order_date"),
                    F.expr("CASE WHEN o_orderkey % 59 = 4 THEN 'Shipped' WHEN o_orderkey % 43 = 11 THEN 'Cancelled' "
                           "WHEN o_orderstatus = 'F' THEN 'Completed' "
                           "WHEN o_orderstatus = 'O' THEN 'Pending' ELSE 'Processing' END").alias("status"),
                    F.expr("CASE WHEN o_orderkey % 53 = 0 THEN NULL "
                           "ELSE CAST(o_totalprice AS DECIMAL(12,2)) END").alias("total_amount")))


def bound_payments(orders: DataFrame) -> DataFrame:
    priced = orders.withColumn("t", F.col("o_totalprice").cast("decimal(12,2)"))
    main = priced.where("o_orderkey % 23 <> 1").select(
        F.expr("o_orderkey * 2").alias("payment_id"),
        F.expr(f"CASE WHEN o_orderkey % 97 = 13 THEN o_orderkey + {FAR_AWAY} "
               f"ELSE o_orderkey END").alias("order_id"),
        F.col("o_orderdate").alias("payment_date"),
        F.expr("CASE WHEN o_orderkey % 83 = 2 THEN NULL "
               "WHEN o_orderkey % 19 = 4 THEN CAST(t - 100.25 AS DECIMAL(12,2)) "
               "WHEN o_orderkey % 31 = 8 THEN CAST(t + 50.50 AS DECIMAL(12,2)) "
               "ELSE t END").alias("payment_amount"),
        F.expr("CASE WHEN o_orderkey % 67 = 9 THEN 'Refunded' WHEN o_orderkey % 13 = 6 THEN 'Failed' "
               "WHEN o_orderkey % 13 = 9 THEN 'Pending' ELSE 'Paid' END").alias("payment_status"))
    part_payment = orders.where("o_orderkey % 71 = 5").select(
        F.expr("o_orderkey * 2 + 1").alias("payment_id"), F.col("o_orderkey").alias("order_id"),
        F.col("o_orderdate").alias("payment_date"),
        F.expr("CAST(10.00 AS DECIMAL(12,2))").alias("payment_amount"),
        F.lit("Paid").alias("payment_status"))
    return main.unionByName(part_payment)


def bound_ledger(spark: SparkSession, sf_dir: str, **options) -> Ledger:
    """The test ledger over ``<sf_dir>/*.parquet``."""
    orders = table(spark, sf_dir, "orders")
    return Ledger.of(
        customers=bound_customers(table(spark, sf_dir, "customer"), orders),
        products=bound_products(table(spark, sf_dir, "part")),
        orders=bound_orders(orders, table(spark, sf_dir, "lineitem")),
        payments=bound_payments(orders),
        **options)
