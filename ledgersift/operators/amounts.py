"""Amounts that disagree between a parent and its children."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgersift.functions.expressions import MONEY_SUM, money, rows
from ledgersift.functions.labels import ENGLISH, Labels
from ledgersift.operators.skew import COUNT_THEM, HotKeys, SkewPolicy, expand


def amount_mismatch(parent: DataFrame, child: DataFrame, pk: str, fk: str, expected: str, actual: str,
                    predicate: Column | None = None, *, child_id: str, labels: Labels = ENGLISH,
                    policy: SkewPolicy | None = None, hot: HotKeys = COUNT_THEM) -> DataFrame:
    """Parent columns, child columns, diff (actual - expected), diff_type and diff_pct.

    One row per child row that disagrees; two part payments that sum to the total are two
    rows. A NULL on either side is not a disagreement, and diff_pct of a zero total is NULL.
    """
    paid = child if predicate is None else child.where(predicate)
    paid = paid.where(F.col(actual).isNotNull()).withColumnRenamed(fk, "_fk")
    priced = parent.where(F.col(expected).isNotNull())
    pairs = expand(priced, paid, pk, "_fk", how="inner", spread_by=[child_id], policy=policy, hot=hot)
    return with_difference(pairs.drop("_fk", "parent_found", "child_found"), expected, actual, labels)


def with_difference(pairs: DataFrame, expected: str, actual: str, labels: Labels = ENGLISH) -> DataFrame:
    """Pairs whose amounts differ, plus diff, diff_type and diff_pct."""
    diff = F.col(actual) - F.col(expected)
    pct = F.round(F.try_divide(F.abs(F.col("diff")) * F.lit(100), F.col(expected)), 2).cast("double")
    return (pairs.withColumn("diff", diff.cast("decimal(13,2)"))
            .where(F.col("diff") != 0)
            .withColumn("diff_type", F.when(F.col("diff") > 0, labels.overpaid).otherwise(labels.underpaid))
            .withColumn("diff_pct", pct))


def mismatch_summary(mismatches: DataFrame) -> DataFrame:
    """n, total_diff, overpaid, underpaid over ``amount_mismatch`` rows. Empty: 0 and NULLs."""
    diff = F.col("diff")
    zero = F.lit(0).cast("decimal(13,2)")
    return mismatches.agg(
        rows().alias("n"),
        money(F.sum(F.abs(diff))).alias("total_diff"),
        money(F.sum(F.when(diff > 0, diff).otherwise(zero))).alias("overpaid"),
        money(F.sum(F.when(diff < 0, -diff).otherwise(zero))).alias("underpaid"))


def reconcile(parent: DataFrame, child: DataFrame, pk: str, fk: str, expected: str, actual: Column,
              predicate: Column | None = None, *, due: Column | None = None,
              only_differences: bool = True) -> DataFrame:
    """Parent columns, n_children, actual_total and diff against the sum over all children.

    Children are summed per key before the join. A parent without matching children is compared
    with 0 where ``due`` (a condition on the parent) holds, and else not compared; nor is one whose
    sum or total is NULL.
    """
    counted = child if predicate is None else child.where(predicate)
    sums = (counted.where(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("_fk"))
            .agg(rows().alias("n_children"), F.sum(actual).cast(MONEY_SUM).alias("actual_total")))
    if due is None:
        paired = parent.join(sums, F.col(pk) == F.col("_fk"), "inner").drop("_fk")
    else:
        found = F.col("_fk").isNotNull()
        nothing = F.lit(0).cast(MONEY_SUM)
        paired = (parent.join(sums, F.col(pk) == F.col("_fk"), "left").where(found | due)
                  .withColumn("actual_total", F.when(found, F.col("actual_total")).otherwise(nothing))
                  .withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))).drop("_fk"))
    compared = (paired
                .withColumn("diff", (F.col("actual_total") - F.col(expected)).cast(MONEY_SUM)))
    return compared.where(F.col("diff") != 0) if only_differences else compared
