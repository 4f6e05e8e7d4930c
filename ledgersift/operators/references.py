"""Rows whose partner is missing: orphan children, and parents without children."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgersift.functions.expressions import money, money_average, percent, rows
from ledgersift.operators.skew import COUNT_THEM, HotKeys, SkewPolicy, key_set, resolve


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str, *, reason: str,
            referenced_as: str | None = None, spread_by: list[str] | None = None,
            policy: SkewPolicy | None = None, hot: HotKeys = COUNT_THEM, small_parent: bool = False) -> DataFrame:
    """Child rows whose foreign key has no parent row, plus ``problem``. A NULL key is an orphan."""
    checked = resolve(child, parent, fk, pk, found="_found", spread_by=spread_by or [], policy=policy, hot=hot,
                      small_parent=small_parent)
    named = [F.col(c).alias(referenced_as) if c == fk and referenced_as else F.col(c) for c in child.columns]
    return checked.where(~F.col("_found")).select(*named, F.lit(reason).alias("problem"))


def lost_keys(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Distinct foreign keys without parent, as ``lost_key``; NULL is not listed.

    Keys are combined before they meet the parent, so whole child rows are not shuffled for it.
    """
    return key_set(child, fk, "lost_key").join(key_set(parent, pk, "_pk"), F.col("lost_key") == F.col("_pk"),
                                               "left_anti")


def orphans_of(child: DataFrame, lost: DataFrame, fk: str, *, reason: str, referenced_as: str | None = None,
               spread_by: list[str] | None = None, hot: HotKeys = COUNT_THEM) -> DataFrame:
    """``orphans`` given the stored result of ``lost_keys``.

    Of a written table Spark knows the size: a short list is broadcast and the child rows stay
    where they are, a long one is joined like any parent.
    """
    checked = resolve(child, lost, fk, "lost_key", found="_lost", spread_by=spread_by or [], hot=hot,
                      unique_parent=True)
    named = [F.col(c).alias(referenced_as) if c == fk and referenced_as else F.col(c) for c in child.columns]
    return checked.where(F.col("_lost") | F.col(fk).isNull()).select(*named, F.lit(reason).alias("problem"))


def _orphan_keys(child: DataFrame, parent: DataFrame, fk: str, pk: str, measures: list[Column]) -> DataFrame:
    """Child measures per foreign key, with ``found``. One row per key, so no key is hot here."""
    per_key = child.groupBy(F.col(fk).alias("_fk")).agg(*measures)
    keys = key_set(parent, pk, "_pk").withColumn("_hit", F.lit(True))
    return (per_key.join(keys, F.col("_fk") == F.col("_pk"), "left")
            .withColumn("found", F.coalesce("_hit", F.lit(False))))


def orphan_rate(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """total, orphans, pct. Empty: 0, NULL, NULL."""
    keyed = _orphan_keys(child, parent, fk, pk, [rows().alias("n")])
    missing = F.when(~F.col("found"), F.col("n")).otherwise(F.lit(0).cast("long"))
    return (keyed.agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("total"),
                      F.sum(missing).alias("orphans"))
            .select("total", "orphans", percent(F.col("orphans"), F.col("total")).alias("pct")))


def orphan_amount(child: DataFrame, parent: DataFrame, fk: str, pk: str, amount: str, *,
                  by: str | None = None, coalesce_empty: bool = False) -> DataFrame:
    """n and amount of the orphan child rows, optionally per value of ``by``.

    With no orphans the amount is NULL, or 0 with ``coalesce_empty``.
    """
    split = [by] if by else []
    per_key = (child.groupBy(F.col(fk).alias("_fk"), *split)
               .agg(rows().alias("n"), F.sum(amount).alias("amount")))
    lost = per_key.join(key_set(parent, pk, "_pk"), F.col("_fk") == F.col("_pk"), "left_anti")
    total = F.sum("amount")
    total = F.coalesce(total, F.lit(0).cast("decimal(24,2)")) if coalesce_empty else total
    counted = F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n")
    return lost.groupBy(*split).agg(counted, money(total).alias("amount"))


def missing_children(parent: DataFrame, child: DataFrame, pk: str, fk: str,
                     predicate: Column | None = None) -> DataFrame:
    """Parent rows (under ``predicate``) that no child row refers to, whatever the child's state."""
    wanted = parent if predicate is None else parent.where(predicate)
    return wanted.join(key_set(child, fk, "_child_key"), F.col(pk) == F.col("_child_key"), "left_anti")


def missing_children_risk(parent: DataFrame, child: DataFrame, pk: str, fk: str, amount: str,
                          predicate: Column | None = None) -> DataFrame:
    """n, amount and avg_amount of parents without children; amounts are 0 when there are none."""
    alone = missing_children(parent, child, pk, fk, predicate)
    zero = F.lit(0).cast("decimal(24,2)")
    return alone.agg(rows().alias("n"),
                     F.coalesce(money(F.sum(amount)), zero).alias("amount"),
                     F.coalesce(money_average(F.sum(amount), F.count(amount)), zero).alias("avg_amount"))
