"""Declared constraints as jobs: domain checks and the split into clean and quarantined rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgersift.operators.references import orphans
from ledgersift.operators.skew import SkewPolicy


def check_domain(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Rows whose value lies outside the domain, plus ``problem``. NULL passes, as in SQL CHECK."""
    reason = f"{column} not in ({', '.join(values)})"
    return df.where(~F.col(column).isin(list(values))).withColumn("problem", F.lit(reason))


def check_fk(child: DataFrame, parent: DataFrame, fk: str, pk: str, *,
             spread_by: list[str] | None = None, policy: SkewPolicy | None = None) -> DataFrame:
    """Child rows that break a foreign key, which, unlike an orphan, may be NULL."""
    return orphans(child.where(F.col(fk).isNotNull()), parent, fk, pk,
                   reason=f"{fk} has no parent", spread_by=spread_by, policy=policy)


def tag(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add ``broken_rules``: names of the rules (true = defect) that a row breaks, in rule order."""
    return df.withColumn("broken_rules", F.array_compact(
        F.array(*[F.when(condition, F.lit(name)) for name, condition in rules.items()])))


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(clean, quarantine). Every row is in exactly one; quarantine carries ``broken_rules``.

    To write both from one pass, write ``tag(df, rules)`` partitioned by whether the list is empty
    (see ``sinks.writers.write_split``).
    """
    tagged = tag(df, rules)
    clean = tagged.where(F.size("broken_rules") == 0).drop("broken_rules")
    return clean, tagged.where(F.size("broken_rules") > 0)
