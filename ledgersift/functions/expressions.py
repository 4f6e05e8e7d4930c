"""Column expressions shared by the operators. All are JVM-side; none is a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COUNT = "decimal(18,0)"
MONEY_SUM = "decimal(24,2)"


def ratio(part: Column, whole: Column) -> Column:
    """100 * part / whole as an exact decimal; NULL when whole is 0 or NULL."""
    return F.try_divide(part.cast(COUNT) * F.lit(100), whole.cast(COUNT))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """Rounded percentage (half away from zero), as a double."""
    return F.round(ratio(part, whole), digits).cast("double")


def score(bad: Column, total: Column) -> Column:
    """Quality score 100 - percent of bad rows, rounded once from the exact ratio."""
    return F.round(F.lit(100) - ratio(bad, total), 2).cast("double")


def rows() -> Column:
    return F.count(F.lit(1))


def money(total: Column) -> Column:
    """Give a money sum its published type."""
    return total.cast(MONEY_SUM)


def money_average(total: Column, n: Column) -> Column:
    """Average amount at two places from an exact sum and the number of non-NULL amounts."""
    return F.round(F.try_divide(total.cast("decimal(28,2)"), n.cast("decimal(18,0)")), 2).cast(MONEY_SUM)


def flag(condition: Column) -> Column:
    """1 when the condition is true, 0 when it is false or unknown."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def tally(condition: Column) -> Column:
    """1/0 as a long, for measures that are summed."""
    return F.when(condition, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))


def keep(condition: Column, value: Column) -> Column:
    """The value where the condition holds, else NULL, so sums over no rows stay NULL."""
    return F.when(condition, value)
