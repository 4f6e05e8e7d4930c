"""Financial impact: shares, projections and return on fixing the defects."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgersift.functions.expressions import MONEY_SUM
from ledgersift.plans.scorecard import revenue_at_risk_total


@dataclass(frozen=True)
class Scenario:
    """Repeat the audited period until the horizon is filled."""

    name: str
    period_months: int
    horizon_months: int


# The two flat scenarios, and the growth scenario's rate per quarter.
FLAT_SCENARIOS = (Scenario("optimistic", 2, 12), Scenario("conservative", 2, 24))
QUARTERLY_GROWTH = Decimal("0.20")


def risk_shares(risk: DataFrame, digits: int = 1) -> DataFrame:
    """The roll-up plus share_pct of the total (the window spans the roll-up's four rows)."""
    everything = Window.partitionBy(F.lit(0))
    share = F.try_divide(F.col("amount") * F.lit(100), F.sum("amount").over(everything))
    return risk.withColumn("share_pct", F.round(share, digits).cast("double"))


def annual_projection(risk: DataFrame, scenarios: Sequence[Scenario] = FLAT_SCENARIOS) -> DataFrame:
    """scenario, factor, amount: the total risk times horizon / period."""
    cells = F.array(*[F.struct(F.lit(s.name).alias("scenario"),
                               F.lit(s.horizon_months / s.period_months).alias("factor"),
                               (F.col("amount") * F.lit(s.horizon_months) / F.lit(s.period_months))
                               .cast(MONEY_SUM).alias("amount"))
                      for s in scenarios])
    return revenue_at_risk_total(risk).select(F.inline(cells))


def growth_projection(risk: DataFrame, growth: Decimal = QUARTERLY_GROWTH, quarters: int = 4,
                      period_months: int = 2) -> DataFrame:
    """Sum of ``quarters`` quarters, the first at the audited rate and each ``growth`` above the last."""
    factor = sum((Decimal(3) / Decimal(period_months)) * (1 + growth) ** k for k in range(quarters))
    return revenue_at_risk_total(risk).select(
        F.lit("growth").alias("scenario"), F.lit(float(factor)).alias("factor"),
        F.round(F.col("amount") * F.lit(factor), 2).cast(MONEY_SUM).alias("amount"))


def fix_roi(risk: DataFrame, fix_cost: Decimal, scenario: Scenario = FLAT_SCENARIOS[0]) -> DataFrame:
    """annual_loss, fix_cost, roi = loss / cost."""
    loss = annual_projection(risk, [scenario])
    cost = F.lit(fix_cost).cast(MONEY_SUM)
    roi = F.round(F.try_divide(F.col("amount"), cost), 2).cast("double")
    return loss.select(F.col("amount").alias("annual_loss"), cost.alias("fix_cost"), roi.alias("roi"))
