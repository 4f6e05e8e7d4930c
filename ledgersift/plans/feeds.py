"""Dashboard feeds and measures: small aggregates over the roll-up, the scorecard and the view."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgersift.functions.expressions import money, percent
from ledgersift.model import Ledger
from ledgersift.plans.checks import mismatched_payments
from ledgersift.plans.scorecard import mean_score, revenue_at_risk_total

TARGET_SCORE = 98.0
ALERT_SCORE = 95.0


def percent_with_problems(scores: DataFrame) -> DataFrame:
    """pct: bad rows over all rows, 0 when there are none."""
    share = percent(F.sum("bad"), F.sum("total"))
    return scores.agg(F.coalesce(share, F.lit(0.0)).alias("pct"))


def kpi_cards(scores: DataFrame, risk: DataFrame) -> DataFrame:
    """mean_score, risk_amount, bad_rows, pct_bad in one row."""
    quality = scores.agg(mean_score().alias("mean_score"), F.sum("bad").alias("bad_rows"),
                         F.coalesce(percent(F.sum("bad"), F.sum("total")), F.lit(0.0)).alias("pct_bad"))
    money_row = revenue_at_risk_total(risk).select(F.col("amount").alias("risk_amount"))
    stacked = quality.unionByName(money_row, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in ("mean_score", "risk_amount", "bad_rows", "pct_bad")])


def error_distribution(scores: DataFrame) -> DataFrame:
    """table_name, bad and its share of all bad rows (the window spans the scorecard's three rows)."""
    everything = Window.partitionBy(F.lit(0))
    return scores.select("table_name", "bad", percent(F.col("bad"), F.sum("bad").over(everything)).alias("share"))


def over_under_by_order(ledger: Ledger) -> DataFrame:
    """order_id, overpaid, underpaid: summed differences, 0 where there is none of a kind."""
    zero = F.lit(0).cast("decimal(13,2)")
    diff = F.col("diff")
    return (mismatched_payments(ledger).groupBy("order_id")
            .agg(money(F.sum(F.when(diff > 0, diff).otherwise(zero))).alias("overpaid"),
                 money(F.sum(F.when(diff < 0, -diff).otherwise(zero))).alias("underpaid")))


def score_vs_target(scores: DataFrame, target: float = TARGET_SCORE) -> DataFrame:
    """table_name, score, target, gap, met for each table and for the mean over tables.

    The scorecard's three rows are gathered into one to add the mean, so it is computed once.
    """
    gap = F.col("score").cast("decimal(10,2)") - F.lit(target).cast("decimal(10,2)")
    return _with_global(scores).select("table_name", "score", F.lit(float(target)).alias("target"),
                                       gap.cast("double").alias("gap"), (F.col("score") >= target).alias("met"))


def _with_global(scores: DataFrame) -> DataFrame:
    """table_name and score of each table and, as ``global``, of their mean."""
    line = F.struct("table_name", "score")
    overall = F.struct(F.lit("global").alias("table_name"), F.col("mean").alias("score"))
    return (scores.agg(F.collect_list(line).alias("tables"), mean_score().alias("mean"))
            .select(F.inline(F.concat("tables", F.array(overall)))))


def score_alerts(scores: DataFrame, threshold: float = ALERT_SCORE) -> DataFrame:
    """Scores below the threshold: the global one, and those of the tables behind it."""
    return (_with_global(scores).where(F.col("score") < threshold)
            .select("table_name", "score", F.lit(float(threshold)).alias("threshold")))


