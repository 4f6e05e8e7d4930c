"""The quality report as an incremental job: new files trigger a fresh scorecard."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgersift.model import Ledger
from ledgersift.plans.scorecard import quality_score


def any_arrival(*streams: DataFrame) -> DataFrame:
    """One stream of what arrives in several tables, without their columns."""
    return reduce(DataFrame.unionByName, [s.select(F.lit(True).alias("arrived")) for s in streams])


def scorecard_job(arrivals: DataFrame, load: Callable[[], Ledger], path: str, checkpoint: str,
                  run_date: str) -> StreamingQuery:
    """Process all arrivals since the last run, then stop.

    ``arrivals`` are the new rows of any of the ledger's tables (see ``any_arrival``). A batch with arrivals audits
    the ledger as ``load`` reads it then. A run date has one scorecard: a later or repeated batch replaces it.
    """
    def audit(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        quality_score(load()).coalesce(1).write.mode("overwrite").parquet(f"{path}/run_date={run_date}")

    return (arrivals.writeStream.foreachBatch(audit).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
