"""Late rows told apart from those in time, before a stream's watermark would drop them without a trace."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

CLOCK = "role string, latest timestamp"
UNDATED = "undated"


def _clock(spark: SparkSession, path: str, batch: int) -> dict[str, datetime]:
    """The latest event time of each role seen up to a batch."""
    if batch < 0:
        return {}
    return {r.role: r.latest for r in spark.read.schema(CLOCK).parquet(f"{path}/clock/batch={batch}").collect()}


def pass_in_time(streams: dict[str, tuple[DataFrame, str]], path: str, *, lateness: timedelta) -> StreamingQuery:
    """Splits what arrives in several streams, then stops.

    ``streams`` maps a role to its stream and event time column. The clock stands at the latest event time of that
    role which is furthest behind, less ``lateness``, as the batches before have set it. Rows before it go to
    ``<path>/late/<role>``, undated ones to ``<path>/undated/<role>``, all others to ``<path>/in_time/<role>``. A stream
    that reads the last in order, with a watermark of the same lateness, drops none of them. Folders are written by
    batch, so a repeated batch replaces its own rows.
    """
    names = {role: stream.columns for role, (stream, _) in streams.items()}
    tagged = [stream.select(F.lit(role).alias("role"), F.col(time).cast("timestamp").alias("at"),
                            F.struct(*stream.columns).alias(role)) for role, (stream, time) in streams.items()]
    union = tagged[0]
    for more in tagged[1:]:
        union = union.unionByName(more, allowMissingColumns=True)

    def split(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        try:
            before = _clock(spark, path, number - 1)
            floor = min(before.values()) - lateness if len(before) == len(names) else None
            late = F.col("at") < F.lit(floor) if floor else F.lit(False)
            for role, columns in names.items():
                own = batch.where(F.col("role") == role)
                for kind, rows in (("late", own.where(late)), (UNDATED, own.where(F.col("at").isNull())),
                                   ("in_time", own.where(F.col("at").isNotNull() & ~late))):
                    (rows.select(*[F.col(f"{role}.{c}").alias(c) for c in columns])
                     .write.mode("overwrite").parquet(f"{path}/{kind}/{role}/batch={number}"))
            latest = {r.role: r.latest for r in batch.groupBy("role").agg(F.max("at").alias("latest")).collect()
                      if r.latest is not None}
            clock = {role: max(t for t in (before.get(role), latest.get(role)) if t)
                     for role in names if before.get(role) or latest.get(role)}
            (spark.createDataFrame(list(clock.items()), CLOCK).coalesce(1).write.mode("overwrite")
             .parquet(f"{path}/clock/batch={number}"))
        finally:
            batch.unpersist()

    return (union.writeStream.foreachBatch(split).option("checkpointLocation", f"{path}/checkpoint")
            .trigger(availableNow=True).start())


def passed(spark: SparkSession, path: str, role: str, schema: str) -> DataFrame:
    """The rows of a role that were in time, as a stream in the order of their batches."""
    return (spark.readStream.schema(f"{schema}, batch int").option("maxFilesPerTrigger", 64)
            .parquet(f"{path}/in_time/{role}").drop("batch"))


def side_output(spark: SparkSession, path: str, kind: str, role: str, schema: str) -> DataFrame:
    """The rows of a role that were ``late`` or ``undated``, with the batch that brought them."""
    return spark.read.schema(f"{schema}, batch int").parquet(f"{path}/{kind}/{role}")
