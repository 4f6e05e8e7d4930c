"""Tables kept by key between batches: a batch reads and rewrites only the buckets its keys fall into.

Rows lie in a shared folder, dealt to buckets by their key. A batch writes the buckets it touched under its own number and
then a manifest that says, for each bucket, which batch wrote it last. The manifest of a batch is written after its rows,
so a batch that is repeated starts from the manifest before it and comes to the same result. Buckets that a batch
replaced are removed by the one after the next, when no repetition can ask for them any more.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgersift.session import remove_folder


@dataclass(frozen=True)
class KeyedTable:
    """A table by key under ``path``: its name, key column, schema (key included) and number of buckets.

    A batch of few keys reads at most one bucket for each of them, so the number of buckets sets how many rows that
    is; it belongs to the folder and must not change while it is in use.
    """

    path: str
    name: str
    key: str
    schema: str
    buckets: int

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def touched(self, delta: DataFrame) -> list[int]:
        """The buckets of a batch's keys: whole numbers below ``buckets``, however large the batch."""
        return sorted(r[0] for r in delta.select(self.bucket()).distinct().collect())

    def read(self, spark: SparkSession, versions: Mapping[int, int], buckets: Iterable[int]) -> DataFrame:
        """The rows of some buckets as the given versions have them."""
        paths = [f"{self.path}/{self.name}/batch={versions[b]}/bucket={b}" for b in buckets if b in versions]
        if not paths:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*paths)

    def write(self, rows: DataFrame, batch: int) -> DataFrame:
        """Writes whole buckets, one file each, under the batch's number, and reads them back."""
        path = f"{self.path}/{self.name}/batch={batch}"
        (rows.withColumn("bucket", self.bucket()).repartition("bucket").write.mode("overwrite")
         .partitionBy("bucket").parquet(path))
        return rows.sparkSession.read.schema(self.schema).parquet(path).select(*rows.columns)


def merged(old: DataFrame, delta: DataFrame, by: list[str]) -> DataFrame:
    """Old rows and a batch's changes summed up by their key columns; all other columns are counts."""
    counts = [c for c in old.columns if c not in by]
    return (old.unionByName(delta.select(*old.columns)).groupBy(*by)
            .agg(*[F.sum(c).alias(c) for c in counts]).select(*old.columns))


MANIFEST = "table string, bucket int, version int, replaced int, measure string, value long"


@dataclass(frozen=True)
class Manifest:
    """What a batch left behind: versions by table and bucket, what it replaced, and running measures."""

    versions: Mapping[str, Mapping[int, int]]
    replaced: tuple[tuple[str, int, int], ...]
    measures: Mapping[str, int]


NOTHING_YET = Manifest({}, (), {})


def read_manifest(spark: SparkSession, path: str, batch: int) -> Manifest:
    """The manifest of one batch; before the first there is none."""
    if batch < 0:
        return NOTHING_YET
    versions, replaced, measures = {}, [], {}
    for r in spark.read.schema(MANIFEST).parquet(f"{path}/manifest/batch={batch}").collect():
        if r.measure is not None:
            measures[r.measure] = r.value
        elif r.version is not None:
            versions.setdefault(r.table, {})[r.bucket] = r.version
        else:
            replaced.append((r.table, r.bucket, r.replaced))
    return Manifest(versions, tuple(replaced), measures)


def write_manifest(spark: SparkSession, path: str, batch: int, manifest: Manifest) -> None:
    """A row for each bucket and measure: bounded by the number of buckets."""
    rows = [(t, b, v, None, None, None) for t, of in manifest.versions.items() for b, v in of.items()]
    rows += [(t, b, None, v, None, None) for t, b, v in manifest.replaced]
    rows += [(None, None, None, None, m, v) for m, v in manifest.measures.items()]
    (spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite")
     .parquet(f"{path}/manifest/batch={batch}"))


def advance(before: Manifest, table: KeyedTable, buckets: Iterable[int], batch: int) -> tuple[dict, list]:
    """The table's versions after a batch wrote these buckets, and the (table, bucket, version) it replaced."""
    old = before.versions.get(table.name, {})
    return ({**old, **dict.fromkeys(buckets, batch)},
            [(table.name, b, old[b]) for b in buckets if b in old])


def remove_replaced(spark: SparkSession, path: str, manifest: Manifest) -> None:
    """Removes buckets that a finished batch replaced."""
    for table, bucket, version in manifest.replaced:
        remove_folder(spark, f"{path}/{table}/batch={version}/bucket={bucket}")
