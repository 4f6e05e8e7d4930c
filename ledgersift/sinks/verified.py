"""Result files that can be checked: what was written is counted and digested on the way, and read again against it.

A file's digest does not depend on the order of its rows or on how they are dealt to parts: it is the sum of a number
made of each row's text. It is worked out by the writing job itself, beside the count, and kept in a manifest
together with the header.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import asdict, dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Between the columns of a row's text, and in place of NULL: control characters that the data do not use.
BETWEEN, NOTHING = "\x1f", "\x1e"

#: Quotes are doubled, and text keeps its blanks, so that a file gives back what was written.
CSV_OPTIONS = {"header": "true", "encoding": "UTF-8", "escape": '"', "ignoreLeadingWhiteSpace": "false",
               "ignoreTrailingWhiteSpace": "false"}

MANIFEST_SCHEMA = "name string, path string, kind string, header string, rows long, digest string, status string"


@dataclass(frozen=True)
class Written:
    """One file's entry in the manifest."""

    name: str
    path: str | None
    kind: str
    header: str | None
    rows: int
    digest: str | None
    status: str


def as_text(df: DataFrame) -> DataFrame:
    """Every column as the text a CSV file holds."""
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def row_number(columns: Iterable[str]) -> Column:
    """A 48-bit number made of a row's text."""
    text = F.concat_ws(BETWEEN, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(NOTHING)) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("decimal(38,0)")


def facts(columns: list[str]) -> list[Column]:
    """Aggregates: number of rows and their digest, 0 for no rows."""
    return [F.count(F.lit(1)).alias("rows"),
            F.coalesce(F.sum(row_number(columns)), F.lit(0)).cast("string").alias("digest")]


def write_verified(df: DataFrame, name: str, path: str, kind: str = "csv", single_file: bool = False) -> Written:
    """Writes a result as CSV text or Parquet; rows and digest are observed while writing."""
    if kind not in ("csv", "parquet"):
        raise ValueError(f"unknown result kind {kind!r}")
    seen = Observation()
    rows = (as_text(df) if kind == "csv" else df).observe(seen, *facts(df.columns))
    writer = (rows.coalesce(1) if single_file else rows).write.mode("overwrite")
    if kind == "csv":
        writer.options(**CSV_OPTIONS).csv(path)
    else:
        writer.parquet(path)
    return Written(name, path, kind, ",".join(df.columns), seen.get["rows"], seen.get["digest"], "OK")


def manifest_path(folder: str, day: date) -> str:
    return f"{folder}/manifest_{day:%Y%m%d}.json"


def write_manifest(spark: SparkSession, written: list[Written], folder: str, day: date) -> None:
    """One row for each file of a run; a second run on the same day replaces the first."""
    (spark.createDataFrame([tuple(asdict(w).values()) for w in written], MANIFEST_SCHEMA).coalesce(1)
     .write.mode("overwrite").json(manifest_path(folder, day)))


def read_manifest(spark: SparkSession, folder: str, day: date) -> DataFrame:
    return spark.read.schema(MANIFEST_SCHEMA).json(manifest_path(folder, day))


def read_result(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A written result as text, under the header it was written with."""
    if kind == "parquet":
        return as_text(spark.read.parquet(path))
    # In the file NULL is nothing and an empty text is a pair of quotes; read under these marks they stay apart.
    return (spark.read.options(**CSV_OPTIONS).option("multiLine", "true").option("nullValue", NOTHING)
            .option("emptyValue", "").csv(path))


def verify(spark: SparkSession, folder: str, day: date) -> DataFrame:
    """name, header, rows, digest, status of each file in a day's manifest, as read from the files themselves.

    Status is ``OK``, ``MISSING`` (cannot be read), ``CHANGED`` (other header, rows or digest than written), or the
    error the run met. One job for each file; nothing but its counts comes to the driver.
    """
    out = []
    for entry in read_manifest(spark, folder, day).orderBy("name").collect():
        if entry.path is None:
            out.append((entry.name, None, 0, None, entry.status))
            continue
        try:
            found = read_result(spark, entry.path, entry.kind)
            header, row = ",".join(found.columns), found.agg(*facts(found.columns)).first()
        except Exception:  # noqa: BLE001 - a file that cannot be read is a finding, and the others are still checked
            out.append((entry.name, None, 0, None, "MISSING"))
            continue
        same = (header, row["rows"], row["digest"]) == (entry.header, entry.rows, entry.digest)
        out.append((entry.name, header, row["rows"], row["digest"], "OK" if same else "CHANGED"))
    return spark.createDataFrame(out, "name string, header string, rows long, digest string, status string")
