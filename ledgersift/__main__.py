"""Command line: ``python -m ledgersift export|report`` (or spark-submit of this file).

The source is a Parquet or CSV folder, catalogue tables, or a JDBC url; the session is the one
spark-submit provides.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import SparkSession

from ledgersift.model import Ledger
from ledgersift.plans.report import full_report
from ledgersift.sinks.runner import failed, run_all
from ledgersift.sources.readers import (
    JdbcSource,
    ask_jdbc,
    read_csv,
    read_jdbc,
    read_parquet,
    read_tables,
    with_key_ranges,
)


def arguments(argv: Sequence[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="ledgersift", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    export = commands.add_parser("export", help="write the ten dated exports")
    export.add_argument("--out", required=True)
    export.add_argument("--kind", choices=("csv", "parquet"), default="csv")
    export.add_argument("--sort-details", choices=("all", "parts", "none"), default="all")
    export.add_argument("--no-share", action="store_true", help="join orders and payments anew in every export")
    report = commands.add_parser("report", help="print the sectioned report")
    for command in (export, report):
        source = command.add_mutually_exclusive_group(required=True)
        source.add_argument("--parquet", metavar="FOLDER")
        source.add_argument("--csv", metavar="FOLDER")
        source.add_argument("--tables", metavar="PREFIX", help="tables <PREFIX>customers, <PREFIX>orders, ...")
        source.add_argument("--jdbc", metavar="URL")
        command.add_argument("--jdbc-option", action="append", default=[], metavar="KEY=VALUE")
    return parser.parse_args(argv)


def source_of(spark: SparkSession, args: argparse.Namespace) -> Ledger:
    if args.parquet:
        return read_parquet(spark, args.parquet)
    if args.csv:
        return read_csv(spark, args.csv)
    if args.jdbc:
        source = JdbcSource(args.jdbc, dict(o.split("=", 1) for o in args.jdbc_option))
        return read_jdbc(spark, with_key_ranges(source, ask_jdbc(spark)))
    return read_tables(spark, {r: f"{args.tables}{r}" for r in ("customers", "products", "orders", "payments")})


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 when everything was written or printed, 1 when an export failed."""
    args = arguments(argv)
    spark = spark or SparkSession.builder.appName("ledgersift").getOrCreate()
    ledger = source_of(spark, args)
    if args.command == "report":
        lines = full_report(ledger, datetime.now())
        lines.where("kind <> 'detail'").select("section", "title", "metric", "value_text").show(200, truncate=False)
        for line in lines.where("kind = 'detail'").orderBy("metric").toLocalIterator():
            print(f"{line.title}: {line.metric} ({line.value_num:.0f}): {line.value_text}")
        return 0
    done = run_all(spark, ledger, args.out, kind=args.kind, share=not args.no_share, sort_details=args.sort_details)
    done.show(100, truncate=False)
    return 1 if failed(done).count() else 0


if __name__ == "__main__":
    sys.exit(main())
