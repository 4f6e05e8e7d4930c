"""Reads the four role tables from files, a catalogue or a relational database."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from ledgersift.model import ROLE_SCHEMAS, Ledger

ROLES = tuple(ROLE_SCHEMAS)
PRIMARY_KEYS = {"customers": "customer_id", "products": "product_id", "orders": "order_id",
                "payments": "payment_id"}


def _ledger(tables: dict[str, DataFrame], **options) -> Ledger:
    return Ledger.of(**{role: tables[role] for role in ROLES}, **options)


def read_parquet(spark: SparkSession, folder: str, **options) -> Ledger:
    """``<folder>/<role>`` per role, one file or a folder of parts."""
    return _ledger({r: spark.read.parquet(f"{folder}/{r}") for r in ROLES}, **options)


def read_csv(spark: SparkSession, folder: str, **options) -> Ledger:
    """``<folder>/<role>.csv`` with a header; the role's schema applies, nothing is inferred."""
    return _ledger({r: spark.read.schema(ROLE_SCHEMAS[r]).option("header", True).option("enforceSchema", False)
                    .csv(f"{folder}/{r}.csv") for r in ROLES}, **options)


def read_tables(spark: SparkSession, names: dict[str, str] | None = None, **options) -> Ledger:
    """Catalogue tables; ``names`` maps a role to a table where the two differ."""
    names = names or {}
    return _ledger({r: spark.table(names.get(r, r)) for r in ROLES}, **options)


@dataclass(frozen=True)
class JdbcSource:
    """Connection settings of a relational ledger.

    ``key_ranges`` gives (lowest, highest) primary key per role. A role with a range is read by
    ``partitions`` concurrent range queries, without one by a single query.
    """

    url: str
    properties: dict[str, str] = field(default_factory=dict)
    tables: dict[str, str] = field(default_factory=dict)
    key_ranges: dict[str, tuple[int, int]] = field(default_factory=dict)
    partitions: int = 64
    fetch_size: int = 10_000

    def options(self, role: str) -> dict[str, str]:
        """Options of the jdbc source for one role."""
        chosen = {"url": self.url, "dbtable": self.tables.get(role, role), "fetchsize": str(self.fetch_size),
                  "preferTimestampNTZ": "true", **self.properties}
        if role in self.key_ranges:
            low, high = self.key_ranges[role]
            chosen |= {"partitionColumn": PRIMARY_KEYS[role], "lowerBound": str(low), "upperBound": str(high + 1),
                       "numPartitions": str(self.partitions)}
        return chosen

    def range_query(self, role: str) -> dict[str, str]:
        """Options of the jdbc source for one role's lowest and highest primary key."""
        key = PRIMARY_KEYS[role]
        return {"url": self.url, "query": f"SELECT MIN({key}) AS low, MAX({key}) AS high "
                                          f"FROM {self.tables.get(role, role)}", **self.properties}


def with_key_ranges(source: JdbcSource, ask: Callable[[dict[str, str]], Sequence]) -> JdbcSource:
    """The source with the key range of every role, so that each table is read by range queries.

    ``ask`` fetches the one row (low, high) of a range query; an empty table has no range.
    """
    found = {role: tuple(ask(source.range_query(role))) for role in ROLES if role not in source.key_ranges}
    return replace(source, key_ranges={**source.key_ranges, **{
        role: (int(low), int(high)) for role, (low, high) in found.items() if low is not None}})


def ask_jdbc(spark: SparkSession) -> Callable[[dict[str, str]], Sequence]:
    return lambda options: spark.read.format("jdbc").options(**options).load().first()


def read_jdbc(spark: SparkSession, source: JdbcSource, **options) -> Ledger:
    return _ledger({r: spark.read.format("jdbc").options(**source.options(r)).load() for r in ROLES}, **options)
