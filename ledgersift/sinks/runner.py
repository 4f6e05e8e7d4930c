"""Runs all exports; a failing one becomes a status row and the others still run."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Mapping
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from ledgersift.model import Ledger
from ledgersift.operators.facts import share_facts
from ledgersift.plans.catalogue import EXPORTS, Check, Export
from ledgersift.session import remove_folder, shared_dir
from ledgersift.sinks.verified import Written, write_manifest, write_verified
from ledgersift.sinks.writers import dated_path

logger = logging.getLogger(__name__)

RESULT_SCHEMA = "name string, rows long, path string, status string, digest string"


def run_all(spark: SparkSession, ledger: Ledger, folder: str, *, day: date | None = None, kind: str = "csv",
            exports: Mapping[str, Export | Check] = EXPORTS, share: bool = False,
            sort_details: str = "all") -> DataFrame:
    """Write every export; result: name, rows, path, status ("OK" or "ERROR: ...") and digest per export.

    The run leaves a manifest of its files beside them, with which ``verified.verify`` checks them later.

    ``share`` counts hot keys and joins orders with payments once, into the shared folder, lets
    the exports read those tables, and removes them when the run ends. ``sort_details`` puts detail files in report order
    (``all``), each part file by itself (``parts``, which needs no shuffle), or leaves them
    (``none``); summaries of a few rows are always in order.
    """
    day = day or date.today()
    facts = None
    if share:
        try:
            facts = f"{shared_dir(spark)}/audit-{uuid.uuid4().hex}"
            ledger = share_facts(ledger, facts)
        except Exception as error:  # noqa: BLE001 - each export then works its facts out and fails on its own
            logger.error("nothing is shared: %s", error)
    results = []
    try:
        for name, export in exports.items():
            path = dated_path(folder, name, day, kind)
            try:
                result = export.sorted(ledger, "all" if export.summary else sort_details)
                results.append(write_verified(result, name, path, kind, single_file=export.summary))
            except Exception as error:  # noqa: BLE001 - one broken export must not stop the rest
                logger.error("%s failed: %s", name, error)
                results.append(Written(name, None, kind, None, 0, None, f"ERROR: {error}"))
    finally:
        if facts:
            remove_folder(spark, facts)
    write_manifest(spark, results, folder, day)
    return spark.createDataFrame([(w.name, w.rows, w.path, w.status, w.digest) for w in results], RESULT_SCHEMA)


def failed(results: DataFrame) -> DataFrame:
    return results.where("status <> 'OK'")
