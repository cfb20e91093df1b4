"""Every registered query of the engine and, where SQL can express it, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafloom.plans import audits, comparisons, documents, files, records, web

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

for _module in (documents, audits, comparisons, web, records, files):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
