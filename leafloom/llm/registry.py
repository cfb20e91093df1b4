"""Queries of this subpackage, by name, and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafloom.llm import bpe, linededup, minhash, packing, pii, pitmanyor, quality, secrets, sstable, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

for _module in (pii, secrets, quality, minhash, linededup, topk, pitmanyor, bpe, sstable, packing):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(getattr(_module, "ORACLES", {}))
