"""All queries over the driver's tables, and the SQL that computes the same rows another way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codeloom.plans import answers, context, files, graphs, misc, sources, windows

PARTS = [files, windows, graphs, sources, context, misc, answers]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for part in PARTS for name, f in part.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for part in PARTS for name, sql in part.ORACLES.items()}
FLAGSHIP = "agg1_summary"
