"""Every registered query and, where SQL can express it, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnpike.plans import audits, features, market, regimes, reports, results, selection

FLAGSHIP = "bars_hourly"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = market.QUERIES | results.QUERIES | reports.QUERIES | features.QUERIES | regimes.QUERIES | selection.QUERIES | audits.QUERIES
ORACLE_SQL: dict[str, str] = market.ORACLE_SQL | results.ORACLE_SQL | reports.ORACLE_SQL | features.ORACLE_SQL | regimes.ORACLE_SQL | selection.ORACLE_SQL | audits.ORACLE_SQL
