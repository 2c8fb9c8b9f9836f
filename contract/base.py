"""Registry of contract queries: one Spark callable and, where SQL can say it, one oracle string each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SURVEY_IDS: dict[str, str] = {}


def query(name: str, survey: str, sql: str | None = None):
    def register(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        SURVEY_IDS[name] = survey
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register
