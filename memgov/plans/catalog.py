"""Named queries over the given tables, each with the same question in plain SQL where SQL can
ask it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

# Bodies differ in length by orders of magnitude; a small batch keeps a Python worker's memory bounded.
BATCH_ROWS = 512

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load_all() -> None:
    from memgov.plans import (  # noqa: F401
        access_queries, body_queries, item_queries, quota_queries, scan_queries, source_queries, stream_queries,
    )
