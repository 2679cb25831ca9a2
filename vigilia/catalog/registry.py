from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import configure, materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MODULES = ["expressions", "interval_queries", "quality_queries", "indicator_queries", "reference_queries", "load_queries",
           "anomaly_queries"]

# Rows of the stored lines take a dozen bytes and some hundreds once they are text: a task that reads more would sort on disk.
SPLIT = "16m"

_STAGES: dict[tuple, DataFrame] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(t)`` under ``name``; ``t`` gives access to the tables of one folder."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark).conf.set("spark.sql.files.maxPartitionBytes", SPLIT)
            return fn(Tables(spark, sf_dir))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return add


class Tables:
    """Tables of one folder, and stage tables written once per application below the shared folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def stage(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A stage is a table in storage that later queries read, as in the monthly trail."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _STAGES:
            _STAGES[key] = materialize(build(), f"stage-{name}")
        return _STAGES[key]

    def view(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A stage that is not written: a row is little work to derive again, and a query reads the columns it needs."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _STAGES:
            _STAGES[key] = build()
        return _STAGES[key]


def forget_stages() -> None:
    _STAGES.clear()


def load_all() -> None:
    for module in MODULES:
        importlib.import_module(f"{__package__}.{module}")
