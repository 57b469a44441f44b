"""Registry of the runnable queries and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Lazy access to the parquet tables and standing views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str, spread: bool = False):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._spread = spread

    @property
    def wide(self) -> Tables:
        """The same tables for work that is heavy per row: a table stored in fewer splits than
        there are cores is spread over the cores; any larger table is read as it is."""
        return Tables(self.spark, self.folder, spread=True)

    def kept(self, name: str) -> DataFrame:
        """A view that a query reads several times, written once to the shared folder."""
        from ..session import written
        return written(getattr(self, name), name)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        from . import views
        if name in views.VIEWS:
            return views.view(self, name)
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        cores = self.spark.sparkContext.defaultParallelism
        if self._spread and df.rdd.getNumPartitions() < cores:
            return df.repartition(cores)
        return df


def query(name: str, sql: str | None = None):
    """Register `fn(tables) -> DataFrame` under a name, with SQL that gives the same rows."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add
