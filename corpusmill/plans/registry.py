"""Where queries register: a Spark function and, where SQL can express it, its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusmill.scratch import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder by name: ``t.documents`` reads ``documents.parquet``. Tables of texts are spread over all cores."""

    _TEXTS = ("documents", "pages", "conversations")

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return spread(table) if name in self._TEXTS else table


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of :class:`Tables`."""

    def register(f: Callable[[Tables], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            ORACLES[key] = sql
        return f

    return register
