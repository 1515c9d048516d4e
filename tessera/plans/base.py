"""Registration of a query together with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """The Parquet tables of a folder, read when named."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def registrar(queries: dict, oracles: dict) -> Callable:
    def register(name: str, sql: str | None = None) -> Callable:
        def wrap(build: Callable[[Tables], DataFrame]) -> Callable:
            queries[name] = lambda spark, folder: build(Tables(spark, folder))
            if sql:
                oracles[name] = sql
            return build

        return wrap

    return register
