"""The registry that pairs a Spark query with its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.session import register

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name, each with the DuckDB text that must return the same rows, where SQL can."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        """Decorator: registers a DataFrame query under `name`."""

        def keep(f: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"{name} is registered twice")
            self.queries[name] = f
            if sql is not None:
                self.oracle[name] = sql
            return f

        return keep

    def sql(self, name: str, tables: str, spark_sql: str, oracle: str | None = None) -> None:
        """Registers a query written as Spark SQL text; `oracle` defaults to the same text."""

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            register(spark, sf_dir, *tables.split())
            return spark.sql(spark_sql)

        self.query(name, oracle or spark_sql)(run)
