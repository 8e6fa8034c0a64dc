"""Registration helper: a query with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Book:
    """Queries and SQL of one module.

    space and names: variables of the module that stand for columns.  They are
    bound when a query runs, as columns need a running session and modules must
    be importable without one.
    """

    def __init__(self, space: dict | None = None, **names: str) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}
        self.space, self.names = space, names
        if space is not None:
            space.update(dict.fromkeys(names))

    def add(self, name: str, query: Query, sql: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(name)
        self.queries[name] = self._bound(query)
        if sql:
            self.sql[name] = sql

    def _bound(self, query: Query) -> Query:
        def run(spark: SparkSession, sf: str) -> DataFrame:
            if self.space is not None:
                self.space.update({k: F.col(c) for k, c in self.names.items()})
            return query(spark, sf)

        return run

    def column(self, name: str, table: str, key: str, make: Callable[[], Column], sql: str, where: str | None = None) -> None:
        """A scalar over a whole table: key and value."""

        def run(spark: SparkSession, sf: str) -> DataFrame:
            df = read(spark, sf, table)
            df = df.where(where) if where else df
            return df.select(key, make().alias("value"))

        self.add(name, run, f"SELECT {key}, {sql} AS value FROM {table}" + (f" WHERE {where}" if where else ""))


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def r9(c: Column) -> Column:
    """Rounded for comparison; -0 becomes 0."""
    return F.round(c, 9) + F.lit(0.0)
