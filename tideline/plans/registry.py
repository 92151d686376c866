"""Register of runnable queries: a Spark function, its output columns, and the same question in SQL.

Output columns are declared as "name:kind" with kind s string, l bigint, d double, b boolean,
t timestamp (second precision, as text). Both sides get the same final projection, so results
can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ship
from .oracle import BASE

_SPARK = {
    "s": lambda c: F.col(c).cast("string"),
    "l": lambda c: F.col(c).cast("long"),
    "d": lambda c: F.round(F.col(c).cast("double"), 6) + F.lit(0.0),
    "b": lambda c: F.col(c).cast("boolean"),
    "t": lambda c: F.date_format(F.col(c), "yyyy-MM-dd HH:mm:ss"),
}
_SQL = {
    "s": "CAST({0} AS VARCHAR)", "l": "CAST({0} AS BIGINT)", "d": "round(CAST({0} AS DOUBLE), 6) + 0.0",
    "b": "CAST({0} AS BOOLEAN)", "t": "strftime({0}, '%Y-%m-%d %H:%M:%S')",
}


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    columns: tuple[tuple[str, str], ...]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        ship(spark)
        return self.run(spark, folder).select(*[_SPARK[k](c).alias(c) for c, k in self.columns])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        cols = ", ".join(f"{_SQL[k].format(c)} AS {c}" for c, k in self.columns)
        ctes, _, body = self.sql.rpartition(";;")
        more = f",\n{ctes.strip().rstrip(',')}" if ctes.strip() else ""
        return f"WITH RECURSIVE {BASE}{more}\nSELECT {cols} FROM (\n{body.strip()}\n)"


CATALOG: dict[str, Query] = {}


def query(name: str, columns: str, sql: str | None = None):
    """Decorator. sql is the body; text before ';;' holds further CTEs."""
    cols = tuple(tuple(c.split(":")) if ":" in c else (c, "s") for c in columns.split())

    def add(fn):
        if name in CATALOG:
            raise ValueError(f"query {name} registered twice")
        CATALOG[name] = Query(name, fn, cols, sql)
        return fn

    return add
