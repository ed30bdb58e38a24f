"""Registered queries: a Spark plan, the SQL it must equal, and the shared output shape."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    plan: Plan
    sql: str | None
    columns: tuple[tuple[str, str], ...]

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.plan(spark, sf_dir)
        out = []
        for name, kind in self.columns:
            c = F.col(name)
            if kind == "l":
                c = c.cast("long")
            elif kind[0] == "d":
                digits = int(kind[1:] or 6)
                c = F.round(c.cast("double"), digits) + F.lit(0.0)
            elif kind == "s":
                c = c.cast("string")
            out.append(c.alias(name))
        return df.select(*out)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        out = []
        for name, kind in self.columns:
            if kind == "l":
                out.append(f'CAST("{name}" AS BIGINT) AS "{name}"')
            elif kind[0] == "d":
                digits = int(kind[1:] or 6)
                out.append(f'round(CAST("{name}" AS DOUBLE), {digits}) + 0.0 AS "{name}"')
            elif kind == "s":
                out.append(f'CAST("{name}" AS VARCHAR) AS "{name}"')
            else:
                out.append(f'"{name}"')
        return f"SELECT {', '.join(out)} FROM ({self.sql}) AS q"


QUERIES: dict[str, Query] = {}


def query(columns: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan under its function's name.

    ``columns`` lists ``name:kind`` with l (integer), d[digits] (double), s (string)
    and b (boolean).
    """
    spec = tuple(tuple(c.split(":")) for c in columns.split())

    def register(plan: Plan) -> Plan:
        QUERIES[plan.__name__] = Query(plan.__name__, plan, sql, spec)
        return plan

    return register
