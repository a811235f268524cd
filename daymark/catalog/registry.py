"""Query registry.

A query is a Spark builder plus, where SQL can express it, the statement a SQL engine runs on
the same tables. One column list drives the final projection on both sides, so names, types
and rounding cannot drift apart.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, "Query"] = {}

#: Averages of cent amounts often sit exactly on a rounding tie, where the last bit of a sum,
#: and so the order of its terms, would decide the digit. A shift far below the last shown
#: digit takes values off the tie on both sides.
TIE_SHIFT = 3.7e-9


@dataclass(frozen=True)
class Query:
    name: str
    columns: str
    build: Builder
    sql: str | None

    def fields(self) -> list[tuple[str, str]]:
        out = []
        for part in self.columns.replace("\n", " ").split(","):
            name, _, kind = part.strip().partition(":")
            out.append((name, kind))
        return out

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(spark, sf_dir).select(
            *[_spark_field(name, kind) for name, kind in self.fields()])

    def statement(self) -> str:
        shown = ", ".join(_sql_field(name, kind) for name, kind in self.fields())
        return f"SELECT {shown} FROM (\n{self.sql}\n) AS q"


def _spark_field(name: str, kind: str):
    c = F.col(f"`{name}`")
    if kind.isdigit():
        r = F.round(c.cast("double") + TIE_SHIFT, int(kind))
        c = F.when(r == 0, 0.0).otherwise(r)
    elif kind in ("d", "s"):
        c = c.cast("string")
    elif kind == "i":
        c = c.cast("bigint")
    elif kind == "b":
        c = c.cast("int").cast("bigint")
    return c.alias(name)


def _sql_field(name: str, kind: str) -> str:
    q = f'"{name}"'
    if kind.isdigit():
        r = f"round(CAST({q} AS DOUBLE) + {TIE_SHIFT}, {kind})"
        return f"CASE WHEN {r} = 0 THEN CAST(0 AS DOUBLE) ELSE {r} END AS {q}"
    if kind in ("d", "s"):
        return f"CAST({q} AS VARCHAR) AS {q}"
    if kind == "i":
        return f"CAST({q} AS BIGINT) AS {q}"
    if kind == "b":
        return f"CAST(CAST({q} AS INTEGER) AS BIGINT) AS {q}"
    return q


def query(name: str, columns: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    """Register a builder. ``columns`` is ``name[:kind], ...`` with kind a number of decimals,
    ``d`` date or time as text, ``s`` text, ``i`` integer, ``b`` truth value as 0/1."""

    def add(build: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, columns, build, sql)
        return build

    return add
