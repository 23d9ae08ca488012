"""Registered queries and, where SQL can say the same, their check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles at a fixed number of digits, so that the order of a sum does not show. -0.0 becomes 0.

    A nudge far below the last digit decides exact halves, which engines round differently.
    """
    def one(f) -> Column:
        if f.dataType.simpleString() in ("double", "float"):
            return (F.round(F.col(f"`{f.name}`").cast("double") + 10.0 ** -(digits + 3), digits) + F.lit(0.0)).alias(f.name)
        return F.col(f"`{f.name}`")

    return df.select(*[one(f) for f in df.schema.fields])


def rsql(*names: str, digits: int = 6) -> str:
    """The same for SQL: a comma list of rounded columns. ``a=expr`` gives an expression a name."""
    out = []
    for n in names:
        name, _, expr = n.partition("=")
        out.append(f"round(CAST({expr or name} AS DOUBLE) + 1e-{digits + 3}, {digits}) + 0.0 AS {name}")
    return ", ".join(out)
