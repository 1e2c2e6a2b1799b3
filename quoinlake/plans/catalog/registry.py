"""Registration of a query together with its check."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: "str | None" = None):
    """Register `fn(spark, sf_dir)`; without `sql` only its rows are checked."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dec(expr: str, places: int) -> str:
    """SQL for the rounding of functions.numeric.exact_round."""
    return f"round(({expr})::decimal(38,10), {places})::double"


def values_of(entries: dict, name: str, *columns: str) -> str:
    """Literal table of a dict for SQL."""

    def quoted(x):
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    rows = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in entries.items())
    return f"(values {rows}) as {name}({', '.join(columns)})"
