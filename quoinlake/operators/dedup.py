"""One row per key, chosen by a declared order."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest_first(first: str, *ties: str) -> list[Column]:
    """Latest value first, NULLs last; remaining columns only break ties."""
    return [F.col(first).desc_nulls_last(), *[F.col(t).asc_nulls_first() for t in ties]]


def latest_per_key(
    df: DataFrame, key: list[str], order: list[Column], keep_null_keys: bool = True
) -> DataFrame:
    """First row of each key under `order`.

    The row_number = 1 shape lets Spark keep one row per key before the shuffle
    (WindowGroupLimit), so a hot key costs one row per map task. Rows with a NULL key are
    not duplicates of each other: each has a group of its own, so `df` is computed once.
    """
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])
    if keep_null_keys:
        df = df.withColumn("_own", F.when(~known, F.monotonically_increasing_id()))
        key = [*key, "_own"]
    else:
        df = df.where(known)
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return ranked.where(F.col("_rn") == 1).drop("_rn", "_own")


def dedup_series(df: DataFrame, on: list[str], priority: list[Column]) -> DataFrame:
    """One observation per day (and series): overlapping sources resolved by `priority`."""
    return latest_per_key(df, on, priority, keep_null_keys=False)
