"""Broadcast only what has been counted."""

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A dimension row of a few hundred bytes: 200k rows stay well under 100 MB.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Measured:
    """A join side with its exact row count and largest key."""

    frame: DataFrame
    rows: int
    last: Any


def measured(df: DataFrame, key: str, max_rows: int = BROADCAST_ROWS) -> Measured:
    """Count a join side; hint broadcast within the bound, leave it to AQE beyond.

    Only the key column is computed here, so windows and wide columns are pruned away.
    """
    rows, last = df.agg(F.count(F.lit(1)), F.max(key)).first()
    return Measured(F.broadcast(df) if rows <= max_rows else df, rows, last)


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    return df.limit(max_rows + 1).count() <= max_rows


def small_or_shuffled(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only if the side has at most `max_rows` rows."""
    return F.broadcast(df) if fits(df, max_rows) else df


def spread(df: DataFrame) -> DataFrame:
    """Use every core for costly row work on a scan of few splits.

    A table of one large file or row group is one task however many cores there are; only
    then are its rows dealt out first. A scan with enough splits, as any large table has,
    is returned as it is and nothing moves.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
