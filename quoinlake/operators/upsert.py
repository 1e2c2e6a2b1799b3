"""Keyed upsert and insert-if-absent on tables of record."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoinlake.operators.dedup import latest_per_key


def upsert(
    base: DataFrame,
    changes: DataFrame,
    key: list[str],
    order: list[Column],
    positive: tuple[str, ...] = (),
) -> DataFrame:
    """Last write wins: per key the first row under `order`, of the base and the changes together.

    A base without a column of the order counts as having NULL there. Of equal ranks the
    change wins. Changes whose `positive` columns are not all above zero, or whose key is
    NULL, are refused; base rows with a NULL key stay.
    """
    for c in [*positive]:
        changes = changes.where(F.col(c) > 0)
    for k in key:
        changes = changes.where(F.col(k).isNotNull())
    both = base.withColumn("_change", F.lit(0)).unionByName(changes.withColumn("_change", F.lit(1)), allowMissingColumns=True)
    return latest_per_key(both, key, [*order, F.desc("_change")]).select(*base.columns)


def insert_missing(base: DataFrame, seed: DataFrame, key: list[str], order: "list[Column] | None" = None) -> DataFrame:
    """Add seed rows whose key the base lacks, one per key (the first under `order`, default all columns ascending)."""
    first = latest_per_key(seed, key, order or [F.col(c).asc_nulls_first() for c in seed.columns])
    return base.unionByName(first.join(base.select(*key), key, "left_anti").select(*base.columns))
