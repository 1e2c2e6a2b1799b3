"""Positions in an order, found without a window over the rows."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoinlake.operators.sizing import small_or_shuffled
from quoinlake.workspace import stored

# monotonically_increasing_id keeps the row's number within its partition in these low bits.
_ROW_BITS = 33


def same_keys(left: DataFrame, right: DataFrame, keys: dict[str, str]) -> Column:
    """Equality of key columns where NULL equals NULL."""
    cond = F.lit(True)
    for a, b in keys.items():
        cond &= left[a].eqNullSafe(right[b])
    return cond


def numbered(
    df: DataFrame, order: list[Column], by: "list[str] | None" = None,
    out: str = "position", total: "str | None" = None,
) -> DataFrame:
    """Rows numbered from 0 in `order`, within each group of `by`; `total` adds the group's size.

    Rows are range-partitioned by group and order, sorted and stored with their place in
    their partition. Only the counts of (group, partition) are summed up, so a group of any
    size is spread over tasks and none holds more than its range. Rows that are equal in
    group and order get different numbers in an arbitrary but fixed succession. NULL is a
    group like any other; NULLs of the order stand where its columns put them.
    """
    by = by or []
    spark = df.sparkSession
    keys = [*[F.col(c).asc_nulls_first() for c in by], *order]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    placed = stored(dealt.withColumn("_place", F.monotonically_increasing_id()), "numbered")
    part, row = F.shiftright("_place", _ROW_BITS), F.col("_place").bitwiseAND((1 << _ROW_BITS) - 1)
    named = {c: f"_by{i}" for i, c in enumerate(by)}
    counts = placed.groupBy(*[F.col(c).alias(a) for c, a in named.items()], part.alias("_part")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(row).alias("_first"))
    group = Window.partitionBy(*named.values(), *([] if by else [F.lit(0)]))
    before = F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(
        *named.values(), "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(group).alias("_total"))
    offsets = small_or_shuffled(stored(offsets, "offsets"))
    left = placed.withColumns({"_row": row, "_of": part})
    joined = left.join(offsets, same_keys(left, offsets, {**named, "_of": "_part"}))
    return joined.select(
        *[left[c] for c in df.columns], (F.col("_row") + F.col("_shift")).alias(out),
        *([F.col("_total").alias(total)] if total else []))
