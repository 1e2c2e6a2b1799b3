"""A keyed table of record kept by merge on read: changes are added, not the table rewritten.

    path/delta/bucket=B/batch=N   the changed keys of a micro-batch that hash to bucket B
    path/base/bucket=B/upto=N     bucket B merged up to batch N

A batch writes its own keys' rows, newest of each key, to the buckets they hash to; its cost
follows the changes. A reader takes each bucket's newest base and the deltas after it, and
keeps the newest row of each key. A bucket with many deltas is merged into a new base. Every
folder is replaced as a whole when a batch is repeated, and a base covers the batches up to
its own, so a repeated batch adds nothing.
"""

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quoinlake.operators.dedup import latest_per_key
from quoinlake.sources.tables import folders, overwrite_partitions, remove_path

#: Deltas of a bucket from which it is merged.
MOST_DELTAS = 8
BUCKETS = 32


@dataclass(frozen=True)
class MergeTable:
    """Where the table lies, what identifies a row and which of two rows wins.

    `order` is as for `latest_per_key`; its columns are columns of the table, so that a
    change that comes late still loses to a newer one. Of equal rows the later batch wins.
    """

    path: str
    schema: StructType
    key: list[str]
    order: list[Column]
    buckets: int = BUCKETS
    positive: tuple[str, ...] = field(default=())

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def newest(self, rows: DataFrame, *ties: Column) -> DataFrame:
        return latest_per_key(rows, self.key, [*self.order, *ties])


def _numbers(paths: list[str]) -> list[tuple[int, int, str]]:
    """(bucket, number, path) of folders bucket=B/<name>=N."""
    out = []
    for p in paths:
        bucket, number = (int(x.rpartition("=")[2]) for x in p.rstrip("/").split("/")[-2:])
        out.append((bucket, number, p))
    return sorted(out)


def _parts(spark: SparkSession, table: MergeTable) -> tuple[dict[int, tuple[int, str]], dict[int, list[tuple[int, str]]], list[str]]:
    """Newest base and later deltas of each bucket, and the folders that no reader needs any more."""
    bases, deltas, old = {}, {}, []
    for b, upto, p in _numbers(folders(spark, f"{table.path}/base/bucket=*/upto=*")):
        if b in bases:
            old.append(bases[b][1])
        bases[b] = (upto, p)
    for b, batch, p in _numbers(folders(spark, f"{table.path}/delta/bucket=*/batch=*")):
        if b in bases and batch <= bases[b][0]:
            old.append(p)
        else:
            deltas.setdefault(b, []).append((batch, p))
    return bases, deltas, old


def _rows(spark: SparkSession, table: MergeTable, bases: list[str], deltas: list[str]) -> DataFrame:
    """Rows of the named folders with their bucket and batch, unmerged."""
    parts = [spark.createDataFrame([], table.schema).withColumns({"bucket": F.lit(0), "batch": F.lit(0).cast("long")})]
    for kind, number, paths in (("base", "upto", bases), ("delta", "batch", deltas)):
        if paths:
            schema = StructType([*table.schema.fields]).add("bucket", "integer").add(number, "long")
            read = spark.read.schema(schema).option("basePath", f"{table.path}/{kind}").parquet(*paths)
            parts.append(read.withColumnRenamed(number, "batch"))
    return reduce(DataFrame.unionByName, parts)


def read_merged(spark: SparkSession, table: MergeTable) -> DataFrame:
    """The table as of now: one row for each key."""
    bases, deltas, _ = _parts(spark, table)
    rows = _rows(spark, table, [p for _, p in bases.values()], [p for d in deltas.values() for _, p in d])
    return table.newest(rows, F.col("batch").desc()).select(*table.schema.names)


def add_changes(table: MergeTable, changes: DataFrame, batch_id: int) -> None:
    """Write the newest change of each key; keys with a NULL and values that are not positive are refused."""
    for c in table.positive:
        changes = changes.where(F.col(c) > 0)
    for k in table.key:
        changes = changes.where(F.col(k).isNotNull())
    newest = table.newest(changes.select(*table.schema.names))
    placed = newest.withColumns({"bucket": table.bucket(), "batch": F.lit(batch_id).cast("long")})
    overwrite_partitions(placed, f"{table.path}/delta", ["bucket", "batch"])


def compact(spark: SparkSession, table: MergeTable, most: int = MOST_DELTAS) -> list[int]:
    """Merge the buckets with more than `most` deltas; returns them.

    What the merge before last left behind is removed first: readers that began since then
    still find their folders.
    """
    bases, deltas, old = _parts(spark, table)
    for p in old:
        remove_path(spark, p)
    full = sorted(b for b, d in deltas.items() if len(d) > most)
    if full:
        rows = _rows(spark, table, [bases[b][1] for b in full if b in bases], [p for b in full for _, p in deltas[b]])
        upto = {b: deltas[b][-1][0] for b in full}
        number = F.element_at(F.create_map(*[F.lit(x) for b in full for x in (b, upto[b])]), F.col("bucket"))
        merged = table.newest(rows, F.col("batch").desc()).withColumn("upto", number.cast("long"))
        overwrite_partitions(merged.select(*table.schema.names, "bucket", "upto"), f"{table.path}/base", ["bucket", "upto"])
    return full


def merge_stream(changes: DataFrame, table: MergeTable, checkpoint: str, most: int = MOST_DELTAS) -> StreamingQuery:
    """Add everything available to the table, batch by batch, and stop."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        add_changes(table, batch, batch_id)
        compact(batch.sparkSession, table, most)

    return (
        changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
