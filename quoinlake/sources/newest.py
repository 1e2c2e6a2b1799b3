"""The newest row of each key of a pool that grows by days, without a shuffle of its history.

    path/heads/dt=D       the newest row of each key within day D
    path/newest/upto=U    the newest row of each key over all days up to U
    path/unkeyed/dt=D     rows of day D without a key, each for itself

The first two are bucketed by the key. A day is reduced to a row a key before it moves, so a
key with most of the day's rows costs a row a task, and then moves once to its buckets. The
newest rows of all days are the last `newest` and the heads of later days, joined bucket by
bucket where they lie: a later day always wins. A day that is put again replaces its own
heads and withdraws every `newest` that had counted it, so the result is that of the days as
they are now, whatever the order in which they came.
"""

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quoinlake.operators.dedup import latest_per_key
from quoinlake.sources.tables import folders, overwrite_day, path_exists, remove_path

BUCKETS = 64


@dataclass(frozen=True)
class NewestTable:
    """`schema` without dt; `order` decides within a day. `name` is that of its tables in the session's catalog."""

    name: str
    path: str
    schema: StructType
    key: str
    order: "list[Column]"
    buckets: int = BUCKETS

    def opened(self, spark: SparkSession, upto: "str | None" = None) -> str:
        """Name in the catalog of the heads, with the days that lie there now, or of the newest rows up to a day."""
        name = f"{self.name}_heads" if upto is None else f"{self.name}_upto_{upto.replace('-', '_')}"
        path = f"{self.path}/heads" if upto is None else f"{self.path}/newest/upto={upto}"
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
        spark.sql(f"DROP TABLE IF EXISTS `{name}`")
        spark.sql(
            f"CREATE TABLE `{name}` ({fields}, dt date) USING parquet {'PARTITIONED BY (dt)' if upto is None else ''} "
            f"CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )
        if upto is None and path_exists(spark, path):
            spark.catalog.recoverPartitions(f"`{name}`")
        return name

    def write(self, rows: DataFrame, name: str, columns: list[str], part: str = "") -> None:
        """Replace a table or one of its days, also by nothing; a bucket is one file."""
        spark = rows.sparkSession
        rows.select(*columns).repartition(self.buckets, F.col(self.key)).createOrReplaceTempView(f"{name}_rows")
        spark.sql(f"INSERT OVERWRITE TABLE `{name}` {part} SELECT * FROM `{name}_rows`")
        spark.catalog.dropTempView(f"{name}_rows")


def _days(spark: SparkSession, table: NewestTable) -> list[str]:
    """The days that were put, ascending: also one without rows has a folder of rows without a key, which is written last."""
    return sorted(p.rpartition("=")[2] for p in folders(spark, f"{table.path}/unkeyed/dt=*"))


def _bases(spark: SparkSession, table: NewestTable) -> list[str]:
    """The days up to which newest rows are stored, ascending; one whose write did not end does not count."""
    found = sorted(folders(spark, f"{table.path}/newest/upto=*"))
    return [p.rpartition("=")[2] for p in found if path_exists(spark, f"{p}/_SUCCESS")]


def _withdraw(spark: SparkSession, table: NewestTable, upto: str) -> None:
    remove_path(spark, f"{table.path}/newest/upto={upto}")


def put_day(table: NewestTable, rows: DataFrame, day: "date | str") -> None:
    """Set the rows of one day, in place of those it had."""
    spark, day = rows.sparkSession, str(day)
    for upto in _bases(spark, table):
        if upto >= day:
            _withdraw(spark, table, upto)
    rows = rows.select(*table.schema.names)
    remove_path(spark, f"{table.path}/unkeyed/dt={day}")
    heads = latest_per_key(rows, [table.key], table.order, keep_null_keys=False)
    table.write(heads, table.opened(spark), table.schema.names, f"PARTITION (dt = DATE'{day}')")
    own = rows.where(F.col(table.key).isNull()).withColumn("dt", F.lit(day).cast("date"))
    overwrite_day(own, f"{table.path}/unkeyed", day)


def _keyed(spark: SparkSession, table: NewestTable) -> "DataFrame | None":
    """One row for each key of all days; None before the first day."""
    if not _days(spark, table):
        return None
    heads = spark.table(f"`{table.opened(spark)}`")
    names = [*table.schema.names, "dt"]
    bases = _bases(spark, table)
    if bases:
        heads = heads.where(F.col("dt") > F.lit(bases[-1]).cast("date"))
    later = latest_per_key(heads, [table.key], [F.desc("dt")], keep_null_keys=False)
    if not bases:
        return later.select(*names)
    base = spark.table(f"`{table.opened(spark, bases[-1])}`")
    both = base.select(*names).alias("b").join(
        later.select(*names).alias("h"), F.col(f"b.{table.key}") == F.col(f"h.{table.key}"), "full_outer"
    )
    return both.select(*[F.when(F.col("h.dt").isNotNull(), F.col(f"h.`{c}`")).otherwise(F.col(f"b.`{c}`")).alias(c) for c in names])


def newest_rows(spark: SparkSession, table: NewestTable) -> DataFrame:
    """The newest row of each key over all days, and every row without a key."""
    keyed = _keyed(spark, table)
    schema = StructType([*table.schema.fields]).add("dt", "date")
    if keyed is None:
        return spark.createDataFrame([], schema)
    return keyed.unionByName(spark.read.schema(schema).parquet(f"{table.path}/unkeyed"))


def advance(spark: SparkSession, table: NewestTable) -> "str | None":
    """Store the newest rows up to the last day, so that later reads start there; returns that day.

    The one before it is kept for readers that began with it; older ones go.
    """
    days, bases = _days(spark, table), _bases(spark, table)
    if not days or (bases and bases[-1] == days[-1]):
        return bases[-1] if bases else None
    table.write(_keyed(spark, table), table.opened(spark, days[-1]), [*table.schema.names, "dt"])
    for upto in bases[:-1]:
        _withdraw(spark, table, upto)
    return days[-1]


def catch_up(spark: SparkSession, table: NewestTable, pool: str) -> list[str]:
    """Put the days of a pool that were not put yet; returns them."""
    known = set(_days(spark, table))
    missing = sorted({p.rpartition("=")[2] for p in folders(spark, f"{pool}/dt=*")} - known)
    for day in missing:
        put_day(table, spark.read.schema(table.schema).parquet(f"{pool}/dt={day}"), day)
    return missing
