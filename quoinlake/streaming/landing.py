"""Stream of JSON ads to partitioned Parquet."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quoinlake.operators.normalize import decode_json
from quoinlake.operators.dedup import latest_per_key
from quoinlake.operators.sizing import BROADCAST_ROWS, fits
from quoinlake.operators.upsert import upsert
from quoinlake.schemas import RAW_LISTING
from quoinlake.sources.tables import (
    newest_version, overwrite_partitions, overwrite_table, path_exists, remove_path, table_exists,
)
from quoinlake.workspace import stored


def kafka_values(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """One topic from its earliest offset, surviving expired offsets. Needs the Kafka package."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    return reader.option("startingOffsets", "earliest").option("failOnDataLoss", "false").load()


def file_values(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Text files of one JSON message per line, as the same `value` column.

    `max_files` is the size of a micro-batch; it has no influence on what is landed.
    """
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(path)


def json_values(df: DataFrame) -> DataFrame:
    """Rows as JSON messages for a queue; NULL fields are written, non-ASCII text is kept."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def publish_kafka(messages: DataFrame, servers: str, topic: str) -> None:
    """Send a `value` column to a topic. Needs the Kafka package."""
    options = {"kafka.bootstrap.servers": servers, "topic": topic, "kafka.retries": "3"}
    messages.write.format("kafka").options(**options).save()


def utc_time(c: "Column | str") -> Column:
    """Wall clock in UTC of a time as text; one without an offset is UTC. The session zone has no part in it.

    An offset has its sign behind the date and the hour, so a text without a sign there is
    cast as it is; only the others pay for the patterns that take an offset apart.
    """
    c = F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    part = lambda i: F.regexp_extract(c, r"T?\d{1,2}:\d{2}.*?([+-])(\d{1,2}):?(\d{2})?$", i)
    minutes = part(2).try_cast("int") * 60 + F.coalesce(part(3).try_cast("int"), F.lit(0))
    offset = F.coalesce(F.when(part(1) == "-", -minutes).otherwise(minutes), F.lit(0))
    moved = c.try_cast("timestamp_ntz") - F.make_dt_interval(mins=offset)
    clock = F.substring(c, 12, 64)
    return F.when(clock.contains("+") | clock.contains("-"), moved).otherwise(c.try_cast("timestamp_ntz"))


def with_dt(df: DataFrame, ts: str = "crawled_at") -> DataFrame:
    """Day partition of the event time, in UTC. Rows without a readable time have no partition: dropped.

    The day is made in a generator that yields nothing for NULL: a filter on it would have
    the time read twice.
    """
    return df.withColumn("dt", F.explode(F.array_compact(F.array(F.to_date(utc_time(ts))))))


def read_json_stream(values: DataFrame, schema: StructType = RAW_LISTING, ts: str = "crawled_at") -> DataFrame:
    return with_dt(decode_json(values, "value", schema), ts)


def land(stream: DataFrame, path: str, checkpoint: str, by: str = "dt") -> StreamingQuery:
    """Write everything available as new Parquet files and stop. Restarts continue exactly once."""
    writer = stream.writeStream.trigger(availableNow=True).partitionBy(by).outputMode("append")
    return writer.start(path, format="parquet", checkpointLocation=checkpoint)


#: Days of a batch up to which their folders are named one by one.
NAMED_DAYS = 1000


def landed_days(spark: SparkSession, path: str, days: list[str], by: str = "dt") -> "DataFrame | None":
    """What lies in the given days of a landed table; no other folder is listed or read. None if there is nothing."""
    there = [f"{path}/{by}={d}" for d in days if path_exists(spark, f"{path}/{by}={d}")]
    return spark.read.option("basePath", path).parquet(*there) if there else None


def not_before(fresh: DataFrame, before: DataFrame, key: list[str], max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of `fresh` whose key `before` does not have.

    Up to `max_rows` keys go to the files of `before`. More are joined by shuffle: Spark would
    else send them through the driver, batch by batch, as long as their files are small.
    """
    keys, before = fresh.select(*key), before.select(*key)
    if fits(keys, max_rows):
        return fresh.join(before.join(F.broadcast(keys), key, "left_semi").distinct(), key, "left_anti")
    again = before.join(keys.hint("merge"), key, "left_semi").distinct()
    return fresh.join(again.hint("merge"), key, "left_anti")


def land_once(
    stream: DataFrame, path: str, checkpoint: str, key: tuple[str, ...] = ("ad_id", "crawled_at"), by: str = "dt"
) -> StreamingQuery:
    """Land every message once, however often it is delivered, and however late.

    Redeliveries agree in `key`, and so in their day: a batch drops those within itself and
    those that earlier batches left in its days. Only the folders of these days are listed,
    and only the key columns of their files are read; the keys of the batch, if they are few,
    go to the files, so that landed rows do not move. No state is kept between batches, so
    none grows. Rows with a NULL in the key are not duplicates. A batch writes a folder of
    its own below each day and replaces it when it is repeated.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = latest_per_key(batch, list(key), [F.col(c).asc_nulls_first() for c in batch.columns])
        fresh = stored(fresh, "fresh")  # read for its days, its keys and its rows
        days = [str(r[0]) for r in fresh.select(by).distinct().limit(NAMED_DAYS + 1).collect()]
        if len(days) <= NAMED_DAYS:
            earlier = landed_days(spark, path, days, by)
        else:
            earlier = spark.read.parquet(path) if table_exists(spark, path) else None
        if earlier is not None:
            fresh = not_before(fresh, earlier.where(F.col("batch") < batch_id), [by, *key])
        rows = fresh.withColumn("batch", F.lit(batch_id).cast("long"))
        overwrite_partitions(rows, path, [by, "batch"])

    return (
        stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


KEPT_VERSIONS = 3


def upsert_stream(
    changes: DataFrame, path: str, checkpoint: str, key: list[str], order: list[Column],
    positive: tuple[str, ...] = (),
) -> StreamingQuery:
    """Keep a small keyed table of record current from a stream of changes.

    Each micro-batch writes version `batch` from version `batch - 1`, so a replayed batch
    rebuilds its own version and never reads what it is writing. The table keeps the columns
    of the order, so batches may come in any order. Read it with `latest_version`. A
    checkpoint that starts anew on a table with versions is refused. The last
    `KEPT_VERSIONS` versions stay.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark, before = batch.sparkSession, f"{path}/version={batch_id - 1}"
        newest = newest_version(spark, path)
        if newest is not None and newest > batch_id or newest is None and batch_id > 0:
            raise ValueError(f"{path} holds version {newest}, the checkpoint is at {batch_id}")
        base = spark.read.parquet(before) if batch_id > 0 else batch.limit(0)
        overwrite_table(upsert(base, batch, key, order, positive), f"{path}/version={batch_id}")
        remove_path(spark, f"{path}/version={batch_id - KEPT_VERSIONS}")

    return (
        changes.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
