"""The two macro tables: daily market quotes and monthly values."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoinlake.operators.dedup import newest_first
from quoinlake.operators.upsert import insert_missing, upsert
from quoinlake.plans.lake import Lake
from quoinlake.schemas import MACRO_MONTHLY, MARKET_RAW
from quoinlake.sources.tables import latest_version, newest_version, write_if_absent, write_version


def ingest_market(spark: SparkSession, lake: Lake, quotes: DataFrame, part: str) -> None:
    """Land quotes (MARKET_RAW) under their load: a day, or ``backfill-<end>``. Once per load.

    Quotes a source did not have stay NULL; `market_features` carries the earlier ones over.
    """
    typed = quotes.select(*[F.col(f.name).cast(f.dataType) for f in MARKET_RAW])
    write_if_absent(spark, typed.withColumn("dt", F.lit(part)), lake.market)


def months(spark: SparkSession, lake: Lake) -> DataFrame:
    if newest_version(spark, lake.monthly) is None:
        return spark.createDataFrame([], MACRO_MONTHLY)
    return latest_version(spark, lake.monthly)


def seed_months(spark: SparkSession, lake: Lake, seed: DataFrame) -> int:
    """Add months the table lacks; entered values stay."""
    return write_version(spark, insert_missing(months(spark, lake), seed, ["month"]), lake.monthly)


def enter_months(spark: SparkSession, lake: Lake, changes: DataFrame, order: str) -> int:
    """Enter or correct months; both values must be positive. `order` ranks repeated entries."""
    merged = upsert(months(spark, lake), changes, ["month"], newest_first(order), ("cpi", "rate"))
    return write_version(spark, merged, lake.monthly)
