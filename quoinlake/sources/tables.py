"""Parquet and CSV tables: scans and idempotent writes."""

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.errors import AnalysisException

from quoinlake.operators.normalize import normalize_csv
from quoinlake.operators.sizing import small_or_shuffled


def read_table(
    spark: SparkSession, path: str, dt: "date | str | None" = None, schema: "StructType | None" = None
) -> DataFrame:
    """Whole table, or one day through partition pruning (the dt column stays)."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.parquet(path)
    return df if dt is None else df.where(F.col("dt") == F.lit(str(dt)).cast("date"))


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a Parquet table lies at the path, on whatever file system it is."""
    try:
        spark.read.parquet(path)
        return True
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise


def read_seed_csv(spark: SparkSession, path: str, **names) -> DataFrame:
    """Seed listing CSV (UTF-8, with or without a byte order mark) in canonical columns."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    return normalize_csv(df, **names)


def read_series_csv(spark: SparkSession, path: str) -> DataFrame:
    """Two-column (day, value) series CSV; all text, typed by `merge_series`."""
    return spark.read.csv(path, header=True, inferSchema=False)


def balanced(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows of a partition value together, with a large value split over several tasks."""
    return df.hint("rebalance", *[F.col(c) for c in by])


def overwrite_partitions(df: DataFrame, path: str, by: "list[str]") -> None:
    """Replace exactly the partitions present in `df`: a repeated run changes nothing."""
    writer = balanced(df, by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*by).parquet(path)


def overwrite_day(df: DataFrame, path: str, day: "date | str") -> None:
    """Replace one day; a run that yields no rows leaves the day empty."""
    balanced(df, ["dt"]).drop("dt").write.mode("overwrite").parquet(f"{path}/dt={day}")


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def folders(spark: SparkSession, pattern: str) -> list[str]:
    """Folders that match a pattern, on whatever file system it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    return [str(f.getPath()) for f in found or [] if f.isDirectory()]


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it is; one that is absent is no error."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def overwrite_table(df: DataFrame, path: str) -> None:
    """Replace the whole table. `df` must not read from `path`."""
    df.write.mode("overwrite").parquet(path)


def append_table(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def only_absent(df: DataFrame, existing: "DataFrame | None", part: str) -> DataFrame:
    """Rows of partitions the target does not have yet; of the target only the incoming partitions are read."""
    if existing is None:
        return df
    incoming = small_or_shuffled(df.select(part).distinct())
    there = existing.join(incoming, part, "left_semi").select(part).distinct()
    return df.join(there, part, "left_anti")


def write_if_absent(spark: SparkSession, df: DataFrame, path: str, part: str = "dt") -> None:
    """Ingest partitions once: rows of a partition already there are skipped.

    `part` alone is read of the target: its values come from the folder names.
    """
    existing = spark.read.parquet(path) if table_exists(spark, path) else None
    balanced(only_absent(df, existing, part), [part]).write.mode("append").partitionBy(part).parquet(path)


def newest_version(spark: SparkSession, path: str) -> "int | None":
    if not table_exists(spark, path):
        return None
    return spark.read.parquet(path).agg(F.max("version")).first()[0]


def latest_version(spark: SparkSession, path: str) -> DataFrame:
    """Current rows of a small table kept as whole versions."""
    newest = newest_version(spark, path)
    return spark.read.parquet(path).where(F.col("version") == F.lit(newest)).drop("version")


def write_version(spark: SparkSession, df: DataFrame, path: str) -> int:
    """Write the next version; readers keep the one they opened, and `df` may read the last."""
    version = (newest_version(spark, path) or 0) + 1
    overwrite_table(df, f"{path}/version={version}")
    return version
