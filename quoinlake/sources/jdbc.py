"""JDBC tables. Thin options around Spark's own source; needs a driver jar and a database."""

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class JdbcTarget:
    url: str
    driver: str = "org.postgresql.Driver"
    properties: dict[str, str] = field(default_factory=dict)

    def options(self, table: str) -> dict[str, str]:
        return {"url": self.url, "driver": self.driver, "dbtable": table, **self.properties}


@dataclass(frozen=True)
class SplitBy:
    """Numeric, date or timestamp column that divides a table scan into parallel queries."""

    column: str
    lower: str
    upper: str
    partitions: int

    def options(self) -> dict[str, str]:
        return {
            "partitionColumn": self.column,
            "lowerBound": self.lower,
            "upperBound": self.upper,
            "numPartitions": str(self.partitions),
        }


def jdbc_reader(
    spark: SparkSession, target: JdbcTarget, table: str, split: "SplitBy | None" = None
) -> DataFrameReader:
    options = {**target.options(table), **(split.options() if split else {})}
    return spark.read.format("jdbc").options(**options)


def jdbc_read(
    spark: SparkSession, target: JdbcTarget, table: str, split: "SplitBy | None" = None
) -> DataFrame:
    """A table name, or a subquery in parentheses with an alias."""
    return jdbc_reader(spark, target, table, split).load()


def serving_types(preds: DataFrame) -> DataFrame:
    """Types of the serving table: numeric id, real timestamp; what is neither becomes NULL."""
    return preds.withColumns(
        {"id": F.col("id").try_cast("bigint"), "scored_at": F.try_to_timestamp("scored_at")}
    )


def jdbc_append(df: DataFrame, target: JdbcTarget, table: str, partitions: int = 8) -> None:
    """Append through a bounded number of connections."""
    df.repartition(partitions).write.format("jdbc").options(**target.options(table)).mode("append").save()
