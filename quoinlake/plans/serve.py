"""Daily run: clean one day, score it, check drift, retrain if needed."""

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoinlake.operators.clean import pool_day
from quoinlake.operators.context import attach_context
from quoinlake.operators.impute import impute_serve
from quoinlake.operators.model import (
    Case, drift_check, load_model, regression_metrics, stable_split,
)
from quoinlake.operators.score import score, to_predictions
from quoinlake.fixed_values import LABEL
from quoinlake.plans.lake import Lake
from quoinlake.plans.retrain import KEY, context_tables, newest_table, retrain, version_in_force, versions_rmse
from quoinlake.schemas import DRIFT_LOG
from quoinlake.sources.jdbc import JdbcTarget, jdbc_append, jdbc_read, serving_types
from quoinlake.sources.newest import put_day
from quoinlake.sources.tables import overwrite_day, overwrite_partitions, overwrite_table, read_table
from quoinlake.workspace import stored


def clean_day(spark: SparkSession, lake: Lake, day: str, **scope_args) -> DataFrame:
    """One raw day to its pool partition and the newest rows, replaced as a whole on a re-run."""
    raw = read_table(spark, lake.raw, day).drop("dt")
    overwrite_day(pool_day(raw, day, **scope_args), lake.pool, day)
    rows = read_table(spark, lake.pool, day)
    put_day(newest_table(spark, lake), rows, day)
    return rows


def score_day(spark: SparkSession, lake: Lake, day: str, version: str, scored_at: str) -> DataFrame:
    """Fill and add context as the version's own statistics and gate say, score, and write the predictions."""
    batch = impute_serve(read_table(spark, lake.pool, day), spark.read.parquet(lake.stats(version)))
    overwrite_day(batch, lake.scored_input, day)
    batch = read_table(spark, lake.scored_input, day)
    gate_on = spark.read.parquet(lake.gate(version)).first()["gate_on"]
    if gate_on:
        batch = attach_context(batch, *context_tables(spark, lake), gate_on)
    scored = score(batch, load_model(lake.models, version))
    scored = stored(scored, "scored")  # computed once for the predictions and the drift check
    preds = to_predictions(scored, version, scored_at)
    overwrite_partitions(preds, lake.predictions, ["model_version", "scored_at"])
    return scored


def check_drift(spark: SparkSession, lake: Lake, scored: DataFrame, version: str, day: str) -> bool:
    """Holdout error of the batch against the stored baseline; logged, not acted on.

    A batch without a holdout row gives no signal.
    """
    _, holdout = stable_split(scored, KEY)
    measured = regression_metrics(holdout, LABEL, "predicted_ppm2").where("n_rows > 0").select(
        F.lit(version).alias("model_version"), "rmse"
    )
    checked = drift_check(measured, versions_rmse(spark, lake)).withColumn(
        "checked_at", F.lit(datetime.now(timezone.utc))
    )
    rows = checked.select(*DRIFT_LOG.names).collect()
    # One entry for a day and version: running the day again replaces it.
    overwrite_table(spark.createDataFrame(rows, DRIFT_LOG), f"{lake.drift_log}/day={day}/version={version}")
    return any(r["drift"] for r in rows)


SERVED_KEY = ["id", "model_version", "scored_at"]


def not_yet_served(preds: DataFrame, served: DataFrame) -> DataFrame:
    """Predictions whose (id, model version, time) the serving table lacks; NULL ids included."""
    keys = [F.col(f"p.{k}").eqNullSafe(F.col(f"s.{k}")) for k in SERVED_KEY]
    return preds.alias("p").join(served.select(*SERVED_KEY).alias("s"), keys, "left_anti")


def load_predictions(
    spark: SparkSession, lake: Lake, target: JdbcTarget, version: str, scored_at: str, table: str = "predictions"
) -> None:
    """Append one batch to the serving database; a repeated load adds nothing."""
    batch = spark.read.parquet(lake.predictions).where(
        (F.col("model_version") == version) & (F.col("scored_at") == scored_at)
    )
    served = jdbc_read(spark, target, table).where(
        (F.col("model_version") == version) & (F.col("scored_at").cast("string") == F.lit(scored_at).cast("timestamp").cast("string"))
    )
    jdbc_append(not_yet_served(serving_types(batch), served), target, table)


@dataclass(frozen=True)
class DayResult:
    version: str
    drift: bool
    decision: "str | None"


def serve(
    spark: SparkSession, lake: Lake, day: str, default_version: str = "",
    cases: "list[Case] | None" = None, scored_at: "str | None" = None, target: "JdbcTarget | None" = None, **scope_args,
) -> DayResult:
    """Run one day. The first run of a lake trains before it can score. With a target the batch is loaded there."""
    clean_day(spark, lake, day, **scope_args)
    version = version_in_force(spark, lake, default_version)
    if not version:
        retrain(spark, lake, day, cases)
        version = version_in_force(spark, lake, day)
    scored = score_day(spark, lake, day, version, scored_at or f"{day}T00:00:00")
    if target is not None:
        load_predictions(spark, lake, target, version, scored_at or f"{day}T00:00:00")
    drift = check_drift(spark, lake, scored, version, day)
    return DayResult(version, drift, retrain(spark, lake, day, cases) if drift else None)
