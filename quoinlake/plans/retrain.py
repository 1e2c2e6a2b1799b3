"""Retrain: statistics, clean data, gated context, model search, promotion."""

import zlib
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quoinlake.operators.context import (
    attach_context, context_present, fit_gate, market_features, market_quotes, monthly_features,
)
from quoinlake.operators.dedup import newest_first
from quoinlake.operators.impute import impute_fit, impute_train
from quoinlake.operators.model import (
    Case, ablate, best_model, current_pointer, current_version, is_training, metrics_rows, promotion_decision, save_model,
    stable_split,
)
from quoinlake.plans.lake import Lake
from quoinlake.schemas import METRICS, PROMOTIONS
from quoinlake.sources.newest import NewestTable, advance, catch_up, newest_rows
from quoinlake.sources.tables import (
    append_table, latest_version, overwrite_partitions, overwrite_table, table_exists,
)

KEY = ["url"]


def context_tables(spark: SparkSession, lake: Lake) -> tuple[DataFrame, DataFrame]:
    """Daily and monthly feature tables from the stored series."""
    daily = market_features(market_quotes(spark.read.parquet(lake.market)))
    monthly = monthly_features(latest_version(spark, lake.monthly))
    return daily, monthly


def newest_table(spark: SparkSession, lake: Lake) -> NewestTable:
    """The newest listing of each URL, kept by days."""
    columns = StructType([f for f in spark.read.parquet(lake.pool).schema.fields if f.name != "dt"])
    name = f"newest_{zlib.crc32(lake.newest.encode()):08x}"
    return NewestTable(name, lake.newest, columns, *KEY, newest_first("ad_id", "price", "area"))


def fit_cleaning(spark: SparkSession, lake: Lake, version: str) -> DataFrame:
    """Fit the statistics on the whole pool, store them, write the training rows."""
    table = newest_table(spark, lake)
    catch_up(spark, table, lake.pool)
    advance(spark, table)
    # The de-duplicated pool is written once and read by every later step.
    overwrite_table(newest_rows(spark, table), f"{lake.clean}_deduped")
    deduped = spark.read.parquet(f"{lake.clean}_deduped")
    overwrite_table(impute_fit(deduped, lake.pool), lake.stats(version))
    clean = impute_train(deduped, spark.read.parquet(lake.stats(version)))
    overwrite_table(clean, lake.clean)
    return spark.read.parquet(lake.clean)


def build_features(spark: SparkSession, lake: Lake, clean: DataFrame, version: str) -> DataFrame:
    """Fit and store the gate; add the macro columns it admits."""
    overwrite_table(fit_gate(clean), lake.gate(version))
    gate_on = spark.read.parquet(lake.gate(version)).first()["gate_on"]
    feats = attach_context(clean, *context_tables(spark, lake), gate_on) if gate_on else clean
    overwrite_table(feats, lake.features)
    return spark.read.parquet(lake.features)


def train(
    spark: SparkSession, lake: Lake, version: str, cases: "list[Case] | None" = None,
    folds: int = 3, parallelism: int = 2,
) -> DataFrame:
    """Search models with and without context; save the best; store one metrics row each.

    With the gate off both feature sets are the same columns, so one search serves both.
    """
    feats = spark.read.parquet(lake.features)
    train_rows, test_rows = stable_split(feats, KEY)
    context = context_present(feats)
    sets = {"macro": context, "no_macro": []} if context else {"macro": []}
    rows, models = ablate(train_rows, test_rows, sets, KEY, cases, folds, parallelism)
    if not context:
        rows += [{**r, "features": "no_macro"} for r in rows]
        models |= {(name, "no_macro"): m for (name, _), m in list(models.items())}
    n_rows, n_train = feats.agg(F.count(F.lit(1)), F.count_if(is_training(KEY))).first()
    stored = metrics_rows(rows, version, datetime.now(timezone.utc), n_train, n_rows - n_train)
    table = spark.createDataFrame(stored, METRICS)
    chosen = best_model(table).first()
    save_model(models[(chosen["model"], chosen["features"])], lake.models, version)
    overwrite_partitions(table, lake.metrics, ["version"])
    return table


def versions_rmse(spark: SparkSession, lake: Lake) -> DataFrame:
    """Baseline RMSE of every trained version: its best model's holdout RMSE."""
    metrics = spark.read.schema(METRICS).parquet(lake.metrics)
    return best_model(metrics, by=["version"]).select("version", F.col("rmse").alias("baseline_rmse"))


def version_in_force(spark: SparkSession, lake: Lake, default: str) -> str:
    if not table_exists(spark, lake.promotions):
        return default
    return current_version(spark.read.schema(PROMOTIONS).parquet(lake.promotions), default)


def promote(spark: SparkSession, lake: Lake, version: str) -> str:
    """Move the pointer if the new version is not worse; returns the decision."""
    known = versions_rmse(spark, lake).where(F.col("version") == version)
    if table_exists(spark, lake.promotions):
        pointer = current_pointer(spark.read.schema(PROMOTIONS).parquet(lake.promotions))
    else:
        pointer = current_pointer(spark.createDataFrame([], PROMOTIONS))
    row = promotion_decision(known, pointer).first()
    if row["decision"] in ("first", "promote"):
        entry = [(version, row["baseline_rmse"], datetime.now(timezone.utc))]
        append_table(spark.createDataFrame(entry, PROMOTIONS), lake.promotions)
    return row["decision"]


def retrain(
    spark: SparkSession, lake: Lake, version: str, cases: "list[Case] | None" = None,
    folds: int = 3, parallelism: int = 2,
) -> str:
    """Train `version` and let it take over if it is not worse; the one in force is never trained over."""
    if version_in_force(spark, lake, "") == version:
        return "noop"
    clean = fit_cleaning(spark, lake, version)
    build_features(spark, lake, clean, version)
    train(spark, lake, version, cases, folds, parallelism)
    return promote(spark, lake, version)
