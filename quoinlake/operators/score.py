"""Scoring: value estimates, the undervalued flag and the prediction table."""

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoinlake.fixed_values import LABEL, UNDERVALUED_FROM
from quoinlake.functions.numeric import exact_round, relative_change, total_value
from quoinlake.operators.compiled import predicted
from quoinlake.schemas import PREDICTIONS


def flag_undervalued(
    df: DataFrame, estimate: str = "predicted_ppm2", actual: str = LABEL,
    threshold: float = UNDERVALUED_FROM,
) -> DataFrame:
    """Share by which the asking price lies below the estimate, and whether it is enough."""
    ratio = -relative_change(F.col(actual), F.col(estimate))
    return df.withColumn("undervalued_ratio", ratio).withColumn(
        "is_undervalued", F.col("undervalued_ratio") >= F.lit(threshold)
    )


def with_total_value(df: DataFrame, estimate: str = "predicted_ppm2", area: str = "area") -> DataFrame:
    return df.withColumn("predicted_total_vnd", total_value(estimate, area))


def score(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Apply a saved model; every input row gets an estimate, in one projection where the model allows it."""
    return with_total_value(flag_undervalued(predicted(df, model, "predicted_ppm2")))


def to_predictions(scored: DataFrame, version: str, scored_at: str) -> DataFrame:
    """Serving columns with their display precision."""
    columns = {
        "id": F.col("ad_id"),
        "district": F.col("district"),
        "area_m2": F.col("area"),
        "listing_ppm2": exact_round(LABEL, 2),
        "predicted_ppm2": exact_round("predicted_ppm2", 2),
        "predicted_total_vnd": F.col("predicted_total_vnd"),
        "undervalued_ratio": exact_round("undervalued_ratio", 4),
        "is_undervalued": F.col("is_undervalued"),
        "url": F.col("url"),
        "model_version": F.lit(version),
        "scored_at": F.lit(scored_at),
    }
    return scored.select(*[columns[f.name].cast(f.dataType).alias(f.name) for f in PREDICTIONS])
