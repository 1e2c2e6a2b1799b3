"""Report queries over the prediction table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoinlake.fixed_values import GAP_EDGES, GAP_LABELS, TOP_ROWS


def list_batches(preds: DataFrame) -> DataFrame:
    """Distinct scoring runs, newest first."""
    return preds.select("model_version", "scored_at").distinct().orderBy(
        F.col("scored_at").desc(), "model_version"
    )


def batch_rows(preds: DataFrame, version: str, scored_at: str) -> DataFrame:
    """Rows of one scoring run; predictions are partitioned by both columns, so others are not read."""
    return preds.where((F.col("model_version") == version) & (F.col("scored_at") == scored_at))


def report_filter(
    preds: DataFrame, districts: "list[str] | None" = None, only_flagged: bool = False
) -> DataFrame:
    """Rows of the chosen districts (NULL is never chosen), optionally flagged ones only."""
    if districts is not None:
        preds = preds.where(F.col("district").isin(*districts) if districts else F.lit(False))
    return preds.where("is_undervalued") if only_flagged else preds


def batch_kpis(preds: DataFrame) -> DataFrame:
    """Rows, percentage flagged (0 for an empty batch) and mean estimate."""
    flagged = F.avg(F.col("is_undervalued").cast("int"))
    return preds.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(100 * flagged, F.lit(0.0)).alias("pct_undervalued"),
        F.avg("predicted_ppm2").alias("mean_predicted"),
    )


def flagged_by(preds: DataFrame, group: str = "district", descending: bool = True) -> DataFrame:
    """Flagged rows per group, most first (or least first); ties by name."""
    n = F.col("n_rows").desc() if descending else F.col("n_rows").asc()
    counted = preds.where("is_undervalued").groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.orderBy(n, group)


def actual_vs_pred_by(preds: DataFrame, group: str = "district") -> DataFrame:
    """Mean asking and estimated unit price per group; a NULL group is left out."""
    return preds.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.avg("listing_ppm2").alias("mean_listing"), F.avg("predicted_ppm2").alias("mean_predicted")
    )


def gap_histogram(
    preds: DataFrame, edges: "tuple[float, ...]" = GAP_EDGES, labels: "tuple[str, ...]" = GAP_LABELS
) -> DataFrame:
    """Rows per right-closed bin of the gap in percent; empty bins stay, NULL gaps do not count.

    The bins are counted by one aggregate without grouping, so none can go missing.
    """
    gap = F.col("undervalued_ratio") * 100
    tests = []
    for i in range(len(labels)):
        above = gap > edges[i - 1] if i > 0 else gap.isNotNull()
        upto = gap <= edges[i] if i < len(edges) else gap.isNotNull()
        tests.append(F.count_if(above & upto))
    bins = F.array(*[
        F.struct(F.lit(i).alias("bin"), F.lit(label).alias("label"), n.alias("n_rows"))
        for i, (label, n) in enumerate(zip(labels, tests))
    ])
    return preds.agg(bins.alias("bins")).select(F.inline("bins"))


def top_undervalued(preds: DataFrame, n: int = TOP_ROWS) -> DataFrame:
    """The n flagged rows with the largest ratio; ties by id."""
    return preds.where("is_undervalued").orderBy(F.col("undervalued_ratio").desc(), "id").limit(n)


def distinct_sorted(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNotNull()).select(col).distinct().orderBy(col)
