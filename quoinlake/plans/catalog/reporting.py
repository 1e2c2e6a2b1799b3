"""Reports over predictions."""

from pyspark.sql import functions as F

from quoinlake.fixed_values import GAP_LABELS
from quoinlake.functions.numeric import exact_round
from quoinlake.operators.report import (
    actual_vs_pred_by, batch_kpis, batch_rows, distinct_sorted, flagged_by, gap_histogram, list_batches, report_filter,
    top_undervalued,
)
from quoinlake.plans.catalog.registry import dec, query
from quoinlake.plans.catalog.standins import PRED_SQL, predictions
from quoinlake.sources.tables import overwrite_partitions
from quoinlake.workspace import new_folder


@query("report_filter", f"""with {PRED_SQL}
select id, district, model_version from preds where district in ('Quận 1', 'Quận 3', 'Quận 7') and is_undervalued""")
def filtered(spark, sf_dir):
    rows = report_filter(predictions(spark, sf_dir), ["Quận 1", "Quận 3", "Quận 7"], only_flagged=True)
    return rows.select("id", "district", "model_version")


@query("batch_rows", f"""with {PRED_SQL}
select id, district, listing_ppm2 from preds where model_version = 'v1996' and scored_at = '1996-05-01T00:00:00'""")
def one_batch(spark, sf_dir):
    """One scoring run of predictions written in their partitions; the other runs are pruned."""
    folder = new_folder(spark, "predictions")
    overwrite_partitions(predictions(spark, sf_dir), folder, ["model_version", "scored_at"])
    kept = spark.read.option("inferSchema", False).schema(predictions(spark, sf_dir).schema).parquet(folder)
    return batch_rows(kept, "v1996", "1996-05-01T00:00:00").select("id", "district", "listing_ppm2")


@query("flagged_by_group", f"""with {PRED_SQL}
select district, count(*) as n_rows from preds where is_undervalued group by 1""")
def flagged_by_group(spark, sf_dir):
    return flagged_by(predictions(spark, sf_dir))


@query("group_actual_vs_pred", f"""with {PRED_SQL}
select district, {dec('avg(listing_ppm2)', 2)} as mean_listing, {dec('avg(predicted_ppm2)', 2)} as mean_predicted
from preds where district is not null group by 1""")
def group_actual_vs_pred(spark, sf_dir):
    means = actual_vs_pred_by(predictions(spark, sf_dir))
    return means.select("district", *[exact_round(c, 2).alias(c) for c in ("mean_listing", "mean_predicted")])


@query("batch_kpis", f"""with {PRED_SQL}
select count(*) as n_rows, {dec('100 * avg(is_undervalued::int)', 4)} as pct_undervalued,
  {dec('avg(predicted_ppm2)', 4)} as mean_predicted from preds""")
def kpis(spark, sf_dir):
    return batch_kpis(predictions(spark, sf_dir)).select(
        "n_rows", *[exact_round(c, 4).alias(c) for c in ("pct_undervalued", "mean_predicted")])


_BINS = ", ".join(f"({i}, '{label}')" for i, label in enumerate(GAP_LABELS))


@query("gap_histogram", f"""with {PRED_SQL},
binned as (select case when g <= -20 then 0 when g <= -10 then 1 when g <= 0 then 2 when g <= 10 then 3
  when g <= 20 then 4 else 5 end as bin from (select undervalued_ratio * 100 as g from preds) where g is not null)
select b.bin::int as bin, b.label, count(binned.bin) as n_rows
from (values {_BINS}) as b(bin, label) left join binned using (bin) group by 1, 2""")
def histogram(spark, sf_dir):
    return gap_histogram(predictions(spark, sf_dir))


@query("list_batches", f"with {PRED_SQL} select distinct model_version, scored_at from preds")
def batches(spark, sf_dir):
    return list_batches(predictions(spark, sf_dir))


@query("topk_undervalued", f"""with {PRED_SQL}
select id, district, {dec('undervalued_ratio', 4)} as undervalued_ratio from (
  select * from preds where is_undervalued order by preds.undervalued_ratio desc, id limit 15)""")
def topk(spark, sf_dir):
    return top_undervalued(predictions(spark, sf_dir)).select(
        "id", "district", exact_round("undervalued_ratio", 4).alias("undervalued_ratio"))


@query("distinct_sorted", f"with {PRED_SQL} select distinct district from preds where district is not null")
def districts(spark, sf_dir):
    return distinct_sorted(predictions(spark, sf_dir), "district")
