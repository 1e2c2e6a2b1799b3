"""Flags, splits, features, model search and decisions."""

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoinlake.fixed_values import CONTEXT_COLUMNS, LABEL
from quoinlake.functions.numeric import exact_round, hash_percent
from quoinlake.operators.compiled import agreement, predicted
from quoinlake.operators.context import attach_context, context_present, fit_gate
from quoinlake.operators.features import (
    BASE_NUMBERS, CATEGORIES, ListingFeatures, default_category, feature_stages, label_index, one_hot_slots, scale_fit,
    scale_std,
)
from quoinlake.operators.impute import impute_fit, impute_train
from quoinlake.operators.model import (
    ablate, ablation_pivot, best_model, current_pointer, drift_check, load_model, model_cases,
    promotion_decision, regression_metrics, save_model, stable_split,
)
from quoinlake.operators.score import flag_undervalued, to_predictions, with_total_value
from quoinlake.operators.sizing import BROADCAST_ROWS
from quoinlake.operators.sums import fold_sums, linear_errors
from quoinlake.plans.catalog.registry import dec, query, table
from quoinlake.plans.catalog.pool import FIT_SQL
from quoinlake.plans.catalog.series import features
from quoinlake.plans.catalog.standins import (
    NEWEST_SQL, PRED_SQL, RAW_SQL, market_feature_sql, monthly_feature_sql, newest_listings, predictions, raw_listings,
    sale_pool, stored,
)
from quoinlake.workspace import new_folder

GROUP = ["district", "property_type_known"]


def group_mean_scored(spark, sf_dir) -> DataFrame:
    """Newest sale listings, each priced at the mean of its district and type.

    The means are broadcast only after the groups of the unfiltered scan, a bound on theirs,
    are counted; the facts are then de-duplicated in one shuffle and not moved again.
    """
    groups = raw_listings(spark, sf_dir, dealt_out=False).select("district", "property_type").distinct()
    n_groups = groups.limit(BROADCAST_ROWS + 1).count()
    pool = sale_pool(spark, sf_dir).withColumn("property_type_known", F.coalesce("property_type", F.lit("UNKNOWN")))
    newest = newest_listings(pool)
    means = newest.groupBy(*GROUP).agg(exact_round(F.avg("price_per_m2"), 6).alias("predicted_ppm2"))
    scored = newest.join(F.broadcast(means) if n_groups <= BROADCAST_ROWS else means, GROUP)
    return with_total_value(flag_undervalued(scored))


FLAG_SQL = f"""{NEWEST_SQL},
typed as (select *, coalesce(property_type, 'UNKNOWN') as property_type_known from newest),
means as (select district, property_type_known, {dec('avg(price_per_m2)', 6)} as predicted_ppm2 from typed group by 1, 2),
scored as (
  select *, (predicted_ppm2 - price_per_m2) / predicted_ppm2 as ratio, {dec('predicted_ppm2 * area * 1000000', 0)}::bigint as total
  from typed join means using (district, property_type_known))"""


@query("undervalued_flag", f"""with {FLAG_SQL}
select ad_id, district, predicted_ppm2, {dec('ratio', 4)} as undervalued_ratio, ratio >= 0.2::double as is_undervalued,
  total as predicted_total_vnd from scored""")
def undervalued_flag(spark, sf_dir):
    return group_mean_scored(spark, sf_dir).select(
        "ad_id", "district", "predicted_ppm2", exact_round("undervalued_ratio", 4).alias("undervalued_ratio"),
        "is_undervalued", "predicted_total_vnd")


@query("prediction_projection", f"""with {FLAG_SQL}
select ad_id as id, district, area as area_m2, {dec('price_per_m2', 2)} as listing_ppm2,
  {dec('predicted_ppm2', 2)} as predicted_ppm2, total as predicted_total_vnd, {dec('ratio', 4)} as undervalued_ratio,
  ratio >= 0.2::double as is_undervalued, url, 'v1' as model_version, '2024-01-01T00:00:00' as scored_at from scored""")
def prediction_projection(spark, sf_dir):
    return to_predictions(group_mean_scored(spark, sf_dir), "v1", "2024-01-01T00:00:00")


@query("stable_split", """
select k as l_orderkey, ('0x' || substr(md5(k::varchar), 1, 8))::bigint % 100 as bucket,
  ('0x' || substr(md5(k::varchar), 1, 8))::bigint % 100 < 80 as in_train, n_rows
from (select l_orderkey as k, count(*) as n_rows from lineitem group by 1)""")
def split(spark, sf_dir):
    keys = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_rows"))
    train, test = stable_split(keys, ["l_orderkey"])
    both = train.withColumn("in_train", F.lit(True)).unionByName(test.withColumn("in_train", F.lit(False)))
    return both.select("l_orderkey", hash_percent("l_orderkey").alias("bucket"), "in_train", "n_rows")


@query("label_index", f"""with {RAW_SQL},
c as (select interior as label, count(*) as n_rows from (select coalesce(interior, 'UNKNOWN') as interior from raw) group by 1)
select label, n_rows, (row_number() over (order by n_rows desc, label) - 1)::double as label_idx from c""")
def labels(spark, sf_dir):
    return label_index(default_category(raw_listings(spark, sf_dir), ["interior"]), "interior")


@query("one_hot", f"""with {RAW_SQL},
known as (select property_type, count(*) as n from raw where property_type is not null group by 1),
ranked as (select property_type, row_number() over (order by n desc, property_type) - 1 as i from known)
select raw.ad_id, coalesce(i = 0, false)::int as pt_0, coalesce(i = 1, false)::int as pt_1, coalesce(i = 2, false)::int as pt_2, (i is null)::int as pt_unseen
from raw left join ranked using (property_type)""")
def hot(spark, sf_dir):
    """The slots of the three most frequent labels and the spare one, by index: any number of labels will do."""
    raw = raw_listings(spark, sf_dir)
    slots = one_hot_slots(raw, "property_type", label_index(raw, "property_type"), "pt")
    flags = {f"pt_{i}": (F.col("pt_slot") == i) & (i < F.col("pt_size") - 1) for i in range(3)}
    flags["pt_unseen"] = F.col("pt_slot") == F.col("pt_size") - 1
    return slots.select("ad_id", *[flag.cast("int").alias(name) for name, flag in flags.items()])


@query("std_scale", f"""
with s as (select stddev_samp(l_quantity) as sq, stddev_samp(l_extendedprice) as sp from lineitem)
select l_orderkey, l_linenumber, l_partkey, {dec('l_quantity / sq', 4)} as l_quantity,
  {dec('l_extendedprice / sp', 4)} as l_extendedprice, 0.0::double as one from lineitem, s""")
def scaled(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").withColumn("one", F.lit(1.0))
    cols = ["l_quantity", "l_extendedprice", "one"]
    out = scale_std(line, scale_fit(line, cols))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", *[exact_round(c, 4).alias(c) for c in cols])


METRICS_SQL = f"""{PRED_SQL},
e as (select model_version, listing_ppm2 as y, predicted_ppm2 as p,
  case when is_undervalued then 'macro' else 'no_macro' end as features from preds),
metrics as (
  select model_version as model, features, count(*) as n_rows, sqrt(avg((y - p) * (y - p))) as rmse,
    avg(abs(y - p)) as mae, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) as r2 from e group by all),
shown as (select model, features, n_rows, {dec('rmse', 4)} as rmse, {dec('mae', 4)} as mae, {dec('r2', 4)} as r2 from metrics)"""


def metrics_table(spark, sf_dir) -> DataFrame:
    """A metrics table made by judging the formula predictions per year and flag."""
    preds = predictions(spark, sf_dir).select(
        F.col("model_version").alias("model"),
        F.when(F.col("is_undervalued"), "macro").otherwise("no_macro").alias("features"),
        "listing_ppm2", "predicted_ppm2")
    metrics = regression_metrics(preds, "listing_ppm2", "predicted_ppm2", ["model", "features"])
    return metrics.withColumns({c: exact_round(c, 4) for c in ("rmse", "mae", "r2")})


@query("regression_metrics", f"with {METRICS_SQL} select * from shown")
def metrics(spark, sf_dir):
    return metrics_table(spark, sf_dir)


@query("best_model", f"with {METRICS_SQL} select * from shown order by rmse, model, features limit 1")
def best(spark, sf_dir):
    return best_model(metrics_table(spark, sf_dir))


@query("ablation_pivot", f"""with {METRICS_SQL}
select model, max(case when features = 'macro' then rmse end) as macro,
  max(case when features = 'no_macro' then rmse end) as no_macro,
  {dec("max(case when features = 'macro' then rmse end) - max(case when features = 'no_macro' then rmse end)", 4)} as delta_rmse
from shown group by 1""")
def ablation(spark, sf_dir):
    pivoted = ablation_pivot(metrics_table(spark, sf_dir))
    return pivoted.withColumn("delta_rmse", exact_round("delta_rmse", 4))


@query("drift_check", f"""with {METRICS_SQL},
b as (select model, rmse from shown where features = 'macro'), h as (select model, rmse from shown where features = 'no_macro')
select h.rmse > b.rmse * 1.5 as drift, h.rmse as batch_rmse, b.rmse as baseline_rmse,
  {dec('b.rmse * 1.5', 3)} as drift_threshold, h.model as model_version from h join b using (model)""")
def drift(spark, sf_dir):
    table_ = metrics_table(spark, sf_dir)
    baseline = table_.where("features = 'macro'").select(F.col("model").alias("version"), F.col("rmse").alias("baseline_rmse"))
    holdout = table_.where("features = 'no_macro'").select(F.col("model").alias("model_version"), "rmse")
    return drift_check(holdout, baseline).withColumn("drift_threshold", exact_round("drift_threshold", 3))


@query("promotion_decision", f"""with {METRICS_SQL},
c as (select model as version, min(rmse) as baseline_rmse from shown group by 1),
p as (select version as current_version, baseline_rmse as current_rmse from c where version <= 'v1997' order by version desc limit 1)
select version, baseline_rmse, current_version, current_rmse,
  case when current_version is null then 'first' when version = current_version then 'noop'
    when baseline_rmse <= current_rmse then 'promote' else 'keep' end as decision,
  case when version = current_version or baseline_rmse > current_rmse then current_version else version end as serving
from c left join p on true""")
def promotion(spark, sf_dir):
    """Each year's model against the pointer left by the promotions up to 1997."""
    candidates = best_model(metrics_table(spark, sf_dir), by=["model"]).select(
        F.col("model").alias("version"), F.col("rmse").alias("baseline_rmse"))
    promotions = candidates.where("version <= 'v1997'").withColumn("promoted_at", F.col("version"))
    return promotion_decision(candidates, current_pointer(promotions))


# --- Spark ML ----------------------------------------------------------------

def train_features(spark, sf_dir) -> DataFrame:
    """The training table written once: newest listings, imputed, with their context."""
    pool = sale_pool(spark, sf_dir)
    newest = stored(spark, newest_listings(pool), "newest")
    clean = impute_train(newest, impute_fit(newest))
    gate_on = fit_gate(clean).first()["gate_on"]
    return stored(spark, attach_context(clean, *features(spark, sf_dir), gate_on), "features")


def _vector_sql() -> str:
    """The same vector in SQL: fill by mean, one column per label, divide by deviation, add up."""
    whole = ["bedrooms", "floors", "rank_quan", "year", "month", "quarter", "dayofweek"]
    numbers = ["log_area", *whole, *CONTEXT_COLUMNS]
    labels = {"property_type": ["A", "N", "R", "UNKNOWN"], "interior": ["Nội thất F", "Nội thất O", "UNKNOWN"]}
    hot = {f"{c}_{i}": f"(coalesce({c}, 'UNKNOWN') = '{label}')::int"
           for c, known in labels.items() for i, label in enumerate(known)}
    every_column = [*numbers, *hot]
    mean = {c: f"trunc(avg({c}))" if c in whole else f"avg({c})" for c in numbers}
    return f"""with {FIT_SQL}, {market_feature_sql()}, {monthly_feature_sql()},
clean as (
  select url, ln(area) as log_area, coalesce(bedrooms, (select bedrooms from med)) as bedrooms, coalesce(floors, 1) as floors,
    rank_quan, year(posted_at) as year, month(posted_at) as month, quarter(posted_at) as quarter,
    dayofweek(posted_at) + 1 as dayofweek, interior, property_type, posted_at from pass2),
joined as (
  select clean.*, {', '.join(f'{dec(c, 4)} as {c}' for c in CONTEXT_COLUMNS)}
  from clean left join daily on posted_at is not null and d = least(posted_at::date, (select max(d) from daily))
  left join monthly on posted_at is not null and monthly.month = least(strftime(posted_at, '%Y-%m'), (select max(month) from monthly))),
means as (select {', '.join(f'{m} as {c}' for c, m in mean.items())} from joined),
vec as (
  select url, {', '.join(f'coalesce(j.{c}, means.{c}) as {c}' for c in numbers)},
    {', '.join(f'{e} as {c}' for c, e in hot.items())} from joined j, means),
stds as (select {', '.join(f'nullif(stddev_samp({c}), 0) as {c}' for c in every_column)} from vec)
select url, {len(every_column) + len(labels)} as dim,
  {dec(' + '.join(f'coalesce(vec.{c} / stds.{c}, 0)' for c in every_column), 3)} as total from vec, stds"""


@query("feature_vector", _vector_sql())
def feature_vector(spark, sf_dir):
    """Vector length and value sum of every training row."""
    feats = train_features(spark, sf_dir)
    fitted = Pipeline(stages=feature_stages(context_present(feats))).fit(feats)
    values = vector_to_array("features")
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return fitted.transform(feats).select("url", F.size(values).alias("dim"), exact_round(total, 3).alias("total"))


@query("train_grid")
def train_grid(spark, sf_dir):
    """All three models with their whole grids on every training row, three folds, with and without context."""
    feats = train_features(spark, sf_dir)
    train, test = stable_split(feats, ["url"])
    sets = {"macro": context_present(feats), "no_macro": []}
    rows, _ = ablate(train, test, sets, ["url"], model_cases(), parallelism=8)
    return spark.createDataFrame(
        [(r["model"], r["features"], r["rmse"], r["mae"], r["r2"], r["cv_rmse_train"]) for r in rows],
        "model string, features string, rmse double, mae double, r2 double, cv_rmse_train double")


SINGLE = ["log_area", "bedrooms", "floors", "rank_quan"]
SETTINGS = [(0.0, 0.0), (0.0, 0.5), (0.1, 0.0), (0.1, 0.5)]


def _single_sql() -> str:
    """Least squares of one number with penalties in closed form, for each number, fold and setting."""
    settings = ", ".join(f"({reg}::double, {elastic}::double)" for reg, elastic in SETTINGS)
    parts = []
    for c in SINGLE:
        mean = f"avg({c})" if c == "log_area" else f"trunc(avg({c}))"
        parts.append(f"""
select '{c}' as feature, k, fold, coalesce({c}, (select {mean} from clean t where t.fold <> k)) as x, price_per_m2 as y
from clean, (select unnest([0, 1, 2]) as k)""")
    return f"""with {FIT_SQL},
clean as (
  select ln(area) as log_area, coalesce(bedrooms, (select bedrooms from med)) as bedrooms, coalesce(floors, 1) as floors, rank_quan,
    price_per_m2, ('0x' || substr(md5(url), 1, 8))::bigint % 100 % 3 as fold from pass2),
x as ({' union all '.join(parts)}),
m as (
  select feature, k, avg(x) as xm, avg(y) as ym, stddev_pop(x) as sx, stddev_pop(y) as sy, covar_pop(x, y) as c
  from x where fold <> k group by all),
b as (
  select m.*, reg, elastic, c / (sx * sy) as r,
    sign(r) * greatest(abs(r) - elastic * reg / sy, 0) / (1 + (1 - elastic) * reg / sy) * sy / sx as slope
  from m, (values {settings}) s(reg, elastic))
select feature, reg, elastic, k::int as fold, {dec('sqrt(avg(power(y - ym - slope * (x - xm), 2)))', 6)} as rmse
from b join x using (feature, k) where x.fold = k group by all"""


@query("linear_search", _single_sql())
def linear_search(spark, sf_dir):
    """Cross-validation of every linear setting on single numbers, from one pass' sums of products."""
    feats = ListingFeatures().transform(train_features(spark, sf_dir))
    sums = fold_sums(feats, SINGLE, [], LABEL, hash_percent("url") % 3)
    rows = [(c, *SETTINGS[s], k, rmse) for c in SINGLE for (s, k), rmse in linear_errors(sums, [c], SETTINGS, 3).items()]
    frame = spark.createDataFrame(rows, "feature string, reg double, elastic double, fold int, rmse double")
    return frame.withColumn("rmse", exact_round("rmse", 6))


@query("score_batch", f"""with {FIT_SQL},
clean as (
  select *, ('0x' || substr(md5(url), 1, 8))::bigint % 100 < 80 as in_train from pass2),
fit as (select regr_slope(price_per_m2, ln(area)) as b, regr_intercept(price_per_m2, ln(area)) as a from clean where in_train),
e as (select clean.*, {dec('a + b * ln(area)', 3)} as predicted from clean, fit),
scored as (
  select *, (predicted - price_per_m2) / predicted as ratio, {dec('predicted * area * 1000000', 0)}::bigint as total from e)
select ad_id as id, district, area as area_m2, {dec('price_per_m2', 2)} as listing_ppm2,
  {dec('predicted', 2)} as predicted_ppm2, total as predicted_total_vnd, {dec('ratio', 4)} as undervalued_ratio,
  ratio >= 0.2::double as is_undervalued, url, '1' as model_version, '2024-01-01T00:00:00' as scored_at from scored""")
def score_batch(spark, sf_dir):
    """A linear model of the area saved, loaded again and applied to every training row."""
    feats = train_features(spark, sf_dir)
    stages = [*feature_stages(numbers=["log_area"], categories=[]), model_cases()[0].estimator]
    store = new_folder(spark, "models")
    save_model(Pipeline(stages=stages).fit(stable_split(feats, ["url"])[0]), store, "1")
    scored = predicted(feats, load_model(store, "1"), "predicted_ppm2").withColumn(
        "predicted_ppm2", exact_round("predicted_ppm2", 3))
    return to_predictions(with_total_value(flag_undervalued(scored)), "1", "2024-01-01T00:00:00")


@query("score_compiled", f"with {FIT_SQL} select name as model, count(*) as n_rows, count(*) as n_equal from pass2, "
                         "(select unnest(['GBT', 'LinearRegression', 'RandomForest']) as name) group by 1")
def score_compiled(spark, sf_dir):
    """Models of every column and context as one expression: their estimates are those of the stages on every row."""
    feats = train_features(spark, sf_dir)
    context = context_present(feats)
    fitted = Pipeline(stages=feature_stages(context)).fit(feats)
    columns = [*BASE_NUMBERS, *context, *[f"{c}_known" for c in CATEGORIES], "features", LABEL]
    vectors = stored(spark, fitted.transform(feats).select(*columns), "vectors")
    models = {
        case.name: PipelineModel(stages=[*fitted.stages, case.estimator.fit(vectors, case.grid[-1])])
        for case in model_cases(trees=(3,), forest_depths=(6,), boost_depths=(4,), rounds=(3,))
    }
    return agreement(models, vectors, feats)
