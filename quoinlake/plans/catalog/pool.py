"""The listing pool: typing, scope, tiers, de-duplication, outlier bounds, imputation."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoinlake.fixed_values import DISTRICT_TIERS
from quoinlake.functions.numeric import calendar_cols, exact_round
from quoinlake.operators.clean import parse_listings, sale_scope, unmapped, with_unit_price
from quoinlake.operators.features import date_keys, default_category, log_col, with_calendar
from quoinlake.operators.impute import (
    frozen_bounds, frozen_fill, impute_fit, impute_serve, impute_train, iqr_bounds, iqr_fit,
)
from quoinlake.plans.catalog.registry import dec, query, table, values_of
from quoinlake.plans.catalog.standins import (
    NEWEST_SQL, POOL_SQL, RAW_SQL, newest_listings, raw_listings, sale_pool, stored,
)

PARSED = ["ad_id", "price", "area", "bedrooms", "floors", "latitude", "longitude", "posted_at"]


@query("parse_types", f"with {RAW_SQL} select {', '.join(PARSED)} from raw")
def parse_types(spark, sf_dir):
    parsed = parse_listings(raw_listings(spark, sf_dir))
    return parsed.withColumn("posted_at", F.col("posted_at").cast("timestamp_ntz")).select(*PARSED)


@query("scope_filter", f"""with {RAW_SQL}
select ad_id, price, area, district from raw where contains(city, 'Hồ Chí Minh') and price > 500000000 and area > 0""")
def scope_filter(spark, sf_dir):
    return sale_scope(parse_listings(raw_listings(spark, sf_dir))).select("ad_id", "price", "area", "district")


@query("unit_price", f"with {RAW_SQL} select ad_id, {dec('price / 1000000.0::double / area', 4)} as price_per_m2 from raw")
def unit_prices(spark, sf_dir):
    priced = with_unit_price(parse_listings(raw_listings(spark, sf_dir)))
    return priced.select("ad_id", exact_round("price_per_m2", 4).alias("price_per_m2"))


@query("tier_map", f"with {POOL_SQL} select ad_id, district, rank_quan from pool")
def tier_map(spark, sf_dir):
    return sale_pool(spark, sf_dir).select("ad_id", "district", "rank_quan")


@query("unmapped_keys", f"""with {RAW_SQL}
select district, count(*) as n_rows from raw
where district not in (select district from {values_of(DISTRICT_TIERS, 't', 'district', 'tier')}) group by 1""")
def unmapped_keys(spark, sf_dir):
    return unmapped(raw_listings(spark, sf_dir), DISTRICT_TIERS)


@query("calendar_features", f"""
select l_orderkey, l_linenumber, l_partkey, year(l_shipdate)::int as year, month(l_shipdate)::int as month,
  quarter(l_shipdate)::int as quarter, (dayofweek(l_shipdate) + 1)::int as dayofweek, {dec('ln(l_quantity)', 6)} as log_area
from lineitem""")
def calendar_features(spark, sf_dir):
    line = log_col(with_calendar(table(spark, sf_dir, "lineitem"), "l_shipdate"), "l_quantity", "log_area")
    return line.select("l_orderkey", "l_linenumber", "l_partkey", *calendar_cols("l_shipdate"),
                       exact_round("log_area", 6).alias("log_area"))


@query("category_default", f"""with {RAW_SQL}
select coalesce(property_type, 'UNKNOWN') as property_type, coalesce(interior, 'UNKNOWN') as interior, count(*) as n_rows
from raw group by all""")
def category_default(spark, sf_dir):
    full = default_category(raw_listings(spark, sf_dir), ["property_type", "interior"])
    return full.groupBy("property_type", "interior").agg(F.count(F.lit(1)).alias("n_rows"))


@query("month_key", """
select l_shipdate::date as posted_date, strftime(l_shipdate, '%Y-%m') as posted_month, count(*) as n_rows
from lineitem group by all""")
def month_keys(spark, sf_dir):
    keyed = date_keys(table(spark, sf_dir, "lineitem"), "l_shipdate")
    return keyed.groupBy("posted_date", "posted_month").agg(F.count(F.lit(1)).alias("n_rows"))


LISTING = ["url", "dt", "price", "area", "district", "bedrooms", "floors", "interior", "rank_quan"]


def listing_rows(df: DataFrame) -> DataFrame:
    return df.select(*LISTING, exact_round("price_per_m2", 4).alias("price_per_m2"))


LISTING_ROWS = ", ".join(LISTING) + f", {dec('price_per_m2', 4)} as price_per_m2"


@query("dedup_latest", f"with {NEWEST_SQL} select {LISTING_ROWS} from newest")
def dedup_latest(spark, sf_dir):
    return listing_rows(newest_listings(sale_pool(spark, sf_dir)))


def bounds_rows(spark, bounds: dict) -> DataFrame:
    rows = [(c, lo, hi) for c, (lo, hi) in bounds.items()]
    frame = spark.createDataFrame(rows, "column string, lo double, hi double")
    return frame.select("column", exact_round("lo", 4).alias("lo"), exact_round("hi", 4).alias("hi"))


@query("iqr_bounds", f"""
with q as (select quantile_disc(value, 0.25) as q1, quantile_disc(value, 0.75) as q3 from events)
select 'value' as "column", {dec('q1 - 1.5 * (q3 - q1)', 4)} as lo, {dec('q3 + 1.5 * (q3 - q1)', 4)} as hi from q""")
def iqr_of_events(spark, sf_dir):
    return bounds_rows(spark, {"value": iqr_bounds(table(spark, sf_dir, "events"), "value")})


IQR_SQL = """p as (select quantile_disc(price_per_m2, 0.25) as q1, quantile_disc(price_per_m2, 0.75) as q3 from {0}),
pb as (select q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi from p),
pass1 as (select * from {0} where price_per_m2 between (select lo from pb) and (select hi from pb)),
a as (select quantile_disc(area, 0.25) as q1, quantile_disc(area, 0.75) as q3 from pass1),
ab as (select q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi from a),
pass2 as (select * from pass1 where area between (select lo from ab) and (select hi from ab))"""


@query("iqr_sequential", f"""with {POOL_SQL}, {IQR_SQL.format('pool')}
select 'price_per_m2' as "column", {dec('lo', 4)} as lo, {dec('hi', 4)} as hi from pb
union all select 'area', {dec('lo', 4)}, {dec('hi', 4)} from ab""")
def iqr_sequential(spark, sf_dir):
    pool = sale_pool(spark, sf_dir).select("price_per_m2", "area").persist()
    try:
        return bounds_rows(spark, iqr_fit(pool))
    finally:
        pool.unpersist()


FIT_SQL = f"""{NEWEST_SQL}, {IQR_SQL.format('newest')},
med as (select coalesce(quantile_disc(bedrooms, 0.5), 1)::int as bedrooms from pass2)"""


@query("impute_fit", f"""with {FIT_SQL}
select (select count(*) from newest) as n_rows_dedup, (select count(*) from pass2) as n_rows_after_iqr,
  {dec('(select lo from pb)', 4)} as price_lo, {dec('(select hi from pb)', 4)} as price_hi,
  {dec('(select lo from ab)', 4)} as area_lo, {dec('(select hi from ab)', 4)} as area_hi,
  '1' as floors, (select bedrooms from med)::varchar as bedrooms, 'UNKNOWN' as interior""")
def fitted_stats(spark, sf_dir):
    stats = impute_fit(newest_listings(sale_pool(spark, sf_dir)))
    sides = {f"{name}_{end}": exact_round(F.col("iqr")[column][end], 4)
             for name, column in (("price", "price_per_m2"), ("area", "area")) for end in ("lo", "hi")}
    return stats.select(
        "n_rows_dedup", "n_rows_after_iqr", *[c.alias(n) for n, c in sides.items()],
        *[F.col("fill")[c].alias(c) for c in ("floors", "bedrooms", "interior")])


_FILLED = """url, dt, price, area, district, coalesce(bedrooms, (select bedrooms from med))::int as bedrooms,
  coalesce(floors, 1)::int as floors, coalesce(interior, 'UNKNOWN') as interior, rank_quan, """ + \
    f"{dec('price_per_m2', 4)} as price_per_m2"


@query("impute_train", f"with {FIT_SQL} select {_FILLED} from pass2")
def imputed_for_training(spark, sf_dir):
    """The de-duplicated pool is written once, for the fit and for the rows."""
    newest = stored(spark, newest_listings(sale_pool(spark, sf_dir)), "newest")
    return listing_rows(impute_train(newest, impute_fit(newest)))


@query("impute_serve", f"with {FIT_SQL} select {_FILLED} from pool")
def imputed_for_serving(spark, sf_dir):
    pool = sale_pool(spark, sf_dir)
    return listing_rows(impute_serve(pool, impute_fit(newest_listings(pool))))
