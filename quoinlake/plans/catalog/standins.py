"""Listing-shaped views of the given tables, in Spark and in SQL.

A line item plays a listing; its supplier's nation gives the district; an order day gives
the market quotes. Gaps, bad text and NULLs are placed by rules on the keys.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoinlake.operators.clean import parse_listings, sale_scope, with_tier, with_unit_price
from quoinlake.fixed_values import DISTRICT_TIERS
from quoinlake.operators.dedup import latest_per_key, newest_first
from quoinlake.operators.sizing import spread
from quoinlake.plans.catalog.registry import table, values_of
from quoinlake import workspace


def every(n: int, *key: str) -> "F.Column":
    total = sum((F.col(k) for k in key[1:]), F.col(key[0]))
    return total % n == 0


# --- raw listings ------------------------------------------------------------

def raw_listings(spark: SparkSession, sf_dir: str, dealt_out: bool = True) -> DataFrame:
    """RAW_LISTING text columns plus dt."""
    line = table(spark, sf_dir, "lineitem")
    line = spread(line) if dealt_out else line
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    joined = line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    ad_id = F.concat_ws("-", "l_orderkey", "l_linenumber")
    vnd = F.round(F.col("l_extendedprice") * 100000).cast("bigint").cast("string")
    none = F.lit(None).cast("string")
    shipped = F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")
    return joined.select(
        ad_id.alias("ad_id"),
        F.concat(F.lit("Lô "), ad_id).alias("title"),
        F.when(every(97, "l_partkey"), "thoả thuận").otherwise(vnd).alias("price"),
        none.alias("price_string"),
        F.when(every(89, "l_partkey"), "m²").otherwise(
            F.concat(F.col("l_quantity").cast("string"), F.lit(" m²"))).alias("area"),
        none.alias("ward"),
        F.concat(F.lit("Quận "), "s_nationkey").alias("district"),
        F.when(F.col("s_nationkey") % 5 < 4, "Tp Hồ Chí Minh").otherwise("Hà Nội").alias("city"),
        F.when(~every(17, "l_partkey"), F.col("l_returnflag")).alias("property_type"),
        none.alias("ad_type"),
        F.when(~every(11, "l_partkey"), F.col("l_linenumber").cast("string")).alias("bedrooms"),
        none.alias("bathrooms"),
        F.when(~every(13, "l_partkey"), (F.col("l_suppkey") % 5 + 1).cast("string")).alias("floors"),
        none.alias("direction"),
        F.when(~every(7, "l_suppkey"), F.concat(F.lit("Nội thất "), "l_linestatus")).alias("interior"),
        none.alias("legal"),
        none.alias("apartment_type"),
        (F.lit(10.0) + F.col("l_discount")).alias("latitude"),
        (F.lit(106.0) + F.col("l_tax")).alias("longitude"),
        F.when(every(83, "l_partkey"), "chưa rõ").otherwise(shipped).alias("posted_at"),
        F.concat(F.lit("/lot/"), ad_id).alias("url"),
        shipped.alias("crawled_at"),
        F.to_date("l_shipdate").alias("dt"),
    )


RAW_SQL = """raw as (
  select l_orderkey || '-' || l_linenumber as ad_id,
    case when l_partkey % 97 = 0 then null else round(l_extendedprice * 100000)::double end as price,
    case when l_partkey % 89 = 0 then null else l_quantity end as area,
    'Quận ' || s_nationkey as district,
    case when s_nationkey % 5 < 4 then 'Tp Hồ Chí Minh' else 'Hà Nội' end as city,
    case when l_partkey % 17 <> 0 then l_returnflag end as property_type,
    case when l_partkey % 11 <> 0 then l_linenumber end as bedrooms,
    case when l_partkey % 13 <> 0 then (l_suppkey % 5 + 1)::int end as floors,
    case when l_suppkey % 7 <> 0 then 'Nội thất ' || l_linestatus end as interior,
    10.0::double + l_discount as latitude, 106.0::double + l_tax as longitude,
    case when l_partkey % 83 <> 0 then l_shipdate end as posted_at,
    '/lot/' || l_orderkey || '-' || l_linenumber as url,
    l_shipdate::date as dt
  from lineitem join supplier on l_suppkey = s_suppkey)"""


# --- pool --------------------------------------------------------------------

def sale_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed, scoped listings with target, tier and dt; re-crawls still in."""
    typed = with_unit_price(sale_scope(parse_listings(raw_listings(spark, sf_dir))))
    return with_tier(typed, DISTRICT_TIERS)


POOL_SQL = f"""{RAW_SQL},
sale as (
  select *, price / 1000000.0::double / area as price_per_m2
  from raw where contains(city, 'Hồ Chí Minh') and price > 500000000 and area > 0),
pool as (
  select sale.*, rank_quan::int as rank_quan
  from sale left join {values_of(DISTRICT_TIERS, "t", "district", "rank_quan")} using (district))"""

TIES = ["ad_id", "price", "area", "district", "floors", "latitude", "longitude", "interior", "property_type", "bedrooms",
        "posted_at"]


def newest_listings(pool: DataFrame) -> DataFrame:
    return latest_per_key(pool, ["url"], newest_first("dt", *TIES))


NEWEST_SQL = f"""{POOL_SQL},
newest as (
  select * from pool qualify row_number() over (partition by url order by dt desc nulls last,
    ad_id nulls first, price nulls first, area nulls first, district nulls first, floors nulls first, latitude nulls first,
    longitude nulls first, interior nulls first, property_type nulls first, bedrooms nulls first,
    posted_at nulls first) = 1)"""


# --- predictions -------------------------------------------------------------

def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction-shaped rows with a formula in place of a model."""
    line = table(spark, sf_dir, "lineitem")
    listing = F.round((F.col("l_extendedprice") / F.col("l_quantity")).cast("decimal(38,10)"), 2).cast("double")
    predicted = F.lit(500.0) + F.col("l_linenumber") * 400.0
    return line.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        F.when(~every(29, "l_suppkey"), F.concat(F.lit("Quận "), F.col("l_suppkey") % 25)).alias("district"),
        F.col("l_quantity").alias("area_m2"),
        listing.alias("listing_ppm2"),
        predicted.alias("predicted_ppm2"),
        F.when(~every(31, "l_partkey"), (predicted - listing) / predicted).alias("undervalued_ratio"),
        F.concat(F.lit("v"), F.year("l_shipdate")).alias("model_version"),
        F.date_format(F.trunc(F.to_date("l_shipdate"), "month"), "yyyy-MM-dd'T'00:00:00").alias("scored_at"),
    ).withColumn("is_undervalued", F.coalesce(F.col("undervalued_ratio") >= 0.2, F.lit(False)))


PRED_SQL = """base as (
  select *, round((l_extendedprice / l_quantity)::decimal(38,10), 2)::double as listing,
    500.0::double + l_linenumber * 400.0::double as predicted from lineitem),
rated as (
  select *, case when l_partkey % 31 <> 0 then (predicted - listing) / predicted end as ratio from base),
preds as (
  select l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey as id,
    case when l_suppkey % 29 <> 0 then 'Quận ' || (l_suppkey % 25) end as district,
    l_quantity as area_m2, listing as listing_ppm2, predicted as predicted_ppm2,
    ratio as undervalued_ratio, coalesce(ratio >= 0.2::double, false) as is_undervalued,
    'v' || year(l_shipdate) as model_version,
    strftime(date_trunc('month', l_shipdate), '%Y-%m-%dT00:00:00') as scored_at
  from rated)"""


# --- market and monthly series -----------------------------------------------

def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """A series written once as its own small table, as a deployment keeps it."""
    return workspace.stored(df, name)


def market_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MARKET_RAW shape of every order day: no quotes on each third day of a month, no FX on each fifth."""
    day = F.to_date("o_orderdate")
    quoted = F.dayofmonth("day") % 3 != 0
    daily = table(spark, sf_dir, "orders").groupBy(day.alias("day")).agg(
        F.max("o_totalprice").alias("gold_usd"),
        F.max("o_orderkey").cast("double").alias("usdvnd"),
        F.min("o_totalprice").alias("vnindex"),
    )
    return daily.select(
        F.col("day").cast("string").alias("date"),
        F.when(quoted, F.col("gold_usd")).alias("gold_usd"),
        F.when(quoted & (F.dayofmonth("day") % 5 != 0), F.col("usdvnd")).alias("usdvnd"),
        F.when(quoted, F.col("vnindex")).alias("vnindex"),
    )



MARKET_SQL = """quotes as (
  select o_orderdate::date as d, case when day(o_orderdate::date) % 3 <> 0 then max(o_totalprice) end as gold,
    case when day(o_orderdate::date) % 3 <> 0 and day(o_orderdate::date) % 5 <> 0 then max(o_orderkey)::double end as usdvnd,
    case when day(o_orderdate::date) % 3 <> 0 then min(o_totalprice) end as vnindex
  from orders group by o_orderdate::date),
cal as (select unnest(generate_series((select min(d) from quotes)::timestamp,
                                      (select max(d) from quotes)::timestamp, interval 1 day))::date as d),
filled as (
  select d, last_value(gold ignore nulls) over w as gold, last_value(usdvnd ignore nulls) over w as usdvnd,
    last_value(vnindex ignore nulls) over w as vnindex
  from cal left join quotes using (d)
  window w as (order by d rows between unbounded preceding and current row))"""


def market_feature_sql() -> str:
    cols = []
    for s in ("vnindex", "usdvnd", "gold"):
        cols.append(f"avg({s}) over r as {s}_90d_ma")
        cols.append(f"({s} - lag({s}, 90) over o) / nullif(lag({s}, 90) over o, 0) as {s}_90d_pct")
    return f"""{MARKET_SQL},
daily as (select d, {', '.join(cols)} from filled
  window r as (order by d range between interval 89 days preceding and current row), o as (order by d))"""


def macro_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MACRO_MONTHLY shape of every order month; the figures of each seventh one are missing."""
    month = F.date_format("o_orderdate", "yyyy-MM")
    known = (F.year("o_orderdate") * 12 + F.month("o_orderdate")) % 7 != 0
    return table(spark, sf_dir, "orders").groupBy(month.alias("month")).agg(
        F.when(F.first(known), F.count(F.lit(1)).cast("double")).alias("cpi"),
        F.max(F.when(known, F.col("o_totalprice"))).alias("rate"),
    )



MONTHLY_SQL = """months as (
  select date_trunc('month', o_orderdate)::date as m,
    case when (year(m) * 12 + month(m)) % 7 <> 0 then count(*)::double end as cpi,
    case when (year(m) * 12 + month(m)) % 7 <> 0 then max(o_totalprice) end as rate
  from orders group by 1),
mcal as (select unnest(generate_series((select min(m) from months)::timestamp,
                                       (select max(m) from months)::timestamp, interval 1 month))::date as m),
mdense as (select m, cpi, rate from mcal left join months using (m))"""


def monthly_feature_sql() -> str:
    cols = []
    for s in ("cpi", "rate"):
        cols += [f"lag({s}, {n}) over o as {s}_{n}m_lag" for n in (1, 3, 6)]
        cols.append(f"lag({s}, 1) over o / nullif(lag({s}, 4) over o, 0) - 1 as {s}_90d_pct")
    return f"""{MONTHLY_SQL},
monthly as (select strftime(m, '%Y-%m') as month, {', '.join(cols)} from mdense window o as (order by m))"""
