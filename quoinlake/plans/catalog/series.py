"""Calendars, fills, trailing windows, as-of joins and the gated context."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoinlake.fixed_values import CONTEXT_COLUMNS, MARKET_COLUMNS, MONTHLY_COLUMNS
from quoinlake.functions.numeric import exact_round, month_key
from quoinlake.operators.asof import asof_backward
from quoinlake.operators.context import (
    attach_context, attach_daily, attach_monthly, fit_gate, market_features, market_quotes,
    monthly_features, span_stats, with_gate,
)
from quoinlake.operators.dedup import dedup_series
from quoinlake.operators.timeseries import (
    coverage, day_spine, densify, forward_fill, lag_ratio, lags, last_observation, merge_series, month_spine,
    shifted, spine, trailing_mean, trailing_pct,
)
from quoinlake.plans.catalog.registry import dec, query, table
from quoinlake.plans.catalog.standins import (
    MARKET_SQL, MONTHLY_SQL, macro_monthly, market_feature_sql, market_raw, monthly_feature_sql, stored,
)


def thin_series(spark, sf_dir) -> DataFrame:
    """Daily maximum order per priority over all order days, known on each third day of the month."""
    known = F.when(F.dayofmonth("o_orderdate") % 3 == 0, F.col("o_totalprice"))
    return table(spark, sf_dir, "orders").groupBy(
        F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("d")).agg(F.max(known).alias("value"))


THIN_SQL = """thin as (
  select o_orderpriority as series, o_orderdate::date as d, max(case when day(o_orderdate) % 3 = 0 then o_totalprice end) as value
  from orders group by all),
spans as (select series, min(d) as lo, max(d) as hi from thin group by 1),
dense as (
  select c.series, c.d, value from (
    select series, unnest(generate_series(lo::timestamp, hi::timestamp, interval 1 day))::date as d from spans) c
  left join thin using (series, d)),
filled as (
  select series, d, last_value(value ignore nulls) over (partition by series order by d
    rows between unbounded preceding and current row) as value from dense)"""


def dense_filled(spark, sf_dir) -> DataFrame:
    dense = densify(thin_series(spark, sf_dir), "d", ["series"])
    return forward_fill(dense, ["value"], ["series"], "d")


@query("calendar_spine", """
select unnest(generate_series((select min(o_orderdate) from orders), (select max(o_orderdate) from orders),
  interval 1 day))::date as d""")
def calendar_spine(spark, sf_dir):
    return spine(table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")), "d")


@query("day_range", """
select unnest(generate_series((select min(l_shipdate) from lineitem), (select max(l_shipdate) from lineitem),
  interval 1 day))::date as d""")
def day_range(spark, sf_dir):
    lo, hi = table(spark, sf_dir, "lineitem").agg(F.to_date(F.min("l_shipdate")), F.to_date(F.max("l_shipdate"))).first()
    return day_spine(spark, str(lo), str(hi))


@query("month_spine", """
select strftime(unnest(generate_series(date '1995-01-01'::timestamp,
  (select date_trunc('month', max(o_orderdate)) + interval 12 month from orders), interval 1 month)), '%Y-%m') as month""")
def months_to_fill(spark, sf_dir):
    today = table(spark, sf_dir, "orders").agg(F.to_date(F.max("o_orderdate"))).first()[0]
    return month_spine(spark, str(today), "1995-01-01")


@query("calendar_join", f"with {THIN_SQL} select series, d, value from dense")
def calendar_join(spark, sf_dir):
    return densify(thin_series(spark, sf_dir), "d", ["series"])


@query("forward_fill", f"with {THIN_SQL} select series, d, value from filled")
def filled_forward(spark, sf_dir):
    return dense_filled(spark, sf_dir)


@query("forward_fill_blocks", f"with {THIN_SQL} select series, d, value from filled")
def filled_by_block(spark, sf_dir):
    """The same fill with each series split by year, as for a hot series."""
    dense = densify(thin_series(spark, sf_dir), "d", ["series"])
    return forward_fill(dense, ["value"], ["series"], "d", F.year("d")).select("series", "d", "value")


@query("trailing_mean_90d", f"""with {THIN_SQL}
select series, d, {dec('''avg(value) over (partition by series order by d
  range between interval 89 days preceding and current row)''', 4)} as mean_90d from filled""")
def mean_90d(spark, sf_dir):
    out = trailing_mean(dense_filled(spark, sf_dir), "value", 90, ["series"], "d", "m")
    return out.select("series", "d", exact_round("m", 4).alias("mean_90d"))


@query("trailing_pct_90d", f"""with {THIN_SQL},
l as (select *, lag(value, 90) over (partition by series order by d) as prev from filled)
select series, d, {dec('(value - prev) / nullif(prev, 0)', 4)} as pct_90d from l""")
def pct_90d(spark, sf_dir):
    out = trailing_pct(dense_filled(spark, sf_dir), "value", 90, ["series"], "d", "p")
    return out.select("series", "d", exact_round("p", 4).alias("pct_90d"))


@query("monthly_lags", f"""with {MONTHLY_SQL}
select m, lag(cpi, 1) over o as lag_1, lag(cpi, 3) over o as lag_3, lag(cpi, 6) over o as lag_6,
  {dec('lag(cpi, 1) over o / nullif(lag(cpi, 4) over o, 0) - 1', 4)} as quarter
from mdense window o as (order by m)""")
def month_lags(spark, sf_dir):
    monthly = macro_monthly(spark, sf_dir).select(
        F.lit("cpi").alias("series"), F.to_date(F.concat("month", F.lit("-01"))).alias("m"), "cpi")
    dense = densify(monthly, "m", ["series"], "month")
    both = lag_ratio(lags(dense, "cpi", (1, 3, 6), ["series"], "m"), "cpi", 1, 4, ["series"], "m", "q")
    return both.select("m", "lag_1", "lag_3", "lag_6", exact_round("q", 4).alias("quarter"))


@query("trailing_mean_blocks", f"""with {THIN_SQL}
select series, d, {dec('''avg(value) over (partition by series order by d
  range between interval 89 days preceding and current row)''', 4)} as mean_90d from filled""")
def mean_90d_by_block(spark, sf_dir):
    """The same means with each series in blocks of 128 days, as for a hot series."""
    out = trailing_mean(dense_filled(spark, sf_dir), "value", 90, ["series"], "d", "m", block_days=128)
    return out.select("series", "d", exact_round("m", 4).alias("mean_90d"))


@query("trailing_pct_joined", f"""with {THIN_SQL},
l as (select *, lag(value, 90) over (partition by series order by d) as prev from filled)
select series, d, {dec('(value - prev) / nullif(prev, 0)', 4)} as pct_90d from l""")
def pct_90d_joined(spark, sf_dir):
    """The same changes by a join on the moved days."""
    out = trailing_pct(dense_filled(spark, sf_dir), "value", 90, ["series"], "d", "p", joined=True)
    return out.select("series", "d", exact_round("p", 4).alias("pct_90d"))


@query("monthly_lags_joined", f"""with {MONTHLY_SQL}
select m, lag(cpi, 1) over o as lag_1, lag(cpi, 3) over o as lag_3, lag(cpi, 6) over o as lag_6,
  {dec('lag(cpi, 1) over o / nullif(lag(cpi, 4) over o, 0) - 1', 4)} as quarter
from mdense window o as (order by m)""")
def month_lags_joined(spark, sf_dir):
    """The same lags by a join on the moved months."""
    monthly = macro_monthly(spark, sf_dir).select(
        F.lit("cpi").alias("series"), F.to_date(F.concat("month", F.lit("-01"))).alias("m"), "cpi")
    out = shifted(densify(monthly, "m", ["series"], "month"), "cpi", (1, 3, 4, 6), ["series"], "m", unit="month")
    quarter = exact_round(F.try_divide("lag_1", "lag_4") - 1, 4)
    return out.select("m", "lag_1", "lag_3", "lag_6", quarter.alias("quarter"))


@query("series_dedup", """
select o_orderdate::date as d, o_orderstatus as source, o_totalprice as value from orders
qualify row_number() over (partition by o_orderdate::date
  order by case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end, o_orderkey desc) = 1""")
def series_dedup(spark, sf_dir):
    quotes = table(spark, sf_dir, "orders").select(
        F.to_date("o_orderdate").alias("d"), F.col("o_orderstatus").alias("source"),
        F.col("o_totalprice").alias("value"), "o_orderkey")
    rank = F.when(F.col("source") == "F", 0).when(F.col("source") == "O", 1).otherwise(2)
    return dedup_series(quotes, ["d"], [rank, F.col("o_orderkey").desc()]).drop("o_orderkey")


@query("series_merge", """
with q as (
  select o_orderdate::date as d,
    max(case when day(o_orderdate) % 3 = 0 and o_orderdate >= timestamp '1995-02-01' then o_totalprice end) as gold,
    min(case when day(o_orderdate) % 2 = 1 and o_orderdate >= timestamp '1995-02-10' then o_totalprice end) as fx,
    nullif(count(*) filter (dayofweek(o_orderdate) between 1 and 5), 0)::double as idx
  from orders group by 1),
cal as (select unnest(generate_series((select min(d) from q)::timestamp, (select max(d) from q)::timestamp, interval 1 day))::date as d)
select cal.d, last_value(gold ignore nulls) over w as gold_usd, last_value(fx ignore nulls) over w as usdvnd,
  last_value(idx ignore nulls) over w as vnindex
from cal left join q using (d) window w as (order by cal.d rows between unbounded preceding and current row)""")
def series_merge(spark, sf_dir):
    """Three series over all order days; each has its own days without a quote."""
    orders = table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))

    def series(quoted, header, value):
        return orders.groupBy(F.col("day").cast("string").alias(header)).agg(
            F.when(F.first(F.expr(quoted)), value).cast("string").alias("v"))

    return merge_series([
        (series("day(day) % 3 = 0 and day >= date'1995-02-01'", "Date", F.max("o_totalprice")), "Date", "v", "gold_usd"),
        (series("day(day) % 2 = 1 and day >= date'1995-02-10'", "Date", F.min("o_totalprice")), "Date", "v", "usdvnd"),
        (series("dayofweek(day) between 2 and 6", "time", F.count(F.lit(1))), "time", "v", "vnindex"),
    ])


@query("series_coverage", f"""with {MARKET_SQL}
select count(*) as n_rows, count(gold) as n_gold_usd, count(usdvnd) as n_usdvnd, count(vnindex) as n_vnindex from quotes""")
def series_coverage(spark, sf_dir):
    return coverage(market_raw(spark, sf_dir), ["gold_usd", "usdvnd", "vnindex"])


@query("last_observation", f"with {MARKET_SQL} select * from quotes order by d desc limit 1")
def latest_quote(spark, sf_dir):
    return last_observation(market_quotes(market_raw(spark, sf_dir)), "d")


@query("time_span_gate", """
with s as (select datediff('day', min(l_shipdate), max(l_shipdate))::int as span_days,
  count(distinct strftime(l_shipdate, '%Y-%m')) as months from lineitem group by l_linestatus, l_quantity >= 50 and l_shipdate < timestamp '1995-02-01')
select span_days, months, span_days >= 183 and months >= 3 as gate_on, count(*) as n_groups from s group by all""")
def time_span_gate(spark, sf_dir):
    """The gate of every group from one scan."""
    early = (F.col("l_quantity") >= 50) & (F.col("l_shipdate") < F.lit("1995-02-01").cast("timestamp_ntz"))
    stats = span_stats(table(spark, sf_dir, "lineitem").withColumn("early", early), "l_shipdate", ["l_linestatus", "early"])
    return with_gate(stats).groupBy("span_days", "months", "gate_on").agg(F.count(F.lit(1)).alias("n_groups"))


def facts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        F.col("l_shipdate").alias("posted_at"))


FACTS_SQL = """facts as (select l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey as id,
  l_shipdate as posted_at from lineitem)"""
LAST_SQL = """ends as (select (select max(d) from daily) as d, (select max(month) from monthly) as m)"""


def rounded(df: DataFrame) -> DataFrame:
    """Feature columns rounded on the series itself, a few thousand rows, not on the facts."""
    return df.withColumns({c: exact_round(c, 4) for c in df.columns if c in CONTEXT_COLUMNS})


def rounded_sql(cols) -> str:
    return ", ".join(f"{dec(c, 4)} as {c}" for c in cols)


def features(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    market = stored(spark, market_raw(spark, sf_dir), "macro_raw")
    monthly = stored(spark, macro_monthly(spark, sf_dir), "macro_monthly")
    return rounded(market_features(market_quotes(market))), rounded(monthly_features(monthly))


@query("asof_daily", f"""with {market_feature_sql()}, {FACTS_SQL}
select id, posted_at, {rounded_sql(MARKET_COLUMNS)}
from facts left join daily on d = least(posted_at::date, (select max(d) from daily))""")
def asof_daily(spark, sf_dir):
    return attach_daily(facts(spark, sf_dir), features(spark, sf_dir)[0])


@query("asof_monthly", f"""with {monthly_feature_sql()}, {FACTS_SQL}
select id, posted_at, {rounded_sql(MONTHLY_COLUMNS)}
from facts left join monthly on month = least(strftime(posted_at, '%Y-%m'), (select max(month) from monthly))""")
def asof_monthly(spark, sf_dir):
    return attach_monthly(facts(spark, sf_dir), features(spark, sf_dir)[1])


@query("attach_context", f"""with {market_feature_sql()}, {monthly_feature_sql()}, {FACTS_SQL}
select id, posted_at, {rounded_sql(CONTEXT_COLUMNS)}
from facts left join daily on d = least(posted_at::date, (select max(d) from daily))
left join monthly on month = least(strftime(posted_at, '%Y-%m'), (select max(month) from monthly))""")
def with_context(spark, sf_dir):
    rows = facts(spark, sf_dir)
    gate_on = fit_gate(rows).first()["gate_on"]
    return attach_context(rows, *features(spark, sf_dir), gate_on)


_QUOTES = """r as (
  select substr(o_orderpriority, 1, 1)::int as key, o_orderdate as t, max({'p': o_totalprice, 'k': o_orderkey}) as v
  from orders group by all)"""


def _right(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.substring("o_orderpriority", 1, 1).cast("int").alias("key"), F.col("o_orderdate").alias("t"),
        F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("orderkey"))


def _left(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_linenumber") % 5 + 1).alias("key"), "l_shipdate")


@query("asof_backward", f"""with {_QUOTES}
select l_orderkey, l_linenumber, l_partkey, l_linenumber % 5 + 1 as key, l_shipdate, r.v['p'] as price, r.v['k'] as orderkey
from lineitem asof left join r on l_linenumber % 5 + 1 = r.key and l_shipdate >= r.t""")
def asof_keyed(spark, sf_dir):
    return asof_backward(_left(spark, sf_dir), _right(spark, sf_dir), "l_shipdate", "t", ["price", "orderkey"], ["key"])


@query("asof_unkeyed", f"""with {_QUOTES},
one as (select t, max(v) as v from r group by t)
select l_orderkey, l_linenumber, l_partkey, l_linenumber % 5 + 1 as key, l_shipdate, one.v['p'] as price, one.v['k'] as orderkey
from lineitem asof left join one on l_shipdate >= one.t""")
def asof_unkeyed(spark, sf_dir):
    right = _right(spark, sf_dir).drop("key")
    return asof_backward(_left(spark, sf_dir), right, "l_shipdate", "t", ["price", "orderkey"])
