"""Ad JSON to listing records."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoinlake.fixed_values import BEDROOMS_IN_TEXT, CODE_LABELS, DISTRICT_TIERS, FLOORS_IN_TEXT
from quoinlake.functions.numeric import epoch_ms
from quoinlake.functions.text import first_number, html_text
from quoinlake.operators.audit import accepted, audited_require, audited_tiers, refusals, unmapped_seen
from quoinlake.operators.normalize import (
    LISTING_REQUIRED, REQUIRED_SOURCES, ads_from_json, backfill_from_text, decode_json, normalize_ads, require,
)
from quoinlake.operators.sizing import spread
from quoinlake.plans.catalog.registry import query, table, values_of
from quoinlake.plans.catalog.standins import RAW_SQL, every, raw_listings
from quoinlake.schemas import AD_JSON
from quoinlake.workspace import stored

URL_PREFIX = "https://lots.example/"


def ad_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as ad JSON text: absent fields are null, 0 or '' in turn; some text is cut short."""
    line = spread(table(spark, sf_dir, "lineitem"))
    key = F.concat_ws("", "l_orderkey", F.lpad(F.col("l_linenumber").cast("string"), 2, "0")).cast("bigint")
    third = F.col("l_partkey") % 3
    millis = F.unix_millis(F.col("l_shipdate").cast("timestamp"))

    def item(name, value):
        return F.struct(F.lit(name).alias("id"), value.alias("value"))

    sell = F.when(every(4, "l_suppkey"), "").otherwise(F.concat(F.lit("Nội thất "), "l_returnflag"))
    items = F.when(~every(3, "l_suppkey"), F.array(
        item("furnishing_sell", F.lit("cũ")), item("legal_documents", F.concat(F.lit("Sổ "), "l_linestatus")),
        item("furnishing_sell", sell)))
    ad = F.struct(
        F.when(third == 0, None).when(third == 1, F.lit(0)).otherwise(key).alias("ad_id"),
        F.when(~every(41, "l_partkey"), key).alias("list_id"),
        F.when(every(2, "l_partkey"), "").otherwise(F.concat(F.lit("Tin "), "l_partkey")).alias("subject"),
        F.when(~every(5, "l_partkey"), F.lit("Tiêu đề")).alias("title"),
        F.when(~every(23, "l_suppkey"), F.round(F.col("l_extendedprice") * 100000).cast("bigint")).alias("price"),
        F.when(every(6, "l_partkey"), 0).otherwise(F.col("l_quantity").cast("int")).alias("size"),
        F.col("l_linenumber").alias("area_usable"),
        F.when(every(8, "l_partkey"), "").otherwise(F.concat(F.lit("Quận "), F.col("l_suppkey") % 25)).alias("area_name"),
        (F.lit(1000) + F.col("l_linenumber") * 10).alias("category"),
        F.lit("Khác").alias("category_name"),
        F.when(every(3, "l_partkey"), F.col("l_linenumber")).alias("rooms"),
        F.when(every(2, "l_suppkey"), 0).otherwise(F.col("l_linenumber")).alias("wc"),
        F.when(every(4, "l_suppkey"), 0).otherwise(F.lit(2)).alias("bathrooms"),
        F.when(every(4, "l_partkey"), F.col("l_linenumber") + 1).alias("floors"),
        (F.col("l_quantity").cast("int") % 11).alias("direction"),
        F.when(~every(7, "l_partkey"), F.col("l_linenumber") % 5).alias("interior"),
        (F.col("l_linenumber") % 8).alias("legal"),
        F.when(~every(9, "l_partkey"), F.col("l_linenumber")).alias("apartment_type"),
        F.when(every(5, "l_suppkey"), F.lit(0).cast("bigint")).otherwise(millis).alias("orig_list_time"),
        F.when(~every(10, "l_suppkey"), millis + 86_400_000).alias("list_time"),
        F.concat(F.lit("<p>Nhà "), "l_linenumber", F.lit(" TẦNG</p><br>có <b>"),
                 F.col("l_quantity").cast("int"), F.lit("</b> phòng ngủ, 9 tầng")).alias("body"),
        F.struct(F.struct(items.alias("items")).alias("seo_structure")).alias("feature_params"),
    )
    text = F.to_json(ad)
    return line.select(
        F.when(every(101, "l_partkey"), F.substring(text, 1, 30)).otherwise(text).alias("value")
    )


AD_SQL = """ads as (
  select *, case when l_partkey % 101 <> 0 then 1 end as ok,
    (l_orderkey || lpad(l_linenumber::varchar, 2, '0'))::bigint as k,
    l_quantity::int as q, epoch_ms(l_shipdate) as ms from lineitem),
norm as (
  select case when ok = 1 then coalesce(case when l_partkey % 3 = 2 then k end, case when l_partkey % 41 <> 0 then k end) end::varchar as ad_id,
    case when ok = 1 then coalesce(case when l_partkey % 2 <> 0 then 'Tin ' || l_partkey end,
      case when l_partkey % 5 <> 0 then 'Tiêu đề' end) end as title,
    case when ok = 1 and l_suppkey % 23 <> 0 then round(l_extendedprice * 100000)::bigint end::varchar as price,
    case when ok = 1 then (case when l_partkey % 6 <> 0 then q else l_linenumber end) || ' m²' end as area,
    case when ok = 1 and l_partkey % 8 <> 0 then 'Quận ' || (l_suppkey % 25) end as district,
    case when ok = 1 then (case when l_suppkey % 2 <> 0 then l_linenumber when l_suppkey % 4 = 0 then 0 else 2 end) end::varchar as bathrooms,
    case when ok = 1 then (case when l_partkey % 3 = 0 then l_linenumber::varchar end) end as rooms,
    case when ok = 1 then (case when l_partkey % 4 = 0 then (l_linenumber + 1)::varchar end) end as floors,
    case when ok = 1 then (case when l_suppkey % 5 <> 0 then ms when l_suppkey % 10 <> 0 then ms + 86400000 end) end as posted_ms,
    case when ok = 1 then q % 11 end as direction, case when ok = 1 and l_partkey % 7 <> 0 then l_linenumber % 5 end as interior,
    case when ok = 1 then l_linenumber % 8 end as legal, case when ok = 1 and l_partkey % 9 <> 0 then l_linenumber end as apartment_type,
    case when ok = 1 then 1000 + l_linenumber * 10 end as category,
    case when ok = 1 and l_suppkey % 3 <> 0 and l_suppkey % 4 <> 0 then 'Nội thất ' || l_returnflag end as sell,
    case when ok = 1 and l_suppkey % 3 <> 0 then 'Sổ ' || l_linestatus end as papers, ok, l_linenumber, q
  from ads),
good as (select * from norm where ad_id is not null and title is not null and price is not null)"""


def listings(spark, sf_dir):
    return ads_from_json(ad_json(spark, sf_dir), "value", URL_PREFIX, F.lit("2024-01-01T00:00:00"))


def counted(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n_rows"))


@query("json_coalesce", f"""with {AD_SQL}
select ad_id, title, area, district, bathrooms, '{URL_PREFIX}' || ad_id as url from good""")
def json_coalesce(spark, sf_dir):
    return listings(spark, sf_dir).select("ad_id", "title", "area", "district", "bathrooms", "url")


def _label_join(domain: str, column: str) -> str:
    return f"left join {values_of(CODE_LABELS[domain], domain + '_t', 'code', domain + '_label')} on {column} = {domain}_t.code"


@query("code_label_map", f"""with {AD_SQL}
select coalesce(category_label, 'Khác') as property_type,
  case when direction <> 0 then coalesce(direction_label, direction::varchar) end as direction,
  coalesce(sell, interior_label, interior::varchar) as interior,
  coalesce(papers, legal_label, legal::varchar) as legal,
  coalesce(apartment_type_label, apartment_type::varchar) as apartment_type, count(*) as n_rows
from good {_label_join('category', 'category')} {_label_join('direction', 'direction')}
  {_label_join('interior', 'interior')} {_label_join('legal', 'legal')}
  {_label_join('apartment_type', 'apartment_type')}
group by all""")
def code_label_map(spark, sf_dir):
    return counted(listings(spark, sf_dir), "property_type", "direction", "interior", "legal", "apartment_type")


@query("kv_array_lookup", f"""with {AD_SQL}
select ad_id, coalesce(sell, interior_label, interior::varchar) as interior,
  coalesce(papers, legal_label, legal::varchar) as legal
from good {_label_join('interior', 'interior')} {_label_join('legal', 'legal')}""")
def kv_array_lookup(spark, sf_dir):
    return listings(spark, sf_dir).select("ad_id", "interior", "legal")


@query("epoch_ms", """
select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as posted_at from events""")
def epoch_millis(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    since = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    millis = F.timestamp_diff("MILLISECOND", since, "ts")
    return events.select("event_id", epoch_ms(millis).alias("posted_at"))


@query("html_strip", """
with plain as (
  select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
    '<!--.*?-->', '<>', 'gs'), '<script\\b[^>]*>.*?</script\\s*>', '<>', 'gsi'),
    '<style\\b[^>]*>.*?</style\\s*>', '<>', 'gsi'), '^(<[^>]*>)+|(<[^>]*>)+$', '', 'g') as t from pages)
select page_id, replace(replace(replace(replace(replace(replace(replace(regexp_replace(t, '(<[^>]*>)+', ' ', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', chr(160)), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') as text
from plain""")
def html_strip(spark, sf_dir):
    return spread(table(spark, sf_dir, "pages")).select("page_id", html_text("html").alias("text"))


@query("regex_backfill", f"""with {AD_SQL}
select ad_id, coalesce(rooms, regexp_extract('Nhà ' || l_linenumber || ' TẦNG có ' || q || ' phòng ngủ, 9 tầng',
    '(?i)(\\d+)\\s*(?:phòng ngủ|PN)', 1)) as bedrooms,
  coalesce(floors, regexp_extract('Nhà ' || l_linenumber || ' TẦNG có ' || q || ' phòng ngủ, 9 tầng',
    '(?i)(\\d+)\\s*tầng', 1)) as floors from good""")
def regex_backfill(spark, sf_dir):
    return listings(spark, sf_dir).select("ad_id", "bedrooms", "floors")


@query("required_fields", f"""with {AD_SQL}
select concat_ws(',', case when ad_id is null then 'ad_id' end, case when title is null then 'title' end,
  case when price is null then 'price' end) as missing, count(*) as n_rows
from norm where ad_id is null or title is null or price is null group by 1
union all select 'none', count(*) from good""")
def required_fields(spark, sf_dir):
    """The required fields are written once, so that the usable and the refused ads are one pass over the text."""
    parsed = decode_json(ad_json(spark, sf_dir), "value", AD_JSON, read=REQUIRED_SOURCES)
    ads = normalize_ads(parsed, URL_PREFIX, F.lit(None))
    usable, refused = require(stored(ads.select(*LISTING_REQUIRED), "required"), LISTING_REQUIRED)
    total = usable.agg(F.lit("none").alias("missing"), F.count(F.lit(1)).alias("n_rows"))
    return refused.unionByName(total)


@query("required_fields_observed", f"""with {AD_SQL}
select concat_ws(',', case when ad_id is null then 'ad_id' end, case when title is null then 'title' end,
  case when price is null then 'price' end) as missing, count(*) as n_rows
from norm where ad_id is null or title is null or price is null group by 1
union all select 'none', count(*) from good""")
def required_fields_observed(spark, sf_dir):
    """The same counts from the one pass that writes the usable ads."""
    ads = normalize_ads(decode_json(ad_json(spark, sf_dir), "value", AD_JSON), URL_PREFIX, F.lit(None))
    audit = audited_require(ads, LISTING_REQUIRED)
    stored(audit.rows, "ads")
    return spark.createDataFrame([*refusals(audit), ("none", accepted(audit))], "missing string, n_rows long")


@query("unmapped_keys_observed", f"""with {RAW_SQL}
select district, count(*) as n_rows from raw
where district not in (select district from {values_of(DISTRICT_TIERS, 't', 'district', 'tier')}) group by 1""")
def unmapped_keys_observed(spark, sf_dir):
    """Districts without a tier from the pass that writes the tiered listings."""
    raw = raw_listings(spark, sf_dir)
    audit = audited_tiers(raw, DISTRICT_TIERS)
    stored(audit.rows, "tiered")
    return spark.createDataFrame(unmapped_seen(audit, raw, DISTRICT_TIERS), "district string, n_rows long")


@query("parse_unit_number", """
select l_orderkey, l_linenumber, l_partkey, case l_linenumber when 1 then l_quantity when 2 then floor(l_quantity)
  when 3 then null when 4 then null when 5 then 3.25::double when 6 then null else l_quantity end as area
from lineitem""")
def parse_unit_number(spark, sf_dir):
    n = F.col("l_linenumber")
    quantity = F.col("l_quantity").cast("string")
    text = (
        F.when(n == 1, F.concat(quantity, F.lit(" m²")))
        .when(n == 2, F.concat(F.lit("khoảng "), F.floor("l_quantity"), F.lit("m vuông")))
        .when(n == 3, "m²").when(n == 4, "").when(n == 5, "3.25.7 m²").when(n == 6, None)
        .otherwise(F.concat(F.lit("DT: "), quantity, F.lit(" x 2")))
    )
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", first_number(text).alias("area"))
