"""Sources, sinks, streaming and serving tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoinlake.operators.dedup import newest_first
from quoinlake.operators.normalize import decode_json, normalize_csv
from quoinlake.operators.upsert import insert_missing, upsert
from quoinlake.plans.catalog.registry import query, table
from quoinlake.plans.catalog.standins import every
from quoinlake.schemas import RAW_LISTING
from quoinlake.sources.jdbc import serving_types
from quoinlake.sources.tables import latest_version, overwrite_partitions, read_table, write_if_absent
from quoinlake.streaming.landing import (
    file_values, json_values, land, land_once, read_json_stream, upsert_stream, with_dt,
)
from quoinlake.streaming.merge import MergeTable, merge_stream, read_merged
from quoinlake.workspace import new_folder


def crawl_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as crawled ads: one in fifty without a crawl time, one in sixty with an unreadable one."""
    events = table(spark, sf_dir, "events")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return events.select(
        F.col("event_id").cast("string").alias("ad_id"),
        F.col("event_type").alias("property_type"),
        F.col("value").cast("string").alias("price"),
        F.when(every(50, "event_id"), None).when(every(60, "event_id"), "hôm nay").otherwise(stamp).alias("crawled_at"),
    )


CRAWL_SQL = """crawl as (
  select event_id, user_id, event_type, value, case when event_id % 50 <> 0 and event_id % 60 <> 0
    then ts::date end as dt from events)"""

DAY_COUNTS = "dt, count(*) as n_rows, round(sum(value)::decimal(38,10), 2)::double as sum_value"


def day_counts(df: DataFrame, value: str = "value") -> DataFrame:
    total = F.round(F.sum(F.col(value).cast("double")).cast("decimal(38,10)"), 2).cast("double")
    return df.groupBy("dt").agg(F.count(F.lit(1)).alias("n_rows"), total.alias("sum_value"))


@query("json_decode", """
select case when json_valid(v) then (v->>'k')::int end as k, count(*) as n_rows
from (select case when event_id % 10 = 3 then substr(props, 1, 5) else props end as v from events)
group by 1""")
def json_decode(spark, sf_dir):
    text = F.when(F.col("event_id") % 10 == 3, F.substring("props", 1, 5)).otherwise(F.col("props"))
    decoded = decode_json(table(spark, sf_dir, "events").select(text.alias("v")), "v", "k int")
    return decoded.groupBy("k").agg(F.count(F.lit(1)).alias("n_rows"))


@query("json_envelope", """
select json_object('c_custkey', c_custkey, 'c_name', c_name, 'c_acctbal', c_acctbal,
  'area', case when c_custkey % 3 = 0 then null else '60 m²' end)::varchar as value from customer""")
def json_envelope(spark, sf_dir):
    area = F.when(~every(3, "c_custkey"), "60 m²")
    return json_values(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", area.alias("area")))


@query("landing_partition_counts", f"with {CRAWL_SQL} select {DAY_COUNTS} from crawl where dt is not null group by dt")
def landing_partition_counts(spark, sf_dir):
    return day_counts(with_dt(crawl_events(spark, sf_dir)), "price")


@query("stream_json_ingest", f"with {CRAWL_SQL} select {DAY_COUNTS} from crawl where dt is not null group by dt")
def stream_json_ingest(spark, sf_dir):
    """Messages to files, files to stream, stream to partitions; drained twice on one checkpoint."""
    folder = new_folder(spark, "ingest")
    json_values(crawl_events(spark, sf_dir)).write.text(f"{folder}/topic")
    for _ in range(2):
        stream = read_json_stream(file_values(spark, f"{folder}/topic"), RAW_LISTING)
        land(stream, f"{folder}/listings_raw", f"{folder}/checkpoint").awaitTermination()
    return day_counts(spark.read.parquet(f"{folder}/listings_raw"), "price")


@query("stream_dedup", f"with {CRAWL_SQL} select {DAY_COUNTS} from crawl where dt is not null group by dt")
def stream_dedup(spark, sf_dir):
    """Messages sent twice, in six files out of time order, a file to a batch; those without an id are sent once."""
    folder = new_folder(spark, "retries")
    crawl = with_dt(crawl_events(spark, sf_dir)).drop("dt")
    nameless = every(97, "ad_id")
    sent = crawl.where(~nameless).unionByName(crawl.where(~nameless)).unionByName(
        crawl.where(nameless).withColumn("ad_id", F.lit(None).cast("string")))
    json_values(sent.repartition(6)).write.text(f"{folder}/topic")
    stream = read_json_stream(file_values(spark, f"{folder}/topic", max_files=1), RAW_LISTING)
    land_once(stream, f"{folder}/listings_raw", f"{folder}/checkpoint").awaitTermination()
    return day_counts(spark.read.parquet(f"{folder}/listings_raw"), "price")


@query("stream_upsert", """
select strftime(ts, '%Y-%m-%d') as month, max_by(value, event_id) as cpi, max(event_id) as rate
from events where value > 0 and event_id > 0 group by 1""")
def stream_upsert(spark, sf_dir):
    """A small keyed table kept current by a stream of changes (here one key per day)."""
    folder = new_folder(spark, "upsert")
    changes = table(spark, sf_dir, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("month"), F.col("value").alias("cpi"), F.col("event_id").alias("rate")
    )
    changes.repartition(6).write.parquet(f"{folder}/changes")
    stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/changes")
    order = newest_first("rate")
    upsert_stream(stream, f"{folder}/table", f"{folder}/checkpoint", ["month"], order, ("cpi", "rate")).awaitTermination()
    return latest_version(spark, f"{folder}/table")


@query("stream_merge", """
select user_id, max_by(value, event_id) as cpi, max(event_id) as rate
from events where value > 0 and event_id > 0 group by 1""")
def stream_merge(spark, sf_dir):
    """A table of record with a row for each user, changed by a stream in six batches and merged when it is read."""
    folder = new_folder(spark, "merge")
    changes = table(spark, sf_dir, "events").select("user_id", F.col("value").alias("cpi"), F.col("event_id").alias("rate"))
    changes.repartition(6).write.parquet(f"{folder}/changes")
    stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/changes")
    record = MergeTable(f"{folder}/table", changes.schema, ["user_id"], newest_first("rate"), 4, ("cpi", "rate"))
    merge_stream(stream, record, f"{folder}/checkpoint", most=3).awaitTermination()
    return read_merged(spark, record)


@query("partition_prune", """
select ts::date as dt, event_type, count(*) as n_rows from events where ts::date = date '2024-01-15' group by 1, 2""")
def partition_prune(spark, sf_dir):
    folder = new_folder(spark, "prune")
    overwrite_partitions(table(spark, sf_dir, "events").withColumn("dt", F.to_date("ts")), folder, ["dt"])
    day = read_table(spark, folder, "2024-01-15")
    return day.groupBy("dt", "event_type").agg(F.count(F.lit(1)).alias("n_rows"))


@query("append_idempotent", f"with {CRAWL_SQL} select {DAY_COUNTS} from crawl where dt is not null group by dt")
def append_idempotent(spark, sf_dir):
    """The same day partitions written twice hold their rows once."""
    folder = new_folder(spark, "append")
    days = with_dt(crawl_events(spark, sf_dir))
    for _ in range(2):
        overwrite_partitions(days, folder, ["dt"])
    return day_counts(spark.read.parquet(folder), "price")


@query("ingest_skip_existing", f"""with {CRAWL_SQL}
select {DAY_COUNTS} from crawl where dt > date '2024-01-15' or (dt is not null and event_type = 'click') group by dt""")
def ingest_skip_existing(spark, sf_dir):
    """Days already there keep what they have; other days come in whole."""
    folder = new_folder(spark, "skip")
    days = with_dt(crawl_events(spark, sf_dir))
    first = days.where((F.col("dt") <= F.lit("2024-01-15").cast("date")) & (F.col("property_type") == "click"))
    write_if_absent(spark, first, folder)
    write_if_absent(spark, days, folder)
    return day_counts(spark.read.parquet(folder), "price")


def seed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers under the headers of a seed CSV, with '' for absent values and one unknown header."""
    columns = {
        "STT": F.col("c_custkey").cast("string"),
        "Tieu de": F.col("c_name"),
        "Gia (VND)": F.when(every(4, "c_custkey"), "").otherwise(F.col("c_acctbal").cast("string")),
        "Dien tich": F.concat(F.col("c_nationkey").cast("string"), F.lit(" m²")),
        "Dia chi": F.lit(""),
        "Quan/Huyen": F.col("c_mktsegment"),
        "URL": F.concat(F.lit("/lot/"), "c_custkey"),
        "Ghi chu": F.when(every(2, "c_custkey"), "").otherwise("x"),
    }
    return table(spark, sf_dir, "customer").select(*[c.alias(name) for name, c in columns.items()])


_SEED_GIVEN = {
    "ad_id": "c_custkey::varchar", "title": "c_name",
    "price": "case when c_custkey % 4 <> 0 then c_acctbal::varchar end",
    "area": "c_nationkey || ' m²'", "district": "c_mktsegment", "url": "'/lot/' || c_custkey",
}
_SEED_SQL = ", ".join(
    f"{_SEED_GIVEN.get(f.name, 'null::varchar' if f.dataType.simpleString() == 'string' else 'null::double')} as {f.name}"
    for f in RAW_LISTING
)


@query("seed_normalize", f"""
select {_SEED_SQL}, case when c_custkey % 2 <> 0 then 'x' end as "Ghi chu" from customer""")
def seed_normalize(spark, sf_dir):
    return normalize_csv(seed_rows(spark, sf_dir))


@query("serving_types", """
select case when id_ok then l_orderkey end as id,
  case when l_partkey % 19 <> 0 then date_trunc('month', l_shipdate)::timestamp end as scored_at, count(*) as n_rows
from (select *, l_linenumber <> 3 as id_ok from lineitem) group by all""")
def types_for_serving(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    odd = F.col("l_linenumber") == 3
    preds = line.select(
        F.when(odd, F.concat_ws("-", "l_orderkey", "l_linenumber")).otherwise(F.col("l_orderkey").cast("string")).alias("id"),
        F.when(every(19, "l_partkey"), "không").otherwise(
            F.date_format(F.trunc(F.to_date("l_shipdate"), "month"), "yyyy-MM-dd'T'00:00:00")).alias("scored_at"),
    )
    typed = serving_types(preds).withColumn("scored_at", F.col("scored_at").cast("timestamp_ntz"))
    return typed.groupBy("id", "scored_at").agg(F.count(F.lit(1)).alias("n_rows"))


@query("upsert_latest", """
with fresh as (
  select o_custkey as c_custkey, o_totalprice as c_acctbal, o_orderpriority as c_mktsegment from orders
  where o_totalprice > 0
  qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) = 1)
select c_custkey, c_acctbal, c_mktsegment from customer
where c_custkey not in (select c_custkey from fresh)
union all select * from fresh""")
def upsert_latest(spark, sf_dir):
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    changes = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"),
        F.col("o_orderpriority").alias("c_mktsegment"), "o_orderdate", "o_orderkey",
    )
    return upsert(base, changes, ["c_custkey"], newest_first("o_orderdate", "o_orderkey"), ("c_acctbal",))


@query("insert_missing", """
with base as (select c_custkey, c_acctbal from customer where c_acctbal > 5000),
seed as (select o_custkey as c_custkey, max(o_totalprice) as c_acctbal from orders group by 1)
select * from base union all select * from seed where c_custkey not in (select c_custkey from base)""")
def insert_if_missing(spark, sf_dir):
    base = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select("c_custkey", "c_acctbal")
    seed = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"))
    return insert_missing(base, seed, ["c_custkey"], [F.desc("c_acctbal")])
