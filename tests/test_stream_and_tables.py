import datetime as dt
import json
import os
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quoinlake.operators.dedup import newest_first
from quoinlake.schemas import RAW_LISTING
from quoinlake.sources.jdbc import JdbcTarget, SplitBy, serving_types
from quoinlake.sources.tables import (
    folders, latest_version, overwrite_day, overwrite_partitions, read_seed_csv, read_series_csv, read_table, table_exists, write_if_absent,
)
from quoinlake.streaming.landing import (
    file_values, json_values, land, land_once, landed_days, read_json_stream, upsert_stream, utc_time, with_dt,
)
from quoinlake.streaming.merge import MergeTable, add_changes, compact, read_merged
from quoinlake.workspace import new_folder, shared_root


def message(ad_id, crawled_at):
    return json.dumps({"ad_id": ad_id, "title": "Nhà phố", "latitude": 10.5, "crawled_at": crawled_at}, ensure_ascii=False)


def send(folder, name, *messages):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.txt", "w", encoding="utf-8") as f:
        f.write("\n".join(messages))


def test_landing_drops_unreadable_and_continues_after_a_restart(spark, tmp_path):
    topic, out, ckpt = (str(tmp_path / n) for n in ("topic", "raw", "ckpt"))

    def drain():
        land(read_json_stream(file_values(spark, topic)), out, ckpt).awaitTermination()
        return spark.read.parquet(out)

    send(topic, "one", message("1", "2025-01-01T10:00:00"), message("2", None), "{broken", message("3", "nay"))
    first = drain()
    assert [(r["ad_id"], r["title"], r["dt"]) for r in first.collect()] == [("1", "Nhà phố", dt.date(2025, 1, 1))]
    assert drain().count() == 1
    send(topic, "two", message("4", "2025-01-02T10:00:00.123456"))
    assert {str(r["dt"]) for r in drain().collect()} == {"2025-01-01", "2025-01-02"}
    assert set(RAW_LISTING.names) | {"dt"} == set(first.columns)


@pytest.mark.parametrize("max_files", [1, 3, 1000])
def test_redelivery_goes_and_late_or_nameless_messages_stay(spark, tmp_path, max_files):
    topic, out, ckpt = (str(tmp_path / n) for n in ("topic", "out", "ckpt"))

    def drain():
        land_once(read_json_stream(file_values(spark, topic, max_files)), out, ckpt).awaitTermination()
        return sorted((r["ad_id"] or "-", r["crawled_at"]) for r in spark.read.parquet(out).collect())

    send(topic, "1", message("1", "2025-01-03T10:00:00"), message("1", "2025-01-03T10:00:00"), message(None, "2025-01-03T10:00:00"))
    send(topic, "2", message("2", "2025-01-01T10:00:00"), message(None, "2025-01-03T10:00:00"))
    send(topic, "3", message("1", "2025-01-03T10:00:00"), message("1", "2025-01-03T10:20:00"))
    want = [("-", "2025-01-03T10:00:00")] * 2 + [("1", "2025-01-03T10:00:00"), ("1", "2025-01-03T10:20:00"), ("2", "2025-01-01T10:00:00")]
    assert drain() == want
    send(topic, "4", message("2", "2025-01-01T10:00:00"), message("9", "2024-12-01T09:00:00"))
    assert drain() == want + [("9", "2024-12-01T09:00:00")]


@pytest.mark.parametrize("zone", ["UTC", "Asia/Ho_Chi_Minh", "America/New_York"])
def test_days_are_utc_in_every_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        texts = ["2025-01-01T20:00:00Z", "2025-01-01T20:00:00", "2025-01-01T20:00:00+07:00", "2025-01-01 03:00:00+0700", "2025-03-09T02:30:00", "x", None]
        df = spark.createDataFrame([(t,) for t in texts], "crawled_at string")
        got = [str(r[0]) for r in df.select(utc_time("crawled_at").cast("string")).collect()]
        assert got == ["2025-01-01 20:00:00", "2025-01-01 20:00:00", "2025-01-01 13:00:00", "2024-12-31 20:00:00", "2025-03-09 02:30:00", "None", "None"]
        assert sorted(str(r["dt"]) for r in with_dt(df).collect()) == ["2024-12-31"] + ["2025-01-01"] * 3 + ["2025-03-09"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_stream_equals_batch(spark, tmp_path):
    topic = str(tmp_path / "topic")
    send(topic, "one", *[message(str(i), f"2025-01-0{i % 3 + 1}T00:00:00") for i in range(30)])
    land(read_json_stream(file_values(spark, topic)), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    batch = read_json_stream(spark.read.text(topic))
    streamed = spark.read.schema(batch.schema).parquet(str(tmp_path / "out"))
    assert batch.exceptAll(streamed).count() == 0 and streamed.count() == 30


def test_upsert_stream_over_several_batches(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ckpt"))
    schema = "month string, cpi double, rate double, n int"

    def change(*rows, checkpoint=ckpt):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        upsert_stream(stream, out, checkpoint, ["month"], newest_first("n"), ("cpi", "rate")).awaitTermination()
        return sorted(map(tuple, latest_version(spark, out).select("month", "cpi", "rate").collect()))

    assert change(("2099-12", 999.0, 1.5, 1)) == [("2099-12", 999.0, 1.5)]
    assert change(("2099-12", 111.0, 2.5, 5), ("2100-01", -1.0, 2.0, 6)) == [("2099-12", 111.0, 2.5)]
    assert change(("2100-02", 5.0, 5.0, 7)) == [("2099-12", 111.0, 2.5), ("2100-02", 5.0, 5.0)]
    # An older change that comes late does not win, and old versions go.
    assert change(("2099-12", 7.0, 7.0, 2)) == [("2099-12", 111.0, 2.5), ("2100-02", 5.0, 5.0)]
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == [f"version={v}" for v in (1, 2, 3)]
    with pytest.raises(StreamingQueryException, match="checkpoint is at 0"):
        change(("2100-03", 5.0, 5.0, 8), checkpoint=str(tmp_path / "other"))


def test_json_messages_keep_text_and_nulls(spark):
    df = spark.createDataFrame([("Quận 1", None)], "district string, ward string")
    assert json_values(df).first()["value"] == '{"district":"Quận 1","ward":null}'


def test_partition_overwrite_replaces_only_its_days(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "2025-01-01"), (2, "2025-01-02")], "v int, d string").withColumn("dt", F.to_date("d"))
    for _ in range(2):
        overwrite_partitions(df, path, ["dt"])
    overwrite_partitions(df.where("v = 2").withColumn("v", F.lit(9)), path, ["dt"])
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [1, 9]
    day = read_table(spark, path, "2025-01-02")
    assert [r["v"] for r in day.collect()] == [9]
    assert "PartitionFilters: [isnotnull(dt" in day._jdf.queryExecution().executedPlan().toString()


def test_a_day_without_rows_is_emptied(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "2025-01-01"), (2, "2025-01-02")], "v int, d string").withColumn("dt", F.to_date("d"))
    overwrite_partitions(df, path, ["dt"])
    overwrite_day(df.where("v = 0"), path, "2025-01-02")
    assert [r["v"] for r in spark.read.parquet(path).collect()] == [1]


def test_write_if_absent(spark, tmp_path):
    path = str(tmp_path / "t")
    assert not table_exists(spark, path)
    df = spark.createDataFrame([(1, "2025-01-01")], "v int, d string").withColumn("dt", F.to_date("d"))
    write_if_absent(spark, df, path)
    both = df.withColumn("v", F.lit(7)).unionByName(df.withColumn("dt", F.lit("2025-01-02").cast("date")))
    write_if_absent(spark, both, path)
    assert sorted((r["v"], str(r["dt"])) for r in spark.read.parquet(path).collect()) == [
        (1, "2025-01-01"), (1, "2025-01-02")]


def test_seed_csv(spark, tmp_path):
    path = tmp_path / "seed.csv"
    path.write_text('﻿STT,Tieu de,Gia (VND),Dien tich,Thoi gian crawl,Ghi chu\n'
                    '1,"Nhà, ""đẹp""",950000000,42 m²,2025-01-01,\n2,,,,2025-01-02,x\n', encoding="utf-8")
    rows = read_seed_csv(spark, str(path)).orderBy("ad_id").collect()
    assert rows[0]["title"] == 'Nhà, "đẹp"' and rows[0]["area"] == "42 m²" and rows[0]["Ghi chu"] is None
    assert rows[1]["title"] is None and rows[1]["latitude"] is None and rows[1]["crawled_at"] == "2025-01-02"
    assert list(rows[0].asDict()) == [*RAW_LISTING.names, "Ghi chu"]
    series = tmp_path / "s.csv"
    series.write_text("Date,usdvnd\n2025-01-01,26310.0\n")
    assert read_series_csv(spark, str(series)).first()["usdvnd"] == "26310.0"


def test_serving_types_and_jdbc_options(spark):
    df = spark.createDataFrame([("12", "2025-01-01T10:00:00"), ("x", "nay")], "id string, scored_at string")
    rows = serving_types(df).collect()
    assert rows[0]["id"] == 12 and rows[0]["scored_at"] == dt.datetime(2025, 1, 1, 10)
    assert rows[1]["id"] is None and rows[1]["scored_at"] is None
    target = JdbcTarget("jdbc:postgresql://db/x", properties={"user": "u"})
    assert target.options("(select 1) t")["dbtable"] == "(select 1) t" and target.options("t")["user"] == "u"
    assert SplitBy("id", "0", "100", 4).options()["numPartitions"] == "4"


def test_shared_folder_is_the_sessions_own(spark):
    root = shared_root(spark)
    assert shared_root(spark) == root and new_folder(spark, "x").startswith(root + "/x-")


def test_event_time_text_of_several_forms(spark):
    df = spark.createDataFrame([("2025-01-01T23:59:59.123456",), ("2025-01-02 00:00:00",), ("2025-01-03",), ("",), (None,)],
                               "crawled_at string")
    assert sorted(str(r["dt"]) for r in with_dt(df).collect()) == ["2025-01-01", "2025-01-02", "2025-01-03"]


def test_a_batch_reads_only_its_own_days(spark, tmp_path):
    topic, out, ckpt = (str(tmp_path / n) for n in ("topic", "out", "ckpt"))

    def drain():
        land_once(read_json_stream(file_values(spark, topic)), out, ckpt).awaitTermination()

    send(topic, "1", *[message(str(i), f"2025-01-0{i}T10:00:00") for i in range(1, 8)])
    drain()
    send(topic, "2", message("3", "2025-01-03T10:00:00"), message("30", "2025-01-03T11:00:00"), message("40", "2025-01-31T11:00:00"))
    drain()
    landed = landed_days(spark, out, ["2025-01-03", "2025-01-31", "2030-01-01"])
    assert all("dt=2025-01-03/" in f or "dt=2025-01-31/" in f for f in landed.inputFiles()) and len(landed.inputFiles()) == 3
    assert sorted((r["ad_id"], r["batch"]) for r in landed.collect()) == [("3", 0), ("30", 1), ("40", 1)]
    assert landed_days(spark, out, ["2030-01-01"]) is None


def test_more_days_than_are_named(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("quoinlake.streaming.landing.NAMED_DAYS", 1)
    topic, out, ckpt = (str(tmp_path / n) for n in ("topic", "out", "ckpt"))
    for name in ("1", "2"):
        send(topic, name, *[message(str(i), f"2025-01-0{i}T10:00:00") for i in range(1, 4)])
        land_once(read_json_stream(file_values(spark, topic)), out, ckpt).awaitTermination()
    assert spark.read.parquet(out).count() == 3


def merge_table(tmp_path, **kw):
    schema = StructType().add("k", "string").add("v", "double").add("at", "integer")
    return MergeTable(str(tmp_path / "t"), schema, ["k"], newest_first("at"), kw.pop("buckets", 3), **kw)


def test_merge_on_read_equals_an_upsert_of_every_batch(spark, tmp_path):
    table, rng, want = merge_table(tmp_path, positive=("v",)), random.Random(5), {}
    for batch in range(7):
        rows = [(None if rng.random() < 0.05 else f"k{rng.randrange(20)}", rng.choice([-1.0, 2.0, 3.0, None]), rng.randrange(50)) for _ in range(15)]
        for k, v, at in rows:
            if k is not None and v is not None and v > 0 and at > want.get(k, (0, -1))[1]:
                want[k] = (v, at)
        frame = spark.createDataFrame(rows, table.schema)
        for _ in range(2):  # a repeated batch changes nothing
            add_changes(table, frame, batch)
        compact(spark, table, most=2)
        got = {r["k"]: (r["v"], r["at"]) for r in read_merged(spark, table).collect()}
        assert {k: at for k, (_, at) in got.items()} == {k: at for k, (_, at) in want.items()}
    for batch in (0, 3):  # replays of batches that a base covers already
        add_changes(table, spark.createDataFrame([("k1", 9.0, -5)], table.schema), batch)
    assert {r["k"]: r["at"] for r in read_merged(spark, table).collect()} == {k: at for k, (_, at) in want.items()}
    assert len(folders(spark, f"{table.path}/base/bucket=*/upto=*")) >= 3


def test_a_small_change_touches_its_bucket_only(spark, tmp_path):
    table = merge_table(tmp_path, buckets=8)
    add_changes(table, spark.createDataFrame([(f"k{i}", 1.0, 1) for i in range(200)], table.schema), 0)
    add_changes(table, spark.createDataFrame([("k7", 2.0, 2), ("k7", 3.0, 1)], table.schema), 1)
    assert len(folders(spark, f"{table.path}/delta/bucket=*/batch=0")) == 8
    assert len(folders(spark, f"{table.path}/delta/bucket=*/batch=1")) == 1
    rows = {r["k"]: (r["v"], r["at"]) for r in read_merged(spark, table).collect()}
    assert len(rows) == 200 and rows["k7"] == (2.0, 2)


def test_compaction_keeps_readers_and_removes_what_nobody_needs(spark, tmp_path):
    table = merge_table(tmp_path, buckets=1)
    assert read_merged(spark, table).count() == 0 and compact(spark, table) == []
    for batch in range(3):
        add_changes(table, spark.createDataFrame([("a", float(batch), batch)], table.schema), batch)
    before = read_merged(spark, table)
    assert compact(spark, table, most=2) == [0]
    assert before.first()["v"] == 2.0  # its folders are still there
    assert len(folders(spark, f"{table.path}/delta/bucket=*/batch=*")) == 3
    compact(spark, table, most=2)
    assert folders(spark, f"{table.path}/delta/bucket=*/batch=*") == [] and read_merged(spark, table).first()["v"] == 2.0


def test_an_expression_for_offsets_only_where_there_is_one(spark):
    texts = ["2025-01-01T20:00:00", "2025-1-1 1:00:00+07:00", "2025-01-01T20:00:00.5-0330", "2025-01-01 20:00:00 +05:30", "2025-01-01", "-1", "+1", "1:00+7",
             "2025-01-01T20:00:00+99:99", "2025-01-01T20:00-x"]
    plain = {"2025-01-01T20:00:00": "2025-01-01 20:00:00", "2025-1-1 1:00:00+07:00": "2024-12-31 18:00:00", "2025-01-01T20:00:00.5-0330": "2025-01-01 23:30:00.5",
             "2025-01-01": "2025-01-01 00:00:00"}
    got = {r["t"]: r["u"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", utc_time("t").cast("string").alias("u")).collect()}
    assert {t: got[t] for t in plain} == plain and got["1:00+7"] is None and got["2025-01-01T20:00-x"] is None
