"""The newest rows of a pool by days: equal to the window over all rows, and no shuffle of history."""

import random

from pyspark.sql import functions as F

from quoinlake.operators.dedup import latest_per_key, newest_first
from quoinlake.sources.newest import NewestTable, advance, catch_up, newest_rows, put_day

SCHEMA = "url string, ad_id string, price double"
TIES = ("ad_id", "price")


def _table(spark, path, buckets=4):
    return NewestTable("pool_test", str(path), spark.createDataFrame([], SCHEMA).schema, "url", newest_first("ad_id", "price"), buckets)


def _expected(spark, days):
    rows = [(*r, d) for d, part in days.items() for r in part]
    df = spark.createDataFrame(rows, SCHEMA + ", d string").withColumn("dt", F.to_date("d")).drop("d")
    order = [F.col("dt").desc(), *newest_first("ad_id", "price")]
    return _rows(latest_per_key(df, ["url"], order))


def _rows(df):
    return sorted((tuple(r) for r in df.select("url", "ad_id", "price", "dt").collect()), key=str)


def _day(seed, n=60):
    r = random.Random(seed)
    hot = lambda: "/hot" if r.random() < 0.4 else f"/lot/{r.randrange(40)}"
    return [(None if r.random() < 0.1 else hot(), r.choice(["a", "b", None]), r.choice([1.0, 2.0, None])) for _ in range(n)]


def test_days_in_any_order_and_again(spark, tmp_path):
    table, days = _table(spark, tmp_path / "t"), {}
    assert newest_rows(spark, table).count() == 0 and advance(spark, table) is None
    steps = [("2025-01-02", 1, True), ("2025-01-04", 2, True), ("2025-01-01", 3, False), ("2025-01-04", None, True),
             ("2025-01-05", 4, False)]
    for day, seed, store in steps:
        days[day] = _day(seed) if seed else []
        put_day(table, spark.createDataFrame(days[day], SCHEMA), day)
        assert _rows(newest_rows(spark, table)) == _expected(spark, days)
        if store:
            assert advance(spark, table) == max(days)
            assert _rows(newest_rows(spark, table)) == _expected(spark, days)


def test_history_does_not_move(spark, tmp_path):
    table = _table(spark, tmp_path / "t")
    for i, day in enumerate(("2025-01-01", "2025-01-02")):
        put_day(table, spark.createDataFrame(_day(i), SCHEMA), day)
        if i == 0:
            assert "Exchange" not in newest_rows(spark, table)._jdf.queryExecution().executedPlan().toString()
            advance(spark, table)
    plan = newest_rows(spark, table)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert "Bucketed: true" in plan


def test_a_write_that_did_not_end_does_not_count(spark, tmp_path):
    table, days = _table(spark, tmp_path / "t"), {"2025-01-01": _day(1)}
    put_day(table, spark.createDataFrame(days["2025-01-01"], SCHEMA), "2025-01-01")
    (tmp_path / "t" / "newest" / "upto=2025-01-01").mkdir(parents=True)
    assert _rows(newest_rows(spark, table)) == _expected(spark, days)
    assert advance(spark, table) == "2025-01-01"
    assert _rows(newest_rows(spark, table)) == _expected(spark, days)


def test_days_of_a_pool_that_are_missing(spark, tmp_path):
    table, days = _table(spark, tmp_path / "t"), {"2025-01-01": _day(1), "2025-01-03": _day(2)}
    for day, rows in days.items():
        spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "pool" / f"dt={day}"))
    assert catch_up(spark, table, str(tmp_path / "pool")) == sorted(days)
    assert catch_up(spark, table, str(tmp_path / "pool")) == []
    assert _rows(newest_rows(spark, table)) == _expected(spark, days)


def test_a_day_of_rows_without_a_key(spark, tmp_path):
    table, days = _table(spark, tmp_path / "t"), {"2025-01-01": [(None, "x", 1.0), (None, "x", 1.0)]}
    put_day(table, spark.createDataFrame(days["2025-01-01"], SCHEMA), "2025-01-01")
    assert _rows(newest_rows(spark, table)) == _expected(spark, days)


def test_an_empty_first_day(spark, tmp_path):
    table = _table(spark, tmp_path / "t")
    put_day(table, spark.createDataFrame([], SCHEMA), "2025-01-01")
    assert newest_rows(spark, table).count() == 0
    advance(spark, table)
    put_day(table, spark.createDataFrame([("/a", "x", 1.0)], SCHEMA), "2025-01-02")
    assert [r["url"] for r in newest_rows(spark, table).collect()] == ["/a"]
