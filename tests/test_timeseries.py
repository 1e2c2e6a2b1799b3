import datetime as dt

import pytest
from pyspark.sql import functions as F

from quoinlake.operators.timeseries import (
    coverage, day_spine, densify, forward_fill, lag_ratio, lags, last_observation, merge_series, month_spine,
    shifted, spine, to_long, trailing_mean, trailing_pct,
)

D0 = dt.date(2025, 1, 1)


def ramp(spark, n):
    rows = [(D0 + dt.timedelta(days=i), 100.0 + i, (100.0 + i) * 10) for i in range(n)]
    return to_long(spark.createDataFrame(rows, "d date, vnindex double, usdvnd double"), "d", ["vnindex", "usdvnd"])


def at(df, series, day, col):
    return df.where((F.col("series") == series) & (F.col("d") == day)).first()[col]


def test_trailing_mean_counts_today_and_89_days_before(spark):
    out = trailing_mean(ramp(spark, 200), "value", 90, ["series"], "d", "ma")
    assert abs(at(out, "vnindex", D0 + dt.timedelta(days=99), "ma") - 154.5) < 1e-9
    assert abs(at(out, "usdvnd", D0 + dt.timedelta(days=99), "ma") - 1545.0) < 1e-9


def test_trailing_mean_is_shorter_at_the_start_not_null(spark):
    out = trailing_mean(ramp(spark, 10), "value", 90, ["series"], "d", "ma")
    assert at(out, "vnindex", D0 + dt.timedelta(days=1), "ma") == 100.5


def test_trailing_pct_uses_the_value_90_days_ago(spark):
    out = trailing_pct(ramp(spark, 200), "value", 90, ["series"], "d", "pct")
    assert abs(at(out, "vnindex", D0 + dt.timedelta(days=99), "pct") - 90 / 109) < 1e-12
    assert at(out, "vnindex", D0 + dt.timedelta(days=89), "pct") is None


def test_trailing_pct_of_zero_is_null(spark):
    zero = spark.createDataFrame([("a", D0, 0.0), ("a", D0 + dt.timedelta(days=1), 5.0)],
                                 "series string, d date, value double")
    out = trailing_pct(zero, "value", 1, ["series"], "d", "pct")
    assert at(out, "a", D0 + dt.timedelta(days=1), "pct") is None


def test_monthly_lags_never_see_the_current_month(spark):
    rows = [("cpi", dt.date(2025, m, 1), 100.0 + m) for m in range(1, 13)]
    df = spark.createDataFrame(rows, "series string, d date, value double")
    out = lag_ratio(lags(df, "value", (1, 3, 6), ["series"], "d"), "value", 1, 4, ["series"], "d", "q")
    row = out.where("d = date'2025-08-01'").first()
    assert (row["lag_1"], row["lag_3"], row["lag_6"]) == (107.0, 105.0, 102.0)
    assert abs(row["q"] - (107 / 104 - 1)) < 1e-12


def test_spine_of_a_gap_and_of_nothing(spark):
    holes = spark.createDataFrame([(D0, 1.0), (D0 + dt.timedelta(days=4), 5.0)], "d date, v double")
    assert [r["d"] for r in spine(holes, "d").orderBy("d").collect()] == [D0 + dt.timedelta(days=i) for i in range(5)]
    assert spine(holes.limit(0), "d").count() == 0
    assert day_spine(spark, "2025-01-01", "2025-01-03").count() == 3


def test_month_form_options(spark):
    months = [r["month"] for r in month_spine(spark, "2026-01-15").collect()]
    assert months[0] == "2025-01" and months[-1] == "2027-01"
    assert months == sorted(set(months)) and len(months) == 25


def test_forward_fill_keeps_leading_nulls(spark):
    rows = [("a", D0 + dt.timedelta(days=i), v) for i, v in enumerate([None, 2.0, None, None, 5.0, None])]
    df = spark.createDataFrame(rows, "series string, d date, value double")
    out = forward_fill(df, ["value"], ["series"], "d").orderBy("d").collect()
    assert [r["value"] for r in out] == [None, 2.0, 2.0, 2.0, 5.0, 5.0]


def test_blocks_change_nothing_even_for_a_hot_and_a_null_series(spark):
    rows = []
    for s, n in (("hot", 900), ("b", 40), (None, 60)):
        for i in range(n):
            rows.append((s, D0 + dt.timedelta(days=i), float(i) if i % 37 == 5 else None))
    df = spark.createDataFrame(rows, "series string, d date, value double").repartition(5)
    plain = forward_fill(df, ["value"], ["series"], "d").select("series", "d", "value")
    for block in (F.trunc("d", "month"), F.year("d"), F.col("d")):
        split = forward_fill(df, ["value"], ["series"], "d", block).select("series", "d", "value")
        assert plain.exceptAll(split).count() == 0 and split.count() == plain.count()


def test_merge_series_of_three_headers(spark):
    gold = spark.createDataFrame([("2025-01-03", "10.5"), ("2025-01-05", "")], "Date string, gold_usd string")
    fx = spark.createDataFrame([("2025-01-02", "26000")], "Date string, usdvnd string")
    idx = spark.createDataFrame([("2025-01-01", "1765.12"), ("2025-01-05", "1770")], "time string, vnindex string")
    out = merge_series([(gold, "Date", "gold_usd", "gold_usd"), (fx, "Date", "usdvnd", "usdvnd"),
                        (idx, "time", "vnindex", "vnindex")]).orderBy("d").collect()
    assert [r["gold_usd"] for r in out] == [None, None, 10.5, 10.5, 10.5]
    assert [r["usdvnd"] for r in out] == [None, 26000.0, 26000.0, 26000.0, 26000.0]
    assert [r["vnindex"] for r in out] == [1765.12] * 4 + [1770.0]


def test_densify_last_and_coverage(spark):
    df = spark.createDataFrame([("a", D0, 1.0), ("a", D0 + dt.timedelta(days=2), 3.0), ("b", D0, 9.0)],
                               "series string, d date, value double")
    dense = densify(df, "d", ["series"])
    assert dense.count() == 4
    assert coverage(dense, ["value"]).first().asDict() == {"n_rows": 4, "n_value": 3}
    assert last_observation(df, "d").first()["value"] == 3.0
    assert last_observation(df.limit(0), "d").where("d is not null").count() == 0


def hot_series(spark, n=700):
    """One long series with gaps of days and NULLs, a short one and one without a name."""
    rows = [("hot", i, None if i % 5 == 0 else float((i * 37) % 101)) for i in range(n) if i % 11]
    rows += [("short", i, float(i)) for i in range(3)] + [(None, i * 40, 1.0 + i) for i in range(9)]
    df = spark.createDataFrame(rows, "series string, i int, value double")
    return df.select("series", F.date_add(F.lit("2024-01-01").cast("date"), F.col("i")).alias("d"), "value")


@pytest.mark.parametrize("block_days", [90, 91, 128, 1000])
def test_means_of_blocks_equal_those_of_the_window(spark, block_days):
    df = hot_series(spark)
    whole = trailing_mean(df, "value", 90, ["series"], "d", "m")
    blocks = trailing_mean(df, "value", 90, ["series"], "d", "m", block_days)
    assert sorted(map(str, whole.collect())) == sorted(map(str, blocks.collect())) and blocks.columns == whole.columns
    with pytest.raises(ValueError):
        trailing_mean(df, "value", 90, ["series"], "d", "m", 89)


def test_no_task_holds_more_than_two_blocks_of_a_series(spark):
    df = hot_series(spark, 5000)
    out = trailing_mean(df, "value", 30, ["series"], "d", "m", block_days=60)
    assert "_block" in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == df.count()


def test_changes_and_lags_by_join_equal_those_of_the_window(spark):
    dense = densify(hot_series(spark).where("series is not null"), "d", ["series"])
    a = trailing_pct(dense, "value", 90, ["series"], "d", "p")
    b = trailing_pct(dense, "value", 90, ["series"], "d", "p", joined=True)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.columns == b.columns
    c, e = lags(dense, "value", (1, 7), ["series"], "d"), shifted(dense, "value", (1, 7), ["series"], "d")
    assert sorted(map(str, c.collect())) == sorted(map(str, e.collect())) and c.columns == e.columns
