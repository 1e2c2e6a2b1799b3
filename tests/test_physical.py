"""Properties of the plans that keep large runs affordable."""

import re

from pyspark.sql import functions as F

from quoinlake.operators.asof import attach_dense
from quoinlake.operators.clean import sale_scope
from quoinlake.operators.normalize import ads_from_json
from quoinlake.operators.sizing import small_or_shuffled, spread
from quoinlake.plans.catalog.modelling import group_mean_scored
from quoinlake.plans.catalog.series import facts, features

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_scope_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "pool")
    spark.createDataFrame([("Tp Hồ Chí Minh", 6e8, 40.0, "x")], "city string, price double, area double, note string"
                          ).write.parquet(path)
    text = formatted(sale_scope(spark.read.parquet(path)).select("price"))
    pushed = re.search(r"PushedFilters: \[(.*)\]", text).group(1)
    assert "StringContains(city" in pushed and "GreaterThan(price" in pushed and "GreaterThan(area" in pushed
    assert "note" not in re.search(r"ReadSchema: (.+)", text).group(1)


def test_facts_are_not_shuffled_for_context(spark):
    daily, _ = features(spark, SF)
    text = plan(attach_dense(facts(spark, SF), daily, F.to_date("posted_at"), "d", ["vnindex_90d_ma"]))
    assert "BroadcastHashJoin" in text
    fact_side = text[: text.index("BroadcastExchange")]
    assert "Exchange hashpartitioning" not in fact_side and "Exchange RoundRobin" not in fact_side


def test_large_sides_are_not_hinted(spark):
    df = spark.range(100)
    assert "rightHint" in str(df.join(small_or_shuffled(df, 100), "id")._jdf.queryExecution().optimizedPlan())
    assert "rightHint" not in str(df.join(small_or_shuffled(df, 99), "id")._jdf.queryExecution().optimizedPlan())


def test_the_flagship_dedups_once(spark):
    df = group_mean_scored(spark, SF).select("ad_id", "undervalued_ratio")
    df.collect()
    final = plan(df).split("Initial Plan")[0]
    assert "ReusedExchange" in final
    assert len(re.findall(r"Exchange hashpartitioning\(url", final)) <= 2  # its own line and the reuse of it


def test_json_is_parsed_once(spark):
    df = spark.createDataFrame([("{}",)], "value string")
    assert plan(ads_from_json(df, "value", "u/", F.lit("t"))).count("from_json(") == 1


def test_only_scans_of_few_splits_are_dealt_out(spark):
    many = spark.range(0, 1000, 1, 64)
    assert spread(many) is many
    assert spread(many.coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_no_udf_anywhere():
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "quoinlake"
    text = "".join(p.read_text(encoding="utf-8") for p in root.rglob("*.py") if "llm" not in p.parts)
    assert not re.search(r"pandas_udf|F\.udf|applyInPandas|mapInPandas|localCheckpoint|crossJoin|mapPartitions", text)
