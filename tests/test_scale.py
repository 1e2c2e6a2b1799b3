"""Queries that read or send no more than they need, on rows made here."""

from datetime import datetime

import pytest

from quoinlake.functions.text import first_filled, first_number, html_text
from quoinlake.operators.normalize import REQUIRED_SOURCES, LISTING_REQUIRED, decode_json, normalize_ads
from quoinlake.operators.quantiles import exact_quantiles
from quoinlake.plans.catalog import QUERIES
from quoinlake.schemas import AD_JSON
from quoinlake.streaming.landing import not_before
from pyspark.sql import functions as F

LINE = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz")


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("lines"))
    rows = [(i, i * 7, i % 30, i % 7 + 1, float(i % 50 + 1), 900.0 * (i % 60 + 1), 0.01, 0.02, "ANR"[i % 3], "FO"[i % 2],
             datetime(1997, 1 + i % 12, 1 + i % 28)) for i in range(1, 901)]
    spark.createDataFrame(rows, LINE).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    return folder


def test_required_fields_parses_the_text_once(spark, lines):
    counted = QUERIES["required_fields"](spark, lines)
    assert "from_json" not in counted._jdf.queryExecution().toString()
    assert {r[0]: r[1] for r in counted.collect()} == {
        r[0]: r[1] for r in QUERIES["required_fields_observed"](spark, lines).collect()}


def test_fields_that_are_not_read_are_null_and_the_others_as_in_a_full_parse(spark):
    text = ['{"ad_id":0,"list_id":7,"subject":"","title":"t","price":5,"category":"x","rooms":3}',
            '{"ad_id":"8","title":"a","price":"1.50"}', '{"ad_id":1,"title":"cut', None, "{}"]
    values = spark.createDataFrame([(t,) for t in text], "value string")
    full, some = (decode_json(values, "value", AD_JSON, read=r) for r in (None, REQUIRED_SOURCES))
    assert some.columns == full.columns and some.first()["rooms"] is None and full.first()["rooms"] == "3"
    needed = [normalize_ads(f, "u/", F.lit(None)).select(*LISTING_REQUIRED).collect() for f in (full, some)]
    assert needed[0] == needed[1]


def test_searched_texts_give_what_the_patterns_give(spark):
    row = spark.createDataFrame(
        [("<P>a</P><!-- x > --><STYLE>b</style ><script>1<2</script>c &lt; <b title=\"1>2\" k='>'>d</b> 1 < 2 <i", )], "h string"
    ).select(html_text("h"), html_text(F.lit("plain"))).first()
    assert tuple(row) == ("a c <  d  1 < 2 <i", "plain")
    texts = ["", "0", "-0", "0.00", "00", "-", "0a", "\n", "0\n", " 0", "a", None, "-1", "10"]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(first_filled("t"), first_number("t")).collect()
    assert [r[0] for r in found] == [None, None, None, None, None, "-", "0a", None, None, " 0", "a", None, "-1", "10"]
    assert [r[1] for r in found] == [None, 0, 0, 0, 0, None, 0, None, 0, 0, None, None, 1, 10]


def test_many_keys_of_a_batch_are_not_sent_through_the_driver(spark):
    rows = lambda lo, hi: spark.range(lo, hi).select(F.lit("d").alias("dt"), F.col("id").cast("string").alias("ad_id"))
    twice = rows(40, 60).unionByName(rows(40, 60))
    for bound, sent in ((10, False), (100, True)):
        left = not_before(rows(0, 50).unionByName(rows(0, 0)), twice, ["dt", "ad_id"], bound)
        assert sorted(int(r["ad_id"]) for r in left.collect()) == list(range(40))
        assert ("Broadcast" in left._jdf.queryExecution().executedPlan().toString()) is sent


def test_quartiles_share_a_sketch(spark, monkeypatch):
    made, sketch = [], F.percentile_approx
    monkeypatch.setattr(F, "percentile_approx", lambda *a: made.append(a) or sketch(*a))
    values = spark.range(1, 1001).select((F.col("id") * 7919 % 1009).cast("double").alias("v"))
    known = sorted(i * 7919 % 1009 for i in range(1, 1001))
    assert exact_quantiles(values, "v", [0.25, 0.75], direct_rows=100, accuracy=50) == [known[249], known[749]]
    assert len(made) == 1
