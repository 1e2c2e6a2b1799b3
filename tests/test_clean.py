import datetime as dt

from pyspark.sql import functions as F

from quoinlake.functions.numeric import epoch_ms, exact_round, hash_percent
from quoinlake.functions.text import first_number, html_text, kv_lookup, unescape
from quoinlake.operators.clean import parse_listings, pool_day, sale_scope, unmapped, with_tier, with_unit_price
from quoinlake.operators.dedup import latest_per_key, newest_first
from quoinlake.operators.normalize import LISTING_REQUIRED, ads_from_json, normalize_ads, decode_json, require
from quoinlake.operators.upsert import insert_missing, upsert
from quoinlake.schemas import AD_JSON, RAW_LISTING


def raw(spark, **over):
    base = {f.name: None for f in RAW_LISTING}
    base |= {"ad_id": "1", "price": "900000000", "area": "92.5 m²", "city": "Tp Hồ Chí Minh", "district": "Quận 1",
             "posted_at": "2025-05-15 10:00:00", "url": "/1", "crawled_at": "2025-05-16T00:00:00"}
    return [tuple((base | o)[f.name] for f in RAW_LISTING) for o in over.get("rows", [{}])]


def frame(spark, *rows):
    return spark.createDataFrame(raw(spark, rows=list(rows)), RAW_LISTING)


def test_tolerant_types(spark):
    df = parse_listings(frame(
        spark, {"ad_id": "a"}, {"ad_id": "b", "area": "m²", "price": "thoả thuận", "posted_at": "hôm qua"},
        {"ad_id": "c", "area": "", "bedrooms": "3", "floors": "x"}))
    rows = {r["ad_id"]: r for r in df.collect()}
    assert rows["a"]["area"] == 92.5 and rows["a"]["price"] == 9e8
    assert rows["a"]["posted_at"] == dt.datetime(2025, 5, 15, 10)
    assert rows["b"]["area"] is None and rows["b"]["price"] is None and rows["b"]["posted_at"] is None
    assert rows["c"]["area"] is None and rows["c"]["bedrooms"] == 3 and rows["c"]["floors"] is None
    assert "title" not in df.columns and "crawled_at" not in df.columns


def test_first_number(spark):
    texts = ["92 m²", "92.5 m²", "khoảng 7.m", "m²", "", None, "1.2.3"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(first_number("t")).collect()] == [92.0, 92.5, 7.0, None, None, None, 1.2]


def test_scope_and_target(spark):
    df = parse_listings(frame(
        spark, {"ad_id": "in"}, {"ad_id": "cheap", "price": "500000000"}, {"ad_id": "zero", "area": "0 m²"},
        {"ad_id": "far", "city": "Hà Nội"}, {"ad_id": "nocity", "city": None}))
    kept = with_unit_price(sale_scope(df)).collect()
    assert [(r["ad_id"], round(r["price_per_m2"], 6)) for r in kept] == [("in", round(900 / 92.5, 6))]


def test_tiers_and_their_audit(spark):
    df = spark.createDataFrame([("Quận 1",), ("Quận 9",), ("Quận 9",), (None,)], "district string")
    assert sorted(str(r["rank_quan"]) for r in with_tier(df, {"Quận 1": 5}).collect()) == ["5", "None", "None", "None"]
    dim = spark.createDataFrame([("Quận 1", 5)], "k string, t int")
    assert with_tier(df, dim).count() == 4
    for tiers in ({"Quận 1": 5}, dim):
        assert {r["district"]: r["n_rows"] for r in unmapped(df, tiers).collect()} == {"Quận 9": 2, None: 1}


def test_pool_day_keeps_one_row_per_url_and_all_null_urls(spark):
    day = pool_day(frame(
        spark, {"ad_id": "1"}, {"ad_id": "1", "posted_at": "2025-05-16 00:00:00"},
        {"ad_id": "n1", "url": None}, {"ad_id": "n2", "url": None}), "2025-05-16")
    rows = day.collect()
    assert sorted(r["ad_id"] for r in rows) == ["1", "n1", "n2"]
    assert {r["dt"] for r in rows} == {dt.date(2025, 5, 16)} and {r["rank_quan"] for r in rows} == {5}
    assert next(r for r in rows if r["ad_id"] == "1")["posted_at"] == dt.datetime(2025, 5, 16)


def test_latest_per_key_is_the_same_in_every_layout(spark):
    rows = [("hot" if i % 3 == 0 else f"k{i % 50}", i % 11, i) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, dt int, i int")
    order = newest_first("dt", "i")
    one = {(r["k"], r["i"]) for r in latest_per_key(df.repartition(7), ["k"], order).collect()}
    two = {(r["k"], r["i"]) for r in latest_per_key(df.coalesce(1), ["k"], order).collect()}
    best = {}
    for k, d, i in rows:
        best[k] = min(best.get(k, (-d, i)), (-d, i))
    assert one == two == {(k, v[1]) for k, v in best.items()}


def test_latest_per_key_limits_before_the_shuffle(spark):
    df = latest_per_key(spark.range(100).selectExpr("id % 5 as k", "id as v"), ["k"], newest_first("v"), False)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_rows_without_a_key_stay_and_the_input_is_read_once(spark, tmp_path):
    rows = [("a", 1), ("a", 2), (None, 3), (None, 3)]
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, "k string, v int").write.parquet(path)
    out = latest_per_key(spark.read.parquet(path), ["k"], newest_first("v"))
    assert sorted((r["k"] or "-", r["v"]) for r in out.collect()) == [("-", 3), ("-", 3), ("a", 2)]
    text = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert text.count("FileScan") == 1 and "WindowGroupLimit" in text


def test_upsert_and_insert(spark):
    base = spark.createDataFrame([("2099-11", 1.0, 1.0), ("2099-12", 999.0, 1.5)], "month string, cpi double, rate double")
    changes = spark.createDataFrame(
        [("2099-12", 5.0, 2.0, 1), ("2099-12", 111.0, 2.5, 2), ("2100-01", 0.0, 1.0, 3)],
        "month string, cpi double, rate double, n int")
    out = upsert(base, changes, ["month"], newest_first("n"), ("cpi", "rate"))
    assert sorted(map(tuple, out.collect())) == [("2099-11", 1.0, 1.0), ("2099-12", 111.0, 2.5)]
    ranked = base.withColumn("n", F.lit(9))
    kept = upsert(ranked, changes, ["month"], newest_first("n"), ("cpi", "rate"))
    assert sorted(r["cpi"] for r in kept.collect()) == [1.0, 999.0]  # older changes do not win
    twice = insert_missing(base, changes.drop("n").union(changes.drop("n")), ["month"])
    assert sorted(r["month"] for r in twice.collect()) == ["2099-11", "2099-12", "2100-01"]
    seeded = insert_missing(base, changes.drop("n"), ["month"])
    assert sorted(r["month"] for r in seeded.collect()) == ["2099-11", "2099-12", "2100-01"]


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_html_text_joins_text_nodes_with_one_space(spark):
    html = "<p>a<b>b</b></p><br><p>c &lt;3&#39;&#x1F600;&nbsp;&copy; &unknown; &amp;amp; AT&T</p><!-- x > y -->"
    assert one(spark, html_text(F.lit(html))) == "a b c <3'\U0001F600\xa0© &unknown; &amp; AT&T"
    assert one(spark, html_text(F.lit("x<script>var a='<p>'</script>y<style>p{}</style>"))) == "x y"
    assert one(spark, html_text(F.lit("không thẻ"))) == "không thẻ"
    assert one(spark, html_text(F.lit("gia < 3 ty, 4 tầng > 2"))) == "gia < 3 ty, 4 tầng > 2"
    assert one(spark, html_text(F.lit('<a title="x>y">t</a><!doctype html> 1<2'))) == "t  1<2"
    assert one(spark, html_text(F.lit("<br>" * 5000 + "a" + "<i>" * 5000))) == "a"
    assert one(spark, unescape(F.lit("&#000000065;b &#150; &#x80; &#x0000000041; &#129;"))) == "Ab – € A \x81"
    assert one(spark, html_text(F.lit(None).cast("string"))) is None
    assert one(spark, unescape(F.lit("&amp;lt; &ampx &#0; &#xD800; &#9999999;"))) == "&lt; &x � � �"


def test_epoch_and_rounding(spark):
    assert one(spark, epoch_ms(F.lit(1747303201999))) == "2025-05-15 10:00:01"
    assert one(spark, epoch_ms(F.lit(-1000))) == "1969-12-31 23:59:59"
    assert one(spark, exact_round(F.lit(2.675), 2)) == 2.68
    assert one(spark, hash_percent(F.lit("abc"))) == int("90015098", 16) % 100


def test_last_entry_of_an_id_wins(spark):
    items = F.from_json(F.lit('[{"id":"a","value":"1"},{"id":"b","value":"2"},{"id":"a","value":"3"}]'),
                        "array<struct<id:string,value:string>>")
    assert one(spark, kv_lookup(items, "a")) == "3" and one(spark, kv_lookup(items, "z")) is None


def test_ad_json_fallbacks_and_refusals(spark):
    ads = [
        '{"ad_id":0,"list_id":77,"subject":"","title":"Nhà","price":0,"size":0,"area_usable":55.5,"category":1020,'
        '"direction":9,"wc":0,"bathrooms":0,"interior":2,"legal":9,"rooms":null,"body":"<p>3 TẦNG, 4 pn, 5 phòng ngủ</p>",'
        '"list_time":1747303201000,"area_name":"","feature_params":{"seo_structure":{"items":'
        '[{"id":"furnishing_sell","value":""},{"id":"legal_documents","value":"Sổ hồng"}]}}}',
        '{"ad_id":5,"subject":"x"}', '{"ad_id":6,"price":1}', "không phải json",
    ]
    df = spark.createDataFrame([(a,) for a in ads], "value string")
    (row,) = ads_from_json(df, "value", "u/", F.lit("t")).collect()
    assert row.asDict() == {
        "ad_id": "77", "title": "Nhà", "price": "0", "price_string": None, "area": "55.5 m²", "ward": None,
        "district": None, "city": None, "property_type": "Nhà ở", "ad_type": None, "bedrooms": "4", "bathrooms": "0",
        "floors": "3", "direction": "9", "interior": "Nội thất cơ bản", "legal": "Sổ hồng", "apartment_type": None,
        "latitude": None, "longitude": None, "posted_at": "2025-05-15 10:00:01", "url": "u/77", "crawled_at": "t",
    }
    refused = require(normalize_ads(decode_json(df, "value", AD_JSON), "u/", F.lit("t")), LISTING_REQUIRED)[1]
    assert {r["missing"]: r["n_rows"] for r in refused.collect()} == {"price": 1, "title": 1, "ad_id,title,price": 1}
