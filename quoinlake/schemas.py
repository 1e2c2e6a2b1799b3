"""Schemas of every stored tier. Nothing in this library infers a schema."""

from pyspark.sql import types as T

TEXT, NUM, INT, LONG = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType()
TIME, FLAG = T.TimestampType(), T.BooleanType()


def table(**columns: T.DataType) -> T.StructType:
    """Every column may be NULL; order is that of the arguments."""
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


RAW_LISTING = table(
    ad_id=TEXT, title=TEXT, price=TEXT, price_string=TEXT, area=TEXT, ward=TEXT, district=TEXT,
    city=TEXT, property_type=TEXT, ad_type=TEXT, bedrooms=TEXT, bathrooms=TEXT, floors=TEXT,
    direction=TEXT, interior=TEXT, legal=TEXT, apartment_type=TEXT, latitude=NUM, longitude=NUM,
    posted_at=TEXT, url=TEXT, crawled_at=TEXT,
)

# Fields the pool does not carry, and the fields that become typed there.
POOL_DROPS = [
    "bathrooms", "legal", "price_string", "apartment_type", "direction", "title", "crawled_at",
    "ad_type",
]
POOL_CASTS = {
    "price": "double",
    "bedrooms": "int",
    "floors": "int",
    "latitude": "double",
    "longitude": "double",
}

# One ad as the listing API returns it (only the fields that are read).
AD_JSON = table(
    ad_id=TEXT, list_id=TEXT, subject=TEXT, title=TEXT, price=TEXT, price_string=TEXT, size=TEXT,
    area_usable=TEXT, ward_name=TEXT, area_name=TEXT, region_name=TEXT, category=INT,
    category_name=TEXT, type=TEXT, rooms=TEXT, wc=TEXT, bathrooms=TEXT, floors=TEXT, direction=TEXT,
    interior=TEXT, legal=TEXT, apartment_type=TEXT, latitude=NUM, longitude=NUM,
    orig_list_time=LONG, list_time=LONG, body=TEXT,
    feature_params=table(seo_structure=table(items=T.ArrayType(table(id=TEXT, value=TEXT)))),
)

MARKET_RAW = table(
    date=TEXT, gold_usd=NUM, usdvnd=NUM, vnindex=NUM,
)

MACRO_MONTHLY = table(
    month=TEXT, cpi=NUM, rate=NUM,
)

PREDICTIONS = table(
    id=TEXT, district=TEXT, area_m2=NUM, listing_ppm2=NUM, predicted_ppm2=NUM,
    predicted_total_vnd=LONG, undervalued_ratio=NUM, is_undervalued=FLAG, url=TEXT,
    model_version=TEXT, scored_at=TEXT,
)

IMPUTE_STATS = table(
    fit_at=TIME, src=TEXT, n_rows_dedup=LONG, n_rows_after_iqr=LONG, iqr_order=T.ArrayType(TEXT),
    iqr=T.MapType(TEXT, table(lo=NUM, hi=NUM)), fill=T.MapType(TEXT, TEXT),
)

GATE = table(
    fit_at=TIME, span_days=INT, months=LONG, gate_on=FLAG, reason=TEXT,
)

METRICS = table(
    version=TEXT, generated_at=TIME, target=TEXT, model=TEXT, features=TEXT, rmse=NUM, mae=NUM,
    r2=NUM, cv_rmse_train=NUM, is_best=FLAG, n_train=LONG, n_test=LONG,
)

PROMOTIONS = table(
    version=TEXT, baseline_rmse=NUM, promoted_at=TIME,
)

DRIFT_LOG = table(
    drift=FLAG, batch_rmse=NUM, baseline_rmse=NUM, drift_threshold=NUM, model_version=TEXT,
    checked_at=TIME,
)
