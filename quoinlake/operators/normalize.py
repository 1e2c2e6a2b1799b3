"""Raw ad JSON to the canonical listing record."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quoinlake.fixed_values import (
    BEDROOMS_IN_TEXT, CODE_LABELS, FLOORS_IN_TEXT, INTERIOR_ITEM_ID, LEGAL_ITEM_ID,
    SEED_HEADERS,
)
from quoinlake.functions.numeric import epoch_ms
from quoinlake.functions.text import (
    blank_to_null, first_filled, first_match, html_text, kv_lookup, label_of,
)
from quoinlake.schemas import AD_JSON, RAW_LISTING


def decode_json(df: DataFrame, value: str, schema=RAW_LISTING, read: "list[str] | None" = None) -> DataFrame:
    """Parse a JSON text column to flat columns; malformed or NULL text gives all NULL.

    The generator keeps later filters above it: pushed below, each would parse the text again.
    Spark does not prune what a generator parses, so a caller that uses few fields names them
    in `read`; the others are skipped in the text and come as NULL.
    """
    kept = schema if read is None else StructType([f for f in schema if f.name in read])
    flat = df.select(F.inline(F.array(F.from_json(F.col(value).cast("string"), kept))))
    if read is None:
        return flat
    return flat.select(*[F.col(f.name) if f.name in read else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


def canonical_url(prefix: str, ad_id: "Column | str") -> Column:
    return F.concat(F.lit(prefix), ad_id if isinstance(ad_id, Column) else F.col(ad_id))


def backfill_from_text(current: "Column | str", text: "Column | str", pattern: str) -> Column:
    """Keep a filled value; otherwise take the first case-insensitive match in the text."""
    return F.coalesce(blank_to_null(current), first_match(text, f"(?iu){pattern}"))


def normalize_ads(ads: DataFrame, url_prefix: str, crawled_at: Column) -> DataFrame:
    """Parsed ads (schema AD_JSON) to RAW_LISTING columns; unusable ads included.

    Split the result with `require(..., LISTING_REQUIRED)`.
    """
    ads = ads.withColumn("_body", html_text("body"))
    items = F.col("feature_params.seo_structure.items")
    ad_id = first_filled("ad_id", "list_id")
    size = first_filled("size", "area_usable")
    posted = F.coalesce(F.nullif("orig_list_time", F.lit(0)), F.nullif("list_time", F.lit(0)))
    labels = {d: label_of(d, CODE_LABELS[d]) for d in ("direction", "interior", "legal", "apartment_type")}
    columns = {
        "ad_id": ad_id,
        "title": first_filled("subject", "title"),
        "price": F.col("price"),
        "price_string": F.col("price_string"),
        "area": F.concat(size, F.lit(" m²")),
        "ward": blank_to_null("ward_name"),
        "district": blank_to_null("area_name"),
        "city": blank_to_null("region_name"),
        "property_type": label_of("category", CODE_LABELS["category"], F.col("category_name")),
        "ad_type": F.col("type"),
        "bedrooms": backfill_from_text("rooms", "_body", BEDROOMS_IN_TEXT),
        "bathrooms": F.coalesce(first_filled("wc"), F.col("bathrooms")),
        "floors": backfill_from_text("floors", "_body", FLOORS_IN_TEXT),
        "direction": F.when(first_filled("direction").isNotNull(), labels["direction"]),
        "interior": F.coalesce(blank_to_null(kv_lookup(items, INTERIOR_ITEM_ID)), labels["interior"]),
        "legal": F.coalesce(blank_to_null(kv_lookup(items, LEGAL_ITEM_ID)), labels["legal"]),
        "apartment_type": labels["apartment_type"],
        "latitude": F.col("latitude"),
        "longitude": F.col("longitude"),
        "posted_at": epoch_ms(posted),
        "url": canonical_url(url_prefix, ad_id),
        "crawled_at": crawled_at.cast("string"),
    }
    return ads.select(*[columns[f.name].cast(f.dataType).alias(f.name) for f in RAW_LISTING])


LISTING_REQUIRED = ["ad_id", "title", "price"]
#: The fields of AD_JSON that the required ones are made of.
REQUIRED_SOURCES = ["ad_id", "list_id", "subject", "title", "price"]


def complete(required: list[str]) -> Column:
    ok = F.lit(True)
    for c in required:
        ok = ok & F.col(c).isNotNull()
    return ok


def require(df: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with every required field, and per missing-field pattern how many were refused."""
    missing = F.array_join(F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]),
                                    lambda x: x.isNotNull()), ",")
    refused = df.where(~complete(required)).groupBy(missing.alias("missing")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )
    return df.where(complete(required)), refused


def ads_from_json(df: DataFrame, value: str, url_prefix: str, crawled_at: Column) -> DataFrame:
    """Ad JSON text to usable RAW_LISTING rows."""
    ads = normalize_ads(decode_json(df, value, AD_JSON), url_prefix, crawled_at)
    return require(ads, LISTING_REQUIRED)[0]


def normalize_csv(
    df: DataFrame, headers: dict[str, str] = SEED_HEADERS, target=RAW_LISTING
) -> DataFrame:
    """Seed CSV to the canonical fields: renamed, '' to NULL, absent fields typed NULL.

    Headers without a mapping are kept under their own name.
    """
    named = {headers.get(c, c): F.nullif(F.col(f"`{c}`"), F.lit("")) for c in df.columns}
    known = [
        (named[f.name].try_cast(f.dataType) if f.name in named else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in target
    ]
    extra = [value.alias(name) for name, value in named.items() if name not in target.names]
    return df.select(*known, *extra)
