"""Typing, scope and derived columns of the listing pool."""

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoinlake.fixed_values import CITY_TEXT, DISTRICT_TIERS, SALE_PRICE_FLOOR
from quoinlake.functions.numeric import unit_price
from quoinlake.functions.text import first_number
from quoinlake.operators.dedup import latest_per_key, newest_first
from quoinlake.operators.sizing import small_or_shuffled
from quoinlake.schemas import POOL_CASTS, POOL_DROPS


def parse_types(df: DataFrame, casts: dict[str, str]) -> DataFrame:
    """Cast the columns that exist; text that is no number or time becomes NULL."""
    typed = {
        c: F.try_to_timestamp(c) if t == "timestamp" else F.col(c).try_cast(t)
        for c, t in casts.items() if c in df.columns
    }
    return df.withColumns(typed)


def parse_listings(raw: DataFrame) -> DataFrame:
    """Raw text listings to pool types: numbers, area without its unit, posting time."""
    typed = parse_types(raw, {**POOL_CASTS, "posted_at": "timestamp"})
    return typed.withColumn("area", first_number("area")).drop(*POOL_DROPS)


def scope(
    df: DataFrame, contains: dict[str, str], above: dict[str, float], positive: tuple[str, ...] = ()
) -> DataFrame:
    """Keep rows by text fragment, exclusive floor and positivity; NULL fails each test."""
    for column, text in contains.items():
        df = df.where(F.col(column).contains(text))
    for column, floor in above.items():
        df = df.where(F.col(column) > F.lit(float(floor)))
    for column in positive:
        df = df.where(F.col(column) > 0)
    return df


def sale_scope(df: DataFrame, city: str = CITY_TEXT, floor: float = SALE_PRICE_FLOOR) -> DataFrame:
    """Listings of one city, for sale (dearer than the floor) and with an area."""
    return scope(df, {"city": city}, {"price": floor}, ("area",))


def with_unit_price(df: DataFrame) -> DataFrame:
    return df.withColumn("price_per_m2", unit_price("price", "area"))


def tier_of(key: "Column | str", tiers: dict[str, int] = DISTRICT_TIERS) -> Column:
    """Tier from a literal map; an unmapped or NULL key gives NULL."""
    key = F.col(key) if isinstance(key, str) else key
    return F.create_map(*[F.lit(x) for kv in tiers.items() for x in kv])[key].cast("int")


def with_tier(
    df: DataFrame, tiers: "dict[str, int] | DataFrame", key: str = "district", out: str = "rank_quan"
) -> DataFrame:
    """Add the tier from a dict (no join) or a (key, tier) table with unique keys."""
    if isinstance(tiers, dict):
        return df.withColumn(out, tier_of(key, tiers))
    dim = small_or_shuffled(tiers.select(F.col(tiers.columns[0]).alias(key), F.col(tiers.columns[1]).alias(out)))
    return df.join(dim, key, "left")


def unmapped(df: DataFrame, tiers: "dict[str, int] | DataFrame", key: str = "district") -> DataFrame:
    """Keys without a tier and how many rows each has, in one aggregation."""
    counted = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    return with_tier(counted, tiers, key, "_tier").where("_tier is null").drop("_tier")


def with_ingest_day(df: DataFrame, day: "date | str") -> DataFrame:
    return df.withColumn("dt", F.lit(str(day)).cast("date"))


def pool_day(raw_day: DataFrame, day: "date | str", **scope_args) -> DataFrame:
    """One ingest day of raw listings as pool rows. NULLs stay; no outlier is removed."""
    typed = with_unit_price(sale_scope(parse_listings(raw_day), **scope_args))
    # Any survivor would do for equal rows; the order makes the choice repeatable.
    survivors = latest_per_key(
        typed, ["url"], newest_first("posted_at", "ad_id", "price", "area")
    )
    return with_ingest_day(with_tier(survivors, DISTRICT_TIERS), day)
