"""Number and date expressions that never raise under ANSI mode."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from quoinlake.fixed_values import MILLION
from quoinlake.functions.text import as_col


def exact_round(c: "Column | str", places: int) -> Column:
    """Half-up rounding of the decimal value a double prints as.

    Rounding the binary value directly differs between engines in the last place.
    """
    return F.round(as_col(c).try_cast("decimal(38,10)"), places).cast("double")


def unit_price(price: "Column | str", area: "Column | str", scale: float = MILLION) -> Column:
    """Price in `scale` units per unit of area; NULL for area 0."""
    return F.try_divide(as_col(price) / F.lit(float(scale)), as_col(area))


def total_value(unit: "Column | str", area: "Column | str", scale: float = MILLION) -> Column:
    """Unit price back to a whole-currency total."""
    return exact_round(as_col(unit) * as_col(area) * F.lit(float(scale)), 0).try_cast("bigint")


def relative_change(now: Column, before: Column) -> Column:
    return F.try_divide(now - before, before)


def hash_percent(*key: "Column | str") -> Column:
    """0..99 from the row's key alone: the same in every run, layout and engine."""
    text = F.concat_ws("|", *[as_col(k).cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % 100


def epoch_ms(c: "Column | str") -> Column:
    """Milliseconds since 1970 as 'yyyy-MM-dd HH:mm:ss' in UTC, whatever the session zone."""
    seconds = F.floor(as_col(c).cast("bigint") / 1000)
    since = F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    return (F.lit("1970-01-01").cast("timestamp_ntz") + since).cast("string")


def month_key(c: "Column | str") -> Column:
    return F.date_format(as_col(c), "yyyy-MM")


def calendar_cols(ts: "Column | str") -> dict[str, Column]:
    """year, month, quarter and day of week (Sunday is 1)."""
    ts = as_col(ts)
    return {
        "year": F.year(ts),
        "month": F.month(ts),
        "quarter": F.quarter(ts),
        "dayofweek": F.dayofweek(ts),
    }
