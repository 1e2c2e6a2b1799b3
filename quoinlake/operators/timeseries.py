"""Dense calendars, forward fill and trailing features.

Series are long tables: one row per (series key, day or month). Windows partition by the
series key, so their size is the length of the calendar, never the number of facts.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quoinlake.fixed_values import MONTH_FORM_AHEAD, MONTH_FORM_START
from quoinlake.functions.numeric import relative_change

_STEP = {"day": "interval 1 day", "month": "interval 1 month"}


def _calendar(lo: Column, hi: Column, unit: str) -> Column:
    return F.explode(F.sequence(lo, hi, F.expr(_STEP[unit])))


def spine(series: DataFrame, on: str, by: "list[str] | None" = None, unit: str = "day") -> DataFrame:
    """Every day (month) between the first and last observation, per series key."""
    lo, hi = F.min(on).alias("lo"), F.max(on).alias("hi")
    bounds = series.groupBy(*by).agg(lo, hi) if by else series.agg(lo, hi)
    return bounds.select(*(by or []), _calendar(F.col("lo"), F.col("hi"), unit).alias(on))


def day_spine(spark: SparkSession, lo: str, hi: str, name: str = "d") -> DataFrame:
    return spark.range(1).select(_calendar(F.lit(lo).cast("date"), F.lit(hi).cast("date"), "day").alias(name))


def month_spine(
    spark: SparkSession, today: str, start: str = MONTH_FORM_START, ahead: int = MONTH_FORM_AHEAD
) -> DataFrame:
    """Month keys from the start month to `ahead` months past today's, ascending."""
    last = F.add_months(F.trunc(F.lit(today).cast("date"), "month"), ahead)
    months = _calendar(F.lit(start).cast("date"), last, "month")
    return spark.range(1).select(months.alias("m")).select(F.date_format("m", "yyyy-MM").alias("month"))


def densify(series: DataFrame, on: str, by: "list[str] | None" = None, unit: str = "day") -> DataFrame:
    """Left join the dense calendar to its sparse series; missing days get NULL values."""
    return spine(series, on, by, unit).join(series, [*(by or []), on], "left")


def forward_fill(
    df: DataFrame, cols: list[str], by: list[str], on: str, block: "Column | None" = None
) -> DataFrame:
    """Replace NULLs by the last earlier value of the same series.

    Without `block` one task fills one series. With it (say the month of `on`) a task
    fills one block of one series and takes what it inherits from a summary of the
    earlier blocks, so a single hot series spreads over the cluster. `block` must
    not decrease with `on`.
    """
    upto = (Window.unboundedPreceding, Window.currentRow)
    if block is None:
        w = Window.partitionBy(*by).orderBy(on).rowsBetween(*upto)
        return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})

    rows = df.withColumns({"_block": block, "_seed": F.lit(0)})
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    # One seed row per block carries what the earlier blocks hand over; it sorts first.
    seeds = rows.groupBy(*by, "_block").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(on))).alias(c) for c in cols]
    ).withColumns({c: F.last(c, ignorenulls=True).over(earlier) for c in cols}).withColumn("_seed", F.lit(1))
    w = Window.partitionBy(*by, "_block").orderBy(F.col("_seed").desc(), on).rowsBetween(*upto)
    both = rows.unionByName(seeds, allowMissingColumns=True)
    filled = both.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})
    return filled.where("_seed = 0").drop("_block", "_seed")


def trailing_mean(
    df: DataFrame, value: str, days: int, by: list[str], on: str, out: str, block_days: "int | None" = None
) -> DataFrame:
    """Mean over the last `days` calendar days including this one; shorter at the start.

    With `block_days` (at least `days`) a task averages one block of that many days of one
    series. Rows that the next block's first frames reach back to are carried over to it,
    so a task holds less than two blocks of a series however long it is.
    """
    frame = Window.partitionBy(*by).orderBy(F.unix_date(on)).rangeBetween(1 - days, 0)
    if block_days is None:
        return df.withColumn(out, F.avg(value).over(frame))
    if block_days < days:
        raise ValueError(f"a block of {block_days} days is shorter than the frame of {days}")
    day = F.unix_date(on)
    own = F.floor(day / block_days)
    reaches = (own + 1) * block_days - day < days
    # a row stands in its own block and, if frames of the next one reach it, there as well
    places = F.array_compact(F.array(
        F.struct(own.alias("_block"), F.lit(False).alias("_carried")),
        F.when(reaches, F.struct((own + 1).alias("_block"), F.lit(True).alias("_carried")))))
    frame = Window.partitionBy(*by, "_block").orderBy(F.unix_date(on)).rangeBetween(1 - days, 0)
    placed = df.select("*", F.inline(places)).withColumn(out, F.avg(value).over(frame))
    return placed.where("not _carried").drop("_block", "_carried")


def trailing_pct(
    df: DataFrame, value: str, steps: int, by: list[str], on: str, out: str, joined: bool = False
) -> DataFrame:
    """Change against the value `steps` rows ago on a dense series; NULL before that.

    With `joined` the earlier value comes by `shifted`, on days.
    """
    if joined:
        moved = shifted(df, value, (steps,), by, on, "_before_{}")
        return moved.withColumn(out, relative_change(F.col(value), F.col(f"_before_{steps}"))).drop(f"_before_{steps}")
    before = F.lag(value, steps).over(Window.partitionBy(*by).orderBy(on))
    return df.withColumn(out, relative_change(F.col(value), before))


def shifted(
    df: DataFrame, value: str, steps: "tuple[int, ...]", by: list[str], on: str, name: str = "lag_{}", unit: str = "day"
) -> DataFrame:
    """Values of `steps` days (months) ago, by equality with the moved series instead of a window.

    The keys are (series, day): the rows of one long series are spread over all tasks. The
    series must be dense and have one row a day; a NULL series key is a series.
    """
    later = (lambda n: F.date_add(on, n)) if unit == "day" else (lambda n: F.add_months(on, n))
    moves = F.inline(F.array(*[F.struct(later(n).alias("_on"), F.lit(n).alias("_n")) for n in steps]))
    keys = {b: f"_by{i}" for i, b in enumerate(by)}
    moved = df.select(*[F.col(b).alias(k) for b, k in keys.items()], F.col(value).alias("_v"), moves)
    wide = moved.groupBy(*keys.values(), "_on").agg(
        *[F.max(F.when(F.col("_n") == n, F.col("_v"))).alias(name.format(n)) for n in steps])
    same = reduce(lambda a, b: a & b, [df[b].eqNullSafe(wide[k]) for b, k in keys.items()], df[on] == wide["_on"])
    return df.join(wide, same, "left").drop(*keys.values(), "_on")


def lags(
    df: DataFrame, value: str, steps: "tuple[int, ...]", by: list[str], on: str, name: str = "lag_{}"
) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(on)
    return df.withColumns({name.format(n): F.lag(value, n).over(w) for n in steps})


def lag_ratio(
    df: DataFrame, value: str, near: int, far: int, by: list[str], on: str, out: str
) -> DataFrame:
    """lag(near) / lag(far) - 1 on a dense series."""
    w = Window.partitionBy(*by).orderBy(on)
    return df.withColumn(out, F.try_divide(F.lag(value, near).over(w), F.lag(value, far).over(w)) - 1)


def last_observation(df: DataFrame, on: str) -> DataFrame:
    """The row with the largest `on`, by aggregation instead of a global sort."""
    return df.agg(F.max_by(F.struct("*"), on).alias("last")).select("last.*")


def coverage(df: DataFrame, cols: list[str]) -> DataFrame:
    """Number of rows and of non-NULL values per series column."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count(c).alias(f"n_{c}") for c in cols])


def to_long(df: DataFrame, on: str, cols: list[str]) -> DataFrame:
    """Wide series table to (series, day, value)."""
    return df.unpivot([on], cols, "series", "value").select("series", on, "value")


def to_wide(df: DataFrame, on: str, cols: list[str], value: str = "value") -> DataFrame:
    return df.groupBy(on).agg(*[
        F.max(F.when(F.col("series") == c, F.col(value))).alias(c) for c in cols
    ])


def merge_series(series: "list[tuple[DataFrame, str, str, str]]") -> DataFrame:
    """Merge (frame, date column, value column, name) series into one dense daily table.

    Stacking and one aggregation replace a chain of full outer joins. Days without a quote
    carry the previous one; days before a series' first quote stay NULL.
    """
    names = [name for _, _, _, name in series]
    parts = [
        frame.select(
            F.lit(name).alias("series"),
            F.to_date(day).alias("d"),
            F.col(value).try_cast("double").alias("value"),
        ).where("d is not null")
        for frame, day, value, name in series
    ]
    stacked = reduce(DataFrame.unionByName, parts)
    wide = to_wide(stacked, "d", names)
    dense = to_long(densify(wide, "d"), "d", names)
    return to_wide(forward_fill(dense, ["value"], ["series"], "d"), "d", names)
