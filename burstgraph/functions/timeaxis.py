"""The integer time axis: deriving it, naming its windows, marking its calendar."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The length of the hourly axis and its named windows (start, stop).
TOTAL_HOURS = 5278
NAMED_WINDOWS = {
    "october": (0, 912),
    "november": (913, 1633),
    "december": (1634, 2354),
    "january": (2355, 3074),
    "february": (3075, 3795),
    "march": (3796, 4514),
    "april": (4515, 5278),
    "charlie": (2496, 2664),
    "ferguson": (1464, 1752),
    "malaysia": (3960, 4128),
    "germanwings": (4368, 4536),
}


def _hours(ts: Column) -> Column:
    """Hours since 1970-01-01 from the calendar fields alone, so no time zone is involved."""
    return F.unix_date(F.to_date(ts)) * 24 + F.hour(ts)


def hour_index(ts: Column, origin: str) -> Column:
    """Whole hours since ``origin``, a full hour."""
    return (_hours(ts) - _hours(F.lit(origin).cast("timestamp_ntz"))).cast("int")


def month_index(ts: Column, first_year: int) -> Column:
    """Whole months since January of ``first_year``."""
    return ((F.year(ts) - first_year) * 12 + F.month(ts) - 1).cast("int")


def in_window(hour: Column, start: int | None, stop: int | None) -> Column:
    """Open at both ends."""
    inside = F.lit(True)
    if start is not None:
        inside = inside & (hour > start)
    if stop is not None:
        inside = inside & (hour < stop)
    return inside


def by_named_window(signal: DataFrame, windows: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """One row per sample and named window that holds it, in one pass over the signal."""
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("window"), F.lit(start).alias("start"), F.lit(stop).alias("stop"))
            for name, (start, stop) in (windows or NAMED_WINDOWS).items()
        ]
    )
    hit = F.filter(rows, lambda w: (F.col("hour") > w["start"]) & (F.col("hour") < w["stop"]))
    return signal.withColumn("_w", F.explode(hit)).select("_w.window", *signal.columns)


def calendar_marks(hours: DataFrame, origin: str) -> DataFrame:
    """Flag the hours at which a month, a Monday or a Saturday begins."""
    at = F.lit(origin).cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("hour"))
    midnight = F.hour(at) == 0
    return hours.select(
        "hour",
        (midnight & (F.dayofmonth(at) == 1)).cast("int").alias("month_start"),
        (midnight & (F.dayofweek(at) == 2)).cast("int").alias("monday"),
        (midnight & (F.dayofweek(at) == 7)).cast("int").alias("saturday"),
    )


def hourly_expand(daily: DataFrame) -> DataFrame:
    """Repeat each day's row for its 24 hours."""
    return daily.withColumn("_h", F.explode(F.sequence(F.lit(0), F.lit(23)))).select(
        (F.col("day") * 24 + F.col("_h")).cast("int").alias("hour"),
        *[c for c in daily.columns if c != "day"],
    )
