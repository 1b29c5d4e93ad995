"""Operators on the long signal table ``(id, hour, value)`` with unique (id, hour) and value <> 0.

A group per id never holds more rows than the time axis has hours, because
(id, hour) is unique; that bounds every packed series.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burstgraph.functions.timeaxis import in_window
from burstgraph.operators.skew import join_skewed


def dedupe(samples: DataFrame) -> DataFrame:
    """One value, the largest, per (id, hour); zeros dropped."""
    return samples.groupBy("id", "hour").agg(F.max("value").alias("value")).where("value <> 0")


def slice_window(signal: DataFrame, start: int, stop: int) -> DataFrame:
    """Samples strictly inside the window."""
    return signal.where(in_window(F.col("hour"), start, stop))


def _keep_ids(signal: DataFrame, keep: Column, aggregate: Column, start, stop) -> DataFrame:
    chosen = (
        signal.where(in_window(F.col("hour"), start, stop))
        .groupBy("id")
        .agg(aggregate.alias("_a"))
        .where(keep)
        .select("id")
    )
    return signal.join(chosen, "id", "left_semi")


def active_in(signal: DataFrame, start: int, stop: int) -> DataFrame:
    """Whole series of the ids with at least one sample in the window."""
    return _keep_ids(signal, F.col("_a") > 0, F.count(F.lit(1)), start, stop)


def peak_above(signal: DataFrame, level: float, start: int | None = None, stop: int | None = None) -> DataFrame:
    """Whole series of the ids whose largest sample in the window exceeds ``level``."""
    return _keep_ids(signal, F.col("_a") > level, F.max("value"), start, stop)


def activity_band(signal: DataFrame, low: int, high: int, start: int | None = None, stop: int | None = None) -> DataFrame:
    """Whole series of the ids with between ``low`` and ``high`` samples, both exclusive."""
    return _keep_ids(signal, (F.col("_a") > low) & (F.col("_a") < high), F.count(F.lit(1)), start, stop)


def series_stats(signal: DataFrame, length: int, rate: float) -> DataFrame:
    """Mean, population deviation and burst threshold over the zero-filled axis.

    Closed forms over the samples alone; the axis is never materialised.
    """
    mean = F.sum("value") / length
    square = F.sum(F.col("value") * F.col("value")) / length
    return (
        signal.groupBy("id")
        .agg(mean.alias("mean"), square.alias("_square"))
        .withColumn("sd", F.sqrt(F.greatest(F.col("_square") - F.col("mean") * F.col("mean"), F.lit(0.0))))
        .withColumn("threshold", F.lit(float(rate)) * F.col("sd") + F.col("mean"))
        .drop("_square")
    )


def above_threshold(signal: DataFrame, length: int, rate: float) -> DataFrame:
    """Samples above their own series' threshold, over the whole axis.

    The statistics stay with the samples as windows over the series: one scan,
    one shuffle by id, and at most the axis' hours per group.
    """
    series = Window.partitionBy("id")
    mean = F.sum("value").over(series) / length
    square = F.sum(F.col("value") * F.col("value")).over(series) / length
    return (
        signal.withColumn("_mean", mean)
        .withColumn("_sd", F.sqrt(F.greatest(square - F.col("_mean") * F.col("_mean"), F.lit(0.0))))
        .where(F.col("value") > F.lit(float(rate)) * F.col("_sd") + F.col("_mean"))
        .select("id", "hour", "value")
    )


def burst_samples(signal: DataFrame, length: int, rate: float, min_count: int, start: int, stop: int) -> DataFrame:
    """Over-threshold samples of the ids with more than ``min_count`` of them in the window.

    The samples are kept over the whole axis, the count only looks at the window.
    It uses the partitioning of the threshold, so there is no further shuffle.
    """
    inside = F.count_if(in_window(F.col("hour"), start, stop)).over(Window.partitionBy("id"))
    return (
        above_threshold(signal, length, rate)
        .withColumn("_n", inside)
        .where(F.col("_n") > min_count)
        .select("id", "hour", "value")
    )


def pack(
    signal: DataFrame,
    start: int | None = None,
    stop: int | None = None,
    floor: float | None = None,
    normalise: bool = False,
) -> DataFrame:
    """(id, freq, series MAP<INT,DOUBLE>) of the samples in the window and above the floor.

    ``freq`` counts those samples; ``normalise`` divides the values by it.
    """
    kept = signal.where(in_window(F.col("hour"), start, stop))
    if floor is not None:
        kept = kept.where(F.col("value") > floor)
    entries = F.sort_array(F.collect_list(F.struct("hour", "value")))
    packed = kept.groupBy("id").agg(F.map_from_entries(entries).alias("series"))
    packed = packed.withColumn("freq", F.size("series"))
    if normalise:
        packed = packed.withColumn("series", F.transform_values("series", lambda _, v: v / F.col("freq")))
    return packed.select("id", "freq", "series")


def slice_packed(series: Column, start: int, stop: int) -> Column:
    """The window on the packed form."""
    return F.map_filter(series, lambda hour, _: (hour > start) & (hour < stop))


def on_axis(signal: DataFrame, length: int) -> DataFrame:
    """``signal`` as it is; reading a sample whose hour is not 0..length-1 fails: the axis is too short for the data."""
    inside = (F.col("hour") >= 0) & (F.col("hour") < length)
    off = F.raise_error(F.concat(F.lit("sample off the axis, hour "), F.col("hour").cast("string")))
    return signal.withColumn("hour", F.when(inside, F.col("hour")).otherwise(off.cast("int")))


def densify(signal: DataFrame, length: int) -> DataFrame:
    """(id, values ARRAY<DOUBLE>) of exactly ``length`` values, 0 where there is no sample."""
    entries = F.sort_array(F.collect_list(F.struct("hour", "value")))
    axis = F.sequence(F.lit(0), F.lit(length - 1))
    zeros = F.map_from_arrays(axis, F.array_repeat(F.lit(0.0), length))
    merged = F.map_zip_with(zeros, F.col("series"), lambda _, zero, v: F.coalesce(v, zero))
    return (
        on_axis(signal, length)
        .groupBy("id")
        .agg(F.map_from_entries(entries).alias("series"))
        .select("id", F.map_values(merged).alias("values"))
    )


def of_cluster(signal: DataFrame, labels: DataFrame) -> DataFrame:
    """Series of the ids on a list."""
    return signal.join(labels.select("id").distinct(), "id", "left_semi")


def overall_activity(signal: DataFrame) -> DataFrame:
    """Sum over the entities per hour."""
    return signal.groupBy("hour").agg(F.sum("value").alias("value"))


def daily_activity(activity: DataFrame, hours_per_day: int = 24) -> DataFrame:
    """Sum per block of hours, scaled so that the largest block is 100."""
    daily = activity.groupBy(F.floor(F.col("hour") / hours_per_day).cast("int").alias("day")).agg(
        F.sum("value").alias("value")
    )
    top = F.max("value").over(Window.partitionBy())  # one row per block of the axis
    return daily.select("day", (F.col("value") * 100.0 / top).alias("value"))


def compare_with_reference(daily: DataFrame, reference: DataFrame) -> DataFrame:
    """Both daily series side by side."""
    return daily.withColumnRenamed("value", "proposed").join(
        reference.withColumnRenamed("value", "reference"), "day"
    )


def baseline_shift(series: DataFrame, column: str = "value", keys: tuple[str, ...] = ()) -> DataFrame:
    """Subtract the smallest value of each key's series, which has at most the axis' hours."""
    return series.withColumn(column, F.col(column) - F.min(column).over(Window.partitionBy(*keys)))


def select_by_title(labels: DataFrame, titles: DataFrame, title_column: str = "label") -> DataFrame:
    """Rows whose label is on a list of titles; labels repeat, so the label side may be hot."""
    wanted = titles.select(F.col(title_column)).distinct()
    return join_skewed(labels, wanted, title_column, "left_semi").select(labels.columns)


def titles_present(labels: DataFrame, titles: DataFrame, title_column: str = "label") -> DataFrame:
    """(listed, present): how many titles are listed and how many of them occur."""
    known = labels.select(title_column).distinct().withColumn("_known", F.lit(1))
    return titles.select(title_column).distinct().join(known, title_column, "left").agg(
        F.count(F.lit(1)).alias("listed"), F.count("_known").alias("present")
    )
