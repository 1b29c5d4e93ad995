"""Polynomial (Savitzky-Golay) smoothing of many series at once.

The value of a polynomial fitted over a window is a sum of the window's moments (of v, k v, k^2 v, ...), and a moment of a
window is the difference of two running sums. So each series becomes its rows once, running sums go over them, and a window of 721
samples costs what one of 5 does: one shuffle by key, no row per sample and window place.
"""

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from burstgraph.operators.series import on_axis


def _moment_weights(window: int, order: int) -> list[float]:
    """a with c(k) = sum of a[j] * k**j, the weight of the sample k places from the centre; odd powers cancel out."""
    if window < 1 or window % 2 != 1:
        raise ValueError("the window must have a centre: a positive odd number of samples")
    if window < order + 2:
        raise ValueError("a polynomial of this order needs a wider window")
    half = window // 2
    places = np.arange(-half, half + 1, dtype=float) / half
    powers = np.vander(places, order + 1, increasing=True)
    row = np.linalg.inv(powers.T @ powers)[0]
    return [0.0 if j % 2 else float(a / half**j) for j, a in enumerate(row)]


def savgol_coefficients(window: int, order: int) -> list[float]:
    """Weights of the window's samples in the fitted polynomial's value at its centre."""
    weights, half = _moment_weights(window, order), window // 2
    return [sum(a * float(k) ** j for j, a in enumerate(weights)) for k in range(-half, half + 1)]


def fill_axis(series: DataFrame, length: int, keys: list[str], of: DataFrame | None = None) -> DataFrame:
    """One row per key (of ``of``, else of the series) and hour 0..length-1, 0 where there is no sample."""
    axis = F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("hour")
    known = (series if of is None else of).select(*keys).distinct() if keys else series.agg(F.count(F.lit(1)).alias("_rows"))
    grid = known.select(*keys, axis)
    return grid.join(series, [*keys, "hour"], "left").select(
        *keys, "hour", F.coalesce("value", F.lit(0.0)).cast("double").alias("value")
    )


def _padded(series: DataFrame, length: int, half: int, keys: list[str]) -> DataFrame:
    """(keys, _at, _v) with _at from -half to length - 1 + half: the whole axis, its ends padded by point reflection.

    (key, hour) is unique, so a packed series holds at most the axis.
    """
    samples = F.map_from_entries(F.collect_list(F.struct("hour", F.col("value").cast("double").alias("value"))))
    zeros = F.map_from_arrays(F.sequence(F.lit(0), F.lit(length - 1)), F.array_repeat(F.lit(0.0), length))
    dense = F.map_values(F.map_zip_with(zeros, F.col("_s"), lambda _, zero, v: F.coalesce(v, zero)))
    packed = on_axis(series, length).groupBy(*keys).agg(samples.alias("_s")).select(*keys, dense.alias("_d"))
    first, last = F.col("_d")[0], F.col("_d")[length - 1]
    before = F.transform(F.reverse(F.slice("_d", 2, half)), lambda v: first - F.abs(v - first))
    after = F.transform(F.reverse(F.slice("_d", length - half, half)), lambda v: last + F.abs(v - last))
    placed = packed.select(*keys, F.posexplode(F.concat(before, "_d", after)).alias("_pos", "_v"))
    return placed.select(*keys, (F.col("_pos") - half).alias("_at"), "_v")


def smooth(series: DataFrame, length: int, window: int, order: int = 2, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, hour, value) smoothed; the ends are padded by point reflection.

    ``series`` has one row per key and hour; absent hours count as 0,
    hours off the axis are refused. A key whose series is all 0 is kept.
    """
    half, weights = window // 2, _moment_weights(window, order)
    if length < half + 1:
        raise ValueError("the series is shorter than half the window")
    keys = list(keys)
    along = Window.partitionBy(*keys).orderBy("_at")
    middle = (length - 1) // 2  # whole numbers near 0 keep the running sums of whole values exact
    place = (F.col("_at") - middle).cast("double")
    degrees = range(len(weights))
    summed = _padded(series, length, half, keys).select(
        *keys,
        "_at",
        *[F.sum(F.col("_v") * F.pow(place, F.lit(j)) if j else F.col("_v")).over(along.rowsBetween(Window.unboundedPreceding, 0)).alias(f"_s{j}") for j in degrees],
    )
    moments = summed.select(
        *keys,
        F.col("_at").cast("int").alias("hour"),
        *[(F.lead(f"_s{j}", half).over(along) - F.lag(f"_s{j}", half + 1, 0.0).over(along)).alias(f"_m{j}") for j in degrees],
    ).where((F.col("hour") >= 0) & (F.col("hour") < length))
    here = (F.col("hour") - middle).cast("double")
    terms = [  # sum of (place - here)**j * v over the window, written out in the moments about the middle
        a * sum((math.comb(j, i) * F.pow(-here, F.lit(j - i)) * F.col(f"_m{i}") for i in range(j)), F.col(f"_m{j}"))
        for j, a in enumerate(weights)
        if a
    ]
    return moments.select(*keys, "hour", sum(terms[1:], terms[0]).alias("value"))
