"""Degree and size distributions: log-binned histograms and power-law fits."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bins have edges BASE ** (TOP * k / bins), k = 0..bins.
BASE = 3.0
TOP = 9.0
DEGREE_BINS = 19
COMMUNITY_BINS = 39


def _bin(value: Column, bins: int, top: float) -> Column:
    """Index of the half-open bin, the last one closed; ``bins`` above the edges, null below them."""
    position = F.floor(F.ln(value) / math.log(BASE) * bins / top).cast("int")
    return F.when(value > BASE**top, bins).when(value >= 1, F.least(position, F.lit(bins - 1)))


def log_histogram(values: DataFrame, column: str, bins: int = DEGREE_BINS, scale: bool = False, top: float = TOP) -> DataFrame:
    """(bin, lower, count), one row per bin, empty ones included; ``scale`` divides by the largest.

    Edges are BASE ** (top * k / bins); the row after the last bin counts the values above them.
    """
    counts = (
        values.select(_bin(F.col(column), bins, top).alias("bin"))
        .where(F.col("bin").isNotNull())
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    axis = values.sparkSession.range(bins + 1).select(F.col("id").cast("int").alias("bin"))
    count = F.coalesce("n", F.lit(0))
    table = axis.join(counts, "bin", "left").select(
        "bin", F.pow(F.lit(BASE), F.lit(top) * F.col("bin") / bins).alias("lower"), count.alias("count")
    )
    if not scale:
        return table
    most = counts.agg(F.max("n").alias("most")).scalar()
    return table.withColumn("count", F.col("count") / most)


def powerlaw_alpha(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """(c, alpha): alpha = 1 + n / sum(ln(x / xmin)), c the largest y; (0, 0) without points."""
    # sum(ln(x / xmin)) = sum(ln x) - n ln(xmin): one pass, no second look at xmin.
    spread = F.sum(F.ln(x)) - F.count(x) * F.ln(F.min(x))
    return points.agg(
        F.coalesce(F.max(y).cast("double"), F.lit(0.0)).alias("c"),
        F.coalesce(1 + F.count(x) / F.when(spread > 0, spread), F.lit(0.0)).alias("alpha"),
    )


def powerlaw_slope(points: DataFrame, x: str = "x", y: str = "y", tail: float = 0.0) -> DataFrame:
    """(slope, intercept) of ln(y) against ln(x) by least squares over the positive points with x of at least ``tail``."""
    used = points.where((F.col(x) > 0) & (F.col(y) > 0) & (F.col(x) >= tail)).select(
        F.ln(x).alias("lx"), F.ln(y).alias("ly")
    )
    return used.agg(
        F.regr_slope("ly", "lx").alias("slope"), F.regr_intercept("ly", "lx").alias("intercept")
    )


def community_sizes(labels: DataFrame, bins: int = COMMUNITY_BINS) -> DataFrame:
    """Log-binned histogram of the sizes of given communities."""
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    return log_histogram(sizes, "size", bins)
