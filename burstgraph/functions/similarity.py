"""Similarity of two series: what one common hour adds, and the correlation of a chunk."""

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 24  # fixed value: samples per correlation chunk


def ratio(x: Column, y: Column) -> Column:
    """Smaller over larger value; null unless both are given (``least`` alone skips nulls)."""
    return F.when(x.isNotNull() & y.isNotNull(), F.least(x, y) / F.greatest(x, y))


def ratio_term(x: Column, y: Column, lam: float) -> Column:
    """The ratio where it exceeds ``lam``, else 0."""
    s = ratio(x, y)
    return F.when(s > lam, s).otherwise(F.lit(0.0))


def signed_term(x: Column, y: Column) -> Column:
    """The ratio, counted for above one half and against below; 0 without a common sample."""
    s = ratio(x, y)
    return F.when(s > 0.5, s).otherwise(F.coalesce(-s, F.lit(0.0)))


def chunk_correlation(n: Column) -> Column:
    """Correlation of one chunk from its sums x, y, xx, yy and xy.

    ``n`` is the number of common samples of *all* chunks. A chunk whose
    denominator is zero adds nothing.
    """
    top = F.col("xy") - F.col("x") * F.col("y") / n
    spread_x = F.greatest(F.col("xx") - F.col("x") * F.col("x") / n, F.lit(0.0))
    spread_y = F.greatest(F.col("yy") - F.col("y") * F.col("y") / n, F.lit(0.0))
    bottom = F.sqrt(spread_x * spread_y)
    return F.when(bottom > 0.0, top / bottom)
