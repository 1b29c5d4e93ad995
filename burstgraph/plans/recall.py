"""The recall experiment: does the learned matrix restore the activity it was learned from?"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstgraph.operators.memory import recall
from burstgraph.operators.series import baseline_shift
from burstgraph.operators.smoothing import fill_axis, smooth
from burstgraph.session import cut_lineage


def pattern_activity(cells: DataFrame, length: int) -> DataFrame:
    """(hour, value): sum of p + 1 over the rows, twice the number of active cells."""
    active = cells.groupBy("hour").agg((2 * F.count(F.lit(1))).cast("double").alias("value"))
    return fill_axis(active, length, [])


def recall_difference(original: DataFrame, recalled: DataFrame, length: int, window: int, order: int = 2) -> DataFrame:
    """(hour, original, recalled, difference) of the smoothed, baseline-shifted activities.

    Both sides are smoothed together, as two keys of one job; a pattern without a cell has the activity 0.
    """
    def tagged(cells: DataFrame, side: str) -> DataFrame:
        return cells.groupBy("hour").agg(F.count(F.lit(1)).alias("_n")).select(
            F.lit(side).alias("side"), "hour", (2.0 * F.col("_n")).alias("value")
        )

    ground = original.sparkSession.createDataFrame([("original", 0, 0.0), ("recalled", 0, 0.0)], "side STRING, hour INT, value DOUBLE")
    both = tagged(original, "original").union(tagged(recalled, "recalled")).union(ground)
    both = both.groupBy("side", "hour").agg(F.sum("value").alias("value"))
    curves = baseline_shift(smooth(both, length, window, order, ("side",)), keys=("side",))
    sides = [F.max(F.when(F.col("side") == name, F.col("value"))).alias(name) for name in ("original", "recalled")]
    return curves.groupBy("hour").agg(*sides).withColumn("difference", F.col("recalled") - F.col("original"))


def recall_experiment(
    matrix: DataFrame, cells: DataFrame, length: int, window: int, degraded: DataFrame | None = None,
    steps: int = 1, tie: int = 1,
) -> DataFrame:
    """Recall from the (possibly degraded) pattern, compared with the original."""
    restored = cut_lineage(recall(matrix, cells if degraded is None else degraded, steps, tie))
    return recall_difference(cells, restored, length, window)
