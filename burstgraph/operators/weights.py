"""Edge weights from the series of the two ends.

Each series is packed once per vertex, as arrays, and sent to the cells of a grid that hold one of the vertex's links
(``operators.grid``): no exchange carries a series per link, and parallel links are weighed once.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstgraph.functions.similarity import CHUNK
from burstgraph.functions.timeaxis import in_window
from burstgraph.operators.grid import chunked_correlation, grid_weights, pack_series, ratio_sum, signed_sum

BLOCK_HOURS, _COPIES = 64, 100_000


def pack_blocks(signal: DataFrame, start: int | None, stop: int | None, floor: float | None) -> DataFrame:
    """(id, freq, blocks MAP<block, MAP<hour, value>>) of the samples in the window and above the floor.

    One shuffle by id serves both groupings; (id, hour) is unique, so a block
    holds at most ``BLOCK_HOURS`` samples.
    """
    kept = signal.where(in_window(F.col("hour"), start, stop))
    if floor is not None:
        kept = kept.where(F.col("value") > floor)
    samples = F.map_from_entries(F.sort_array(F.collect_list(F.struct("hour", "value"))))
    blocks = F.map_from_entries(F.collect_list(F.struct("block", "samples")))
    return (
        kept.repartition("id")
        .groupBy("id", F.floor(F.col("hour") / BLOCK_HOURS).cast("int").alias("block"))
        .agg(samples.alias("samples"), F.count(F.lit(1)).alias("n"))
        .groupBy("id")
        .agg(F.sum("n").alias("freq"), blocks.alias("blocks"))
    )


def _samples(signal: DataFrame, start: int | None, stop: int | None, floor: float | None = None) -> DataFrame:
    kept = signal.where(in_window(F.col("hour"), start, stop))
    return kept if floor is None else kept.where(F.col("value") > floor)


def _one_row_per_copy(weighed: DataFrame) -> DataFrame:
    """A link's copies are counted out in steps, so no row ever holds an array of all of them."""
    steps = weighed.selectExpr("src", "dst", "weight", "copies", f"explode(sequence(0L, copies - 1, {_COPIES}L)) AS _from")
    return steps.selectExpr("src", "dst", "weight", f"explode(sequence(_from, least(_from + {_COPIES}L, copies) - 1)) AS _copy").drop("_copy")


def hebb_weights(
    edges: DataFrame,
    signal: DataFrame,
    start: int,
    stop: int,
    floor: float = 0.0,
    normalise: bool = True,
    lam: float = 0.5,
    min_weight: float | None = None,
) -> DataFrame:
    """Sum of value ratios above ``lam`` over the common hours of the open window.

    ``normalise`` divides the values by their series' number of samples in the
    window. ``min_weight`` prunes (weight > min_weight). No ratio exceeds 1, so a
    vertex with at most ``min_weight`` samples cannot have a heavier edge and is
    left out before the join; this is exact.
    """
    packed = pack_series(_samples(signal, start, stop, floor))
    keep_all = min_weight is None or min_weight < 0
    if not keep_all:
        packed = packed.where(F.size("hours") > min_weight)
    weighed = grid_weights(edges, packed, ratio_sum(lam), normalise, keep_all)
    if min_weight is not None:
        weighed = weighed.where(F.col("weight") > min_weight)
    return _one_row_per_copy(weighed)


def signed_weights(edges: DataFrame, signal: DataFrame, normalise: bool = True) -> DataFrame:
    """Ratios above one half minus the others, over the whole axis."""
    return _one_row_per_copy(grid_weights(edges, pack_series(signal), signed_sum, normalise, True))


def correlation_weights(edges: DataFrame, signal: DataFrame, start: int, stop: int) -> DataFrame:
    """Chunked correlation over the open window: an edge's common hours in order, cut into chunks of ``CHUNK``.

    Dividing a series by its frequency cancels out, so values stay as they are.
    """
    packed = pack_series(_samples(signal, start, stop))
    return _one_row_per_copy(grid_weights(edges, packed, chunked_correlation(CHUNK), False, True))
