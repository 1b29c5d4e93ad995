"""Associative-memory operators on sparse +-1 patterns.

A pattern is the table of its active (+1) cells ``(id, hour)``; every other cell
is -1. With p = 2a - 1 the score of a cell is 2 * (weight of the active
neighbours) - (weight of all neighbours), so the dense entity x hour grid is
never built: one lookup, one aggregation combined before the shuffle.
``matrix`` is a symmetric edge table ``(src, dst, weight)`` with weights > 0.
Optional ``by`` columns hold several experiments in one pattern table.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burstgraph.functions.hashing import uniform
from burstgraph.operators.graph import prune_edges, symmetrise
from burstgraph.operators.ordinals import ordinal_ids
from burstgraph.operators.series import above_threshold
from burstgraph.operators.skew import join_skewed, with_both_ends
from burstgraph.session import cut_lineage

WEIGHT = "DECIMAL(28, 12)"  # weights are summed in this type, exactly: a score of 0 is a tie whatever the order of the sum
MUTE_DIVISORS = (1.0, 1.2, 1.5, 2.0, 3.0, 4.0, 5.0, 10.0)  # fixed values of the mute sweep


def memory_matrix(edges: DataFrame, min_weight: float = 0.0, cluster: DataFrame | None = None, binary: bool = False) -> DataFrame:
    """Symmetric weights above ``min_weight``, optionally inside a cluster or reduced to structure."""
    kept = prune_edges(edges, min_weight)
    if cluster is not None:
        kept = with_both_ends(kept, cluster)
    if binary:
        kept = kept.withColumn("weight", F.lit(1.0))
    return symmetrise(kept)


def binarise(signal: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Cells above a fixed threshold; a threshold below 0 would make absent cells active."""
    if threshold < 0:
        raise ValueError("threshold must not be negative on a sparse signal")
    return signal.where(F.col("value") > threshold).select("id", "hour")


def binarise_sigma(signal: DataFrame, length: int, sigmas: float = 2.0) -> DataFrame:
    """Cells above their row's mean + sigmas * deviation."""
    return above_threshold(signal, length, sigmas).select("id", "hour")


def _grid(ids: DataFrame, length: int) -> DataFrame:
    return ids.select("id", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("hour"))


def degrade(cells: DataFrame, ids: DataFrame, length: int, noise: float, seed: int) -> DataFrame:
    """Flip every cell of the grid with probability ``noise``, by a hash of the cell."""
    # What is shuffled is the flips and the active cells; the grid is only counted through.
    flips = _grid(ids, length).where(uniform([F.col("id"), F.col("hour")], seed) < noise)
    inside = cells.where((F.col("hour") >= 0) & (F.col("hour") < length)).join(ids.select("id").distinct(), "id", "left_semi")
    tagged = inside.select("id", "hour", F.lit(False).alias("_flip")).union(flips.select("id", "hour", F.lit(True).alias("_flip")))
    once = tagged.groupBy("id", "hour").agg(F.min("_flip").alias("_least"), F.max("_flip").alias("_most"))
    return once.where("_least = _most").select("id", "hour")


def random_cells(ids: DataFrame, length: int, share: float, seed: int) -> DataFrame:
    """Uniform noise on the grid, active with probability ``share``: the control input."""
    return _grid(ids, length).where(uniform([F.col("id"), F.col("hour")], seed) < share)


def mute(cells: DataFrame, cluster: DataFrame, divisor: float) -> DataFrame:
    """Switch off the first len / divisor rows of the cluster, in id order."""
    return mute_each(cells, cluster, (divisor,)).select("id", "hour")


def mute_each(cells: DataFrame, cluster: DataFrame, divisors: tuple[float, ...]) -> DataFrame:
    """One muted copy of the pattern per divisor, told apart by the column ``divisor``."""
    rows = ordinal_ids(cluster.select("id").distinct())
    total = rows.agg(F.count(F.lit(1)).alias("_n")).scalar()
    copies = F.explode(F.array(*[F.lit(float(d)) for d in divisors]))
    return (
        cells.join(rows, "id", "left")
        .select("id", "hour", "ordinal", copies.alias("divisor"))
        .where(F.col("ordinal").isNull() | (F.col("ordinal") >= F.floor(total / F.col("divisor"))))
        .select("divisor", "id", "hour")
    )


def recall_scores(matrix: DataFrame, cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, id, hour, score) of the cells with an active neighbour.

    A cell without one scores minus its row's total weight. The active cells of
    a row are packed (at most axis length x experiments) so a neighbour stays
    one row until after the lookup.
    """
    packed = (
        cells.groupBy(F.col("id").alias("dst"))
        .agg(F.collect_list(F.struct(*by, "hour")).alias("_cells"))
    )
    active = (
        join_skewed(matrix, packed, "dst")
        .select(F.col("src").alias("id"), "weight", F.explode("_cells").alias("_cell"))
        .groupBy("id", *[F.col(f"_cell.{c}").alias(c) for c in (*by, "hour")])
        .agg(F.sum(F.col("weight").cast(WEIGHT)).alias("_active"))
    )
    totals = matrix.groupBy(F.col("src").alias("id")).agg(F.sum(F.col("weight").cast(WEIGHT)).alias("_total"))
    return active.join(totals, "id").select(
        *by, "id", "hour", (F.col("_active") + F.col("_active") - F.col("_total")).alias("score")
    )


def recall(matrix: DataFrame, cells: DataFrame, steps: int = 1, tie: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """Active cells after ``steps`` updates; a zero score becomes ``tie`` (+1 or -1).

    Rows without neighbours end as 0, which is neither active nor -1; see ``error_rates``.
    """
    on: Column = F.col("score") >= 0 if tie > 0 else F.col("score") > 0
    for step in range(steps):
        cells = recall_scores(matrix, cells, by).where(on).select(*by, "id", "hour")
        if step < steps - 1:
            cells = cut_lineage(cells)
    return cells


def in_event(cells: DataFrame, start: int, stop: int) -> DataFrame:
    """Cells of the event's hours: start included, stop not."""
    return cells.where((F.col("hour") >= start) & (F.col("hour") < stop))


def expand_hits(cells: DataFrame, start: int, stop: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows with any active cell in the event become active in all of its hours."""
    hours = F.explode(F.sequence(F.lit(start), F.lit(stop - 1))).alias("hour")
    return in_event(cells, start, stop).select(*by, "id").distinct().select(*by, "id", hours)


def _rates(cells: DataFrame, marks: list[str], rows: DataFrame, matrix: DataFrame, hours: int) -> DataFrame:
    """One row of rates: ``miss_rate`` and ``mismatch_rate`` arrays, an entry per mark.

    ``cells`` has a row per cell that is active originally (``_in``) or after a recall (one boolean column per mark). Cells are counted
    per row first, so the list of rows and the matrix are read once and met once.
    """
    inside = F.coalesce("_in", F.lit(False))
    counts = [F.count_if(inside).alias("_original")]
    for mark in marks:
        counts += [F.count_if(F.col(mark)).alias(f"_n{mark}"), F.count_if(F.col(mark) & inside).alias(f"_hit{mark}")]
    linked = matrix.select(F.col("src").alias("id")).distinct().withColumn("_linked", F.lit(True))
    of_row = rows.select("id").distinct().join(linked, "id", "left").join(cells.groupBy("id").agg(*counts), "id", "left")
    alone = F.col("_linked").isNull()
    total = of_row.agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count_if(alone).alias("_isolated"),
        F.coalesce(F.sum("_original"), F.lit(0)).alias("_original"),
        F.coalesce(F.sum(F.when(alone, F.col("_original"))), F.lit(0)).alias("_lost"),
        *[F.coalesce(F.sum(f"_{kind}{mark}"), F.lit(0)).alias(f"_{kind}{mark}") for mark in marks for kind in ("n", "hit")],
    )

    def differing(mark: str) -> Column:
        changed = F.col("_original") + F.col(f"_n{mark}") - 2 * F.col(f"_hit{mark}")
        return changed + F.col("_isolated") * hours - F.col("_lost")

    return total.select(
        F.array(*[1 - F.try_divide(F.col(f"_hit{mark}"), F.col("_original")) for mark in marks]).alias("miss_rate"),
        F.array(*[F.try_divide(differing(mark), F.col("_rows") * hours) for mark in marks]).alias("mismatch_rate"),
    )


def error_rates(original: DataFrame, recalled: DataFrame, rows: DataFrame, matrix: DataFrame, hours: int) -> DataFrame:
    """(miss_rate, mismatch_rate) over the given rows and ``hours`` hours.

    Miss rate: originally active cells that are not active any more. Mismatch
    rate: all cells that differ; every cell of a row without neighbours does,
    because it is 0. Null where there is nothing to divide by.
    """
    tagged = original.select("id", "hour", F.lit(True).alias("_in"), F.lit(False).alias("_on")).union(
        recalled.select("id", "hour", F.lit(False).alias("_in"), F.lit(True).alias("_on"))
    )
    cells = tagged.groupBy("id", "hour").agg(F.max("_in").alias("_in"), F.max("_on").alias("_on"))
    return _rates(cells, ["_on"], rows, matrix, hours).select(F.col("miss_rate")[0].alias("miss_rate"), F.col("mismatch_rate")[0].alias("mismatch_rate"))


def _active_since(cells: DataFrame, cluster: DataFrame, divisors: list[float]) -> DataFrame:
    """(id, hour, since): the first of the ascending ``divisors`` under which the cell is not muted; cells that always are go."""
    rows = ordinal_ids(cluster.select("id").distinct())
    total = rows.agg(F.count(F.lit(1)).alias("_n")).scalar()
    muted = [F.coalesce((F.col("ordinal") < F.floor(total / F.lit(d))).cast("int"), F.lit(0)) for d in divisors]
    since = sum(muted[1:], muted[0])
    return cells.join(rows, "id", "left").select("id", "hour", since.alias("since")).where(F.col("since") < len(divisors))


def mute_sweep(
    matrix: DataFrame,
    cells: DataFrame,
    cluster: DataFrame,
    hours: int,
    divisors: tuple[float, ...] = MUTE_DIVISORS,
    tie: int = -1,
    event: tuple[int, int] | None = None,
    row_hits: bool = False,
) -> DataFrame:
    """Error after muting a growing part of the cluster: all parts in one job.

    A larger divisor mutes fewer rows, so a cell is active from one divisor on. Each active cell travels once with that place,
    a cell's incoming weight is summed per place, and running sums over the places are the scores of all parts.
    With an ``event`` only its hours are compared (``hours`` is not used then); with ``row_hits`` a row that recalled any
    of its hours counts for all of them.
    """
    if row_hits and event is None:
        raise ValueError("row hits need an event")
    steps = sorted(float(d) for d in divisors)
    packed = _active_since(cells, cluster, steps).groupBy(F.col("id").alias("dst")).agg(
        F.collect_list(F.struct("hour", "since")).alias("_cells")  # at most the axis
    )
    weight = F.col("weight").cast(WEIGHT)
    sums = (
        join_skewed(matrix, packed, "dst")
        .select(F.col("src").alias("id"), "weight", F.explode("_cells").alias("_cell"))
        .select("id", "weight", "_cell.hour", "_cell.since")
        .transform(lambda df: df if event is None else in_event(df, *event))
        .groupBy("id", "hour")
        .agg(*[F.coalesce(F.sum(F.when(F.col("since") == k, weight)), F.lit(0)).alias(f"_w{k}") for k in range(len(steps))])
    )
    totals = matrix.groupBy(F.col("src").alias("id")).agg(F.sum(weight).alias("_total"))
    marks, active = [f"_on{k}" for k in range(len(steps))], F.lit(0).cast("DECIMAL(1, 0)")
    on = []
    for k, mark in enumerate(marks):
        active = active + F.col(f"_w{k}").cast(WEIGHT)  # wider sums would lose decimal places
        score = active + active - F.col("_total").cast(WEIGHT)
        on.append((score >= 0 if tie > 0 else score > 0).alias(mark))
    scored = sums.join(totals, "id").select("id", "hour", *on).where(" OR ".join(marks))
    if event is not None:
        cells, hours = in_event(cells, *event), event[1] - event[0]
        if row_hits:
            scored = scored.groupBy("id").agg(*[F.max(mark).alias(mark) for mark in marks])
            scored = scored.withColumn("hour", F.explode(F.sequence(F.lit(event[0]), F.lit(event[1] - 1))))
    tagged = cells.select("id", "hour", F.lit(True).alias("_in"), *[F.lit(False).alias(mark) for mark in marks]).union(
        scored.select("id", "hour", F.lit(False).alias("_in"), *marks)
    )
    met = tagged.groupBy("id", "hour").agg(*[F.max(c).alias(c) for c in ("_in", *marks)])
    rates = _rates(met, marks, cluster, matrix, hours)
    named = F.arrays_zip(F.array(*[F.lit(d) for d in steps]).alias("divisor"), "miss_rate", "mismatch_rate")
    rows = rates.select(F.inline(named)).toDF("divisor", "miss_rate", "mismatch_rate")
    return rows.withColumn("percent", F.floor(100.0 / F.col("divisor")).cast("int"))
