"""The jobs from files to files: ingest, the four ways of learning, a cluster's signals and its activity against a
reference, degree distributions, recall and muting.

``store`` is the folder ``ingest`` fills: parquet tables vertices, edges and
signal. Windows go by name or as (start, stop). Every learning job leaves
``vertices`` and ``edges`` tables and the parts of ``graph.gexf`` in ``out``.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burstgraph.functions.timeaxis import NAMED_WINDOWS, TOTAL_HOURS
from burstgraph.functions.titles import exported_title
from burstgraph.operators import distributions, memory, series
from burstgraph.operators.graph import PropertyGraph, degrees
from burstgraph.plans import learning
from burstgraph.plans.recall import recall_difference
from burstgraph.session import Scratch, cut_lineage
from burstgraph.sources import readers, sinks

Window = str | tuple[int, int]


def _bounds(window: Window) -> tuple[int, int]:
    return NAMED_WINDOWS[window] if isinstance(window, str) else window


def _tables(spark: SparkSession, store: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(readers.load_table(spark, f"{store}/{name}") for name in ("vertices", "edges", "signal"))


def _save(graph: PropertyGraph, out: str, weighted: bool) -> PropertyGraph:
    """Store the result first, so the document is written from it and not computed again."""
    spark = graph.vertices.sparkSession
    sinks.save_table(graph.vertices, f"{out}/vertices")
    sinks.save_table(graph.edges, f"{out}/edges")
    stored = PropertyGraph(
        readers.load_table(spark, f"{out}/vertices"), readers.load_table(spark, f"{out}/edges")
    )
    sinks.write_gexf(stored, f"{out}/graph.gexf", weighted)
    return stored


def ingest(
    spark: SparkSession, vertices: str, edges: str, signal: str, store: str, wide: bool = False, hour_base: int = 1
) -> None:
    """Read the three files, keep what belongs together, store it as tables."""
    samples = readers.read_signal_wide(spark, signal, hour_base) if wide else readers.read_signal_long(spark, signal)
    sinks.save_table(samples, f"{store}/signal", sort_by="hour")
    samples = readers.load_table(spark, f"{store}/signal")
    kept = readers.join_series(readers.read_vertices(spark, vertices), samples)
    sinks.save_table(kept, f"{store}/vertices")
    kept = readers.load_table(spark, f"{store}/vertices")
    with Scratch(spark, "ingest") as scratch:  # the joins read the links more than once, the text is parsed once
        links, _ = scratch.keep(readers.read_edges(spark, edges))
        sinks.save_table(readers.with_both_ends(links, kept), f"{store}/edges")


def static(
    spark: SparkSession, store: str, out: str, window: Window = "charlie", length: int = TOTAL_HOURS, **options
) -> PropertyGraph:
    """Learn on all links; also writes the component's series as text."""
    vertices, edges, signal = _tables(spark, store)
    found = learning.learn_static(vertices, edges, signal, *_bounds(window), **options)
    stored = _save(found.graph, out, weighted=False)
    sinks.write_cluster_signals(signal, stored.vertices, f"{out}/signal.txt", length)
    return stored


def peaks(
    spark: SparkSession, store: str, out: str, window: Window = "october", length: int = TOTAL_HOURS, **options
) -> PropertyGraph:
    """Learn on bursts; also writes the component's unfiltered series as text."""
    vertices, edges, signal = _tables(spark, store)
    found = learning.learn_peaks(vertices, edges, signal, length, *_bounds(window), **options)
    stored = _save(found.graph, out, weighted=False)
    _, samples = learning.component_full_signals(PropertyGraph(vertices, edges), signal, stored)
    sinks.write_signal_text(samples, f"{out}/signal.txt", length)
    return stored


def null_model(spark: SparkSession, store: str, out: str, window: Window = "february", **options) -> PropertyGraph:
    """Learn on random links between the same series."""
    vertices, edges, signal = _tables(spark, store)
    found = learning.learn_null_model(vertices, edges, signal, *_bounds(window), **options)
    return _save(found.graph, out, weighted=False)


def all_pairs(
    spark: SparkSession, signal: str, titles: str, out: str, window: Window = "january", **options
) -> PropertyGraph:
    """Link the alike among the loud, from a signal table and an id,title file."""
    named = readers.read_labels(spark, titles).select("id", exported_title(F.col("label")).alias("title"))
    found = learning.learn_all_pairs(readers.load_table(spark, signal), named, *_bounds(window), **options)
    return _save(found, out, weighted=True)


def cluster_signals(spark: SparkSession, signal: str, cluster: str, out: str, length: int = TOTAL_HOURS) -> None:
    """Write the series of a list of ids as text."""
    labels = readers.read_labels(spark, cluster)
    sinks.write_cluster_signals(readers.load_table(spark, signal), labels, out, length)


def activity(
    spark: SparkSession, signal: str, cluster: str, reference: str, out: str, origin: str, hours_per_day: int = 24
) -> None:
    """A cluster's daily activity, scaled to 100, beside a date,value file whose day 0 is the date ``origin``.

    Leaves the tables ``daily``, ``compared`` (days in both) and ``correlation`` (null under two days).
    """
    samples = series.of_cluster(readers.load_table(spark, signal), readers.read_labels(spark, cluster))
    sinks.save_table(series.daily_activity(series.overall_activity(samples), hours_per_day), f"{out}/daily")
    daily = readers.load_table(spark, f"{out}/daily")
    sinks.save_table(series.compare_with_reference(daily, readers.read_reference(spark, reference, origin)), f"{out}/compared")
    both = readers.load_table(spark, f"{out}/compared")
    sinks.save_table(both.agg(F.corr("proposed", "reference").alias("correlation"), F.count(F.lit(1)).alias("days")), f"{out}/correlation")


def degree_distribution(
    spark: SparkSession, edges: str, out: str, bins: int = distributions.DEGREE_BINS, tail: float = 0.0
) -> None:
    """Degrees of a src,dst,weight file: tables ``degrees``, ``histogram`` (counts divided by the largest) and ``exponent``.

    The exponent is the slope over the histogram's bins whose lower edge is at least ``tail``, and the estimate from the degrees.
    """
    sinks.save_table(degrees(readers.read_weighted_edges(spark, edges)), f"{out}/degrees")
    counted = readers.load_table(spark, f"{out}/degrees")
    sinks.save_table(distributions.log_histogram(counted, "degree", bins, scale=True), f"{out}/histogram")
    points = readers.load_table(spark, f"{out}/histogram")
    slope = distributions.powerlaw_slope(points, "lower", "count", tail)
    # one row each
    estimate = distributions.powerlaw_alpha(counted.select(F.col("degree").alias("x"), F.lit(1.0).alias("y"))).select("alpha")
    sinks.save_table(slope.select("*", estimate.scalar().alias("alpha")), f"{out}/exponent")


def _pattern(
    spark: SparkSession, weights: str, signal: str, length: int, min_weight: float, sigmas: float,
    threshold: float | None = None, cluster: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matrix, active cells, rows) from a src,dst,weight file and a signal table.

    Cells are active above ``threshold`` or, without one, above their row's mean + ``sigmas`` deviations; with a ``cluster`` the
    matrix holds the links inside it alone.
    """
    samples = readers.load_table(spark, signal)
    matrix = cut_lineage(memory.memory_matrix(readers.read_weighted_edges(spark, weights), min_weight, cluster))
    active = memory.binarise_sigma(samples, length, sigmas) if threshold is None else memory.binarise(samples, threshold)
    return matrix, cut_lineage(active), samples.select("id").distinct()


def recall(
    spark: SparkSession, weights: str, signal: str, out: str, length: int = TOTAL_HOURS, window: int = 721,
    min_weight: float = 0.0, sigmas: float = 2.0, steps: int = 1, tie: int = 1, noise: float = 0.0, seed: int = 0,
    threshold: float | None = None, cluster: str | None = None,
) -> None:
    """Recall the pattern, degraded by ``noise``, and leave tables ``curves`` and ``errors``."""
    ids = None if cluster is None else cut_lineage(readers.read_labels(spark, cluster).select("id"))
    matrix, cells, rows = _pattern(spark, weights, signal, length, min_weight, sigmas, threshold, ids)
    start = memory.degrade(cells, rows, length, noise, seed) if noise else cells
    found = cut_lineage(memory.recall(matrix, start, steps, tie))
    sinks.save_table(recall_difference(cells, found, length, window), f"{out}/curves")
    sinks.save_table(memory.error_rates(cells, found, rows, matrix, length), f"{out}/errors")


def mute(
    spark: SparkSession, weights: str, signal: str, cluster: str, out: str, length: int = TOTAL_HOURS,
    min_weight: float = 0.0, sigmas: float = 2.0, event: tuple[int, int] | None = None, row_hits: bool = False,
    threshold: float | None = None, inside: bool = False,
) -> None:
    """Mute growing parts of a list of ids, recall, and leave the table ``errors``; ``inside`` keeps the list's own links alone."""
    ids = cut_lineage(readers.read_labels(spark, cluster).select("id"))
    matrix, cells, _ = _pattern(spark, weights, signal, length, min_weight, sigmas, threshold, ids if inside else None)
    sinks.save_table(memory.mute_sweep(matrix, cells, ids, length, event=event, row_hits=row_hits), f"{out}/errors")
