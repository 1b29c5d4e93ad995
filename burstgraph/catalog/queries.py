"""One query per operator, each over the whole of the given tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burstgraph.functions import timeaxis, titles
from burstgraph.operators import distributions, graph, memory, nullmodel, ordinals, pairs, series, smoothing, weights
from burstgraph.operators.components import connected_components, hop_distances
from burstgraph.operators.graph import PropertyGraph
from burstgraph.plans import learning, recall
from burstgraph.session import cut_lineage, scratch_path, store
from burstgraph.sources import readers, sinks, tables

N = tables.PART_HOURS
RATE, MIN_COUNT, MIN_WEIGHT = 2.0, 3, 1.0
EVENT = (30, 50)
LEVEL = 150.0
PAIR_WEIGHT = 3.0

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def r6(name: str):
    """Six decimals; adding 0.0 turns a rounded -0.0 into 0.0."""
    return (F.round(F.col(name), 6) + F.lit(0.0)).alias(name)


# Shared inputs ---------------------------------------------------------------


def bursts(spark, folder):
    return series.burst_samples(tables.part_signal(spark, folder), N, RATE, MIN_COUNT, 0, N)


def learned_edges(spark, folder, min_weight=MIN_WEIGHT):
    """Pruned burst weights, computed once."""
    edges = tables.part_edges(spark, folder)
    return store(weights.hebb_weights(edges, bursts(spark, folder), 0, N, min_weight=min_weight))


def learned_graph(spark, folder, min_weight=MIN_WEIGHT):
    return PropertyGraph(tables.part_vertices(spark, folder), learned_edges(spark, folder, min_weight))


def all_weights(spark, folder):
    """Every link with its weight over the whole axis, zeros included."""
    return weights.hebb_weights(tables.part_edges(spark, folder), tables.part_signal(spark, folder), -1, N)


def memory_inputs(spark, folder):
    """(matrix, active cells, rows): learned weights and the bursts of all parts with a series."""
    signal = tables.part_signal(spark, folder)
    matrix = store(memory.memory_matrix(learned_edges(spark, folder)))
    cells = store(memory.binarise_sigma(signal, N, 2.0))
    return matrix, cells, signal.select("id").distinct()


def dirty_vertices(spark, folder):
    """Vertex rows as a raw dump holds them: some ids not numeric, some titles missing."""
    part = tables.table(spark, folder, "part")
    return part.select(
        F.when(F.col("p_brand") == "Brand#2", F.concat(F.lit("p"), F.col("p_partkey")))
        .otherwise(F.col("p_partkey").cast("string"))
        .alias("id"),
        F.when(F.col("p_type") != "SMALL", F.concat_ws("&", "p_name", "p_brand")).alias("title"),
    )


def clean_vertices(spark, folder):
    path = scratch_path(spark, "vertices")
    dirty_vertices(spark, folder).write.csv(path)
    vertices = readers.read_vertices(spark, path)
    return readers.join_series(vertices, tables.part_signal(spark, folder))


# Sources and sinks -----------------------------------------------------------


@query
def signal_long(spark, folder):
    path = scratch_path(spark, "signal-long")
    tables.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("_c0"),
        F.col("l_partkey").alias("id"),
        F.col("l_quantity").alias("value"),
        timeaxis.month_index(F.col("l_shipdate"), 1995).alias("hour"),
    ).write.csv(path, header=True)
    return readers.read_signal_long(spark, path)


@query
def signal_wide(spark, folder):
    path = scratch_path(spark, "signal-wide")
    dense = series.densify(tables.part_signal(spark, folder), N)
    dense.select("id", *[F.col("values")[i].alias(f"h{i + 1}") for i in range(N)]).write.csv(path, header=True)
    return readers.read_signal_wide(spark, path, hour_base=1)


@query
def vertices(spark, folder):
    return clean_vertices(spark, folder)


@query
def edges_base(spark, folder):
    path = scratch_path(spark, "edges")
    tables.part_edges(spark, folder).select("src", "dst").write.csv(path, sep=" ")
    edges = readers.read_edges(spark, path)
    return readers.ingest(clean_vertices(spark, folder), edges, tables.part_signal(spark, folder))[1]


@query
def labels(spark, folder):
    path = scratch_path(spark, "labels")
    tables.part_labels(spark, folder).write.csv(path)
    return readers.read_labels(spark, path)


@query
def edges_weighted(spark, folder):
    path = scratch_path(spark, "edges-weighted")
    sinks.write_edges_csv(all_weights(spark, folder), path)
    return readers.read_weighted_edges(spark, path).select("src", "dst", r6("weight"))


@query
def saved_roundtrip(spark, folder):
    path = scratch_path(spark, "signal")
    sinks.save_table(tables.part_signal(spark, folder), path, sort_by="hour")
    return readers.load_table(spark, path)


@query
def signal_text_roundtrip(spark, folder):
    signal = tables.part_signal(spark, folder)
    both = []
    for layout in ("lines", "concatenated"):
        path = scratch_path(spark, f"signal-text-{layout}")
        sinks.write_signal_text(signal, path, N, layout)
        both.append(readers.read_signal_text(spark, path, layout).withColumn("layout", F.lit(layout)))
    return both[0].union(both[1])


@query
def pagecounts_filter(spark, folder):
    path = scratch_path(spark, "pagecounts")
    tables.table(spark, folder, "documents").select(
        "lang", F.concat(F.lit("page_"), F.col("doc_id")), "n_chars", F.col("n_chars") * 2
    ).write.csv(path, sep=" ", compression="gzip")
    return readers.read_pagecounts(spark, path)


@query
def gexf_lines(spark, folder):
    result = learning_result(spark, folder).graph
    lines = sinks.gexf_lines(result.map_edges(F.round("weight", 6)))
    return lines.select("section", "line")


@query
def gexf_file(spark, folder):
    """The unweighted document written out and read back."""
    path = scratch_path(spark, "gexf")
    vertices = tables.part_labels(spark, folder).withColumnRenamed("label", "title")
    edges = tables.part_edges(spark, folder)
    sinks.write_gexf(PropertyGraph(vertices, edges), path, weighted=False)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query
def cluster_signals(spark, folder):
    path, output = scratch_path(spark, "cluster"), scratch_path(spark, "cluster-signals")
    tables.part_labels(spark, folder).where("label = 'Brand#7'").write.csv(path)
    cluster = readers.read_labels(spark, path)
    sinks.write_cluster_signals(tables.part_signal(spark, folder), cluster, output, N)
    return spark.read.text(output)


@query
def edges_export(spark, folder):
    edges, named = scratch_path(spark, "edges-full"), scratch_path(spark, "id-title")
    graph_ = learned_graph(spark, folder)
    sinks.write_edges_csv(graph_.edges, edges)
    sinks.write_titles_csv(graph_.vertices, named)
    names = readers.read_labels(spark, named)
    return (
        readers.read_weighted_edges(spark, edges)
        .join(names.withColumnRenamed("id", "src"), "src")
        .select("src", "dst", F.col("label").alias("src_title"), r6("weight"))
    )


@query
def weights_export(spark, folder):
    path = scratch_path(spark, "weights")
    sinks.write_weights(all_weights(spark, folder), path)
    return spark.read.schema("weight DOUBLE").csv(path).select(r6("weight"))


@query
def series_arrays(spark, folder):
    path = scratch_path(spark, "arrays")
    sinks.write_series_arrays(tables.part_signal(spark, folder), path, N)
    text = F.concat_ws(",", F.transform("values", lambda v: v.cast("bigint").cast("string")))
    return readers.load_table(spark, path).orderBy("id").select(
        "id", F.size("values").alias("length"), text.alias("series")
    )


# Projections and filters -----------------------------------------------------


@query
def title_clean(spark, folder):
    text = F.col("text")
    return tables.table(spark, folder, "documents").select(
        "doc_id",
        F.md5(titles.stored_title(text)).alias("stored"),
        F.md5(titles.exported_title(text)).alias("exported"),
        F.md5(titles.printable_title(text)).alias("printable"),
        F.md5(titles.display_title(text)).alias("display"),
    )


@query
def window_slice(spark, folder):
    return series.slice_window(tables.part_signal(spark, folder), 20, 60)


@query
def active_in_window(spark, folder):
    return series.active_in(tables.part_signal(spark, folder), 20, 22)


@query
def peak_above(spark, folder):
    return series.peak_above(tables.part_signal(spark, folder), 100.0, 0, N)


@query
def activity_band(spark, folder):
    return series.activity_band(tables.part_signal(spark, folder), 20, 28)


@query
def prune_edges(spark, folder):
    return graph.prune_edges(all_weights(spark, folder), 3.0).select("src", "dst", r6("weight"))


@query
def select_by_title(spark, folder):
    part = tables.table(spark, folder, "part")
    named = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"))
    wanted = part.where("p_brand = 'Brand#1'").select(F.col("p_name").alias("label"))
    return series.select_by_title(named, wanted)


@query
def titles_present(spark, folder):
    """Names of one brand's parts that another brand's parts carry too."""
    part = tables.table(spark, folder, "part").withColumnRenamed("p_name", "label")
    return series.titles_present(part.where("p_brand = 'Brand#2'"), part.where("p_brand = 'Brand#1'"))


@query
def drop_positions(spark, folder):
    entities = tables.table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), "c_name")
    months = tables.monthly_orders(spark, folder).select(F.col("day").cast("long").alias("position"))
    return ordinals.drop_positions(entities, months)


@query
def memory_matrix(spark, folder):
    return memory.memory_matrix(learned_edges(spark, folder), 1.2).select("src", "dst", r6("weight"))


@query
def memory_matrix_cluster(spark, folder):
    """Structure only, both ends in one given community."""
    cluster = tables.part_labels(spark, folder).where("label IN ('Brand#3', 'Brand#4', 'Brand#5')")
    return memory.memory_matrix(learned_edges(spark, folder), cluster=cluster, binary=True)


@query
def map_filter_window(spark, folder):
    packed = series.pack(tables.part_signal(spark, folder))
    inside = series.slice_packed(F.col("series"), 20, 60)
    return packed.select("id", F.explode(inside).alias("hour", "value"))


# Joins -----------------------------------------------------------------------


@query
def all_pairs(spark, folder):
    signal = tables.user_signal(spark, folder)
    found = pairs.similar_pairs(signal, -1, tables.USER_HOURS, PAIR_WEIGHT)
    return found.select("src", "dst", r6("weight"))


@query
def hebb_weights(spark, folder):
    return all_weights(spark, folder).select("src", "dst", r6("weight"))


@query
def hebb_weights_floor(spark, folder):
    """Raw values above a floor, another ratio limit and an inner window."""
    weighed = weights.hebb_weights(
        tables.part_edges(spark, folder), tables.part_signal(spark, folder), 10, 70,
        floor=20.0, normalise=False, lam=0.7,
    )
    return weighed.select("src", "dst", r6("weight"))


@query
def labelled_graph(spark, folder):
    result = learned_graph(spark, folder).remove_singletons()
    named = graph.labelled(result.vertices, tables.part_vertices(spark, folder))
    return PropertyGraph(named, result.edges).map_vertices(title=titles.exported_title(F.col("title"))).vertices


@query
def reference_compare(spark, folder):
    daily = series.daily_activity(series.overall_activity(tables.part_signal(spark, folder)), hours_per_day=1)
    both = series.compare_with_reference(daily, tables.monthly_orders(spark, folder))
    return both.select("day", r6("proposed"), r6("reference"))


@query
def reference_corr(spark, folder):
    daily = series.daily_activity(series.overall_activity(tables.part_signal(spark, folder)), hours_per_day=1)
    both = series.compare_with_reference(daily, tables.monthly_orders(spark, folder))
    return both.agg(F.round(F.corr("proposed", "reference"), 6).alias("correlation"))


@query
def ordinal_ids(spark, folder):
    return ordinals.ordinal_ids(tables.table(spark, folder, "customer").select(F.col("c_custkey").alias("id")))


# Aggregations ----------------------------------------------------------------


@query
def series_stats(spark, folder):
    stats = series.series_stats(tables.part_signal(spark, folder), N, RATE)
    return stats.select("id", r6("mean"), r6("sd"), r6("threshold"))


@query
def burst_vertices(spark, folder):
    return bursts(spark, folder)


@query
def component_sizes(spark, folder):
    result = learned_graph(spark, folder, 2.0).remove_singletons()
    return graph.component_sizes(result.connected_components())


@query
def overall_activity(spark, folder):
    return series.overall_activity(tables.user_signal(spark, folder)).select("hour", r6("value"))


@query
def daily_activity(spark, folder):
    activity = series.overall_activity(tables.user_signal(spark, folder))
    return series.daily_activity(activity).select("day", r6("value"))


@query
def degrees(spark, folder):
    return learned_graph(spark, folder).degrees().select("id", "degree", r6("weighted_degree"))


@query
def degree_histogram(spark, folder):
    table = distributions.log_histogram(graph.degrees(tables.part_edges(spark, folder)), "degree", scale=True)
    return table.select("bin", r6("lower"), r6("count"))


def degree_points(spark, folder):
    degree = learned_graph(spark, folder, 0.0).degrees()
    return degree.groupBy(F.col("degree").alias("x")).agg(F.count(F.lit(1)).alias("y"))


@query
def powerlaw_alpha(spark, folder):
    return distributions.powerlaw_alpha(degree_points(spark, folder)).select(r6("c"), r6("alpha"))


@query
def powerlaw_slope(spark, folder):
    return distributions.powerlaw_slope(degree_points(spark, folder)).select(r6("slope"), r6("intercept"))


@query
def community_sizes(spark, folder):
    table = distributions.community_sizes(tables.part_labels(spark, folder))
    return table.select("bin", r6("lower"), "count")


@query
def stage_counts(spark, folder):
    return graph.stage_counts(learning_result(spark, folder).stages)


# Time series -----------------------------------------------------------------


@query
def signed_similarity(spark, folder):
    weighed = weights.signed_weights(tables.part_edges(spark, folder), tables.part_signal(spark, folder))
    return weighed.select("src", "dst", r6("weight"))


@query
def chunked_pearson(spark, folder):
    weighed = weights.correlation_weights(
        tables.part_edges(spark, folder), tables.part_signal(spark, folder), -1, N
    )
    return weighed.select("src", "dst", r6("weight"))


@query
def smoothed_activity(spark, folder):
    activity = series.overall_activity(tables.part_signal(spark, folder))
    return smoothing.smooth(activity, N, window=5).select("hour", r6("value"))


@query
def smoothed_by_label(spark, folder):
    """One smoothed curve per community, all in one job."""
    labelled = tables.part_signal(spark, folder).join(tables.part_labels(spark, folder), "id")
    activity = labelled.groupBy("label", "hour").agg(F.sum("value").alias("value"))
    return smoothing.smooth(activity, N, window=25, keys=("label",)).select("label", "hour", r6("value"))


@query
def recall_difference(spark, folder):
    matrix, cells, _ = memory_inputs(spark, folder)
    restored = cut_lineage(memory.recall(matrix, cells))
    table = recall.recall_difference(cells, restored, N, window=5)
    return table.select("hour", r6("original"), r6("recalled"), r6("difference"))


@query
def hourly_expand(spark, folder):
    return timeaxis.hourly_expand(tables.monthly_orders(spark, folder)).select("hour", r6("value"))


@query
def named_windows(spark, folder):
    windowed = timeaxis.by_named_window(tables.part_hourly_signal(spark, folder))
    return windowed.groupBy("window").agg(
        F.count(F.lit(1)).alias("samples"), F.countDistinct("id").alias("ids"), F.round(F.sum("value"), 6).alias("value")
    )


@query
def calendar_marks(spark, folder):
    hours = tables.user_signal(spark, folder).select("hour").distinct()
    return timeaxis.calendar_marks(hours, tables.EVENT_ORIGIN)


# Graph -----------------------------------------------------------------------


@query
def remove_singletons(spark, folder):
    return learned_graph(spark, folder).remove_singletons().vertices


@query
def connected_components_all(spark, folder):
    """Components of all parts, unlinked ones included."""
    result = learned_graph(spark, folder)
    return connected_components(result.vertices, result.edges)


QUERIES["connected_components"] = QUERIES.pop("connected_components_all")


@query
def nth_component(spark, folder):
    """The second largest component of the strongly pruned graph: vertices and edges."""
    found = learned_graph(spark, folder, 2.0).remove_singletons().nth_component(1)
    return component_rows(found)


def component_rows(found: PropertyGraph) -> DataFrame:
    """Vertices and edges of a graph in one table."""
    nodes = found.vertices.select(
        F.lit("vertex").alias("kind"), F.col("id").alias("src"), F.col("id").alias("dst"),
        F.lit(0.0).alias("weight"), "title",
    )
    links = found.edges.select(F.lit("edge").alias("kind"), "src", "dst", r6("weight"), F.lit("").alias("title"))
    return nodes.union(links)


@query
def coarsen(spark, folder):
    merged = coarse_graph(spark, folder).vertices
    return merged.select("id", "title", "members")


@query
def coarsen_edges(spark, folder):
    return coarse_graph(spark, folder).edges.select("src", "dst", r6("weight"))


def coarse_graph(spark, folder):
    """Merge what a weight above 1.5 connects; the smallest title stands for the merged ones."""
    return learned_graph(spark, folder).coarsen(
        F.col("weight") > 1.5, title=F.min("title"), members=F.count(F.lit(1))
    )


def first_source(edges: DataFrame) -> DataFrame:
    return edges.agg(F.min("src").alias("id"))


@query
def hop_distances_all(spark, folder):
    edges = learned_edges(spark, folder, 0.5)
    return hop_distances(edges, first_source(edges))


QUERIES["hop_distances"] = QUERIES.pop("hop_distances_all")


@query
def hop_summary(spark, folder):
    edges = learned_edges(spark, folder, 0.5)
    reached = hop_distances(edges, first_source(edges)).where("distance > 0")
    return reached.agg(
        F.count(F.lit(1)).alias("reached"),
        F.round(F.avg("distance"), 6).alias("mean_distance"),
        F.max("distance").alias("max_distance"),
    )


@query
def null_model_edges(spark, folder):
    vertices = tables.part_vertices(spark, folder)
    drawn = nullmodel.null_model_edges(tables.part_edges(spark, folder), vertices.count(), seed=1)
    return drawn.select("src", "dst")


@query
def component_full_signals(spark, folder):
    base = PropertyGraph(tables.part_vertices(spark, folder), tables.part_edges(spark, folder))
    signal = tables.part_signal(spark, folder)
    found = learning_result(spark, folder).graph
    full, samples = learning.component_full_signals(base, signal, found)
    linked = full.degrees().select("id", F.col("degree").alias("base_degree"))
    return samples.join(linked, "id", "left")


# Associative memory ----------------------------------------------------------


@query
def binarise(spark, folder):
    return memory.binarise(tables.part_signal(spark, folder), 40.0)


@query
def binarise_sigma(spark, folder):
    return memory.binarise_sigma(tables.part_signal(spark, folder), N, 2.0)


@query
def degrade(spark, folder):
    signal = tables.part_signal(spark, folder)
    return memory.degrade(memory.binarise_sigma(signal, N, 2.0), signal.select("id").distinct(), N, noise=0.2, seed=7)


@query
def mute(spark, folder):
    cells = memory.binarise_sigma(tables.part_signal(spark, folder), N, 2.0)
    cluster = tables.part_labels(spark, folder).where("label IN ('Brand#3', 'Brand#4', 'Brand#5')")
    return memory.mute(cells, cluster, 1.5)


@query
def recall_step(spark, folder):
    matrix, cells, _ = memory_inputs(spark, folder)
    return memory.recall(matrix, cells)


@query
def recall_scores(spark, folder):
    matrix, cells, _ = memory_inputs(spark, folder)
    return memory.recall_scores(matrix, cells).withColumn("score", F.col("score").cast("double")).select("id", "hour", r6("score"))


@query
def recall_steps(spark, folder):
    """Three steps with ties going down."""
    matrix, cells, _ = memory_inputs(spark, folder)
    return memory.recall(matrix, cells, steps=3, tie=-1)


@query
def recall_random(spark, folder):
    """The control: recall from noise as dense as the pattern could be."""
    matrix = store(memory.memory_matrix(learned_edges(spark, folder)))
    rows = tables.part_signal(spark, folder).select("id").distinct()
    return memory.recall(matrix, memory.random_cells(rows, N, 0.5, seed=3))


@query
def recall_error(spark, folder):
    matrix, cells, rows = memory_inputs(spark, folder)
    rates = memory.error_rates(cells, memory.recall(matrix, cells), rows, matrix, N)
    return rates.select(r6("miss_rate"), r6("mismatch_rate"))


@query
def recall_error_event(spark, folder):
    """Inside the event, with every row that recalled any of it counted as a hit."""
    matrix, cells, rows = memory_inputs(spark, folder)
    found = memory.expand_hits(memory.recall(matrix, cells), *EVENT)
    rates = memory.error_rates(memory.in_event(cells, *EVENT), found, rows, matrix, EVENT[1] - EVENT[0])
    return rates.select(r6("miss_rate"), r6("mismatch_rate"))


@query
def mute_sweep(spark, folder):
    edges = learned_edges(spark, folder)
    matrix = store(memory.memory_matrix(edges))
    cells = store(memory.binarise_sigma(tables.part_signal(spark, folder), N, 2.0))
    cluster = store(graph.endpoint_ids(edges))
    rates = memory.mute_sweep(matrix, cells, cluster, N)
    return rates.select("percent", r6("miss_rate"), r6("mismatch_rate"))


@query
def mute_sweep_event(spark, folder):
    """The sweep inside the event, with every row that recalled any of it counted as a hit."""
    edges = learned_edges(spark, folder)
    matrix = store(memory.memory_matrix(edges))
    cells = store(memory.binarise_sigma(tables.part_signal(spark, folder), N, 2.0))
    cluster = store(graph.endpoint_ids(edges))
    rates = memory.mute_sweep(matrix, cells, cluster, N, event=EVENT, row_hits=True)
    return rates.select("percent", r6("miss_rate"), r6("mismatch_rate"))


# Jobs ------------------------------------------------------------------------


def learning_result(spark, folder, **options):
    options = {"rate": RATE, "min_count": MIN_COUNT, "min_weight": MIN_WEIGHT, **options}
    return learning.learn_peaks(
        tables.part_vertices(spark, folder), tables.part_edges(spark, folder), tables.part_signal(spark, folder),
        N, 0, N, **options,
    )


@query
def learn_peaks(spark, folder):
    return component_rows(learning_result(spark, folder).graph)


@query
def learn_static(spark, folder):
    found = learning.learn_static(
        tables.part_vertices(spark, folder), tables.part_edges(spark, folder), tables.part_signal(spark, folder),
        -1, N, min_weight=7.0,
    )
    return component_rows(found.graph)


@query
def learn_all_pairs(spark, folder):
    names = tables.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), titles.exported_title(F.col("c_name")).alias("title")
    )
    found = learning.learn_all_pairs(
        tables.user_signal(spark, folder), names, -1, tables.USER_HOURS, level=LEVEL, min_weight=PAIR_WEIGHT
    )
    return component_rows(found)


@query
def learn_null_model(spark, folder):
    found = learning.learn_null_model(
        tables.part_vertices(spark, folder), tables.part_edges(spark, folder), tables.part_signal(spark, folder),
        -1, N, min_weight=5.0,
    )
    return component_rows(found.graph)


@query
def recall_experiment(spark, folder):
    """Recall from the pattern with a third of one community muted."""
    matrix, cells, _ = memory_inputs(spark, folder)
    cluster = tables.part_labels(spark, folder).where("label IN ('Brand#3', 'Brand#4', 'Brand#5')")
    muted = cut_lineage(memory.mute(cells, cluster, 3.0))
    table = recall.recall_experiment(matrix, cells, N, window=7, degraded=muted)
    return table.select("hour", r6("original"), r6("recalled"), r6("difference"))
