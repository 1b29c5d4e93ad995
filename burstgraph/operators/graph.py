"""PropertyGraph: a vertex table and an edge table, and the operators on the pair."""

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burstgraph.operators.components import connected_components
from burstgraph.operators.skew import hot_ends, join_skewed, with_both_ends
from burstgraph.session import cut_lineage, store


def prune_edges(edges: DataFrame, min_weight: float) -> DataFrame:
    """Edges heavier than ``min_weight``."""
    return edges.where(F.col("weight").cast("double") > min_weight)


def endpoint_ids(edges: DataFrame) -> DataFrame:
    """Distinct ids that occur at either end, from one pass over the edges."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def symmetrise(edges: DataFrame) -> DataFrame:
    """Edge table of W + W transposed, without its zeros."""
    arms = F.array(
        F.struct(F.col("src").alias("src"), F.col("dst").alias("dst")),
        F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")),
    )
    return (
        edges.select(F.explode(arms).alias("arm"), "weight")
        .groupBy("arm.src", "arm.dst")
        .agg(F.sum("weight").alias("weight"))
        .where("weight <> 0")
    )


def component_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def degrees(edges: DataFrame) -> DataFrame:
    """Incident edges and their total weight per vertex."""
    return (
        edges.select(F.explode(F.array("src", "dst")).alias("id"), "weight")
        .groupBy("id")
        .agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("weighted_degree"))
    )


@dataclass(frozen=True)
class PropertyGraph:
    """``vertices`` has an ``id`` and any attributes; ``edges`` has src, dst, weight."""

    vertices: DataFrame
    edges: DataFrame

    def prune(self, min_weight: float) -> "PropertyGraph":
        return replace(self, edges=prune_edges(self.edges, min_weight))

    def remove_singletons(self) -> "PropertyGraph":
        return replace(self, vertices=self.vertices.join(endpoint_ids(self.edges), "id", "left_semi"))

    def connected_components(self) -> DataFrame:
        return connected_components(self.vertices, self.edges)

    def induced_subgraph(self, ids: DataFrame) -> "PropertyGraph":
        """Vertices on the list and the edges with both ends on it."""
        return PropertyGraph(
            self.vertices.join(ids.select("id"), "id", "left_semi"), with_both_ends(self.edges, ids)
        )

    def nth_component(self, n: int = 0) -> "PropertyGraph":
        """The n-th largest component, ties by smallest label; empty if there is none.

        An edge never leaves its component, so testing one end is enough.
        """
        components = store(self.connected_components())
        ids = cut_lineage(nth_component_ids(components, n))
        sources = ids.select(F.col("id").alias("src"))
        return PropertyGraph(
            self.vertices.join(ids.select("id"), "id", "left_semi"),
            join_skewed(self.edges, sources, "src", "left_semi").select(self.edges.columns),
        )

    def map_vertices(self, **columns: Column) -> "PropertyGraph":
        """Replace the vertex attributes by the given expressions."""
        return replace(
            self, vertices=self.vertices.select("id", *[c.alias(name) for name, c in columns.items()])
        )

    def map_edges(self, weight: Column) -> "PropertyGraph":
        """Replace the edge weight by an expression over the edge."""
        return replace(self, edges=self.edges.withColumn("weight", weight))

    def triplets(self) -> DataFrame:
        """Edges with the attributes of both ends as ``src_<name>`` and ``dst_<name>``."""
        joined = self.edges
        hot = hot_ends(self.edges)
        for end in ("src", "dst"):
            named = self.vertices.select(
                F.col("id").alias(end),
                *[F.col(c).alias(f"{end}_{c}") for c in self.vertices.columns if c != "id"],
            )
            joined = join_skewed(joined, named, end, hot=hot[end])
        return joined

    def coarsen(self, predicate: Column, **reduced: Column) -> "PropertyGraph":
        """Merge the vertices connected by edges that satisfy ``predicate``.

        ``predicate`` is an expression over the triplet, ``reduced`` are aggregates
        over the merged vertices' attributes; aggregates combine before the shuffle,
        so a component may hold any share of the vertices. The other edges are
        re-pointed with their weight; loops and parallel edges stay.
        """
        columns = self.edges.columns
        decided = store(
            self.triplets().select(*columns, F.coalesce(predicate, F.lit(False)).alias("_merge"))
        )
        components = store(connected_components(self.vertices, decided.where("_merge")))
        merged = (
            self.vertices.join(components, "id")
            .groupBy(F.col("component").alias("id"))
            .agg(*[c.alias(name) for name, c in reduced.items()])
        )
        rest = decided.where(~F.col("_merge")).drop("_merge")
        hot = hot_ends(decided)
        for end in ("src", "dst"):
            label = components.select(F.col("id").alias(end), F.col("component").alias(f"_{end}"))
            rest = join_skewed(rest, label, end, hot=hot[end])
        moved = rest.select(
            F.col("_src").alias("src"), F.col("_dst").alias("dst"), *[c for c in columns if c not in ("src", "dst")]
        )
        return PropertyGraph(merged, moved)

    def symmetrise(self) -> "PropertyGraph":
        return replace(self, edges=symmetrise(self.edges))

    def degrees(self) -> DataFrame:
        return degrees(self.edges)


def nth_component_ids(components: DataFrame, n: int = 0) -> DataFrame:
    """(id, component) of the n-th largest component."""
    chosen = (
        component_sizes(components).orderBy(F.desc("size"), "component").offset(n).limit(1).select("component")
    )
    return components.join(F.broadcast(chosen), "component").select("id", "component")


def labelled(vertices: DataFrame, titles: DataFrame) -> DataFrame:
    """Vertices with the title of their id, null where it is unknown, the first in order where it has several."""
    named = titles.groupBy("id").agg(F.min("title").alias("title"))
    return vertices.select("id").join(named, "id", "left")


def stage_counts(stages: dict[str, "PropertyGraph"]) -> DataFrame:
    """(stage, vertices, edges, positive_edges) of each named graph."""
    parts = []
    for name, graph in stages.items():
        parts.append(
            graph.vertices.agg(F.count(F.lit(1)).alias("n")).select(
                F.lit(name).alias("stage"), "n", F.lit(0).cast("long").alias("e"), F.lit(0).cast("long").alias("p")
            )
        )
        parts.append(
            graph.edges.agg(F.count(F.lit(1)).alias("e"), F.count_if(F.col("weight") > 0).alias("p")).select(
                F.lit(name).alias("stage"), F.lit(0).cast("long").alias("n"), "e", "p"
            )
        )
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.union(part)
    return rows.groupBy("stage").agg(
        F.sum("n").alias("vertices"), F.sum("e").alias("edges"), F.sum("p").alias("positive_edges")
    )
