"""Connected components and hop distances as loops of joins over stored tables.

Components follow randomised contraction (Boegeholz, Brand, Todor: In-database
connected component analysis, 2020). Each round every vertex points to the
neighbour, or itself, with the smallest random priority; the edges are
re-pointed and de-duplicated. The edge table shrinks geometrically, so the
rounds are logarithmic in the vertices and the total work is linear in the edges.
"""

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from burstgraph.functions.hashing import mixed_sql
from burstgraph.operators.skew import (
    ROWS_PER_TASK,
    hot_from_counts,
    hot_keys,
    join_skewed,
    repeat_rows,
    salt_rows,
)
from burstgraph.session import Scratch, cut_lineage, scratch_path, store


def _ordered_pairs(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct unordered pairs of different ids."""
    return rows.where(f"{a} <> {b}").selectExpr(f"least({a}, {b}) AS a", f"greatest({a}, {b}) AS b").distinct()


def _representatives(pairs: DataFrame, seed: int) -> DataFrame:
    """(id, rep, n): each vertex's choice and its degree; minima combine before the shuffle."""
    ranked = f"struct({mixed_sql(['other'], seed)} AS priority, other AS id)"
    own = f"struct({mixed_sql(['id'], seed)} AS priority, id AS id)"
    return (
        pairs.selectExpr("inline(array(struct(a AS id, b AS other), struct(b AS id, a AS other)))")
        .groupBy("id")
        .agg(F.expr(f"min({ranked})").alias("best"), F.count(F.lit(1)).alias("n"))
        .selectExpr("id", f"least(best, {own}).id AS rep", "n")
    )


def component_labels(edges: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(id, component) of every vertex an edge touches; the label is the smallest id."""
    with Scratch(edges.sparkSession, "components") as scratch:
        pairs, size = scratch.keep(_ordered_pairs(edges, "src", "dst"))
        if size == 0:
            return edges.selectExpr("src AS id", "src AS component").where(F.lit(False))
        rounds: list[tuple[DataFrame, int]] = []  # each round's pairs, and a bound on their number
        while size > 0:
            rounds.append((pairs, size))
            reps, moved = _representatives(pairs, seed=len(rounds)), pairs
            for end in ("a", "b"):
                table = reps.selectExpr(f"id AS {end}", f"rep AS rep_{end}")
                hot = None  # no key can hold more rows than the table
                if size > rows_per_task:
                    hot = hot_from_counts(reps, "id", "n", rows_per_task).withColumnRenamed("id", end)
                moved = join_skewed(moved, table, end, hot=hot)
            pairs, size = scratch.keep(_ordered_pairs(moved, "rep_a", "rep_b"))

        # Walk back from the last, smallest round; vertices without a later choice are roots. A round's choices are a
        # function of its pairs, so they are made again rather than stored.
        last, size = rounds[-1]
        roots = _representatives(last, seed=len(rounds)).selectExpr("id", "rep AS root")
        for k in range(len(rounds) - 1, 0, -1):
            last, size = rounds[k - 1]
            reps, hot = _representatives(last, seed=k), None
            if 2 * size > rows_per_task:
                reps, _ = scratch.keep(reps)
                hot = hot_keys(reps, "rep", rows_per_task)
            later = roots.selectExpr("id AS rep", "root AS later")
            roots = join_skewed(reps, later, "rep", "left", hot=hot).selectExpr("id", "coalesce(later, rep) AS root")
        roots, _ = scratch.keep(roots)
        smallest = roots.groupBy("root").agg(F.min("id").alias("component"))
        hot = hot_keys(roots, "root", rows_per_task) if 2 * size > rows_per_task else None
        return store(join_skewed(roots, smallest, "root", hot=hot).select("id", "component"), "component-labels")


def connected_components(vertices: DataFrame, edges: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(id, component) of all vertices; one without edges is its own component."""
    labels = component_labels(edges, rows_per_task)
    return vertices.select("id").join(labels, "id", "left").select(
        "id", F.coalesce("component", "id").alias("component")
    )


def hop_distances(edges: DataFrame, sources: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(id, distance) along directed edges from the nearest source, breadth first.

    The edges are laid out once by (src, salt). What was visited is a table in the shared folder, bucketed by id with one
    partition per distance: a round joins the frontier to the edges, drops what the table holds bucket by bucket, and appends
    the rest. Only the frontier is ever exchanged.
    """
    spark = edges.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "hops")
    table = "hops_" + path.rsplit("-", 1)[1]

    def append(rows: DataFrame, step: int) -> int:
        seen = Observation()
        counted = rows.select("id", F.lit(step).alias("distance")).observe(seen, F.count(F.lit(1)).alias("rows"))
        writer = counted.write.partitionBy("distance").bucketBy(buckets, "id").option("path", path)
        writer.mode("append").saveAsTable(table)
        return seen.get["rows"]

    with Scratch(spark, "hop-links") as scratch:
        links, _ = scratch.keep(edges.select("src", "dst").distinct())
        hot = hot_keys(links, "src", rows_per_task)
        key = ["src"] if hot is None else ["src", "_salt"]
        laid_out = cut_lineage((links if hot is None else salt_rows(links, "src", hot)).repartition(buckets, *key))
    step = 0
    try:
        found = append(sources.select("id").distinct().repartition(buckets, "id"), step)
        while found:
            heads = spark.table(table).where(F.col("distance") == step).select(F.col("id").alias("src"))
            if hot is not None:
                heads = repeat_rows(heads, "src", hot)
            reached = laid_out.join(heads, key).select(F.col("dst").alias("id")).distinct()
            step += 1
            found = append(unvisited(reached, spark.table(table)), step)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")  # the files stay: they are the result
    return spark.read.schema("id BIGINT, distance INT").parquet(path)


def unvisited(reached: DataFrame, visited: DataFrame) -> DataFrame:
    """Ids of ``reached`` that the bucketed table ``visited`` does not hold; the table is read bucket by bucket."""
    return reached.select("id").join(visited.select("id").hint("merge"), "id", "left_anti")
