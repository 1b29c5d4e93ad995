"""Control experiment: real series on random power-law edges."""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstgraph.functions.hashing import P2, absorb_sql, finish_sql, mixed_sql, start_sql

# Quadrant probabilities of the recursive matrix generator.
QUADRANTS = {"a": 0.45, "b": 0.15, "c": 0.15, "d": 0.25}
# A generator ends a generated method, which else grows too large for the JVM to compile, and keeps later filters from being written
# out in terms of all levels.
LEVELS_PER_METHOD = 1


def levels_for(vertices: int) -> int:
    """Bits of an id range twice as large as the vertex count."""
    return max(1, math.ceil(math.log2(max(2, 2 * vertices))))


def null_model_edges(links: DataFrame, vertices: int, seed: int, draws: int | None = None) -> DataFrame:
    """One random draw per distinct row of ``links``, or ``draws`` numbered draws, kept where both ends exist.

    Each draw walks the levels of a recursive matrix over twice as many ids as
    there are vertices; the choice per level is a hash of the row's own
    (src, dst) and the level, so the result does not depend on partitioning. Every level is a projection of plain
    arithmetic, which the generated code runs one after the other. Loops go, ids are
    shifted down by half the range and ids that are no ordinal 0..n-1 go.
    Repeated draws are merged.
    """
    levels = levels_for(vertices)
    half = 2 ** (levels - 1)
    a, b, c = QUADRANTS["a"], QUADRANTS["b"], QUADRANTS["c"]
    if draws is None:
        numbered = links.select("src", "dst").distinct()
    else:
        numbered = links.sparkSession.range(draws).selectExpr("id AS src", "-1L AS dst")
    # the part of the hash that all levels share
    walked = numbered.selectExpr(f"{absorb_sql(start_sql(seed), mixed_sql(['src', 'dst'], seed))} AS state", "0L AS s", "0L AS t")
    for level in range(1, levels + 1):
        bit = 1 << (levels - level)
        u = f"CAST({finish_sql(absorb_sql('state', str(level)))} AS DOUBLE) / {float(P2)!r}D"
        walked = walked.selectExpr("state", "s", "t", f"{u} AS u").selectExpr(
            "state",
            f"s + if(u >= {a + b}D, {bit}L, 0L) AS s",
            f"t + if((u >= {a}D AND u < {a + b}D) OR u >= {a + b + c}D, {bit}L, 0L) AS t",
        )
        if level % LEVELS_PER_METHOD == 0:
            walked = walked.selectExpr("inline(array(struct(state, s, t)))")
    return (
        walked.selectExpr(f"inline(array(struct(s - {half}L AS src, t - {half}L AS dst)))")
        .where(f"src <> dst AND src >= 0 AND src < {vertices} AND dst >= 0 AND dst < {vertices}")
        .distinct()
        .withColumn("weight", F.lit(0.0))
    )
