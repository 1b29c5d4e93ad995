"""Joins that stay balanced when one key holds a large share of the rows.

A key is *hot* when it holds more than ``ROWS_PER_TASK`` rows. Its rows are
spread over one salt per ``ROWS_PER_TASK`` of them, and the other side, which
has few rows per key, is repeated once per salt. The rule does not depend on
the size of the table. The hot list can hold one key per ``ROWS_PER_TASK`` rows, so
it is joined like any other table: adaptive execution broadcasts it while it is small.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burstgraph.session import cut_lineage_counted

ROWS_PER_TASK = 2_000_000  # rows of one key that a task takes

DETECT = object()


def hot_keys(df: DataFrame, key: str, limit: int | None = None) -> DataFrame | None:
    """(key, _splits) of the hot keys as a stored table, or None when there is none.

    ``df`` should be stored or checkpointed: it is read again here. Counts combine before the shuffle.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    hot, found = cut_lineage_counted(hot_from_counts(counts, key, "_n", limit))
    return hot if found else None


def hot_ends(edges: DataFrame, limit: int | None = None) -> dict[str, DataFrame | None]:
    """The hot keys of both ends of ``edges``, from one pass over them."""
    ends = edges.selectExpr("inline(array(struct('src' AS _end, src AS _key), struct('dst' AS _end, dst AS _key)))")
    counts = ends.groupBy("_end", "_key").agg(F.count(F.lit(1)).alias("_n"))
    hot, found = cut_lineage_counted(hot_from_counts(counts, "_key", "_n", limit, "_end"))
    if not found:
        return {"src": None, "dst": None}
    return {end: hot.where(F.col("_end") == end).select(F.col("_key").alias(end), "_splits") for end in ("src", "dst")}


def hot_from_counts(counts: DataFrame, key: str, n: str, limit: int | None = None, *more: str) -> DataFrame:
    """The same from known row counts, without another pass over the rows."""
    limit = ROWS_PER_TASK if limit is None else limit
    return counts.where(F.col(n) > limit).select(*more, key, F.ceil(F.col(n) / limit).cast("int").alias("_splits"))


def salt_rows(df: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Give every row its salt: 0, or one of the salts of its hot key."""
    spread = [
        F.col(f.name) for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.ArrayType))
    ]
    salt = F.pmod(F.xxhash64(*spread), F.col("_splits")).cast("int")
    return (
        df.join(hot, key, "left")
        .withColumn("_salt", F.coalesce(salt, F.lit(0)))
        .drop("_splits")
    )


def repeat_rows(df: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Repeat every row once per salt of its key."""
    salts = F.sequence(F.lit(0), F.coalesce(F.col("_splits"), F.lit(1)) - 1)
    return (
        df.join(hot, key, "left").withColumn("_salt", F.explode(salts)).drop("_splits")
    )


def join_skewed(rows: DataFrame, lookup: DataFrame, key: str, how: str = "inner", hot=DETECT) -> DataFrame:
    """Join ``rows`` to ``lookup`` (few rows per key) with the hot keys of ``rows`` split.

    ``how`` is inner, left, left_semi or left_anti: forms in which a row of the
    left side meets every match for its key whatever its salt. ``hot`` takes a
    list from ``hot_keys`` when it is already known; None means a plain join.
    """
    if hot is DETECT:
        hot = hot_keys(rows, key)
    if hot is None:
        return rows.join(lookup, key, how)
    salted = salt_rows(rows, key, hot)
    return salted.join(repeat_rows(lookup, key, hot), [key, "_salt"], how).drop("_salt")


def with_both_ends(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges whose two ends are among ``vertices``."""
    ids, hot = vertices.select("id"), hot_ends(edges)
    kept = join_skewed(edges, ids.withColumnRenamed("id", "src"), "src", "left_semi", hot=hot["src"])
    kept = join_skewed(kept, ids.withColumnRenamed("id", "dst"), "dst", "left_semi", hot=hot["dst"])
    return kept.select(edges.columns)
