"""Keep the rows whose id is probably in a set, before they are shuffled to a join that decides exactly.

The filter is one hashed bitmap of fixed size, so what is broadcast does not grow. When the ids outgrow it, it only lets more
rows pass.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 23
_BUCKET = 1 << 15  # bits in one row of bitmap_construct_agg


def free_name(columns: list[str], name: str) -> str:
    """``name``, or a longer one, that is none of ``columns`` (compared as Spark does, without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def split_rows(rows: DataFrame, ids: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose ``column`` is surely not in ``ids``, rows where it may be: all that are and few others).

    A null is never in ``ids``, yet may be among the latter.
    """
    mark = free_name(rows.columns, "_place")
    place = F.expr(f"pmod(xxhash64(CAST(`{column}` AS BIGINT)), {BITS}L)")
    marked = (
        ids.where(F.col(column).isNotNull())
        .select(place.alias("place"))
        .groupBy(F.expr(f"place div {_BUCKET}").alias("bucket"))
        .agg(F.expr(f"bitmap_construct_agg(place % {_BUCKET})").alias("bits"))
    )
    bitmap = np.zeros(BITS // 8, dtype=np.uint8)
    for bucket, bits in marked.collect():  # BITS / _BUCKET rows at most
        bitmap[bucket * (_BUCKET // 8) :][: _BUCKET // 8] = np.frombuffer(bits, np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(bitmap)

    def side(wanted: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = shared.value
            for batch in batches:
                at = batch.column(batch.num_columns - 1).to_numpy()
                yield batch.filter(pa.array((held[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == wanted)).select(range(batch.num_columns - 1))

        return rows.withColumn(mark, place).mapInArrow(run, rows.schema)

    return side(0), side(1)


def probably_in(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows of ``rows`` whose ``column`` may occur in ``ids`` (all that do, and few others)."""
    return split_rows(rows, ids, column)[1]


def without(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` is not in ``ids``; only those that may be are shuffled. Nulls stay."""
    clear, open_rows = split_rows(rows, ids, column)
    dropped = free_name(rows.columns, "_dropped")
    named = ids.select(F.col(column).cast("bigint").alias(dropped)).distinct()
    return clear.union(open_rows.join(named, F.col(column).cast("bigint") == F.col(dropped), "left_anti"))
