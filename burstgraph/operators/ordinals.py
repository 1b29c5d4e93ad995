"""Consecutive numbers 0..n-1 in id order without a global sort in one task."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from burstgraph.session import cut_lineage

ROW_BITS = 33  # fixed value: bits Spark's monotonic id leaves to the row number


def ordinal_ids(ids: DataFrame, key: str = "id", name: str = "ordinal") -> DataFrame:
    """Number the rows by range partition: rows before the partition + row inside it.

    The sorted ids are materialised once, so both passes see the same partition
    bounds. The window below runs over one row per partition, never over the data.
    """
    number = F.monotonically_increasing_id()
    numbered = cut_lineage(
        ids.repartitionByRange(F.col(key))
        .sortWithinPartitions(key)
        .withColumn("_part", F.shiftright(number, ROW_BITS))
        .withColumn("_row", number.bitwiseAND(F.lit((1 << ROW_BITS) - 1)))
    )
    sizes = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    return numbered.join(F.broadcast(offsets), "_part").select(
        *ids.columns, (F.col("_before") + F.col("_row")).alias(name)
    )


def drop_positions(entities: DataFrame, positions: DataFrame) -> DataFrame:
    """Remove the entities at the given positions of the id order."""
    return ordinal_ids(entities, name="position").join(positions, "position", "left_anti").select(entities.columns)
