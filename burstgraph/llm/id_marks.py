"""Tell rows whose id is surely not in a set from the others, in JVM expressions.

The ids become one hashed bitmap of fixed size (256 rows of 4 KB), which is broadcast; as it does not grow, more ids only let more
rows pass to the exact join behind it.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 23
BUCKET = 1 << 15  # bits in one row of bitmap_construct_agg


def _place(column: Column) -> Column:
    return F.pmod(F.xxhash64(column.cast("bigint")), F.lit(BITS))


def divide(rows: DataFrame, ids: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose ``column`` is surely not among the ``column`` of ``ids``, the other rows). A null is not among them."""
    marks = (
        ids.where(F.col(column).isNotNull())
        .select(_place(F.col(column)).alias("place"))
        .groupBy(F.expr(f"place div {BUCKET}").alias("bucket"))
        .agg(F.expr(f"bitmap_construct_agg(place % {BUCKET})").alias("bits"))
    )
    place = _place(F.col(f"r.{column}"))
    spot = place % BUCKET
    byte = F.conv(F.hex(F.substring("m.bits", (spot / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.expr("m.bits IS NOT NULL") & (F.getbit(byte, (spot % 8).cast("int")) == 1), F.lit(False))
    bucket = (place / BUCKET).cast("bigint")
    joined = rows.alias("r").join(F.broadcast(marks.alias("m")), bucket == F.col("m.bucket"), "left")
    return joined.where(~hit).select("r.*"), joined.where(hit).select("r.*")
