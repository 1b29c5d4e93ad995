"""Adapters: signal, vertex, edge and label tables from a star schema and an event table."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burstgraph.functions.timeaxis import hour_index, month_index
from burstgraph.operators.skew import join_skewed
from burstgraph.session import store

PART_HOURS = 84  # months of the part axis, 1995 to 2001
USER_HOURS = 720  # hours of the user axis, January 2024
SHIP_ORIGIN = "1995-01-01 00:00:00"
EVENT_ORIGIN = "2024-01-01 00:00:00"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id", "hour").agg(F.sum("value").alias("value")).where("value <> 0")


def part_signal(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly quantity per part."""
    return _summed(
        table(spark, folder, "lineitem").select(
            F.col("l_partkey").alias("id"),
            month_index(F.col("l_shipdate"), 1995).alias("hour"),
            F.col("l_quantity").alias("value"),
        )
    )


def part_hourly_signal(spark: SparkSession, folder: str) -> DataFrame:
    """Quantity per part on the hourly axis."""
    return _summed(
        table(spark, folder, "lineitem").select(
            F.col("l_partkey").alias("id"),
            hour_index(F.col("l_shipdate"), SHIP_ORIGIN).alias("hour"),
            F.col("l_quantity").alias("value"),
        )
    )


def part_vertices(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))


def part_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Brand of each part as its given community."""
    return table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("label"))


def part_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Each part of an order linked from the order's lowest and to its highest part.

    Two links per line item at most: linear in the lines even for a huge order.
    The jobs expect a stored edge table, so the links are computed once.
    """
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey")
    ends = lines.groupBy("l_orderkey").agg(F.min("l_partkey").alias("low"), F.max("l_partkey").alias("high"))
    links = F.array(
        F.struct(F.col("low").alias("src"), F.col("l_partkey").alias("dst")),
        F.struct(F.col("l_partkey").alias("src"), F.col("high").alias("dst")),
    )
    return store(
        join_skewed(lines, ends, "l_orderkey")
        .select(F.explode(links).alias("link"))
        .select("link.src", "link.dst")
        .where("src < dst")
        .distinct()
        .withColumn("weight", F.lit(0.0)),
        "part-edges",
    )


def user_signal(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly event value per user."""
    return _summed(
        table(spark, folder, "events").select(
            F.col("user_id").alias("id"),
            hour_index(F.col("ts"), EVENT_ORIGIN).alias("hour"),
            F.col("value"),
        )
    )


def monthly_orders(spark: SparkSession, folder: str) -> DataFrame:
    """(day, value): total order price per month, an external series to compare with."""
    return (
        table(spark, folder, "orders")
        .groupBy(month_index(F.col("o_orderdate"), 1995).alias("day"))
        .agg(F.sum("o_totalprice").alias("value"))
    )
