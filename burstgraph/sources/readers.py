"""Readers for the file layouts of signals, graphs and label lists. Schemas are explicit throughout."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burstgraph import schema
from burstgraph.functions.titles import all_digits, stored_title
from burstgraph.operators.series import dedupe
from burstgraph.operators.skew import with_both_ends


def read_signal_long(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header: row number, id, value, hour."""
    return dedupe(spark.read.schema(schema.SIGNAL_LONG_FILE).csv(path, header=True).drop("_c0"))


def read_signal_wide(spark: SparkSession, path: str, hour_base: int = 1) -> DataFrame:
    """CSV with header: id, then one value per hour; the first value column is hour ``hour_base``.

    A line is split into one array, so the plan does not grow with the hours. Lines whose first field is no whole number, the
    header above all, are dropped; so are fields that are no number.
    """
    fields = F.split(F.translate("value", '"\r', ""), ",")
    cells = spark.read.text(path).select(fields.alias("fields")).select(
        F.expr("try_cast(trim(fields[0]) AS BIGINT)").alias("id"), F.posexplode("fields").alias("pos", "text")
    )
    return (
        cells.where("id IS NOT NULL AND pos > 0 AND text NOT IN ('0', '0.0')")
        .selectExpr("id", f"pos + {hour_base - 1} AS hour", "try_cast(trim(text) AS DOUBLE) AS value")
        .where("value <> 0")
    )


def read_vertices(spark: SparkSession, path: str) -> DataFrame:
    """CSV without header: id, title. Rows without a numeric id or a title are dropped."""
    rows = spark.read.schema(schema.VERTEX_FILE).csv(path)
    return clean_vertices(rows)


def clean_vertices(rows: DataFrame) -> DataFrame:
    """Numeric ids, titles present and in their stored form."""
    return rows.where(all_digits(F.col("id")) & F.col("title").isNotNull()).select(
        F.col("id").cast("long").alias("id"), stored_title(F.col("title")).alias("title")
    )


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Space-separated, no header: src, dst. The weight starts at 0."""
    return (
        spark.read.schema(schema.EDGE_FILE)
        .csv(path, sep=" ")
        .select(F.col("src").cast("long"), F.col("dst").cast("long"), F.lit(0.0).alias("weight"))
    )


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """CSV without header: id and, optionally, a label."""
    return spark.read.schema(schema.LABEL).csv(path)


def read_reference(spark: SparkSession, path: str, origin: str) -> DataFrame:
    """CSV with header: date, value. Days are counted from the date ``origin``; rows without a date or a value go."""
    rows = spark.read.schema("date STRING, value DOUBLE").csv(path, header=True)
    day = F.date_diff(F.expr("try_cast(date AS DATE)"), F.to_date(F.lit(origin)))
    return rows.select(day.alias("day"), "value").where("day IS NOT NULL AND value IS NOT NULL")


def read_weighted_edges(spark: SparkSession, path: str) -> DataFrame:
    """CSV without header: src, dst, weight."""
    return spark.read.schema(schema.EDGE).csv(path)


def read_pagecounts(spark: SparkSession, path: str, lang: str = "en", min_count: int = 100) -> DataFrame:
    """Space-separated ``lang name count size`` (gz or plain): one language, counts above the minimum."""
    rows = spark.read.schema(schema.PAGECOUNT_FILE).csv(path, sep=" ", quote="")
    return rows.where((F.col("lang") == lang) & (F.col("count") > min_count))


def read_signal_text(spark: SparkSession, path: str, layout: str = "lines") -> DataFrame:
    """Dense dump ``(id,[v0,v1,...])``: one record per line, or all records run together.

    The run-together layout is split by the reader at the closing bracket, so it
    streams as records and never as one line.
    """
    separators = {"lines": "\n", "concatenated": "])"}
    lines = spark.read.option("lineSep", separators[layout]).text(path)
    parsed = lines.select(
        F.regexp_extract("value", r"\(\s*(-?\d+)\s*,\s*\[", 1).alias("id"),
        F.regexp_extract("value", r"\[([^\]]*)", 1).alias("body"),
    ).where("id <> ''")
    return (
        parsed.where("trim(body) <> ''")
        .select(F.col("id").cast("long").alias("id"), F.posexplode(F.split("body", ",")).alias("hour", "value"))
        .withColumn("value", F.trim("value"))
        .select("id", "hour", F.col("value").cast("double").alias("value"))
        .where("value <> 0")
    )


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """A table saved by ``save_table``."""
    return spark.read.parquet(path)


def join_series(vertices: DataFrame, signal: DataFrame) -> DataFrame:
    """Vertices that have a series."""
    return vertices.join(signal.select("id").distinct(), "id", "left_semi")


def ingest(vertices: DataFrame, edges: DataFrame, signal: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices with a series and the edges between them."""
    kept = join_series(vertices, signal)
    return kept, with_both_ends(edges, kept)
