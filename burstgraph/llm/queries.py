"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burstgraph.llm.conversation_repair import damaged, repair_reports
from burstgraph.llm.decontamination import benchmark_matches
from burstgraph.llm.embedding_dedup import embedding_dedup
from burstgraph.llm.jaccard_join import jaccard_components
from burstgraph.llm.language_id import language_id
from burstgraph.llm.lm_scoring import lm_scores
from burstgraph.llm.quality_classifier import quality_scores
from burstgraph.llm.sentencepiece_codec import encode_documents
from burstgraph.llm.suffix_dedup import suffix_dedup
from burstgraph.llm.token_alignment import token_alignment
from burstgraph.llm.token_counts import edited_counts
from burstgraph.llm.url_filter import url_verdicts
from burstgraph.llm.window_dedup import cut_windows


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_verdicts(_table(spark, folder, "pages"))


def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup(_table(spark, folder, "documents")).drop("node", "kept")


def op3_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scores(_table(spark, folder, "documents"))


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return benchmark_matches(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op5_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    encoded = encode_documents(_table(spark, folder, "documents"))
    return encoded.select("doc_id", "n_pieces", "piece_ids", F.xxhash64("piece_ids").alias("ids_hash"), "round_trip")


def op6_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality_scores(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op7_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(_table(spark, folder, "documents"))


def op8_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup(_table(spark, folder, "embeddings"))


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return edited_counts(_table(spark, folder, "documents")).drop("edited")


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id(_table(spark, folder, "documents"))


def op11_window_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = cut_windows(_table(spark, folder, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"), F.size("spans").alias("n_spans"))


def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return token_alignment(_table(spark, folder, "documents"))


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "conversations")
    return repair_reports(damaged(rows), rows)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_decontamination": op4_decontamination,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_language_id": op10_language_id,
    "op11_window_dedup": op11_window_dedup,
    "op12_token_alignment": op12_token_alignment,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLES: dict[str, str] = {}
