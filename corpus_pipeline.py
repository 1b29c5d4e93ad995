"""The corpus pipeline: five stages from the documents table to encoded documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet in the shared folder and reads
again as the next stage's docs. All but the last return the columns of documents; a column of another name passes through.
Near duplicates are decided by row, that is by doc_id and text, so that of rows repeating an id only the copies go; a leak of the
benchmark takes all rows of its doc_id along. Rows with a null doc_id stay where a decision needs the id.
"""

from burstgraph.llm.common import park
from burstgraph.llm.decontamination import benchmark_matches
from burstgraph.llm.id_filter import free_name, split_rows, without
from burstgraph.llm.jaccard_join import components_by_text
from burstgraph.llm.language_id import told_apart
from burstgraph.llm.sentencepiece_codec import encode_documents
from burstgraph.llm.suffix_dedup import cut_documents
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONFIDENT = 0.5

# The learned and the aligned decisions have no SQL form; tests hold every stage against a plain version.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter whose language is told with a score of at least ``CONFIDENT``."""
    return told_apart(docs, CONFIDENT)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near duplicates; of equal rows of one id and text, one."""
    judged = park(components_by_text(docs), "pipeline-groups")
    copies = judged.where("doc_id <> component_id").select("doc_id", "text_key").distinct()
    clear, doubted = split_rows(docs, copies, "doc_id")
    names = [free_name(docs.columns, name) for name in ("_copy", "_text_key")]
    key = [F.col("doc_id").cast("bigint") == F.col(names[0]), F.xxhash64("text") == F.col(names[1])]
    kept = clear.union(doubted.join(copies.toDF(*names), key, "left_anti"))
    repeated = judged.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return kept
    single, several = split_rows(kept, repeated, "doc_id")
    again = several.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return single.union(several.join(repeated, "doc_id", "left_anti")).union(again)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings that stand in earlier documents; documents with nothing left go."""
    return cut_documents(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = benchmark_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, park(found.select("doc_id").distinct(), "pipeline-leaks"), "doc_id")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, piece_ids, round_trip) of the documents left."""
    return encode_documents(docs)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", join_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", decontaminate),
    ("SentencePiece encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = park(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
