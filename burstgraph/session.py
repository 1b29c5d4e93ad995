"""Where intermediate results go: the shared folder the cluster names.

Loops cut their lineage with reliable checkpoints, so a lost executor costs a
re-read from the shared folder and never the loop.
"""

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only for local masters without a setting."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if configured is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            configured = tempfile.mkdtemp(prefix="burstgraph-")
        context.setCheckpointDir(configured)
    return configured or context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared folder; partitioning and order survive."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_lineage_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``cut_lineage`` and the number of rows, counted while they are written.

    Retried tasks may be counted twice: use the number as an upper bound that is
    0 only for an empty table.
    """
    seen = Observation()
    return cut_lineage(df.observe(seen, F.count(F.lit(1)).alias("rows"))), seen.get["rows"]


class Scratch:
    """Column files in the shared folder that belong to one piece of work; leaving the block deletes what is left of them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, scratch_path(spark, name)
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def keep(self, df: DataFrame) -> tuple[DataFrame, int]:
        """``df`` written in one pass and read from its files, with the rows counted on the way.

        Retried tasks may be counted twice: the number is an upper bound that is 0 only for an empty table.
        """
        seen, path = Observation(), f"{self.root}/{len(self._paths)}-{uuid.uuid4().hex}"
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(kept)] = (kept, path)
        return kept, seen.get["rows"]

    def forget(self, df: DataFrame) -> None:
        """Delete the files of one table kept here; other tables are left alone."""
        if id(df) in self._paths:
            delete_files(self.spark, self._paths.pop(id(df))[1])

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *_) -> None:
        delete_files(self.spark, self.root)


def delete_files(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def store(df: DataFrame, name: str = "rows") -> DataFrame:
    """``df``, computed and written once as column files in the shared folder and read from there.

    A checkpoint computes its last stage twice; this is for rows that are dear to make. Partitioning and order are not kept.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
