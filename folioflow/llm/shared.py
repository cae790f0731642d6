"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows and bytes of an Arrow batch, so that a batch of long texts stays small.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session, by rows and by bytes; smaller settings stay.

    The settings are read when a lazy result runs, so they can't be put back here.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{key}").rstrip("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a new one in local mode (tests) and an error elsewhere."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="folioflow-shared-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


class Workspace:
    """Tables in the shared folder that cut lineage and outlive lost executors.

    ``keep`` writes a table and returns it read back; ``drop`` deletes tables
    that nothing lazy reads any more. What the result still needs stays.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/folioflow-{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """A name for each stem that is no column of ``df``, whatever the case."""
    taken, names = {c.lower() for c in df.columns}, []
    for stem in stems:
        name = stem
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        names.append(name)
    return names


#: Keys that more than this part of all rows have are broadcast: there are never more of them.
HOT_KEYS = 2000


def join_counted(rows: DataFrame, counted: DataFrame, on: list[str], least: int = 1000) -> DataFrame:
    """``rows`` joined with ``counted``, a written table of distinct keys, each with the number n of rows that have it.

    A key of more than one in ``HOT_KEYS`` of all rows (and more than ``least``) is hot.
    There are at most ``HOT_KEYS`` such keys, whatever the input, so they are broadcast
    and their rows stay where they are; all others are shuffled, and none of them can fill a task.
    """
    held = counted.agg(F.sum("n").alias("all"), F.max("n").alias("most")).first()
    limit = max(least, (held["all"] or 0) // HOT_KEYS)
    if (held["most"] or 0) <= limit:
        return rows.join(counted.drop("n"), on)
    hot, cold = counted.where(F.col("n") > limit).drop("n"), counted.where(F.col("n") <= limit).drop("n")
    rest = rows.join(F.broadcast(hot.select(on)), on, "left_anti")
    return rows.join(F.broadcast(hot), on).unionByName(rest.join(cold, on))


def crc32_of(column: str) -> Column:
    """crc32 of a number written as text, as the folds of the contracts take it."""
    return F.crc32(F.col(column).cast("string").cast("binary"))
