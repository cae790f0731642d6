"""Session helpers shared by the queries, the tests and the bench."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("folioflow")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers.

    Nothing happens where PYTHONPATH already names the repository; otherwise
    the sources go out once per application through Spark's own file server.
    """
    on_path = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    app = spark.sparkContext.applicationId
    if str(ROOT) in on_path or app in _shipped:
        return
    archive = Path(tempfile.mkdtemp(prefix="folioflow-ship-")) / "folioflow_src.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted((ROOT / "folioflow").rglob("*.py")):
            z.write(path, path.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


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


class Kept:
    """Tables in the shared folder that cut lineage and outlive lost executors: ``keep`` writes one and reads it back, ``drop`` deletes."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/folioflow-{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Most rows and bytes of an Arrow batch of texts, files or pages.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once, whatever the size of a partition; smaller settings of the session stay.

    The settings are read when a lazy result runs, so they can't be put back here.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{key}").rstrip("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` over several tasks a core, for work that takes much longer than reading them: a small table is one file and else one task."""
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


if str(ROOT) not in sys.path:
    sys.path.insert(0, str(ROOT))
