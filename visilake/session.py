"""Session settings and lineage cuts shared by the jobs."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
LOCAL_FOLDER = "/tmp/visilake-shared"
#: how many partitions a table of few files is dealt into before per-row work; unset: none
DEAL_CONF = "spark.visilake.deal"

#: Settings the operators rely on; a cluster may override any of them at submit.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    # call sites of every column call cost more than small plans do
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cpus: int = 8, shuffle_partitions: int | None = None, memory: str = "12g", folder: str = LOCAL_FOLDER) -> SparkSession:
    """A single-JVM session for tests and the benchmark; stored steps go to ``folder``."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("visilake")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config(DEAL_CONF, str(cpus))
        .config(CHECKPOINT_CONF, folder)
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def dealt(df: DataFrame) -> DataFrame:
    """Deal rows anew over as many partitions as the session's setting asks for.

    For tables that arrive in a few large files or row groups and whose rows cost far more to
    work on than to move (parsing, stemming). Unset, as for tables in many files, nothing moves.
    """
    asked = df.sparkSession.conf.get(DEAL_CONF, None)
    return df.repartition(int(asked)) if asked else df


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; a fixed local one in local mode only."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get(CHECKPOINT_CONF, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder all executors share")
    return LOCAL_FOLDER


def run_folder(spark: SparkSession) -> str:
    """Where this application stores its steps, inside the shared folder."""
    return f"{shared_folder(spark)}/steps-{spark.sparkContext.applicationId}"


def remove_run(spark: SparkSession) -> bool:
    """Remove the steps this application has stored; no frame that reads one may be used afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through reliable storage in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once a session."""
    context = spark.sparkContext
    if getattr(context, "_visilake_shipped", False):
        return
    here = Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='visilake-code-')}/visilake", "zip", here.parent, here.name)
    context.addPyFile(archive)  # Spark's own file server hands it out, so it has to stay
    context._visilake_shipped = True
