"""Sending this package to the executors, and tables in the folder that they share."""

import tempfile
import time
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package's modules to the executors, once a session; they need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_shiftscope_shipped", False):
        return
    package = Path(__file__).parent
    path = Path(tempfile.mkdtemp()) / "shiftscope-modules.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for module in sorted(package.rglob("*.py")):
            archive.write(module, module.relative_to(package.parent))
    context.addPyFile(str(path))
    context._shiftscope_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it.

    Where none is named a local session gets a folder of its own; on a cluster, whose machines would not share it,
    that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='spark-')}")
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def _paths(spark: SparkSession) -> list[str]:
    context = spark.sparkContext
    if not hasattr(context, "_shiftscope_tables"):
        context._shiftscope_tables = []
    return context._shiftscope_tables


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, its lineage cut, safe when executors are lost."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._shiftscope_path = path
    _paths(df.sparkSession).append(path)
    return table


def mark(spark: SparkSession) -> int:
    """A point in the order of written(), for release()."""
    return len(_paths(spark))


#: Seconds that release() waits for jobs that still run.
PATIENCE = 30.0


def _wait_for_jobs(spark: SparkSession) -> None:
    """Waits until no job runs, PATIENCE seconds at most.

    A query can end before all of its jobs do: where an adaptive plan learns that one side of a join is empty, the stages
    of the other side go on reading their tables for a while.
    """
    tracker, end = spark.sparkContext.statusTracker(), time.monotonic() + PATIENCE
    while tracker.getActiveJobsIds() and time.monotonic() < end:
        time.sleep(0.05)


def release(spark: SparkSession, since: int = 0, keep: tuple[DataFrame, ...] = ()) -> None:
    """Deletes the tables that were written after a mark, but those in keep. Frames that still read them must not be used.

    Jobs that run are waited for, as a query's own stages may outlive it.
    """
    _wait_for_jobs(spark)
    paths, spared = _paths(spark), {getattr(k, "_shiftscope_path", None) for k in keep}
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in [p for p in paths[since:] if p not in spared]:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
        paths.remove(path)
