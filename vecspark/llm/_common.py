"""Shared plumbing: where jobs may write, and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none (single-machine tests) a temporary folder is set.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="vecspark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/vecspark-{uuid.uuid4().hex}-{name}"


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it again."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path, **options)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop_written(df: DataFrame) -> None:
    """Delete what ``written`` made, through the file system of its path."""
    path = getattr(df, "_scratch_path", None)
    if path:
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Rows of an Arrow batch, where the session doesn't say: whole texts may be long.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Set the session's rows of an Arrow batch to ``BATCH_ROWS`` unless it was set to less."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def freed(run):
    """``run`` for ``mapInArrow``: what a task has freed goes back to the system when it ends, as workers live on."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes

            import pyarrow as pa

            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return wrapped


def driver_freed(spark: SparkSession) -> None:
    """What the driver's JVM has freed outside of its heap goes back to the system: its compilers and codecs leave much,
    which the C library keeps for each thread. A JVM without this command stays as it is."""
    jvm = spark._jvm
    try:
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        # The server's own class is not open to callers, its interface is.
        call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = name, "systemTrimNativeHeap"
        call.invoke(server, args)
    except Py4JError:
        pass


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
