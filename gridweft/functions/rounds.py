"""Helpers of operators that go in rounds."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_IDS_A_BUCKET = 100_000
_MADE: list[str] = []


def use_checkpoints(spark: SparkSession) -> str:
    """The folder of checkpoints: that of spark.checkpoint.dir. Only a local session may do without one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="gridweft-"))
    return context._jsc.sc().getCheckpointDir().get()


def give_back(spark: SparkSession) -> bool:
    """Has the driver's JVM return freed native memory to the system, if it knows how (JDK 17.0.9 or later on Linux).

    Planning and compiling the many small queries of rounds leave hundreds of megabytes freed
    but held by malloc, which a driver of bounded memory lacks later.
    """
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
    with contextlib.suppress(Py4JError):
        kinds, given = gateway.new_array(jvm.Class, 4), gateway.new_array(jvm.Object, 4)
        for k, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[k] = jvm.java.lang.Class.forName(kind)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, given)
        return True
    return False


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut at a copy in spark.checkpoint.dir, which all executors share."""
    use_checkpoints(df.sparkSession)
    return df.checkpoint()


def new_folder(spark: SparkSession, kind: str) -> str:
    """The name of a new folder in that of checkpoints, which intermediate() removes."""
    _MADE.append(f"{use_checkpoints(spark)}/{kind}-{uuid.uuid4()}")
    return _MADE[-1]


@contextmanager
def intermediate(spark: SparkSession) -> Iterator[None]:
    """Removes on exit what was written within it to the shared folder on the way to results.

    Results are lazy and read those folders, so they must be written or collected inside.
    Checkpoints go by spark.cleaner.referenceTracking.cleanCheckpoints.
    """
    before = len(_MADE)
    try:
        yield
    finally:
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        for folder in _MADE[before:]:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(hadoop).delete(path, True)
        del _MADE[before:]


def shared_folder(spark: SparkSession) -> str:
    """A new folder in that of checkpoints, which must be mounted, as raster files are read and written by place."""
    folder = new_folder(spark, "files").removeprefix("file://").removeprefix("file:")
    if "://" in folder:
        raise RuntimeError(f"{folder} is not mounted; give readers and writers a transport")
    os.makedirs(folder)
    return folder


def numbered(ids: DataFrame, by: list[str], order: str, name: str) -> DataFrame:
    """Adds 1, 2, ... in the order of a distinct integer column within each `by`.

    Buckets of ids are counted first and only the counts are summed up in one window.
    """
    rows = ids.withColumn("_bucket", F.floor(F.col(order) / _IDS_A_BUCKET))
    over = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*by, "_bucket").count().select(*by, "_bucket", F.coalesce(F.sum("count").over(over), F.lit(0)).alias("_before"))
    inner = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(order)))
    return inner.join(counts, [*by, "_bucket"]).withColumn(name, F.col("_before") + F.col("_n")).drop("_bucket", "_before", "_n")
