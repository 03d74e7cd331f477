"""Tables that a step writes into the folder that all executors share, and later steps read."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset and all runs on one machine (tests), a local one is set."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="tidemark-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def settle(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: later steps neither run its
    plan again nor depend on one executor's disk.  Then Spark's cleaner is given the chance to
    drop the shuffle files of the plan, which nothing needs any more, and the driver gives memory back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tidemark-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    give_back_driver(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def give_back_driver(spark: SparkSession) -> None:
    """Garbage of the driver goes, and native memory that its JVM has freed (the compilers' above all) goes back to the
    machine: the C library keeps it otherwise, some hundred MB after many plans."""
    gc.collect()
    jvm = spark._jvm
    jvm.System.gc()
    with contextlib.suppress(Py4JError):  # only where the JVM has this command
        # the server's own class is hidden, its interface is not
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that no later step reads."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._tidemark_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
