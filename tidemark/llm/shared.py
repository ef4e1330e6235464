"""Tables that one step of an operator writes and later steps read, on storage all executors share."""

from __future__ import annotations

import re
import tempfile
import time
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: Seconds between two times that the driver gives freed memory back.
TRIM_EVERY = 5.0
_trimmed = 0.0


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where that is unset, a temporary one on a single machine and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def saved(df: DataFrame, name: str, **options: int) -> DataFrame:
    """The rows of `df`, written once and read back; later failures restart from the files. options: of the Parquet writer."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **options).parquet(path)
    trim_driver(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def trim_driver(spark: SparkSession) -> None:
    """Lets the driver's JVM give freed native memory back to the system; a chain of many jobs leaves it scattered over its threads' heaps."""
    global _trimmed
    if time.monotonic() - _trimmed < TRIM_EVERY:
        return
    _trimmed, jvm, new = time.monotonic(), spark._jvm, spark.sparkContext._gateway.new_array
    try:
        # called through the public interface, as the server's own class is closed to reflection
        (call,) = (m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = new(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        args[2], args[3] = new(jvm.java.lang.Object, 0), new(jvm.java.lang.String, 0)
        call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:  # a JVM without that command
        pass
