"""Tables that cut lineage: written as Parquet in the folder that spark.checkpoint.dir names, so they survive a lost executor."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: The driver gives memory back after so many tables of a store.
RELEASE_AFTER = 4
#: The JVM's diagnostic command that does so.
COMMAND = "systemTrimNativeHeap"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only on a local master whose session names none (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_waymark_shared", None)
    if not path:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='waymark-')}"
        spark._waymark_shared = path
    return path.rstrip("/")


def release(spark: SparkSession) -> str | None:
    """Return the driver's freed native memory to the system: what the JVM says of it, or None where it can't (JDK before 17.0.9, not glibc).

    Each exchange of a plan has a driver thread of its own for a minute, and glibc keeps what these and the JVM's compilers
    free in dozens of arenas, so that a driver grows over a chain of many small jobs although its heap doesn't.
    """
    jvm = spark._jvm
    args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), COMMAND
    try:
        # The server's class is not public: its method is taken from the interface.
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods() if m.getName() == "invoke")
        return invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        return None


class Store:
    """Named tables under one run's own folder."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/waymark-{name}-{uuid.uuid4().hex}"
        self.names: set[str] = set()
        self.written = 0

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write df once and return a DataFrame that reads what was written."""
        path = f"{self.root}/{name}"
        self.names.add(name)
        df.write.mode("overwrite").parquet(path)
        self.written += 1
        if self.written % RELEASE_AFTER == 0:
            release(self.spark)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that nothing reads any more."""
        self.names.discard(name)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def keep(self, *names: str) -> None:
        """Delete all tables but those named: what is returned reads only them."""
        for name in self.names - set(names):
            self.drop(name)
