"""A folder that the driver and all executors share, and tables in it."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local session without one gets its own."""
    if found := spark.conf.get(KEY, None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError(f"set {KEY} to a folder that all machines share")
    path = "file://" + tempfile.mkdtemp(prefix="textloom-")
    spark.conf.set(KEY, path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def _place(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path as it knows it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _delete(spark: SparkSession, path: str) -> None:
    files, where = _place(spark, path)
    files.delete(where, True)


def give_back(spark: SparkSession) -> bool:
    """The driver's JVM gives native memory that it has freed back to the system: compiling the code of many queries
    leaves a lot of it. Whether it could; a JVM without that command goes on as before."""
    jvm, new = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    named, kinds, values = jvm.java.lang.Class.forName, new(jvm.java.lang.Class, 4), new(jvm.java.lang.Object, 4)
    try:
        for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = named(kind)
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # by the interface: the server's own class isn't open to others
        named("javax.management.MBeanServerConnection").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JError:
        return False
    return True


class Workspace:
    """A folder of tables in the shared place; it goes with close(), or when the driver ends.

    The file system deletes it when the driver's JVM ends, so a session that was stopped before leaves nothing behind.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = scratch(spark, name)
        files, where = _place(spark, self.path)
        files.mkdirs(where)
        files.deleteOnExit(where)
        atexit.register(self.close)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df as a table and reads it again: its lineage ends here, and lost executors cost nothing."""
        at = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(at)
        give_back(self.spark)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, name: str) -> None:
        _delete(self.spark, f"{self.path}/{name}")

    def close(self) -> None:
        atexit.unregister(self.close)
        try:
            _delete(self.spark, self.path)
        except Exception:  # noqa: BLE001  the session may have ended before
            pass
