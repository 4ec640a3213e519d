"""Tables that queries keep in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: What undoes the folders and tables made since each open scope began; the last of all are undone when Python ends.
_scopes: list[list[Callable[[], None]]] = [[]]


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below the folder named in spark.checkpoint.dir; where that is unset, below a temporary one, which only a local master can share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "pulse-shared")
    return f"{base.rstrip('/')}/pulse-{uuid.uuid4().hex}"


def remove(path: str, spark: SparkSession) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def at_end(undo: Callable[[], None]) -> None:
    """undo is called when the innermost open scope ends, or Python does."""
    _scopes[-1].append(undo)


def _undo(made: list[Callable[[], None]]) -> None:
    while made:
        with contextlib.suppress(Exception):  # a stopped session's folders are the cluster's to remove
            made.pop()()


atexit.register(lambda: [_undo(s) for s in reversed(_scopes)])


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """Folders and tables made inside are removed at its end, but for those of lasting()."""
    _scopes.append(made := [])
    try:
        yield
    finally:
        _scopes.remove(made)
        _undo(made)


def release(spark: SparkSession) -> None:
    """Collects what the driver has dropped, so that its heap shrinks and Spark removes the shuffles and broadcasts that went with it; what its JVM has freed beside the heap goes back to the system."""
    gc.collect()
    spark._jvm.System.gc()
    trim(spark)


def trim(spark: SparkSession) -> None:
    """Gives back what the driver's JVM has freed beside its heap, which glibc keeps for each of its many threads; nothing where the JVM has no command for it."""
    with contextlib.suppress(Py4JError):
        jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
        kinds, given = array(jvm.Class, 4), array(jvm.Object, 4)
        for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = jvm.Class.forName(kind)
        for i, x in enumerate((jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap", array(jvm.Object, 0), array(jvm.String, 0))):
            given[i] = x
        # the server's own class is hidden, its interface is not
        jvm.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)


def stored(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read back: lineage ends there."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    at_end(lambda: remove(path, spark))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lasting(df: DataFrame) -> DataFrame:
    """As stored(), for a scope's result: it stays until the scope around this one ends."""
    inner = _scopes.pop() if len(_scopes) > 1 else None
    try:
        return stored(df)
    finally:
        if inner is not None:
            _scopes.append(inner)
