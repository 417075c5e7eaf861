"""What every operator here needs from the session.

Intermediate tables go to the folder that ``spark.checkpoint.dir`` names, which
the driver and all executors share; a temporary folder is used only where the
setting is absent and everything runs on one machine (local tests).
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import time
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyarrow import fs
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession

from ..session import ship

#: Rows of an Arrow batch sent to Python. Texts can be long, so it is small.
BATCH_ROWS = 1024
#: The JVM's command that returns the C library's free memory; seconds between two uses.
TRIM, RELIEF_S = "systemTrimNativeHeap", 3.0


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from the session's settings."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "palimpsest-shared")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/palimpsest-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below this application's part of the shared folder."""
    return f"{_own(spark)}/{name}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Remove all that this application wrote there, once its results are written elsewhere."""
    discard(spark, _own(spark))


def arrow_limits(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound what one Arrow batch holds (read when a plan is made) and give executors this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage, survives executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    relieve(spark)
    df.write.option("parquet.block.size", 16 << 20).parquet(path)  # a task buffers a row group
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


_relieved = 0.0


def relieve(spark: SparkSession) -> None:
    """Have the driver drop what nothing refers to any more, and return free native memory; every few seconds at most.

    Shuffles and broadcasts of finished steps are removed when the driver collects
    its garbage. Operators of many small jobs start hundreds of short-lived threads
    there, whose allocations the C library keeps; a JVM without a command to return
    them is left alone.
    """
    global _relieved
    if time.monotonic() - _relieved < RELIEF_S:
        return
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    gateway = spark.sparkContext._gateway
    jvm, kind = gateway.jvm, gateway.jvm.java.lang.Class.forName

    def called(method: str, *given: tuple[str, object]):
        # By reflection on the public interface: the server's own class is not accessible.
        kinds, values = gateway.new_array(jvm.java.lang.Class, len(given)), gateway.new_array(jvm.java.lang.Object, len(given))
        for i, (k, v) in enumerate(given):
            kinds[i], values[i] = kind(k), v
        return kind("javax.management.MBeanServer").getMethod(method, kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)

    commands = ("javax.management.ObjectName", jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"))
    if called("isRegistered", commands) and any(x.getName() == TRIM for x in called("getMBeanInfo", commands).getOperations()):
        called("invoke", commands, ("java.lang.String", TRIM), ("[Ljava.lang.Object;", None), ("[Ljava.lang.String;", None))
    _relieved = time.monotonic()


def reread(df: DataFrame) -> DataFrame:
    """A table of ``written`` anew, so that it can be joined or cogrouped with itself."""
    out = df.sparkSession.read.schema(df.schema).parquet(df.shared_path)
    out.shared_path = df.shared_path
    return out


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: What operators keep in a worker between tasks: by name, how to drop it.
KEPT: dict[str, Callable[[], None]] = {}


def prepare(keep: str) -> None:
    """Drop what other operators kept in this worker."""
    for name, drop in KEPT.items():
        if name != keep:
            drop()


def release(*shared: Broadcast) -> None:
    """Give back what a worker no longer uses at the end of a task; workers live on.

    Values of the broadcasts given are dropped, to be read again by the next task.
    """
    for b in shared:
        b.__dict__.pop("_value", None)
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(run, keep: str = "", shared: tuple[Broadcast, ...] = ()):
    """A function of batches after which the worker gives back memory.

    What other operators kept in the worker is dropped before it starts; module
    functions do that, so that it is the worker's own and not a copy sent to it.
    """

    def wrapped(batches):
        prepare(keep)
        try:
            yield from run(batches)
        finally:
            release(*shared)

    return wrapped


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The store behind a URI, and the path in it."""
    return fs.FileSystem.from_uri(uri)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def size_hint(df: DataFrame) -> int:
    """The optimizer's estimate of the table's bytes; for a table in files, the files' size. Nothing is read."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def need(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, so other columns with clashing names play no part."""
    return df.select(*[df[n] for n in names])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that the table does not have, made from those given."""
    held, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in held:
            n += "_"
        held.add(n.lower())
        out.append(n)
    return out


def out_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A batch of ``schema`` from arrays or lists."""
    return pa.RecordBatch.from_arrays([c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in schema], schema=schema)
