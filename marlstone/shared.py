"""Lineage cuts in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import io
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark import SparkContext, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []
_held: list[DataFrame] = []
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """What the cluster names in spark.checkpoint.dir; a folder of our own only on a local master that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="marlstone-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def materialize(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    Compressed and column-pruned, so cheaper than an RDD checkpoint, and it survives lost
    executors. The files go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def hold(df: DataFrame) -> DataFrame:
    """df, kept on the executors' disks once computed, for narrow tables that are read more than once.

    No lineage is cut: what a lost executor held is computed again. Attributes are new, as after materialize().
    The next query's ship() lets go of it; who still reads it then computes it again.
    """
    _held.append(df.persist(StorageLevel.DISK_ONLY))
    return df.select(*[F.col(f"`{c}`").alias(c) for c in df.columns])


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors' Python workers this package, wherever the driver found it; once an application. Lets go of what earlier queries hold."""
    release()
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return spark
    _shipped.add(sc.applicationId)
    top = Path(__file__).resolve().parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    path = f"{shared_dir(spark)}/{top.name}-{uuid.uuid4().hex}.zip"
    hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(sc._jsc.hadoopConfiguration())
    out = fs.create(hadoop)
    out.write(bytearray(held.getvalue()))
    out.close()
    _written.append((spark, path))
    sc.addPyFile(fs.makeQualified(hadoop).toString())
    return spark


def tidy(spark: SparkSession) -> None:
    """Give back the driver's memory, Python's and the JVM's, that nothing uses any more; a query of many small plans leaves much."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)
    spark.sparkContext._jvm.System.gc()
    with contextlib.suppress(Py4JError):  # only JVMs that know the command
        _trim_native(spark.sparkContext)


def _trim_native(sc: SparkContext) -> str:
    """The JVM gives back what its C heap has free, and says so: of compiled and unloaded code, buffers and ended threads. That is tens to hundreds of MB after many plans."""
    jvm, array = sc._jvm, sc._gateway.new_array
    kinds, given = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
    for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = jvm.java.lang.Class.forName(kind)
    # The server's own class is hidden; its interface isn't.
    invoke = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds)
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    return invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)


def written() -> int:
    """How much has been written so far: a mark for drop()."""
    return len(_written)


def drop(since: int, until: int) -> None:
    """Delete what materialize() wrote between two marks, and all that is held; only when nothing reads them any more."""
    for spark, path in _written[since:until]:
        _delete(spark, path)
    _written[since:until] = []
    release()


def release() -> None:
    """Let go of all that is held."""
    while _held:
        df = _held.pop()
        if df.sparkSession.sparkContext._jsc is not None:
            df.unpersist()


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None or sc._jsc.sc().isStopped():
        return  # a stopped context leaves the files to the cluster
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def cleanup() -> None:
    """Delete what is left of what materialize() and ship() wrote."""
    while _written:
        _delete(*_written.pop())
