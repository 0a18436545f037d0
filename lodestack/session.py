"""What the package needs of a session: itself in the Python workers, and tables in
the folder that driver and executors share."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per context, unless the path that
    they inherit names it already. The file travels through Spark's own server."""
    root = Path(__file__).resolve().parent
    inherited = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    sc = spark.sparkContext
    if str(root.parent) in inherited or "lodestack.zip" in getattr(sc, "_python_includes", []):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="lodestack-"), "lodestack.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only in local mode, where both are one process, a temporary folder takes the place
    of one that the session does not name; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("FAILED_PRECONDITION: spark.checkpoint.dir names no folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="lodestack-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


#: Paths of the tables written within the innermost :func:`scratch`.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Deletes at its end the tables that :func:`written` made within it. It gives a
    function that writes a result which stays, as :func:`written` does outside."""
    made, outer = [], _made.get()
    token = _made.set(made)

    def result(df: DataFrame, name: str) -> DataFrame:
        _made.set(outer)
        try:
            return written(df, name)
        finally:
            _made.set(made)

    try:
        yield result
    finally:
        _made.reset(token)
        for path in made:
            delete(spark, path)


def release() -> None:
    """Unused memory of a Python worker back to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # where the C library has it
        trim(0)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, never a recomputation of
    what came before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestack/{name}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Delete the tables that :func:`written` left in the shared folder. For the end of
    an application, when the results that read them are stored."""
    delete(spark, f"{shared_dir(spark)}/lodestack")
