"""Persistent state: a table of versions, of which readers see the newest whole one."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def save(state: DataFrame, path: str, version: int) -> None:
    """Write a version. Spark's committer publishes its files together, so that a
    writer that dies leaves the version before it in force."""
    state.write.mode("overwrite").parquet(f"{path}/version={version}")


def committed(spark: SparkSession, path: str) -> list[int]:
    """Versions whose writer ended, in order: those whose folder its committer marked."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = [(f.getPath().getName(), f.getPath()) for f in fs.listStatus(at)]
    marked = lambda p: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    return sorted(int(n.removeprefix("version=")) for n, p in names if re.fullmatch(r"version=\d+", n) and marked(p))


def latest(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest committed version, which may be empty; null when there is none."""
    seen = committed(spark, path)
    return spark.read.parquet(f"{path}/version={seen[-1]}") if seen else None


def expire(spark: SparkSession, path: str, keep: int) -> list[int]:
    """Versions beyond the newest ``keep``, oldest first: what a clean-up may delete."""
    seen = committed(spark, path)
    return seen[:-keep] if keep else seen
