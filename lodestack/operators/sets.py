"""Set algebra over keyed rows. Sets are DataFrames; order exists only at the edge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["function", "hash", "size_bytes"]


def distinct(rows: DataFrame, key: list[str] = KEY) -> DataFrame:
    """One row per key."""
    return rows.select(*key).distinct()


def union(sets: list[DataFrame], key: list[str] = KEY) -> DataFrame:
    if not sets:
        raise ValueError("INVALID_ARGUMENT: a union needs at least one set")
    return reduce(DataFrame.unionByName, [s.select(*key) for s in sets]).distinct()


def difference_and_intersection(a: DataFrame, b: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Every key of ``a`` or ``b`` with ``side``: only_a, both or only_b.

    One shuffle by key: the two sides are counted as flags instead of joined, so
    that partial aggregation runs before the exchange and no key can be hot.
    """
    flags = a.select(*key, F.lit(1).alias("__a"), F.lit(0).alias("__b")).unionByName(b.select(*key, F.lit(0).alias("__a"), F.lit(1).alias("__b")))
    both = flags.groupBy(*key).agg(F.max("__a").alias("__a"), F.max("__b").alias("__b"))
    side = F.when(F.col("__a") + F.col("__b") == 2, "both").when(F.col("__a") == 1, "only_a").otherwise("only_b")
    return both.select(*key, side.alias("side"))


def partition_by(rows: DataFrame, column: str, packed: str) -> DataFrame:
    """Groups by ``column`` with their size and first key; they sort by that key."""
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.min(packed).alias("first_key"))


def first(rows: DataFrame, packed: str) -> DataFrame:
    """The smallest key, null for an empty set."""
    return rows.agg(F.min(packed).alias("first_key"))


def without_empty(rows: DataFrame) -> DataFrame:
    """Keys of size 0 always exist and need no look-up."""
    return rows.where(F.col("size_bytes") != 0)
