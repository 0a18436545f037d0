"""Metrics: counters, histograms, gauges and merges of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def powers_of_two(n: int, with_zero: bool = False) -> list[float]:
    return [0.0] * with_zero + [float(2**i) for i in range(n)]


def decimal_buckets(low: int, high: int, steps: int) -> list[float]:
    """``steps`` points between neighbouring powers of ten: 10**(i / (steps + 1)) to
    four decimals times the power, from 10**low to 10**(low + high)."""
    points = [round(10 ** (i / (steps + 1)), 4) for i in range(steps + 1)]
    return [float(f"{p}e{k}") for k in range(low, low + high) for p in points] + [float(f"1e{low + high}")]


def counters(rows: DataFrame, labels: list[str]) -> DataFrame:
    return rows.groupBy(*labels).agg(F.count(F.lit(1)).alias("n"))


def histogram(rows: DataFrame, labels: list[str], value: str, buckets: list[float], unit: int = 1) -> DataFrame:
    """Cumulative counts per label and bucket ``le``, with total count and sum.

    One conditional count per bucket: a row is aggregated once, whatever the
    number of buckets, and the exchange holds one row per label and task. ``sum``
    is kept in whole multiples of 1/``unit``.
    """
    counts = [F.count(F.when(F.col(value) <= b, 1)).alias(f"b{i}") for i, b in enumerate(buckets)]
    whole = rows.groupBy(*labels).agg(*counts, F.count(value).alias("count"), F.sum(F.round(F.col(value) * unit).cast("long")).alias("sum"))
    each = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(buckets)])
    return whole.select(*labels, "count", "sum", F.explode(each).alias("x")).select(*labels, "x.le", "x.n", "count", "sum")


def gauge(rows: DataFrame, labels: list[str], value: str, ts: list[str]) -> DataFrame:
    """The last value per label."""
    return rows.groupBy(*labels).agg(F.max_by(value, F.struct(*ts)).alias(value))


def named(metrics: DataFrame, pattern: str) -> DataFrame:
    return metrics.where(F.col("name").rlike(pattern))


def merge_errors(rows: DataFrame, group: str, order: str) -> DataFrame:
    """Per group the first code and the distinct messages in order of first sight.
    Messages are made distinct before they are gathered."""
    each = rows.groupBy(group, "message").agg(F.min(order).alias("at"), F.min_by("code", order).alias("code"))
    seen = F.array_sort(F.collect_list(F.struct("at", "message"))).alias("m")
    out = each.groupBy(group).agg(F.min_by("code", "at").alias("code"), seen)
    return out.select(group, "code", F.array_join(F.transform("m", lambda x: x["message"]), ", ").alias("message"))


def version(text: Column) -> Column:
    """``major.minor.patch`` as a struct that orders by number."""
    part = lambda i: F.split_part(text, F.lit("."), F.lit(i)).cast("int")
    return F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch"))


def merge_capabilities(reports: DataFrame, group: str) -> DataFrame:
    """Reports of several backends as one: lists are joined without repeats, the
    lowest versions by their maximum, the highest by their minimum."""
    show = lambda c: F.concat_ws(".", c["major"], c["minor"], c["patch"])
    return reports.groupBy(group).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("functions")))).alias("functions"),
        show(F.max(version(F.col("low")))).alias("low"), show(F.min(version(F.col("high")))).alias("high"), F.max(version(F.col("deprecated"))).alias("d"),
    ).withColumn("deprecated", show(F.col("d"))).drop("d")


def pack_executions(runs: DataFrame, key: list[str], size_class: str, order: str, outcome: str, duration: str, last: int) -> DataFrame:
    """Execution statistics: per key a map from size class to its ``last`` executions
    in order. Rows beyond the last ones are ranked away before they are gathered."""
    from pyspark.sql import Window

    w = Window.partitionBy(*key, size_class).orderBy(F.desc(order))
    kept = runs.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= last)
    each = kept.groupBy(*key, size_class).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, outcome, duration))), lambda x: F.struct(x[outcome].alias("outcome"), x[duration].alias("duration"))).alias("runs"))
    return each.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(size_class, "runs")))).alias("size_classes"))
