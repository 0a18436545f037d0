"""Stores: keyed tables with look-up, missing-key detection and upsert.

A store is a DataFrame with key columns and ``data``. Look-ups that decide
presence never carry ``data``; it is joined last. What the storage daemon does
as a side effect of a read (repair, cache fill) is a DataFrame of rows to write.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions import digests
from lodestack.functions.status import ok, status
from lodestack.operators.sets import KEY, distinct, without_empty

NOT_FOUND = "Object not found"


def find_missing(requests: DataFrame, store: DataFrame, key: list[str] = KEY, implicit_empty: bool = True) -> DataFrame:
    """Requested keys that the store lacks: distinct, then a left anti join."""
    wanted = distinct(requests, key)
    if implicit_empty and "size_bytes" in key:
        wanted = without_empty(wanted)
    return wanted.join(store.select(*key), key, "left_anti")


def get(requests: DataFrame, store: DataFrame, key: list[str] = KEY, value: str = "data") -> DataFrame:
    """Requested rows with their value and a status; absent keys are NOT_FOUND."""
    found = store.select(*key, F.col(value), F.lit(True).alias("__hit"))
    out = requests.join(found, key, "left")
    return out.withColumn("status", F.when(F.col("__hit").isNull(), status("NOT_FOUND", NOT_FOUND)).otherwise(ok())).drop("__hit")


def with_empty(rows: DataFrame, value: str = "data") -> DataFrame:
    """Reads of size 0 succeed with no bytes whatever the store holds."""
    empty = F.col("size_bytes") == 0
    return rows.withColumns({value: F.when(empty, F.lit(b"")).otherwise(F.col(value)), "status": F.when(empty, ok()).otherwise(F.col("status"))})


def checked(rows: DataFrame, function: str | None = None, value: str = "data", source: str = "backend") -> DataFrame:
    """Bytes that do not match their digest become a status; the value goes. The row's
    function decides, unless one is given."""
    seen = F.coalesce(F.col("status"), digests.integrity(F.col(value), function or F.col("function"), F.col("hash"), F.col("size_bytes"), source))
    return rows.withColumn("status", seen).withColumn(value, F.when(F.col("status").isNull(), F.col(value)))


def put(rows: DataFrame, store: DataFrame, function: str | None = None, key: list[str] = KEY) -> tuple[DataFrame, DataFrame]:
    """(rows to append, status per row). Each row is validated alone, by its own function
    unless one is given, one bad row fails itself only; keys that exist already are
    consumed, not written again."""
    judged = rows.withColumn("status", digests.integrity(F.col("data"), function or F.col("function"), F.col("hash"), F.col("size_bytes"), "user"))
    fresh = judged.where("status is null and size_bytes <> 0").drop("status").dropDuplicates(key).join(store.select(*key), key, "left_anti")
    return fresh, judged.drop("data")


def put_hierarchical(rows: DataFrame, blobs: DataFrame, function: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(blob rows, grant rows): bytes once under the canonical key, and one row per
    tenant and key that makes them visible."""
    fresh, _ = put(rows, blobs, function)
    good = rows.withColumn("status", digests.integrity(F.col("data"), function or F.col("function"), F.col("hash"), F.col("size_bytes"), "user")).where("status is null")
    return fresh.select(*KEY, "data"), good.select("instance_name", *KEY).distinct()


def get_hierarchical(requests: DataFrame, grants: DataFrame, blobs: DataFrame) -> DataFrame:
    """Reads of a hierarchical store: a blob is visible to a tenant if it or an ancestor has
    a grant (the least specific is reported as ``found_at``); its bytes are those of the
    canonical key, checked."""
    from lodestack.operators.combinators import by_ancestor

    seen = by_ancestor(requests, grants.select("instance_name", *KEY), KEY, most_specific=False)
    out = checked(get(seen, blobs))
    hidden = F.col("found_at").isNull() & (F.col("size_bytes") != 0)
    gone = status("NOT_FOUND", NOT_FOUND)
    return with_empty(out.withColumn("data", F.when(~hidden, F.col("data"))).withColumn("status", F.when(hidden, gone).otherwise(F.col("status"))))


def read_only(rows: DataFrame) -> DataFrame:
    """Writes to a store that takes none."""
    return rows.drop("data").withColumn("status", status("INVALID_ARGUMENT", "The storage backend is read-only"))


def failing(requests: DataFrame, code: str, message: str) -> DataFrame:
    """A store that answers everything with one status."""
    return requests.withColumn("data", F.lit(None).cast("binary")).withColumn("status", status(code, message))


def latest(rows: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    """The newest row per key by struct order of ``version``; map-side combined."""
    value = F.max(F.struct(F.struct(*version).alias("v"), F.struct("*").alias("row"))).alias("m")
    return rows.groupBy(*[F.col(k).alias(f"__{k}") for k in key]).agg(value).select("m.row.*")


def with_timestamp(rows: DataFrame, now: Column) -> DataFrame:
    """Results without a completion time get the time of writing."""
    return rows.withColumn("worker_completed_timestamp", F.coalesce("worker_completed_timestamp", now))


def batch_budget(rows: DataFrame, request: str, position: str, size: str, most: int) -> DataFrame:
    """Requests whose sizes add up beyond ``most`` fail as a whole, at the first
    position that crosses it. A request is one message, so its rows are few."""
    running = F.sum(size).over(Window.partitionBy(request).orderBy(position).rowsBetween(Window.unboundedPreceding, 0))
    over = rows.select(request, position, running.alias("__sum")).where(F.col("__sum") > most).groupBy(request).agg(F.min(position).alias("failed_at"))
    return rows.groupBy(request).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("total")).join(over, request, "left")


def slices(parents: DataFrame, slicer: Column) -> DataFrame:
    """One row per child of a composite: the parent's key, the child's, and its range.
    ``slicer`` yields ``array<struct<hash, size_bytes, offset_bytes>>``."""
    own = parents.select(*[F.col(k).alias(f"parent_{k}") for k in KEY], F.explode(slicer).alias("s"))
    return own.select("*", "s.*").drop("s")


def get_from_composite(pairs: DataFrame, index: DataFrame, store: DataFrame) -> DataFrame:
    """Children (``parent_hash``, ``hash``) read out of their parents; the parent is
    checked whole before its bytes are cut."""
    found = pairs.join(index, ["parent_hash", "hash"], "left")
    blobs = store.select(F.col("hash").alias("parent_hash"), F.col("size_bytes").alias("__size"), "data")
    out = found.join(blobs, "parent_hash", "left")
    sound = digests.integrity(F.col("data"), "SHA256", F.col("parent_hash"), F.col("__size"))
    out = out.withColumn("status", F.when(F.col("offset_bytes").isNull(), status("NOT_FOUND", NOT_FOUND)).otherwise(sound))
    cut = F.substr("data", F.col("offset_bytes").cast("int") + 1, F.col("size_bytes").cast("int"))
    return out.withColumn("data", F.when(F.col("status").isNull(), cut)).drop("__size")


def content_rows(values: DataFrame, data: str, function: str = "SHA256") -> DataFrame:
    """Values as blobs under the key of their own bytes."""
    return values.select(F.lit(function).alias("function"), digests.hash_of(data, function).alias("hash"), digests.size_of(data).alias("size_bytes"), digests.as_bytes(data).alias("data"))


def typed(rows: DataFrame, schema: str, value: str = "data", source: str = "backend") -> DataFrame:
    """Rows with ``message``: their bytes read as a JSON document of ``schema``. What
    does not parse becomes a status: the user's fault or the store's."""
    code = "INVALID_ARGUMENT" if source == "user" else "INTERNAL"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}
    parsed = F.from_json(F.col(value).cast("string"), f"{schema}, __bad string", options)
    out = rows.withColumn("__m", parsed)
    bad = F.col(value).isNotNull() & (F.col("__m").isNull() | F.col("__m.__bad").isNotNull())
    out = out.withColumn("status", F.coalesce(F.col("status"), F.when(bad, status(code, "Failed to unmarshal message")).otherwise(ok())))
    return out.withColumn("message", F.when(F.col("status").isNull(), F.col("__m").dropFields("__bad"))).drop("__m")


def observed(rows: DataFrame, name: str, value: str = "size_bytes") -> DataFrame:
    """The same rows, counted on the way: read the figures from the query's listener."""
    return rows.observe(name, F.count(F.lit(1)).alias("rows"), F.sum(value).alias(value))
