"""Combinators over stores: mirrors, fallbacks, caches, routes, tenants, shards.

Routes and ancestors are equi-joins: a name is exploded into its few ancestors,
which meet the routes or rows by hash instead of by a prefix comparison. Whether a
side is broadcast is left to the optimizer, which knows its size when it runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions import names
from lodestack.functions.status import is_infrastructure_error, ok, status
from lodestack.operators.sets import KEY, distinct
from lodestack.operators.stores import find_missing

# Mirrors ------------------------------------------------------------------

def mirror_classes(requests: DataFrame, a: DataFrame, b: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Requested keys with ``side``: both, only_a, only_b or neither.

    Flags of the three inputs meet in one aggregation: one shuffle by key.
    """
    flag = lambda df, i: df.select(*key, *[F.lit(int(i == j)).alias(f"__{j}") for j in range(3)])
    met = flag(requests, 0).unionByName(flag(a, 1)).unionByName(flag(b, 2)).groupBy(*key).agg(*[F.max(f"__{j}").alias(f"__{j}") for j in range(3)]).where("__0 = 1")
    side = F.when(F.col("__1") + F.col("__2") == 2, "both").when(F.col("__1") == 1, "only_a").when(F.col("__2") == 1, "only_b").otherwise("neither")
    return met.select(*key, side.alias("side"))


def mirrored_find_missing(requests: DataFrame, a: DataFrame, b: DataFrame, key: list[str] = KEY) -> DataFrame:
    return mirror_classes(requests, a, b, key).where("side = 'neither'").drop("side")


def mirrored_repairs(requests: DataFrame, a: DataFrame, b: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Keys to copy, with ``direction``: a_to_b or b_to_a."""
    half = mirror_classes(requests, a, b, key).where("side like 'only%'")
    return half.select(*key, F.when(F.col("side") == "only_a", "a_to_b").otherwise("b_to_a").alias("direction"))


def mirrored_get(requests: DataFrame, a: DataFrame, b: DataFrame, order: str, key: list[str] = KEY) -> DataFrame:
    """Reads alternate between the mirrors by request number; the other side serves
    what the first lacks, and the row says which copy is to be made."""
    side = lambda df, n: df.select(*key, F.col("data").alias(f"__d{n}"), F.lit(True).alias(f"__h{n}"))
    out = requests.join(side(a, "a"), key, "left").join(side(b, "b"), key, "left")
    first_a = F.col(order) % 2 == 0
    ha, hb = F.coalesce("__ha", F.lit(False)), F.coalesce("__hb", F.lit(False))
    served = F.when(first_a & ha, "a").when(~first_a & hb, "b").when(ha, "a").when(hb, "b")
    repair = F.when(first_a & ~ha & hb, "b_to_a").when(~first_a & ~hb & ha, "a_to_b")
    out = out.withColumns({"served_by": served, "repair": repair, "data": F.when(served == "a", F.col("__da")).otherwise(F.col("__db"))})
    return out.withColumn("status", F.when(F.col("served_by").isNull(), status("NOT_FOUND", "Object not found")).otherwise(ok())).drop("__da", "__db", "__ha", "__hb")


def replicated(rows: DataFrame) -> DataFrame:
    """What is absent after a copy that should have made it is INTERNAL, not NOT_FOUND."""
    s = F.col("status")
    lost = status("INTERNAL", F.concat(F.lit("Blob absent from source backend: "), s["message"]))
    return rows.withColumn("status", F.when(s["code"] == "NOT_FOUND", lost).otherwise(s))


# Fallback and caching -------------------------------------------------------

def fallback_missing(requests: DataFrame, primary: DataFrame, secondary: DataFrame, key: list[str] = KEY) -> DataFrame:
    """The secondary is asked only for what the primary lacks."""
    return find_missing(find_missing(requests, primary, key), secondary, key)


def fallback_repairs(requests: DataFrame, primary: DataFrame, secondary: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Keys that only the secondary has, to copy into the primary."""
    return find_missing(requests, primary, key).join(secondary.select(*key), key, "left_semi")


def get_with_fallback(requests: DataFrame, stores: list[tuple[str, DataFrame]], key: list[str] = KEY) -> DataFrame:
    """The first store in order that has a key serves it."""
    out = requests
    for i, (_, s) in enumerate(stores):
        out = out.join(s.select(*key, F.col("data").alias(f"__d{i}"), F.lit(True).alias(f"__h{i}")), key, "left")
    hit = [F.col(f"__h{i}").isNotNull() for i in range(len(stores))]
    by, data = F.when(F.lit(False), ""), F.when(F.lit(False), F.lit(b""))
    for i, (name, _) in enumerate(stores):
        by, data = by.when(hit[i], name), data.when(hit[i], F.col(f"__d{i}"))
    out = out.withColumns({"served_by": by, "data": data})
    out = out.withColumn("status", F.when(F.col("served_by").isNull(), status("NOT_FOUND", "Object not found")).otherwise(ok()))
    return out.drop(*[f"__{x}{i}" for x in "dh" for i in range(len(stores))])


def cache_fills(requests: DataFrame, fast: DataFrame, slow: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Requested keys that a read takes from the slow store and leaves in the fast one."""
    return find_missing(requests, fast, key).join(slow.select(*key), key, "left_semi")


def existence_cached(requests: DataFrame, seen: DataFrame, store: DataFrame, now: int, ttl: int, key: list[str] = KEY) -> tuple[DataFrame, DataFrame]:
    """(missing keys, ``seen`` afterwards): keys present at most ``ttl`` before ``now`` are
    not asked for again; of the others those that are present are remembered from now on.
    ``seen`` holds ``key`` and ``seen_at``; keys whose time is up leave it."""
    fresh = seen.where(F.col("seen_at") >= now - ttl).groupBy(*key).agg(F.max("seen_at").alias("seen_at"))
    asked = distinct(requests, key).join(fresh, key, "left_anti")
    missing = find_missing(asked, store, key, implicit_empty=False)
    present = asked.join(missing, key, "left_anti").select(*key, F.lit(now).cast("long").alias("seen_at"))
    return missing, fresh.unionByName(present)


def canary_route(requests: DataFrame, health: DataFrame, now: Column) -> DataFrame:
    """Requests by the backend that a tenant's state names: the replica where a valid
    verdict is healthy, the source where it is not, the canary where none is valid."""
    state = health.select("instance_name", "healthy", "expires_at")
    out = requests.join(state, "instance_name", "left")
    valid = F.col("expires_at").isNotNull() & (F.col("expires_at") > now)
    return out.withColumn("backend", F.when(~valid, "canary").when(F.col("healthy"), "replica").otherwise("source")).drop("healthy", "expires_at")


def canary_verdict(s: Column) -> Column:
    return ~is_infrastructure_error(s)


# Routes and tenants ---------------------------------------------------------

def route(requests: DataFrame, routes: DataFrame) -> DataFrame:
    """Rows with the backend of the longest matching prefix and the name rewritten for it.

    ``routes``: ``prefix, backend, new_prefix``. Rows without a route get status
    INVALID_ARGUMENT.
    """
    unique = requests.select("instance_name").distinct()
    prefixes = unique.select("instance_name", F.explode(names.ancestors(F.col("instance_name"))).alias("prefix"))
    met = prefixes.join(routes, "prefix").groupBy("instance_name").agg(F.max_by(F.struct("prefix", "backend", "new_prefix"), names.depth(F.col("prefix"))).alias("r"))
    out = requests.join(met, "instance_name", "left").select(*requests.columns, "r.*")
    inner = names.patch(F.col("instance_name"), F.col("prefix"), F.col("new_prefix"))
    bad = status("INVALID_ARGUMENT", F.concat(F.lit("Unknown instance name: "), F.col("instance_name")))
    return out.withColumn("inner_name", inner).withColumn("status", F.when(F.col("backend").isNull(), bad).otherwise(ok())).drop("prefix", "new_prefix")


def route_find_missing(requests: DataFrame, routes: DataFrame, stores: DataFrame) -> DataFrame:
    """Missing keys under their outer names; ``stores`` holds ``backend`` and inner keys."""
    routed = route(requests, routes).where("backend is not null").dropDuplicates(["instance_name", *KEY])
    held = stores.select("backend", F.col("instance_name").alias("inner_name"), *KEY)
    return routed.join(held, ["backend", "inner_name", *KEY], "left_anti").select("instance_name", *KEY)


def by_ancestor(requests: DataFrame, rows: DataFrame, key: list[str], most_specific: bool = True) -> DataFrame:
    """Requests joined to the row of the nearest (or the farthest) ancestor that has one."""
    wanted = requests.select("instance_name", *key).distinct()
    tries = wanted.select("*", F.explode(names.ancestors(F.col("instance_name"))).alias("__at")).withColumn("__depth", names.depth(F.col("__at")))
    values = [c for c in rows.columns if c not in ("instance_name", *key)]
    held = rows.select(F.col("instance_name").alias("__at"), *key, F.struct(F.col("instance_name").alias("found_at"), *values).alias("__row"))
    pick = F.max_by if most_specific else F.min_by
    best = tries.join(held, ["__at", *key]).groupBy("instance_name", *key).agg(pick("__row", "__depth").alias("__row"))
    return requests.join(best, ["instance_name", *key], "left").select(*requests.columns, "__row.*")


def ancestors_find_missing(requests: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that neither the tenant nor any of its ancestors has."""
    wanted = requests.select("instance_name", *key).distinct()
    tries = wanted.select("*", F.explode(names.ancestors(F.col("instance_name"))).alias("__at"))
    found = tries.join(rows.select(F.col("instance_name").alias("__at"), *key).distinct(), ["__at", *key], "left_semi").drop("__at")
    return wanted.join(found, ["instance_name", *key], "left_anti")


# Results and the objects they need ------------------------------------------

#: Fixed value: the multiplier that spreads completion seconds.
SPREAD = 0x936A0D2A41E8C779


def expired(completed: Column, now_s: int, floor_s: int, validity_s: int, jitter_s: int) -> Column:
    """Whether a result is hidden: older than the floor, or past its validity and a
    jitter that its completion second determines. Null times never expire.

    ``completed`` is a timestamp; arithmetic is in whole nanoseconds, modulo 2**64.
    """
    if jitter_s <= 0:
        raise ValueError("INVALID_ARGUMENT: the jitter must be positive")
    spread = f"cast({SPREAD} as decimal(20,0))"
    seconds = F.unix_seconds(completed).cast("decimal(38,0)")
    jitter = (F.pmod(seconds * F.expr(spread), F.expr("cast(18446744073709551616 as decimal(20,0))")) % F.lit(jitter_s * 10**9).cast("decimal(20,0)")).cast("long")
    at = F.unix_micros(completed) * 1000
    gone = at + F.lit(validity_s * 10**9) + jitter
    return F.coalesce((F.unix_seconds(completed) < floor_s) | (F.lit(now_s * 10**9) > gone), F.lit(False))


def complete(results: DataFrame, references: DataFrame, store: DataFrame, result_key: list[str], key: list[str]) -> DataFrame:
    """Results none of whose references is missing from the store.

    ``references`` holds ``result_key`` and ``key``; a null in any key column stands
    for a malformed digest and makes its result incomplete. Empty objects are never
    missing. Keys are made distinct before the store is asked, so a popular object is
    looked up once.
    """
    broken = F.lit(False)
    for k in key:
        broken = broken | F.col(k).isNull()
    missing = find_missing(references.where(~broken).select(*key), store, key)
    lacking = references.join(missing, key, "left_semi").select(*result_key)
    malformed = references.where(broken).select(*result_key)
    return results.join(lacking.union(malformed).distinct(), result_key, "left_anti")


def within_tree_budget(results: DataFrame, sizes: Column, most: int) -> DataFrame:
    """Results whose trees together stay within ``most`` bytes."""
    return results.where(F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x) <= most)


def replication_plan(keys: DataFrame, source: DataFrame, sink: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Rows to append to the sink: wanted once, absent there, present in the source."""
    wanted = distinct(keys, key).join(sink.select(*key), key, "left_anti")
    return wanted.join(source, key)


def round_robin(requests: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``turn``: the row number within ``by``, from 0."""
    return requests.withColumn("turn", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
