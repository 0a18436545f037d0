"""Registered queries of the content-addressed algebra, each with DuckDB SQL for the
same rows where SQL can say it.

Domain tables are derived from the driver's tables: documents are blobs, two
thirds of them lie on each of two mirrors, orders are action results whose line
items refer to parts, events are an operation log.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.functions import binary, digests, documents, names, paths, tokens, u64
from lodestack.functions.status import http_status
from lodestack.operators import auth, combinators, graph, metrics, sets, stores
from lodestack.plans.build import build
from lodestack.session import delete, shared_dir
from lodestack.sources import archives, references, state
from lodestack.streaming import folds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
KEY = sets.KEY


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.lit("SHA256").alias("function"), digests.hash_of("text").alias("hash"), digests.size_of("text").alias("size_bytes"),
        F.concat_ws("/", "lang", "source").alias("instance_name"), F.col("text").cast("binary").alias("data"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("doc_id"), F.lit("SHA256").alias("function"), digests.hash_of("text").alias("hash"), digests.size_of("text").alias("size_bytes"), F.lit("bench").alias("instance_name"), F.col("text").cast("binary").alias("data"))


def mirror(spark: SparkSession, sf_dir: str, side: int) -> DataFrame:
    return cas(spark, sf_dir).where(F.col("doc_id") % 3 != side).dropDuplicates(KEY)


def requested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cas(spark, sf_dir).select(*KEY).unionByName(items(spark, sf_dir).select(*KEY))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with its time in microseconds."""
    return table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


def tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers under region/nation."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_nationkey", "r_regionkey", "r_name", "n_name", F.concat_ws("/", "r_name", "n_name").alias("instance_name"))


_CAS = """cas AS (SELECT doc_id, 'SHA256' AS function, sha256(text) AS hash, octet_length(encode(text))::BIGINT AS size_bytes, concat_ws('/', lang, source) AS instance_name, text FROM documents),
bench AS (SELECT 'SHA256' AS function, sha256(text) AS hash, octet_length(encode(text))::BIGINT AS size_bytes FROM benchmark),
a AS (SELECT DISTINCT function, hash, size_bytes FROM cas WHERE doc_id % 3 <> 0),
b AS (SELECT DISTINCT function, hash, size_bytes FROM cas WHERE doc_id % 3 <> 1),
req AS (SELECT DISTINCT function, hash, size_bytes FROM (SELECT function, hash, size_bytes FROM cas UNION ALL SELECT * FROM bench) WHERE size_bytes <> 0)"""
_TENANT = """tenant AS (SELECT c_custkey, n_nationkey, r_regionkey, r_name, n_name, r_name || '/' || n_name AS instance_name
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

# Look-ups ---------------------------------------------------------------------


@query(f"WITH {_CAS} SELECT * FROM (SELECT DISTINCT function, hash, size_bytes FROM cas WHERE size_bytes <> 0) r WHERE NOT EXISTS (SELECT 1 FROM bench s WHERE s.hash = r.hash AND s.size_bytes = r.size_bytes)")
def find_missing_flat(spark, sf_dir):
    """Document digests that the benchmark store lacks."""
    rows = cas(spark, sf_dir)
    good = rows.where(digests.validate(F.col("function"), F.col("hash"), F.col("size_bytes")).isNull())
    return stores.find_missing(good, items(spark, sf_dir))


@query(f"WITH {_CAS} SELECT c.doc_id, c.hash, CASE WHEN a.hash IS NULL THEN 'NOT_FOUND' ELSE 'OK' END AS code FROM cas c LEFT JOIN a ON a.hash = c.hash AND a.size_bytes = c.size_bytes")
def get_with_status(spark, sf_dir):
    """Reads from a mirror, checked against their digests."""
    requests = cas(spark, sf_dir).select("doc_id", *KEY)
    got = stores.checked(stores.get(requests, mirror(spark, sf_dir, 0)))
    return got.select("doc_id", "hash", F.coalesce("status.code", F.lit("OK")).alias("code"))


@query(f"WITH {_CAS} SELECT doc_id, CASE WHEN text IS NULL THEN 'NOT_FOUND' WHEN doc_id % 2 = 1 OR doc_id % 3 = 1 THEN 'INTERNAL' ELSE 'OK' END AS code FROM cas")
def integrity_filter(spark, sf_dir):
    """Every other stored blob claims one byte too few, every third has another's hash."""
    rows = cas(spark, sf_dir).withColumn("size_bytes", F.col("size_bytes") - F.col("doc_id") % 2)
    rows = rows.withColumn("hash", F.when(F.col("doc_id") % 3 == 1, F.sha2(F.lit(b"another"), 256)).otherwise(F.col("hash")))
    code = digests.integrity(F.col("data"), "SHA256", F.col("hash"), F.col("size_bytes"))["code"]
    return rows.select("doc_id", F.coalesce(code, F.lit("OK")).alias("code"))


@query(f"WITH {_CAS} SELECT doc_id, CASE WHEN size_bytes > 4096 THEN 'INVALID_ARGUMENT' ELSE 'OK' END AS code FROM cas")
def bounded_read(spark, sf_dir):
    rows = cas(spark, sf_dir)
    return rows.select("doc_id", F.coalesce(digests.bounded(F.col("data"), F.col("size_bytes"), 4096)["code"], F.lit("OK")).alias("code"))


@query(f"WITH {_CAS} SELECT function, hash, size_bytes FROM cas WHERE size_bytes <> 0 AND hash NOT IN (SELECT hash FROM a) GROUP BY ALL")
def batch_update_appends(spark, sf_dir):
    """Upload all documents to a mirror: what it has to append."""
    fresh, _ = stores.put(cas(spark, sf_dir).select(*KEY, "data"), mirror(spark, sf_dir, 0))
    return fresh.select(*KEY)


@query(f"WITH {_CAS} SELECT DISTINCT instance_name, function, hash, size_bytes FROM cas")
def hierarchical_put_grants(spark, sf_dir):
    """Grant rows of an upload to a hierarchical store."""
    rows = cas(spark, sf_dir)
    _, grants = stores.put_hierarchical(rows.select("instance_name", *KEY, "data"), mirror(spark, sf_dir, 0))
    return grants


@query("SELECT c_mktsegment AS segment, arg_max(c_custkey, (c_acctbal, c_custkey)) AS custkey FROM customer GROUP BY 1")
def latest_wins(spark, sf_dir):
    """The newest row per key."""
    c = table(spark, sf_dir, "customer")
    return stores.latest(c, ["c_mktsegment"], ["c_acctbal", "c_custkey"]).select(F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("custkey"))


# Two backends -------------------------------------------------------------------


@query(f"WITH {_CAS} SELECT * FROM req WHERE hash NOT IN (SELECT hash FROM a) AND hash NOT IN (SELECT hash FROM b)")
def mirrored_find_missing(spark, sf_dir):
    r = sets.without_empty(requested(spark, sf_dir))
    return combinators.mirrored_find_missing(r, mirror(spark, sf_dir, 0), mirror(spark, sf_dir, 1))


@query(f"WITH {_CAS} SELECT *, CASE WHEN hash IN (SELECT hash FROM a) THEN 'a_to_b' ELSE 'b_to_a' END AS direction FROM req WHERE (hash IN (SELECT hash FROM a)) <> (hash IN (SELECT hash FROM b))")
def mirrored_repair_plan(spark, sf_dir):
    r = sets.without_empty(requested(spark, sf_dir))
    return combinators.mirrored_repairs(r, mirror(spark, sf_dir, 0), mirror(spark, sf_dir, 1))


@query(f"""WITH {_CAS}, f AS (SELECT doc_id, hash IN (SELECT hash FROM a) AS ha, hash IN (SELECT hash FROM b) AS hb FROM cas)
SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND ha THEN 'a' WHEN doc_id % 2 <> 0 AND hb THEN 'b' WHEN ha THEN 'a' WHEN hb THEN 'b' END AS served_by,
CASE WHEN doc_id % 2 = 0 AND NOT ha AND hb THEN 'b_to_a' WHEN doc_id % 2 <> 0 AND NOT hb AND ha THEN 'a_to_b' END AS repair FROM f""")
def mirrored_get(spark, sf_dir):
    requests = cas(spark, sf_dir).select("doc_id", *KEY)
    return combinators.mirrored_get(requests, mirror(spark, sf_dir, 0), mirror(spark, sf_dir, 1), "doc_id").select("doc_id", "served_by", "repair")


@query(f"WITH {_CAS} SELECT * FROM req WHERE hash NOT IN (SELECT hash FROM a) AND hash NOT IN (SELECT hash FROM bench)")
def read_fallback_missing(spark, sf_dir):
    return combinators.fallback_missing(requested(spark, sf_dir), mirror(spark, sf_dir, 0), items(spark, sf_dir))


@query(f"WITH {_CAS} SELECT * FROM req WHERE hash NOT IN (SELECT hash FROM a) AND hash IN (SELECT hash FROM bench)")
def read_fallback_repair(spark, sf_dir):
    return combinators.fallback_repairs(requested(spark, sf_dir), mirror(spark, sf_dir, 0), items(spark, sf_dir))


@query(f"WITH {_CAS} SELECT doc_id, CASE WHEN hash IN (SELECT hash FROM a) THEN 'a' WHEN hash IN (SELECT hash FROM b) THEN 'b' END AS served_by FROM cas")
def get_fallback_chain(spark, sf_dir):
    requests = cas(spark, sf_dir).select("doc_id", *KEY)
    return combinators.get_with_fallback(requests, [("a", mirror(spark, sf_dir, 0)), ("b", mirror(spark, sf_dir, 1))]).select("doc_id", "served_by")


@query(f"WITH {_CAS} SELECT * FROM req WHERE hash NOT IN (SELECT hash FROM a) AND hash IN (SELECT hash FROM b)")
def read_caching_fills(spark, sf_dir):
    return combinators.cache_fills(requested(spark, sf_dir), mirror(spark, sf_dir, 0), mirror(spark, sf_dir, 1))


@query(f"WITH {_CAS} SELECT * FROM req WHERE hash NOT IN (SELECT hash FROM b) AND hash IN (SELECT hash FROM cas)")
def replication_copies(spark, sf_dir):
    """What a replicator copies into a mirror, each key once."""
    plan = combinators.replication_plan(sets.without_empty(requested(spark, sf_dir)), cas(spark, sf_dir).select(*KEY).distinct(), mirror(spark, sf_dir, 1))
    return plan.select(*KEY)


# Sets ---------------------------------------------------------------------------


@query(f"WITH {_CAS} SELECT * FROM a UNION SELECT * FROM b UNION SELECT * FROM bench")
def set_union(spark, sf_dir):
    return sets.union([mirror(spark, sf_dir, 0), mirror(spark, sf_dir, 1), items(spark, sf_dir)])


@query(f"WITH {_CAS} SELECT *, CASE WHEN hash IN (SELECT hash FROM a) AND hash IN (SELECT hash FROM b) THEN 'both' WHEN hash IN (SELECT hash FROM a) THEN 'only_a' ELSE 'only_b' END AS side FROM (SELECT * FROM a UNION SELECT * FROM b)")
def set_diff_intersect(spark, sf_dir):
    return sets.difference_and_intersection(mirror(spark, sf_dir, 0), mirror(spark, sf_dir, 1))


@query(f"WITH {_CAS} SELECT instance_name, count(*) AS n, min('1-' || hash || '-' || size_bytes || '-' || instance_name) AS first_key FROM cas GROUP BY 1")
def partition_by_instance(spark, sf_dir):
    packed = digests.key(digests.function_value(F.col("function")), F.col("hash"), F.col("size_bytes"), F.col("instance_name"))
    return sets.partition_by(cas(spark, sf_dir).withColumn("key", packed), "instance_name", "key")


@query(f"WITH {_CAS} SELECT min('1-' || hash || '-' || size_bytes) AS first_key FROM cas")
def set_first(spark, sf_dir):
    packed = digests.key(digests.function_value(F.col("function")), F.col("hash"), F.col("size_bytes"))
    return sets.first(cas(spark, sf_dir).withColumn("key", packed), "key")


# Names, routes, tenants ------------------------------------------------------------


@query(f"WITH {_TENANT}, n AS (SELECT DISTINCT instance_name FROM tenant) SELECT instance_name, unnest(list_transform(range(0, len(string_split(instance_name, '/')) + 1), lambda i: array_to_string(string_split(instance_name, '/')[1:i], '/'))) AS ancestor FROM n")
def ancestors_explode(spark, sf_dir):
    return tenants(spark, sf_dir).select("instance_name").distinct().select("instance_name", F.explode(names.ancestors(F.col("instance_name"))).alias("ancestor"))


def _routes(spark):
    return spark.createDataFrame([("ASIA", "east", "asia"), ("ASIA/JAPAN", "tokyo", ""), ("EUROPE", "west", "eu/main")], "prefix string, backend string, new_prefix string")


_ROUTES = """routes(prefix, backend, new_prefix) AS (VALUES ('ASIA', 'east', 'asia'), ('ASIA/JAPAN', 'tokyo', ''), ('EUROPE', 'west', 'eu/main')),
routed AS (SELECT t.c_custkey, t.instance_name, r.backend, CASE WHEN r.prefix IS NOT NULL THEN trim(r.new_prefix || substr(t.instance_name, length(r.prefix) + 1), '/') END AS inner_name
FROM tenant t LEFT JOIN LATERAL (SELECT * FROM routes r WHERE t.instance_name = r.prefix OR starts_with(t.instance_name, r.prefix || '/') ORDER BY length(r.prefix) DESC LIMIT 1) r ON true)"""


@query(f"WITH {_TENANT}, {_ROUTES} SELECT c_custkey, backend, inner_name, CASE WHEN backend IS NULL THEN 'INVALID_ARGUMENT' ELSE 'OK' END AS code FROM routed")
def demux_route(spark, sf_dir):
    out = combinators.route(tenants(spark, sf_dir).select("c_custkey", "instance_name"), _routes(spark))
    return out.select("c_custkey", "backend", "inner_name", F.coalesce("status.code", F.lit("OK")).alias("code"))


@query(f"WITH {_TENANT}, {_ROUTES} SELECT instance_name, 'SHA256' AS function, sha256(c_custkey::VARCHAR) AS hash, length(c_custkey::VARCHAR)::BIGINT AS size_bytes FROM routed WHERE backend IS NOT NULL AND c_custkey % 4 = 0")
def demux_find_missing(spark, sf_dir):
    """Each backend holds three of four customers' objects under inner names."""
    rows = tenants(spark, sf_dir).select("c_custkey", "instance_name", F.lit("SHA256").alias("function"), digests.hash_of(F.col("c_custkey").cast("string")).alias("hash"), F.length(F.col("c_custkey").cast("string")).cast("long").alias("size_bytes"))
    held = combinators.route(rows, _routes(spark)).where("backend is not null and c_custkey % 4 <> 0").select("backend", F.col("inner_name").alias("instance_name"), *KEY)
    return combinators.route_find_missing(rows, _routes(spark), held)


def _tenant_rows(spark, sf_dir):
    """Objects 0..6 held at some level of the name tree."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    n = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    at_nation = n.select(F.concat_ws("/", "r_name", "n_name").alias("instance_name"), (F.col("n_nationkey") % 7).cast("long").alias("obj"))
    at_region = region.select(F.col("r_name").alias("instance_name"), F.col("r_regionkey").cast("long").alias("obj"))
    root = spark.range(3, 6).select(F.lit("").alias("instance_name"), F.col("id").alias("obj"))
    return at_nation.union(at_region).union(root)


_HELD = f"""{_TENANT}, held AS (SELECT r_name || '/' || n_name AS instance_name, (n_nationkey % 7)::BIGINT AS obj FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT r_name, r_regionkey::BIGINT FROM region UNION ALL SELECT '', unnest(range(3, 6))),
ask AS (SELECT c_custkey, instance_name, r_name, c_custkey % 7 AS obj FROM tenant)"""


def _asks(spark, sf_dir):
    return tenants(spark, sf_dir).select("c_custkey", "instance_name", (F.col("c_custkey") % 7).alias("obj"))


@query(f"WITH {_HELD} SELECT c_custkey, (SELECT arg_max(h.instance_name, length(h.instance_name)) FROM held h WHERE h.obj = ask.obj AND h.instance_name IN ('', ask.r_name, ask.instance_name)) AS found_at FROM ask")
def hier_most_specific(spark, sf_dir):
    return combinators.by_ancestor(_asks(spark, sf_dir), _tenant_rows(spark, sf_dir), ["obj"]).select("c_custkey", "found_at")


@query(f"WITH {_HELD} SELECT c_custkey, (SELECT arg_min(h.instance_name, length(h.instance_name)) FROM held h WHERE h.obj = ask.obj AND h.instance_name IN ('', ask.r_name, ask.instance_name)) AS found_at FROM ask")
def hier_least_specific(spark, sf_dir):
    return combinators.by_ancestor(_asks(spark, sf_dir), _tenant_rows(spark, sf_dir), ["obj"], most_specific=False).select("c_custkey", "found_at")


@query(f"WITH {_HELD} SELECT DISTINCT instance_name, obj FROM ask WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.obj = ask.obj AND h.instance_name IN ('', ask.r_name, ask.instance_name))")
def hier_find_missing(spark, sf_dir):
    return combinators.ancestors_find_missing(_asks(spark, sf_dir), _tenant_rows(spark, sf_dir), ["obj"])


# Authorization -----------------------------------------------------------------------


@query(f"WITH {_TENANT} SELECT c_custkey, instance_name FROM tenant WHERE r_name = 'ASIA' OR instance_name = 'EUROPE/FRANCE'")
def auth_prefix_filter(spark, sf_dir):
    good = spark.createDataFrame([("ASIA",), ("EUROPE/FRANCE",)], "prefix string")
    return auth.allowed_prefixes(tenants(spark, sf_dir).select("c_custkey", "instance_name"), good)


@query(f"""WITH {_TENANT}, v AS (SELECT DISTINCT instance_name, length(n_name) % 5 <> 0 AS allowed FROM tenant)
SELECT c_custkey % 50 AS request, min(CASE WHEN NOT allowed THEN instance_name END) AS denied, count(DISTINCT instance_name) AS names FROM tenant JOIN v USING (instance_name) GROUP BY 1""")
def auth_find_missing_failfast(spark, sf_dir):
    t = tenants(spark, sf_dir)
    verdicts = t.select("instance_name", (F.length("n_name") % 5 != 0).alias("allowed")).distinct()
    return auth.find_missing_failfast(t.select((F.col("c_custkey") % 50).alias("request"), "instance_name"), verdicts, "request")


@query("SELECT doc_id, CASE WHEN quality = 1 THEN 'OK' WHEN toxic = 1 THEN 'UNAVAILABLE' WHEN doc_id % 2 = 0 THEN 'OK' ELSE 'PERMISSION_DENIED' END AS code FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def auth_any_of(spark, sf_dir):
    from lodestack.functions.status import ok, status

    first = F.when(F.col("quality") == 1, ok()).otherwise(auth.deny_all())
    second = F.when(F.col("toxic") == 1, status("UNAVAILABLE", "no answer")).otherwise(auth.deny_all())
    third = F.when(F.col("doc_id") % 2 == 0, ok()).otherwise(auth.deny_all())
    rows = table(spark, sf_dir, "labels").where("quality is not null and toxic is not null")
    return rows.select("doc_id", F.coalesce(auth.any_of([first, second, third])["code"], F.lit("OK")).alias("code"))


@query("""WITH v AS (SELECT user_id, max(ts) AS seen FROM events GROUP BY 1)
SELECT event_id, CASE WHEN epoch_us(seen) + 86400000000 > (SELECT max(epoch_us(ts)) FROM events) THEN user_id % 2 = 0 END AS allowed FROM events JOIN v USING (user_id)""")
def auth_cached_verdict(spark, sf_dir):
    e = events(spark, sf_dir)
    now = e.agg(F.max("us")).first()[0]
    verdicts = e.groupBy("user_id").agg((F.max("us") + 86_400_000_000).alias("expires_at")).withColumn("allowed", F.col("user_id") % 2 == 0)
    return auth.cached_verdict(e.select("event_id", "user_id"), verdicts, "user_id", F.lit(now)).select("event_id", "allowed")


# Action results -------------------------------------------------------------------------

NOW, FLOOR, DAY = 915148800, 694224000, 86400
_EXPIRED = f"""epoch(o_orderdate) < {FLOOR} OR {NOW}::HUGEINT * 1000000000 > epoch_us(o_orderdate)::HUGEINT * 1000 + {900 * DAY}::HUGEINT * 1000000000
+ ((epoch(o_orderdate)::BIGINT::UHUGEINT * {combinators.SPREAD}::UHUGEINT) % 18446744073709551616::UHUGEINT % ({900 * DAY}::UHUGEINT * 1000000000))::HUGEINT"""


def _results(spark, sf_dir):
    return table(spark, sf_dir, "orders").withColumn("completed", F.col("o_orderdate").cast("timestamp"))


def _expired():
    return combinators.expired(F.col("completed"), NOW, FLOOR, 900 * DAY, 900 * DAY)


@query(f"SELECT o_orderkey FROM orders WHERE NOT ({_EXPIRED})")
def ac_expiring(spark, sf_dir):
    return _results(spark, sf_dir).where(~_expired()).select("o_orderkey")


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN {NOW} ELSE epoch(o_orderdate)::BIGINT END AS completed FROM orders")
def ac_timestamp_inject(spark, sf_dir):
    rows = _results(spark, sf_dir).withColumn("worker_completed_timestamp", F.when(F.col("o_orderkey") % 5 != 0, F.col("completed")))
    return stores.with_timestamp(rows, F.timestamp_seconds(F.lit(NOW))).select("o_orderkey", F.unix_seconds("worker_completed_timestamp").alias("completed"))


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part").where("p_partkey % 50 <> 0").select(F.col("p_partkey").alias("part"))


def _refs(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("part"))


_COMPLETE = "NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND (l_partkey % 50 = 0 OR NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey)))"


@query(f"SELECT o_orderkey FROM orders WHERE {_COMPLETE}")
def ac_completeness(spark, sf_dir):
    return combinators.complete(_results(spark, sf_dir), _refs(spark, sf_dir), _parts(spark, sf_dir), ["o_orderkey"], ["part"]).select("o_orderkey")


@query(f"SELECT o_orderkey FROM orders JOIN (SELECT l_orderkey, sum(l_quantity::BIGINT) AS q FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE q <= 100 AND {_COMPLETE}")
def ac_completeness_size_cap(spark, sf_dir):
    sizes = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.col("l_quantity").cast("long")).alias("sizes"))
    rows = combinators.within_tree_budget(_results(spark, sf_dir).join(sizes, "o_orderkey"), F.col("sizes"), 100)
    return combinators.complete(rows, _refs(spark, sf_dir), _parts(spark, sf_dir), ["o_orderkey"], ["part"]).select("o_orderkey")


@query(f"""WITH {_TENANT}, good AS (SELECT o_orderkey, o_custkey, o_orderkey % 40 AS action FROM orders WHERE NOT ({_EXPIRED}) AND {_COMPLETE}),
stored AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN r_name ELSE instance_name END AS at, action, max(o_orderkey) AS o_orderkey FROM good JOIN tenant ON o_custkey = c_custkey GROUP BY 1, 2),
ask AS (SELECT DISTINCT instance_name, r_name, c_custkey % 40 AS action FROM tenant)
SELECT instance_name, action, (SELECT arg_max(o_orderkey, length(s.at)) FROM stored s WHERE s.action = ask.action AND s.at IN ('', ask.r_name, ask.instance_name)) AS o_orderkey FROM ask""")
def ac_hier_complete_expiring(spark, sf_dir):
    """Candidates are filtered for expiry and completeness before the most specific one is chosen."""
    good = combinators.complete(_results(spark, sf_dir).where(~_expired()), _refs(spark, sf_dir), _parts(spark, sf_dir), ["o_orderkey"], ["part"])
    t = tenants(spark, sf_dir)
    at = F.when(F.col("o_orderkey") % 3 == 0, "").when(F.col("o_orderkey") % 3 == 1, F.col("r_name")).otherwise(F.col("instance_name"))
    stored = good.join(t, F.col("o_custkey") == F.col("c_custkey")).select(at.alias("instance_name"), (F.col("o_orderkey") % 40).alias("action"), "o_orderkey").groupBy("instance_name", "action").agg(F.max("o_orderkey").alias("o_orderkey"))
    asks = t.select("instance_name", (F.col("c_custkey") % 40).alias("action")).distinct()
    return combinators.by_ancestor(asks, stored, ["action"]).select("instance_name", "action", "o_orderkey")


# Sharding ---------------------------------------------------------------------------------

SHARDS = {"a": 1, "b": 2, "c": 4, "d": 7, "e": 1}


def _sharded(spark, sf_dir, shards):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", digests.shard_hash(digests.hash_of(F.col("o_orderkey").cast("string"))).alias("h"))
    return u64.assign_shards(rows, "h", shards).drop("h")


def _shard_sql(shards: dict[str, int], source: str) -> str:
    """Rendezvous hashing in SQL: unsigned 128-bit arithmetic, reduced modulo 2**64."""
    rows = ", ".join(f"('{k}', {w}::UHUGEINT, {h}::UHUGEINT)" for k, w, h in u64.check_shards(shards))
    lut = ", ".join(map(str, u64.LOG2))
    m = "18446744073709551616::UHUGEINT"
    mult = lambda x, c: f"((({x} // 4294967296::UHUGEINT) * {c}::UHUGEINT % 4294967296::UHUGEINT) * 4294967296::UHUGEINT + ({x} % 4294967296::UHUGEINT) * {c}::UHUGEINT) % {m}"
    return f"""s(k, w, s) AS (VALUES {rows}),
h AS ({source}),
x0 AS (SELECT id, k, w, s, xor(h, s) AS x FROM h, s),
x1 AS (SELECT id, k, w, s, xor(x, x // {1 << 30}::UHUGEINT) AS x FROM x0),
x2 AS (SELECT id, k, w, s, {mult('x', u64.MULTIPLIERS[0])} AS x FROM x1),
x3 AS (SELECT id, k, w, s, xor(x, x // {1 << 27}::UHUGEINT) AS x FROM x2),
x4 AS (SELECT id, k, w, s, {mult('x', u64.MULTIPLIERS[1])} AS x FROM x3),
x5 AS (SELECT id, k, w, s, xor(x, x // {1 << 31}::UHUGEINT) AS x FROM x4),
x6 AS (SELECT *, CASE WHEN x < 2 THEN 0 ELSE length(ltrim(bin(x // 2::UHUGEINT), '0')) END AS msb FROM x5),
x7 AS (SELECT *, CASE WHEN msb = 0 THEN 0::UHUGEINT ELSE (x % (list_transform(range(0, 65), lambda i: (2::DOUBLE ** i)::UHUGEINT))[msb + 1]) * (list_transform(range(0, 65), lambda i: (2::DOUBLE ** i)::UHUGEINT))[65 - msb] END AS bf FROM x6),
x8 AS (SELECT *, (bf // {1 << 58}::UHUGEINT)::BIGINT AS i, (bf % {1 << 58}::UHUGEINT) * 64::UHUGEINT // 65536::UHUGEINT AS t FROM x7),
x9 AS (SELECT *, msb::UHUGEINT * 65536::UHUGEINT + [{lut}][i + 1]::UHUGEINT + ([{lut}][i + 2] - [{lut}][i + 1])::UHUGEINT * t // {1 << 48}::UHUGEINT AS lg FROM x8),
assigned AS (SELECT id, arg_max(k, (w * 4294967296::UHUGEINT // (4194304::UHUGEINT - lg), -(s::HUGEINT))) AS shard FROM x9 GROUP BY id)"""


_ORDER_HASH = "SELECT o_orderkey AS id, (('0x' || substr(sha256(o_orderkey::VARCHAR), 1, 8))::BIGINT::UHUGEINT * 4294967296::UHUGEINT + ('0x' || substr(sha256(o_orderkey::VARCHAR), 9, 8))::BIGINT::UHUGEINT) AS h FROM orders"


@query(f"WITH {_shard_sql(SHARDS, _ORDER_HASH)} SELECT id AS o_orderkey, shard FROM assigned")
def shard_assign(spark, sf_dir):
    return _sharded(spark, sf_dir, SHARDS)


@query(f"WITH {_shard_sql(SHARDS, _ORDER_HASH)} SELECT shard, count(*) AS n FROM assigned GROUP BY 1")
def shard_balance(spark, sf_dir):
    return metrics.counters(_sharded(spark, sf_dir, SHARDS), ["shard"])


@query(f"WITH {_shard_sql(SHARDS, _ORDER_HASH)} SELECT shard AS was, count(*) AS n FROM assigned WHERE shard = 'c' GROUP BY 1")
def shard_stability(spark, sf_dir):
    """Keys that move when a shard goes, by their former shard: only its own."""
    rows = table(spark, sf_dir, "orders").select(digests.shard_hash(digests.hash_of(F.col("o_orderkey").cast("string"))).alias("h"))
    both = u64.assign_shards(u64.assign_shards(rows, "h", SHARDS, "was"), "h", {k: w for k, w in SHARDS.items() if k != "c"}, "now")
    return metrics.counters(both.where("was <> now"), ["was"])


# Digests and paths ----------------------------------------------------------------------------


@query("SELECT doc_id, md5(text) AS hash FROM documents")
def digest_md5(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", digests.hash_of("text", "MD5").alias("hash"))


@query("SELECT doc_id, sha1(text) AS hash FROM documents")
def digest_sha1(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", digests.hash_of("text", "SHA1").alias("hash"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def digest_sha256(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", digests.hash_of("text", "SHA256").alias("hash"))


@query()
def digest_sha384_sha512(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", digests.hash_of("text", "SHA384").alias("sha384"), digests.hash_of("text", "SHA512").alias("sha512"))


@query("SELECT doc_id, sha1(encode('blob ' || octet_length(encode(text))) || '\\x00'::BLOB || encode(text)) AS hash FROM documents")
def digest_gitsha1(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", digests.hash_of("text", "GITSHA1").alias("hash"))


@query("SELECT function, count(*) AS n FROM (SELECT unnest(['MD5', 'SHA1', 'SHA256', NULL]) AS function FROM documents) GROUP BY 1")
def digest_infer_function(spark, sf_dir):
    t = F.col("text")
    hashes = F.explode(F.array(F.md5(t.cast("binary")), F.sha1(t.cast("binary")), F.sha2(t.cast("binary"), 256), F.lit("abc"))).alias("h")
    return metrics.counters(table(spark, sf_dir, "documents").select(hashes).select(digests.infer_function(F.col("h")).alias("function")), ["function"])


@query(f"WITH {_CAS} SELECT doc_id, instance_name, 'SHA256' AS function, hash, size_bytes, 'zstd' AS compressor FROM cas")
def bytestream_path_roundtrip(spark, sf_dir):
    path = digests.read_path(F.col("instance_name"), F.col("function"), F.col("hash"), F.col("size_bytes"), "zstd")
    p = digests.parse_read_path(F.col("path"))
    return cas(spark, sf_dir).withColumn("path", path).select("doc_id", p["instance"].alias("instance_name"), p["function"].alias("function"), p["hash"].alias("hash"), p["size"].alias("size_bytes"), p["compressor"].alias("compressor"))


@query(f"WITH {_CAS} SELECT doc_id, instance_name || '/uploads/u' || doc_id || '/blobs/' || hash || '/' || size_bytes AS path, hash, size_bytes FROM cas")
def bytestream_write_path(spark, sf_dir):
    path = digests.write_path(F.col("instance_name"), F.concat(F.lit("u"), F.col("doc_id").cast("string")), F.col("function"), F.col("hash"), F.col("size_bytes"))
    p = digests.parse_write_path(F.col("path"))
    return cas(spark, sf_dir).withColumn("path", path).select("doc_id", "path", p["hash"].alias("hash"), p["size"].alias("size_bytes"))


@query()
def index_slots(spark, sf_dir):
    """FNV-1a slots of the location index for each key's first attempt."""
    packed = digests.key(digests.function_value(F.col("function")), F.col("hash"), F.col("size_bytes"))
    slot = binary.fnv1a_hex(binary.slot_key(F.sha2(packed.cast("binary"), 256), F.lit(0)))
    return cas(spark, sf_dir).select("doc_id", slot.alias("slot"))


@query("SELECT page_id, length(url) - length(replace(url, '/', '')) AS slashes, url NOT LIKE '%//%' AS plain FROM pages")
def url_shape(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", (F.length(u) - F.length(F.replace(u, F.lit("/"), F.lit("")))).cast("long").alias("slashes"), (~u.contains("//")).alias("plain"))


@query("SELECT p_partkey, '/' || lower(p_brand) || '/../' || p_size || '/' AS path FROM part")
def path_normalise(spark, sf_dir):
    raw = F.concat(F.lit("/.././/"), F.lower("p_brand"), F.lit("/./../"), F.col("p_size").cast("string"), F.lit("//."))
    return table(spark, sf_dir, "part").select("p_partkey", paths.normalise(raw).alias("path"))


@query(f"WITH {_CAS} SELECT doc_id, (size_bytes + 999) // 1000 AS chunks FROM cas")
def chunked_read(spark, sf_dir):
    return cas(spark, sf_dir).select("doc_id", F.size(binary.chunks(F.col("data"), 1000)).cast("long").alias("chunks"))


@query("SELECT code, http FROM (VALUES ('OK', 200), ('CANCELED', 499), ('UNKNOWN', 500), ('NOT_FOUND', 404), ('ABORTED', 409), ('UNAVAILABLE', 503), ('UNAUTHENTICATED', 401)) t(code, http)")
def status_to_http(spark, sf_dir):
    codes = spark.createDataFrame([(c,) for c in ("OK", "CANCELED", "UNKNOWN", "NOT_FOUND", "ABORTED", "UNAVAILABLE", "UNAUTHENTICATED")], "code string")
    return codes.select("code", http_status(F.col("code")).alias("http"))


# Graphs and composites ----------------------------------------------------------------------------


def _edges(spark, sf_dir):
    s = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    n, c, o = (table(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    edge = lambda df, a, b: df.select(a.alias("parent"), b.alias("child"))
    return edge(n, s("r", "n_regionkey"), s("n", "n_nationkey")).union(edge(c, s("n", "c_nationkey"), s("c", "c_custkey"))).union(edge(o, s("c", "o_custkey"), s("o", "o_orderkey")))


_EDGES = """edges AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders),
reach AS (SELECT 'r1' AS node UNION SELECT child FROM reach JOIN edges ON parent = node)"""


@query(f"WITH RECURSIVE {_EDGES} SELECT node FROM reach")
def nested_closure(spark, sf_dir):
    return graph.closure(spark.createDataFrame([("r1",)], "node string"), _edges(spark, sf_dir))


@query(f"WITH RECURSIVE {_EDGES} SELECT node FROM reach WHERE node NOT IN (SELECT 'o' || o_orderkey FROM orders WHERE o_orderkey % 2 = 0)")
def nested_copy_plan(spark, sf_dir):
    sink = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node"))
    return graph.copy_plan(spark.createDataFrame([("r1",)], "node string"), _edges(spark, sf_dir), sink)


@query("SELECT l_orderkey AS tree, CASE WHEN count(DISTINCT l_linenumber) < max(l_linenumber) - min(l_linenumber) + 1 THEN 'missing child' WHEN min(l_linenumber) > 1 THEN 'unexpected directory' END AS problem FROM lineitem GROUP BY 1")
def tree_order(spark, sf_dir):
    """Line items as a chain of directories: each names the next number as its child."""
    rows = graph.by_tree(table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("int").alias("n")), "l_orderkey")
    last = F.max("n").over(Window.partitionBy("l_orderkey"))
    dirs = rows.distinct().withColumn("last", last).select(F.col("l_orderkey").alias("tree"), (F.col("n") - 1).alias("position"), F.col("n").cast("string").alias("hash"), F.when(F.col("n") < F.col("last"), F.array((F.col("n") + 1).cast("string"))).otherwise(F.array().cast("array<string>")).alias("children"))
    return graph.tree_status(dirs)


@query(f"WITH {_CAS} SELECT doc_id, sha256(encode(text)[1:10]) AS head FROM cas WHERE size_bytes >= 20")
def composite_slices(spark, sf_dir):
    """The first ten bytes of each document as a child, read out of its parent."""
    rows = cas(spark, sf_dir).where("size_bytes >= 20")
    head = F.substr("data", F.lit(1), F.lit(10))
    parents = rows.select("doc_id", *KEY, head.alias("head"))
    slicer = F.array(F.struct(digests.hash_of(F.col("head")).alias("hash"), F.lit(10).cast("long").alias("size_bytes"), F.lit(0).cast("long").alias("offset_bytes")))
    index = stores.slices(parents.dropDuplicates(KEY), slicer).select("parent_hash", "hash", "size_bytes", "offset_bytes")
    pairs = parents.select("doc_id", F.col("hash").alias("parent_hash"), digests.hash_of(F.col("head")).alias("hash"))
    got = stores.get_from_composite(pairs, index, rows.dropDuplicates(KEY))
    return got.select("doc_id", digests.hash_of(F.col("data")).alias("head"))


# Metrics ----------------------------------------------------------------------------------------------

_POW2 = metrics.powers_of_two(33)
_DECIMAL = metrics.decimal_buckets(-3, 6, 2)


@query(f"WITH {_CAS} SELECT instance_name, b AS le, count(CASE WHEN size_bytes <= b THEN 1 END) AS n, count(*) AS count, sum(size_bytes)::BIGINT AS sum FROM cas, (SELECT unnest({_POW2})::DOUBLE AS b) GROUP BY 1, 2")
def size_histogram_pow2(spark, sf_dir):
    return metrics.histogram(cas(spark, sf_dir).select("instance_name", "size_bytes"), ["instance_name"], "size_bytes", _POW2)


@query(f"SELECT event_type, b AS le, count(CASE WHEN value <= b THEN 1 END) AS n, count(value) AS count, sum(round(value * 1000)::BIGINT)::BIGINT AS sum FROM events, (SELECT unnest({_DECIMAL})::DOUBLE AS b) GROUP BY 1, 2")
def duration_histogram_decimal(spark, sf_dir):
    return metrics.histogram(table(spark, sf_dir, "events"), ["event_type"], "value", _DECIMAL, 1000)


@query("SELECT event_type, user_id % 10 AS pool, count(*) AS n FROM events GROUP BY 1, 2")
def counters_by_label(spark, sf_dir):
    return metrics.counters(table(spark, sf_dir, "events").withColumn("pool", F.col("user_id") % 10), ["event_type", "pool"])


@query("SELECT user_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1")
def last_value_gauge(spark, sf_dir):
    return metrics.gauge(table(spark, sf_dir, "events"), ["user_id"], "value", ["ts", "event_id"])


@query("SELECT event_type AS name, count(*) AS n FROM events WHERE regexp_matches(event_type, '^(sign|pur)') GROUP BY 1")
def metric_name_filter(spark, sf_dir):
    rows = metrics.counters(table(spark, sf_dir, "events").select(F.col("event_type").alias("name")), ["name"])
    return metrics.named(rows, "^(sign|pur)")


@query("""WITH r AS (SELECT s_nationkey AS g, ['MD5', 'SHA1', 'SHA256'][1:(s_suppkey % 3 + 1)::INT] AS f, [2, s_suppkey % 3, 0] AS low, [2, 3 + s_suppkey % 4, s_suppkey % 12] AS high, [1, s_suppkey % 2, 0] AS dep FROM supplier)
SELECT g, array_to_string(list_sort(list_distinct(flatten(list(f)))), ',') AS functions, array_to_string(max(low), '.') AS low, array_to_string(min(high), '.') AS high, array_to_string(max(dep), '.') AS deprecated FROM r GROUP BY 1""")
def capability_merge(spark, sf_dir):
    k = F.col("s_suppkey")
    dots = lambda *c: F.concat_ws(".", *[x.cast("string") for x in c])
    known = F.array(F.lit("MD5"), F.lit("SHA1"), F.lit("SHA256"))
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("g"), F.slice(known, F.lit(1), (k % 3 + 1).cast("int")).alias("functions"), dots(F.lit(2), k % 3, F.lit(0)).alias("low"), dots(F.lit(2), 3 + k % 4, k % 12).alias("high"), dots(F.lit(1), k % 2, F.lit(0)).alias("deprecated"))
    return metrics.merge_capabilities(rows, "g").withColumn("functions", F.array_join("functions", ","))


@query("""WITH e AS (SELECT user_id, event_type AS message, min(event_id) AS seen FROM events WHERE event_type <> 'view' GROUP BY 1, 2)
SELECT user_id, upper(arg_min(message, seen)) AS code, string_agg(message, ', ' ORDER BY seen) AS message FROM e GROUP BY 1""")
def error_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("event_type <> 'view'").select("user_id", "event_id", F.col("event_type").alias("message"), F.upper("event_type").alias("code"))
    return metrics.merge_errors(rows, "user_id", "event_id")


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, sum(l_quantity::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS r, l_quantity::BIGINT AS q FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice))
SELECT l_orderkey, count(*) AS n, sum(q)::BIGINT AS total, min(CASE WHEN r > 100 THEN l_linenumber END) AS failed_at FROM s GROUP BY 1""")
def batch_budget(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")).alias("m")).select("l_orderkey", "l_linenumber", F.col("m.l_quantity").cast("long").alias("q"))
    return stores.batch_budget(rows, "l_orderkey", "l_linenumber", "q", 100)


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, k ORDER BY o_orderkey DESC) AS rn FROM (SELECT o_custkey, o_orderkey, length(o_orderpriority)::INT AS k, o_orderstatus AS outcome, round(o_totalprice)::BIGINT AS d FROM orders))
SELECT o_custkey, k, count(*) AS runs, sum(d)::BIGINT AS total, arg_max(outcome, o_orderkey) AS last FROM r WHERE rn <= 3 GROUP BY 1, 2""")
def iscc_stats_pack(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.length("o_orderpriority").alias("k"), F.col("o_orderstatus").alias("outcome"), F.round("o_totalprice").cast("long").alias("d"))
    packed = metrics.pack_executions(rows, ["o_custkey"], "k", "o_orderkey", "outcome", "d", 3)
    each = packed.select("o_custkey", F.explode("size_classes").alias("k", "runs"))
    return each.select("o_custkey", "k", F.size("runs").cast("long").alias("runs"), F.aggregate("runs", F.lit(0).cast("long"), lambda a, x: a + x["duration"]).alias("total"), F.element_at("runs", -1)["outcome"].alias("last"))


# Time-stateful operators ----------------------------------------------------------------------------------

_ORDERED = "o AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"


@query(f"""WITH RECURSIVE {_ORDERED}, f AS (SELECT user_id, event_id, n, us AS ins, 'miss' AS answer FROM o WHERE n = 1 UNION ALL
SELECT o.user_id, o.event_id, o.n, CASE WHEN f.ins >= o.us - {DAY * 10**6} THEN f.ins ELSE o.us END, CASE WHEN f.ins >= o.us - {DAY * 10**6} THEN 'hit' ELSE 'miss' END FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1)
SELECT event_id, answer FROM f""")
def existence_cache_ttl(spark, sf_dir):
    return folds.fold(events(spark, sf_dir), "user_id", "us", "event_id", folds.existence_step(DAY * 10**6)).select("event_id", "answer")


@query(f"""WITH RECURSIVE {_ORDERED}, f AS (SELECT user_id, event_id, n, 1 AS left_, us + {5 * DAY * 10**6} AS stop, 'sampled' AS answer FROM o WHERE n = 1 UNION ALL
SELECT o.user_id, o.event_id, o.n, CASE WHEN f.left_ > 0 THEN f.left_ - 1 WHEN o.us >= f.stop THEN 1 ELSE f.left_ END, CASE WHEN f.left_ <= 0 AND o.us >= f.stop THEN o.us + {5 * DAY * 10**6} ELSE f.stop END, CASE WHEN f.left_ > 0 OR o.us >= f.stop THEN 'sampled' ELSE 'dropped' END FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1)
SELECT event_id, answer FROM f""")
def rate_sampler(spark, sf_dir):
    return folds.fold(events(spark, sf_dir), "user_id", "us", "event_id", folds.sampler_step(2, 5 * DAY * 10**6)).select("event_id", "answer")


@query(f"""WITH RECURSIVE {_ORDERED}, f AS (SELECT user_id, event_id, n, event_type <> 'error' AS healthy, us + {DAY * 10**6} AS stop, CASE WHEN event_type <> 'error' THEN 'canary' ELSE 'canary_retried_on_source' END AS answer FROM o WHERE n = 1 UNION ALL
SELECT o.user_id, o.event_id, o.n, CASE WHEN o.us >= f.stop THEN o.event_type <> 'error' ELSE f.healthy END, CASE WHEN o.us >= f.stop THEN o.us + {DAY * 10**6} ELSE f.stop END,
CASE WHEN o.us < f.stop THEN CASE WHEN f.healthy THEN 'replica' ELSE 'source' END WHEN o.event_type <> 'error' THEN 'canary' ELSE 'canary_retried_on_source' END FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1)
SELECT event_id, answer FROM f""")
def canary_state(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("failed", (F.col("event_type") == "error").cast("int"))
    return folds.fold(rows, "user_id", "us", "event_id", folds.canary_step(DAY * 10**6), "failed").select("event_id", "answer")


@query(f"""WITH RECURSIVE {_ORDERED}, f AS (SELECT user_id, event_id, n, us + {10**9} * (event_id % 100) AS stop, 'asked' AS answer FROM o WHERE n = 1 UNION ALL
SELECT o.user_id, o.event_id, o.n, CASE WHEN f.stop > o.us THEN f.stop ELSE o.us + {10**9} * (o.event_id % 100) END, CASE WHEN f.stop > o.us THEN 'cached' ELSE 'asked' END FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1)
SELECT event_id, answer FROM f""")
def response_cache(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("lifetime", F.lit(10**9) * (F.col("event_id") % 100))
    return folds.fold(rows, "user_id", "us", "event_id", folds.expiring_step(), "lifetime").select("event_id", "answer")


@query()
def lru_evictions(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("store", F.col("user_id") % 16)
    return folds.cache_simulation(rows, "store", "user_id", "us", "event_id", 4)


@query()
def fifo_evictions(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("store", F.col("user_id") % 16)
    return folds.cache_simulation(rows, "store", "user_id", "us", "event_id", 4, "FIFO")


@query(f"WITH {_CAS} SELECT * FROM req WHERE hash NOT IN (SELECT hash FROM a)")
def replicate_once(spark, sf_dir):
    return folds.replicate_once(sets.without_empty(requested(spark, sf_dir)), mirror(spark, sf_dir, 0), KEY)


@query(f"""WITH v AS (SELECT arg_max(event_type <> 'error', (ts, event_id)) AS healthy, max(epoch_us(ts)) AS seen, user_id FROM events WHERE user_id % 3 <> 0 GROUP BY user_id)
SELECT event_id, CASE WHEN seen IS NULL OR seen + {30 * DAY * 10**6} <= (SELECT max(epoch_us(ts)) FROM events) THEN 'canary' WHEN healthy THEN 'replica' ELSE 'source' END AS backend FROM events LEFT JOIN v USING (user_id)""")
def canary_route(spark, sf_dir):
    """Requests by the verdict that their tenant's last event left."""
    e = events(spark, sf_dir)
    now = e.agg(F.max("us")).first()[0]
    health = e.where("user_id % 3 <> 0").groupBy("user_id").agg(F.max_by(F.col("event_type") != "error", F.struct("ts", "event_id")).alias("healthy"), (F.max("us") + 30 * DAY * 10**6).alias("expires_at"))
    rows = e.select("event_id", F.col("user_id").alias("instance_name"))
    return combinators.canary_route(rows, health.withColumnRenamed("user_id", "instance_name"), F.lit(now)).select("event_id", "backend")


# Sources, documents, tokens, plans -------------------------------------------------------------------------


@query("SELECT page_id, sha256(encode(html)[11:]) AS hash, 'OK' AS code FROM pages UNION ALL SELECT -1 - page_id, sha256(url), 'NOT_FOUND' FROM pages WHERE page_id % 10 = 0")
def reference_expand_range(spark, sf_dir):
    """Pages as a medium: a reference leaves out their first ten bytes."""
    p = table(spark, sf_dir, "pages").withColumn("content", F.col("html").cast("binary"))
    cut = binary.byte_range(F.col("content"), F.lit(10), F.lit(0))
    wanted = p.select("page_id", digests.hash_of(cut).alias("hash"), digests.size_of(cut).alias("size_bytes"), "url")
    refs = wanted.select("hash", F.lit("http").alias("medium"), F.concat_ws("#", "url", "page_id").alias("location"), F.lit(10).alias("offset_bytes"), F.lit(0).alias("length"), F.lit("identity").alias("decompressor")).dropDuplicates(["hash"])
    media = p.select(F.lit("http").alias("medium"), F.concat_ws("#", "url", "page_id").alias("location"), "content")
    absent = p.where("page_id % 10 = 0").select((-1 - F.col("page_id")).alias("page_id"), digests.hash_of("url").alias("hash"), F.lit(1).cast("long").alias("size_bytes"))
    got = references.expand(wanted.drop("url").unionByName(absent), refs, media)
    return got.select("page_id", "hash", F.coalesce("status.code", F.lit("OK")).alias("code"))


@query(f"WITH {_CAS} SELECT '1-' || hash || '-' || size_bytes AS key, hash FROM cas GROUP BY ALL")
def zip_roundtrip(spark, sf_dir):
    """Blobs into archives and back, hashed again."""
    packed = digests.key(digests.function_value(F.col("function")), F.col("hash"), F.col("size_bytes")).alias("key")
    rows = cas(spark, sf_dir).dropDuplicates(KEY).select(packed, "data")
    return archives.read_zip(archives.write_zip(rows)).select("key", digests.hash_of(F.col("data")).alias("hash"))


@query("SELECT event_id, props->>'$.k' AS k, event_type || ' ' || (props->>'$.k') AS label FROM events WHERE (props->>'$.k')::INT > 50")
def document_filter_project(spark, sf_dir):
    k = documents.field(F.col("props"), "k")
    rows = table(spark, sf_dir, "events").where(k.cast("int") > 50)
    return rows.select("event_id", k.alias("k"), documents.join(" ", F.col("event_type"), k).alias("label"))


@query("SELECT event_id, (props->>'$.k') = '7' AS allowed FROM events")
def document_authorize(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", documents.allowed(documents.field(F.col("props"), "k") == "7").alias("allowed"))


def _b64(c):
    return F.translate(F.replace(F.base64(c.cast("binary")), F.lit("\r\n"), F.lit("")), "+/=", "-_")


@query(f"SELECT o_orderkey, (epoch(o_orderdate)::BIGINT <= {NOW - 90_000_000}) AND ({NOW - 90_000_000} < epoch(o_orderdate)::BIGINT + 8640000) AS valid FROM orders")
def jwt_claims_window(spark, sf_dir):
    """Tokens made of orders: not before their date, for a hundred days."""
    at = F.unix_seconds("completed")
    claims = F.to_json(F.struct(F.col("o_orderkey").alias("sub"), at.alias("nbf"), (at + 8640000).alias("exp")))
    header = F.concat(F.lit("Bearer "), _b64(F.lit('{"alg":"HS256"}')), F.lit("."), _b64(claims), F.lit(".c2ln"))
    rows = _results(spark, sf_dir).withColumn("token", tokens.parse(header))
    return rows.select("o_orderkey", tokens.in_window(F.col("token"), F.lit(NOW - 90_000_000)).alias("valid"))


_PLAN = {
    "with_labels": {
        "labels": {"pair": {"mirrored": {"backend_a": {"local": "a"}, "backend_b": {"local": "bench"}}}},
        "backend": {"read_fallback": {"primary": {"label": "pair"}, "secondary": {"local": "even"}}},
    }
}


@query(f"WITH {_CAS} SELECT * FROM req WHERE hash NOT IN (SELECT hash FROM a) AND hash NOT IN (SELECT hash FROM cas WHERE doc_id % 2 = 0) AND hash NOT IN (SELECT hash FROM bench)")
def planned_find_missing(spark, sf_dir):
    """A store described as data: two mirrors, and even documents as a fallback."""
    even = cas(spark, sf_dir).where("doc_id % 2 = 0").dropDuplicates(KEY)
    tables = {"a": mirror(spark, sf_dir, 0), "bench": items(spark, sf_dir), "even": even}
    return build(_PLAN, tables).find_missing(sets.without_empty(requested(spark, sf_dir)))


@query(f"WITH {_CAS} SELECT * FROM req WHERE hash NOT IN (SELECT hash FROM a)")
def sharded_find_missing(spark, sf_dir):
    """The same mirror asked through five shards."""
    plan = {"sharding": {k: {"weight": w, "backend": {"local": "a"}} for k, w in SHARDS.items()}}
    return build(plan, {"a": mirror(spark, sf_dir, 0)}).find_missing(sets.without_empty(requested(spark, sf_dir)))


@query("SELECT event_id, (props->>'$.k')::INT AS k FROM events")
def typed_decode(spark, sf_dir):
    """The log's documents, read as messages of a fixed shape."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("props").cast("binary").alias("data"), F.expr("cast(null as struct<code:string,message:string>)").alias("status"))
    return stores.typed(rows, "k int").select("event_id", F.col("message.k").alias("k"))


@query("SELECT DISTINCT 'SHA256' AS function, sha256(p_name || p_brand) AS hash, octet_length(encode(p_name || p_brand))::BIGINT AS size_bytes FROM part")
def content_put(spark, sf_dir):
    """Values stored under the key of their own bytes."""
    values = table(spark, sf_dir, "part").select(F.concat("p_name", "p_brand").alias("v"))
    return stores.content_rows(values, "v").select(*KEY).distinct()


@query("SELECT DISTINCT user_id FROM events")
def access_profile_bloom(spark, sf_dir):
    """File access profiles: each tenant's filter holds all paths that it has opened."""
    rows = table(spark, sf_dir, "events").select("user_id", F.concat_ws("/", "event_type", F.col("event_id").cast("string")).alias("path"))
    made = binary.access_profiles(rows, ["user_id"], "path", 8191, 3)
    has = binary.bloom_has(F.col("bloom_filter"), F.col("bloom_filter_hash_functions"), F.col("path"))
    met = rows.join(made.withColumnRenamed("user_id", "tenant"), F.col("user_id").eqNullSafe(F.col("tenant")))
    return met.groupBy("user_id").agg(F.bool_and(has).alias("held")).where("held").select("user_id")


@query("SELECT count(DISTINCT (o_orderpriority, o_custkey % 7)) AS n FROM orders")
def reduced_action_digest(spark, sf_dir):
    """Actions that differ in command and platform only where their digests do."""
    platform = F.create_map(F.lit("os"), F.col("o_orderpriority"), F.lit("arch"), (F.col("o_custkey") % 7).cast("string"))
    return table(spark, sf_dir, "orders").select(digests.reduced_action(F.lit("c"), platform).alias("d")).distinct().agg(F.count(F.lit(1)).alias("n"))


# Single operators ---------------------------------------------------------------------------------------------


@query(f"WITH {_CAS} SELECT doc_id, 0::BIGINT AS bytes, 'OK' AS code FROM cas WHERE doc_id % 4 = 0 UNION ALL SELECT doc_id, size_bytes, 'OK' FROM cas WHERE doc_id % 4 <> 0 AND hash IN (SELECT hash FROM a) UNION ALL SELECT doc_id, NULL, 'NOT_FOUND' FROM cas WHERE doc_id % 4 <> 0 AND hash NOT IN (SELECT hash FROM a)")
def empty_blob_source(spark, sf_dir):
    """Reads of which every fourth asks for the empty blob, whatever the store holds."""
    void = digests.hash_of(F.lit(b""))
    fourth = F.col("doc_id") % 4 == 0
    requests = cas(spark, sf_dir).select("doc_id", "function", F.when(fourth, void).otherwise(F.col("hash")).alias("hash"), F.when(fourth, F.lit(0)).otherwise(F.col("size_bytes")).cast("long").alias("size_bytes"))
    got = stores.with_empty(stores.get(requests, mirror(spark, sf_dir, 0)))
    return got.select("doc_id", digests.size_of("data").alias("bytes"), F.coalesce("status.code", F.lit("OK")).alias("code"))


@query("SELECT doc_id, 'UNAVAILABLE' AS code, 503 AS http FROM documents")
def error_source(spark, sf_dir):
    got = stores.failing(cas(spark, sf_dir).select("doc_id", *KEY), "UNAVAILABLE", "Storage is being moved")
    return got.select("doc_id", F.col("status.code").alias("code"), http_status(F.col("status.code")).alias("http"))


@query("SELECT doc_id, 'INVALID_ARGUMENT' AS code FROM documents")
def read_only_sink(spark, sf_dir):
    return stores.read_only(cas(spark, sf_dir)).select("doc_id", F.col("status.code").alias("code"))


@query("SELECT page_id, NOT (starts_with(n, '/') OR ends_with(n, '/') OR contains(n, '//')) AS valid FROM (SELECT page_id, regexp_replace(url, '^https?:', '') || CASE WHEN page_id % 2 = 0 THEN '' ELSE '/' END AS m, CASE WHEN page_id % 3 = 0 THEN substr(regexp_replace(url, '^https?:', ''), 3) ELSE regexp_replace(url, '^https?:', '') END AS n FROM pages)")
def name_validation(spark, sf_dir):
    """Addresses as tenant names: two in three begin with slashes."""
    rest = F.regexp_replace("url", "^https?:", "")
    name = F.when(F.col("page_id") % 3 == 0, F.substr(rest, F.lit(3))).otherwise(rest)
    return table(spark, sf_dir, "pages").select("page_id", names.is_valid(name).alias("valid"))


@query("SELECT s_suppkey, array_to_string(list_filter(['MD5', 'SHA1', 'SHA256'], lambda x: list_contains(['SHA256', 'NEW', 'MD5'][1:(s_suppkey % 3 + 1)::INT], x)), ',') AS functions FROM supplier")
def supported_functions(spark, sf_dir):
    reported = F.slice(F.array(F.lit("SHA256"), F.lit("NEW"), F.lit("MD5")), F.lit(1), (F.col("s_suppkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(digests.supported(["MD5", "SHA1", "SHA256"], reported), ",").alias("functions"))


@query("SELECT p_partkey, 'bytes=' || p_size || '-' || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE (p_size + p_partkey % 5 - 1)::VARCHAR END AS header FROM part")
def range_headers(spark, sf_dir):
    size = (F.col("p_partkey") % 5).cast("int")
    return table(spark, sf_dir, "part").select("p_partkey", binary.range_header(F.col("p_size"), size).alias("header"))


@query("SELECT doc_id, lower('01' || sha256(text) || CASE WHEN 2 * n < 128 THEN printf('%02x', 2 * n) WHEN 2 * n < 16384 THEN printf('%02x%02x', 2 * n % 128 + 128, 2 * n // 128) ELSE printf('%02x%02x%02x', 2 * n % 128 + 128, 2 * n // 128 % 128 + 128, 2 * n // 16384) END) AS compact FROM (SELECT doc_id, text, octet_length(encode(text)) AS n FROM documents)")
def compact_digests(spark, sf_dir):
    return cas(spark, sf_dir).select("doc_id", F.lower(F.hex(digests.compact(digests.function_value(F.col("function")), F.col("hash"), F.col("size_bytes")))).alias("compact"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def compressed_roundtrip(spark, sf_dir):
    """Blobs packed by a codec (alternating) and read back through decompression."""
    rows = cas(spark, sf_dir)
    odd = rows.where("doc_id % 2 = 1").withColumn("data", binary.decompress(binary.compress(F.col("data"), "deflate"), "deflate"))
    even = rows.where("doc_id % 2 = 0").withColumn("data", binary.decompress(binary.compress(F.col("data"), "zstd"), "zstd"))
    return odd.unionByName(even).select("doc_id", digests.hash_of("data").alias("hash"))


@query(f"WITH {_CAS} SELECT doc_id, CASE WHEN hash IN (SELECT hash FROM a) THEN 'OK' ELSE 'INTERNAL' END AS code FROM cas")
def absent_after_copy(spark, sf_dir):
    got = combinators.replicated(stores.get(cas(spark, sf_dir).select("doc_id", *KEY), mirror(spark, sf_dir, 0)))
    return got.select("doc_id", F.coalesce("status.code", F.lit("OK")).alias("code"))


@query("SELECT event_id, 'while serving ' || event_type || ': ' || user_id AS message FROM events WHERE event_type = 'error'")
def status_wrap(spark, sf_dir):
    from lodestack.functions.status import status, wrap

    s = wrap(status("UNKNOWN", F.col("user_id").cast("string")), "while serving error", "INTERNAL")
    return table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", s["message"].alias("message"))


@query("SELECT user_id, user_id % 4 <> 3 AS valid FROM (SELECT DISTINCT user_id FROM events)")
def token_signatures(spark, sf_dir):
    """HMAC tokens by key id: none, two known ones, and one that no key has."""
    import base64
    import hashlib
    import hmac

    keys = {"k1": b"one", "k2": b"two"}

    @F.pandas_udf("string")
    def sign(u: pd.Series) -> pd.Series:
        enc = lambda b: base64.urlsafe_b64encode(b).rstrip(b"=").decode()

        def one(n: int) -> str:
            kid = [None, "k1", "k2", "k9"][n % 4]
            head = '{"alg":"HS256"' + (f',"kid":"{kid}"' if kid else "") + "}"
            signed = f"{enc(head.encode())}.{enc(b'{}')}"
            return f"Bearer {signed}." + enc(hmac.new(keys.get(kid, b"one"), signed.encode(), hashlib.sha256).digest())

        return u.map(one)

    rows = table(spark, sf_dir, "events").select("user_id").distinct().withColumn("token", tokens.parse(sign(F.col("user_id"))))
    return rows.select("user_id", tokens.hmac_valid(F.col("token"), keys).alias("valid"))


@query(f"""WITH RECURSIVE {_ORDERED}, f AS (SELECT user_id, event_id, n, us AS ins, true AS copied FROM o WHERE n = 1 UNION ALL
SELECT o.user_id, o.event_id, o.n, CASE WHEN f.ins >= o.us - {DAY * 10**6} THEN f.ins ELSE o.us END, NOT (f.ins >= o.us - {DAY * 10**6}) FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1)
SELECT user_id, count(*) FILTER (WHERE copied) AS copies, count(*) AS requests FROM f GROUP BY 1""")
def queued_replication(spark, sf_dir):
    """Requests of a queue that copies a key only if it has not been seen within a day."""
    seen = folds.fold(events(spark, sf_dir), "user_id", "us", "event_id", folds.existence_step(DAY * 10**6))
    return seen.groupBy("user_id").agg(F.count(F.when(F.col("answer") == "miss", 1)).alias("copies"), F.count(F.lit(1)).alias("requests"))


@query("SELECT page_id, page_id % 3 = 0 AS pass_through FROM pages")
def reference_pass_through(spark, sf_dir):
    """References into the store itself that only change the tenant."""
    rows = table(spark, sf_dir, "pages").select("page_id", digests.hash_of("url").alias("hash"), F.when(F.col("page_id") % 3 == 0, digests.hash_of("url")).otherwise("elsewhere").alias("location"), F.lit("cas").alias("medium"), F.lit("identity").alias("decompressor"))
    return references.is_identity(rows).select("page_id", "pass_through")


@query("SELECT n_nationkey, n_name FROM nation")
def state_reopened(spark, sf_dir):
    """State written in two versions and opened again: the newest one."""
    path = f"{shared_dir(spark)}/lodestack/state-{uuid.uuid4().hex}"
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    state.save(nation.limit(3), path, 1)
    state.save(nation, path, 2)
    return state.latest(spark, path)


@query("SELECT n_nationkey, 1 AS field, n_name AS value FROM nation UNION ALL SELECT n_nationkey, 2, n_nationkey::VARCHAR FROM nation")
def message_field_visitor(spark, sf_dir):
    """Field ranges of messages made of two strings each."""
    part = lambda tag, c: F.concat(F.lit(bytes([tag])), F.unhex(F.lpad(F.hex(F.octet_length(c).cast("long")), 2, "0")), c.cast("binary"))
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(part(0x0A, F.col("n_name")), part(0x12, F.col("n_nationkey").cast("string"))).alias("message"))
    each = rows.select("n_nationkey", "message", F.explode(binary.message_fields(F.col("message"))).alias("f"))
    return each.select("n_nationkey", F.col("f.field").alias("field"), F.substr("message", (F.col("f.offset") + 1).cast("int"), F.col("f.size").cast("int")).cast("string").alias("value"))


@query(ORACLE["rate_sampler"])
def stream_sampler(spark, sf_dir):
    """The rate sampler over the log as a stream that ends with its files."""
    log = events(spark, sf_dir).select(F.col("user_id").cast("string").alias("user"), "us", "event_id")
    base = f"{shared_dir(spark)}/lodestack/stream-{uuid.uuid4().hex}"
    log.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(log.schema).parquet(f"{base}/in")
    out = folds.fold_stream(stream, "user", "us", "event_id", folds.sampler_step(2, 5 * DAY * 10**6), 2)
    run = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{base}/out").select("event_id", "answer")


# Plans that read ------------------------------------------------------------------


def _tenanted(spark, sf_dir, side: int):
    return cas(spark, sf_dir).where(F.col("doc_id") % 3 != side).select("instance_name", *KEY, "data").dropDuplicates(["instance_name", *KEY])


def _asked(spark, sf_dir):
    return cas(spark, sf_dir).select("doc_id", "instance_name", *KEY)


def _codes(rows: DataFrame, *more: str) -> DataFrame:
    """What a read answered: its code, and whether the bytes are the key's."""
    return rows.select("doc_id", *more, F.coalesce("status.code", F.lit("OK")).alias("code"), F.coalesce(F.sha2("data", 256) == F.col("hash"), F.lit(False)).alias("sound"))


def _code_sql(ok: str, extra: str = "") -> str:
    return f"SELECT doc_id, {extra}CASE WHEN {ok} THEN 'OK' ELSE 'NOT_FOUND' END AS code, coalesce({ok}, false) AS sound FROM cas"


_IN = "hash IN (SELECT hash FROM a) OR hash IN (SELECT hash FROM bench) OR hash IN (SELECT hash FROM cas WHERE doc_id % 2 = 0)"


@query(f"WITH {_CAS} {_code_sql(_IN)}")
def planned_get(spark, sf_dir):
    """Reads through two mirrors and a fallback."""
    even = cas(spark, sf_dir).where("doc_id % 2 = 0").dropDuplicates(KEY)
    tables = {"a": mirror(spark, sf_dir, 0), "bench": items(spark, sf_dir).dropDuplicates(KEY), "even": even}
    return _codes(build(_PLAN, tables).get(_asked(spark, sf_dir).drop("instance_name")))


@query(f"WITH {_CAS} {_code_sql('hash IN (SELECT hash FROM a)')}")
def sharded_get(spark, sf_dir):
    """Reads through five shards over one table: each blob comes once."""
    plan = {"sharding": {k: {"weight": w, "backend": {"local": "a"}} for k, w in SHARDS.items()}}
    return _codes(build(plan, {"a": mirror(spark, sf_dir, 0)}).get(_asked(spark, sf_dir).drop("instance_name")))


_DEMUX = """t AS (SELECT DISTINCT doc_id % 3 AS m, instance_name, hash FROM cas), k AS (SELECT cas.*, split_part(instance_name, '/', 1) AS top,
EXISTS (SELECT 1 FROM t WHERE t.instance_name = cas.instance_name AND t.hash = cas.hash AND m <> 0) AS in0, EXISTS (SELECT 1 FROM t WHERE t.instance_name = cas.instance_name AND t.hash = cas.hash AND m <> 1) AS in1 FROM cas)"""


@query(f"""WITH {_CAS}, {_DEMUX} SELECT doc_id, CASE WHEN top NOT IN ('en', 'de') THEN 'INVALID_ARGUMENT' WHEN (top = 'en' AND in0) OR (top = 'de' AND in1) THEN 'OK' ELSE 'NOT_FOUND' END AS code,
(top = 'en' AND in0) OR (top = 'de' AND in1) AS sound FROM k""")
def demux_get(spark, sf_dir):
    """Reads by tenant from the backend of the longest prefix, under rewritten names."""
    inner = _tenanted(spark, sf_dir, 1).withColumn("instance_name", names.patch(F.col("instance_name"), F.lit("de"), F.lit("x/y")))
    plan = {"demultiplexing": {"en": {"backend": {"local": "t0"}}, "de": {"backend": {"local": "t1"}, "new_prefix": "x/y"}}}
    return _codes(build(plan, {"t0": _tenanted(spark, sf_dir, 0), "t1": inner}).get(_asked(spark, sf_dir)))


@query(f"""WITH {_CAS}, {_DEMUX} SELECT doc_id, CASE WHEN top = 'en' THEN 'UNAVAILABLE' WHEN top <> 'de' THEN 'INVALID_ARGUMENT' WHEN in0 OR in1 THEN 'OK' ELSE 'NOT_FOUND' END AS code, top = 'de' AND (in0 OR in1) AS sound FROM k""")
def error_stops_fallback(spark, sf_dir):
    """A fallback is asked for what is not found, never for what failed."""
    plan = {"read_fallback": {"primary": {"demultiplexing": {"en": {"backend": {"error": {"code": "UNAVAILABLE", "message": "down"}}}, "de": {"backend": {"local": "t0"}}}}, "secondary": {"local": "t1"}}}
    return _codes(build(plan, {"t0": _tenanted(spark, sf_dir, 0), "t1": _tenanted(spark, sf_dir, 1)}).get(_asked(spark, sf_dir)))


_HELD = "held AS (SELECT DISTINCT CASE WHEN doc_id % 2 = 0 THEN split_part(instance_name, '/', 1) ELSE instance_name END AS holder, hash FROM cas WHERE doc_id % 3 <> 0)"
_VISIBLE = "EXISTS (SELECT 1 FROM held WHERE held.hash = cas.hash AND (holder = instance_name OR starts_with(instance_name, holder || '/')))"


def _held(spark, sf_dir):
    top = F.element_at(F.split("instance_name", "/"), 1)
    return cas(spark, sf_dir).where("doc_id % 3 <> 0").withColumn("instance_name", F.when(F.col("doc_id") % 2 == 0, top).otherwise(F.col("instance_name")))


@query(f"WITH {_CAS}, {_HELD} {_code_sql(_VISIBLE)}")
def hier_get(spark, sf_dir):
    """Reads see what the tenant or an ancestor holds, and no other tenant's blobs."""
    held = _held(spark, sf_dir).select("instance_name", *KEY, "data").dropDuplicates(["instance_name", *KEY])
    return _codes(build({"hierarchical_instance_names": {"local": "t"}}, {"t": held}).get(_asked(spark, sf_dir)))


@query(f"WITH {_CAS}, {_HELD} SELECT doc_id, CASE WHEN size_bytes = 0 OR {_VISIBLE} THEN 'OK' ELSE 'NOT_FOUND' END AS code, coalesce(size_bytes = 0 OR {_VISIBLE}, false) AS sound, (SELECT min_by(holder, length(holder)) FROM held WHERE held.hash = cas.hash AND (holder = instance_name OR starts_with(instance_name, holder || '/'))) AS found_at FROM cas")
def hier_cas_get(spark, sf_dir):
    """Grants make a tenant see the canonical blob; the least specific one counts."""
    rows = _held(spark, sf_dir)
    return _codes(stores.get_hierarchical(_asked(spark, sf_dir), rows.select("instance_name", *KEY).distinct(), rows.select(*KEY, "data").dropDuplicates(KEY)), "found_at")


_NEXT = "r AS (SELECT c.doc_id, c.hash, CASE WHEN c.doc_id % 10 <> 0 THEN n.hash END AS ref, n.size_bytes AS ref_size FROM cas c JOIN cas n ON n.doc_id = c.doc_id + 1)"
_LACKING = "SELECT hash FROM r WHERE ref IS NULL OR (ref_size <> 0 AND ref NOT IN (SELECT hash FROM a))"


@query(f"WITH {_CAS}, {_NEXT} {_code_sql(f'hash NOT IN ({_LACKING})')}")
def planned_completeness(spark, sf_dir):
    """Results whose references are malformed or missing are not found; empty ones always exist."""
    rows = cas(spark, sf_dir)
    after = rows.select((F.col("doc_id") - 1).alias("doc_id"), "function", F.when(F.col("doc_id") % 10 != 1, F.col("hash")).alias("hash"), "size_bytes")
    refs = rows.select("doc_id", *[F.col(k).alias(f"result_{k}") for k in KEY]).join(after, "doc_id").drop("doc_id")
    plan = {"completeness_checking": {"backend": {"local": "results"}, "content": {"local": "a"}, "references": "refs"}}
    return _codes(build(plan, {"results": rows.select(*KEY, "data").dropDuplicates(KEY), "a": mirror(spark, sf_dir, 0), "refs": refs}).get(_asked(spark, sf_dir).drop("instance_name")))


@query(f"WITH {_CAS} SELECT hash, CASE WHEN min(doc_id) % 2 = 0 THEN 5 ELSE 90 END AS seen_at, min(doc_id) % 2 = 1 OR hash IN (SELECT hash FROM a) AS known FROM cas WHERE size_bytes <> 0 GROUP BY hash")
def existence_cache_join(spark, sf_dir):
    """Keys seen lately are not asked for; the others are remembered if present."""
    first = cas(spark, sf_dir).where("size_bytes <> 0").groupBy(*KEY).agg(F.min("doc_id").alias("first"))
    seen = first.select(*KEY, F.when(F.col("first") % 2 == 0, 5).otherwise(90).cast("long").alias("seen_at"))
    missing, after = combinators.existence_cached(first, seen, mirror(spark, sf_dir, 0), now=100, ttl=20)
    gone = missing.withColumn("gone", F.lit(True))
    out = seen.join(gone, KEY, "left").join(after.select(*KEY, F.lit(True).alias("kept")), KEY, "left")
    return out.select("hash", F.col("seen_at").cast("int").alias("seen_at"), (F.col("kept").isNotNull() & F.col("gone").isNull()).alias("known"))


_FIRST = "f AS (SELECT hash, min(doc_id) AS first FROM cas GROUP BY hash), k AS (SELECT cas.*, first FROM cas LEFT JOIN f USING (hash))"


def _first(spark, sf_dir) -> DataFrame:
    """Each key once, with the least document that has it."""
    return cas(spark, sf_dir).groupBy(*KEY).agg(F.min("doc_id").alias("first"), F.min_by("data", "doc_id").alias("data"))


def _spoilt(data: Column) -> Column:
    return F.when(F.col("first") % 4 == 1, F.concat(data, F.lit(b"x"))).otherwise(data)


@query(f"WITH {_CAS}, {_FIRST}, g AS (SELECT doc_id, CASE WHEN size_bytes = 0 THEN 'OK' WHEN first IS NULL OR first % 3 = 0 THEN 'NOT_FOUND' WHEN first % 4 = 1 THEN 'INTERNAL' ELSE 'OK' END AS code FROM k) SELECT doc_id, code, code = 'OK' AS sound FROM g")
def planned_wrappers(spark, sf_dir):
    """Empty blobs exist whatever the store holds; others are checked on their way out."""
    held = _first(spark, sf_dir).where("first % 3 <> 0").withColumn("data", _spoilt(F.col("data")))
    return _codes(build({"empty_blobs": {"validating": {"local": "t"}}}, {"t": held}).get(_asked(spark, sf_dir)))


@query(f"WITH {_CAS}, {_FIRST}, g AS (SELECT doc_id, CASE WHEN size_bytes = 0 THEN 'OK' WHEN first IS NULL OR first % 3 = 0 OR first % 5 = 0 THEN 'NOT_FOUND' WHEN first % 4 = 1 THEN 'INTERNAL' ELSE 'OK' END AS code FROM k) SELECT doc_id, code, code = 'OK' AS sound FROM g")
def planned_references(spark, sf_dir):
    """Reads through references into another medium: some lost, some to lost or changed bytes."""
    rows, at = _first(spark, sf_dir), F.col("first").cast("string").alias("location")
    refs = rows.where("first % 5 <> 0").select("hash", F.lit("disk").alias("medium"), at, F.lit(2).cast("long").alias("offset_bytes"), F.lit(0).cast("long").alias("length"), F.lit("identity").alias("decompressor"))
    media = rows.where("first % 3 <> 0").select(F.lit("disk").alias("medium"), at, F.concat(F.lit(b"ab"), _spoilt(F.col("data"))).alias("content"))
    return _codes(build({"empty_blobs": {"reference_expanding": {"references": "refs", "media": "media"}}}, {"refs": refs, "media": media}).get(_asked(spark, sf_dir)))


_T0, _VALID, _JITTER = 1_700_000_000, 86_400, 3_600


@query(f"""WITH {_CAS}, {_FIRST}, t AS (SELECT doc_id, hash, CASE WHEN first % 5 <> 0 THEN {_T0} + first * 1000 END AS t FROM k),
g AS (SELECT doc_id, CASE WHEN hash IS NULL OR coalesce(t < {_T0 + 20_000} OR {(_T0 + 150_000) * 10**9} > (t + {_VALID})::HUGEINT * 1000000000 + (t::HUGEINT * {combinators.SPREAD} % {2**64}) % {_JITTER * 10**9}, false) THEN 'NOT_FOUND' ELSE 'OK' END AS code FROM t)
SELECT doc_id, code, code = 'OK' AS sound FROM g""")
def planned_expiring(spark, sf_dir):
    """Results past their validity and jitter, or older than the floor, are not found."""
    rows = _first(spark, sf_dir)
    done = rows.select(*KEY, F.when(F.col("first") % 5 != 0, F.timestamp_seconds(F.col("first") * 1000 + _T0)).alias("worker_completed_timestamp"))
    plan = {"action_result_expiring": {"backend": {"local": "t"}, "completed": "done", "now": _T0 + 150_000, "floor": _T0 + 20_000, "validity": _VALID, "jitter": _JITTER}}
    return _codes(build(plan, {"t": rows, "done": done}).get(_asked(spark, sf_dir)))


@query(f"WITH {_CAS}, {_FIRST} SELECT DISTINCT hash, CASE WHEN EXISTS (SELECT 1 FROM a WHERE a.hash = k.hash) THEN 'remembered' ELSE 'missing' END AS answer FROM k WHERE size_bytes <> 0 AND first % 2 = 0")
def planned_existence_caching(spark, sf_dir):
    """Keys seen lately are not asked for; what the others answered, and what is remembered of it."""
    rows = _first(spark, sf_dir).where("size_bytes <> 0")
    seen = rows.select(*KEY, F.when(F.col("first") % 2 == 0, 5).otherwise(90).cast("long").alias("seen_at"))
    node = build({"existence_caching": {"backend": {"local": "a"}, "seen": "seen", "now": 100, "ttl": 20}}, {"a": mirror(spark, sf_dir, 0), "seen": seen})
    asked = cas(spark, sf_dir).where("size_bytes <> 0").select(*KEY)
    return node.find_missing(asked).select("hash", F.lit("missing").alias("answer")).unionByName(node.effects["remembered"](asked).select("hash", F.lit("remembered").alias("answer")))


@query(f"""WITH {_CAS}, {_DEMUX}, w AS (SELECT *, length(instance_name) AS n FROM k),
g AS (SELECT *, CASE WHEN n % 4 = 3 OR n % 3 = 2 THEN 'canary' WHEN n % 3 = 0 THEN 'replica' ELSE 'source' END AS way, CASE WHEN top = 'en' THEN 'UNAVAILABLE' WHEN top <> 'de' THEN 'INVALID_ARGUMENT' WHEN in0 THEN 'OK' ELSE 'NOT_FOUND' END AS far FROM w),
h AS (SELECT doc_id, CASE WHEN way = 'source' OR (way = 'canary' AND far = 'UNAVAILABLE') THEN CASE WHEN in1 THEN 'OK' ELSE 'NOT_FOUND' END ELSE far END AS code FROM g) SELECT doc_id, code, code = 'OK' AS sound FROM h""")
def planned_canarying(spark, sf_dir):
    """A tenant's state names replica or source; a canary that finds the replica down is read from the source."""
    n = F.length("instance_name")
    health = cas(spark, sf_dir).select("instance_name").distinct().where(n % 4 != 3).select("instance_name", (n % 3 != 1).alias("healthy"), F.when(n % 3 == 2, 50).otherwise(200).alias("expires_at"))
    replica = {"demultiplexing": {"en": {"backend": {"error": {"code": "UNAVAILABLE", "message": "down"}}}, "de": {"backend": {"local": "t0"}}}}
    plan = {"read_canarying": {"source": {"local": "t1"}, "replica": replica, "health": "health", "now": 100}}
    return _codes(build(plan, {"t0": _tenanted(spark, sf_dir, 0), "t1": _tenanted(spark, sf_dir, 1), "health": health}).get(_asked(spark, sf_dir)))


# Nulls, bad input and several functions ---------------------------------------------


@query(f"WITH {_shard_sql(SHARDS, _ORDER_HASH)} SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN shard END AS shard FROM orders LEFT JOIN assigned ON id = o_orderkey")
def shard_assign_nulls(spark, sf_dir):
    """Keys without a hash have no shard and change nobody else's."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 11 != 0, digests.shard_hash(F.sha2(F.col("o_orderkey").cast("string").cast("binary"), 256))).alias("h"))
    return u64.assign_shards(rows, "h", SHARDS).drop("h")


_NULLED = "o AS (SELECT CASE WHEN event_id % 7 <> 0 THEN user_id + 9007199254740992 END AS user_id, event_id, epoch_us(ts) AS us FROM events), o2 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS n FROM o)"


@query(f"""WITH RECURSIVE {_NULLED}, f AS (SELECT user_id, event_id, n, us AS ins, 'miss' AS answer FROM o2 WHERE n = 1 UNION ALL
SELECT o.user_id, o.event_id, o.n, CASE WHEN f.ins >= o.us - {DAY * 10**6} THEN f.ins ELSE o.us END, CASE WHEN f.ins >= o.us - {DAY * 10**6} THEN 'hit' ELSE 'miss' END FROM f JOIN o2 o ON o.user_id IS NOT DISTINCT FROM f.user_id AND o.n = f.n + 1)
SELECT event_id, answer FROM f""")
def existence_cache_null_keys(spark, sf_dir):
    """Null keys are one key, and leave keys beyond 2**53 apart."""
    rows = events(spark, sf_dir).withColumn("user_id", F.when(F.col("event_id") % 7 != 0, F.col("user_id") + F.lit(2**53)))
    return folds.fold(rows, "user_id", "us", "event_id", folds.existence_step(DAY * 10**6)).select("event_id", "answer")


@query(f"WITH {_CAS} SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'UNIMPLEMENTED' WHEN doc_id % 5 = 0 THEN 'INVALID_ARGUMENT' ELSE 'OK' END AS code FROM cas WHERE text IS NOT NULL")
def mixed_functions_put(spark, sf_dir):
    """An upload of rows by several digest functions: each is judged by its own."""
    data = F.col("text").cast("binary")
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", data.alias("data"), digests.size_of("text").alias("size_bytes"), F.when(F.col("doc_id") % 7 == 0, "BLAKE3").when(F.col("doc_id") % 2 == 0, "MD5").otherwise("SHA256").alias("function"))
    wrong = F.when(F.col("doc_id") % 5 == 0, F.concat(F.col("data"), F.lit(b"x"))).otherwise(F.col("data"))
    rows = rows.withColumn("hash", F.coalesce(digests.hash_by(F.col("function"), wrong), F.repeat(F.lit("0"), F.lit(64))))
    _, judged = stores.put(rows, mirror(spark, sf_dir, 0))
    return judged.select("doc_id", F.coalesce("status.code", F.lit("OK")).alias("code"))


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'a/b' WHEN 5 THEN '' END AS instance, CASE WHEN doc_id % 6 IN (0, 5) THEN sha256(doc_id::VARCHAR) END AS hash FROM documents""")
def parse_bad_paths(spark, sf_dir):
    """Paths with other letters, redundant slashes, reserved names or lengths are none."""
    h, n = F.sha2(F.col("doc_id").cast("string").cast("binary"), 256), F.col("doc_id") % 6
    path = F.when(n == 0, F.concat(F.lit("a/b/blobs/"), h, F.lit("/5"))).when(n == 1, F.concat(F.lit("blobs/"), F.repeat(F.lit("Z"), F.lit(64)), F.lit("/5"))).when(n == 2, F.concat(F.lit("a//b/blobs/"), h, F.lit("/5")))
    path = path.when(n == 3, F.concat(F.lit("uploads/x/blobs/"), h, F.lit("/5"))).when(n == 4, F.lit("blobs/blake3/abc/5")).otherwise(F.concat(F.lit("blobs/"), h, F.lit("/9")))
    got = digests.parse_read_path(path)
    return table(spark, sf_dir, "documents").select("doc_id", got["instance"].alias("instance"), got["hash"].alias("hash"))


@query("SELECT doc_id, doc_id % 5 = 0 AS parsed, doc_id % 5 = 0 AS valid FROM documents")
def tokens_malformed(spark, sf_dir):
    """Headers that are no base64, no UTF-8 or unsigned are denied, row by row."""
    part = lambda s: F.translate(F.rtrim(F.base64(s), F.lit("=")), "+/", "-_")
    head, claims = part(F.lit(b'{"alg":"HS256"}')), part(F.concat(F.lit(b'{"exp":'), F.col("doc_id").cast("string").cast("binary"), F.lit(b"}")))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(".", head, claims).alias("signed"))

    @F.udf("string")
    def sign(s: str) -> str:
        import base64
        import hashlib
        import hmac

        return base64.urlsafe_b64encode(hmac.new(b"key", s.encode(), hashlib.sha256).digest()).rstrip(b"=").decode()

    n = F.col("doc_id") % 5
    header = F.when(n == 0, F.concat(F.lit("Bearer "), F.col("signed"), F.lit("."), sign("signed"))).when(n == 1, F.concat(F.lit("Bearer a."), F.split("signed", r"\.")[1], F.lit(".a")))
    header = header.when(n == 2, F.lit("Bearer _w.__8.QQ")).when(n == 3, F.lit("Basic dXNlcg==")).otherwise(F.lit("Bearer e30"))
    token = tokens.parse(header)
    return docs.select("doc_id", token.isNotNull().alias("parsed"), F.coalesce(tokens.hmac_valid(token, {None: b"key"}), F.lit(False)).alias("valid"))


@query("SELECT 0::BIGINT AS n")
def state_empty_version(spark, sf_dir):
    """The newest committed version counts, also when it is empty; one without its mark does not."""
    path = f"{shared_dir(spark)}/lodestack/state-{uuid.uuid4().hex}"
    r = table(spark, sf_dir, "region").select("r_regionkey")
    state.save(r, path, 1)
    state.save(r.limit(0), path, 2)
    state.save(r, path, 10)
    delete(spark, f"{path}/version=10/_SUCCESS")
    return state.latest(spark, path).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_CAS} SELECT doc_id, function, hash, size_bytes FROM cas WHERE text IS NOT NULL")
def digest_uncompact(spark, sf_dir):
    """Compact digests read back."""
    rows = cas(spark, sf_dir).where("data is not null")
    back = digests.uncompact(digests.compact(digests.function_value(F.col("function")), F.col("hash"), F.col("size_bytes")))
    return rows.select("doc_id", back.alias("d")).select("doc_id", "d.*")
