"""Stores described as data: a nested dict becomes a node over DataFrames.

Names of the nodes are those of the store configurations that the combinators
mirror. A node answers ``find_missing`` and ``get`` by asking its children, and
lists its ``effects`` (rows that a run would write). Catalyst plans what comes out;
this module only composes. Nodes below ``demultiplexing`` and
``hierarchical_instance_names`` are asked with ``instance_name`` beside the key.
A store that fails answers reads with its status, and fails the job that asks it
for missing keys.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions import names, u64
from lodestack.functions.digests import shard_hash
from lodestack.functions.status import status
from lodestack.operators import combinators, stores
from lodestack.operators.sets import KEY, union
from lodestack.session import written
from lodestack.sources import references


@dataclass
class Node:
    """A store: how it is asked for missing keys and for bytes (``data``, ``status`` beside
    each request), what reads of it would write, and what it holds if it is one table."""

    missing: Callable[[DataFrame], DataFrame]
    read: Callable[[DataFrame], DataFrame]
    effects: dict = field(default_factory=dict)
    held: DataFrame | None = None

    def find_missing(self, requests: DataFrame) -> DataFrame:
        return self.missing(requests)

    def get(self, requests: DataFrame) -> DataFrame:
        return self.read(requests)

    def present(self, requests: DataFrame) -> DataFrame:
        """Requested keys that the store has."""
        keys = requests.select(*KEY).distinct()
        return keys.join(self.find_missing(keys), KEY, "left_anti")


def _key(df: DataFrame) -> list[str]:
    return [c for c in ("instance_name", *KEY) if c in df.columns]


def _absent() -> Column:
    return F.coalesce(F.col("status.code") == "NOT_FOUND", F.lit(False))


def _then(rows: DataFrame, other: Node) -> DataFrame:
    """What one store answers NOT_FOUND, the other is asked for; other errors stay."""
    rows = written(rows, "plan-reads")
    return rows.where(~_absent()).unionByName(other.get(rows.where(_absent()).drop("data", "status")).select(rows.columns))


def _local(t: DataFrame) -> Node:
    def keyed(r: DataFrame) -> list[str]:  # a table without tenants is asked by the bare key
        return [c for c in _key(r) if c in t.columns]

    return Node(lambda r: stores.find_missing(r, t, keyed(r)) if set(keyed(r)) == set(_key(r)) else r.select(*_key(r)).distinct().join(t.select(*keyed(r)), keyed(r), "left_anti"), lambda r: stores.get(r, t, keyed(r)), held=t)


def build(spec: dict, tables: dict[str, DataFrame], labels: dict[str, Node] | None = None) -> Node:
    """The node of ``spec``: a dict with one key, the kind.

    Unknown kinds, tables and labels, and labels that shadow others, are errors
    before anything runs.
    """
    labels = labels or {}
    if len(spec) != 1:
        raise ValueError(f"INVALID_ARGUMENT: a node has one kind, not {sorted(spec)}")
    (kind, v), = spec.items()
    sub = lambda s: build(s, tables, labels)
    if kind in ("local", "zip_reading"):  # a table, or the entries that sources.archives reads
        if v not in tables:
            raise ValueError(f"INVALID_ARGUMENT: unknown table {v!r}")
        n = _local(tables[v])
        return n if kind == "local" else Node(n.missing, lambda r: stores.checked(n.get(r)), held=n.held)
    if kind == "label":
        if v not in labels:
            raise ValueError(f"INVALID_ARGUMENT: undeclared label {v!r}")
        return labels[v]
    if kind == "with_labels":
        if again := set(v["labels"]) & set(labels):
            raise ValueError(f"INVALID_ARGUMENT: labels declared twice: {sorted(again)}")
        own = dict(labels)
        for name, s in v["labels"].items():
            own[name] = build(s, tables, own)
        return build(v["backend"], tables, own)
    if kind == "error":
        code, message = (v["code"], v.get("message", "")) if isinstance(v, dict) else (str(v), "")
        fails = F.raise_error(F.lit(f"{code}: {message}"))
        return Node(lambda r: r.select(*_key(r)).where(fails.isNull()), lambda r: stores.failing(r, code, message), {"status": v})
    if kind == "mirrored":
        a, b = sub(v["backend_a"]), sub(v["backend_b"])

        def repairs(r: DataFrame) -> DataFrame:
            r = r.select(*_key(r)).distinct()
            gone_a, gone_b = written(a.find_missing(r), "plan-missing"), written(b.find_missing(r), "plan-missing")
            ways = [gone_b.join(gone_a, gone_a.columns, "left_anti").withColumn("direction", F.lit("a_to_b")), gone_a.join(gone_b, gone_a.columns, "left_anti").withColumn("direction", F.lit("b_to_a"))]
            return ways[0].unionByName(ways[1])

        return Node(lambda r: b.find_missing(a.find_missing(r)), lambda r: _then(a.get(r), b), {"repairs": repairs})
    if kind == "read_fallback":
        p, s = sub(v["primary"]), sub(v["secondary"])
        lost = lambda r: p.find_missing(r).join(s.find_missing(p.find_missing(r)), _key(r), "left_anti")
        return Node(lambda r: s.find_missing(p.find_missing(r)), lambda r: _then(p.get(r), s), {"repairs": lost})
    if kind == "read_caching":
        fast, slow = sub(v["fast"]), sub(v["slow"])
        fills = lambda r: fast.find_missing(r).join(slow.find_missing(fast.find_missing(r)), _key(r), "left_anti")
        return Node(slow.find_missing, lambda r: _then(fast.get(r), slow), {"fills": fills})
    if kind == "read_canarying":
        source, replica, health = sub(v["source"]), sub(v["replica"]), tables[v["health"]]

        def read(r: DataFrame) -> DataFrame:
            way = f"__route{len(r.columns)}"  # carried beside the request; routes may be nested
            by = written(combinators.canary_route(r, health, F.lit(v["now"])).withColumnRenamed("backend", way), "plan-routes")
            tried = written(replica.get(by.where(F.col(way) != "source")), "plan-reads")
            # a canary that fails by infrastructure is read from the source
            again = (F.col(way) == "canary") & F.coalesce(~combinators.canary_verdict(F.col("status")), F.lit(False))
            back = source.get(by.where(F.col(way) == "source").drop(way).unionByName(tried.where(again).select(r.columns)))
            out = tried.where(~again).drop(way)
            return out.unionByName(back.select(out.columns))

        return Node(source.find_missing, read)
    if kind == "existence_caching":
        n, seen = sub(v["backend"]), tables[v["seen"]]
        fresh = seen.where(F.col("seen_at") >= v["now"] - v["ttl"])
        ask = lambda r: r.select(*_key(r)).distinct().join(fresh.select(*_key(r)), _key(r), "left_anti")
        remembered = lambda r: ask(r).join(n.find_missing(ask(r)), _key(r), "left_anti").withColumn("seen_at", F.lit(v["now"]).cast("long"))
        return Node(lambda r: n.find_missing(ask(r)), n.get, {"remembered": remembered})
    if kind == "completeness_checking":
        n, cas = sub(v["backend"]), sub(v["content"])
        refs, own = tables[v["references"]], [f"result_{k}" for k in KEY]

        def read(r: DataFrame) -> DataFrame:
            rows = written(n.get(r), "plan-reads")
            asked = refs.join(rows.where("status is null").select(*[F.col(k).alias(f"result_{k}") for k in KEY]).distinct(), own, "left_semi")
            broken = F.greatest(*[F.col(k).isNull() for k in KEY])
            gone = cas.find_missing(asked.where(~broken).where("size_bytes <> 0").select(*KEY))
            bad = asked.join(gone, KEY, "left_semi").select(*own).unionByName(asked.where(broken).select(*own)).distinct()
            bad = bad.select(*[F.col(f"result_{k}").alias(k) for k in KEY], F.lit(True).alias("__bad"))
            lost = status("NOT_FOUND", "Object is incomplete")
            out = rows.join(bad, KEY, "left").withColumn("status", F.when(F.col("__bad") & F.col("status").isNull(), lost).otherwise(F.col("status")))
            return out.withColumn("data", F.when(F.col("__bad").isNull(), F.col("data"))).drop("__bad").select(rows.columns)

        return Node(n.find_missing, read)
    if kind == "action_result_expiring":
        n, times = sub(v["backend"]), tables[v["completed"]].select(*KEY, F.col("worker_completed_timestamp").alias("__t"))

        def read(r: DataFrame) -> DataFrame:
            rows = n.get(r).join(times, KEY, "left")
            gone = combinators.expired(F.col("__t"), v["now"], v["floor"], v["validity"], v["jitter"]) & F.col("status").isNull()
            out = rows.withColumn("data", F.when(~gone, F.col("data"))).withColumn("status", F.when(gone, status("NOT_FOUND", "Object expired")).otherwise(F.col("status")))
            return out.drop("__t")

        return Node(n.find_missing, read)
    if kind == "reference_expanding":
        refs, media = tables[v["references"]], tables[v["media"]]
        lost = lambda r: r.select(*_key(r)).distinct().join(refs.select("hash"), "hash", "left_anti").select(*_key(r))
        return Node(lost, lambda r: references.expand(r, refs, media))
    if kind == "empty_blobs":
        n = sub(v)
        some = lambda r: r.where(F.coalesce(F.col("size_bytes") != 0, F.lit(True)))

        def read(r: DataFrame) -> DataFrame:
            got = n.get(some(r))
            return got.unionByName(stores.with_empty(stores.failing(r.where("size_bytes = 0"), "NOT_FOUND", stores.NOT_FOUND)).select(got.columns))

        return Node(lambda r: n.find_missing(some(r)), read)
    if kind == "validating":
        n = sub(v)
        return Node(n.find_missing, lambda r: stores.checked(n.get(r)))
    if kind == "sharding":
        nodes = {k: sub(s["backend"]) for k, s in v.items()}
        weights = {k: s["weight"] for k, s in v.items()}
        u64.check_shards(weights)
        deal = lambda r: u64.assign_shards(r.withColumn("__h", shard_hash(F.col("hash"))), "__h", weights).drop("__h")
        tagged = lambda columns: union([n.held.select(F.lit(k).alias("shard"), *columns) for k, n in nodes.items()], ["shard", *columns])
        plain = all(n.held is not None for n in nodes.values())  # one join on shard and key, not one a shard

        def missing(r: DataFrame) -> DataFrame:
            dealt = deal(r.select(*_key(r)).distinct())
            if plain and _key(r) == list(KEY):
                return stores.find_missing(dealt, tagged(KEY), ["shard", *KEY]).drop("shard")
            dealt = written(dealt, "plan-shards")
            return union([nodes[k].find_missing(dealt.where(F.col("shard") == k).drop("shard")) for k in nodes], _key(r))

        def read(r: DataFrame) -> DataFrame:
            if plain and _key(r) == list(KEY):
                return stores.get(deal(r), tagged([*KEY, "data"]), ["shard", *KEY]).drop("shard")
            dealt = written(deal(r), "plan-shards")
            return _together([nodes[k].get(dealt.where(F.col("shard") == k).drop("shard")) for k in nodes])

        return Node(missing, read)
    if kind == "hierarchical_instance_names":
        n = sub(v)

        def tries(r: DataFrame) -> DataFrame:
            """Each request under its tenant and all ancestors."""
            return r.withColumn("__own", F.col("instance_name")).withColumn("instance_name", F.explode(names.ancestors(F.col("__own"))))

        def missing(r: DataFrame) -> DataFrame:
            asked = written(tries(r.select("instance_name", *KEY).distinct()), "plan-tenants")
            gone = n.find_missing(asked.select("instance_name", *KEY).distinct())
            found = asked.join(gone, ["instance_name", *KEY], "left_anti").select(F.col("__own").alias("instance_name"), *KEY).distinct()
            return r.select("instance_name", *KEY).distinct().join(found, ["instance_name", *KEY], "left_anti")

        def read(r: DataFrame) -> DataFrame:
            """The nearest ancestor that answers other than NOT_FOUND."""
            asked = written(tries(r.select("instance_name", *KEY).distinct()), "plan-tenants")
            got = n.get(asked)
            order = Window.partitionBy("__own", *KEY).orderBy(_absent(), F.desc(names.depth(F.col("instance_name"))))
            best = got.withColumn("__r", F.row_number().over(order)).where("__r = 1").select(F.col("__own").alias("instance_name"), *KEY, "data", "status", F.lit(True).alias("__met"))
            met = r.join(best, ["instance_name", *KEY], "left")  # keys with nulls meet nothing
            return met.select(*r.columns, "data", F.when(F.col("__met").isNull(), status("NOT_FOUND", stores.NOT_FOUND)).otherwise(F.col("status")).alias("status"))

        return Node(missing, read)
    if kind == "demultiplexing":
        nodes = {prefix: sub(s["backend"]) for prefix, s in v.items()}

        def routed(r: DataFrame) -> DataFrame:
            routes = r.sparkSession.createDataFrame([(p, p, s.get("new_prefix", p)) for p, s in v.items()], "prefix string, backend string, new_prefix string")
            return written(combinators.route(r, routes), "plan-routes")

        def own(dealt: DataFrame, prefix: str, columns: list[str]) -> DataFrame:
            rows = dealt.where(F.col("backend") == prefix).withColumn("__outer", F.col("instance_name")).withColumn("instance_name", F.col("inner_name"))
            return rows.select("__outer", *columns)

        def missing(r: DataFrame) -> DataFrame:
            keys = ["instance_name", *KEY]
            dealt, parts = routed(r.select(*keys).distinct()), []
            for prefix, n in nodes.items():
                asked = own(dealt, prefix, keys)
                parts.append(asked.join(n.find_missing(asked.drop("__outer")), keys, "left_semi").select(F.col("__outer").alias("instance_name"), *KEY))
            return union(parts, keys)

        def read(r: DataFrame) -> DataFrame:
            dealt = routed(r)
            parts = [n.get(own(dealt, prefix, r.columns)).withColumn("instance_name", F.col("__outer")).drop("__outer") for prefix, n in nodes.items()]
            lost = dealt.where("backend is null").select(*r.columns, F.lit(None).cast("binary").alias("data"), "status")
            return _together([lost, *[p.select(lost.columns) for p in parts]])

        return Node(missing, read, {"unroutable": lambda r: routed(r.select("instance_name", *KEY).distinct()).where("backend is null").select("instance_name", *KEY)})
    raise ValueError(f"INVALID_ARGUMENT: unknown kind {kind!r}")


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
