"""Operators against fixed cases: what the store daemon's own tests expect of them."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lodestack.functions.status import ok, status
from lodestack.operators import auth, combinators, graph, metrics, sets, stores
from lodestack.plans.build import build
from lodestack.sources import archives, references
from lodestack.streaming import folds

S = 1_000_000


def blobs(spark, *texts):
    return spark.createDataFrame([("SHA256", hashlib.sha256(t.encode()).hexdigest(), len(t), t.encode()) for t in texts], "function string, hash string, size_bytes long, data binary")


def texts(df):
    known = {hashlib.sha256(t.encode()).hexdigest(): t for t in ("", "a", "b", "c", "d")}
    return sorted(known[r.hash] for r in df.collect())


def test_set_algebra(spark):
    a = blobs(spark, "a", "b", "b")
    b = blobs(spark, "b", "c")
    assert texts(sets.union([a, b, a])) == ["a", "b", "c"]
    got = {r.hash: r.side for r in sets.difference_and_intersection(a, b).collect()}
    assert sorted(got.values()) == ["both", "only_a", "only_b"]
    assert texts(sets.without_empty(blobs(spark, "", "a"))) == ["a"]
    with pytest.raises(ValueError):
        sets.union([])


def test_find_missing_and_get(spark):
    store = blobs(spark, "a")
    assert texts(stores.find_missing(blobs(spark, "", "a", "b", "b"), store)) == ["b"]
    got = {r.hash: r.status for r in stores.get(blobs(spark, "a", "b").drop("data"), store).collect()}
    assert sorted(str(s and s.code) for s in got.values()) == ["NOT_FOUND", "None"]
    empty = stores.with_empty(stores.get(blobs(spark, "").drop("data"), store)).first()
    assert bytes(empty.data) == b"" and empty.status is None


def test_put_validates_each_row_alone(spark):
    rows = blobs(spark, "a", "b", "b").union(blobs(spark, "c").withColumn("size_bytes", F.lit(7).cast("long")))
    fresh, judged = stores.put(rows, blobs(spark, "a"))
    assert texts(fresh) == ["b"]
    assert sum(r.status is not None for r in judged.collect()) == 1


def test_mirrors(spark):
    a, b, req = blobs(spark, "a", "b"), blobs(spark, "b", "c"), blobs(spark, "a", "b", "c", "d")
    assert texts(combinators.mirrored_find_missing(req, a, b)) == ["d"]
    plan = combinators.mirrored_repairs(req, a, b)
    assert {r.direction for r in plan.collect()} == {"a_to_b", "b_to_a"} and texts(plan) == ["a", "c"]
    # repairing makes the plan empty
    fixed = lambda x, way, y: x.unionByName(plan.where(F.col("direction") == way).join(y, sets.KEY, "left_semi").drop("direction").join(y, sets.KEY))
    assert combinators.mirrored_repairs(req, fixed(a, "b_to_a", b), fixed(b, "a_to_b", a)).count() == 0
    got = combinators.mirrored_get(req.drop("data").withColumn("n", F.lit(1)), a, b, "n").collect()
    assert sorted(str(r.served_by) for r in got) == ["None", "a", "b", "b"]
    lost = combinators.replicated(stores.get(blobs(spark, "d").drop("data"), a)).first()
    assert lost.status.code == "INTERNAL"


def test_fallback_and_caching(spark):
    p, s, req = blobs(spark, "a"), blobs(spark, "a", "b"), blobs(spark, "a", "b", "c")
    assert texts(combinators.fallback_missing(req, p, s)) == ["c"]
    assert texts(combinators.fallback_repairs(req, p, s)) == ["b"] == texts(combinators.cache_fills(req, p, s))
    assert {r.served_by for r in combinators.get_with_fallback(req.drop("data"), [("p", p), ("s", s)]).collect()} == {"p", "s", None}
    assert texts(combinators.replication_plan(req.union(req), s, p)) == ["b"]


def test_longest_prefix(spark):
    routes = spark.createDataFrame([("a", "123", "x"), ("a/b/c", "456", ""), ("a/b/c/d/e", "789", "y/z")], "prefix string, backend string, new_prefix string")
    req = spark.createDataFrame([(n,) for n in ("a/b", "a/b/c/d", "hello", "a/b/c/d/e", "ab", "a")], "instance_name string")
    got = {r.instance_name: (r.backend, r.inner_name, r.status and r.status.code) for r in combinators.route(req, routes).collect()}
    assert got == {"a/b": ("123", "x/b", None), "a/b/c/d": ("456", "d", None), "hello": (None, None, "INVALID_ARGUMENT"), "a/b/c/d/e": ("789", "y/z", None), "ab": (None, None, "INVALID_ARGUMENT"), "a": ("123", "x", None)}


def test_ancestors(spark):
    rows = spark.createDataFrame([("", 1, "root"), ("a", 1, "near"), ("a/b", 2, "own")], "instance_name string, k int, v string")
    req = spark.createDataFrame([("a/b", 1), ("a/b", 2), ("c", 1), ("c", 2)], "instance_name string, k int")
    most = {(r.instance_name, r.k): r.v for r in combinators.by_ancestor(req, rows, ["k"]).collect()}
    least = {(r.instance_name, r.k): r.v for r in combinators.by_ancestor(req, rows, ["k"], False).collect()}
    assert most == {("a/b", 1): "near", ("a/b", 2): "own", ("c", 1): "root", ("c", 2): None} and least[("a/b", 1)] == "root"
    assert [tuple(r) for r in combinators.ancestors_find_missing(req, rows, ["k"]).collect()] == [("c", 2)]


def test_expiry_fixed_values(spark):
    day = 86400
    gone = lambda t, now: spark.range(1).select(combinators.expired(F.timestamp_seconds(F.lit(t)), now, 1641325785, 28 * day, 28 * day)).first()[0]
    assert gone(1641325784, 0) and not gone(1641325786, 1644187855) and gone(1641325786, 1644187856)
    assert spark.range(1).select(combinators.expired(F.lit(None).cast("timestamp"), 9**9, 0, 1, 1)).first()[0] is False
    with pytest.raises(ValueError):
        combinators.expired(F.lit(None), 0, 0, 1, 0)


def test_completeness(spark):
    results = spark.createDataFrame([(i,) for i in range(5)], "r int")
    refs = spark.createDataFrame([(0, 10), (1, 10), (1, 11), (2, None), (3, 10), (3, 10)], "r int, k int")
    store = spark.createDataFrame([(10,)], "k int")
    assert sorted(r.r for r in combinators.complete(results, refs, store, ["r"], ["k"]).collect()) == [0, 3, 4]
    sized = results.withColumn("s", F.array(F.lit(4).cast("long"), F.col("r").cast("long")))
    assert combinators.within_tree_budget(sized, F.col("s"), 6).count() == 3


def test_authorizers(spark):
    deny, down = auth.deny_all(), status("UNAVAILABLE", "x")
    code = lambda *s: spark.range(1).select(auth.any_of(list(s))["code"]).first()[0]
    assert code(deny, ok(), down) is None and code(deny, down, ok()) == "UNAVAILABLE" and code(deny, deny) == "PERMISSION_DENIED"
    req = spark.createDataFrame([(1, "a/b"), (2, "c"), (2, "a")], "request int, instance_name string")
    assert auth.allowed_prefixes(req, spark.createDataFrame([("a",)], "prefix string")).count() == 2
    verdicts = spark.createDataFrame([("a/b", True), ("a", True), ("c", False)], "instance_name string, allowed boolean")
    assert {r.request: r.denied for r in auth.find_missing_failfast(req, verdicts, "request").collect()} == {1: None, 2: "c"}


def test_metrics(spark):
    b = metrics.decimal_buckets(-9, 18, 2)
    assert b[:4] == [1e-9, 2.1544e-9, 4.6416e-9, 1e-8] or b[:4] == [1e-9, 2.1544e-9, 4.6415e-9, 1e-8]
    assert len(metrics.decimal_buckets(-3, 6, 2)) == 19
    rows = spark.createDataFrame([("x", 1.0), ("x", 3.0), ("x", None), ("y", 8.0)], "l string, v double")
    got = {(r.l, r.le): r.n for r in metrics.histogram(rows, ["l"], "v", [1.0, 2.0, 4.0]).collect()}
    assert got == {("x", 1.0): 1, ("x", 2.0): 1, ("x", 4.0): 2, ("y", 1.0): 0, ("y", 2.0): 0, ("y", 4.0): 0}
    errs = spark.createDataFrame([(1, 2, "B", "two"), (1, 1, "A", "one"), (1, 3, "C", "one")], "g int, o int, code string, message string")
    assert tuple(metrics.merge_errors(errs, "g", "o").first()) == (1, "A", "one, two")


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("x", "y")], "parent string, child string")
    seeds = spark.createDataFrame([("a",), ("a",)], "node string")
    assert sorted(r.node for r in graph.closure(seeds, edges).collect()) == list("abcd")
    sink = spark.createDataFrame([("b",)], "node string")
    assert sorted(r.node for r in graph.copy_plan(seeds, edges, sink).collect()) == list("acd")
    trees = [("ok", 0, "r", ["x", "y"]), ("ok", 1, "x", ["z"]), ("ok", 2, "y", ["z"]), ("ok", 3, "z", []), ("miss", 0, "r", ["x"]), ("late", 0, "r", ["y"]), ("late", 1, "x", []), ("late", 2, "y", ["x"]), ("odd", 0, "r", []), ("odd", 1, "q", [])]
    got = {r.tree: r.problem for r in graph.tree_status(spark.createDataFrame(trees, "tree string, position int, hash string, children array<string>")).collect()}
    assert got == {"ok": None, "miss": "missing child", "late": "out of order", "odd": "unexpected directory"}


def test_trees_fill_partitions(spark, monkeypatch):
    monkeypatch.setattr(graph, "TREE_ROWS", 100)
    rows = spark.range(1000).select((F.col("id") % 250).alias("tree"), (F.col("id") / 250).cast("int").alias("position"))
    spread = graph.by_tree(rows, "tree")
    assert spread.rdd.getNumPartitions() == 10 and graph.by_tree(rows.limit(0), "tree").count() == 0
    chain = spread.select("tree", "position", F.col("position").cast("string").alias("hash"), F.when(F.col("position") < 3, F.array((F.col("position") + 1).cast("string"))).alias("children"))
    status = graph.tree_status(chain)
    assert status._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert status.where("problem is null").count() == 250
    # a null names no directory: neither a child nor one of its own
    odd = [(1, 0, "r", [None]), (2, 0, "r", []), (2, 1, None, []), (3, 0, "r", None), (4, 0, "r", ["x"]), (4, 1, "x", []), (4, 2, "x", []), (5, None, "r", [])]
    got = {r.tree: r.problem for r in graph.tree_status(spark.createDataFrame(odd, "tree int, position int, hash string, children array<string>")).collect()}
    assert got == {1: "missing child", 2: "unexpected directory", 3: None, 4: "repeated directory", 5: "missing child"}


def test_composites(spark):
    whole = blobs(spark, "abc")
    child = hashlib.sha256(b"b").hexdigest()
    index = stores.slices(whole, F.array(F.struct(F.lit(child).alias("hash"), F.lit(1).cast("long").alias("size_bytes"), F.lit(1).cast("long").alias("offset_bytes"))))
    parent = whole.first().hash
    pairs = spark.createDataFrame([(parent, child), (parent, "no")], "parent_hash string, hash string")
    got = {r.hash: (r.data and bytes(r.data), r.status and r.status.code) for r in stores.get_from_composite(pairs, index.select("parent_hash", "hash", "size_bytes", "offset_bytes"), whole).collect()}
    assert got == {child: (b"b", None), "no": (None, "NOT_FOUND")}


def sampled(spark, step, times, **kw):
    df = spark.createDataFrame([("k", int(t * S), i, *p) for i, (t, *p) in enumerate(times)], "k string, us long, i int" + (", p int" if kw else ""))
    return [r.answer for r in folds.fold(df, "k", "us", "i", step, *kw.values()).orderBy("i").collect()]


def test_rate_sampler_fixed_case(spark):
    times = [(1000.0,), (1000.0,), (1000.5,), (1000.9,), (1001.0,), (1001.0,), (1001.1,), (1007.0,), (1007.0,), (1007.3,)]
    assert [a == "sampled" for a in sampled(spark, folds.sampler_step(2, S), times)] == [True, True, False, False, True, True, False, True, True, False]


def test_existence_cache_does_not_extend(spark):
    assert sampled(spark, folds.existence_step(60 * S), [(0,), (59,), (60,), (61,), (121,), (122,)]) == ["miss", "hit", "hit", "miss", "hit", "miss"]


def test_canary_and_response_cache(spark):
    assert sampled(spark, folds.canary_step(10 * S), [(0, 0), (5, 1), (10, 1), (15, 0), (20, 0)], p="p") == ["canary", "replica", "canary_retried_on_source", "source", "canary"]
    assert sampled(spark, folds.expiring_step(), [(0, 5 * S), (4, 1), (5, 0), (5, 7)], p="p") == ["asked", "cached", "asked", "asked"]


def test_bounded_caches(spark):
    ev = spark.createDataFrame([("s", k, i * S, i) for i, k in enumerate("abacab")], "s string, k string, us long, i int")
    lru = [(r.hit, r.evicted) for r in folds.cache_simulation(ev, "s", "k", "us", "i", 2).orderBy("i").collect()]
    assert lru == [(False, None), (False, None), (True, None), (False, "b"), (True, None), (False, "c")]
    fifo = [(r.hit, r.evicted) for r in folds.cache_simulation(ev, "s", "k", "us", "i", 2, "FIFO").orderBy("i").collect()]
    assert fifo == [(False, None), (False, None), (True, None), (False, "a"), (False, "b"), (False, "c")]


def test_stream_gives_the_batch_answers(spark, tmp_path):
    rows = [(f"u{i % 3}", i * S // 2, i) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, us long, i long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    step = folds.sampler_step(2, 5 * S)
    out = folds.fold_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "k", "us", "i", step, 2)
    q = out.writeStream.format("memory").queryName("sampled").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = {r.i: r.answer for r in folds.fold(df, "k", "us", "i", step).collect()}
    assert {r.i: r.answer for r in spark.table("sampled").collect()} == batch


def test_archives(spark):
    rows = spark.createDataFrame([(f"k{i}", b"x" * i) for i in range(30)] + [("k1", b"x"), (None, b"")], "key string, data binary").coalesce(1)
    made = archives.write_zip(rows, most=100).cache()
    assert made.count() > 1
    back = {r.key: bytes(r.data) for r in archives.read_zip(made).collect()}
    assert back == {f"k{i}": b"x" * i for i in range(30)}
    bad = archives.read_zip(spark.createDataFrame([(b"no archive",)], "content binary")).first()
    assert bad.key is None


def test_archives_are_not_copied():
    import tracemalloc

    import pyarrow as pa

    rows = pa.RecordBatch.from_arrays([pa.array([f"k{i}" for i in range(64)]), pa.array([bytes([i]) * (1 << 20) for i in range(64)], pa.binary())], ["k", "d"])
    tracemalloc.start()
    made = [next(archives._archived(iter([rows]), 32 << 20))]
    packing = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    held = tracemalloc.get_traced_memory()[0]
    back = [k for b in archives._members(iter([made[0].select(["content"])])) for k in b.column(0).to_pylist()]
    reading = tracemalloc.get_traced_memory()[1] - held
    tracemalloc.stop()
    assert made[0].column(1).to_pylist() == [32] and back == [f"k{i}" for i in range(32)]
    assert packing < 45 << 20 and reading < 16 << 20  # of an archive of 32 MB


def test_references(spark):
    import zlib

    c = zlib.compressobj(wbits=-15)
    packed = b"head" + c.compress(b"hello") + c.flush()
    want = lambda t: (hashlib.sha256(t).hexdigest(), len(t))
    req = spark.createDataFrame([want(b"hello"), want(b"ead"), want(b"none"), want(b"wrong"), want(b"lost")], "hash string, size_bytes long")
    refs = spark.createDataFrame([(want(b"hello")[0], "http", "u", 4, 0, "deflate"), (want(b"ead")[0], "http", "u", 1, 3, "identity"), (want(b"wrong")[0], "http", "u", 0, 5, "identity"), (want(b"lost")[0], "s3", "v", 0, 0, "identity")], "hash string, medium string, location string, offset_bytes int, length int, decompressor string")
    media = spark.createDataFrame([("http", "u", packed)], "medium string, location string, content binary")
    got = {r.hash: (r.data and bytes(r.data), r.status and r.status.code) for r in references.expand(req, refs, media).collect()}
    assert [got[want(t)[0]] for t in (b"hello", b"ead", b"none", b"wrong", b"lost")] == [(b"hello", None), (b"ead", None), (None, "NOT_FOUND"), (None, "INTERNAL"), (None, "NOT_FOUND")]


def test_plans(spark):
    t = {"x": blobs(spark, "a"), "y": blobs(spark, "b")}
    req = blobs(spark, "a", "b", "c")
    node = build({"with_labels": {"labels": {"m": {"mirrored": {"backend_a": {"local": "x"}, "backend_b": {"local": "y"}}}}, "backend": {"label": "m"}}}, t)
    assert texts(node.find_missing(req)) == ["c"] and texts(node.effects["repairs"](req)) == ["a", "b"]
    shard = build({"sharding": {"p": {"weight": 1, "backend": {"local": "x"}}, "q": {"weight": 3, "backend": {"local": "x"}}}}, t)
    assert texts(shard.find_missing(req)) == ["b", "c"]
    nested = {"read_fallback": {"primary": {"local": "x"}, "secondary": {"local": "y"}}}
    assert texts(build({"sharding": {"p": {"weight": 1, "backend": nested}, "q": {"weight": 3, "backend": {"local": "x"}}}}, t).find_missing(blobs(spark, "a", "c", "d"))) == ["c", "d"]
    assert sum(r.status is None for r in node.get(req.drop("data")).collect()) == 2
    tenant = lambda df, n: df.withColumn("instance_name", F.lit(n))
    t |= {"root": tenant(blobs(spark, "a"), ""), "own": tenant(blobs(spark, "b"), "x/b")}
    tree = {"hierarchical_instance_names": {"local": "root"}}
    assert texts(build(tree, t).find_missing(tenant(blobs(spark, "a", "b"), "p/q"))) == ["b"]
    routes = build({"demultiplexing": {"a": {"backend": tree, "new_prefix": "x"}, "a/b": {"backend": {"local": "y"}}}}, t)
    asked = tenant(blobs(spark, "a", "b"), "a/c").unionByName(tenant(blobs(spark, "a", "b"), "a/b")).unionByName(tenant(blobs(spark, "a"), "zz"))
    got = sorted((r.instance_name, r.hash) for r in routes.find_missing(asked).collect())
    ha, hb = (hashlib.sha256(c).hexdigest() for c in (b"a", b"b"))
    assert got == sorted([("a/c", hb), ("a/b", ha)])
    assert [r.instance_name for r in routes.effects["unroutable"](asked).collect()] == ["zz"]
    for bad in ({"local": "z"}, {"label": "m"}, {"what": 1}, {"with_labels": {"labels": {"m": {"local": "x"}}, "backend": {"with_labels": {"labels": {"m": {"local": "y"}}, "backend": {"label": "m"}}}}}):
        with pytest.raises(ValueError):
            build(bad, t)


def test_state_versions(spark, tmp_path):
    from lodestack.sources import state

    path = str(tmp_path / "state")
    assert state.latest(spark, path) is None
    for v in (1, 2, 10):
        state.save(spark.range(v), path, v)
    assert state.latest(spark, path).count() == 10 and state.expire(spark, path, 1) == [1, 2]


def test_typed_and_content(spark):
    rows = spark.createDataFrame([(1, b'{"k": 5}'), (2, b"junk"), (3, None)], "i int, data binary").withColumn("status", ok())
    got = {r.i: (r.message and r.message.k, r.status and r.status.code) for r in stores.typed(rows, "k int").collect()}
    assert got == {1: (5, None), 2: (None, "INTERNAL"), 3: (None, None)}
    assert texts(stores.content_rows(spark.createDataFrame([("a",)], "v string"), "v")) == ["a"]


def test_canary_routes(spark):
    req = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "instance_name string")
    health = spark.createDataFrame([("a", True, 10), ("b", False, 10), ("c", True, 5)], "instance_name string, healthy boolean, expires_at int")
    got = {r.instance_name: r.backend for r in combinators.canary_route(req, health, F.lit(5)).collect()}
    assert got == {"a": "replica", "b": "source", "c": "canary", "d": "canary"}


def test_plan_reads_and_failures(spark):
    t = {"x": blobs(spark, "a", "b"), "y": blobs(spark, "c")}
    asked = blobs(spark, "a", "c", "d").drop("data")
    codes = lambda spec: sorted(r.c or "OK" for r in build(spec, t).get(asked).select(F.col("status.code").alias("c")).collect())
    down = {"error": {"code": "UNAVAILABLE", "message": "down"}}
    assert codes({"read_fallback": {"primary": {"local": "x"}, "secondary": {"local": "y"}}}) == ["NOT_FOUND", "OK", "OK"]
    assert codes({"read_fallback": {"primary": down, "secondary": {"local": "y"}}}) == ["UNAVAILABLE"] * 3
    assert codes({"read_caching": {"fast": {"local": "y"}, "slow": down}}) == ["OK", "UNAVAILABLE", "UNAVAILABLE"]
    with pytest.raises(Exception, match="UNAVAILABLE: down"):
        build(down, t).find_missing(asked).collect()
    assert build(down, t).find_missing(asked.limit(0)).collect() == []


def test_completeness_by_whole_digests(spark):
    results = spark.createDataFrame([(i,) for i in range(5)], "r long")
    refs = spark.createDataFrame([(0, "SHA256", "aa", 3), (1, "SHA256", None, 3), (2, "SHA256", "ee", 0), (3, "SHA256", "zz", 3), (4, "SHA256", "aa", None)], "r long, function string, hash string, size_bytes long")
    store = spark.createDataFrame([("SHA256", "aa", 3)], "function string, hash string, size_bytes long")
    assert sorted(r.r for r in combinators.complete(results, refs, store, ["r"], list(sets.KEY)).collect()) == [0, 2]


def test_plan_reads_keep_keys_with_nulls(spark):
    """Requests with a null in the key are answered NOT_FOUND, by every node that joins on it."""
    asked = spark.createDataFrame([(1, "t/u", "SHA256", None, None), (2, "t/u", None, "ab", 1)], "doc_id int, instance_name string, function string, hash string, size_bytes bigint")
    held = spark.createDataFrame([("t", "SHA256", "ab", 1, b"x")], "instance_name string, function string, hash string, size_bytes bigint, data binary")
    health = spark.createDataFrame([("t/u", True, 200)], "instance_name string, healthy boolean, expires_at bigint")
    local = {"local": "held"}
    canary = {"read_canarying": {"source": local, "replica": local, "health": "health", "now": 100}}
    for plan in ({"empty_blobs": local}, {"hierarchical_instance_names": local}, canary, {"read_canarying": {"source": local, "replica": canary, "health": "health", "now": 300}}):
        got = build(plan, {"held": held, "health": health}).get(asked)
        assert sorted(got.columns) == sorted([*asked.columns, "data", "status"])
        assert sorted((r["doc_id"], r["status"]["code"]) for r in got.collect()) == [(1, "NOT_FOUND"), (2, "NOT_FOUND")]
