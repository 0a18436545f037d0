"""Scalar functions against fixed values and plain Python."""

import hashlib
import hmac
import base64
import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.functions import binary, digests, documents, names, paths, status, tokens, u64


def one(spark, *cols, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    row = df.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return row[0] if len(cols) == 1 else tuple(row)


# Shards of keys 0 to 19 under weights 1, 2, 4, 7, 1.
WINNERS = [3, 2, 0, 3, 3, 3, 0, 0, 1, 3, 0, 3, 1, 2, 2, 2, 3, 3, 1, 3]
SHARDS = {"a": 1, "b": 2, "c": 4, "d": 7, "e": 1}


def test_rendezvous_fixed_values_and_counts():
    own = u64.check_shards(SHARDS)
    index = {"a": 0, "b": 1, "c": 2, "d": 3, "e": 4}
    pick = lambda keys: np.array([index[own[i][0]] for i in range(5)])[u64.pick(keys, own)]
    assert pick(np.arange(20, dtype=np.uint64)).tolist() == WINNERS
    counts = np.bincount(pick(np.arange(1_000_000, dtype=np.uint64))) / 1_000_000
    assert np.allclose(counts, np.array([1, 2, 4, 7, 1]) / 15, atol=0.002)


def test_log2_fixed_point():
    assert u64.log2(np.array([1 << i for i in range(64)], np.uint64)).tolist() == [i << 16 for i in range(64)]
    x = np.arange(2, 100_000, dtype=np.uint64)
    assert np.abs(u64.log2(x) / 65536 - np.log2(x.astype(float))).max() / 1 < 1e-4


def test_shards_move_only_their_own_keys(spark):
    df = spark.range(2000).withColumn("h", F.xxhash64("id"))
    a = u64.assign_shards(df, "h", SHARDS, "was")
    moved = u64.assign_shards(a, "h", {k: w for k, w in SHARDS.items() if k != "b"}, "now").where("was <> now")
    assert {r.was for r in moved.select("was").distinct().collect()} == {"b"}
    with pytest.raises(ValueError):
        u64.check_shards({})
    with pytest.raises(ValueError):
        u64.check_shards({"a": 0})


def test_fnv1a_fixed_value(spark):
    key = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert one(spark, binary.fnv1a_hex(binary.slot_key(F.col("k"), F.lit(0x11223344))), k=key) == "3a62c67919ee2436"
    assert binary.fnv1a([b"", b"a"]).tolist() == [0xCBF29CE484222325, 0xAF63DC4C8601EC8C]


def test_digests(spark):
    h = {f: one(spark, digests.hash_of(F.lit("hello").cast("binary"), f)) for f in ("MD5", "SHA1", "SHA256", "SHA384", "SHA512", "GITSHA1")}
    for f in ("MD5", "SHA1", "SHA256", "SHA384", "SHA512"):
        assert h[f] == hashlib.new(f.lower(), b"hello").hexdigest()
        assert one(spark, digests.infer_function(F.lit(h[f]))) == f
    assert h["GITSHA1"] == hashlib.sha1(b"blob 5\0hello").hexdigest()
    assert one(spark, digests.infer_function(F.lit("abc"))) is None
    with pytest.raises(NotImplementedError):
        digests.hash_of("x", "BLAKE3")


@pytest.mark.parametrize("fn,h,size,code", [("MD5", "8b1a9953c4611296a827abf8c47804d7", 5, None), ("MD5", "8b1a", 5, "INVALID_ARGUMENT"), ("MD5", "8B1A9953C4611296A827ABF8C47804D7", 5, "INVALID_ARGUMENT"), ("MD5", "8b1a9953c4611296a827abf8c47804d7", -1, "INVALID_ARGUMENT"), ("NONE", "8b", 5, "INVALID_ARGUMENT")])
def test_digest_validation(spark, fn, h, size, code):
    assert one(spark, digests.validate(F.lit(fn), F.lit(h), F.lit(size))["code"]) == code


def test_integrity_tells_sizes_and_sums_apart(spark):
    h = hashlib.sha256(b"hello").hexdigest()
    say = lambda data, size, src="backend", hash_=h: one(spark, digests.integrity(F.lit(data).cast("binary"), "SHA256", F.lit(hash_), F.lit(size), src)["code"])
    assert say("hello", 5) is None and say(None, 5) == "NOT_FOUND"
    assert say("hello", 4) == "INTERNAL" and say("hello", 6, "user") == "INVALID_ARGUMENT" and say("hellp", 5) == "INTERNAL"


def test_resource_paths(spark):
    h = "8b1a9953c4611296a827abf8c47804d7"
    parse = lambda p: one(spark, digests.parse_read_path(F.lit(p)))
    assert tuple(parse(f"a/b/blobs/{h}/5")) == ("a/b", None, "MD5", h, 5)
    assert tuple(parse(f"blobs/{h}/5"))[0] == "" and tuple(parse(f"x/compressed-blobs/zstd/{h}/5"))[1] == "zstd"
    b3 = "a" * 64
    assert tuple(parse(f"blobs/blake3/{b3}/9"))[2:] == ("BLAKE3", b3, 9)
    for bad in ("blobs/abc/5", f"blobs/{h}/x", f"blobs/{h}", f"blob/{h}/5"):
        assert parse(bad) is None
    assert one(spark, digests.read_path(F.lit("i"), F.lit("BLAKE3"), F.lit(b3), F.lit(9))) == f"i/blobs/blake3/{b3}/9"
    w = one(spark, digests.write_path(F.lit("i/j"), F.lit("uu"), F.lit("MD5"), F.lit(h), F.lit(5)))
    assert w == f"i/j/uploads/uu/blobs/{h}/5"
    assert tuple(one(spark, digests.parse_write_path(F.lit(w + "/extra")))) == ("i/j", None, "MD5", h, 5)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 300, 8191, 8192, 10**6, 2**40])
def test_compact_form(spark, n):
    got = bytes(one(spark, digests.compact(F.lit(3), F.lit("ab" * 16), F.lit(n))))
    assert got[:17] == b"\x03" + b"\xab" * 16
    z = shift = 0
    for b in got[17:]:
        z |= (b & 127) << shift
        shift += 7
    assert z == 2 * n and all(b > 127 for b in got[17:-1]) and got[-1] < 128


def test_instance_names(spark):
    up = lambda n: one(spark, names.ancestors(F.lit(n)))
    assert up("hello/world/cup") == ["", "hello", "hello/world", "hello/world/cup"] and up("") == [""]
    valid = lambda n: one(spark, names.is_valid(F.lit(n)))
    assert valid("") and valid("a/b") and not any(map(valid, ("/a", "a/", "a//b", "a/blobs", "uploads")))
    patch = lambda n, a, b: one(spark, names.patch(F.lit(n), F.lit(a), F.lit(b)))
    assert patch("a/b/c", "a/b", "x") == "x/c" and patch("a/b", "a/b", "") == "" and patch("a", "", "x") == "x/a" and patch("ab", "a", "x") is None and patch("", "", "x") == "x"


@pytest.mark.parametrize("path,want", [("", "."), ("/", "/"), ("a//b/./c", "a/b/c"), ("/hello/../world", "/hello/../world"), ("/../../a", "/a"), ("a/", "a/"), ("a/.", "a/"), ("../..", "../.."), ("../", ".."), (".", "."), ("a/..", "a/.."), ("/..", "/"), ("a\0b", None)])
def test_paths(spark, path, want):
    assert one(spark, paths.normalise(F.lit(path))) == want


def test_ranges_and_chunks(spark):
    d = F.lit("0123456789").cast("binary")
    cut = lambda a, n: bytes(one(spark, binary.byte_range(d, F.lit(a), F.lit(n))))
    assert cut(2, 3) == b"234" and cut(8, 0) == b"89" and cut(0, 0) == b"0123456789"
    assert one(spark, binary.range_header(F.lit(5), F.lit(0))) == "bytes=5-" and one(spark, binary.range_header(F.lit(5), F.lit(3))) == "bytes=5-7"
    assert [bytes(x) for x in one(spark, binary.chunks(d, 4))] == [b"0123", b"4567", b"89"]


def test_codecs_and_message_fields(spark):
    raw = b"payload " * 20
    deflate = zlib.compressobj(wbits=-15)
    packed = deflate.compress(raw) + deflate.flush()
    assert bytes(one(spark, binary.decompress(F.lit(packed), "deflate"))) == raw
    zstandard = pytest.importorskip("zstandard")
    assert bytes(one(spark, binary.decompress(F.lit(zstandard.compress(raw)), "zstd"))) == raw
    assert one(spark, binary.decompress(F.lit(b"junk"), "zstd")) is None
    message = b"\x08\x96\x01" + b"\x12\x03abc" + b"\x1a\x00"
    assert [tuple(f) for f in one(spark, binary.message_fields(F.lit(message)))] == [(2, 5, 3), (3, 10, 0)]
    assert one(spark, binary.message_fields(F.lit(b"\x12\x09abc"))) is None


def test_codecs_hold_few_rows_in_one_worker(spark):
    import tracemalloc

    import pyarrow as pa

    rows = pa.array([bytes([i % 256]) * 10_000 if i % 7 else None for i in range(2000)], pa.binary())
    for how in ("deflate", "zstd"):
        tracemalloc.start()
        packed = binary.by_row(lambda x: binary._packed(x, how), rows)
        peak = tracemalloc.get_traced_memory()[1]
        back = binary.by_row(binary._unpacked, packed, pa.array([how] * len(rows)))
        both = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert back.equals(rows) and peak < 8e6 and both < 30e6  # of 17 MB
    assert binary.by_row(binary._unpacked, pa.array([], pa.binary()), pa.array([], pa.string())).equals(pa.array([], pa.binary()))
    df = spark.createDataFrame([(b"abc" * 9, "zstd"), (None, "zstd"), (b"", None)], "x binary, how string")
    twice = df.select("x", "how", binary.decompress(binary.compress(F.col("x"), "deflate"), "deflate").alias("y"), binary.decompress(binary.compress(F.col("x"), "zstd"), F.col("how")).alias("z"))
    assert [(r.x == r.y, r.how and r.x == r.z, r.z) for r in twice.collect()] == [(True, True, b"abc" * 9), (True, True, None), (True, None, None)]
    plan = twice.select("y")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1  # packed and unpacked by one worker
    with pytest.raises(ValueError):
        binary.compress(F.col("x"), "lzw")


def test_bloom_filter(spark):
    held = [f"dir/file{i}" for i in range(20)]
    f = binary.bloom_of(held, 509, 3)
    assert binary.bloom_size(f) == 509
    df = spark.createDataFrame([(p,) for p in [*held, *(f"other{i}" for i in range(200))]], "p string")
    got = df.select("p", binary.bloom_has(F.lit(f), F.lit(3), F.col("p")).alias("x")).collect()
    assert all(r.x for r in got if r.p in held) and sum(r.x for r in got if r.p not in held) < 20


def test_bloom_filters_hash_paths_together(spark, monkeypatch):
    calls, fnv1a = [], binary.fnv1a
    monkeypatch.setattr(binary, "fnv1a", lambda *a: calls.append(1) or fnv1a(*a))
    paths = [f"{'d/' * (i % 7)}ä{i}" for i in range(500)]
    f = binary.bloom_of(paths, 8191, 3)
    assert len(calls) == 1
    monkeypatch.undo()
    bits = {int(binary.fnv1a([p.encode() + b"/" * i])[0]) % 8191 for p in paths for i in range(3)} | {8191}
    assert f == sum(1 << i for i in bits).to_bytes(1024, "little")
    # each row has its own filter, number of functions and path, any of them null
    small, none = binary.bloom_of(["x"], 31, 5), b"\0"
    rows = [(f, 3, paths[9], True), (f, 1, paths[9], True), (f, 3, "x", False), (small, 5, "x", True), (small + b"\0", 5, "x", True), (small, 5, paths[9], False), (none, 3, "x", False), (b"", 3, "x", False), (None, 3, "x", False), (f, 3, None, False)]
    df = spark.createDataFrame(rows, "f binary, k int, p string, want boolean")
    assert all(r.x == r.want for r in df.select("want", binary.bloom_has(F.col("f"), F.col("k"), F.col("p")).alias("x")).collect())
    made = binary.access_profiles(spark.createDataFrame([(None, p) for p in paths] + [(1, "x"), (1, None), (2, None)], "u int, p string"), ["u"], "p", 8191, 3)
    assert {r.u: bytes(r.bloom_filter) for r in made.collect()} == {None: f, 1: binary.bloom_of(["x"], 8191, 3)}


def test_documents(spark):
    doc = json.dumps({"name": "Ann", "files": {"token": "t0"}, "users": [{"name": "a", "age": 30}, {"name": "b", "age": 10}, {"name": "c"}], "aud": ["x", "y"]})
    d = F.lit(doc)
    assert one(spark, documents.field(d, "name")) == "Ann" and one(spark, documents.field(d, "missing.deep")) is None
    users = documents.items(d, "users", "struct<name:string,age:int>")
    assert one(spark, documents.where(users, lambda u: u["age"] > 20, lambda u: u["name"])) == ["a"]
    assert one(spark, documents.join(" ", F.lit("Bearer"), documents.field(d, "files.token"), documents.field(d, "name"))) == "Bearer t0 Ann"
    assert one(spark, documents.contains(F.from_json(documents.field(d, "aud"), "array<string>"), F.lit("y")))
    assert json.loads(one(spark, documents.select(n=documents.field(d, "name"), m=documents.field(d, "no")))) == {"n": "Ann", "m": None}
    assert one(spark, documents.allowed(documents.field(d, "no") == "x")) is False
    assert one(spark, documents.headers(F.lit('{"a":["1","2"]}'))) == {"a": ["1", "2"]}


def test_tokens(spark):
    enc = lambda b: base64.urlsafe_b64encode(b).rstrip(b"=").decode()
    signed = enc(b'{"alg":"HS256","kid":"k1"}') + "." + enc(b'{"sub":"me","nbf":100,"exp":200}')
    header = f"Bearer {signed}." + enc(hmac.new(b"key", signed.encode(), hashlib.sha256).digest())
    t = tokens.parse(F.col("h"))
    df = spark.createDataFrame([(header,), ("Bearer nonsense",), (None,)], "h string").withColumn("t", t)
    rows = df.select(F.col("t.kid"), tokens.in_window(F.col("t"), F.lit(100)).alias("a"), tokens.in_window(F.col("t"), F.lit(200)).alias("b"), tokens.hmac_valid(F.col("t"), {"k1": b"key"}).alias("v"), tokens.hmac_valid(F.col("t"), {"k1": b"no"}).alias("w")).collect()
    assert tuple(rows[0]) == ("k1", True, False, True, False) and not rows[1].a and not rows[1].v and not rows[2].v


def test_status(spark):
    s = status.status("NOT_FOUND", "gone")
    assert tuple(one(spark, status.wrap(s, "while reading", "INTERNAL"))) == ("INTERNAL", "while reading: gone")
    assert one(spark, status.is_infrastructure_error(status.status("UNAVAILABLE", "")), status.is_infrastructure_error(s)) == (True, False)
    assert one(spark, status.http_status(F.lit("ABORTED")), status.http_status(F.lit("DATA_LOSS"))) == (409, 500)


def test_shards_beside_a_null(spark):
    """A null leaves the other rows' 64 bits alone."""
    keys = [None, *((i * 0x9E3779B97F4A7C15) % 2**63 for i in range(1, 400))]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i long, h long")
    own = u64.check_shards(SHARDS)
    want = [own[j][0] for j in u64.pick(np.array(keys[1:], np.uint64), own)]
    got = [r.shard for r in u64.assign_shards(df, "h", SHARDS).orderBy("i").collect()]
    assert got == [None, *want]
