"""Digests as columns: hashing, validation, keys and resource paths.

All functions take and return Columns, so that they stay in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestack.functions import names
from lodestack.functions.status import ok, status

# Digest functions of the remote execution protocol and their hash bytes.
FUNCTIONS = {"SHA256": 1, "SHA1": 2, "MD5": 3, "SHA384": 5, "SHA512": 6, "SHA256TREE": 8, "BLAKE3": 9, "GITSHA1": 10}
HASH_BYTES = {"SHA256": 32, "SHA1": 20, "MD5": 16, "SHA384": 48, "SHA512": 64, "SHA256TREE": 32, "BLAKE3": 32, "GITSHA1": 20}
#: Functions above this value are named in paths; the others follow from the hash's length.
UNNAMED = 7
_BY_LENGTH = {2 * HASH_BYTES[f]: f for f in ("MD5", "SHA1", "SHA256", "SHA384", "SHA512")}
_NAMED = {f.lower(): f for f, v in FUNCTIONS.items() if v > UNNAMED}
COMPRESSORS = ("zstd", "deflate", "brotli")


def as_bytes(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("binary")


def hash_of(data: Column | str, function: str = "SHA256") -> Column:
    """Lower-case hex hash of the bytes. BLAKE3 and SHA256TREE have no built-in: an error at plan time."""
    d = as_bytes(data)
    if function == "GITSHA1":
        size = F.octet_length(d).cast("string").cast("binary")
        return F.sha1(F.concat(F.lit(b"blob "), size, F.lit(b"\x00"), d))
    made = {"MD5": lambda: F.md5(d), "SHA1": lambda: F.sha1(d), "SHA256": lambda: F.sha2(d, 256), "SHA384": lambda: F.sha2(d, 384), "SHA512": lambda: F.sha2(d, 512)}
    if function not in made:
        raise NotImplementedError(f"UNIMPLEMENTED: digest function {function}")
    return made[function]()


def size_of(data: Column | str) -> Column:
    return F.octet_length(as_bytes(data)).cast("long")


def infer_function(hash_: Column) -> Column:
    """The function that a hash's length tells, null for any other length."""
    out = F.when(F.lit(False), F.lit(""))
    for n, name in _BY_LENGTH.items():
        out = out.when(F.length(hash_) == n, F.lit(name))
    return out


def function_value(name: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in FUNCTIONS.items() for x in kv]), name)


def validate(function: Column, hash_: Column, size: Column) -> Column:
    """Status of a digest: exact hash length, lower-case hex, size not negative."""
    length = F.element_at(F.create_map(*[F.lit(x) for f, n in HASH_BYTES.items() for x in (f, 2 * n)]), function)
    return (
        F.when(length.isNull(), status("INVALID_ARGUMENT", "Unknown digest function"))
        .when(hash_.isNull() | (F.length(hash_) != length), status("INVALID_ARGUMENT", F.concat(F.lit("Hash has length "), F.coalesce(F.length(hash_), F.lit(0)).cast("string"), F.lit(", while "), length.cast("string"), F.lit(" characters were expected"))))
        .when(~hash_.rlike("^[0-9a-f]*$"), status("INVALID_ARGUMENT", "Non-hexadecimal character in digest hash"))
        .when(size.isNull() | (size < 0), status("INVALID_ARGUMENT", "Invalid digest size"))
        .otherwise(ok())
    )


#: Functions that Spark computes.
COMPUTED = ("MD5", "SHA1", "SHA256", "SHA384", "SHA512", "GITSHA1")


def hash_by(function: Column, data: Column) -> Column:
    """The hash by the function that each row names, null for one that is not computed."""
    out = F.when(F.lit(False), F.lit(""))
    for name in COMPUTED:
        out = out.when(function == name, hash_of(data, name))
    return out


def integrity(data: Column, function: str | Column, hash_: Column, size: Column, source: str = "backend") -> Column:
    """Status of stored or uploaded bytes against their digest, by one function or by the
    row's. Users' data fails as INVALID_ARGUMENT, stored data as INTERNAL; what cannot be
    computed is UNIMPLEMENTED."""
    code = "INVALID_ARGUMENT" if source == "user" else "INTERNAL"
    seen = size_of(data)
    made = hash_of(data, function) if isinstance(function, str) else hash_by(function, data)
    return (
        F.when(data.isNull(), status("NOT_FOUND", "Object not found"))
        .when(size.isNull(), status("INVALID_ARGUMENT", "Invalid digest size"))
        .when(seen > size, status(code, "Buffer is larger than expected"))
        .when(seen != size, status(code, F.concat(F.lit("Buffer is "), seen.cast("string"), F.lit(" bytes in size, while "), size.cast("string"), F.lit(" bytes were expected"))))
        .when(made.isNull(), status("UNIMPLEMENTED", "Digest function cannot be computed"))
        .when(hash_.isNull() | (made != hash_), status(code, F.concat(F.lit("Buffer has checksum "), made, F.lit(", while "), F.coalesce(hash_, F.lit("none")), F.lit(" was expected"))))
        .otherwise(ok())
    )


def bounded(data: Column, size: Column, most: int) -> Column:
    """Status of reading at most ``most`` bytes into memory."""
    return F.when(size > most, status("INVALID_ARGUMENT", F.concat(F.lit("Buffer is "), size.cast("string"), F.lit(f" bytes in size, while a maximum of {most} bytes is permitted")))).otherwise(ok())


def key(function_value_: Column, hash_: Column, size: Column, instance: Column | None = None) -> Column:
    """The packed key, with or without the instance; both hold the function."""
    parts = [function_value_.cast("string"), hash_, size.cast("string")]
    return F.concat_ws("-", *parts, *([instance] if instance is not None else []))


def shard_hash(hash_: Column) -> Column:
    """The first 8 bytes of a hex hash as 64 bits."""
    half = lambda at: F.conv(F.substring(hash_, at, 8), 16, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


def supported(known: list[str], reported: Column) -> Column:
    """Known functions that a backend reports, once each, in the known order."""
    return F.array_intersect(F.array(*map(F.lit, known)), reported)


def read_path(instance: Column, function: Column, hash_: Column, size: Column, compressor: str | None = None) -> Column:
    named = F.when(function_value(function) > UNNAMED, F.lower(function))
    kind = F.lit(f"compressed-blobs/{compressor}" if compressor else "blobs")
    return F.concat_ws("/", F.nullif(instance, F.lit("")), kind, named, hash_, size.cast("string"))


def write_path(instance: Column, uuid: Column, function: Column, hash_: Column, size: Column, compressor: str | None = None) -> Column:
    return F.concat_ws("/", F.nullif(instance, F.lit("")), F.lit("uploads"), uuid, read_path(F.lit(""), function, hash_, size, compressor))


_NAMES = "|".join(_NAMED)
_TAIL = rf"(?:blobs|compressed-blobs/({'|'.join(COMPRESSORS)}))/(?:({_NAMES})/)?([^/]+)/([0-9]+)"
READ_PATH = rf"^(?:(.*)/)?{_TAIL}$"
WRITE_PATH = rf"^(?:(.*?)/)?uploads/([^/]+)/{_TAIL}(?:/.*)?$"


def _parsed(path: Column, pattern: str, at: int) -> Column:
    part = lambda i: F.regexp_extract(path, pattern, i)
    named = F.upper(F.nullif(part(at + 1), F.lit("")))
    function = F.coalesce(named, infer_function(part(at + 2)))
    sound = validate(function, part(at + 2), part(at + 3).try_cast("long")).isNull() & names.is_valid_or_root(part(1))
    return F.when(
        path.rlike(pattern) & function.isNotNull() & sound,
        F.struct(part(1).alias("instance"), F.nullif(part(at), F.lit("")).alias("compressor"), function.alias("function"), part(at + 2).alias("hash"), part(at + 3).try_cast("long").alias("size")),
    )


def parse_read_path(path: Column) -> Column:
    """``struct<instance, compressor, function, hash, size>``, null for other paths."""
    return _parsed(path, READ_PATH, 2)


def parse_write_path(path: Column) -> Column:
    return _parsed(path, WRITE_PATH, 3)


def zigzag_varint(n: Column) -> Column:
    """Zig-zag variable-length bytes of a non-negative size, up to 2**62."""
    z = F.shiftleft(n.cast("long"), 1)
    one = lambda v: F.unhex(F.lpad(F.hex(v), 2, "0"))
    out = one(z.bitwiseAND(F.lit(127)))
    for groups in range(2, 10):
        top = F.shiftrightunsigned(z, 7 * (groups - 1))
        low = [one(F.shiftrightunsigned(z, 7 * i).bitwiseAND(F.lit(127)).bitwiseOR(F.lit(128))) for i in range(groups - 1)]
        out = F.when(top > 0, F.concat(*low, one(top.bitwiseAND(F.lit(127))))).otherwise(out)
    return out


def compact(function_value_: Column, hash_: Column, size: Column) -> Column:
    """Function byte, hash bytes, zig-zag varint size."""
    return F.concat(F.unhex(F.lpad(F.hex(function_value_.cast("long")), 2, "0")), F.unhex(hash_), zigzag_varint(size))


def uncompact(packed: Column) -> Column:
    """``struct<function, hash, size_bytes>`` of :func:`compact`, null for other bytes."""
    value = F.conv(F.hex(F.substring(packed, 1, 1)), 16, 10).cast("int")
    name, width = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(0))
    for f, v in FUNCTIONS.items():
        name, width = name.when(value == v, F.lit(f)), width.when(value == v, F.lit(HASH_BYTES[f]))
    rest = F.substr(packed, width + 2, F.lit(10))
    byte = lambda i: F.conv(F.hex(F.substr(rest, i, F.lit(1))), 16, 10).cast("long")
    places = F.sequence(F.lit(1), F.greatest(F.octet_length(rest), F.lit(1)))
    z = F.aggregate(places, F.lit(0).cast("long"), lambda a, i: a + F.call_function("shiftleft", byte(i).bitwiseAND(F.lit(127)), (i - 1) * 7))
    whole = (F.octet_length(rest) > 0) & (F.octet_length(rest) < 10) & F.forall(places, lambda i: (byte(i) >= 128) == (i < F.octet_length(rest)))
    return F.when(name.isNotNull() & whole, F.struct(name.alias("function"), F.lower(F.hex(F.substr(packed, F.lit(2), width))).alias("hash"), F.shiftrightunsigned(z, 1).alias("size_bytes")))


def reduced_action(command_hash: Column, platform: Column) -> Column:
    """Digest of an action's command and platform alone; ``platform`` is a map, whose
    order does not matter."""
    return F.sha2(F.to_json(F.struct(command_hash.alias("command"), F.array_sort(F.map_entries(platform)).alias("platform"))).cast("binary"), 256)
