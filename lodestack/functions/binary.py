"""Bytes: FNV-1a, Bloom filters, compressed data, message fields, ranges."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestack.session import release

# Fixed values of 64-bit FNV-1a.
FNV_BASIS, FNV_PRIME = 14695981039346656037, 1099511628211


def fnv1a(rows: list[bytes], basis: int = FNV_BASIS) -> np.ndarray:
    """64-bit FNV-1a of each row, vectorised over the rows that are long enough for a byte."""
    size = np.array([len(r) for r in rows], np.int64)
    order = np.argsort(-size, kind="stable")
    data, at, left = np.frombuffer(b"".join(rows), np.uint8), (np.cumsum(size) - size)[order], -size[order]
    h = np.full(len(rows), basis, np.uint64)
    for j in range(int(size.max(initial=0))):
        n = np.searchsorted(left, -j)
        h[:n] = (h[:n] ^ data[at[:n] + j]) * np.uint64(FNV_PRIME)
    out = np.empty_like(h)
    out[order] = h
    return out


def fnv1a_hex(data: Column, basis: int = FNV_BASIS) -> Column:
    """Hex FNV-1a of bytes; null for null."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        h = fnv1a([bytes(x) if x is not None else b"" for x in s], basis)
        return pd.Series([None if x is None else f"{v:016x}" for x, v in zip(s, h.tolist())])

    return run(data)


def slot_key(key_hex: Column, attempt: Column) -> Column:
    """The bytes that an index slot is hashed from: 32-byte key, little-endian attempt."""
    h = F.lpad(F.hex(attempt.cast("long")), 8, "0")
    little = F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)])
    return F.concat(F.unhex(key_hex), F.unhex(little))


CODECS = ("identity", "zstd", "deflate")

#: Rows of a batch that are Python objects at one time.
ROWS_AT_ONCE = 64


def by_row(one: Callable[..., bytes | None], *columns: pa.Array) -> pa.Array:
    """``one`` of the values of each row, as bytes. A batch may hold many large values:
    only a few rows of it become Python objects at a time, and the result is built once."""
    data, ends, valid = bytearray(), [0], []
    for i in range(0, len(columns[0]), ROWS_AT_ONCE):
        for x in zip(*(c.slice(i, ROWS_AT_ONCE).to_pylist() for c in columns)):
            y = one(*x)
            data += y or b""
            ends.append(len(data))
            valid.append(y is not None)
    bitmap, offsets = pa.array(valid, pa.bool_()).buffers()[1], pa.array(ends, pa.int32()).buffers()[1]
    release()
    return pa.Array.from_buffers(pa.binary(), len(valid), [bitmap, offsets, pa.py_buffer(data)])


def _codec(name: str) -> str:
    if name not in CODECS:
        raise ValueError(f"INVALID_ARGUMENT: unknown decompressor {name}")
    return name


def _packed(x: bytes | None, how: str) -> bytes | None:
    if x is None:
        return None
    if how == "deflate":
        c = zlib.compressobj(wbits=-15)
        return c.compress(x) + c.flush()
    import zstandard

    return zstandard.compress(x)


def _unpacked(x: bytes | None, how: str | None) -> bytes | None:
    if x is None:
        return None
    try:
        if how == "deflate":
            return zlib.decompressobj(-15).decompress(x)
        if how == "zstd":
            import zstandard

            return zstandard.ZstdDecompressor().decompressobj().decompress(x)
    except Exception:  # whatever a codec raises means bytes that it cannot decode
        pass
    return None


def compress(data: Column, codec: str) -> Column:
    """Bytes encoded by a codec (``identity``, ``zstd``, ``deflate``); null for null."""
    if _codec(codec) == "identity":
        return data

    @F.arrow_udf("binary")
    def pack(s: pa.Array) -> pa.Array:
        return by_row(lambda x: _packed(x, codec), s)

    return pack(data)


def decompress(data: Column, codec: str | Column) -> Column:
    """Decoded bytes (``identity``, ``zstd``, ``deflate``, by name or per row); null if
    they do not decode or the codec is unknown. Bytes that need no decoding stay out
    of Python. With a codec by name, one worker decodes what it made by :func:`compress`."""
    if isinstance(codec, str):
        if _codec(codec) == "identity":
            return data

        @F.arrow_udf("binary")
        def unpack(s: pa.Array) -> pa.Array:
            return by_row(lambda x: _unpacked(x, codec), s)

        return unpack(data)

    @F.arrow_udf("binary")
    def unpack_by(s: pa.Array, how: pa.Array) -> pa.Array:
        return by_row(_unpacked, s, how)

    return F.when(codec == "identity", data).otherwise(unpack_by(F.when(codec != "identity", data), codec))


def message_fields(data: Column) -> Column:
    """``array<struct<field, offset, size>>`` of a message's top-level length-delimited
    fields; null for bytes that are no message."""

    def visit(x: bytes) -> list[tuple[int, int, int]] | None:
        out, at = [], 0

        def varint() -> int:
            nonlocal at
            value = shift = 0
            while True:
                b = x[at]
                at += 1
                value |= (b & 127) << shift
                shift += 7
                if b < 128:
                    return value

        try:
            while at < len(x):
                tag = varint()
                kind = tag & 7
                if kind == 0:
                    varint()
                elif kind in (1, 5):
                    at += 8 if kind == 1 else 4
                elif kind == 2:
                    n = varint()
                    out.append((tag >> 3, at, n))
                    at += n
                else:
                    return None
        except IndexError:
            return None
        return out if at == len(x) else None

    @F.pandas_udf("array<struct<field:int,offset:long,size:long>>")
    def run(s: pd.Series) -> pd.Series:
        name = ("field", "offset", "size")
        return s.map(lambda x: None if x is None or (v := visit(bytes(x))) is None else [dict(zip(name, f)) for f in v])

    return run(data)


def byte_range(data: Column, offset: Column, size: Column) -> Column:
    """Bytes from ``offset``; size 0 reads to the end."""
    return F.when(size > 0, F.substr(data, offset.cast("int") + 1, size.cast("int"))).otherwise(F.substr(data, offset.cast("int") + 1))


def range_header(offset: Column, size: Column) -> Column:
    end = F.when(size > 0, (offset + size - 1).cast("string")).otherwise(F.lit(""))
    return F.concat(F.lit("bytes="), offset.cast("string"), F.lit("-"), end)


def chunks(data: Column, most: int) -> Column:
    """The bytes as an array of chunks of at most ``most`` bytes."""
    n = F.octet_length(data)
    starts = F.when(n > 0, F.sequence(F.lit(1), n, F.lit(most))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substr(data, i, F.lit(most)))


def bloom_positions(paths: list[str], bits: int | np.ndarray, functions: int) -> Iterator[np.ndarray]:
    """FNV-1a of the paths with 0, 1, ... trailing slashes, modulo the number of bits (of
    all filters or of each path's own): an array over the paths for each function."""
    h = fnv1a([p.encode() for p in paths])
    for _ in range(functions):
        yield (h % np.asarray(bits, np.uint64)).astype(np.int64)
        h = (h ^ np.uint64(ord("/"))) * np.uint64(FNV_PRIME)


def bloom_size(filter_: bytes) -> int:
    """Bits of a filter: all before the terminator, the highest set bit."""
    used = filter_.rstrip(b"\0")
    return 8 * len(used) - 9 + used[-1].bit_length() if used else -1


def _bloom_packed(at: np.ndarray, bits: int) -> bytes:
    held = np.zeros(bits + 1, bool)
    held[at] = held[bits] = True
    return np.packbits(held, bitorder="little").tobytes()


def bloom_of(paths: list[str], bits: int, functions: int) -> bytes:
    return _bloom_packed(np.concatenate([np.empty(0, np.int64), *bloom_positions(paths, bits, functions)]), bits)


def bloom_has(filter_: Column, functions: Column, path: Column) -> Column:
    """Whether a filter may hold a path; null filters hold nothing."""

    @F.pandas_udf("boolean")
    def run(f: pd.Series, k: pd.Series, p: pd.Series) -> pd.Series:
        has = np.zeros(len(f), bool)
        filters = [b"" if x is None else bytes(x) for x in f]
        sizes = np.array([bloom_size(x) for x in filters], np.int64)
        rows = np.flatnonzero((sizes > 0) & p.notna().to_numpy())
        if len(rows):
            data = np.frombuffer(b"".join(filters), np.uint8)
            start = np.cumsum([0, *map(len, filters)])[rows]
            asked = k.to_numpy()[rows].astype(np.int64)
            all_set = np.ones(len(rows), bool)
            for i, at in enumerate(bloom_positions(p.iloc[rows].tolist(), sizes[rows], int(asked.max()))):
                all_set &= (i >= asked) | (data[start + (at >> 3)] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            has[rows] = all_set
        return pd.Series(has)

    return run(filter_, functions, path)


def access_profiles(rows, key: list[str], path: str, bits: int, functions: int):
    """Bloom filters of the paths of each key. Bit positions are made distinct before
    they are gathered: a group holds at most ``bits`` numbers, however many paths."""

    @F.pandas_udf("array<int>")
    def positions(p: pd.Series) -> pd.Series:
        at = np.stack([*bloom_positions([x or "" for x in p], bits, functions)], axis=1).tolist()
        return pd.Series([[] if x is None else i for x, i in zip(p, at)], dtype=object)

    @F.pandas_udf("binary")
    def packed(s: pd.Series) -> pd.Series:
        return s.map(lambda at: _bloom_packed(at, bits))

    each = rows.select(*key, F.explode(positions(F.col(path))).alias("bit")).distinct()
    return each.groupBy(*key).agg(F.collect_list("bit").alias("bits")).select(*key, packed(F.col("bits")).alias("bloom_filter"), F.lit(functions).alias("bloom_filter_hash_functions"))
