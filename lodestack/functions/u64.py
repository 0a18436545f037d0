"""Unsigned 64-bit arithmetic and weighted rendezvous hashing.

Bigint columns raise on overflow under ANSI rules, so products modulo 2**64 run
in numpy over Arrow batches: one vectorised function, whose plan stays one
expression however often a filter is pushed through it.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The multipliers of the 64-bit finalizer.
MULTIPLIERS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
#: Fixed-point log2 of 1 + i/64, in 65536ths.
LOG2 = [round(math.log2(1 + i / 64) * 65536) for i in range(65)]


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer that spreads a key's bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MULTIPLIERS[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MULTIPLIERS[1])
    return x ^ (x >> np.uint64(31))


def log2(x: np.ndarray) -> np.ndarray:
    """log2 in 65536ths: whole bits, a table entry, and linear interpolation. 0 has 0."""
    msb = np.zeros(len(x), np.uint64)
    rest = x >> np.uint64(1)
    for step in (32, 16, 8, 4, 2, 1):
        high = rest >> np.uint64(step) > 0
        msb += np.where(high, np.uint64(step), np.uint64(0))
        rest = np.where(high, rest >> np.uint64(step), rest)
    msb += rest > 0
    bits = np.where(msb == 0, np.uint64(0), x << ((np.uint64(64) - msb) & np.uint64(63)))
    table = np.array(LOG2, np.uint64)
    at = (bits >> np.uint64(58)).astype(np.int64)
    part = (bits << np.uint64(6)) >> np.uint64(16)
    return (msb << np.uint64(16)) + table[at] + (((table[at + 1] - table[at]) * part) >> np.uint64(48))


def score(key: np.ndarray, shard: int, weight: int) -> np.ndarray:
    lg = log2(mixed(key ^ np.uint64(shard)))
    return np.uint64(weight << 32) // (np.uint64(64 << 16) - lg)


def shard_key_hash(key: str) -> int:
    return int.from_bytes(hashlib.sha256(key.encode()).digest()[:8], "big")


def check_shards(shards: dict[str, int]) -> list[tuple[str, int, int]]:
    """Shards with their hashes in unsigned order; plan-time errors for none, zero
    weights, weights that do not fit and equal hashes."""
    if not shards:
        raise ValueError("INVALID_ARGUMENT: no shards provided")
    for k, w in shards.items():
        if not 0 < w < 1 << 32:
            raise ValueError(f"INVALID_ARGUMENT: shard {k!r} has weight {w}")
    out = sorted(((k, w, shard_key_hash(k)) for k, w in shards.items()), key=lambda x: x[2])
    if len({h for *_, h in out}) < len(out):
        raise ValueError("INVALID_ARGUMENT: shards have colliding hashes")
    return out


def pick(key: np.ndarray, shards: list[tuple[str, int, int]]) -> np.ndarray:
    """Index of the best-scoring shard; ties go to the first, that of the smallest hash."""
    best, at = score(key, shards[0][2], shards[0][1]), np.zeros(len(key), np.int64)
    for i, (_, w, h) in enumerate(shards[1:], 1):
        s = score(key, h, w)
        better = s > best
        best, at = np.where(better, s, best), np.where(better, i, at)
    return at


def assign_shards(df: DataFrame, hash64: str, shards: dict[str, int], out: str = "shard") -> DataFrame:
    """``df`` plus the shard of weighted rendezvous hashing of bigint ``hash64``
    (null for null). Removing a shard moves its own keys only."""
    own = check_shards(shards)
    names = np.array([k for k, *_ in own], object)

    @F.arrow_udf("string")
    def shard(h: pa.Array) -> pa.Array:  # Arrow, since pandas turns a column with nulls into doubles
        null = h.is_null().to_numpy(zero_copy_only=False)
        key = h.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
        return pa.array(names[pick(key, own)], pa.string(), mask=null)

    return df.withColumn(out, shard(F.col(hash64)))
