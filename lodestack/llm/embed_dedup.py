"""Embedding near-duplicates within a label, by int8 tile products.

Every usable vector is scaled to unit length and quantised to int8 with its own
scale, once. Rows are dealt into tiles of one label and one nearest pivot; each pair
of tiles that can hold a link is one group, and only the int8 rows travel to it.
Within it the integer products of all pairs come from one matrix product, and a
rigorous bound of both vectors' quantisation errors tells which pairs link, which
do not, and which are unsure. Only the vectors of unsure pairs go to their groups
once more, in full, where just those pairs are computed in double precision.
A group returns link counts per vector and a spanning forest of its links, so
that a dense group of copies costs rows, not pairs.

Bound: with u = q/s + e for the unit vectors, |e| known exactly, the cosine
differs from q1.q2/(s1 s2) by at most |e1| |q2/s2| + |e2| |q1/s1| + |e1| |e2|.
Tiles of pivots p1, p2 hold no link if the angle between p1 and p2 exceeds the
largest angles of their rows to them and that of the threshold together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm._shared import connected_components, forest, scratch, written
from lodestack.llm.vectors import common_dim, matrix, numbers, usable

#: Rows of a tile; a group holds two.
TILE = 1024
#: Pivots, rows of the table: a fixed number, so that they can be broadcast. They part labels of as many tiles or more.
PIVOTS = 64
#: Tables of labels with more rows are joined by a shuffle instead of a broadcast.
BROADCAST_ROWS = 100_000
#: For rounding, on every bound.
SLACK = 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled first, so that no square is lost or infinite."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def quantise(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows as int8, their scales, error norms and quantised norms."""
    scale = 127 / np.abs(u).max(1)
    q = np.rint(u * scale[:, None]).astype(np.int8)
    approx = q / scale[:, None]
    return q, scale, np.linalg.norm(u - approx, axis=1), np.linalg.norm(approx, axis=1)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of paired rows in double precision."""
    a, b = a / np.abs(a).max(1, keepdims=True), b / np.abs(b).max(1, keepdims=True)
    dot = np.einsum("ij,ij->i", a, b)
    return dot / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def bounded_pairs(x: tuple, y: tuple | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs of quantised rows that may link (``y`` None: within ``x``), and which
    of them surely do."""
    (qx, sx, ex, nx), (qy, sy, ey, ny) = x, y or x
    # products of int8 rows are exact in float32 below 2**24
    kind = np.float32 if qx.shape[1] * 127 * 127 < 1 << 24 else np.float64
    about = (qx.astype(kind) @ qy.astype(kind).T).astype(np.float64) / np.outer(sx, sy)
    error = np.outer(ex, ny) + np.outer(nx, ey) + np.outer(ex, ey) + SLACK
    i, j = np.nonzero(about + error >= threshold)
    if y is None:
        i, j = i[i < j], j[i < j]
    return i, j, about[i, j] - error[i, j] >= threshold


def linked_pairs(x: np.ndarray, y: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs at or above the threshold, between ``x`` and ``y`` (None: within ``x``)."""
    i, j, sure = bounded_pairs(quantise(unit(x)), None if y is None else quantise(unit(y)), threshold)
    hit, other = sure.copy(), x if y is None else y
    at = np.flatnonzero(~sure)
    for lo in range(0, len(at), 1 << 16):
        k = at[lo : lo + (1 << 16)]
        hit[k] = cosines(x[i[k]], other[j[k]]) >= threshold
    return i[hit], j[hit]


def summed(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row with rows of other ids, and the root of its tree: the smallest id."""
    order = np.argsort(ids, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    other = ids[i] != ids[j]
    links = np.bincount(np.concatenate([i[other], j[other]]), minlength=len(ids))
    return links, ids[order][forest(len(ids), rank[i], rank[j])[rank]]


QUANTISED = "row long, id long, label {label}, d int, q binary, scale double, err double, norm double, c int, angle double"
PAIR = ["label", "d", "c1", "z1", "c2", "z2"]


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", tile: int = TILE) -> DataFrame:
    """One row per vector: id, ``n_links``, ``component_id``, ``kept``.

    Vectors link within equal, non-null labels at a cosine of at least
    ``threshold``. Unusable vectors (null, zero, null or non-finite
    components), null labels and lengths that differ link with nothing and are
    components of their own. Rows that share an id are one node: their links
    add up. A null id links with nothing (component null, kept).
    """
    with scratch(vectors.sparkSession) as result:
        return result(_components(vectors, threshold, id_col, vec_col, label_col, tile), "dedup-components")


def _components(vectors: DataFrame, threshold: float, id_col: str, vec_col: str, label_col: str, tile: int) -> DataFrame:
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), numbers(vectors, vec_col).alias("v"))
    good = rows.where(usable("v") & F.col("label").isNotNull() & F.col("id").isNotNull()).withColumn("row", F.monotonically_increasing_id())
    good = written(good, "dedup-vectors")  # numbers of rows stay what they are
    dim = common_dim(good, "v")
    drawn = good.where(F.size("v") == dim).select(F.xxhash64("row").alias("x"), "row", "v").orderBy("x", "row").limit(PIVOTS).toArrow()
    pivots = unit(matrix(drawn["v"])) if drawn.num_rows else np.zeros((0, 0))
    sent = spark.sparkContext.broadcast(pivots)
    label = good.schema["label"].dataType.simpleString()

    def quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        for b in batches:
            length = pa.compute.list_value_length(b.column("v")).to_numpy(zero_copy_only=False)
            for d in np.unique(length):
                part = b.filter(pa.array(length == d))
                u = unit(matrix(part.column("v")))
                q, scale, err, norm = quantise(u)
                c, angle = np.zeros(len(u), np.int32), np.full(len(u), np.pi)
                if d == p.shape[1]:
                    cos = u @ p.T
                    c = cos.argmax(1).astype(np.int32)
                    angle = np.arccos(np.clip(cos[np.arange(len(u)), c], -1, 1))
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("id").cast(pa.int64()), part.column("label"), pa.array(np.full(len(u), d, np.int32)), pa.array([x.tobytes() for x in q], pa.binary()), pa.array(scale), pa.array(err), pa.array(norm), pa.array(c), pa.array(angle)],
                    ["row", "id", "label", "d", "q", "scale", "err", "norm", "c", "angle"],
                )

    small = written(good.mapInArrow(quantised, QUANTISED.format(label=label)), "dedup-quantised")
    large = small.groupBy("label", "d").count().where(F.col("count") >= PIVOTS * tile).select("label", "d", F.lit(True).alias("large"))
    parted = lambda c, whole: F.when(F.col("large"), F.col(c)).otherwise(F.lit(whole)).alias(c)
    small = small.join(F.broadcast(large) if large.count() <= BROADCAST_ROWS else large, ["label", "d"], "left").select("label", "d", "row", "id", "q", "scale", "err", "norm", parted("c", 0), parted("angle", float(np.pi)))
    # Tiles of a label and pivot, and which pivots can meet: at most PIVOTS rows a label and pivot.
    tiles = small.groupBy("label", "d", "c").agg(F.expr(f"cast((count(1) + {tile - 1}) div {tile} as int)").alias("k"), F.max("angle").alias("far"))
    tiles = written(tiles, "dedup-tiles")
    between = np.arccos(np.clip(pivots @ pivots.T, -1, 1)) if len(pivots) else np.zeros((1, 1))
    apart = spark.createDataFrame([(i, j, float(x)) for i, row in enumerate(between) for j, x in enumerate(row)], "c int, c2 int, between double")
    other = tiles.select("label", "d", F.col("c").alias("c2"), F.col("k").alias("k2"), F.col("far").alias("far2"))
    can = F.when(F.col("d") == dim, F.col("between") <= F.col("far") + F.col("far2") + float(np.arccos(threshold)) + SLACK).otherwise(True)
    meet = tiles.join(other, ["label", "d"]).join(F.broadcast(apart), ["c", "c2"]).where(can).select("label", "d", "c", "k", "c2", "k2")
    meet = written(meet, "dedup-meetings")
    own = small.join(F.broadcast(meet) if meet.count() <= BROADCAST_ROWS else meet, ["label", "d", "c"])
    own = own.withColumn("z", F.pmod(F.xxhash64("row"), F.col("k")).cast("int")).withColumn("z2", F.explode(F.sequence(F.lit(0), F.col("k2") - 1)))
    first = F.struct("c", "z") <= F.struct(F.col("c2"), F.col("z2"))
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    paired = own.select("label", "d", pick("c", "c2").alias("c1"), pick("z", "z2").alias("z1"), pick("c2", "c").alias("c2"), pick("z2", "z").alias("z2"), ((F.col("c") == F.col("c2")) & (F.col("z") == F.col("z2"))).alias("same"), first.alias("first"), "row", "id", "q", "scale", "err", "norm")

    def sides(pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame | None]:
        return (pdf, None) if pdf["same"].iat[0] else (pdf[pdf["first"]], pdf[~pdf["first"]])

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = sides(pdf)
        key = {k: pdf[k].iat[0] for k in PAIR}
        if not len(a) or (b is not None and not len(b)):
            return pd.DataFrame({c: [] for c in [*PAIR, "same", "first", "row", "id", "links", "root", "unsure"]})
        get = lambda x: (np.frombuffer(b"".join(x["q"]), np.int8).reshape(len(x), -1), x["scale"].to_numpy(), x["err"].to_numpy(), x["norm"].to_numpy())
        i, j, sure = bounded_pairs(get(a), None if b is None else get(b), threshold)
        both = a if b is None else pd.concat([a, b])
        j = j if b is None else j + len(a)
        links, root = summed(both["id"].to_numpy(), i[sure], j[sure])
        unsure = np.zeros(len(both), bool)
        unsure[i[~sure]] = unsure[j[~sure]] = True
        out = both[["same", "first", "row", "id"]].assign(links=links, root=root, unsure=unsure, **key)
        return out[(links > 0) | unsure]

    schema = f"label {label}, d int, c1 int, z1 int, c2 int, z2 int, same boolean, first boolean, row long, id long, links long, root long, unsure boolean"
    found = written(paired.groupBy(*PAIR).applyInPandas(compare, schema), "dedup-links")

    def exact(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = sides(pdf)
        x, y = (None if part is None or not len(part) else np.array(part["v"].tolist(), np.float64) for part in (a, b))
        if x is None or (b is not None and y is None):
            return pd.DataFrame({"id": [], "links": [], "root": []})
        i, j, sure = bounded_pairs(quantise(unit(x)), None if y is None else quantise(unit(y)), threshold)
        i, j, other, hit = i[~sure], j[~sure], x if y is None else y, np.zeros((~sure).sum(), bool)
        for lo in range(0, len(i), 1 << 16):
            s = slice(lo, lo + (1 << 16))
            hit[s] = cosines(x[i[s]], other[j[s]]) >= threshold
        both = a if b is None else pd.concat([a, b])
        links, root = summed(both["id"].to_numpy(), i[hit], j[hit] if b is None else j[hit] + len(a))
        return pd.DataFrame({"id": both["id"].to_numpy(), "links": links, "root": root})[links > 0]

    again = found.where("unsure").select(*PAIR, "same", "first", "row", "id").join(good.select("row", "v"), "row")
    more = written(again.groupBy(*PAIR).applyInPandas(exact, "id long, links long, root long"), "dedup-exact")
    found = found.where("links > 0").select("id", "links", "root").unionByName(more)
    comps = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    n_links = found.groupBy("id").agg(F.sum("links").alias("links"))
    out = rows.select("id").join(n_links.withColumnRenamed("id", "i2"), F.col("id") == F.col("i2"), "left").join(comps, F.col("id") == F.col("node"), "left")
    comp = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("id") == comp, F.lit(True)).alias("kept"))
