"""Approximate nearest neighbours by inner product.

A forest of random-projection trees: each inner node splits by a hyperplane
between two sampled points, a leaf holds a bounded number of sampled rows.
Inner products become angles by one extra component that lifts every vector to
the largest norm. The splits are fitted on a bounded sample; every row is
routed through every tree. A query walks all trees through one shared priority
queue (least margin first) until the leaves it has seen hold enough rows; the
rows of those leaves are then ranked by the exact inner product in double
precision. How many are enough is measured in each run, on queries whose
neighbours are found by brute force. Equal vectors are indexed once, with their
smallest ids.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm._shared import scratch, written
from lodestack.llm.vectors import common_dim, matrix, numbers, usable

#: The most rows that the splits are fitted on; index and search cover all rows.
SAMPLE = 1 << 16
#: Bytes of that sample at most: fewer rows where vectors are long.
SAMPLE_BYTES = 64 << 20
TREES = 10
#: Rows of the table that a leaf holds, about, and sampled rows of a leaf at least: the
#: larger the table, the fewer of the sample's rows share a leaf.
LEAF, LEAST = 512, 8
#: A query takes leaves until they hold this many rows, trees together, or more where RECALL needs more.
SEARCH = 40_000
#: Share of the nearest that the leaves must hold, over at most so many brute-forced queries.
RECALL, PROBES = 0.95, 256
#: Rows of a leaf that one group ranks; larger leaves are dealt over several groups.
BLOCK = 4_096


class Tree:
    """Hyperplanes (one row a node), children (negative: leaf ``-1 - i``)."""

    def __init__(self, x: np.ndarray, rng: np.random.Generator, leaf: int = LEAF):
        self.normal: list[np.ndarray] = []
        self.offset: list[float] = []
        self.kids: list[list[int]] = []
        self.leaves = 0
        self.root = self._grow(x, np.arange(len(x)), rng, leaf)
        self.normal_ = np.array(self.normal, np.float32).reshape(len(self.normal), x.shape[1])

    def _grow(self, x: np.ndarray, rows: np.ndarray, rng: np.random.Generator, leaf: int) -> int:
        todo, root = [(rows, None)], None
        while todo:
            rows, at = todo.pop()
            node, split = None, None
            if len(rows) > leaf:
                for _ in range(4):
                    a, b = x[rows[rng.integers(len(rows), size=2)]]
                    normal = (a / (np.linalg.norm(a) or 1)) - (b / (np.linalg.norm(b) or 1))
                    if not normal.any():
                        continue
                    side = x[rows] @ normal
                    cut = float(np.median(side)) if not 0.2 < (side > 0).mean() < 0.8 else 0.0
                    if 0 < (side > cut).sum() < len(rows):
                        split = (normal / np.linalg.norm(normal), cut / np.linalg.norm(normal), side > cut)
                        break
            if split is None:
                node = -1 - self.leaves
                self.leaves += 1
            else:
                node = len(self.normal)
                self.normal.append(split[0].astype(np.float32))
                self.offset.append(split[1])
                self.kids.append([0, 0])
                todo += [(rows[~split[2]], (node, 0)), (rows[split[2]], (node, 1))]
            if at is None:
                root = node
            else:
                self.kids[at[0]][at[1]] = node
        return root if root is not None else -1

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out = np.zeros(len(x), np.int64)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -1 - node
            elif len(rows):
                up = x[rows] @ self.normal_[node] > self.offset[node]
                todo += [(self.kids[node][0], rows[~up]), (self.kids[node][1], rows[up])]
        return out


def search(forest: list[Tree], sizes: dict[tuple[int, int], int], q: np.ndarray, enough: int) -> list[tuple[int, int]]:
    """Leaves (tree, leaf) in the order of the shared queue until they hold ``enough`` rows."""
    heap = [(0.0, t, tree.root) for t, tree in enumerate(forest)]
    margins = [(tree.normal_ @ q - tree.offset).tolist() if len(tree.normal_) else [] for tree in forest]
    found, out = 0, []
    while heap and found < enough:
        d, t, node = heapq.heappop(heap)
        kids = forest[t].kids
        while node >= 0:
            m = margins[t][node]
            near = kids[node][m > 0]
            heapq.heappush(heap, (d + m * m, t, kids[node][m <= 0]))
            node = near
        leaf = -1 - node
        if n := sizes.get((t, leaf), 0):
            found += n
            out.append((t, leaf))
    return out


def exact(one: DataFrame, probes: pa.Table, k: int) -> DataFrame:
    """By brute force over all rows, the ``k + 1`` best distinct vectors of each probe: ``probe, score, ids, v``."""
    q = matrix(probes["v"])
    sent = one.sparkSession.sparkContext.broadcast(q)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = sent.value @ matrix(b.column("v")).T if len(sent.value) else np.zeros((0, b.num_rows))
            m = min(k + 1, b.num_rows)
            at = np.argpartition(-scores, m - 1, axis=1)[:, :m] if m else np.zeros((0, 0), np.int64)
            probe, row = np.repeat(np.arange(len(at)), m), pa.array(at.ravel(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(probe, pa.int32()), pa.array(np.take_along_axis(scores, at, 1).ravel() if m else [], pa.float64()), b.column("ids").take(row), b.column("v").take(row)], ["probe", "score", "ids", "v"])

    order = Window.partitionBy("probe").orderBy(F.desc("score"), F.col("ids")[0])
    found = one.select("ids", "v").mapInArrow(best, f"probe int, score double, ids array<long>, v {one.schema['v'].dataType.simpleString()}")
    return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).drop("r")


def needed(forest: list[Tree], sizes: dict[tuple[int, int], int], probes: pa.Table, found: DataFrame, k: int, top: float) -> int:
    """The least ``enough`` whose leaves hold ``RECALL`` of the probes' ``k`` nearest."""
    got = found.toArrow()
    if not got.num_rows:
        return 0
    y = lift(matrix(got["v"]), top).astype(np.float32)
    leaves = np.column_stack([tree.route(y) for tree in forest])
    near: dict[int, list[tuple[float, int, int]]] = {}
    for row, (p, score, ids) in enumerate(zip(got["probe"].to_pylist(), got["score"].to_pylist(), got["ids"].to_pylist())):
        near.setdefault(p, []).extend((-score, i, row) for i in ids)
    own, asked = probes["id"].to_pylist(), lift(matrix(probes["v"]), None).astype(np.float32)
    needs = []
    for p, rows in near.items():
        before, n = {}, 0
        for at in search(forest, sizes, asked[p], 1 << 62):
            before[at] = n
            n += sizes[at]
        for _, _, row in sorted(r for r in rows if r[1] != own[p])[:k]:
            needs.append(min(before.get((t, lf), n) for t, lf in enumerate(leaves[row].tolist())) + 1)
    return sorted(needs)[math.ceil(RECALL * len(needs)) - 1] if needs else 0


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = SAMPLE, trees: int = TREES, leaf: int = LEAF, enough: int | None = None, seed: int = 7) -> DataFrame:
    """Per query its ``k`` nearest found: ``query_id, rank, vec_id, score``.

    A query's own id is never its neighbour. Vectors that are null, zero, hold
    null or non-finite components, or differ from the common dimension of ``vectors``
    take no part, nor do null ids. Repeated ids count once per distinct vector. Ties go
    to the smaller id. Empty input gives an empty result. Leaves are taken until
    they hold ``enough`` rows, by default the larger of ``SEARCH`` and what ``RECALL`` needs.
    """
    with scratch(vectors.sparkSession) as result:
        return result(_nearest(vectors, queries, k, id_col, vec_col, sample, trees, leaf, enough, seed), "ann-nearest")


def _nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vec_col: str, sample: int, trees: int, leaf: int, enough: int | None, seed: int) -> DataFrame:
    spark = vectors.sparkSession
    take = lambda df: df.where(usable(vec_col)).where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), numbers(vectors, vec_col).cast(kind).alias("v"))
    kind = vectors.select(numbers(vectors, vec_col).alias("v")).schema["v"].dataType.simpleString()
    rows = take(vectors)
    dim = common_dim(rows, "v")
    rows = rows.where(F.size("v") == dim)
    # Equal vectors once: the k + 1 smallest ids are all that a query can need.
    one = rows.distinct().groupBy(F.md5(F.to_json(F.struct("v")).cast("binary")).alias("h"), F.pmod(F.xxhash64("id"), F.lit(16)).alias("s")).agg(F.slice(F.array_sort(F.collect_set("id")), 1, k + 1).alias("ids"), F.first("v").alias("v"))
    one = one.groupBy("h").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"), F.first("v").alias("v"))
    one = written(one.select(F.col("ids")[0].alias("rep"), "ids", "v"), "ann-rows")
    result = "query_id long, rank int, vec_id long, score double"
    total, top = one.agg(F.count(F.lit(1)), F.max(F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x))).first()
    if not total:
        return spark.createDataFrame([], result)
    sample = min(sample, max(2, SAMPLE_BYTES // (8 * dim)))
    fit = one.select("rep", "v").orderBy(F.xxhash64("rep"), "rep").limit(sample).toArrow()
    x = lift(matrix(fit["v"]), top).astype(np.float32)
    rng = np.random.default_rng(seed)
    held = max(LEAST, min(leaf, leaf * len(x) // total))
    forest = [Tree(x, rng, held) for _ in range(trees)]
    sent = spark.sparkContext.broadcast(forest)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            y = lift(matrix(b.column("v")), top).astype(np.float32)
            for t, tree in enumerate(sent.value):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t), pa.int32()), pa.array(tree.route(y), pa.int64()), b.column("rep"), b.column("ids"), b.column("v")], ["tree", "leaf", "rep", "ids", "v"])

    postings = written(one.mapInArrow(route, f"tree int, leaf long, rep long, ids array<long>, v {kind}"), "ann-postings")
    # One row a leaf: bounded by the sample, whatever the table's size.
    sizes = {(r.tree, r.leaf): r.n for r in postings.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
    sent_sizes = spark.sparkContext.broadcast(sizes)
    asked = take(queries).where(F.size("v") == dim).distinct()
    if enough is None:
        n = max(8, min(PROBES, SAMPLE_BYTES // (8 * dim * (k + 1))))
        probes = asked.orderBy(F.xxhash64("id"), "id", "v").limit(n).toArrow()
        enough = max(SEARCH, needed(forest, sizes, probes, exact(one, probes, k), k, top))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = lift(matrix(b.column("v")), None).astype(np.float32)
            at, tree, leaf_, part = [], [], [], []
            for i, q in enumerate(y):
                for t, lf in search(sent.value, sent_sizes.value, q, enough):
                    for p in range(-(-sent_sizes.value[t, lf] // BLOCK)):
                        at.append(i), tree.append(t), leaf_.append(lf), part.append(p)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(tree, pa.int32()), pa.array(leaf_, pa.int64()), pa.array(part, pa.int32()), b.column("id").take(at), b.column("v").take(at)], ["tree", "leaf", "part", "id", "v"])

    asked = asked.repartition(spark.sparkContext.defaultParallelism).mapInArrow(walk, f"tree int, leaf long, part int, id long, v {kind}")
    big = spark.createDataFrame([(t, lf, -(-n // BLOCK)) for (t, lf), n in sizes.items() if n > BLOCK] or [(-1, -1, 1)], "tree int, leaf long, blocks long")
    dealt = postings.join(F.broadcast(big), ["tree", "leaf"], "left").withColumn("part", F.pmod(F.xxhash64("rep"), F.coalesce("blocks", F.lit(1))).cast("int")).drop("blocks")

    def rank(key: tuple, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        cv = np.array(c["v"].tolist(), np.float64)
        per = c["ids"].map(len).to_numpy()
        flat, starts = np.concatenate(c["ids"].tolist()), np.r_[0, np.cumsum(per)[:-1]]
        qid, out = q["id"].to_numpy(), []
        for lo in range(0, len(q), 512):
            scores = np.array(q["v"].iloc[lo : lo + 512].tolist(), np.float64) @ cv.T
            edge = -np.partition(-scores, min(len(c), k + 1) - 1, axis=1)[:, min(len(c), k + 1) - 1]
            i, j = np.nonzero(scores >= edge[:, None])  # ties at the edge all stay; the last ranking resolves them
            n = per[j]
            at = np.repeat(starts[j] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            out.append(pd.DataFrame({"query_id": np.repeat(qid[lo + i], n), "vec_id": flat[at], "score": np.repeat(scores[i, j], n)}))
        got = pd.concat(out)
        return got[got["query_id"] != got["vec_id"]]

    pairs = asked.groupBy("tree", "leaf", "part").cogroup(dealt.groupBy("tree", "leaf", "part")).applyInPandas(rank, "query_id long, vec_id long, score double")
    best = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def lift(x: np.ndarray, top: float | None) -> np.ndarray:
    """``x`` with the component that makes every norm the largest one (queries: 0)."""
    extra = np.zeros(len(x)) if top is None else np.sqrt(np.maximum(0, top - (x * x).sum(1)))
    return np.column_stack([x, extra])
