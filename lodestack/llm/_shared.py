"""Helpers shared by the training-data operators: bounded training samples and
connected components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.session import release, scratch, shared_dir, written

__all__ = ["bounded_sample", "connected_components", "forest", "held_out", "kept", "scratch", "shared_dir", "tidy", "written", "written_texts"]

#: Whitespace that separates words everywhere in this subpackage.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of an Arrow batch of whole texts, where the session does not say otherwise.
TEXT_ROWS = 250
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_slot: dict = {}


def written_texts(df: DataFrame, name: str) -> DataFrame:
    """:func:`written` for rows made from whole texts, or sets of their shingles, in Python
    workers: they get smaller batches than narrow rows, and the session's own setting holds again afterwards."""
    conf = df.sparkSession.conf
    own = conf.get(BATCH_ROWS, None)
    if own is not None:
        return written(df, name)
    conf.set(BATCH_ROWS, TEXT_ROWS)
    try:
        return written(df, name)
    finally:
        conf.unset(BATCH_ROWS)


def kept(key: str, make):
    """What a Python worker builds once and keeps for its later tasks. It keeps one
    thing at a time: the next operator's takes the place of the last one's."""
    if _slot.get("key") != key:
        _slot.clear()
        _slot.update(key=key, value=make())
    return _slot["value"]


def tidy(batches):
    """The batches, and afterwards unused memory back to the system: workers outlive
    their tasks."""
    yield from batches
    release()


def held_out(id_col: str | Column) -> Column:
    """True for the third of the rows that no model may learn from."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def bounded_sample(ids: DataFrame, n: int, most_bytes: int) -> DataFrame:
    """At most ``n`` rows of ``ids``, those with the smallest ``x``, as long as their
    ``bytes`` (of the text behind each) add up to ``most_bytes`` at most; a row that does
    not fit is passed over. Bounded, so that it can be broadcast; the same on every run
    if ``x`` and the other columns order the rows."""
    columns = [c for c in ids.columns if c not in ("x", "bytes")]
    got, left = [], most_bytes
    for r in ids.orderBy("x", *columns).limit(n).collect():
        if r["bytes"] <= left:
            got.append(tuple(r[c] for c in columns))
            left -= r["bytes"]
    return ids.sparkSession.createDataFrame(got, ids.select(*columns).schema)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The root (smallest index) of each of ``n`` nodes under links ``i, j``."""
    root = np.arange(n)
    while len(i):
        low, high = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
        open_ = low != high
        if not open_.any():
            break
        i, j, low, high = i[open_], j[open_], low[open_], high[open_]
        np.minimum.at(root, high, low)
        while not np.array_equal(up := root[root], root):
            root = up
    return root


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id of every node of an undirected graph.

    ``edges``: two long columns ``a``, ``b``. Returns ``node``, ``component``.
    Each round takes the smallest label among a node's neighbours and then
    follows the label's own label (pointer jumping), so that long chains take
    a logarithmic number of rounds. Labels and edges stay distributed; only
    the number of changed labels reaches the driver. Neighbours' minima are
    combined before the shuffle, and joins on a hub read written tables, so
    that the adaptive planner can split them.
    Loops and repeated edges are harmless; nodes without an edge are absent.
    """
    edges = edges.where("a is not null and b is not null and a <> b")
    both = written(edges.union(edges.select("b", "a")).distinct().toDF("a", "b"), "cc-edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "cc-labels")
    for _ in range(max_rounds):
        near = (
            both.join(labels, F.col("b") == F.col("node"))
            .groupBy("a").agg(F.min("component").alias("near"))
        )
        step = written(
            labels.join(near, F.col("node") == F.col("a"))
            .select("node", F.col("component").alias("old"), F.least("component", "near").alias("component")),
            "cc-step",
        )
        # The label's label: roots only, so that the small side has one row a component.
        roots = written(
            step.join(step.select(F.col("component").alias("r")).distinct(), F.col("node") == F.col("r"), "left_semi")
            .select(F.col("node").alias("root"), F.col("component").alias("up")),
            "cc-roots",
        )
        new = written(
            step.join(roots, F.col("component") == F.col("root"), "left")
            .select("node", "old", F.least("component", F.coalesce("up", "component")).alias("component")),
            "cc-labels",
        )
        changed = new.where("component <> old").limit(1).count()
        labels = new.select("node", "component")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
