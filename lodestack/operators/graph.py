"""Reference graphs: closure from seeds, copy plans, orders of tree directories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.session import written


def closure(seeds: DataFrame, edges: DataFrame, max_depth: int = 10_000) -> DataFrame:
    """All nodes that seeds reach, seeds included, each once.

    ``seeds``: ``node``; ``edges``: ``parent, child``. One round a level: the
    frontier meets the edges, and what no earlier level holds is the next
    frontier, written down so that a round costs its own join only. Cycles and
    diamonds end by themselves. (A recursive query would keep repeated nodes and
    is limited in rows.)
    """
    edges = written(edges.select("parent", "child").distinct(), "closure-edges")
    frontier = written(seeds.select("node").where("node is not null").distinct(), "closure-level")
    seen = frontier
    for _ in range(max_depth):
        reached = edges.join(frontier, F.col("parent") == F.col("node"), "left_semi").select(F.col("child").alias("node")).distinct()
        frontier = written(reached.where("node is not null").join(seen, "node", "left_anti"), "closure-level")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
    raise RuntimeError(f"more than {max_depth} levels")


def copy_plan(seeds: DataFrame, edges: DataFrame, sink: DataFrame) -> DataFrame:
    """Reachable nodes that the sink lacks."""
    return closure(seeds, edges).join(sink.select("node"), "node", "left_anti")


#: Rows of a partition of whole trees.
TREE_ROWS = 1 << 18

#: What may be wrong with a tree, as :func:`tree_status` prefers it.
PROBLEMS = ("missing child", "out of order", "repeated directory", "unexpected directory")


def by_tree(rows: DataFrame, tree: str) -> DataFrame:
    """Small trees, each whole in one of as many partitions as the rows fill: what groups
    by tree, or by tree and more, needs no further shuffle, and a task's memory does not
    grow with the table. For rows that are cheap to count."""
    return rows.repartition(-(-rows.count() // TREE_ROWS) or 1, tree)


def tree_status(directories: DataFrame) -> DataFrame:
    """Per tree whether its directories are in topological order.

    ``directories``: ``tree, position, hash, children``. The root comes first;
    every other directory must have been named as a child by an earlier one, and
    every named child must follow. Plain aggregation on (tree, hash) of directories
    and named children together; a null names no directory.
    """
    none = F.lit(None).cast(directories.schema["position"].dataType)
    seen = lambda h, own, position, at: F.struct(h.alias("hash"), own.alias("own"), position.alias("position"), at.alias("at"))
    own = F.array(seen(F.col("hash"), F.lit(1), F.col("position"), none))
    named = F.transform("children", lambda c: seen(c, F.lit(None).cast("int"), none, F.col("position")))
    each = directories.select("tree", F.inline(F.concat(own, F.coalesce(named, F.slice(own, 1, 0)))))
    met = each.groupBy("tree", "hash").agg(F.min("position").alias("position"), F.count("own").alias("times"), F.count(F.lit(1)).alias("all"), F.min("at").alias("named_at"))
    nowhere = (F.col("tree").isNull() | F.col("hash").isNull()) & (F.col("all") > F.col("times"))
    bad = (
        F.when(F.col("position").isNull() | nowhere, 1)
        .when(F.col("times") > 1, 3)
        .when((F.col("position") > 0) & F.col("named_at").isNull(), 4)
        .when((F.col("position") > 0) & (F.col("named_at") >= F.col("position")), 2)
        .when((F.col("position") == 0) & F.col("named_at").isNotNull(), 2)
    )
    worst = met.groupBy("tree").agg(F.min(bad).alias("worst"))
    return worst.select("tree", F.coalesce(*[F.when(F.col("worst") == i, p) for i, p in enumerate(PROBLEMS, 1)]).alias("problem"))
