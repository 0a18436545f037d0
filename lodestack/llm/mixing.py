"""Mixing sources to target weights by systematic sampling.

Each source gets a word budget (its target). Within a source every document is
expected ``target / source_size`` times; these expectations are prefix-summed
in a fixed order, one random offset is added, and a document is emitted once
for each integer boundary that its stretch of the sum crosses. Positions are
fixed-point integers, so reruns agree and no rounding can add a copy.

The prefix sum has levels: documents fall into cells (source, size class,
hash bucket) whose number follows the source's documents; a cell is numbered
by a window, its offset is summed over the cells of its block, the blocks of its
class and the classes of its source. No task sees a whole source, however large
its share. Ordering by size class keeps the taken words close to the target,
because every class gives its exact share. Rows of equal id and size fall into
one cell.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.llm._shared import WORD, written

#: Fixed-point bits of a rate; positions stay in 64 bits up to 2**35 documents a source.
BITS = 28
#: Documents of a source for each hash bucket.
CELL = 1 << 9
#: Cells of a class in one block.
BLOCK = 1 << 10
#: Up to so many sources, one row a source is collected, and the table of targets
#: broadcast; beyond, targets are computed by Spark alone and joined by a shuffle.
MAX_SOURCES = 100_000


def word_count(text: str | Column) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: Sequence[int], weights: Sequence[int], ratio=(3, 2), cap: int = 2) -> list[tuple[int, int]]:
    """Exact targets (numerator, denominator): ``ratio`` of all words by weight,
    each at most ``cap`` times its source, the excess reshared by weight."""
    out: list[tuple[int, int]] = [(0, 1)] * len(sizes)
    active, fixed = [i for i, n in enumerate(sizes) if n > 0], 0
    total = sum(sizes) * ratio[0]
    while active:
        left, w = total - ratio[1] * fixed, sum(weights[i] for i in active)
        over = [i for i in active if weights[i] * left > cap * sizes[i] * ratio[1] * w]
        if not over:
            for i in active:
                out[i] = (weights[i] * left, ratio[1] * w)
            break
        for i in over:
            out[i] = (cap * sizes[i], 1)
            fixed += cap * sizes[i]
        active = [i for i in active if i not in set(over)]
    return out


def few_sources(spark: SparkSession, per: list, kind: str, cycle: Sequence[int], seed: str) -> DataFrame:
    """The table of :func:`many_sources` for collected rows."""
    per = sorted(per, key=lambda r: (r.s is None, r.s or ""))
    targets = source_targets([r["size"] for r in per], [cycle[i % len(cycle)] for i in range(len(per))])
    rows = []
    for i, (r, (num, den)) in enumerate(zip(per, targets, strict=True)):
        rate = (num << BITS) // (den * r["size"]) if r["size"] else 0
        offset = int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:7], 16)
        rows.append((r.s, i, r["size"], num / den, rate, offset, -(-r.n // CELL)))
    return F.broadcast(spark.createDataFrame(rows, f"s {kind}, i long, source_size long, target double, rate long, u long, k long"))


def many_sources(per: DataFrame, cycle: Sequence[int], seed: str, ratio=(3, 2), cap: int = 2) -> DataFrame:
    """``s, i, source_size, target, rate, u, k`` of each source, by Spark alone: sources are
    numbered within ranges, and rounds of exact sums find the ones at their cap."""
    spark = per.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(per.repartitionByRange(parts, F.col("s").asc_nulls_last()).withColumn("p", F.spark_partition_id()), "mixing-sources")
    at, starts = 0, []
    for r in sorted(ranged.groupBy("p").count().collect(), key=lambda r: r.p):  # one row a partition
        starts.append((r.p, at))
        at += r["count"]
    own = ranged.join(F.broadcast(spark.createDataFrame(starts, "p int, o long")), "p")
    own = own.withColumn("i", F.col("o") + F.row_number().over(Window.partitionBy("p").orderBy(F.col("s").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in cycle]), (F.col("i") % len(cycle)).cast("int") + 1)
    table = written(own.select("s", "i", "n", "size", weight.cast("decimal(10,0)").alias("w"), F.lit(False).alias("full")), "mixing-targets")
    total = (table.agg(F.sum("size")).first()[0] or 0) * ratio[0]
    while True:
        row = table.agg(F.sum(F.when(F.col("full"), F.col("size"))).alias("fixed"), F.sum(F.when(~F.col("full") & (F.col("size") > 0), F.col("w"))).alias("w")).first()
        left, w = total - ratio[1] * cap * (row.fixed or 0), int(row.w or 0)
        dec = lambda x: F.lit(str(x)).cast("decimal(38,0)")
        over = ~F.col("full") & (F.col("size") > 0) & (F.col("w") * dec(left) > F.col("size") * dec(cap * ratio[1] * w))
        now = written(table.withColumn("new", over).withColumn("full", F.col("full") | F.col("new")), "mixing-targets")
        if not now.where("new").limit(1).count():
            break
        table = now.drop("new")
    some = F.col("size") > 0
    num = F.when(~some, dec(0)).when(F.col("full"), (F.col("size") * cap).cast("decimal(38,0)")).otherwise((F.col("w") * dec(left)).cast("decimal(38,0)"))
    den = F.when(~some | F.col("full"), dec(1)).otherwise(dec(ratio[1] * w))
    digest = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("i").cast("string")).cast("binary")), 1, 7)
    out = table.withColumns({"num": num, "den": den}).withColumn("rate", F.when(some, F.expr(f"cast(cast(num * {1 << BITS} as decimal(38,0)) div cast(den * size as decimal(38,0)) as long)")).otherwise(F.lit(0)))
    return out.select("s", "i", F.col("size").alias("source_size"), (F.col("num").cast("double") / F.col("den").cast("double")).alias("target"), "rate", F.conv(digest, 16, 10).cast("long").alias("u"), F.expr(f"(n + {CELL - 1}) div {CELL}").alias("k"))


def mix(docs: DataFrame, id_col: str, size_col: str, source_col: str, cycle=(3, 1, 2), seed: str = "mix") -> DataFrame:
    """``docs`` plus ``source_size``, ``target``, ``copies`` and ``taken``.

    Sources are ordered by code point, null last (null is a source of its own),
    and weigh ``cycle`` in turn. A size of 0 or null takes nothing; an empty
    table gives an empty result; repeated rows are separate documents; columns
    of ``docs`` other than those added pass through.
    """
    size = F.coalesce(F.col(size_col), F.lit(0)).cast("long")
    per = docs.groupBy(F.col(source_col).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("size"))
    first = per.limit(MAX_SOURCES + 1).collect()
    if len(first) <= MAX_SOURCES:
        table = few_sources(docs.sparkSession, first, docs.schema[source_col].dataType.simpleString(), cycle, seed)
    else:
        table = written(many_sources(per, cycle, seed), "mixing-table")
    added = ("source_size", "target", "copies", "taken")
    base = docs.select(F.struct(*[F.col(c) for c in docs.columns if c not in added]).alias("row"), size.alias("n"), F.col(source_col).alias("source"), F.col(id_col).alias("id"))
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.col("n").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    base = base.join(table, F.col("source").eqNullSafe(F.col("s"))).withColumns({"c": F.length(F.bin("n")), "b": F.pmod(key, F.col("k"))}).withColumn("z", F.expr(f"b div {BLOCK}"))
    cell = ["i", "c", "z", "b"]
    sums = lambda part, order: F.coalesce(F.sum("count").over(Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = written(base.groupBy(*cell).count(), "mixing-cells")
    offsets = counts.withColumn("o", sums(cell[:3], "b")).drop("count")
    for level in (3, 2):  # blocks of a class, classes of a source
        above = counts.groupBy(*cell[:level]).agg(F.sum("count").alias("count"))
        above = above.select(*cell[:level], sums(cell[: level - 1], cell[level - 1]).alias("up"))
        offsets = offsets.join(above, cell[:level]).withColumn("o", F.col("o") + F.col("up")).drop("up")
    out = base.withColumn("r", F.row_number().over(Window.partitionBy(*cell).orderBy("n", "id"))).join(offsets, cell)
    one = 1 << BITS

    def crossed(rank: Column) -> Column:
        whole, part = F.expr(f"rate div {one}"), F.col("rate") % one
        return rank * whole + F.shiftright(rank * part + F.col("u"), BITS)

    rank = F.col("o") + F.col("r")
    return out.select("row.*", "source_size", "target", (crossed(rank) - crossed(rank - 1)).alias("copies"), ((crossed(rank) - crossed(rank - 1)) * F.col("n")).alias("taken"))


def emit(mixed: DataFrame) -> DataFrame:
    """One row per copy of what :func:`mix` decided."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
