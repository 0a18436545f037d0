"""N-gram Jaccard join: a size-aware heavy-light self-join of shingle sets.

Documents are sets of five-word shingles (64-bit hashes); they link at a Jaccard
similarity of 0.75 or more. Documents with equal sets are one class from the
start. Then, by size:

* small sets enumerate all subsets of the fixed sizes at which a partner could
  link, and meet on equal subsets, which proves the link;
* large sets meet in inverted lists. A set is listed under its prefix, the
  shingles that one global order puts first, long enough that linked sets share
  one. Shingles of long lists are moved to the end of the order, so that common
  passages drop out of the prefixes;
* of every list each set first meets the leader alone, so that a group of near
  copies costs rows, not pairs. A parity sketch of the sets rules out pairs by a
  proven bound, the others are compared exactly. Members of one leader are in one
  component; only sets apart from their leader go on: in lists of bounded length
  their sketches meet the other members', in longer ones (dense groups under moved
  shingles, and any list beyond the bound) blocks of sets are compared exactly and
  each pair of blocks gives a spanning forest of its links. Nothing is dropped.

The boundary between small and large is the size up to which subsets cost fewer
rows than lists. Links become components by :func:`connected_components`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm._shared import connected_components, forest, kept, scratch, tidy, written, written_texts

WORDS = 5
#: Sets up to this size may be small; the cost model picks the boundary below it.
MOST_SMALL = 12
#: A shingle in more prefixes than this goes to the end of the order.
LIST = 64
#: As many shingles at most are moved (the most frequent): the proven size of the
#: broadcast, 8 bytes each. Lists that stay long beyond it are compared in blocks.
MOVED = 1 << 20
#: Tables of ids up to this many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Documents of a block in dense groups, and base of their size classes: sets that link are of one class or of neighbours.
BLOCK, RATIO = 256, 4 / 3
#: Prefix entries of one partition of the inverted lists.
ENTRIES = 500_000
CACHE = 150_000

_MIX = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _final(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(32))


class _Hashes(dict):
    """Word (bytes) to 64-bit hash; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, hashes: dict) -> np.ndarray:
    """The sorted set of a text's shingle hashes. Fewer than five words are one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(WORDS, len(h))
    n = len(h) - k + 1
    s = np.full(n, np.uint64(k))
    for j in range(k):
        s += h[j : j + n] * _MIX[j]
    return np.unique(_final(s))


def prefix_length(n: int) -> int:
    return n - -(-3 * n // 4) + 1


def overlap_needed(n: int, m: int) -> int:
    return -(-3 * (n + m) // 7)


def in_order(s: np.ndarray, moved: np.ndarray | None) -> np.ndarray:
    """The prefix of a sorted set: unmoved shingles by hash, then moved ones."""
    p = prefix_length(len(s))
    if moved is None or not len(moved):
        return s[:p]
    last = among(s, moved)
    if (free := s[~last])[p - 1 :].size:
        return free[:p]
    return np.concatenate([free, s[last]])[:p]


def among(k: np.ndarray, moved: np.ndarray) -> np.ndarray:
    """Which shingles are in the sorted, non-empty array."""
    at = np.searchsorted(moved, k)
    return moved[np.minimum(at, len(moved) - 1)] == k


def sketch(s: np.ndarray) -> bytes:
    """Parities of how many shingles fall into each of 2**k >= n cells. Sets that
    differ in d shingles differ in at most d parities."""
    bits = 64
    while bits < len(s):
        bits *= 2
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def parities_apart(a: bytes, b: bytes) -> int:
    """Differing parities; the longer sketch is folded to the shorter's length."""
    if len(a) < len(b):
        a, b = b, a
    x, n = int.from_bytes(a, "little"), 8 * len(a)
    while n > 8 * len(b):
        n //= 2
        x = (x >> n) ^ (x & ((1 << n) - 1))
    return (x ^ int.from_bytes(b, "little")).bit_count()


def _hashes() -> _Hashes:
    return kept("jaccard-hashes", _Hashes)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Batches with their shingle sets, about a million shingles at a time."""
    for b in batches:
        lo, sets, size = 0, [], 0
        for i, t in enumerate(b.column("text")):
            sets.append(shingles(t.as_py(), _hashes()))
            size += len(sets[-1])
            if size > 1_000_000 or i + 1 == b.num_rows:
                yield b.slice(lo, len(sets)), sets
                lo, sets, size = i + 1, [], 0


def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, sets in _texts(batches):
        yield pa.RecordBatch.from_arrays(
            [
                b.column("doc"), pa.array([len(s) for s in sets], pa.int32()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                _lists([in_order(s, None) if len(s) else s for s in sets]),
                _lists([s if len(s) <= MOST_SMALL else s[:0] for s in sets]),
                pa.array([sketch(s) for s in sets], pa.binary()),
            ],
            ["doc", "n", "digest", "keys", "small", "sketch"],
        )


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0] + [len(a) for a in arrays])
    flat = np.concatenate([np.zeros(0, np.uint64), *arrays])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))


SIGNATURE = "doc long, n int, digest binary, keys array<long>, small array<long>, sketch binary"


def small_boundary(histogram: dict[int, int], verify: float = 2.0) -> int:
    """The largest size up to which enumerating subsets costs no more rows than
    listing prefixes and comparing what meets there."""
    best, subsets, lists = 0, 0.0, 0.0
    for s in range(1, MOST_SMALL + 1):
        count = histogram.get(s, 0)
        subsets += count * sum(comb(s, overlap_needed(s, m)) for m in partners(s))
        lists += count * prefix_length(s) * (1 + verify)
        if subsets <= lists:
            best = s
    return best


def partners(s: int) -> list[int]:
    """Sizes that a set of size ``s`` can link with."""
    return [m for m in range(1, 2 * s + 1) if 4 * min(s, m) >= 3 * max(s, m)]


def _side(df: DataFrame) -> DataFrame:
    """``df`` marked for a broadcast if its counted rows are few enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_shingles, component_id`` of every row.

    Null texts and texts without words are empty and link with nothing; a row
    with a null id links with nothing and has no component. Rows that share an
    id are one node, with the links of all their texts. Ids are integers.
    """
    with scratch(docs.sparkSession) as result:
        return result(_classes(docs, id_col, text_col), "jaccard-classes")


def _classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    text = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    sig = written_texts(text.mapInArrow(lambda it: tidy(signatures(it)), SIGNATURE), "jaccard-signatures")
    linkable = sig.where("doc is not null and n > 0")
    classes = linkable.groupBy("digest").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("copies"))
    several = written(classes.where("copies > 1"), "jaccard-copies")
    several_side = _side(several)
    reps = linkable.join(several_side, "digest", "left").where("rep is null or rep = doc").withColumn("copies", F.coalesce("copies", F.lit(1)))

    sizes = {r.n: r["count"] for r in reps.where(F.col("n") <= MOST_SMALL).groupBy("n").count().collect()}
    small = small_boundary(sizes)
    edges = [subset_links(reps.where(F.col("n") <= small).select("doc", "n", "small"), small)]

    # Inverted lists: what is large, and small sets that a large one could link with.
    listed = reps.where(4 * F.col("n") >= 3 * (small + 1)).select("doc", "n", "keys", "copies")
    entries = listed.select("doc", "n", "copies", F.explode("keys").alias("key"))
    frequent = lambda df, c: df.where(F.col(c) > LIST).orderBy(F.desc(c), "key").limit(MOVED)
    first = written(frequent(entries.groupBy("key").agg(F.count(F.lit(1)).alias("c")), "c"), "jaccard-frequent")
    moved = _moved(first)
    late = None
    if len(moved):
        touched = lambda m: entries.join(F.broadcast(spark.createDataFrame(pd.DataFrame({"key": m.view(np.int64)}))), "key", "left_semi").select("doc").distinct()
        affected = text.join(_side(written(touched(moved), "jaccard-touched")), "doc", "left_semi")
        # What takes their place may be frequent too: the shingles next in order are counted as well.
        behind = affected.mapInArrow(_next_keys(spark.sparkContext.broadcast(moved)), "key long").groupBy("key").agg(F.count(F.lit(1)).alias("c"))
        moved = _moved(written_texts(frequent(first.unionByName(behind).groupBy("key").agg(F.sum("c").alias("c")), "c"), "jaccard-frequent"))
        again = written(touched(moved), "jaccard-touched")
        sent = spark.sparkContext.broadcast(moved)

        def reorder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = sent.value
            for b, sets in _texts(batches):
                keys = [in_order(s, m) if len(s) else s for s in sets]
                last = [among(k, m) for k in keys]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc"), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), _lists([k[~x] for k, x in zip(keys, last)]), _lists([k[x] for k, x in zip(keys, last)])],
                    ["doc", "d", "light", "late"],
                )

        side = _side(again)
        fresh = text.join(side, "doc", "left_semi").mapInArrow(lambda it: tidy(reorder(it)), "doc long, d binary, light array<long>, late array<long>")
        facts = reps.join(side, "doc", "left_semi").select(F.col("doc").alias("doc_"), F.col("digest").alias("d_"), "n", "copies")
        fresh = written_texts(fresh.join(facts, (F.col("doc") == F.col("doc_")) & (F.col("d") == F.col("d_"))).select("doc", "n", "copies", "light", "late"), "jaccard-reordered")
        entries = entries.join(side, "doc", "left_anti").unionByName(fresh.select("doc", "n", "copies", F.explode("light").alias("key")))
        late = fresh.select("doc", "n", "copies", F.explode("late").alias("key"))

    total = reps.agg(F.sum(F.size("keys"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // ENTRIES))
    meet = leaders(LIST)
    # Leaders come first: most copies, then the smallest id.
    dealt = entries.repartition(parts, "key").sortWithinPartitions("key", F.desc("copies"), "doc")
    lists = written(dealt.mapInArrow(lambda it: tidy(meet(it)), "list long, leader long, ln int, doc long, n int, c int"), "jaccard-lists")
    dense = lists.where(F.col("c") > LIST).select("leader", "doc", "ln", "n")
    if late is not None:
        dense = dense.unionByName(late_groups(late))
    dense = written(dense.distinct(), "jaccard-dense")

    sketches = reps.select("doc", "n", "sketch")
    met = lists.where(F.col("c") <= LIST).select("leader", "doc", "ln", "n").unionByName(dense)
    met = met.where("doc <> leader and 4 * least(n, ln) >= 3 * greatest(n, ln)").select(F.col("leader").alias("a"), F.col("doc").alias("b")).distinct()
    close = met.join(sketches.toDF("a", "na", "ka"), "a").join(sketches.toDF("b", "nb", "kb"), "b")
    close = written_texts(close.mapInArrow(lambda it: tidy(_possible(it)), "a long, b long"), "jaccard-close")
    sets = _sets_of(text, close.select("a").union(close.select("b")).union(dense.select("doc")).union(dense.select("leader")))
    linked = _verified(close, sets)
    near = linked.select(F.col("a").alias("leader"), F.col("b").alias("doc"), F.lit(True).alias("near"))
    edges += [linked, dense_links(dense, near, sets)]

    # Short lists again, where a set is apart from its leader. Equal lists have one number.
    rest = lists.where(F.col("c").between(3, LIST)).select("list", "leader", "doc", "n").dropDuplicates(["list", "doc", "n"]).join(near, ["leader", "doc"], "left")
    rest = rest.select("list", "doc", "n", F.col("near").isNull().alias("apart")).withColumn("any", F.max("apart").over(Window.partitionBy("list"))).where("any").drop("any")
    rest = rest.join(sketches, ["doc", "n"]).repartition(parts, "list").sortWithinPartitions("list")
    others = written_texts(rest.mapInArrow(rest_of_lists(small), "a long, b long").distinct(), "jaccard-rest")
    edges.append(_verified(others, _sets_of(text, others.select("a").union(others.select("b")))))

    union = edges[0]
    for e in edges[1:]:
        union = union.union(e)
    # Rows that share an id are one node: it joins the classes of its texts.
    shared = written(linkable.groupBy("doc").count().where("count > 1").select("doc"), "jaccard-shared")
    member = linkable.join(_side(shared), "doc", "left_semi").join(several_side.select("digest", "rep"), "digest").select(F.col("rep").alias("a"), F.col("doc").alias("b"))
    comps = connected_components(union.union(member))
    out = sig.select("doc", "n", "digest").join(several_side.select("digest", "rep"), "digest", "left")
    linkable_row = F.col("doc").isNotNull() & (F.col("n") > 0)  # empty sets share a digest, not a class
    out = out.withColumn("rep", F.when(linkable_row, F.coalesce("rep", "doc")).otherwise(F.col("doc")))
    out = out.join(comps.toDF("node", "component"), F.col("rep") == F.col("node"), "left")
    return out.select(F.col("doc").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))


def _moved(frequent: DataFrame) -> np.ndarray:
    """The shingles as a sorted array: at most MOVED, eight bytes each."""
    return np.sort(frequent.select("key").toArrow()["key"].to_numpy().astype(np.int64).view(np.uint64))


def _sets_of(text: DataFrame, docs: DataFrame) -> DataFrame:
    """The shingle sets of some documents, made anew from their texts."""
    ids = written(docs.toDF("doc").distinct(), "jaccard-involved")
    return written_texts(text.join(_side(ids), "doc", "left_semi").mapInArrow(lambda it: tidy(_sets(it)), "doc long, s binary").distinct(), "jaccard-sets")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` that link."""
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    return written_texts(both.mapInArrow(lambda it: tidy(_linked(it)), "a long, b long").distinct(), "jaccard-linked")


def subset_links(sets: DataFrame, small: int) -> DataFrame:
    """Links among small sets. A list is that of one subset and one pair of sizes
    (n <= m) that link exactly from the subset's size on: every set of size n in
    it links with all others there, so a star around one of them holds its links."""

    def enumerate_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, lows, keys = [], [], []
            for doc, s in zip(b.column("doc"), b.column("small")):
                s = s.as_py()
                for m in partners(len(s)):
                    if m > small:
                        continue
                    lo, hi = min(len(s), m), max(len(s), m)
                    for sub in combinations(s, overlap_needed(lo, hi)):
                        docs.append(doc.as_py()), lows.append(len(s) == lo)
                        keys.append(hashlib.blake2b(np.array([lo, hi, *sub], np.int64).tobytes(), digest_size=12).digest())
                    if len(docs) > 100_000:
                        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(lows, pa.bool_()), pa.array(keys, pa.binary())], ["doc", "low", "key"])
                        docs, lows, keys = [], [], []
            if docs:
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(lows, pa.bool_()), pa.array(keys, pa.binary())], ["doc", "low", "key"])

    rows = written(sets.mapInArrow(enumerate_, "doc long, low boolean, key binary"), "jaccard-subsets")
    centre = written(rows.groupBy("key").agg(F.min(F.when(F.col("low"), F.col("doc"))).alias("a"), F.count(F.lit(1)).alias("c")).where("c > 1 and a is not null").select("key", "a"), "jaccard-centres")
    return rows.join(centre, "key").where("doc <> a").select("a", F.col("doc").alias("b")).distinct()


def leaders(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Entries ordered by list, leaders first, to one row for each member but the
    leader: ``list, leader, ln, doc, n, c``. ``c`` is the number of members, or
    ``most + 1`` for all longer lists, which pass through without being held. Lists
    of three to ``most`` members are numbered by who is in them."""

    def rows(key: np.ndarray, doc: np.ndarray, n: np.ndarray, lead: tuple | None = None) -> pa.RecordBatch:
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        length = np.diff(np.r_[at, len(key)]) if lead is None else np.array([most + 1])
        of = np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(key)]))
        number = np.add.reduceat(_final(doc.view(np.uint64) * _MIX[0] + _MIX[1]), at)
        number = np.where((length >= 3) & (length <= most), number.view(np.int64), key[at])
        leader, ln = (doc[at][of], n[at][of]) if lead is None else (np.full(len(key), lead[0]), np.full(len(key), lead[1], np.int32))
        keep = (length[of] > 1) & (doc != leader)
        columns = (number[of], leader, ln, doc, n, np.minimum(length, most + 1)[of].astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], ["list", "leader", "ln", "doc", "n", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, long = None, None
        for b in batches:
            new = [b.column(c).to_numpy() for c in ("key", "doc", "n")]
            if long is not None:  # a list that is known to be long goes on
                k = int(np.searchsorted(new[0], long[0], "right"))
                if k:
                    yield rows(*(x[:k] for x in new), long[1:])
                new = [x[k:] for x in new]
                if not len(new[0]):
                    continue
                long = None
            if held is not None:
                new = [np.concatenate(x) for x in zip(held, new)]
            last = int(np.searchsorted(new[0], new[0][-1], "left")) if len(new[0]) else 0
            if last:
                yield rows(*(x[:last] for x in new))
            held = [x[last:] for x in new]
            if len(held[0]) > most:
                long = (held[0][0], held[1][0], held[2][0])
                yield rows(*held, long[1:])
                held = None
        if held is not None and len(held[0]):
            yield rows(*held)

    return run


def rest_of_lists(small: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows ``list, doc, n, apart, sketch`` ordered by list to the pairs of a list of which
    one is apart from the leader and whose sketches and sizes do not rule out a link."""

    def pairs(rows: list[tuple[int, int, bool, bytes]]) -> Iterator[tuple[int, int]]:
        by: dict[int, list[int]] = {}
        for i, r in enumerate(rows):
            by.setdefault(len(r[3]), []).append(i)
        doc, n, apart = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows])
        words = {w: np.frombuffer(b"".join(rows[i][3] for i in at), np.uint64).reshape(len(at), -1) for w, at in by.items()}
        for wide, x in words.items():
            i = np.array(by[wide])
            for narrow in (w for w in (wide, wide // 2) if w in words):  # sizes that link are at most one fold apart
                y, j, own = words[narrow], np.array(by[narrow]), x
                if narrow < wide:
                    own = x[:, : y.shape[1]] ^ x[:, y.shape[1] :]
                fit = (apart[i][:, None] | apart[j]) & (4 * np.minimum(n[i][:, None], n[j]) >= 3 * np.maximum(n[i][:, None], n[j])) & (np.maximum(n[i][:, None], n[j]) > small) & (doc[i][:, None] != doc[j])
                if wide == narrow:
                    fit &= i[:, None] < j
                p, q = np.nonzero(fit)
                for lo in range(0, len(p), 4096):
                    s = slice(lo, lo + 4096)
                    differ = np.bitwise_count(own[p[s]] ^ y[q[s]]).sum(1, dtype=np.int64)
                    ok = 7 * differ <= n[i[p[s]]] + n[j[q[s]]]
                    yield from zip(np.minimum(doc[i[p[s]][ok]], doc[j[q[s]][ok]]).tolist(), np.maximum(doc[i[p[s]][ok]], doc[j[q[s]][ok]]).tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, out = None, [], set()
        for b in batches:
            for number, *row in zip(*(b.column(c).to_pylist() for c in ("list", "doc", "n", "apart", "sketch"))):
                if number != at:
                    out.update(pairs(rows))
                    at, rows = number, []
                rows.append(row)
            if out:
                yield _pairs(out)
                out = set()
        out.update(pairs(rows))
        yield _pairs(out)

    return run


def _pairs(out: set[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*out) if out else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches do not rule out a link: 7 |A - B| <= |A| + |B|."""
    for b in batches:
        keep = [7 * parities_apart(x, y) <= n for x, y, n in zip(b.column("ka").to_pylist(), b.column("kb").to_pylist(), (b.column("na").to_numpy() + b.column("nb").to_numpy()).tolist())]
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, sets in _texts(batches):
        yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc", "s"])


def links(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 75 * (len(a) + len(b) - both)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = [links(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(b.column("sa"), b.column("sb"))]
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _next_keys(sent):
    """Keys behind the prefix of each set: three for each moved one within it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moved = sent.value
        for _, sets in _texts(batches):
            out = [np.zeros(0, np.uint64)]
            for s in sets:
                if len(s):
                    p = prefix_length(len(s))
                    out.append(s[p : p + 3 * int(among(s[:p], moved).sum())])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64))], ["key"])

    return run


def late_groups(late: DataFrame) -> DataFrame:
    """``leader, doc, ln, n``: members of each list of a moved shingle with its leader,
    the one with most copies (ties: the smallest id). Lists may be of any length."""
    late = written(late, "jaccard-late")
    first = late.groupBy("key").agg(F.max(F.struct("copies", (-F.col("doc")).alias("first"), "n")).alias("m"), F.count(F.lit(1)).alias("c")).where("c > 1")
    first = written(first.select("key", (-F.col("m.first")).alias("leader"), F.col("m.n").alias("ln")), "jaccard-leaders")
    return late.join(first, "key").where("doc <> leader").select("leader", "doc", "ln", "n")


def dense_links(dense: DataFrame, near: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of dense groups beyond those with the leader, as a forest of each pair of
    blocks. Two documents that both link with it are in one component already; those
    apart from it (``apart``) are compared with all of the group. Blocks hold one size
    class, and only blocks of neighbouring classes meet."""
    rows = dense.join(near, ["leader", "doc"], "left").select("leader", "doc", F.col("near").isNull().alias("apart"), F.floor(F.log("n") / float(np.log(RATIO)) + 1e-9).cast("int").alias("z"))
    rows = written(rows, "jaccard-dense-apart")
    blocks = rows.groupBy("leader", "z").agg(F.sum(F.col("apart").cast("int")).alias("l"), F.count(F.lit(1)).alias("g"))
    blocks = blocks.select("leader", "z", F.expr(f"cast((l + {BLOCK - 1}) div {BLOCK} as int)").alias("lb"), F.expr(f"cast((g + {BLOCK - 1}) div {BLOCK} as int)").alias("gb"))
    blocks = written(blocks, "jaccard-blocks")
    # (own class, block of the apart, other class, block of all)
    near_by = blocks.select("leader", "z", "lb", "gb", F.explode(F.array(F.col("z") - 1, F.col("z"), F.col("z") + 1)).alias("z2"))
    met = near_by.select("leader", "z", "z2", "lb", F.col("gb").alias("own")).join(blocks.select("leader", F.col("z").alias("z2"), F.col("lb").alias("lb2"), F.col("gb").alias("gb2")), ["leader", "z2"])
    met = written(met, "jaccard-blocks-met")
    bucket = lambda n: F.pmod(F.xxhash64("doc"), F.col(n)).cast("int")
    ways = _side(met)
    x = rows.where("apart").join(ways, ["leader", "z"]).select("leader", "z", bucket("lb").alias("i"), "z2", F.explode(F.sequence(F.lit(0), F.col("gb2") - 1)).alias("j"), "doc", F.lit(True).alias("apart"))
    y = rows.join(ways.where("lb2 > 0"), ["leader", "z"]).select("leader", F.col("z2").alias("z"), F.explode(F.sequence(F.lit(0), F.col("lb2") - 1)).alias("i"), F.col("z").alias("z2"), bucket("own").alias("j"), "doc", F.lit(False).alias("apart"))
    tiles = x.union(y).join(sets, "doc")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[pdf["apart"]], pdf[~pdf["apart"]]
        if not len(x) or not len(y):
            return pd.DataFrame({"a": [], "b": []})
        own = [np.frombuffer(s, np.uint64) for s in y["s"]]
        sizes = np.array([len(s) for s in own])
        flat = np.concatenate(own)
        order = np.argsort(flat, kind="stable")
        ordered, of = flat[order], np.repeat(np.arange(len(own)), sizes)[order]
        nodes, at = np.unique(np.concatenate([x["doc"], y["doc"]]), return_inverse=True)
        i, j = [], []
        for k, s in enumerate(x["s"]):
            s = np.frombuffer(s, np.uint64)
            lo, hi = np.searchsorted(ordered, s, "left"), np.searchsorted(ordered, s, "right")
            n = hi - lo
            where = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            both = np.bincount(of[where], minlength=len(own))
            hit = np.flatnonzero(100 * both >= 75 * (len(s) + sizes - both))
            i.append(np.full(len(hit), at[k])), j.append(at[len(x) + hit])
        root = forest(len(nodes), np.concatenate(i), np.concatenate(j))
        moved = root != np.arange(len(nodes))
        return pd.DataFrame({"a": nodes[root[moved]], "b": nodes[moved]})

    return written(tiles.groupBy("leader", "z", "i", "z2", "j").applyInPandas(compare, "a long, b long"), "jaccard-dense-links")
