"""Time-stateful operators: caches, samplers and health, as folds over a key's events.

The windows are anchored: one starts at the event that changed the state last,
which no fixed window reproduces. Each operator is one small step function over
a state. In batch it runs per key over time-ordered events
(``groupBy.applyInPandas`` streams sorted pieces, see :func:`fold`); in a stream
the same step runs in ``applyInPandasWithState``.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: (state or None, time in microseconds, payload) -> (new state, answer)
Step = Callable[[tuple | None, int, object], tuple[tuple, str]]


def existence_step(ttl_us: int) -> Step:
    """hit while the last insertion is at most ``ttl`` old; a hit does not extend it."""

    def step(state: tuple | None, ts: int, _: object) -> tuple[tuple, str]:
        if state is not None and state[0] >= ts - ttl_us:
            return state, "hit"
        return (ts,), "miss"

    return step


def expiring_step() -> Step:
    """A response cache: each entry brings its own lifetime in microseconds."""

    def step(state: tuple | None, ts: int, lifetime: object) -> tuple[tuple, str]:
        if state is not None and state[0] > ts:
            return state, "cached"
        return (ts + int(lifetime or 0),), "asked"

    return step


def sampler_step(n: int, epoch_us: int) -> Step:
    """``n`` samples an epoch; a new epoch begins with the first request at or after
    the end of the last one once its quota is used up. Unused quota stays."""

    def step(state: tuple | None, ts: int, _: object) -> tuple[tuple, str]:
        left, end = state or (0, None)
        if left > 0:
            return (left - 1, end), "sampled"
        if end is None or ts >= end:
            return (n - 1, ts + epoch_us), "sampled"
        return (left, end), "dropped"

    return step


def canary_step(lasts_us: int) -> Step:
    """Health of a replica: without a valid verdict the request is the canary; its
    outcome (payload true: infrastructure error) decides for ``lasts`` from there."""

    def step(state: tuple | None, ts: int, failed: object) -> tuple[tuple, str]:
        if state is None or ts >= state[1]:
            healthy = not bool(failed)
            return (int(healthy), ts + lasts_us), "canary" if healthy else "canary_retried_on_source"
        return state, "replica" if state[0] else "source"

    return step


def fold(events: DataFrame, key: str, ts_us: str, tie: str, step: Step, payload: str | None = None) -> DataFrame:
    """``key, ts_us, tie, answer`` per event, in batch.

    Events are dealt to partitions by key and sorted within them; a partition is
    read as a stream, with the state of one key at a time. A hot key is one long
    sequential fold by nature, but it never has to fit in memory. Events without a
    key are those of one key; an event without a time has no answer and changes nothing.
    """
    cols = [F.col(key).alias("k"), F.col(ts_us).cast("long").alias("t"), F.col(tie).alias("i"), (F.col(payload) if payload else F.lit(None).cast("int")).alias("p")]
    rows = events.select(*cols).repartition("k").sortWithinPartitions("k", "t", "i")
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = object(), None
        for b in batches:  # Arrow, since pandas turns keys beside a null into doubles
            out = []
            for k, t, p in zip(*(b.column(c).to_pylist() for c in ("k", "t", "p"))):
                if k != at:
                    at, state = k, None
                if t is None:
                    out.append(None)
                    continue
                state, answer = step(state, t, p)
                out.append(answer)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("k", "t", "i")), pa.array(out, pa.string())], ["k", "t", "i", "answer"])

    out = rows.mapInArrow(run, f"k {types['k']}, t long, i {types['i']}, answer string")
    return out.toDF(key, ts_us, tie, "answer")


def fold_stream(events: DataFrame, key: str, ts_us: str, tie: str, step: Step, width: int, payload: str | None = None) -> DataFrame:
    """The same answers over a stream: state (``width`` longs) is kept per key and
    checkpointed by Spark. Events of a key are folded in time order within each
    micro-batch; across batches in order of arrival, as the reference does."""
    cols = [F.col(key).cast("string").alias("k"), F.col(ts_us).cast("long").alias("t"), F.col(tie).cast("long").alias("i"), (F.col(payload).cast("long") if payload else F.lit(None).cast("long")).alias("p")]
    names = [f"s{i}" for i in range(width)]

    def run(group: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = tuple(held.get) if held.exists else None
        pdf = pd.concat(list(frames)).sort_values(["t", "i"])
        out = []
        for t, p in zip(pdf["t"], pdf["p"]):
            state, answer = step(state, t, None if pd.isna(p) else p)
            out.append(answer)
        held.update(tuple(int(x) for x in state))
        yield pdf[["k", "t", "i"]].assign(answer=out)

    out = events.select(*cols).groupBy("k").applyInPandasWithState(run, "k string, t long, i long, answer string", ", ".join(f"{n} long" for n in names), "append", GroupStateTimeout.NoTimeout)
    return out.toDF(key, ts_us, tie, "answer")


class Evicting:
    """A bounded key set in FIFO or LRU order."""

    def __init__(self, capacity: int, policy: str):
        if policy not in ("FIFO", "LRU"):
            raise ValueError(f"INVALID_ARGUMENT: policy {policy}")
        self.capacity, self.policy, self.keys = capacity, policy, OrderedDict()

    def touch(self, key: object) -> bool:
        """Whether the key is held; LRU moves it to the end."""
        if key not in self.keys:
            return False
        if self.policy == "LRU":
            self.keys.move_to_end(key)
        return True

    def insert(self, key: object, value: object = None) -> list[object]:
        """Make room first, then insert; the keys evicted for it."""
        gone = []
        while len(self.keys) >= self.capacity:
            gone.append(self.keys.popitem(last=False)[0])
        self.keys[key] = value
        return gone


def cache_simulation(events: DataFrame, store: str, key: str, ts_us: str, tie: str, capacity: int, policy: str = "LRU", ttl_us: int | None = None) -> DataFrame:
    """Per access of a bounded cache: ``hit``, and ``evicted`` (the key that left, or
    null). Caches are per ``store``; the state is bounded by ``capacity``. With a
    TTL an entry older than it counts as absent, and room is made before the
    cache notices that the key is there already."""
    rows = events.select(F.col(store).alias("s"), F.col(key).cast("string").alias("k"), F.col(ts_us).cast("long").alias("t"), F.col(tie).alias("i")).repartition("s").sortWithinPartitions("s", "t", "i")
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, cache = object(), None
        for pdf in frames:
            hits, gone = [], []
            for s, k, t in zip(pdf["s"], pdf["k"], pdf["t"]):
                if s != at:
                    at, cache = s, Evicting(capacity, policy)
                fresh = cache.touch(k) and (ttl_us is None or cache.keys[k] >= t - ttl_us)
                out = []
                if not fresh:
                    if ttl_us is not None and len(cache.keys) >= capacity:
                        out = [cache.keys.popitem(last=False)[0]]
                    if k in cache.keys:
                        cache.keys[k] = t
                        cache.keys.move_to_end(k)
                    else:
                        out += cache.insert(k, t)
                hits.append(bool(fresh)), gone.append(out[0] if out else None)
            yield pdf[["s", "k", "t", "i"]].assign(hit=hits, evicted=gone)

    out = rows.mapInPandas(run, f"s {types['s']}, k string, t long, i {types['i']}, hit boolean, evicted string")
    return out.toDF(store, key, ts_us, tie, "hit", "evicted")


def replicate_once(requests: DataFrame, sink: DataFrame, key: list[str]) -> DataFrame:
    """Concurrent requests for a key copy it once; the sink is asked again first."""
    return requests.select(*key).distinct().join(sink.select(*key), key, "left_anti")
