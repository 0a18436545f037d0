"""Laws that hold for any stores: random small cases."""

import random

import pytest

from lodestack.operators import combinators, sets, stores
from lodestack.plans.build import build
from lodestack.session import shared_dir, sweep, written
from tests.test_operators import blobs

LETTERS = "abcdefgh"


def pick(rng):
    return [c for c in LETTERS if rng.random() < 0.5]


def keys(df):
    return {r.hash for r in df.collect()}


@pytest.mark.parametrize("seed", range(4))
def test_missing_keys_and_repairs(spark, seed):
    rng = random.Random(seed)
    req, a, b = (blobs(spark, *(pick(rng) or ["z"])) for _ in range(3))
    missing = combinators.mirrored_find_missing(req, a, b)
    assert keys(missing) <= keys(req)
    assert keys(missing) == keys(req) - keys(a) - keys(b)
    assert keys(combinators.fallback_missing(req, a, b)) == keys(missing)
    repairs = combinators.mirrored_repairs(req, a, b)
    assert keys(repairs) == keys(req) & (keys(a) ^ keys(b))
    # what a fallback repairs, the primary then has
    fills = combinators.fallback_repairs(req, a, b)
    healed = a.select(*sets.KEY).unionByName(fills)
    assert combinators.fallback_repairs(req, healed, b).count() == 0
    assert keys(stores.find_missing(req, healed)) == keys(missing)
    sides = sets.difference_and_intersection(a, b).collect()
    assert {r.hash for r in sides if r.side == "both"} == keys(a) & keys(b)


@pytest.mark.parametrize("seed", range(2))
def test_sharding_changes_no_answer(spark, seed):
    rng = random.Random(seed + 10)
    req, a = blobs(spark, *LETTERS), blobs(spark, *(pick(rng) or ["z"]))
    plan = {"sharding": {f"s{i}": {"weight": rng.randrange(1, 9), "backend": {"local": "a"}} for i in range(3)}}
    assert keys(build(plan, {"a": a}).find_missing(req)) == keys(stores.find_missing(req, a))


def test_written_tables_are_swept(spark):
    import os

    df = written(spark.range(3), "here")
    assert df.count() == 3 and os.path.isdir(f"{shared_dir(spark)}/lodestack")
    sweep(spark)
    assert not os.path.isdir(f"{shared_dir(spark)}/lodestack")
