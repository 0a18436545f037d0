"""The driver's contract: each query runs on small tables and equals its SQL."""

import os

import pytest

import __spark_entry__ as entry
from lodestack import queries as core

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if v is None or v != v:
        return None
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, duck, name):
    df = core.QUERIES[name](spark, SF)
    rows = [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]
    if name in core.ORACLE:
        got = duck.execute(core.ORACLE[name])
        cols = [d[0] for d in got.description]
        assert sorted(cols) == sorted(df.columns)
        want = [tuple(dict(zip(cols, r))[c] for c in sorted(cols)) for r in got.fetchall()]
        norm = lambda rs: sorted((tuple(map(plain, r)) for r in rs), key=str)
        assert norm(rows) == norm(want)
    else:
        assert rows


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_run_from_any_folder(tmp_path):
    """Python workers find the package though nothing that they inherit names it."""
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(entry.__file__).resolve().parent
    code = f"""
import sys
sys.path.insert(0, {str(repo)!r})
from pyspark.sql import SparkSession
import __spark_entry__ as e
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("rows", e.queries()["rate_sampler"](spark, {SF!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 1000" in out.stdout, out.stderr[-2000:]
