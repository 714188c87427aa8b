"""Every registered query against its SQL oracle on the smallest tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from kinweave.plans import fixtures, registry

DATA = os.environ.get("KINWEAVE_TESTDATA", "/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def _plain(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return (2, round(float(v), 6))
    return (3, str(v))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(map(_plain, r)) for r in df.select(*columns).collect())
    if name not in registry.ORACLES:
        assert got
        return
    cursor = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(_plain(r[i]) for i in at) for r in cursor.fetchall())


def test_no_pairwise_plans(spark):
    """Joins by place don't fall back to comparing all pairs."""
    for name in ("overlap_join_binned", "bed_subtract", "site_block_join", "sv_shared_exclusive", "tr_locus_blocks"):
        plan = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_alleles_are_dealt_by_locus(spark, monkeypatch):
    """A view that multiplies a small table isn't one task's, and what follows by locus shuffles no allele."""
    part = spark.range(20_001).select(F.col("id").alias("p_partkey"), F.lit(7).alias("p_size"))
    assert fixtures.dealt(part, "p_partkey").rdd.getNumPartitions() == 5
    assert fixtures.dealt(part.limit(0), "p_partkey").count() == 0
    monkeypatch.setattr(fixtures.dealt, "__defaults__", (50,))
    plan = registry.QUERIES["tr_best_assign"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "hashpartitioning" in x]
    assert dealt and all("hashpartitioning(p_partkey" in x for x in dealt)
