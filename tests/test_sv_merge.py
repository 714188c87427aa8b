"""Merging of callers against its SQL on odd calls, and what it shuffles."""

import pathlib
import random

import duckdb
import pytest

from kinweave.operators import sv
from kinweave.operators.storage import shared_folder
from kinweave.plans import registry, sv_queries

COLUMNS = "id string, prio int, chrom string, svtype string, start_pos long, end_pos long, svlen long"


def _odd_calls(seed):
    """Crowded, long, reversed, repeated and placeless calls of four callers, and a fifth that isn't asked for."""
    rng = random.Random(seed)
    rows = []
    for i in range(500):
        start = rng.choice([rng.randrange(40_000), rng.randrange(0, 40_000, 2_000), 16_384 * rng.randrange(4) + rng.randrange(-210, 210)])
        size = rng.choice([0, 0, 1, 50, 300, 900, -300, -500, -2_000, rng.randrange(20_000)] + ([70_000] if i % 50 == 0 else []))
        row = (f"c{i}", rng.choice([0, 1, 1, 2, 2, 3, 3, 4]), rng.choice(["chr1", "chr1", "chr2", None]) if i % 9 == 0 else "chr1", rng.choice(["INS", "DEL", "INV"]), start if i % 61 else None, start + size, rng.choice([size, -size]))
        rows += [row] * rng.choice([1] * 9 + [2, 3])
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_merge_of_odd_calls(spark, seed):
    rows = _odd_calls(seed)
    calls = spark.createDataFrame(rows, COLUMNS).repartition(3)
    db = duckdb.connect()
    db.sql(f"create table fx_sv ({COLUMNS.replace('string', 'varchar').replace('long', 'bigint')})")
    db.executemany("insert into fx_sv values (?, ?, ?, ?, ?, ?, ?)", rows)
    heads = f"with {sv_queries._MERGED}"
    order = lambda xs: sorted(map(tuple, xs), key=repr)
    primaries, links = sv.merge_callers(calls, 4)
    assert order(primaries.select("id", "prio").collect()) == order(db.sql(f"{heads} select id, prio from p3").fetchall())
    assert order(links.select("primary_id", "support_id", "round").collect()) == order(db.sql(f"{heads} select * from lk").fetchall())
    with_gt = sv_queries._with_gt(calls)
    table = sv.support_table(with_gt, 4).select("primary_id", "n_support", "n_sources", "gt_consistent")
    want = db.sql(f"{heads} select * from sup").fetchall()
    assert order(table.collect()) == order(want) and len(want) > 50 and {w[2] for w in want} > {1, 2}
    best = registry.ORACLES["sv_best_primary"]
    sql = heads + best[best.index(", x as (select lk.support_id"):]
    assert order(sv.best_primaries(with_gt, 4).select("support_id", "primary_id").collect()) == order(db.sql(sql).fetchall())


@pytest.mark.parametrize("name", ["sv_gt_consistency", "sv_support_stats", "sv_best_primary"])
def test_links_are_neither_shuffled_nor_stored(spark, name):
    """360,000 links of 1,200 calls; only calls travel."""
    rows = [(f"caller{i % 2}.{i * 7919 % 10007}", i % 2, "chr1", "DEL", 5000 + i % 7, 5300 + i % 11, -i % 13) for i in range(1_200)]
    store = spark.sparkContext._jsc.sc().statusStore()

    def written():
        executors = store.executorList(False)
        stored = sum(f.stat().st_size for f in pathlib.Path(shared_folder(spark).removeprefix("file:")).rglob("*") if f.is_file())
        return stored + sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))

    before = written()
    got = getattr(sv_queries, name)(spark.createDataFrame(rows, COLUMNS).repartition(3)).collect()
    assert len(got) == (1 if name == "sv_support_stats" else 600)
    assert written() - before < 500_000
