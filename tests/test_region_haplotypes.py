"""Ways through regions against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from kinweave.operators import haplograph
from kinweave.plans import fixtures, registry


def test_a_region_of_many_ways_is_whole(spark):
    rows = [("r", "A" * 12, 0, i, "A", x) for i in range(8) for x in "CGT"] + [("s", "ACGT", 5, 6, "C", "T")]
    df = spark.createDataFrame(rows, "region string, sequence string, offset long, pos long, ref string, alt string")
    got = haplograph.region_haplotypes(df).collect()
    want = ["".join(x) + "AAAA" for x in itertools.product("CGT", repeat=8)]  # 6,561 ways
    assert [r["haplotype"] for r in sorted(got, key=lambda r: r["path"]) if r["region"] == "r"] == want
    assert all(r["complete"] and r["n_variants"] == (8 if r["region"] == "r" else 1) for r in got)
    assert [r["haplotype"] for r in got if r["region"] == "s"] == ["ATGT"]


def test_ways_are_the_maximal_sets():
    variants = sorted([(1, "A", "T"), (1, "A", "C"), (2, "AAA", "A"), (3, "A", "G"), (7, "AA", "A"), (8, "A", "C")])
    start = [p + (haplograph.variant_kind(r, a) != "SNV") for p, r, a in variants]
    end = [max(haplograph.variant_end(*v), s) for v, s in zip(variants, start)]
    apart = lambda i, j: start[j] > end[i] or start[i] > end[j]
    free = [c for k in range(len(variants) + 1) for c in itertools.combinations(range(len(variants)), k) if all(apart(i, j) for i, j in itertools.combinations(c, 2))]
    want = [list(c) for c in free if not any(all(apart(i, j) for i in c) for j in range(len(variants)) if j not in c)]
    ways = haplograph.Ways(variants)
    assert [ways[k] for k in range(len(ways))] == sorted(want)


def each_way(variants):
    """All ways by walking, one after the other."""
    start = [p + (haplograph.variant_kind(r, a) != "SNV") for p, r, a in variants]
    end = [haplograph.variant_end(p, r, a) for p, r, a in variants]

    def walk(path, last):
        after = [i for i in range(len(variants)) if start[i] > last]
        nxt = [i for i in after if start[i] <= min(end[j] for j in after)]
        if not nxt:
            yield path
        for i in nxt:
            yield from walk([*path, i], max(end[i], start[i]))

    return list(walk([], -1 << 60))


@pytest.mark.parametrize("seed", range(40))
def test_ways_by_number_are_the_walk(seed):
    rng = random.Random(seed)
    bases = lambda: "".join(rng.choices("ACGT", k=rng.choice([1, 1, 1, 2, 4])))
    variants = sorted({(rng.randrange(14), bases(), bases()) for _ in range(rng.randrange(0, 11))})
    ways = haplograph.Ways(variants)
    assert [ways[k] for k in range(len(ways))] == each_way(variants)


def test_one_region_is_many_tasks(spark):
    rows = [("r", "A" * 30, 0, i, "A", x) for i in range(9) for x in "CGT"]
    df = spark.createDataFrame(rows, "region string, sequence string, offset long, pos long, ref string, alt string")
    got = haplograph.region_haplotypes(df, share=500)
    assert got.groupBy(F.spark_partition_id()).count().count() > 1
    assert sorted(r["path"] for r in got.collect()) == list(range(3**9))
    # any way can be asked for alone, among more than could be made
    many = spark.createDataFrame([("r", "A" * 30, 0, i, "A", x) for i in range(30) for x in "CGT"], df.schema)
    some = haplograph.some_haplotypes(many, spark.createDataFrame([("r", 0), ("r", 3**30 - 1), ("r", 3**29), ("r", 3**30), ("x", 1)], "region string, path long")).collect()
    assert {r["path"]: r["haplotype"] for r in some} == {0: "C" * 30, 3**30 - 1: "T" * 30, 3**29: "G" + "C" * 29}
    with pytest.raises(Exception, match="ways through one region"):
        haplograph.region_haplotypes(spark.createDataFrame([("r", "A" * 80, 0, i, "A", x) for i in range(50) for x in "CGT"], df.schema)).count()


def test_query_takes_all_sites(spark):
    data = "/root/testdata/sf0.001"
    site = fixtures.view(spark, data, "fx_site")
    want = site.groupBy(F.expr("cast(pos0 div 40000 as string)").alias("region")).agg(F.countDistinct(F.col("pos0") % 40).alias("n")).collect()
    got = registry.QUERIES["region_haplotypes"](spark, data).groupBy("region").agg(F.max("n_variants").alias("n")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
