"""Orientations written out and as a sequence say the same."""

import random

from pyspark.sql import functions as F

from kinweave.operators import phasing


def test_orientations_agree(spark):
    rng = random.Random(2)
    call = lambda i: (f"s{i}", rng.choice([0, 1, 2, None]), rng.choice([0, 1]), rng.choice(["A", "B", "C", "D", "E", ".", "?", None]), rng.choice(["A", "B", "C", "F", "?"]))
    rows = [(k, *[rng.choice([0, 1, 2, None]) for _ in range(6)], [call(i) for i in range(5)]) for k in range(60)]
    df = spark.createDataFrame(rows, "site_id long, f0_0 int, f0_1 int, f1_0 int, f1_1 int, f2_0 int, f2_1 int, calls array<struct<id:string,g0:int,g1:int,h0:string,h1:string>>")
    got = df.select(phasing.orientations(3).alias("a"), phasing.orientations(3, written_out=0).alias("b")).collect()
    assert all(r["a"] == r["b"] and len(r["a"]) == 8 for r in got)
    # a plan for many founders stays small
    many = df.select(*[F.lit(0).alias(f"f{j}_{k}") for j in range(12) for k in (0, 1)], "calls").select(phasing.orientations(12).alias("x"))
    assert len(many._jdf.queryExecution().optimizedPlan().toString()) < 200_000


def test_flips_compute_their_blocks_once(spark):
    """The scans, and the blocks that say nothing, read stored rows."""
    from kinweave.operators.phases import flip_phases

    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    df = spark.range(40).selectExpr("'c' as chrom", "id * 10 as start_pos", "id * 10 as end_pos", "1L as n_markers", "if(id % 7 = 0, '????', if(id % 2 = 0, 'ACBC', 'BCAC')) as labels")
    flipped = flip_phases(df.mapInArrow(seen, df.schema), ["AB"], [0, 1, 2, 3]).collect()
    assert len(flipped) == 40 and {r["labels"] for r in flipped} == {"????", "BCAC"}
    assert made.value == 40


def test_orientations_are_tried_once(spark):
    """No filter on what they decide is pushed below, where they would be tried again."""
    from kinweave.plans import registry
    from tests.test_queries import DATA

    def plan(name):
        return registry.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()

    for name in ("orientation_block_stats", "failed_singletons"):
        assert plan(name).count("array_min(") == 1, name
    filters = [line for line in plan("phased_genotypes").splitlines() if line.lstrip(" +-:").startswith("Filter")]
    assert not any("forall(" in line for line in filters)


def test_a_block_of_low_quality_has_no_row(spark):
    calls = "array<struct<id:string,g0:int,g1:int,dp:int,h0:string,h1:string>>"
    one = [("s1", 0, 1, 30, "A", "B")]
    rows = [("c", 1, "low_qual", 1, ["s1"], one), ("c", 2, "fail", 1, ["s1"], one), ("c", 2, "fail", 1, ["s2"], one), ("c", 2, "fail", 1, ["s1"], one), ("c", 2, "pass", 0, [], one), ("c", 2, "low_qual", 1, ["s9"], one)]
    df = spark.createDataFrame(rows, f"chrom string, b long, status string, m int, wrong array<string>, calls {calls}").withColumn("best", F.struct(F.col("m").alias("mismatches"), "wrong"))
    got = [r.asDict() for r in phasing.orientation_stats(df).collect()]
    assert got == [{"chrom": "c", "b": 2, "passing": 1, "failing": 3, "nocall": 0, "singletons": "s1:2;s2:1", "rate": 0.25}]
    assert sorted((r["b"], r["id"], r["n"]) for r in phasing.failed_singletons(df).collect()) == [(2, "s1", 2), (2, "s2", 1)]
