"""Queries without SQL read all eight children."""

import numpy as np
from pyspark.sql import functions as F

from kinweave.operators import hmm
from kinweave.plans import fixtures, registry

DATA = "/root/testdata/sf0.001"


def test_viterbi_has_a_state_for_each_set_of_eight(spark):
    site, gt = fixtures.views(spark, DATA, "fx_site", "fx_gt")
    carries = (F.coalesce("g0", F.lit(0)) > 0) | (F.coalesce("g1", F.lit(0)) > 0)
    calls = site.join(gt.where("i >= 6"), "site_id").groupBy("chrom", "pos0").agg(F.collect_list(F.when(carries, F.col("i"))).alias("who"), F.count(F.lit(1)).alias("n"))
    want = {(r["chrom"], r["pos0"]): sum(1 << (i - 6) for i in r["who"]) for r in calls.collect()}
    got = registry.QUERIES["hmm_viterbi"](spark, DATA).collect()
    assert {(r["chrom"], r["pos0"]): r["observed"] for r in got} == want
    assert max(want.values()) > 7


def test_viterbi_of_eight_is_the_dense_one():
    seen = np.random.default_rng(2).integers(0, 256, 12)
    flips = np.array([[bin(a ^ b).count("1") for b in range(256)] for a in range(256)])
    step = np.where(flips == 0, np.log(hmm.STAY), flips * np.log(hmm.SWITCH))
    emit = lambda o: np.where(np.arange(256) == o, np.log(hmm.MATCH), np.log(hmm.DIFFER))
    dense = emit(seen[0]) - 8 * np.log(2)
    for o in seen[1:]:
        dense = (dense[:, None] + step).max(axis=0) + emit(o)
    assert abs(hmm.viterbi(seen, 8)[1] - dense.max()) < 1e-9


def test_flips_hold_labels_of_eight(spark):
    got = registry.QUERIES["phase_flips"](spark, DATA).collect()
    assert got and all(len(r["labels"]) == 16 for r in got)
