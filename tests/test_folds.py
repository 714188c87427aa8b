"""Ordered folds, the hidden-Markov path, the haplotype graph and projections."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.operators import assembly, hapmap, haplograph, hmm, sv


def test_viterbi_is_the_dense_one():
    rng = np.random.default_rng(0)
    n, size = 3, 8
    order = hmm.state_order(n)
    assert order.tolist() == [0, 1, 2, 4, 3, 5, 6, 7]
    for _ in range(25):
        seen = rng.integers(0, size, 6)
        weight = lambda a, b: math.log(hmm.STAY) if a == b else bin(a ^ b).count("1") * math.log(hmm.SWITCH)
        emit = lambda s, o: math.log(hmm.MATCH if s == o else hmm.DIFFER)
        best = max(
            -n * math.log(2) + sum(emit(s, o) for s, o in zip(path, seen)) + sum(weight(a, b) for a, b in zip(path, path[1:]))
            for path in itertools.product(range(size), repeat=len(seen))
        ) if len(seen) <= 4 else None
        path, score = hmm.viterbi(seen, n)
        own = -n * math.log(2) + sum(emit(s, o) for s, o in zip(path, seen)) + sum(weight(a, b) for a, b in zip(path, path[1:]))
        assert own == pytest.approx(score)
        dense = np.array([emit(s, seen[0]) - n * math.log(2) for s in range(size)])
        for o in seen[1:]:
            dense = np.array([max(dense[a] + weight(a, b) for a in range(size)) + emit(b, o) for b in range(size)])
        assert score == pytest.approx(dense.max())
        assert best is None or score == pytest.approx(best)
    assert hmm.viterbi(np.zeros(0, np.int64), 3)[0].size == 0


@pytest.mark.parametrize("most", [1, 40, 20_000])
def test_path_over_windows_is_the_uncut_one(spark, most):
    """Lines of different lengths, cut into windows of any size; and the whole table, line by line."""
    rng = np.random.default_rng(5)
    rows = [(c, int(p), int(x)) for c, n in (("a", 6 if most == 1 else 130), ("b", 3 if most == 1 else 41), ("c", 1)) for p, x in enumerate(np.repeat(rng.integers(0, 8, n // 3 + 1), 3)[:n] ^ rng.choice([0, 0, 0, 1, 2], n))]
    df = spark.createDataFrame(rows, "chrom string, pos0 long, observed long").repartition(3)
    got = {(r["chrom"], r["pos0"]): r["state"] for r in hmm.viterbi_paths(hmm.cut_windows(df, most), 3, ["chrom"]).collect()}
    for c in "abc":
        seen = np.array([x for k, _, x in rows if k == c])
        assert [got[c, p] for p in range(len(seen))] == hmm.viterbi(seen, 3)[0].tolist()
    assert hmm.viterbi_paths(hmm.cut_windows(df.limit(0), most), 3, ["chrom"]).count() == 0


def test_viterbi_of_the_table(spark):
    from kinweave.plans import fixtures, hmm_queries, registry

    data = "/root/testdata/sf0.001"
    seen = hmm_queries._observed(*fixtures.views(spark, data, "fx_site", "fx_gt")).toPandas().sort_values(["chrom", "pos0"])
    whole = {(r["chrom"], r["pos0"]): r["state"] for r in registry.QUERIES["hmm_viterbi"](spark, data).collect()}
    cut = hmm.viterbi_paths(hmm.cut_windows(hmm_queries._observed(*fixtures.views(spark, data, "fx_site", "fx_gt")), 90), 8, ["chrom"])
    assert {(r["chrom"], r["pos0"]): r["state"] for r in cut.collect()} == whole
    for chrom, rows in seen.groupby("chrom"):
        assert [whole[chrom, p] for p in rows["pos0"]] == hmm.viterbi(rows["observed"].to_numpy(), 8)[0].tolist()


def test_sites_are_computed_once_whatever_the_windows(spark):
    rows = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            rows.add(batch.num_rows)
            yield batch

    df = spark.range(60).selectExpr("'a' as chrom", "id as pos0", "id % 4 as observed", "cast(id div 10 as int) as window")
    assert hmm.viterbi_paths(df.mapInArrow(seen, df.schema), 2, ["chrom"]).count() == 60
    assert rows.value == 60


def test_a_long_switch_is_followed():
    seen = np.array([1] * 60 + [3] * 60)
    assert hmm.viterbi(seen, 2)[0].tolist() == seen.tolist()
    noisy = np.array([1] * 20 + [3] * 5 + [1] * 20)
    assert set(hmm.viterbi(noisy, 2)[0].tolist()) == {1}


@pytest.mark.parametrize("length", [9, 10, 16, 17, 18, 30])
def test_short_runs(spark, length):
    rows = [("c", i, "x", 0, "A") for i in range(length)] + [("c", length, "x", 0, "B")]
    df = spark.createDataFrame(rows, "chrom string, b long, id string, slot int, label string")
    masked = {r["b"] + 1 for r in hapmap.short_run_mask(df, 10).where("masked and label = 'A'").collect()}
    assert masked == (set(range(1, length + 1)) if length < 10 else set(range(length - 8, 10)))


def test_haplotype_graph():
    assert haplograph.haplotype("acgtacgt", 100, [(101, "C", "T"), (103, "TA", "T"), (106, "G", "GAA")]) == "aTgtcgAAt"
    ways = haplograph.Ways([(10, "A", "T"), (10, "A", "C"), (20, "A", "G")])
    assert [ways[k] for k in range(len(ways))] == [[0, 2], [1, 2]]
    with pytest.raises(ValueError, match="reference"):
        haplograph.haplotype("aaa", 0, [(1, "C", "T")])


def test_projection(spark):
    df = spark.createDataFrame([("5M2D3M2I4M", t) for t in range(16)], "c string, t long").withColumn("q", assembly.project(assembly.parse_cigar(F.col("c")), F.lit(0), F.col("t")))
    assert [r["q"] for r in df.orderBy("t").collect()] == [0, 1, 2, 3, 4, 5, 5, 5, 6, 7, 10, 11, 12, 13, None, None]


def test_best_primary_takes_a_later_one_in_reach(spark):
    rows = [("s", "p1", 0, 10, 5, False), ("s", "p2", 1, 10, 40, True), ("s", "p3", 2, 10, 60, True), ("t", "p1", 0, 10, 5, True)]
    df = spark.createDataFrame(rows, "support_id string, primary_id string, s long, e long, diff long, same_gt boolean")
    assert [tuple(r) for r in sv.best_primary(df).collect()] == [("s", "p2")]


def test_strip(spark):
    info = spark.createDataFrame([({"AC": "3", "MAF": "0.1", "HOMLEN": "0", "HOMSEQ": "AC"},)], "i map<string,string>")
    assert info.select(sv.strip_info(F.col("i"), ["AC"], ["HOMLEN", "HOMSEQ"])).first()[0] == {"MAF": "0.1", "HOMLEN": "0"}
