"""Reasons for bad lines, pedigree checks, and trios over three generations."""

import pytest

from kinweave.operators import normalise, pedigree, truthset
from kinweave.plans import fixtures, registry
from kinweave.sources import validation
from kinweave.sources import writers as wr

BAD = {
    "bed": (["c 1 2", "c\t1\t2\tx"], ["c 1", "c x 2", "c 5 2"]), "ped": (["f a NA 0 1 2"], ["f a", "f a a b 1 2", "f a b c m 2"]),
    "vcf": (["c\t1\t.\tA\tC\t.\t.\t.", "c\t1\t.\tA\tC\t9\t.\t.\tGT:DP\t0|1:3\t./."], ["c\t1", "c\tx\t.\tA\tC\t9\t.\t.", "c\t1\t.\tA?\tC\t9\t.\t.", "c\t1\t.\tA\tC\tz\t.\t.", "c\t1\t.\tA\tC\t9\t.\t.\tGT\t0-1"]),
    "inheritance": (["c,1,2,AC,BD"], ["c,1,2", "c,x,2,AC", "c,3,2,AC", "c,1,2,A"]), "iht": (["c 1 2 A/B 4"], ["c 1 2", "c a 2 A/B 4", "c 3 2 A/B 4", "c 1 2 AB 4"]),
    "paf": (["a\t1\t0\t1\t+\tb\t1\t0\t1\t1\t5\t60\tNM:i:3"], ["a", "a\t1\t0\t1\t+\tb\t1\t0\t1\t1\tx\t60\tNM:i:3", "a\t1\t0\t1\t+\tb\t1\t0\t1\t1\t5\t60"]),
    "sam": (["r\t0\tc\t5\t60\t5M\t*\t0\t0\tACGTA\t*", "r\t4\t*\t0\t0\t*\t*\t0\t0\tA\t*"], ["r\t0", "r\t0\tc\tx\t60\t5M\t*\t0\t0\tA\t*", "r\t0\tc\t5\t60\t5Q\t*\t0\t0\tA\t*"]),
    "fai": (["c\t5"], ["c", "c\tx"]), "mash": (["c:1:2:A:C x y"], ["c:1:2:A:C x", "c:1 x y"]), "regions": (["c:1-2"], ["c:1"]), "sites": (["1\tc\t5"], ["1\tc", "1\tc\tx"]),
}


@pytest.mark.parametrize("kind", validation.FORMATS)
def test_every_rule(spark, tmp_path, kind):
    """Each bad line has a reason of its own, good ones none; the counts come with the action."""
    good, bad = BAD[kind]
    (tmp_path / "x").write_text("\n".join(["", *good, *bad, "  "]) + "\n")
    rows, watch = validation.counted(validation.checked(spark, str(tmp_path / "x"), kind), kind)
    got = {r["value"]: r["reason"] for r in rows.collect()}
    assert all(got[x] is None for x in good)
    reasons = [got[x] for x in bad]
    assert None not in reasons and reasons == [name for name, _ in validation._rules(kind)[2]]
    assert watch.get["lines"] == len(good) + len(bad) and watch.get["bad"] == len(bad) and all(watch.get[r] == 1 for r in reasons)
    with pytest.raises(ValueError, match="unknown format"):
        validation.checked(spark, "x", "nothing")


def test_pedigrees_that_loop_or_marry_in(spark):
    ped = lambda rows: spark.createDataFrame(rows, "id string, father string, mother string")
    inbred = [("a0", None, None), ("b0", None, None)] + [(f"{x}{k}", f"a{k - 1}", f"b{k - 1}") for k in range(1, 12) for x in "ab"]
    assert {r["id"]: r["depth"] for r in pedigree.depths(ped(inbred)).collect()} == {f"{x}{k}": k for k in range(12) for x in "ab"}
    assert pedigree.reachable(ped(inbred), ["a1"]).count() == 21
    with pytest.raises(ValueError, match="descends from themselves: x, y"):
        pedigree.depths(ped([("r", None, None), ("x", "y", "r"), ("y", "x", None)]))
    assert pedigree.depths(ped([])).count() == 0
    with pytest.raises(Exception, match="too many children"):
        normalise.label_combinations(ped([(f"k{i}", "f", "m") for i in range(11)])).count()


def test_alleles_seen_in_grandchildren(spark):
    """The view has candidates that their own children confirm, and others."""
    data = "/root/testdata/sf0.01"
    n = registry.QUERIES["transmission_counts"](spark, data)
    sums = n.selectExpr("sum(n_iht_denovo) as a", "sum(n_denovo) as b").first()
    assert sums["a"] > 0 and sums["b"] > 0
    gt, gen = fixtures.views(spark, data, "fx_gt", "fx_gen")
    assert gen.count() > gt.count()


def test_annotations_are_added_behind(spark):
    rows = [("c", 5, "A", ["C", "G"], {"OVL": "x", "K": "1"}), ("c", 6, "A", ["C"], {}), ("c", 7, "A", ["C"], {"OVL": "y"}), ("c", 8, "A", [], {"K": "2"})]
    df = spark.createDataFrame(rows, "chrom string, pos0 long, ref string, alts array<string>, info map<string,string>")
    notes = spark.createDataFrame([("c:5:A:C", "one", 1), ("c:5:A:C", "two", 2), ("c:6:A:C", "three", 1)], "key string, anno string, n int")
    got = {r["pos0"]: r["info"] for r in truthset.annotate_records(df, notes).collect()}
    assert got == {5: {"OVL": "x,two", "K": "1"}, 6: {"OVL": "three"}, 7: {"OVL": "y"}, 8: {"K": "2"}}


def test_repeats_subset_keeps_lines(spark, tmp_path):
    head = ["##a", "##b", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts"]
    lines = [f"chr1\t{k}\t.\tTA\tT\t.\t.\tTRID=t{k};END={k + 5};MOTIFS=A;STRUC=x\tGT\t0/1" for k in range(20)]
    (tmp_path / "in.vcf").write_text("\n".join(head + lines) + "\n")
    wr.subset_repeats(spark, str(tmp_path / "in.vcf"), spark.createDataFrame([("t3",), ("t17",), ("t99",), ("t3",)], "trid string"), str(tmp_path / "out"))
    got = [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(got) == sorted(head + [lines[3], lines[17]])
