"""Row-level rules on literals."""

import pytest
from pyspark.sql import functions as F

from kinweave.functions import genotype as g
from kinweave.functions import text as tx
from kinweave.operators import denovo, truthset


@pytest.mark.parametrize(
    ("before", "after"),
    [("1/1", "1/1"), ("1/0", "0/1"), ("1|0", "0/1"), ("2|2", "2/2"), ("1/.", "./1"), ("1|.", "./1"), ("./.", "./."), ("2/0", "0/2"), ("3/1/2/0", "0/1/2/3"), ("1/./2", "./1/2"), ("1|.|2", "./1/2")],
)
def test_unphase(spark, before, after):
    assert spark.createDataFrame([(before,)], "x string").select(g.unphase_text(F.col("x"))).first()[0] == after


@pytest.mark.parametrize(
    ("mom", "dad", "child", "kind"),
    [
        ((0, 0), (1, 1), (0, 1), "Valid"), ((0, 1), (0, 1), (0, 1), "Valid"), ((1, 1), (0, 1), (1, 0), "Valid"), ((0, 1), (0, 0), (1, 0), "Valid"),
        ((1, 1), (1, 1), (1, 0), "Violation"), ((0, 0), (0, 0), (1, 0), "CanDenovo"), ((1, 2), (3, 4), (3, 2), "Valid"),
    ],
)
def test_trio(spark, mom, dad, child, kind):
    ped = spark.createDataFrame([("k", "d", "m"), ("d", None, None), ("m", None, None)], "id string, father string, mother string")
    gts = spark.createDataFrame([(1, i, *a, 30, 50) for i, a in (("m", mom), ("d", dad), ("k", child))], "site_id long, id string, g0 int, g1 int, dp int, gq int")
    assert [r["kind"] for r in denovo.classify(gts, ped).collect()] == [kind]


def test_denovo_seen_in_grandchildren(spark):
    ped = spark.createDataFrame([("d", None, None), ("m", None, None), ("k", "d", "m"), ("w", None, None), ("g1", "k", "w"), ("g2", "k", "w")], "id string, father string, mother string")
    rows = [("d", 0, 0), ("m", 0, 0), ("k", 0, 1), ("w", 0, 0), ("g1", 0, 1), ("g2", 0, 0)]
    gts = spark.createDataFrame([(1, i, a, b, 30, 50) for i, a, b in rows], "site_id long, id string, g0 int, g1 int, dp int, gq int")
    raised = denovo.inherited(denovo.classify(gts, ped), gts, ped)
    assert {r["child"]: r["kind"] for r in raised.collect()} == {"k": "IhtDenovo", "g1": "Valid", "g2": "Valid"}
    assert denovo.candidates(raised).first()["child"] == "k"


def test_grandchildren_are_read_in_the_sites_row(spark):
    """As ``inherited`` has it, for all kinds of gaps among the grandchildren, and without another join of the calls."""
    ped = spark.createDataFrame([("d", None, None), ("m", None, None), ("k", "d", "m"), ("j", "d", "m"), ("w", None, None), ("g1", "k", "w"), ("g2", "k", "w")], "id string, father string, mother string")
    rows = []
    for site, (a, b) in enumerate([((0, 1), (0, 0)), ((0, 0), (1, 1)), ((0, 0), (0, 0)), ((None, 1), (0, None)), ((1, 1), (None, None)), ((2, 1), (0, 2))]):
        rows += [(site, i, *gt, 30, 50) for i, gt in (("d", (0, 0)), ("m", (0, 0)), ("k", (0, 1)), ("j", (0, 1)), ("w", (0, 0)), ("g1", a), ("g2", b)) if site != 5 or i != "w"]
    gts = spark.createDataFrame([r for r in rows if r[:2] != (2, "g2")], "site_id long, id string, g0 int, g1 int, dp int, gq int")
    key = lambda df: sorted((r["site_id"], r["child"], r["kind"]) for r in df.collect())
    now = denovo.classify(gts, ped, grandchildren=True)
    want = key(denovo.inherited(denovo.classify(gts, ped), gts, ped))
    assert key(now) == want and {k for _, _, k in want} >= {"IhtDenovo", "CanDenovo"}
    for query in (denovo.transmission_counts(now), denovo.candidates(now)):
        assert query._jdf.queryExecution().optimizedPlan().toString().count("collect_list") == 1
        assert query._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 5  # the calls once, the pedigree for trios and children


def test_scalar_rules(spark):
    df = spark.createDataFrame([("ACGTN-", "chr10:5-9", "x:1", float("nan"), "A", ["AT"])], "s string, r string, bad string, q double, ref string, alts array<string>")
    r = df.select(
        tx.reverse_complement(F.col("s")).alias("rc"), tx.parse_region(F.col("r")).alias("region"), tx.parse_region(F.col("bad")).alias("none"), g.quality_passes(F.col("q")).alias("nan"),
        g.quality_passes(F.lit(None).cast("double")).alias("null"), g.is_indel(F.col("ref"), F.col("alts")).alias("indel"), g.is_indel(F.col("ref"), F.array().cast("array<string>")).alias("none_alt"),
        g.reference_ratio(F.array(F.lit(3), F.lit(1))).alias("ratio"), g.missing_or_shallow(F.array(F.array(F.lit(0), F.lit(1))), F.lit(None).cast("array<int>")).alias("bad_depth"),
        tx.prefix_name(F.lit(">a"), "h1_").alias("fa"), tx.unphase_separators(F.lit("0|1")).alias("sep"), tx.unphase_separators(F.lit("##a|b")).alias("head"),
        tx.edit_or_length(F.lit("AAA"), F.lit("ATA")).alias("edit"), tx.edit_or_length(F.lit("AAA"), F.lit("TTTTT")).alias("len"),
    ).first()
    assert r["rc"] == "NNACGT" and tuple(r["region"]) == ("chr10", 5, 9) and r["none"] is None
    assert r["nan"] and r["null"] and r["indel"] and not r["none_alt"] and r["ratio"] == 0.75 and r["bad_depth"]
    assert (r["fa"], r["sep"], r["head"], r["edit"], r["len"]) == (">h1_a", "0/1", "##a|b", 1, 2)


def test_genotype_class(spark):
    rows = [([0, 0], 9, 30), ([0, 1], 9, 30), ([1, 1], 9, 30), ([0, 1], 4, 30), ([0, None], 9, 30), ([0], 9, 30)]
    df = spark.createDataFrame(rows, "gt array<int>, dp int, gq int")
    assert [r[0] for r in df.select(g.genotype_class(F.col("gt"), F.col("dp"), F.col("gq"))).collect()] == ["HomRef", "Het", "HomAlt", "NoCall", "NoCall", "NoCall"]


def test_natural_order(spark):
    order = lambda xs: [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x string").orderBy(tx.natural_key(F.col("x"))).collect()]
    assert order(["1", "10", "2", "11"]) == ["1", "2", "10", "11"]
    assert order(["a10", "a2", "a1"]) == ["a1", "a2", "a10"]


def test_collapsed_sites(spark):
    df = spark.createDataFrame([("chr10:1:3:CT:C,G", "1|0:0|0", "dv"), ("chr10:1:3:CT:C,G", "0|0:0|0", "dragen")], "site string, genotype string, caller string")
    r = truthset.conflicts(truthset.collapse_sites(df)).withColumn("p", truthset.parse_site(F.col("site"))).first()
    assert r["conflict"] and r["n_sources"] == 2 and r["genotype"] == "0|0:0|0" and r["p"]["alts"] == ["C", "G"]
