"""Contigs cut to regions, and the four configurations, against a walk base by base."""

import itertools
import random

from pyspark.sql import functions as F

from kinweave.operators import assembly

LETTERS = {"A": 0, "B": 1}


def walk(ops, pos, start, end):
    """Query places of a region's first base and of its end: op by op, a target base at a time."""
    t, q, first, last = pos, 0, None, None
    for op, n in ops:
        if op in "IS":
            q += n
        elif op in "N":
            t += n
        elif op in "M=XD":
            if first is None and t + n > start:
                first = q + (max(0, start - t) if op != "D" else 0)
            if last is None and t + n >= end:
                last = q + (min(n, end - t) if op != "D" else 0)
            t, q = t + n, q + (n if op != "D" else 0)
    return -1 if first is None else first, q if last is None else last


def test_ranges_are_the_walk(spark):
    rng = random.Random(11)
    rows = []
    for k in range(400):
        ops = [(rng.choice("MIDNS=XH"), rng.randrange(1, 9)) for _ in range(rng.randrange(1, 7))]
        start = rng.randrange(0, 40)
        rows.append((k, "".join(f"{n}{o}" for o, n in ops), rng.randrange(0, 20), start, start + rng.randrange(1, 12), *[None] * 0))
    df = spark.createDataFrame(rows, "k long, cigar string, pos long, s long, e long")
    got = {r["k"]: (r["q"]["q_start"], r["q"]["q_end"]) for r in df.withColumn("q", assembly.target_range(assembly.parse_cigar(F.col("cigar")), F.col("pos"), F.col("s"), F.col("e"))).collect()}
    for k, cigar, pos, s, e in rows:
        ops = [(o, int(n)) for n, o in __import__("re").findall(r"(\d+)([A-Z=])", cigar)]
        assert got[k] == walk(ops, pos, s, e), (cigar, pos, s, e)


def test_haplotypes_and_problems(spark):
    """Multiple and missing contigs, a male's X, strands, contigs that end inside a region."""
    contig = lambda sample, hap, chrom, pos, cigar, seq, reverse=False: (sample, hap, chrom, pos, cigar, seq, reverse)
    rows = [
        contig("a", 1, "c", 0, "2S10M", "NNACGTACGTAC"), contig("a", 2, "c", 2, "4M3I6M", "GTACNNNGTACGT"),
        contig("b", 1, "c", 0, "10M", "ACGTACGTAC"), contig("b", 1, "c", 1, "9M", "CGTACGTAC"), contig("b", 2, "c", 0, "10M", "ACGTACGTAC", True),
        contig("m", 2, "chrX", 0, "10M", "ACGTACGTAC"), contig("w", 2, "chrX", 0, "10M", "ACGTACGTAC"), contig("s", 1, "c", 0, "4M", "ACGT"), contig("s", 2, "c", 0, "10M", "ACGTACGTAC"),
    ]
    df = spark.createDataFrame(rows, "sample string, hap int, chrom string, pos0 long, cigar string, seq string, reverse boolean")
    regions = spark.createDataFrame([("r", "c", 3, 7), ("x", "chrX", 3, 7)], "region string, chrom string, s long, e long")
    got = {(r["region"], r["sample"]): (r["haps"], r["problem"]) for r in assembly.haplotypes(assembly.region_sequences(df, regions), regions, [("a", False), ("b", False), ("m", True), ("w", False), ("s", False), ("n", False)]).collect()}
    assert got["r", "a"] == (["TACGT", "TACNNNGT"], None)
    assert got["r", "b"] == (None, "multi") and got["r", "s"] == (None, "missing") and got["r", "n"] == (None, "missing") and got["r", "m"] == (None, "missing")
    assert got["x", "m"] == (["TACGT", "TACGT"], None) and got["x", "w"] == (None, "missing")
    turned = {(r["sample"], r["hap"]): r["seq"] for r in assembly.region_sequences(df, regions.where("region = 'r'"), turn=True).where("sample = 'b' and hap = 2").collect()}
    assert turned["b", 2] == "ACGTA"


def test_configurations(spark):
    """All ways of sorted parental sequences and labels of two children, against trying the four configurations."""
    rows, labels, want = [], [], {}
    parents = [(["AA", "CC"], ["GG", "TT"]), (["AA", "AA"], ["GG", "TT"])]
    kids = [["AA", "GG"], ["AA", "TT"], ["CC", "GG"], ["CC", "TT"], ["AA", "AA"]]
    names = [("A", "C"), ("A", "D"), ("B", "C"), ("B", "D")]
    for n, ((f, m), one, two, x, y) in enumerate(itertools.product(parents, kids, kids, names, names)):
        region = f"r{n}"
        own = {"f": (f, ("A", "B")), "m": (m, ("C", "D")), "k": (sorted(one), x), "l": (sorted(two), y)}
        rows += [(region, s, h, None) for s, (h, _) in own.items()]
        labels += [(region, s, *lab) for s, (_, lab) in own.items()]
        config = None
        for k, (i, j) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1)]):
            of = {"A": f[i], "B": f[1 - i], "C": m[j], "D": m[1 - j]}
            if config is None and all(sorted((of[a], of[b])) == h for h, (a, b) in own.values()):
                config = k
        want[region] = config
    df = spark.createDataFrame(rows, "region string, sample string, haps array<string>, problem string")
    got = {r["region"]: (r["config"], r["concordant"]) for r in assembly.concordance(df, spark.createDataFrame(labels, "region string, sample string, h0 string, h1 string"), "f", "m").collect()}
    assert got == {k: (v, v is not None) for k, v in want.items()}
    assert set(want.values()) == {None, 0, 1, 2, 3}
