"""Sequences read line by line, normalised variants, stored regions."""

import random

from pyspark.sql import functions as F

from kinweave.operators import normalise as nm
from kinweave.sources import readers as rd
from kinweave.sources import writers as wr


def test_fasta_of_many_splits(spark, tmp_path):
    """Two records over several splits and files, with blank lines, in chunks of many sizes."""
    rng = random.Random(1)
    want = {n: "".join(rng.choice("ACGTacgtN") for _ in range(k)) for n, k in (("c1", 9000), ("c2", 1), ("c3", 0), ("c4", 777))}
    lines = lambda s, w: "\n".join(s[i : i + w] for i in range(0, len(s), w))
    (tmp_path / "a.fa").write_text(f">c1 one\n{lines(want['c1'], 61)}\n\n>c2\n{want['c2']}\n>c3 none\n")
    (tmp_path / "b.fa").write_text(f">c4\r\n{lines(want['c4'], 70)}\r\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600b")
    try:
        for size in (16, 100, 1 << 16):
            rows = rd.read_fasta_chunks(spark, str(tmp_path), size)
            assert size > 16 or rows.rdd.getNumPartitions() >= 1
            got = {}
            for r in sorted(rows.collect(), key=lambda r: (r["chrom"], r["chunk"])):
                assert len(r["sequence"]) <= size and r["chunk"] * size == len(got.get(r["chrom"], ""))
                got[r["chrom"]] = got.get(r["chrom"], "") + r["sequence"]
            assert got == {n: s.lower() for n, s in want.items() if s}
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def leftmost(seq, pos, ref, alt):
    """By trying all shorter and earlier ways to write the same haplotype."""
    whole = seq[:pos] + alt + seq[pos + len(ref) :]
    d = len(alt) - len(ref)
    if d == 0:
        diff = [i for i in range(len(ref)) if ref[i] != alt[i]]
        return (pos + diff[0], ref[diff[0] : diff[-1] + 1], alt[diff[0] : diff[-1] + 1]) if diff else None
    for p in range(len(seq)):
        for n in range(1, 6):
            r, a = seq[p : p + n + max(0, -d)], whole[p : p + n + max(0, d)]
            if min(len(r), len(a)) == n and seq[:p] + a + seq[p + len(r) :] == whole and (n == 1 or r[0] != a[0]):
                return p, r, a
    return None


def test_normalised_variants_are_leftmost(spark):
    rng = random.Random(7)
    sequence = "".join(rng.choice("ACGT") * rng.choice([1, 1, 2, 9]) + rng.choice(["", "", "CAG" * 12]) for _ in range(40))
    rows = []
    for k in range(250):
        pos = rng.randrange(1, len(sequence) - 8)
        ref = sequence[pos : pos + rng.randrange(1, 5)]
        alts = []
        for _ in range(rng.choice([1, 1, 2])):
            kind = rng.random()
            tail = sequence[pos + len(ref) : pos + len(ref) + 3]
            alts.append(ref + tail if kind < 0.35 else ref[0] if kind < 0.7 and len(ref) > 1 else ref[:-1] + rng.choice([x for x in "ACGT" if x != ref[-1]]))
        rows.append((k, "c", pos, ref, alts))
    odd = [(900, "c", 3, "N" + sequence[4], ["A"]), (901, "nowhere", 5, "A", ["AC"]), (902, "c", 10, sequence[10], ["<DEL>"]), (903, "c", 0, sequence[0], [sequence[0] * 2]), (904, "c", 20, sequence[20].lower(), [sequence[20:22].lower()])]
    df = spark.createDataFrame(rows + odd, "k long, chrom string, pos0 long, ref string, alts array<string>")
    chunks = rd.fasta_chunks(spark.createDataFrame([("c", sequence.lower())], "name string, sequence string"), 16)
    got = {(r["k"], r["alt_no"]): r for r in nm.normalise(df, chunks, 16, reach=2).collect()}
    assert len(got) == sum(len(r[4]) for r in rows + odd)
    moved = 0
    for k, _, pos, ref, alts in rows:
        for i, alt in enumerate(alts):
            r = got[k, i + 1]
            assert r["matches"] and (r["pos0"], r["ref"], r["alt"]) == leftmost(sequence, pos, ref, alt), (pos, ref, alt)
            moved += r["pos0"] < pos - 16
    assert moved > 5  # over more than a chunk
    assert not got[900, 1]["matches"] and not got[901, 1]["matches"] and got[902, 1]["alt"] == "<DEL>" and got[904, 1]["matches"]
    assert got[903, 1]["pos0"] == 0
    assert nm.normalise(df.limit(0), chunks, 16).collect() == []


def test_regions_read_what_they_need(spark, tmp_path):
    """Folders and row groups are chosen by chromosome, range, position and quality; long records reach into a region."""
    rows = [(f"chr{c}", p, "A" * (1 + p % 4), float(p % 50)) for c in (1, 2) for p in range(0, 40_000, 10)] + [("chr1", 19_990, "A" * 500, None)]
    df = spark.createDataFrame(rows, "chrom string, pos0 long, ref string, qual double")
    at = str(tmp_path / "stored")
    rd.store_records(df, at, 4000)
    want = lambda first, last, reach: sorted((c, p) for c, p, r, q in rows if c == "chr1" and first - reach < p <= last and p + (len(r) if reach else 1) > first and (q is None or q >= 20))
    for reach in (0, 600):
        found = rd.read_region(spark, at, [("chr1", 20_005, 21_000)], 20.0, 4000, reach)
        assert sorted((r["chrom"], r["pos0"]) for r in found.collect()) == want(20_005, 21_000, reach)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [" in plan and "range#" in plan.split("PartitionFilters")[1] and "GreaterThanOrEqual(pos0," in plan and "qual" in plan.split("PushedFilters")[1]
    files = {r[0] for r in rd.read_region(spark, at, [("chr1", 20_005, 21_000)], None, 4000).select(F.input_file_name()).collect()}
    assert len(files) == 1 and rd.read_region(spark, at, [], None, 4000).count() == 0


def test_ordered_files_and_their_index(spark, tmp_path):
    """Parts in order one after the other, the header once and first, and regions that read few parts."""
    rng = random.Random(4)
    rows = [(f"chr{rng.randrange(1, 4)}\t{rng.randrange(5000)}\tx{k}",) for k in range(3000)]
    at = str(tmp_path / "out")
    wr.write_ordered(spark.createDataFrame(rows, "line string").repartition(5), at, ["##one", "#CHROM\tPOS"], parts=8)
    parts = sorted(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-"))
    lines = [x for p in parts for x in p.read_text().splitlines()]
    key = lambda x: (x.split("\t")[0], int(x.split("\t")[1]), x)
    assert lines == ["##one", "#CHROM\tPOS", *sorted((r[0] for r in rows), key=key)]
    assert len(parts) == 9 and spark.read.text(at).count() == 3002
    found = wr.read_ordered(spark, at, "chr2", 1000, 1200)
    assert sorted((r["value"] for r in found.collect()), key=key) == [x for x in lines[2:] if x.startswith("chr2\t") and 1000 <= key(x)[1] <= 1200]
    assert len(found.inputFiles()) <= 2
    assert wr.read_ordered(spark, at, "chr9", 0, 9).count() == 0
    index = spark.read.parquet(f"{at}/_index").collect()
    assert sum(r["lines"] for r in index) == 3000
