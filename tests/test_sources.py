"""Readers and writers on small files."""

from pyspark.sql import functions as F

from kinweave.operators import hapmap
from kinweave.sources import readers as rd
from kinweave.sources import writers as wr
from kinweave.streaming.incremental import place_sites


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_bed(spark, tmp_path):
    p = put(tmp_path, "a.bed", "# x\nchr1 1000 2000\n\nchr2\t1500\t2500\tn\nchr3 a b\n")
    assert [tuple(r) for r in rd.read_bed(spark, p).orderBy("chrom").collect()] == [("chr1", 1000, 2000, []), ("chr2", 1500, 2500, ["n"])]
    assert rd.rejected(spark, p).count() == 1


def test_ped(spark, tmp_path):
    p = put(tmp_path, "a.ped", "F a b c 1 0\nF b NA 0 1 x\nF short\n")
    assert [tuple(r) for r in rd.read_ped(spark, p).orderBy("id").collect()] == [("F", "a", "b", "c", 1, 0), ("F", "b", None, None, 1, None)]
    h = put(tmp_path, "h.ped", "#c\tchild\tdad\tmom\tsex\tp\nF\ta\tb\tc\tfemale\t0\n")
    assert tuple(rd.read_ped_with_header(spark, h).first()) == ("F", "a", "b", "c", 2)


VCF = "##fileformat=VCFv4.2\n##contig=<ID=chr1,length=99>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tx\ty\nchr1\t5\t.\tA\tC,G\t30.5\tPASS\tEND=7;FLAG\tGT:DP:AD:GQ\t0|2:11:4,1,6:50\t./.\nchr1\t9\tid\tAT\tA\t.\tq1;q2\t.\tGT\t0/1\t1/1\n"


def test_vcf(spark, tmp_path):
    p = put(tmp_path, "a.vcf", VCF)
    a, b = rd.read_vcf(spark, p).orderBy("pos0").collect()
    assert (a["pos0"], a["alts"], a["qual"], a["filters"], a["info"]) == (4, ["C", "G"], 30.5, ["PASS"], {"END": "7", "FLAG": "true"})
    x, y = a["calls"]
    assert (x["gt"], x["phased"], x["dp"], x["gq"], x["ad"], y["gt"], y["dp"]) == ([0, 2], True, 11, 50, [4, 1, 6], [None, None], None)
    assert b["qual"] is None and b["filters"] == ["q1", "q2"] and b["id"] == "id"
    assert [c["sample"] for c in rd.read_vcf(spark, p, ["y"]).first()["calls"]] == ["y"]
    assert tuple(rd.vcf_contigs(spark, p).first()) == ("chr1", 99)
    assert rd.genotypes(rd.read_vcf(spark, p)).count() == 4
    wr.write_lines(wr.vcf_lines(rd.read_vcf(spark, p), ["x", "y"]), str(tmp_path / "out"), wr.vcf_header(["x", "y"]), as_one=True)
    again = rd.read_vcf(spark, str(tmp_path / "out")).orderBy("pos0").collect()
    assert [r["calls"][0]["gt"] for r in again] == [[0, 2], [0, 1]] and again[0]["info"] == a["info"]


def test_inheritance(spark, tmp_path):
    p = put(tmp_path, "i.csv", "﻿CHROM,start,end,k1,d\nchr1,5,9,AC,AB\nchr1,10,19,A,AB\n")
    assert sorted((r["id"], r["h0"], r["h1"], r["start_pos"]) for r in rd.read_inheritance_csv(spark, p).collect()) == [("d", "A", "B", 5), ("k1", "A", "C", 5)]


def test_iht_round_trip(spark, tmp_path):
    rows = [("c", 1, 9, 3, "d", "A", "B"), ("c", 1, 9, 3, "k", "A", None), ("c", 1, 9, 3, "x", ".", "C")]
    labels = spark.createDataFrame(rows, "chrom string, start_pos long, end_pos long, n_markers long, id string, h0 string, h1 string")
    wr.write_lines(wr.iht_lines(labels, ["d", "k", "x"], ["d"]), str(tmp_path / "m"), ["#chrom\tstart\tend\td\tk\tx\tmarker_count\tlen"], as_one=True)
    got = rd.read_iht(spark, str(tmp_path / "m")).orderBy("id").collect()
    assert [(r["id"], r["founder"], r["h0"], r["h1"], r["n_markers"]) for r in got] == [("d", True, "A", "B", 3), ("k", False, "A", None, 3), ("x", False, ".", "C", 3)]


def test_alignments_sequences_and_sites(spark, tmp_path):
    paf = put(tmp_path, "a.paf", "s;r;h1:1.0\t" + "\t".join("0" * 9) + "\t1600\t60\tNM:i:7\n")
    assert tuple(rd.read_paf(spark, paf).first()) == ("s;r;h1:1.0", 1600, 7, "s", "r", "h1:1.0")
    fa = put(tmp_path, "a.fa", ">c1 note\nACG\nTA\n>c2\nGG\n")
    fasta = rd.read_fasta(spark, fa)
    assert {r["name"]: r["sequence"] for r in fasta.collect()} == {"c1": "acgta", "c2": "gg"}
    assert rd.fasta_region(rd.fasta_chunks(fasta, 2), spark.createDataFrame([("c1", 1, 4)], "chrom string, s long, e long"), 2).first()["sequence"] == "cgt"
    assert tuple(rd.read_fai(spark, put(tmp_path, "a.fai", "c1\t5\t9\n")).first()) == ("c1", 5)
    mash = rd.read_mash(spark, put(tmp_path, "m", "chr1:1:3:CT:C  1|0:0|0:,0|0:0|0:  a,b\n")).first()
    assert mash["callers"] == ["a", "b"] and len(mash["genotypes"]) == 2
    tr = put(tmp_path, "t.vcf", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tx\nchr1\t5\t.\tACA\tACACA\t.\t.\tTRID=t1;END=9;MOTIFS=CA,C;STRUC=x\tGT:AP:AM\t0/1:0.9,0.8:.,0.5\n")
    a, b = rd.read_repeats_vcf(spark, tr).orderBy("slot").collect()
    assert (a["trid"], a["e"], a["motifs"], a["seq"], a["purity"], a["methylation"]) == ("t1", 9, ["CA", "C"], "CA", 0.9, None) and b["seq"] == "CACA"
    assert rd.read_json_document(spark, put(tmp_path, "j.json", '[{"a": 1}, {"a": 2}]')).count() == 2


def test_reports(spark, tmp_path):
    steps = spark.createDataFrame([("c", "k", 0, 9, 10, "A", "B")], "chrom string, id string, slot int, prev_end long, next_start long, old string, new string")
    wr.write_lines(wr.switch_lines(steps), str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).first()[0] == "c\t9\t10\tk\tA\tB"
    decided = spark.createDataFrame([("c", 1, 2, "pass"), ("c", 3, 4, "fail")], "chrom string, s long, e long, status string")
    wr.split_by_status(decided, str(tmp_path / "split"), wr.bed_lines)
    assert spark.read.text(str(tmp_path / "split/fail")).first()[0] == "c\t3\t4"
    assert wr.json_lines(decided).first()[0].startswith('{"chrom":"c"')
    assert wr.fasta_lines(decided, "chrom", "status").first()[0] == ">c\npass"
    labels = hapmap.to_long(spark.createDataFrame([("c", 5, "k", "A", None), ("c", 5, "j", "A", "C")], "chrom string, pos0 long, id string, h0 string, h1 string"), ["chrom", "pos0", "id"])
    assert wr.marker_lines(labels, ["j", "k"]).first()[0] == "c\t5\tA|C\tA|?\tA:j,k;C:j"


def test_stream(spark, tmp_path):
    sites = spark.createDataFrame([("c", 5), ("c", 50)], "chrom string, pos0 long")
    sites.write.parquet(str(tmp_path / "in"))
    blocks = spark.createDataFrame([("c", 1, 0, 10)], "chrom string, b long, start_pos long, end_pos long")
    stream = place_sites(spark.readStream.schema(sites.schema).parquet(str(tmp_path / "in")), blocks)
    q = stream.writeStream.format("memory").queryName("placed").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("placed").select("pos0", F.col("b")).collect()] == [(5, 1)]


def test_vcf_with_repeated_info_keys(spark, tmp_path):
    """The first of a repeated key counts; the job goes on."""
    (tmp_path / "x.vcf").write_text("##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\nc\t7\t.\tA\tG\t5\tPASS\tDP=1;DB;DP=2;DB\n")
    assert rd.read_vcf(spark, str(tmp_path / "x.vcf")).first()["info"] == {"DP": "1", "DB": "true"}


def test_left_align_writes_no_chromosome_as_one_row(spark, monkeypatch):
    from pyspark.sql import functions as F

    from kinweave.plans import files_queries, registry

    written, write = [], files_queries.wr.write_lines
    monkeypatch.setattr(files_queries.wr, "write_lines", lambda lines, *x, **y: (written.append(lines), write(lines, *x, **y))[1])
    assert registry.QUERIES["left_align"](spark, "/root/testdata/sf0.01").count() == 18000
    assert written[0].toDF("value").agg(F.max(F.length("value"))).first()[0] < 4000


def test_calls_and_info_are_parsed_once(spark, tmp_path):
    """Filters on what was read do not repeat the parsing below; odd INFO entries are read as they stand."""
    line = "chr1\t5\t.\tA\tC,.\t.\t.\tA=1;A=2;F;E=;=v;B=x=y\tGT:DP:AD\t0|1:7:1,.\t.:.:."
    (tmp_path / "x.vcf").write_text(f"#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tp\tq\n{line}\nchr1\tx\t.\tA\tC\t.\t.\t.\n")
    records = rd.read_vcf(spark, str(tmp_path / "x.vcf"))
    got = records.collect()
    assert len(got) == 1 and got[0]["info"] == {"A": "1", "F": "true", "E": "", "": "v", "B": "x=y"} and got[0]["alts"] == ["C"]
    assert [(c["gt"], c["phased"], c["dp"], c["gq"], c["ad"], c["sd"]) for c in got[0]["calls"]] == [([0, 1], True, 7, None, [1, None], None), ([None], False, None, None, None, None)]
    for rows in (rd.genotypes(records), rd.read_sv_vcf(spark, str(tmp_path / "x.vcf"), 0).where(F.col("svtype").isin("INS", "DEL"))):
        plan = rows._jdf.queryExecution().optimizedPlan().toString().splitlines()
        filters = [p for p in plan if p.lstrip(" +-:").startswith("Filter")]
        assert filters and all(p.count("split(") <= 2 for p in filters)
