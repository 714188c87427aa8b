"""Queries that go through files, and those of the normalising operators.

Files are written below the checkpoint folder, which all executors share.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import normalise as nm
from ..operators.scans import running
from ..operators.storage import cut, shared_folder
from ..sources import readers as rd
from ..sources import writers as wr
from .registry import query
from .sv_queries import _MERGED


#: The sequenced family of the views: two parents and their eight children.
PEOPLE = [f"S{i:02d}" for i in range(4, 14)]


def _place(df) -> str:
    return f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"


@query("file_bed", "SC1 SK7 I1", "fx_rg", sql="select chrom, s, e, 'x' || (s % 7) as name from fx_rg")
def file_bed(rg):
    at = _place(rg)
    wr.write_lines(wr.bed_lines(rg.withColumn("name", F.concat(F.lit("x"), (F.col("s") % 7).cast("string"))), "name"), at, ["#chrom\tstart\tend\tname"])
    return rd.read_bed(rg.sparkSession, at).select("chrom", "s", "e", F.get("rest", 0).alias("name"))


@query("file_ped", "SC2", "fx_ped", sql="select 'F' as family, id, father, mother, cast(sex as integer) as sex, cast(0 as integer) as phenotype from fx_ped")
def file_ped(ped):
    at = _place(ped)
    parent = lambda c: F.coalesce(F.col(c), F.when(F.col("i") % 2 == 0, "NA").otherwise("0"))
    wr.write_lines(ped.select(F.concat_ws("\t", F.lit("F"), "id", parent("father"), parent("mother"), F.col("sex").cast("string"), F.lit("0"))), at)
    return rd.read_ped(ped.sparkSession, at)


@query("file_vcf", "SC6 SC8 SC23 SK4", "fx_site", "fx_gt", sql="""
select s.chrom, s.pos0, s.ref, s.alt, cast(s.qual as double) as qual, g.id, g.g0, g.g1, cast(g.dp as integer) as dp, cast(g.gq as integer) as gq from fx_site s join fx_gt g on g.site_id = s.site_id
""")
def file_vcf(site, gt):
    at, samples = _place(site), PEOPLE
    call = F.struct(F.col("id").alias("sample"), F.array("g0", "g1").alias("gt"), F.lit(False).alias("phased"), "dp", "gq")
    calls = gt.groupBy("site_id").agg(F.collect_list(call).alias("calls"))
    records = site.join(calls, "site_id").select(
        "chrom", "pos0", F.lit(None).cast("string").alias("id"), "ref", F.array("alt").alias("alts"), "qual", F.array(F.lit("PASS")).alias("filters"), F.create_map(F.lit("SITE"), F.col("site_id").cast("string")).alias("info"), "calls"
    )
    wr.write_lines(wr.vcf_lines(records, samples), at, wr.vcf_header(samples, [("chr1", 1000)]))
    rows = rd.genotypes(rd.read_vcf(site.sparkSession, at))
    return rows.select("chrom", "pos0", "ref", F.get("alts", 0).alias("alt"), "qual", F.col("sample").alias("id"), F.get("gt", 0).alias("g0"), F.get("gt", 1).alias("g1"), "dp", "gq")


@query("file_iht", "SC11 SK1 J15", "fx_mark", sql="select chrom, start_pos, end_pos, cast(3 as bigint) as n_markers, id, id in ('S04', 'S05') as founder, h0, h1 from fx_mark")
def file_iht(mark):
    at, people = _place(mark), PEOPLE
    rows = mark.withColumn("n_markers", F.lit(3).cast("long"))
    wr.write_lines(wr.iht_lines(rows, people, ["S04", "S05"]), at, ["\t".join(["#chrom", "start", "end", *people, "marker_count", "len"])])
    return rd.read_iht(mark.sparkSession, at)


@query("file_switches", "SK3 SK15", "fx_label", sql="""
with l as (select chrom, b, start_pos, end_pos, id, 0 as slot, h0 as h from fx_label union all select chrom, b, start_pos, end_pos, id, 1, h1 from fx_label)
select chrom || ' ' || pe || ' ' || start_pos || ' ' || id || ' ' || p || ' ' || h as line from (select *, lag(h) over w as p, lag(end_pos) over w as pe from l window w as (partition by chrom, id, slot order by b)) t where p <> h
""")
def file_switches(label):
    from ..operators import hapmap

    at = _place(label)
    rows = hapmap.to_long(label, ["chrom", "b", "start_pos", "end_pos", "id"])
    wr.write_lines(wr.switch_lines(hapmap.switches(rows)), at)
    return label.sparkSession.read.text(at).select(F.replace("value", F.lit("\t"), F.lit(" ")).alias("line"))


@query("file_markers", "SK2", "fx_label", sql="""
with l as (select chrom, start_pos, id, h0 as h from fx_label union all select chrom, start_pos, id, h1 from fx_label),
g as (select chrom, start_pos, h, string_agg(distinct id, ',' order by id) as ids from l where h is not null group by chrom, start_pos, h),
i as (select chrom, start_pos, string_agg(h || ':' || ids, ';' order by h) as info from g group by chrom, start_pos),
p as (select chrom, start_pos, string_agg(coalesce(h0, '?') || '|' || coalesce(h1, '?'), ' ' order by id) as pairs from fx_label group by chrom, start_pos)
select p.chrom || ' ' || p.start_pos || ' ' || pairs || ' ' || info as line from p join i on i.chrom = p.chrom and i.start_pos = p.start_pos
""")
def file_markers(label):
    from ..operators import hapmap

    at = _place(label)
    rows = hapmap.to_long(label, ["chrom", "start_pos", "id"]).withColumnRenamed("start_pos", "pos0")
    wr.write_lines(wr.marker_lines(rows, PEOPLE), at)
    return label.sparkSession.read.text(at).select(F.replace("value", F.lit("\t"), F.lit(" ")).alias("line"))


_WIDE = "case when b % 5 = 0 and i = 6 then h0 when b % 2 = 0 and i = 7 then h0 || h0 else h0 || h1 end"


def _wide_csv(label) -> str:
    """An inheritance CSV; some blocks have a label of one letter, some of two equal ones."""
    at = _place(label)
    text = F.when((F.col("b") % 5 == 0) & (F.col("i") == 6), F.col("h0")).when((F.col("b") % 2 == 0) & (F.col("i") == 7), F.concat("h0", "h0")).otherwise(F.concat("h0", "h1"))
    wr.csv_folder(label.groupBy("chrom", "start_pos", "end_pos").pivot("id", PEOPLE).agg(F.max(text)), at)
    return at


@query("file_inheritance_csv", "SC10 SK13", "fx_label", sql=f"""
with w as (select chrom, start_pos, end_pos, id, cast(i - 4 as integer) as ord, {_WIDE} as x from fx_label),
k as (select chrom, start_pos from w group by chrom, start_pos having min(length(x)) = 2)
select w.chrom, w.start_pos, end_pos, id, ord, x[1] as h0, x[2] as h1 from w join k on k.chrom = w.chrom and k.start_pos = w.start_pos
""")
def file_inheritance_csv(label):
    return rd.read_inheritance_csv(label.sparkSession, _wide_csv(label)).drop("b")


@query("file_ivec_csv", "SC12", "fx_label", sql=f"""
with w as (select chrom, start_pos, end_pos, id, cast(i - 4 as integer) as ord, {_WIDE} as x from fx_label),
k as (select chrom, start_pos from w group by chrom, start_pos having min(length(x)) = 2)
select w.chrom, w.start_pos, end_pos, id, ord, x[1] as h0, case when x[1] <> x[2] then x[2] end as h1 from w join k on k.chrom = w.chrom and k.start_pos = w.start_pos
""")
def file_ivec_csv(label):
    return rd.read_ivec_csv(label.sparkSession, _wide_csv(label)).drop("b")


@query("file_ped_header", "SC3", "fx_ped", sql="select 'F' as family, id, father, mother, cast(sex as integer) as sex from fx_ped")
def file_ped_header(ped):
    at = _place(ped)
    parent = lambda c: F.coalesce(F.col(c), F.lit("NA"))
    wr.write_lines(ped.select(F.concat_ws("\t", F.lit("F"), "id", parent("father"), parent("mother"), F.when(F.col("sex") == 1, "male").otherwise("Female"))), at, ["#family\tid\tfather\tmother\tsex"])
    return rd.read_ped_with_header(ped.sparkSession, at)


@query("file_paf", "SC14", "fx_sv", sql="""
select id || ';chr' || (prio + 1) || ':1-9;' || (start_pos % 2) as name, abs(svlen) * 6 as block_len, case when start_pos % 5 > 0 then start_pos % 7 end as edits, id as sample, 'chr' || (prio + 1) || ':1-9' as region, cast(start_pos % 2 as varchar) as hap from fx_sv
""")
def file_paf(calls):
    at = _place(calls)
    name = F.concat_ws(";", "id", F.concat(F.lit("chr"), (F.col("prio") + 1).cast("string"), F.lit(":1-9")), (F.col("start_pos") % 2).cast("string"))
    more = F.when(F.col("start_pos") % 5 > 0, F.concat(F.lit("tp:A:P\tNM:i:"), (F.col("start_pos") % 7).cast("string"))).otherwise("tp:A:P")
    wr.write_lines(calls.select(F.concat_ws("\t", name, *[F.lit("0")] * 9, (F.abs("svlen") * 6).cast("string"), F.lit("60"), more)), at)
    return rd.read_paf(calls.sparkSession, at)


@query("file_mash", "SC15 A7", "fx_site", "fx_gt", sql="""
select cast(site_id as varchar) as site, string_agg(coalesce(g0 || '/' || g1, './.'), ',' order by i) as genotypes, string_agg('c' || i, ',' order by i) as callers from fx_gt group by site_id
""")
def file_mash(site, gt):
    at = _place(gt)
    text = F.coalesce(F.concat(F.col("g0").cast("string"), F.lit("/"), F.col("g1").cast("string")), F.lit("./."))
    pairs = gt.groupBy("site_id").agg(F.sort_array(F.collect_list(F.struct("i", text.alias("g")))).alias("p"))
    wr.write_lines(pairs.select(F.concat_ws(" ", F.col("site_id").cast("string"), F.array_join(F.transform("p", lambda p: p["g"]), ","), F.array_join(F.transform("p", lambda p: F.concat(F.lit("c"), p["i"].cast("string"))), ","))), at)
    rows = rd.read_mash(gt.sparkSession, at)
    return rows.select("site", F.array_join("genotypes", ",").alias("genotypes"), F.array_join("callers", ",").alias("callers"))


@query("file_contigs", "SC16 I11", "fx_rg", sql="""
select r.chrom, greatest(s - 25, 0) as s, least(e + 25, m) as e from fx_rg r join (select chrom, max(e) as m from fx_rg group by chrom) c on c.chrom = r.chrom
""")
def file_contigs(rg):
    from ..operators import intervals

    at = _place(rg)
    lengths = rg.groupBy("chrom").agg(F.max("e").alias("n"))
    wr.write_lines(lengths.select(F.concat_ws("\t", "chrom", F.col("n").cast("string"), F.lit("6"), F.lit("60"), F.lit("61"))), at)
    return intervals.slop(rg, rd.read_fai(rg.sparkSession, at), 25).select("chrom", "s", "e")


@query("file_fasta", "SC17 SK8", "fx_site", sql="""
with q as (select chrom, string_agg(ref, '' order by site_id) as seq from fx_site group by chrom),
r as (select distinct chrom, site_id % 150 as s, site_id % 150 + 70 as e from fx_site)
select r.chrom, s, e, lower(substr(seq, cast(s + 1 as integer), 70)) as sequence from r join q on q.chrom = r.chrom
""")
def file_fasta(site):
    at = _place(site)
    bases = site.groupBy("chrom").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("site_id", "ref"))), lambda x: x["ref"]), "").alias("seq"))
    wr.write_lines(wr.fasta_lines(bases.select(F.concat("chrom", F.lit(" of >1 part")).alias("name"), F.regexp_replace("seq", "(.{60})", "$1\n").alias("seq")), "name", "seq"), at)
    chunks = rd.read_fasta_chunks(site.sparkSession, at, 32)
    begin = F.col("site_id") % 150
    return rd.fasta_region(chunks, site.select("chrom", begin.alias("s"), (begin + 70).alias("e")), 32)


@query("file_alignments", "SC18 J7 S11", "fx_site", "fx_block", sql="""
select site_id, b, case when t < 1000 then t when t < 1005 then 1000 when t < 6005 then t - 5 else t - 5 + 300 end as q
from (select site_id, b, pos0 - start_pos as t from fx_site s join fx_block k on k.chrom = s.chrom and s.pos0 between k.start_pos and k.end_pos) x
""")
def file_alignments(site, block):
    from ..operators import assembly, concordance

    at = _place(site)
    wr.write_lines(block.select(F.concat_ws("\t", F.concat_ws(".", "chrom", F.col("b").cast("string")), F.lit("0"), "chrom", (F.col("start_pos") + 1).cast("string"), F.lit("60"), F.lit("1000M5D5000M300I193995M"), *[F.lit("*")] * 5)), at, ["@HD\tVN:1.6"])
    reads = rd.read_sam(site.sparkSession, at).select("chrom", F.substring_index("name", ".", -1).cast("long").alias("b"), "pos0", assembly.parse_cigar(F.col("cigar")).alias("ops"))
    span = F.aggregate("ops", F.lit(0).cast("long"), lambda n, x: n + F.when(x["op"].isin("M", "D", "N", "=", "X"), x["len"]).otherwise(0))
    placed = reads.select("chrom", "b", F.col("pos0").alias("start_pos"), (F.col("pos0") + span - 1).alias("end_pos"))
    met = concordance.block_join(site, placed, first_only=False).join(reads.select("chrom", "b", "ops"), ["chrom", "b"])
    return met.select("site_id", "b", assembly.project(F.col("ops"), F.col("start_pos"), F.col("pos0")).alias("q"))


@query("file_json", "SC19", "fx_label", sql="select chrom || ':' || b as region, id, [h0, h1][1] as first, [h0, h1][2] as second from fx_label")
def file_json(label):
    at = _place(label)
    wr.write_lines(wr.json_lines(label.select(F.concat_ws(":", "chrom", F.col("b").cast("string")).alias("region"), "id", F.array("h0", "h1").alias("haps"))), at)
    rows = rd.read_json_lines(label.sparkSession, at, "region string, id string, haps array<string>")
    return rows.select("region", "id", F.get("haps", 0).alias("first"), F.get("haps", 1).alias("second"))


@query("file_sites", "SC22", "fx_site", sql="select cast(site_id as varchar) as site_id, chrom, cast(pos0 as varchar) as pos0 from fx_site")
def file_sites(site):
    at = _place(site)
    wr.csv_folder(site.select("site_id", "chrom", "pos0"), at, "\t")
    return rd.read_sites(site.sparkSession, at)


@query("file_regions", "SC21 I14", "fx_rg", sql="select chrom, s, e from fx_rg")
def file_regions(rg):
    from ..functions.text import parse_region
    from ..operators.intervals import region_text

    at = _place(rg)
    wr.write_lines(rg.select(region_text(F.col("chrom"), F.col("s"), F.col("e"))), at)
    return rg.sparkSession.read.text(at).select(parse_region(F.col("value")).alias("r")).select("r.*")


@query("file_repeats", "SC13", "fx_tr", sql="""
with l as (select trid, i, slot, seq, purity_pct from fx_tr)
select cast(trid as varchar) as trid, 'chr1' as chrom, trid * 100 as s, trid * 100 + 50 as e, 'S' || lpad(cast(i as varchar), 2, '0') as id, cast(slot as integer) as slot, seq, purity_pct / 100.0 as purity, case when slot = 0 then 0.25 end as methylation from l
""")
def file_repeats(tr):
    at = _place(tr)
    wr.write_lines(_repeat_lines(tr), at, wr.vcf_header(PEOPLE))
    return rd.read_repeats_vcf(tr.sparkSession, at).drop("motifs")


def _repeat_lines(tr):
    loci = tr.groupBy("trid").agg(F.sort_array(F.collect_set("seq")).alias("seqs"), F.collect_list(F.struct("i", "slot", "seq", "purity_pct")).alias("c"))

    def call(who: int):
        own = F.array_sort(F.filter("c", lambda c: c["i"] == who), lambda x, y: (x["slot"] - y["slot"]).cast("int"))
        gt = F.array_join(F.transform(own, lambda c: F.array_position("seqs", c["seq"]).cast("string")), "/")
        return F.concat_ws(":", gt, F.array_join(F.transform(own, lambda c: (c["purity_pct"] / 100).cast("string")), ","), F.lit("0.25,."))

    info = F.concat(F.lit("TRID="), F.col("trid").cast("string"), F.lit(";END="), (F.col("trid") * 100 + 50).cast("string"), F.lit(";MOTIFS=AC,G;STRUC=x"))
    alts = F.array_join(F.transform("seqs", lambda x: F.concat(F.lit("T"), x)), ",")
    line = F.concat_ws("\t", F.lit("chr1"), (F.col("trid") * 100).cast("string"), F.lit("."), F.lit("TA"), alts, F.lit("."), F.lit("."), info, F.lit("GT:AP:AM"), *[call(4 + k) for k in range(10)])
    return loci.select(line)


_SV_INFO = ["SVTYPE", "SVLEN", "END", "RNAMES"]


def _sv_file(calls) -> str:
    at = _place(calls)
    info = F.map_from_arrays(F.array(*map(F.lit, _SV_INFO)), F.array("svtype", F.col("svlen").cast("string"), F.col("end_pos").cast("string"), F.lit("r1,r2")))
    none = F.array(F.struct(F.lit("").alias("sample"), F.array(F.lit(None).cast("int")).alias("gt"), F.lit(False).alias("phased"), F.lit(None).cast("int").alias("dp"), F.lit(None).cast("int").alias("gq")))
    records = calls.select("chrom", F.col("start_pos").alias("pos0"), "id", F.lit("N").alias("ref"), F.array(F.lit("<SV>")).alias("alts"), F.lit(None).cast("double").alias("qual"), F.array(F.lit("PASS")).alias("filters"), info.alias("info"), none.alias("calls"))
    wr.write_lines(wr.vcf_lines(records, []), at, wr.vcf_header([]))
    return at


@query("file_sv_vcf", "SC20 F18", "fx_sv", sql="select id, cast(0 as bigint) as prio, chrom, svtype, start_pos, end_pos, svlen from fx_sv where svtype in ('INS', 'DEL')")
def file_sv_vcf(calls):
    from ..operators import sv

    return sv.keep_types(rd.read_sv_vcf(calls.sparkSession, _sv_file(calls), 0), ("INS", "DEL"))


@query("file_sv_stripped", "SK12 G18", "fx_sv", sql="select id, chrom, start_pos as pos0, 'END;SVLEN;SVTYPE' as keys from fx_sv")
def file_sv_stripped(calls):
    from ..operators import sv

    spark, at = calls.sparkSession, _place(calls)
    whole = rd.read_vcf(spark, _sv_file(calls))
    wr.write_lines(wr.vcf_lines(whole.withColumn("info", sv.strip_info(F.col("info"), ["RNAMES"], [])).withColumn("calls", F.array(F.struct(F.lit("").alias("sample"), F.array(F.lit(None).cast("int")).alias("gt"), F.lit(False).alias("phased"), F.lit(None).cast("int").alias("dp"), F.lit(None).cast("int").alias("gq")))), []), at, wr.vcf_header([]))
    return rd.read_vcf(spark, at).select("id", "chrom", "pos0", F.array_join(F.sort_array(F.map_keys("info")), ";").alias("keys"))


@query("file_sv_merged", "SK11 S6", "fx_sv", sql=f"""
with {_MERGED}, g as (select primary_id, string_agg(distinct support_id, ',' order by support_id) as ids, count(distinct round) as n from lk group by primary_id)
select p3.id, p3.chrom, f.start_pos as pos0, p3.svtype, coalesce(ids, '.') as support, cast(1 + coalesce(n, 0) as varchar) as n_sources from p3 join fx_sv f on f.id = p3.id left join g on g.primary_id = p3.id
""")
def file_sv_merged(calls):
    """All four callers merged, written as one VCF and read back."""
    from ..operators import sv

    spark, at = calls.sparkSession, _place(calls)
    primaries, links = sv.merge_callers(calls, 4)
    wr.write_lines(wr.merged_sv_lines(primaries, links, calls), at, wr.vcf_header([]))
    info = lambda k: F.element_at("info", k)
    return rd.read_vcf(spark, at).select("id", "chrom", "pos0", info("SVTYPE").alias("svtype"), info("SUPPORT").alias("support"), info("N_SOURCES").alias("n_sources"))


@query("allele_counts", "I19", "fx_gt", sql="""
select site_id, cast(coalesce(sum(coalesce(g0, 0) + coalesce(g1, 0)), 0) as integer) as ac, cast(count(g0) + count(g1) as integer) as an, coalesce(sum(coalesce(g0, 0) + coalesce(g1, 0)), 0) > 0 as kept from fx_gt group by site_id
""")
def allele_counts(gt):
    sites = gt.groupBy("site_id").agg(F.collect_list(F.array("g0", "g1")).alias("gts"))
    ac, an = nm.allele_counts(F.col("gts"), F.lit(1))
    both = sites.select("site_id", ac.alias("counts"), an.alias("an"))
    return both.select("site_id", F.get("counts", 0).alias("ac"), "an", (F.size(nm.trim_alternatives(F.array(F.lit("T")), F.col("counts"))) > 0).alias("kept"))


#: Reference sequences with stretches of one base and of repeats; deletions and tandem duplications in them, some with a second alternative that changes the last base.
_INDELS = """
q as (select chrom, string_agg(repeat(ref, cast(1 + site_id % 7 as integer)) || case when site_id % 160 = 0 then repeat('ACT', 60) else '' end, '' order by site_id) as seq from fx_site group by chrom),
v as (select site_id, q.chrom, substr(seq, 400 + (site_id * 37) % (length(seq) - 800) - 198, 220) as seq, 400 + (site_id * 37) % (length(seq) - 800) as a, 1 + site_id % 3 as k, site_id % 2 = 0 as deletes, site_id % 5 = 0 as two from fx_site s join q on q.chrom = s.chrom)
"""


@query("left_align", "I18 SC17", "fx_site", sql=f"""
with {_INDELS}, m as (select *, 199 as o, unnest(range(0, 200)) as t from v),
f as (select site_id, min(t) filter (where case when deletes then substr(seq, t + 2, o - t) = substr(seq, t + 2 + k, o - t)
    else substr(substr(seq, t + 2, o - t) || substr(seq, o + 2, k), k + 1) = substr(seq, t + 2, o - t) end) as t from m group by site_id),
g as (select v.*, f.t, 199 as o from v join f on f.site_id = v.site_id)
select site_id, 1 as alt_no, a - o + t as pos0, substr(seq, t + 1, case when deletes then 1 + k else 1 end) as ref, case when deletes then substr(seq, t + 1, 1) else substr(seq, t + 1, 1) || left(substr(seq, t + 2, o - t) || substr(seq, o + 2, k), k) end as alt from g
union all select site_id, 2, a + case when deletes then k else 0 end, substr(seq, o + 1 + case when deletes then k else 0 end, 1), translate(substr(seq, o + 1 + case when deletes then k else 0 end, 1), 'ACGT', 'CGTA') from g where two
""")
def left_align(site):
    """Normalised against a FASTA that is written and read back; a shift crosses many of its small chunks."""
    at = _place(site)
    piece = F.concat(F.repeat("ref", (1 + F.col("site_id") % 7).cast("int")), F.when(F.col("site_id") % 160 == 0, F.repeat(F.lit("ACT"), 60)).otherwise(""))
    # a line holds the pieces of 16 sites: no row has a chromosome
    pieces = running(site.select("chrom", "site_id", piece.alias("x"), F.expr("floor(site_id / 16384)").alias("_bin")), ["chrom"], "_bin", ["site_id"], F.lit(1), "n", how="sum")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("site_id", "x"))), lambda p: p["x"]), "")
    lines = pieces.groupBy("chrom", F.expr("n div 16").alias("line")).agg(text.alias("value"))
    heads = site.select("chrom").distinct().select("chrom", F.lit(-1).cast("long").alias("line"), F.concat(F.lit(">"), "chrom").alias("value"))
    wr.write_lines(lines.unionByName(heads).repartition("chrom").sortWithinPartitions("chrom", "line").select("value"), at)
    chunks = cut(rd.read_fasta_chunks(site.sparkSession, at, 64))
    length = chunks.groupBy("chrom").agg(F.sum(F.length("sequence")).alias("length"))
    a, k = 400 + (F.col("site_id") * 37) % (F.col("length") - 800), 1 + F.col("site_id") % 3
    at_base = site.select("site_id", "chrom").join(length, "chrom").select("site_id", "chrom", a.alias("a"), k.alias("k"), (F.col("site_id") % 2 == 0).alias("deletes")).withColumn("z", F.col("a") + 1 + F.col("k"))
    bases = rd.fasta_region(chunks, at_base.select("chrom", F.col("a").alias("s"), F.col("z").alias("e")), 64).select("chrom", F.col("s").alias("a"), F.col("e").alias("z"), F.upper("sequence").alias("bases"))
    placed = at_base.join(bases, ["chrom", "a", "z"])
    ref = F.when(F.col("deletes"), F.col("bases")).otherwise(F.left("bases", F.lit(1)))
    alt = F.when(F.col("deletes"), F.left("bases", F.lit(1))).otherwise(F.col("bases"))
    last = F.concat(F.expr("left(ref, length(ref) - 1)"), F.translate(F.right("ref", F.lit(1)), "ACGT", "CGTA"))
    records = placed.select("site_id", "chrom", F.col("a").alias("pos0"), ref.alias("ref"), alt.alias("alt"))
    records = records.select("site_id", "chrom", "pos0", "ref", F.when(F.col("site_id") % 5 == 0, F.array("alt", last)).otherwise(F.array("alt")).alias("alts"))
    made = nm.normalise(records, chunks, 64, reach=16)
    return made.where("matches").select("site_id", "alt_no", "pos0", "ref", "alt")


@query("file_ordered", "SK1 SK4 SK7 I1", "fx_site", sql="""
select 'vcf' as file, chrom, pos0 + 1 as pos from fx_site where site_id % 3 > 0 and chrom = 'chr2' and pos0 + 1 between 2000000 and 9000000
union all select 'bed', chrom, pos0 from fx_site where chrom = 'chr3' and pos0 between 0 and 5000000
""")
def file_ordered(site):
    """Pass and fail VCFs and a BED, each in order over its parts, read back by region through their indexes."""
    spark, at = site.sparkSession, _place(site)
    none = F.array(F.struct(F.lit("").alias("sample"), F.array(F.lit(None).cast("int")).alias("gt"), F.lit(False).alias("phased"), F.lit(None).cast("int").alias("dp"), F.lit(None).cast("int").alias("gq")))
    records = site.select(
        "chrom", "pos0", F.col("site_id").cast("string").alias("id"), "ref", F.array("alt").alias("alts"), F.col("qual").cast("double").alias("qual"), F.array(F.lit("PASS")).alias("filters"), F.create_map(F.lit("X"), F.lit("1")).alias("info"),
        none.alias("calls"), F.when(F.col("site_id") % 3 > 0, "pass").otherwise("fail").alias("status"),
    )
    wr.split_by_status(records, at, lambda rows: wr.vcf_lines(rows, []), wr.vcf_header([]))
    wr.write_ordered(wr.bed_lines(site.select("chrom", F.col("pos0").alias("s"), (F.col("pos0") + 9).alias("e"))), f"{at}/bed")
    f = F.split("value", "\t")
    rows = lambda name, found: found.select(F.lit(name).alias("file"), f[0].alias("chrom"), f[1].cast("long").alias("pos"))
    return rows("vcf", wr.read_ordered(spark, f"{at}/pass", "chr2", 2_000_000, 9_000_000)).unionByName(rows("bed", wr.read_ordered(spark, f"{at}/bed", "chr3", 0, 5_000_000)))


@query("file_region", "SC4 SC5 SC7 F1", "fx_site", "fx_gt", sql="""
select s.chrom, s.pos0, s.ref, s.alt, cast(s.qual as double) as qual, g.id, g.g0, g.g1 from fx_site s join fx_gt g on g.site_id = s.site_id
where s.qual >= 12 and ((s.chrom = 'chr2' and s.pos0 between 3000000 and 6500000) or (s.chrom = 'chr4' and s.pos0 between 0 and 1000000))
""")
def file_region(site, gt):
    """Two regions of stored records, from the folders and row groups that they touch."""
    at = _place(site)
    call = F.struct(F.col("id").alias("sample"), F.array("g0", "g1").alias("gt"))
    calls = gt.groupBy("site_id").agg(F.collect_list(call).alias("calls"))
    rd.store_records(site.join(calls, "site_id").select("chrom", "pos0", "ref", F.array("alt").alias("alts"), F.col("qual").cast("double").alias("qual"), "calls"), at, 1 << 20)
    found = rd.read_region(site.sparkSession, at, [("chr2", 3_000_000, 6_500_000), ("chr4", 0, 1_000_000)], 12.0, 1 << 20)
    return found.select("chrom", "pos0", "ref", F.get("alts", 0).alias("alt"), "qual", F.explode("calls").alias("c")).select("chrom", "pos0", "ref", "alt", "qual", F.col("c.sample").alias("id"), F.get("c.gt", 0).alias("g0"), F.get("c.gt", 1).alias("g1"))


@query("label_combinations", "J19", "fx_ped", sql="""
with k as (select father, mother, id, row_number() over (partition by father, mother order by id) - 1 as j, count(*) over (partition by father, mother) as n from fx_ped where father is not null and mother is not null),
c as (select k.*, unnest(range(cast(pow(4, n) as bigint))) as x from k)
select father, mother, id, case when (x >> (2 * j)) % 2 = 0 then 'A' else 'B' end as h0, case when (x >> (2 * j + 1)) % 2 = 0 then 'C' else 'D' end as h1, count(*) as n, cast(sum(x) as bigint) as combinations from c group by all
""")
def label_combinations(ped):
    """How often each child of each couple of the table has each pair of labels, and the sum of the combinations' numbers."""
    return nm.label_combinations(ped).groupBy("father", "mother", "id", "h0", "h1").agg(F.count(F.lit(1)).alias("n"), F.sum("combination").alias("combinations"))


@query("file_annotated", "SK9 SK10 J11 J12 J13 G16", "fx_site", sql="""
with v as (select *, case when site_id % 3 = 1 then 'HAP_PASS' when site_id % 2 = 0 then 'HAP_FAIL' else 'HAP_OVLP' end as label from fx_site)
select chrom, pos0, ref, alt, case when site_id % 4 = 0 and site_id % 5 <> 0 then 'old,' || label when site_id % 4 = 0 then 'old' when site_id % 5 <> 0 then label end as ovl from v
""")
def file_annotated(site):
    """Labels of variants as JSON, read back into the INFO of a VCF, which is written and read back."""
    from ..operators import truthset

    spark, at = site.sparkSession, _place(site)
    key = F.concat_ws(":", "chrom", F.col("pos0").cast("string"), "ref", "alt")
    variants = site.select((F.col("site_id") % 7).alias("key"), (F.col("site_id") % 3).alias("hap"), key.alias("variant"), (F.col("site_id") % 2 == 0).alias("overlaps"), "site_id")
    labelled = truthset.haplotype_labels(variants, spark.range(7).select(F.col("id").alias("key"), F.lit(1).alias("hap"))).where("site_id % 5 <> 0")
    wr.write_lines(wr.json_lines(labelled.select(F.col("variant").alias("key"), F.col("label").alias("anno"))), f"{at}/var_anno.json")
    labels = rd.read_json_lines(spark, f"{at}/var_anno.json", "key string, anno string").withColumn("n", F.lit(0))
    none = F.array(F.struct(F.lit("").alias("sample"), F.array(F.lit(None).cast("int")).alias("gt"), F.lit(False).alias("phased"), F.lit(None).cast("int").alias("dp"), F.lit(None).cast("int").alias("gq")))
    info = F.when(F.col("site_id") % 4 == 0, F.create_map(F.lit("OVL"), F.lit("old"), F.lit("X"), F.lit("1"))).otherwise(F.create_map(F.lit("X"), F.lit("1")))
    records = site.select("chrom", "pos0", F.lit(None).cast("string").alias("id"), "ref", F.array("alt").alias("alts"), F.col("qual").cast("double").alias("qual"), F.array(F.lit("PASS")).alias("filters"), info.alias("info"), none.alias("calls"))
    wr.write_lines(wr.vcf_lines(truthset.annotate_records(records, labels), []), f"{at}/vcf", wr.vcf_header([]))
    return rd.read_vcf(spark, f"{at}/vcf").select("chrom", "pos0", "ref", F.get("alts", 0).alias("alt"), F.try_element_at("info", F.lit("OVL")).alias("ovl"))


@query("file_repeats_kept", "SK14 J14", "fx_tr", sql="""
select cast(trid as varchar) as trid, 'S' || lpad(cast(i as varchar), 2, '0') as id, cast(slot as integer) as slot, seq, 'chr1' || chr(9) || trid * 100 || chr(9) || (trid * 100 + 50) || chr(9) || trid as line from fx_tr where trid % 3 = 0
""")
def file_repeats_kept(tr):
    """The loci of a repeat VCF that a set names, their lines as they were, and a BED of them."""
    spark, at = tr.sparkSession, _place(tr)
    wr.write_lines(_repeat_lines(tr), f"{at}/all", wr.vcf_header(PEOPLE))
    keep = tr.where("trid % 3 = 0").select(F.col("trid").cast("string").alias("trid")).distinct()
    wr.subset_repeats(spark, f"{at}/all", keep, f"{at}/kept")
    rows = rd.read_repeats_vcf(spark, f"{at}/kept")
    wr.write_lines(wr.bed_lines(rows.select("chrom", "s", "e", "trid").distinct(), "trid"), f"{at}/bed")
    bed = rd.read_bed(spark, f"{at}/bed").select(F.get("rest", 0).alias("trid"), F.concat_ws("\t", "chrom", F.col("s").cast("string"), F.col("e").cast("string"), F.get("rest", 0)).alias("line"))
    return rows.join(bed, "trid").select("trid", "id", "slot", "seq", "line")


#: Lines of each format made of sites, of which every seventh, eleventh and thirteenth is damaged.
_DAMAGED = {
    "bed": "concat_ws('\t', chrom, {n}, cast(pos0 + 5 as string))",
    "ped": "concat_ws(' ', 'f', cast(site_id as string), 'NA', 'NA', {n}, '2')",
    "vcf": "concat_ws('\t', chrom, {n}, '.', ref, alt, '9', '.', '.', 'GT', '0/1')",
    "inheritance": "concat_ws(',', chrom, {n}, cast(pos0 + 5 as string), 'AC', 'BD')",
    "iht": "concat_ws(' ', chrom, {n}, cast(pos0 + 5 as string), 'A/B', '4')",
    "paf": "concat_ws('\t', 'a', '1', '0', '1', '+', 'b', '1', '0', '1', '1', {n}, '60', 'NM:i:3')",
    "sam": "concat_ws('\t', 'r', '0', chrom, {n}, '60', '5M', '*', '0', '0', 'ACGTA', '*')",
    "fai": "concat_ws('\t', chrom, {n}, '6')",
    "mash": "concat_ws('\t', concat_ws(':', chrom, {n}, '1', ref, alt), 'x', 'y')",
    "regions": "concat(chrom, ':', {n}, '-', cast(pos0 + 5 as string))",
    "sites": "concat_ws('\t', cast(site_id as string), chrom, {n})",
}


def _reason(kind: str) -> str:
    """SQL: why a line of the damaged files is bad."""
    number = {"ped": "sex is no number", "paf": "block length is no number", "fai": "length is no number", "bed": "start or end is no number", "inheritance": "start or end is no number", "iht": "start or end is no number", "regions": "no chrom:start-end"}.get(kind, "position is no number")
    few = {"bed": 3, "ped": 6, "vcf": 8, "inheritance": 4, "iht": 5, "paf": 12, "sam": 11, "fai": 2, "mash": 3, "sites": 3}.get(kind)
    short = f"'fewer than {few} fields'" if few else "'no chrom:start-end'"
    return f"case when site_id % 11 = 0 then {short} when site_id % 7 = 0 then {'null' if kind == 'mash' else repr(number)} end"


@query("file_damaged", "2.14", "fx_site", sql="select kind, reason, count(*) as n from (" + " union all ".join(f"select '{k}' as kind, {_reason(k)} as reason from fx_site" for k in _DAMAGED) + ") x group by kind, reason")
def file_damaged(site):
    """Damaged files of every format: how many lines are bad, and why."""
    from ..sources import validation

    spark, at = site.sparkSession, _place(site)
    out = None
    for kind, line in _DAMAGED.items():
        number = "if(site_id % 7 = 0, 'x1', cast(pos0 % 1000 as string))"
        text = F.expr(f"if(site_id % 11 = 0, 'cut', {line.format(n=number)})")
        wr.write_lines(site.select(text), f"{at}/{kind}")
        found = validation.checked(spark, f"{at}/{kind}", kind).groupBy(F.lit(kind).alias("kind"), "reason").agg(F.count(F.lit(1)).alias("n"))
        out = found if out is None else out.unionByName(found)
    return out


@query("text_rewrites", "2.15 2.12", "fx_gt", sql="""
select site_id, id, case when i % 5 = 0 then '##' || id || '|' || coalesce(g0, 9) else coalesce(g0, 9) || '/' || coalesce(g1, 9) end as line, case when i % 2 = 0 then '>hap1_' || id || ' x' else 'AC|GT' end as name from fx_gt
""")
def text_rewrites(gt):
    from ..functions import text as tx

    a, b = F.coalesce("g0", F.lit(9)).cast("string"), F.coalesce("g1", F.lit(9)).cast("string")
    line = F.when(F.col("i") % 5 == 0, F.concat(F.lit("##"), "id", F.lit("|"), a)).otherwise(F.concat(a, F.lit("|"), b))
    name = F.when(F.col("i") % 2 == 0, F.concat(F.lit(">"), "id", F.lit(" x"))).otherwise("AC|GT")
    return gt.select("site_id", "id", tx.unphase_separators(line).alias("line"), tx.prefix_name(name, "hap1_").alias("name"))


@query("caller_sets", "2.11 F19", "fx_sv", sql="""
with a as (select distinct chrom, svtype, start_pos % 50 as x from fx_sv where prio = 0), b as (select distinct chrom, svtype, start_pos % 50 as x from fx_sv where prio = 1)
select 'both' as kind, * from (select * from a intersect select * from b) union all select 'first', * from (select * from a except select * from b) union all select 'second', * from (select * from b except select * from a)
""")
def caller_sets(calls):
    """What two callers share and what only one of them has."""
    place = lambda prio: calls.where(F.col("prio") == prio).select("chrom", "svtype", (F.col("start_pos") % 50).alias("x")).distinct()
    a, b = place(0), place(1)
    named = lambda df, kind: df.select(F.lit(kind).alias("kind"), "chrom", "svtype", "x")
    return named(a.intersect(b), "both").unionByName(named(a.subtract(b), "first")).unionByName(named(b.subtract(a), "second"))
