"""Queries of the truth-set, haplotype-graph and assembly operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import assembly, haplograph
from ..operators import truthset as ts
from .registry import query

_MASH = """
cl as (select s.chrom || ':' || (s.pos0 - s.pos0 % 20000) || ':' || (s.pos0 - s.pos0 % 20000 + 1) || ':' || s.ref || ':' || s.alt as site, case when g.g0 is null then './.' else g.g0 || '/' || g.g1 end as genotype, 'c' || (g.i % 3) as caller
  from fx_site s join fx_gt g on g.site_id = s.site_id),
co as (select site, string_agg(genotype, ',' order by genotype) as genotypes, string_agg(caller, ',' order by caller) as callers, count(distinct genotype) > 1 as conflict, count(distinct caller) as n_sources, min(genotype) as genotype from cl group by site)
"""


def _calls(site, gt):
    pos = F.col("pos0") - F.col("pos0") % 20000
    key = F.concat_ws(":", "chrom", pos.cast("string"), (pos + 1).cast("string"), "ref", "alt")
    genotype = F.when(F.col("g0").isNull(), "./.").otherwise(F.concat_ws("/", F.col("g0").cast("string"), F.col("g1").cast("string")))
    both = site.join(gt, "site_id")
    return both.select(key.alias("site"), genotype.alias("genotype"), F.concat(F.lit("c"), (F.col("i") % 3).cast("string")).alias("caller"))


@query("mash_collapse", "A7", "fx_site", "fx_gt", sql=f"with {_MASH} select site, genotypes, callers from co")
def mash_collapse(site, gt):
    c = ts.collapse_sites(_calls(site, gt))
    return c.select("site", F.array_join("genotypes", ",").alias("genotypes"), F.array_join("callers", ",").alias("callers"))


@query("mash_conflict", "A8", "fx_site", "fx_gt", sql=f"with {_MASH} select site, conflict, n_sources, genotype from co")
def mash_conflict(site, gt):
    return ts.conflicts(ts.collapse_sites(_calls(site, gt))).select("site", "conflict", F.col("n_sources").cast("long").alias("n_sources"), "genotype")


@query("mash_contained", "G13 J10", "fx_site", sql="""
with s as (select site_id, chrom, pos0 // 20000 as pos, ref, case when site_id % 3 = 0 then [alt, substr('ACGT', cast(1 + site_id % 4 as integer), 1)] else [alt] end as alts, site_id % 11 = 0 as conflict from fx_site),
e as (select site_id, chrom, pos, ref, len(alts) as n_alts, unnest(alts) as alt from s), k as (select site_id as other, chrom, pos, ref, unnest(alts) as alt from s where not conflict),
h as (select site_id, n_alts, count(distinct e.alt) as n from e join k using (chrom, pos, ref, alt) where site_id <> other group by site_id, n_alts)
select s.site_id, case when conflict then 'gt_mismatch' when h.n = h.n_alts then 'contained' else 'PASS' end as filter from s left join h on h.site_id = s.site_id
""")
def mash_contained(site):
    second = F.substr(F.lit("ACGT"), (1 + F.col("site_id") % 4).cast("int"), F.lit(1))
    alts = F.when(F.col("site_id") % 3 == 0, F.array(F.col("alt"), second)).otherwise(F.array("alt"))
    sites = site.select(F.col("site_id").alias("site"), "chrom", F.expr("pos0 div 20000").alias("pos"), "ref", alts.alias("alts"), (F.col("site_id") % 11 == 0).alias("conflict"))
    return ts.contained(sites).select(F.col("site").alias("site_id"), ts.site_filter(F.col("conflict"), F.col("contained")).alias("filter"))


@query("anno_join", "J11 SK10", "fx_site", sql="""
with k as (select site_id, chrom || ':' || (pos0 // 3000) as key from fx_site), a as (select key, max(site_id) as anno from k where site_id % 2 = 0 group by key)
select k.site_id, a.anno from k left join a on a.key = k.key
""")
def anno_join(site):
    keyed = site.select("site_id", F.concat_ws(":", "chrom", F.expr("pos0 div 3000").cast("string")).alias("key"))
    notes = keyed.where("site_id % 2 = 0").select("key", F.col("site_id").alias("anno"), F.col("site_id").alias("n"))
    return ts.annotate(keyed, notes).select("site_id", "anno")


_HAPS = """
al as (select start_pos // 40000 as key, row_number() over (partition by start_pos // 40000 order by id) as n, prio as hap, abs(svlen) * 6 as block_len, start_pos % 7 as edits, start_pos % 3 as indels from fx_sv),
ch as (select key, hap, edits, indels from (select *, row_number() over (partition by key order by edits, indels, n) as r from al where block_len >= 1500 or n = 1) x where r = 1)
"""


def _alignments(calls):
    from pyspark.sql import Window

    key = F.expr("start_pos div 40000").alias("key")
    n = F.row_number().over(Window.partitionBy(F.expr("start_pos div 40000")).orderBy("id")).alias("n")
    return calls.select("id", key, n, F.col("prio").alias("hap"), (F.abs("svlen") * 6).alias("block_len"), (F.col("start_pos") % 7).alias("edits"), (F.col("start_pos") % 3).alias("indels"))


@query("hap_select", "A11", "fx_sv", sql=f"with {_HAPS} select key, cast(hap as bigint) as hap, edits, indels from ch")
def hap_select(calls):
    return ts.best_haplotypes(_alignments(calls)).withColumn("hap", F.col("hap").cast("long"))


@query("hap_annotations", "J12 J13 G16", "fx_sv", sql=f"""
with {_HAPS} select f.id, case when ch.hap is not null then 'HAP_PASS' when f.start_pos % 5 = 0 then 'HAP_FAIL' else 'HAP_OVLP' end as label from fx_sv f left join ch on ch.key = f.start_pos // 40000 and ch.hap = f.prio
""")
def hap_annotations(calls):
    variants = calls.select(F.expr("start_pos div 40000").alias("key"), F.col("prio").alias("hap"), "id", (F.col("start_pos") % 5 == 0).alias("overlaps"))
    return ts.haplotype_labels(variants, ts.best_haplotypes(_alignments(calls))).select("id", "label")


@query("problem_regions", "F21 F20 F22", "fx_iv", sql="""
with x as (select chrom, s, e, row_number() over (partition by chrom order by s, e) as k, s % 9 as x, e % 10 as y from fx_iv where s % 9 >= 6 or e % 10 >= 6),
p as (select *, max(e) over (partition by chrom order by k rows between unbounded preceding and 1 preceding) as pe from x),
i as (select *, sum(case when pe is null or s > pe then 1 else 0 end) over (partition by chrom order by k rows unbounded preceding) as island from p)
select chrom, min(s) as s, max(e) as e, count(*) as n from i group by chrom, island
""")
def problem_regions(a):
    return ts.problem_regions(a.withColumns({"x": F.col("s") % 9, "y": F.col("e") % 10}))


@query("region_haplotypes", "W10 S3 S4", "fx_site", sql="""
with recursive v as (select distinct cast(pos0 // 40000 as varchar) as region, pos0 % 40 as p, case when alt = 'A' then 'C' else alt end as alt from fx_site),
r as (select *, dense_rank() over (partition by region order by p) as k from v),
w as (select distinct region, cast(0 as bigint) as k, '' as hap, cast(-1 as bigint) as last, '' as alts from v
  union all select w.region, r.k, w.hap || repeat('A', cast(r.p - w.last - 1 as integer)) || r.alt, r.p, w.alts || r.alt from w join r on r.region = w.region and r.k = w.k + 1),
m as (select region, max(k) as n from r group by region)
select w.region, row_number() over (partition by w.region order by alts) - 1 as path, n as n_variants, hap || repeat('A', cast(59 - last as integer)) as haplotype, true as complete from w join m on m.region = w.region and m.n = w.k
""")
def region_haplotypes(site):
    at = F.col("pos0") % 40
    base = F.repeat(F.lit("A"), 60)
    return haplograph.region_haplotypes(
        site.select(F.expr("pos0 div 40000").alias("region"), base.alias("sequence"), F.lit(0).alias("offset"), at.alias("pos"), F.lit("A").alias("ref"), F.when(F.col("alt") == "A", "C").otherwise(F.col("alt")).alias("alt"))
    )


_MARKED = """
v as (select distinct chrom, pos0 // 40000 as region, pos0 % 400 as pos, case when site_id % 4 = 0 then ref || 'ACG' when site_id % 4 = 1 then ref || 'A' else ref end as ref, case when site_id % 4 = 2 then alt || 'TT' when site_id % 4 = 1 then ref else alt end as alt from fx_site),
w as (select *, length(ref) = 1 and length(alt) = 1 as one from v),
p as (select *, pos + case when one then 0 else 1 end as st, pos + case when not one and length(ref) > length(alt) then length(ref) - length(alt) else 0 end as en from w),
n as (select *, lead(st) over o as nx, lag(en) over o as pv, row_number() over o as idx from p window o as (partition by chrom, region order by pos, ref, alt))
"""


@query("file_overlaps", "W10 SK8", "fx_site", sql=f"""
with {_MARKED} select chrom || chr(9) || (pos + 1) || chr(9) || ref || chr(9) || alt || chr(9) || case when en >= nx then 'OvlNext' else 'OvlPrev' end || chr(9) || idx || chr(9) || 0 as line from n where en >= nx or pv >= st
""")
def file_overlaps(site):
    """Overlapping variants of each region, written and read back."""
    from ..operators.storage import shared_folder
    from ..sources import writers

    k = F.col("site_id") % 4
    ref = F.when(k == 0, F.concat("ref", F.lit("ACG"))).when(k == 1, F.concat("ref", F.lit("A"))).otherwise(F.col("ref"))
    alt = F.when(k == 2, F.concat("alt", F.lit("TT"))).when(k == 1, F.col("ref")).otherwise(F.col("alt"))
    rows = site.select("chrom", F.expr("pos0 div 40000").alias("region"), (F.col("pos0") % 400).alias("pos"), ref.alias("ref"), alt.alias("alt")).distinct().withColumn("hap", F.lit(0))
    at = f"{shared_folder(site.sparkSession)}/{uuid.uuid4().hex}"
    writers.write_lines(writers.overlap_lines(haplograph.overlaps(rows, ["chrom", "region"])), at)
    return site.sparkSession.read.text(at).select(F.col("value").alias("line"))


@query("file_haplotypes", "S3 S4 SK8 J12", "fx_site", sql="""
with recursive v as (select distinct cast(pos0 // 40000 as varchar) as region, pos0 % 40 as p, case when alt = 'A' then 'C' else alt end as alt from fx_site where site_id % 2 = 0),
r as (select *, dense_rank() over (partition by region order by p) as k from v),
w as (select distinct region, cast(0 as bigint) as k, '' as hap, cast(-1 as bigint) as last, '' as alts, '' as vars from v
  union all select w.region, r.k, w.hap || repeat('a', cast(r.p - w.last - 1 as integer)) || lower(r.alt), r.p, w.alts || r.alt, w.vars || r.p || r.alt || ';' from w join r on r.region = w.region and r.k = w.k + 1),
m as (select region, max(k) as n from r group by region)
select 's1;' || w.region || ';hap:' || (row_number() over (partition by w.region order by alts) - 1) as label, n as count, hap || repeat('a', cast(59 - last as integer)) as sequence, vars from w join m on m.region = w.region and m.n = w.k
""")
def file_haplotypes(site):
    """Sequences and variants of all ways as FASTA and JSON, read back and put together by label."""
    from ..operators.storage import shared_folder
    from ..sources import readers, writers

    spark = site.sparkSession
    at = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    alt = F.when(F.col("alt") == "A", "C").otherwise(F.col("alt"))
    rows = site.where("site_id % 2 = 0").select(F.expr("pos0 div 40000").alias("region"), F.repeat(F.lit("A"), 60).alias("sequence"), F.lit(0).alias("offset"), (F.col("pos0") % 40).alias("pos"), F.lit("A").alias("ref"), alt.alias("alt"))
    writers.write_haplotypes(haplograph.region_haplotypes(rows, with_variants=True), "s1", at)
    made = readers.read_json_lines(spark, f"{at}/variants.json", "label string, count long, vars array<struct<pos:long,ref:string,alt:string>>")
    text = F.array_join(F.transform("vars", lambda v: F.concat(v["pos"].cast("string"), v["alt"], F.lit(";"))), "")
    found = readers.read_fasta(spark, f"{at}/haps.fasta").withColumnRenamed("name", "label")
    return made.select("label", "count", text.alias("vars")).join(found, "label")


@query("cigar_projection", "S11", "fx_site", sql="""
select site_id, case when t < 20 then t when t < 25 then 20 else t - 5 + 3 end as q from (select site_id, pos0 % 50 as t from fx_site) x
""")
def cigar_projection(site):
    cigar = assembly.parse_cigar(F.lit("20M5D3I40M"))
    return site.select("site_id", assembly.project(cigar, F.lit(0), F.col("pos0") % 50).alias("q"))


#: Per block and sample: the sequences of its two haplotypes, of which some have a base of their own, and how its contigs lie.
_ASSEMBLED = """
a as (select chrom, b, start_pos, i, id, h0, h1, case when i >= 6 and i % 7 = 0 and b % 5 = 0 then 'T' else '' end as own, i = 9 and b % 11 = 3 as lacks, i = 8 and b % 13 = 5 as twice from fx_label),
q as (select *, case h0 when 'A' then case when b % 2 = 0 then 'AC' else 'GT' end when 'B' then case when b % 2 = 0 then 'GT' else 'AC' end when 'C' then case when b % 4 < 2 then 'CA' else 'TG' end else case when b % 4 < 2 then 'TG' else 'CA' end end as s0,
  case h1 when 'A' then case when b % 2 = 0 then 'AC' else 'GT' end when 'B' then case when b % 2 = 0 then 'GT' else 'AC' end when 'C' then case when b % 4 < 2 then 'CA' else 'TG' end else case when b % 4 < 2 then 'TG' else 'CA' end end as s1 from a)
"""


@query("assembly_concordance", "G11 J3 J7 S11", "fx_label", sql=f"""
with {_ASSEMBLED}, r as (select chrom, b, count(*) filter (where lacks) as n_missing, count(*) filter (where twice and not lacks) as n_multi, bool_or(own <> '') as bad from q group by chrom, b)
select chrom || ':' || b as region, n_missing + n_multi = 0 and b % 7 <> 6 and not bad as concordant, cast(case when n_missing + n_multi = 0 and b % 7 <> 6 and not bad then case when b % 4 = 0 then 0 when b % 4 = 1 then 1 when b % 4 = 2 then 3 else 2 end end as integer) as config,
  n_missing, n_multi, b % 7 <> 6 as in_block from r
""")
def assembly_concordance(label):
    """Contigs with clips, insertions and deletions, cut to a region of each block; every seventh region is in no block."""
    spark = label.sparkSession
    odd, late = F.col("b") % 2 == 1, F.col("b") % 4 >= 2
    ab, cd = lambda x: F.when(x, "GT").otherwise("AC"), lambda x: F.when(x, "TG").otherwise("CA")
    of = lambda h: F.when(h == "A", ab(odd)).when(h == "B", ab(~odd)).when(h == "C", cd(late)).otherwise(cd(~late))
    rows = label.select("chrom", "b", "start_pos", "i", "id", "h0", "h1", F.explode(F.array(F.lit(1), F.lit(2))).alias("hap"))
    rows = rows.where(~((F.col("i") == 9) & (F.col("b") % 11 == 3) & (F.col("hap") == 2)))
    twice = F.when((F.col("i") == 8) & (F.col("b") % 13 == 5) & (F.col("hap") == 1), 2).otherwise(1)
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), twice)))
    # the region takes 41 bases, the last beyond its end; a sample's own base stands at their end
    bad = (F.col("i") >= 6) & (F.col("i") % 7 == 0) & (F.col("b") % 5 == 0)
    two = of(F.when(F.col("hap") == 1, F.col("h0")).otherwise(F.col("h1")))
    inside = F.concat(F.repeat(two, 20), F.when(bad, "N").otherwise(F.substring(two, 1, 1)))
    clip, inserted = 3 + F.col("i"), 1 + F.col("b") % 9
    filler = lambda n: F.repeat(F.substring(F.lit("ACGT"), 1 + F.col("i") % 4, 1), n.cast("int"))
    seq = F.concat(filler(clip + 100 + inserted), inside, filler(F.lit(300)))
    cigar = F.concat(clip.cast("string"), F.lit("S100M"), inserted.cast("string"), F.lit("I20M5D70M2H"))
    # the deletion is after the region's first 20 bases: they go on behind it
    contigs = rows.select(F.col("id").alias("sample"), "hap", "chrom", F.col("start_pos").alias("pos0"), F.concat(cigar, F.lit("")).alias("cigar"), seq.alias("seq"), (F.col("i") % 2 == 0).alias("reverse"))
    regions = label.select("chrom", "b", "start_pos").distinct().select(F.concat_ws(":", "chrom", F.col("b").cast("string")).alias("region"), "chrom", "b", (F.col("start_pos") + 100).alias("s"), (F.col("start_pos") + 145).alias("e"))
    found = assembly.haplotypes(assembly.region_sequences(contigs, regions), regions, [(f"S{i:02d}", i % 2 == 0) for i in range(4, 14)])
    blocks = label.where(F.col("b") % 7 != 6).select(F.concat_ws(":", "chrom", F.col("b").cast("string")).alias("region"), F.col("id").alias("sample"), "h0", "h1")
    return assembly.concordance(found, blocks, "S04", "S05")
