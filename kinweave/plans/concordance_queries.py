"""Queries of the concordance and phasing operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import genotype as g
from ..operators import concordance as cc
from ..operators import hapmap, phasing
from .registry import query

_VIEWS = ("fx_site", "fx_block", "fx_label", "fx_gt")
_KEEP = 5.0

#: Sites in blocks with the parents' alleles under each of the four configurations.
_CONFIG = """
sb as (select s.*, b.b, b.start_pos, b.end_pos from fx_site s join fx_block b on s.chrom = b.chrom and s.pos0 between b.start_pos and b.end_pos),
pa as (select sb.site_id, d.g0 as d0, d.g1 as d1, m.g0 as m0, m.g1 as m1 from sb left join fx_gt d on d.site_id = sb.site_id and d.id = 'S04' left join fx_gt m on m.site_id = sb.site_id and m.id = 'S05'),
cf as (select pa.site_id, k, case when k % 2 = 0 then d0 else d1 end as a, case when k % 2 = 0 then d1 else d0 end as b,
  case when k < 2 then m0 else m1 end as c, case when k < 2 then m1 else m0 end as d from pa cross join (select unnest(range(4)) as k) r),
ok as (select cf.site_id, cf.k from cf join sb on sb.site_id = cf.site_id join fx_gt x on x.site_id = cf.site_id and x.i >= 6 join fx_label l on l.chrom = sb.chrom and l.b = sb.b and l.id = x.id
  group by cf.site_id, cf.k having bool_and(coalesce(
    least(case l.h0 when 'A' then cf.a when 'B' then cf.b when 'C' then cf.c else cf.d end, case l.h1 when 'A' then cf.a when 'B' then cf.b when 'C' then cf.c else cf.d end) = least(x.g0, x.g1)
    and greatest(case l.h0 when 'A' then cf.a when 'B' then cf.b when 'C' then cf.c else cf.d end, case l.h1 when 'A' then cf.a when 'B' then cf.b when 'C' then cf.c else cf.d end) = greatest(x.g0, x.g1), false))),
al as (select site_id, bool_or(g0 is null) as missing, bool_and(g0 = 0 and g1 = 0) as ref, bool_and(g0 <> g1) as het from fx_gt group by site_id),
st as (select sb.*, ok.k, case when sb.qual < 5 then 'low_qual' when al.site_id is null or al.missing then 'nocall' when al.ref then 'all_ref' when al.het then 'all_het' when ok.k is not null then 'pass' else 'fail' end as status
  from sb left join (select site_id, min(k) as k from ok group by site_id) ok on ok.site_id = sb.site_id left join al on al.site_id = sb.site_id)
"""


def _decided(site, block, label, gt):
    return cc.statuses(cc.gather(site, block, label.where("i >= 6"), gt, ["S04", "S05"]), _KEEP)


@query("site_block_join", "J1 J2 J3 SC5", "fx_site", "fx_block", sql="""
select s.site_id, b.chrom, b.b from fx_site s join fx_block b on s.chrom = b.chrom and s.pos0 between b.start_pos and b.end_pos
""")
def site_block_join(site, block):
    return cc.block_join(site, block).select("site_id", "chrom", "b")


@query("sites_not_in_block", "J1", "fx_site", "fx_block", sql="""
select s.site_id from fx_site s where not exists (select 1 from fx_block b where s.chrom = b.chrom and s.pos0 between b.start_pos and b.end_pos)
""")
def sites_not_in_block(site, block):
    return cc.outside_blocks(site, block).select("site_id")


@query("concordance_status", "F1 F10 G1 J16", *_VIEWS, sql=f"with {_CONFIG} select site_id, chrom, b, status, case when status = 'pass' then cast(k as integer) end as config from st")
def concordance_status(site, block, label, gt):
    return _decided(site, block, label, gt).select("site_id", "chrom", "b", "status", "config")


@query("concordance_block_stats", "A3 A4 SK5", *_VIEWS, sql=f"""
with {_CONFIG}, n as (select chrom, b, start_pos, end_pos, count(*) filter (where status = 'pass') as passing, count(*) filter (where status = 'fail') as failing, count(*) filter (where status = 'nocall') as nocall
  from st where status <> 'low_qual' group by chrom, b, start_pos, end_pos)
select *, case when passing + failing > 0 then round(passing / (passing + failing), 3) else 0 end as rate from n
""")
def concordance_block_stats(site, block, label, gt):
    return cc.block_stats(_decided(site, block, label, gt))


@query("concordance_totals", "A4 SK4", *_VIEWS, sql=f"""
with {_CONFIG} select status, count(*) as n from st group by status
union all select 'not_in_block', count(*) from fx_site s where not exists (select 1 from fx_block b where s.chrom = b.chrom and s.pos0 between b.start_pos and b.end_pos)
""")
def concordance_totals(site, block, label, gt):
    return cc.totals(_decided(site, block, label, gt), cc.outside_blocks(site, block))


_VALUE = lambda h: f"case {h} when 'A' then pd[1 + k % 2] when 'B' then pd[2 - k % 2] when 'C' then pm[1 + k // 2] else pm[2 - k // 2] end"


# one aggregate by site and one by block: calls and labels as lists in the order of ids
@query("phased_genotypes", "G2", *_VIEWS, sql=f"""
with g as (select site_id, max(case when id = 'S04' then [g0, g1] end) as pd, max(case when id = 'S05' then [g0, g1] end) as pm, list([g0, g1] order by id) filter (where i >= 6) as kids,
  bool_or(g0 is null) as missing, bool_and(g0 = 0 and g1 = 0) as ref, bool_and(g0 <> g1) as het from fx_gt group by site_id),
l as (select chrom, b, start_pos, end_pos, list([h0, h1] order by id) as labels, list(id order by id) as ids from fx_label where i >= 6 group by chrom, b, start_pos, end_pos),
s as (select fx_site.site_id, pd, pm, kids, labels, ids from fx_site join g on g.site_id = fx_site.site_id join l on l.chrom = fx_site.chrom and l.b = fx_site.pos0 // 200000 and pos0 between start_pos and end_pos
  where qual >= 5 and not missing and not g.ref and not het),
c as (select *, unnest(range(4)) as k from s),
m as (select site_id, min(k) as k, any_value(pd) as pd, any_value(pm) as pm, any_value(labels) as labels, any_value(ids) as ids from c
  where len(list_filter(range(1, 9), lambda j: list_sort([{_VALUE("labels[j][1]")}, {_VALUE("labels[j][2]")}]) = list_sort(kids[j]))) = 8 group by site_id),
r as (select *, unnest(range(1, 9)) as j from m)
select site_id, ids[j] as id, cast({_VALUE("labels[j][1]")} as varchar) || '|' || cast({_VALUE("labels[j][2]")} as varchar) as gt from r
""")
def phased_genotypes(site, block, label, gt):
    return cc.phased(_decided(site, block, label, gt))


#: Mismatching samples of each of the four orientations; the founders' own labels count too.
_ORIENT = """
sb as (select s.*, b.b from fx_site s join fx_block b on s.chrom = b.chrom and s.pos0 between b.start_pos and b.end_pos),
pa as (select sb.*, d.g0 as d0, d.g1 as d1, m.g0 as m0, m.g1 as m1 from sb left join fx_gt d on d.site_id = sb.site_id and d.id = 'S04' left join fx_gt m on m.site_id = sb.site_id and m.id = 'S05'),
ex as (select pa.site_id, r.o, l.id, x.g0, x.g1,
  case l.h0 when 'A' then case when o % 2 = 0 then d0 else d1 end when 'B' then case when o % 2 = 0 then d1 else d0 end when 'C' then case when o < 2 then m0 else m1 end else case when o < 2 then m1 else m0 end end as e0,
  case l.h1 when 'A' then case when o % 2 = 0 then d0 else d1 end when 'B' then case when o % 2 = 0 then d1 else d0 end when 'C' then case when o < 2 then m0 else m1 end else case when o < 2 then m1 else m0 end end as e1
  from pa cross join (select unnest(range(4)) as o) r join fx_label l on l.chrom = pa.chrom and l.b = pa.b join fx_gt x on x.site_id = pa.site_id and x.id = l.id),
mm as (select *, list_sort(list_filter([g0, g1], lambda v: v is not null)) <> list_sort(list_filter([e0, e1], lambda v: v is not null)) as bad from ex),
cn as (select site_id, o, count(*) filter (where bad) as mismatches, min(id) filter (where bad) as wrong from mm group by site_id, o),
bo as (select * from (select *, row_number() over (partition by site_id order by mismatches, o) as n from cn) t where n = 1),
al as (select site_id, bool_or(g0 is null or dp < 8) as missing from fx_gt group by site_id),
ds as (select sb.site_id, sb.chrom, sb.b, bo.o, bo.mismatches, bo.wrong, case when sb.qual < 5 then 'low_qual' when al.site_id is null or al.missing then 'nocall' when bo.mismatches = 0 then 'pass' else 'fail' end as status
  from sb left join bo on bo.site_id = sb.site_id left join al on al.site_id = sb.site_id)
"""


def _oriented(site, block, label, gt):
    return phasing.best_orientation(cc.gather(site, block, label, gt, ["S04", "S05"], first_only=False), 2, _KEEP, 8)


@query("best_orientation", "J17 G4 G5 G6 J2", *_VIEWS, sql=f"with {_ORIENT} select site_id, chrom, b, cast(o as integer) as orientation, cast(mismatches as integer) as mismatches, status from ds")
def best_orientation(site, block, label, gt):
    return _oriented(site, block, label, gt).select("site_id", "chrom", "b", "best.orientation", "best.mismatches", "status")


@query("orientation_block_stats", "A3 SK5", *_VIEWS, sql=f"""
with {_ORIENT}, n as (select chrom, b, count(*) filter (where status = 'pass') as passing, count(*) filter (where status = 'fail') as failing, count(*) filter (where status = 'nocall') as nocall from ds where status <> 'low_qual' group by chrom, b),
o as (select chrom, b, string_agg(wrong || ':' || k, ';' order by wrong) as singletons from (select chrom, b, wrong, count(*) as k from ds where status = 'fail' and mismatches = 1 group by chrom, b, wrong) t group by chrom, b)
select n.*, case when passing + failing > 0 then round(passing / (passing + failing), 3) else 0 end as rate, coalesce(o.singletons, '') as singletons from n left join o on o.chrom = n.chrom and o.b = n.b
""")
def orientation_block_stats(site, block, label, gt):
    return phasing.orientation_stats(_oriented(site, block, label, gt))


@query("failed_singletons", "A25", *_VIEWS, sql=f"with {_ORIENT} select chrom, b, wrong as id, count(*) as n from ds where status = 'fail' and mismatches = 1 group by chrom, b, wrong")
def failed_singletons(site, block, label, gt):
    return phasing.failed_singletons(_oriented(site, block, label, gt))


@query("phased_by_map", "G7", *_VIEWS, sql=f"""
with {_ORIENT} select ds.site_id, ex.id, ex.e0 || '|' || ex.e1 as gt from ds join ex on ex.site_id = ds.site_id and ex.o = ds.o where ds.status = 'pass' and ex.id in ('S04', 'S06', 'S07')
union all select site_id, 'S99', './.' from ds where status = 'pass'
""")
def phased_by_map(site, block, label, gt):
    return phasing.phased_by_map(_oriented(site, block, label, gt), 2, ["S04", "S06", "S07", "S99"])


@query("alt_reorder", "G3", "fx_site", "fx_gt", sql="""
with a as (select site_id, alt as a1, substr('ACGT', cast(1 + site_id % 4 as integer), 1) as a2 from fx_site)
select g.site_id, g.id, least(a1, a2) || ',' || greatest(a1, a2) as alts, coalesce(cast(case when g.g0 = 0 or a1 <= a2 then g.g0 else g.g0 + 1 end as varchar), '.') || '/' || coalesce(cast(case when g.g1 = 0 or a1 <= a2 then g.g1 else g.g1 + 1 end as varchar), '.') as gt
from fx_gt g join a on a.site_id = g.site_id
""")
def alt_reorder(site, gt):
    alts = site.select("site_id", F.array("alt", F.substr(F.lit("ACGT"), (1 + F.col("site_id") % 4).cast("int"), F.lit(1))).alias("a")).withColumn("o", g.reorder_alternatives(F.col("a")))
    both = gt.join(alts, "site_id")
    return both.select("site_id", "id", F.array_join("o", ",").alias("alts"), g.format_gt(g.remap_alleles(F.array("g0", "g1"), F.col("a"), F.col("o"))).alias("gt"))


@query("site_filters", "F1 F2 F6 F16 F23", "fx_site", "fx_gt", sql="""
select s.site_id, length(s.alt || repeat('A', cast(s.site_id % 3 as integer))) <> length(s.ref) as indel, coalesce(bool_or(g.g0 > 0 or g.g1 > 0), false) as carries
from fx_site s left join fx_gt g on g.site_id = s.site_id and g.id in ('S06', 'S07') where s.qual >= 5 group by s.site_id, s.alt, s.ref
""")
def site_filters(site, gt):
    alts = F.array(F.concat("alt", F.repeat(F.lit("A"), (F.col("site_id") % 3).cast("int"))))
    calls = gt.where(F.col("id").isin("S06", "S07")).groupBy("site_id").agg(F.collect_list(F.array("g0", "g1")).alias("gts"))
    kept = site.where(g.quality_passes(F.col("qual"), 5)).join(calls, "site_id", "left")
    return kept.select("site_id", g.is_indel(F.col("ref"), alts).alias("indel"), g.has_alternative(F.col("gts")).alias("carries"))


@query("depth_resolution", "F3 F4", "fx_gt", sql="""
select site_id, case when site_id % 3 = 2 then null else cast(sum(case when site_id % 3 = 0 then dp else dp * 2 end) as bigint) end as depth,
  bool_or(g0 is null) or site_id % 3 = 2 or bool_or(case when site_id % 3 = 0 then dp else dp * 2 end < 10) as bad from fx_gt group by site_id
""")
def depth_resolution(gt):
    records = gt.groupBy("site_id").agg(F.collect_list(F.array("g0", "g1")).alias("gts"), F.collect_list(F.col("dp").cast("int")).alias("own"))
    kind = F.col("site_id") % 3
    twice = F.transform("own", lambda d: F.array(d, d))
    depths = g.record_depths(F.when(kind == 0, F.col("own")), F.when(kind == 1, twice), F.lit(None).cast("array<array<int>>"))
    each = records.withColumn("d", depths)
    return each.select("site_id", F.aggregate("d", F.lit(0).cast("long"), lambda s, x: s + x).alias("depth"), g.missing_or_shallow(F.col("gts"), F.col("d"), 10).alias("bad"))


@query("depth_stats", "A1 D18", "fx_depth", sql="select chrom, sample_id, round(avg(dp), 6) as mean, round(stddev_pop(dp), 6) as std from fx_depth group by chrom, sample_id")
def depth_stats(depth):
    return hapmap.depth_stats(depth).select("chrom", "sample_id", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("depth_band_filter", "F5", "fx_depth", sql="""
select d.chrom, d.site_id, bool_and(d.dp between m.mean - m.std and m.mean + m.std) as kept
from fx_depth d join (select chrom, sample_id, avg(dp) as mean, stddev_pop(dp) as std from fx_depth group by chrom, sample_id) m on m.chrom = d.chrom and m.sample_id = d.sample_id group by d.chrom, d.site_id
""")
def depth_band_filter(depth):
    # SQL's join leaves out rows without a chromosome or a sample
    return hapmap.depth_band(depth.dropna(subset=["chrom", "sample_id"]), hapmap.depth_stats(depth))
