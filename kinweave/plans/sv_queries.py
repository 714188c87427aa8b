"""Queries of the structural-variant operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import sv
from .registry import query

_CALLERS = ["HiFi_sawfish", "ONT_sniffles", "asm_pggb", "asm_pav"]


def _round(k: int, before: str) -> str:
    return f"""
m{k} as (select p.id as primary_id, c.id as support_id, {k} as round from iv c join {before} p on p.chrom = c.chrom and p.svtype = c.svtype and c.s < p.e and p.s < c.e where c.prio = {k}),
p{k} as (select * from {before} union all select * from iv where prio = {k} and id not in (select support_id from m{k}))"""


_MERGED = f"""
iv as (select id, prio, chrom, svtype, start_pos - 200 as s, end_pos + case when svtype = 'INS' then 1 else 0 end + 200 as e from fx_sv),
p0 as (select * from iv where prio = 0),{_round(1, 'p0')},{_round(2, 'p1')},{_round(3, 'p2')},
lk as (select * from m1 union all select * from m2 union all select * from m3),
mem as (select primary_id, support_id as member from lk union all select id, id from p3),
sup as (select m.primary_id, count(*) - 1 as n_support, count(distinct f.prio) as n_sources, count(distinct f.start_pos % 2) <= 1 as gt_consistent from mem m join fx_sv f on f.id = m.member group by m.primary_id)
"""


def _merged(calls):
    return sv.merge_callers(calls, 4)


def _with_gt(calls):
    return calls.withColumn("gt", (F.col("start_pos") % 2).cast("string"))


# all overlaps with an earlier caller once, by bins; then who is a primary is decided for one caller after the other
@query("sv_merge", "S6 D14", "fx_sv", sql="""
with iv as (select id, prio, chrom, svtype, start_pos - 200 as s, end_pos + case when svtype = 'INS' then 1 else 0 end + 200 as e from fx_sv),
bins as (select *, unnest(range(s // 2000, (e - 1) // 2000 + 1)) as bin from iv),
ov as (select p.id as p, p.prio as pk, c.id as c, c.prio as ck from bins p join bins c on p.chrom = c.chrom and p.svtype = c.svtype and p.bin = c.bin
  where p.prio < c.prio and c.s < p.e and p.s < c.e and p.bin = greatest(p.s // 2000, c.s // 2000)),
not1 as (select distinct c as id from ov where ck = 1),
not2 as (select distinct c as id from ov where ck = 2 and not (pk = 1 and p in (select id from not1))),
l1 as (select * from ov where not (pk = 1 and p in (select id from not1)) and not (pk = 2 and p in (select id from not2)))
select p as primary_id, c as support_id, cast(ck as integer) as round from l1
""")
def sv_merge(calls):
    return _merged(calls)[1]


@query("sv_primaries", "S6", "fx_sv", sql=f"with {_MERGED} select id, cast(prio as bigint) as prio from p3")
def sv_primaries(calls):
    return _merged(calls)[0].select("id", F.col("prio").cast("long").alias("prio"))


@query("sv_support_select", "A16", "fx_sv", sql=f"""
with {_MERGED} select primary_id, prio, support_id, diff from (select *, row_number() over (partition by primary_id, prio order by diff, support_id) as r
  from (select lk.primary_id, lk.support_id, cast(s.prio as bigint) as prio, abs(s.svlen - p.svlen) as diff from lk join fx_sv p on p.id = lk.primary_id join fx_sv s on s.id = lk.support_id) x) y where r = 1
""")
def sv_support_select(calls):
    return sv.closest_support(calls, _merged(calls)[1]).withColumn("prio", F.col("prio").cast("long"))


@query("sv_best_primary", "A17", "fx_sv", sql=f"""
with {_MERGED}, x as (select lk.support_id, list_sort(list({{'s': p.s, 'e': p.e, 'id': p.id, 'diff': abs(a.svlen - b.svlen), 'same_gt': a.start_pos % 2 = b.start_pos % 2}})) as xs
  from lk join fx_sv a on a.id = lk.support_id join fx_sv b on b.id = lk.primary_id join iv p on p.id = lk.primary_id group by lk.support_id having count(*) > 1)
select support_id, list_reduce(xs, lambda b, v: case when v.diff < b.diff or (v.diff <= 50 and v.same_gt) then v else b end).id as primary_id from x
""")
def sv_best_primary(calls):
    return sv.best_primaries(_with_gt(calls), 4)


@query("sv_gt_consistency", "A12", "fx_sv", sql=f"with {_MERGED} select * from sup")
def sv_gt_consistency(calls):
    return sv.support_table(_with_gt(calls), 4)


@query("sv_support_stats", "A13", "fx_sv", sql=f"with {_MERGED} select n_sources, gt_consistent, count(*) as n from sup group by n_sources, gt_consistent")
def sv_support_stats(calls):
    return sv.support_stats(sv.support_table(_with_gt(calls), 4))


@query("sv_size_stats", "A14", "fx_sv", sql="select svtype, count(*) as n, cast(sum(abs(svlen)) as bigint) as total_len from fx_sv group by rollup (svtype)")
def sv_size_stats(calls):
    return sv.size_stats(calls)


@query("sv_shared_exclusive", "J6 A15 F19", "fx_sv", sql="""
with a as (select *, start_pos - 200 as s, end_pos + case when svtype = 'INS' then 1 else 0 end + 200 as e from fx_sv where prio = 0),
b as (select *, start_pos as s, end_pos + case when svtype = 'INS' then 1 else 0 end as e from fx_sv where prio = 1),
h as (select distinct a.id from a join b on a.chrom = b.chrom and a.svtype = b.svtype and a.s < b.e and b.s < a.e where least(abs(a.svlen), abs(b.svlen)) / greatest(abs(a.svlen), abs(b.svlen)) >= 0.7),
n as (select svtype, count(*) filter (where id in (select id from h)) as shared, count(*) filter (where id not in (select id from h)) as exclusive from a group by svtype)
select *, round(100 * shared / (shared + exclusive), 4) as pct_shared from n
""")
def sv_shared_exclusive(calls):
    return sv.shared_exclusive(sv.matches(calls.where("prio = 0"), calls.where("prio = 1")))


@query("sv_prefilter", "F14 F15", "fx_sv", sql="select id from fx_sv where abs(svlen) between 50 and 300")
def sv_prefilter(calls):
    return sv.prefilter(calls, 50, 300).select("id")


@query("sv_normalise_id", "G19 W9", "fx_sv", sql="""
with n as (select id, case when prio = 0 then replace(replace(id, '.', ';'), ';', '_') else 'hifi_' || replace(replace(id, '.', ';'), ';', '_') end as clean, 'grp' || (start_pos % 500) as name from fx_sv),
d as (select *, row_number() over (partition by name order by id) - 1 as k from n)
select id, clean, case when k > 0 then name || '_' || k else name end as unique_id from d
""")
def sv_normalise_id(calls):
    clean = tx.normalise_id(F.replace("id", F.lit("."), F.lit(";")), F.lit("hifi"))
    named = calls.select("id", clean.alias("clean"), F.concat(F.lit("grp"), (F.col("start_pos") % 500).cast("string")).alias("name"))
    return sv.number_duplicates(named, "name", ["id"]).select("id", "clean", "unique_id")


@query("sv_source_of", "2.12", "fx_sv", sql="select id, nullif(regexp_extract(id, '^([^_.:]*[_:.][^_.:]+)', 1), '') as source from fx_sv")
def sv_source_of(calls):
    return calls.select("id", tx.source_of(F.col("id")).alias("source"))


@query("sv_infer", "G17", "fx_sv", sql="""
select id, case when svtype = 'INS' then svlen when svtype = 'DEL' then svlen else 0 end as svlen, case when svtype = 'INV' or svlen = 0 then 'OTHER' else svtype end as svtype from fx_sv
""")
def sv_infer(calls):
    ref = F.repeat(F.lit("A"), F.when(F.col("svtype") == "DEL", 1 - F.col("svlen")).otherwise(1).cast("int"))
    alt = F.repeat(F.lit("A"), F.when(F.col("svtype") == "INS", 1 + F.col("svlen")).otherwise(1).cast("int"))
    size, kind = sv.infer_type(ref, alt)
    return calls.select("id", size.cast("long").alias("svlen"), kind.alias("svtype"))


@query("sv_strip_info", "G18", "fx_sv", sql="""
select id, case when svlen <> 0 and prio <> 0 then 'SVTYPE' else 'SVLEN,SVTYPE' end as kept from (select id, svlen, prio from fx_sv) t
""")
def sv_strip_info(calls):
    info = F.create_map(F.lit("SVTYPE"), F.col("svtype"), F.lit("SVLEN"), F.when(F.col("prio") == 0, "0").otherwise(F.col("svlen").cast("string")), F.lit("AC"), F.lit("3"))
    return calls.select("id", F.array_join(F.array_sort(F.map_keys(sv.strip_info(info, ["AC"], ["SVLEN"]))), ",").alias("kept"))


@query("source_one_hot", "2.13", "fx_sv", sql="""
select chrom, svtype, start_pos, max((prio = 0)::int) as "HiFi_sawfish", max((prio = 1)::int) as "ONT_sniffles", max((prio = 2)::int) as asm_pggb, max((prio = 3)::int) as asm_pav from fx_sv group by chrom, svtype, start_pos
""")
def source_one_hot(calls):
    sites = calls.groupBy("chrom", "svtype", "start_pos").agg(F.collect_set(F.element_at(F.array(*[F.lit(c) for c in _CALLERS]), F.col("prio").cast("int") + 1)).alias("sources"))
    return sv.one_hot_sources(sites, _CALLERS).drop("sources")
