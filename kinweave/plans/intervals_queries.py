"""Queries of the interval operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as iv
from .registry import query

#: Islands of a set: the running maximum of the ends and a new island where a start lies beyond it.
_ISLANDS = """
select chrom, min(s) as s, max(e) as e, count(*) as n from (
  select chrom, s, e, sum(case when pe is null or s > pe then 1 else 0 end) over (partition by chrom order by s, e, k rows unbounded preceding) as island
  from (select *, max(e) over (partition by chrom order by s, e, k rows between unbounded preceding and 1 preceding) as pe
        from (select chrom, s, e, row_number() over (order by chrom, s, e) as k from {x}) t0) t1) t2
group by chrom, island
"""


def islands(x: str) -> str:
    return _ISLANDS.format(x=x)


@query("bed_merge", "I2", "fx_iv", sql=islands("fx_iv"))
def bed_merge(a):
    return iv.merge(a)


@query("bed_union_merge", "I8", "fx_iv", "fx_rg", sql=islands("(select * from fx_iv union all select * from fx_rg)"))
def bed_union_merge(a, b):
    return iv.union_merge([a, b])


@query("overlap_join_binned", "J5", "fx_iv", "fx_rg", sql="""
select a.chrom, a.s, a.e, b.s as b_s, b.e as b_e from fx_iv a join fx_rg b on a.chrom = b.chrom and a.s < b.e and b.s < a.e
""")
def overlap_join_binned(a, b):
    return iv.overlap_join(a, b)


@query("overlap_join_two_levels", "J5", "fx_iv", "fx_rg", sql="""
select a.chrom, a.s, a.e, b.s as b_s, b.e as b_e from fx_iv a join fx_rg b on a.chrom = b.chrom and a.s < b.e and b.s < a.e
""")
def overlap_join_two_levels(a, b):
    return iv.overlap_join(a, b, size=8, wide=6)


@query("bed_intersect", "I3", "fx_iv", "fx_rg", sql="""
select a.chrom, greatest(a.s, b.s) as s, least(a.e, b.e) as e from fx_iv a join fx_rg b on a.chrom = b.chrom and a.s < b.e and b.s < a.e
""")
def bed_intersect(a, b):
    return iv.intersect(a, b).select("chrom", "s", "e")


@query("bed_keep_overlapping", "I4 J7", "fx_iv", "fx_rg", sql="""
select chrom, s, e from fx_iv a where exists (select 1 from fx_rg b where a.chrom = b.chrom and a.s < b.e and b.s < a.e)
""")
def bed_keep_overlapping(a, b):
    return iv.keep_overlapping(a, b)


@query("bed_intersect_count", "I5 A24", "fx_iv", "fx_rg", sql="""
select b.chrom, b.s, b.e, count(a.s) as n from fx_rg b left join fx_iv a on a.chrom = b.chrom and a.s < b.e and b.s < a.e group by b.chrom, b.s, b.e
""")
def bed_intersect_count(a, b):
    return iv.count_overlaps(b, a)


@query("bed_zero_regions", "I13", "fx_iv", "fx_rg", sql="""
select distinct chrom, s, e from fx_rg b where not exists (select 1 from fx_iv a where a.chrom = b.chrom and a.s < b.e and b.s < a.e)
""")
def bed_zero_regions(a, b):
    return iv.uncovered(b, a)


@query("bed_subtract", "I6", "fx_iv", "fx_rg", sql=f"""
with m as ({islands("fx_rg")}),
a as (select *, row_number() over (order by chrom, s, e) as k from fx_iv),
j as (select a.*, case when m.s is not null then greatest(a.s, m.s) end as bs, case when m.s is not null then least(a.e, m.e) end as be
      from a left join m on a.chrom = m.chrom and a.s < m.e and m.s < a.e)
select chrom, ps as s, pe as e from (
  select chrom, coalesce(lag(be) over (partition by k order by bs), s) as ps, coalesce(bs, e) as pe from j
  union all select chrom, max(be) as ps, max(e) as pe from j where bs is not null group by chrom, k) x
where ps < pe
""")
def bed_subtract(a, b):
    return iv.subtract(a, b)


@query("bed_multiinter", "I7", "fx_iv", "fx_rg", sql=f"""
with x as (select chrom, s, e from ({islands("fx_iv")}) p union all select chrom, s, e from ({islands("fx_rg")}) q),
d as (select chrom, p, sum(d) as d from (select chrom, s as p, 1 as d from x union all select chrom, e, -1 from x) t group by chrom, p),
r as (select chrom, p as s, lead(p) over (partition by chrom order by p) as e, sum(d) over (partition by chrom order by p) as depth from d)
select chrom, s, e from r where depth = 2
""")
def bed_multiinter(a, b):
    return iv.multi_intersect([a, b])


@query("bed_windows", "I9", "fx_rg", sql="""
select chrom, s, e, ws, least(ws + 25, e) as we from (select chrom, s, e, unnest(range(s, e, 20)) as ws from fx_rg) t
""")
def bed_windows(b):
    return iv.windows(b, 25, 20)


@query("bed_coverage", "I10", "fx_iv", "fx_rg", sql=f"""
with m as ({islands("fx_iv")})
select b.chrom, b.s, b.e, cast(coalesce(sum(least(b.e, m.e) - greatest(b.s, m.s)) filter (where m.s is not null), 0) as bigint) as covered,
  round(coalesce(sum(least(b.e, m.e) - greatest(b.s, m.s)) filter (where m.s is not null), 0) / (b.e - b.s), 6) as fraction
from fx_rg b left join m on b.chrom = m.chrom and b.s < m.e and m.s < b.e group by b.chrom, b.s, b.e
""")
def bed_coverage(a, b):
    return iv.coverage(b, a).withColumn("fraction", F.round("fraction", 6))


@query("bed_smooth", "I10", "fx_rg", sql=f"""
with m as ({islands("fx_rg")}),
sp as (select chrom, min(s) as s, max(e) as e from m group by chrom),
t as (select chrom, ws as s, least(ws + 400, e) as e from (select chrom, e, unnest(range(s, e, 200)) as ws from sp) q),
c as (select t.chrom, t.s, t.e, coalesce(sum(least(t.e, m.e) - greatest(t.s, m.s)) filter (where m.s is not null), 0) / (t.e - t.s) as f
      from t left join m on t.chrom = m.chrom and t.s < m.e and m.s < t.e group by t.chrom, t.s, t.e),
thin as ({islands("(select chrom, s, e from c where f < 0.35)")}),
j as (select m.chrom, m.s, m.e, case when h.s is not null then greatest(m.s, h.s) end as bs, case when h.s is not null then least(m.e, h.e) end as be
      from m left join thin h on m.chrom = h.chrom and m.s < h.e and h.s < m.e)
select chrom, ps as s, pe as e from (
  select chrom, coalesce(lag(be) over (partition by chrom, s order by bs), s) as ps, coalesce(bs, e) as pe from j
  union all select chrom, max(be), max(e) from j where bs is not null group by chrom, s) x
where pe - ps > 10
""")
def bed_smooth(b):
    return iv.smooth(b, 400, 200, 0.35, 10)


@query("bed_slop", "I11 SC16 D17", "fx_rg", sql="""
select b.chrom, greatest(b.s - 10, 0) as s, least(b.e + 10, c.length) as e from fx_rg b join (select chrom, max(e) as length from fx_rg group by chrom) c on b.chrom = c.chrom
""")
def bed_slop(b):
    return iv.slop(b, b.groupBy("chrom").agg(F.max("e").alias("length")), 10)


@query("bed_around", "I12", "fx_iv", sql="select distinct chrom, greatest(s - 10, 0) as s, e + 10 as e from fx_iv")
def bed_around(a):
    return iv.around(a, 10)


@query("bed_region_text", "I14", "fx_rg", sql="select chrom || ':' || s || '-' || e as region from fx_rg")
def bed_region_text(b):
    return b.select(iv.region_text(F.col("chrom"), F.col("s"), F.col("e")).alias("region"))


@query("bed_self_overlaps", "I15", "fx_iv", sql="""
with d as (select chrom, s, e, count(*) as copies from fx_iv where s < e group by chrom, s, e)
select chrom, s, e, copies > 1 or exists (select 1 from d x where x.chrom = d.chrom and x.s < d.e and d.s < x.e and (x.s <> d.s or x.e <> d.e)) as overlaps from d
""")
def bed_self_overlaps(a):
    return iv.overlapping_rows(a)


@query("bed_summary", "I16", "fx_iv", sql="""
select chrom, count(*) as n, cast(sum(e - s) as bigint) as bases, min(e - s) as shortest, max(e - s) as longest from fx_iv group by chrom
""")
def bed_summary(a):
    return iv.summary(a)


@query("bed_sorted_ranks", "I1", "fx_rg", sql="select chrom, s, e, row_number() over (partition by chrom order by s, e) as n from fx_rg")
def bed_sorted_ranks(b):
    return iv.ranked(b)


@query("bed_concat_distinct", "I17", "fx_iv", sql="select distinct * from fx_iv")
def bed_concat_distinct(a):
    return iv.concat_distinct([a, a])


@query("bed_chunks", "I20", "fx_rg", sql="select chrom, s, e, cast(ntile(8) over (partition by chrom order by s) as integer) as chunk from fx_rg")
def bed_chunks(b):
    return iv.chunks(b, 8, ["chrom"], ["s"])
