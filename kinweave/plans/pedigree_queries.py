"""Queries of the pedigree, trio and genotype operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import genotype as g
from ..functions import text as tx
from ..operators import denovo, pedigree
from .registry import query

_WALK = """
recursive pairs as (select id as child, father as parent from fx_ped where father is not null union select id, mother from fx_ped where mother is not null),
walk(id, depth) as (select id, 0 from fx_ped where father is null and mother is null
  union all select p.child, w.depth + 1 from walk w join pairs p on p.parent = w.id),
depths as (select id, max(depth) as depth from walk group by id)
"""


@query("ped_depth", "S10", "fx_ped", sql=f"with {_WALK} select id, depth from depths")
def ped_depth(ped):
    return pedigree.depths(ped)


@query("ped_founders", "S10", "fx_ped", sql="""
select id from fx_ped p where father is null and mother is null and exists (select 1 from fx_ped c where c.father = p.id or c.mother = p.id)
""")
def ped_founders(ped):
    return pedigree.founders(ped)


@query("ped_offspring", "S10", "fx_ped", sql=f"""
with {_WALK} select d.id, d.depth from depths d join fx_ped p on p.id = d.id where p.father is not null or p.mother is not null
""")
def ped_offspring(ped):
    return pedigree.offspring(ped)


@query("ped_children", "J9", "fx_ped", sql="""
select father as id, id as child from fx_ped where father is not null union select mother, id from fx_ped where mother is not null
""")
def ped_children(ped):
    return pedigree.children(ped)


@query("ped_spouse", "J9", "fx_ped", sql=f"""
with {_WALK}, b as (select p.id, p.father, p.mother, d.depth from fx_ped p join depths d on d.id = p.id where father is not null and mother is not null)
select a as id, arg_min(s, depth * 1000 + n) as spouse from (
  select *, row_number() over (order by id) as n from (
    select father as a, mother as s, depth, id from b union all select mother, father, depth, id from b) x) y group by a
""")
def ped_spouse(ped):
    return pedigree.spouses(ped)


@query("ped_trios", "J8", "fx_ped", sql="select id as child, father, mother from fx_ped where father is not null and mother is not null")
def ped_trios(ped):
    return pedigree.trios(ped)


@query("ped_multichild_founders", "S2 J9", "fx_ped", sql="""
select p.id, count(*) as n_children from fx_ped p join fx_ped c on c.father = p.id or c.mother = p.id
where p.father is null and p.mother is null group by p.id having count(*) > 1
""")
def ped_multichild_founders(ped):
    return pedigree.founders_with_several_children(ped)


@query("ped_reachable", "S9", "fx_ped", sql="""
with recursive walk(id) as (select id from fx_ped where id = 'S04' and father is not null and mother is not null
  union select c.id from walk w join fx_ped c on (c.father = w.id or c.mother = w.id) and c.father is not null and c.mother is not null)
select id from walk
""")
def ped_reachable(ped):
    return pedigree.reachable(ped, ["S04", "S01"])


@query("ped_sample_check", "SC9", "fx_ped", "fx_gt", sql="""
select id, 'samples' as missing_in from fx_ped where id not in (select id from fx_gt)
union all select distinct id, 'pedigree' from fx_gt where id not in (select id from fx_ped)
""")
def ped_sample_check(ped, gt):
    return pedigree.check_samples(ped, gt.select("id").distinct())


_TRIO = """
t0 as (select c.site_id, c.id as child, c.g0, c.g1, case
    when c.g0 is null or f.g0 is null or m.g0 is null or c.dp < 5 or f.dp < 5 or m.dp < 5 or c.gq < 10 or f.gq < 10 or m.gq < 10 then 'Unknown'
    when (c.g0 in (m.g0, m.g1) and c.g1 in (f.g0, f.g1)) or (c.g1 in (m.g0, m.g1) and c.g0 in (f.g0, f.g1)) then 'Valid'
    when m.g0 = 0 and m.g1 = 0 and f.g0 = 0 and f.g1 = 0 and c.g0 <> c.g1 then 'CanDenovo' else 'Violation' end as kind
  from fx_gen c join fx_ped p on p.id = c.id join fx_gen f on f.site_id = c.site_id and f.id = p.father join fx_gen m on m.site_id = c.site_id and m.id = p.mother),
t as (select site_id, child, case when kind = 'CanDenovo' and exists (select 1 from fx_gen k join fx_ped q on q.id = k.id where k.site_id = t0.site_id and t0.child in (q.father, q.mother) and t0.g0 in (k.g0, k.g1))
    and exists (select 1 from fx_gen k join fx_ped q on q.id = k.id where k.site_id = t0.site_id and t0.child in (q.father, q.mother) and t0.g1 in (k.g0, k.g1)) then 'IhtDenovo' else kind end as kind from t0),
n as (select site_id, count(*) filter (where kind = 'Valid') as n_valid, count(*) filter (where kind = 'Violation') as n_violation,
    count(*) filter (where kind = 'Unknown') as n_unknown, count(*) filter (where kind = 'CanDenovo') as n_denovo, count(*) filter (where kind = 'IhtDenovo') as n_iht_denovo, count(*) as n_total
  from t group by site_id)
"""


_PARENTS = ", ".join(f"max(case when id = '{who}' then {c} end) as {x}_{c}" for who, x in (("S04", "f"), ("S05", "m")) for c in ("g0", "g1", "dp", "gq"))


# one aggregate by site: the parents' calls as columns, the children's as a list
@query("trio_class", "G8 F11 J8", "fx_gt", "fx_ped", sql=f"""
with s as (select site_id, {_PARENTS}, list(struct_pack(id := id, g0 := g0, g1 := g1, dp := dp, gq := gq)) filter (where i >= 6) as kids from fx_gt group by site_id),
k as (select * exclude (kids), unnest(kids) as c from s)
select site_id, c.id as child, case when c.g0 is null or f_g0 is null or m_g0 is null or least(c.dp, f_dp, m_dp) < 5 or least(c.gq, f_gq, m_gq) < 10 then 'Unknown'
  when (c.g0 in (m_g0, m_g1) and c.g1 in (f_g0, f_g1)) or (c.g1 in (m_g0, m_g1) and c.g0 in (f_g0, f_g1)) then 'Valid'
  when m_g0 + m_g1 + f_g0 + f_g1 = 0 and c.g0 <> c.g1 then 'CanDenovo' else 'Violation' end as kind
from k
""")
def trio_class(gt, ped):
    return denovo.classify(gt.where("i >= 4"), ped).where("child >= 'S06'").select("site_id", "child", "kind")


@query("transmission_counts", "A5 G9", "fx_gen", "fx_ped", sql=f"with {_TRIO} select * from n")
def transmission_counts(gt, ped):
    return denovo.transmission_counts(denovo.classify(gt, ped, grandchildren=True).where("child >= 'S06'"))


@query("avg_gq", "A6", "fx_gt", "fx_ped", sql="""
select site_id, round(sum(case when g0 is not null and dp >= 5 and gq >= 10 then gq else 0 end) / (select count(*) from fx_ped), 6) as avg_gq from fx_gt group by site_id
""")
def avg_gq(gt, ped):
    return denovo.average_quality(gt, ped).withColumn("avg_gq", F.round("avg_gq", 6))


@query("denovo_candidates", "G9 G10 F12 SK6", "fx_gen", "fx_ped", sql=f"""
with {_TRIO} select n.site_id, c.child, n.n_denovo, n.n_iht_denovo, n.n_unknown, n.n_valid
from n join (select site_id, min(child) as child from t where kind in ('CanDenovo', 'IhtDenovo') group by site_id) c on c.site_id = n.site_id where n.n_violation = 0 and n.n_unknown < 3
""")
def denovo_candidates(gt, ped):
    return denovo.candidates(denovo.classify(gt, ped, grandchildren=True).where("child >= 'S06'"), 3)


@query("unphase", "F7 F8 F9", "fx_gt", sql="""
select site_id, id, coalesce(cast(g0 as varchar), '.') || '/' || coalesce(cast(g1 as varchar), '.') as first,
  coalesce(cast(g0 as varchar), '.') || '/' || coalesce(cast(g1 as varchar), '.') as txt,
  case when g0 is null then coalesce(cast(g1 as varchar), '.') || '/.' else g0 || '/' || coalesce(cast(g1 as varchar), '.') end as last
from (select site_id, id, g0, g1 from fx_gt) t
""")
def unphase(gt):
    pair = F.array("g1", "g0")
    return gt.select(
        "site_id", "id", g.format_gt(g.unphase(pair)).alias("first"), g.unphase_text(g.format_gt(pair, "|")).alias("txt"), g.format_gt(g.unphase_missing_last(pair)).alias("last")
    )


@query("natural_sort", "2.10", "supplier", sql="""
select s_suppkey, lower(regexp_extract(s_name, '[^0-9]+')) || lpad(regexp_extract(s_name, '[0-9]+'), 20, '0') as sort_key from supplier
""")
def natural_sort(supplier):
    return supplier.select("s_suppkey", tx.natural_key(F.col("s_name")).alias("sort_key"))


@query("reverse_complement", "2.12", "fx_tr", sql="""
select trid, i, slot, reverse(translate(regexp_replace(seq, '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA')) as rc from fx_tr
""")
def reverse_complement(tr):
    return tr.select("trid", "i", "slot", tx.reverse_complement(F.col("seq")).alias("rc"))
