"""Queries of the tandem-repeat operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import repeats as rp
from .registry import query

_LABELS = ["A", "B", "C", "D"]


def _alleles(tr):
    return tr.select("trid", F.col("i").alias("id"), "slot", "seq", (F.col("purity_pct") / 100.0).alias("purity"))


_PASS = """
ok as (select trid, count(distinct seq) as n_alleles, cast(max(length(seq)) as integer) as longest from fx_tr group by trid
  having count(distinct i) = 10 and min(purity_pct) > 0 and avg(purity_pct / 100.0) >= 0.5 and count(distinct seq) > 1 and max(length(seq)) >= 10
  and trid not in (select trid from (select trid, seq from fx_tr group by trid, seq having count(*) = 1) q))
"""

#: Samples 6 to 13 have labels by arithmetic; each gives both alleles to both its haplotypes.
_SHARED = """
lb as (select trid, i, slot, seq, case when i % 2 = 0 then 'A' else 'B' end as h0, case when i % 3 = 0 then 'C' else 'D' end as h1 from fx_tr where i >= 6),
al as (select trid, h0 as label, seq from lb union all select trid, h1, seq from lb),
cn as (select trid, label, seq, count(*) as n from al group by trid, label, seq),
rk as (select *, row_number() over (partition by trid, label order by n desc, seq) as r from cn),
cd as (select trid, label, seq, n from (select *, min(n) filter (where r <= 2) over (partition by trid, label) as second from rk) x where n >= second)
"""


def _labelled(tr):
    return tr.where("i >= 6").withColumns({"h0": F.when(F.col("i") % 2 == 0, "A").otherwise("B"), "h1": F.when(F.col("i") % 3 == 0, "C").otherwise("D")})


def _candidates(tr):
    rows = _labelled(tr)
    return rp.candidates(rows.select("trid", F.explode(F.array("h0", "h1")).alias("label"), "seq"))


def _calls(tr):
    rows = _labelled(tr)
    pick = lambda k: F.max(F.when(F.col("slot") == k, F.col("seq")))
    return rows.groupBy("trid", F.col("i").alias("id"), "h0", "h1").agg(pick(0).alias("a0"), pick(1).alias("a1"))


@query("tr_filter", "F17 J14", "fx_tr", sql=f"with {_PASS} select * from ok")
def tr_filter(tr):
    return rp.passing(_alleles(tr))


@query("tr_candidates", "A18", "fx_tr", sql=f"with {_SHARED} select * from cd")
def tr_candidates(tr):
    return _candidates(tr)


@query("tr_best_assign", "A19 J18 G14 G15", "fx_tr", sql=f"""
with {_SHARED}, o as (select *, row_number() over (partition by trid, label order by n desc, seq) - 1 as p from cd),
ch as (select a.trid, ((a.p * 1000 + b.p) * 1000 + c.p) * 1000 + d.p as ord, a.seq as "A", b.seq as "B", c.seq as "C", d.seq as "D"
  from o a join o b on b.trid = a.trid and b.label = 'B' join o c on c.trid = a.trid and c.label = 'C' join o d on d.trid = a.trid and d.label = 'D' where a.label = 'A'),
ca as (select trid, i, h0, h1, max(case when slot = 0 then seq end) as a0, max(case when slot = 1 then seq end) as a1 from lb group by trid, i, h0, h1),
x as (select ch.*, ca.a0, ca.a1, case when h0 = 'A' then "A" else "B" end as e0, case when h1 = 'C' then "C" else "D" end as e1 from ch join ca on ca.trid = ch.trid),
y as (select *, case when length(a0) = length(e0) then levenshtein(a0, e0) else abs(length(a0) - length(e0)) end + case when length(a1) = length(e1) then levenshtein(a1, e1) else abs(length(a1) - length(e1)) end as st,
  case when length(a0) = length(e1) then levenshtein(a0, e1) else abs(length(a0) - length(e1)) end + case when length(a1) = length(e0) then levenshtein(a1, e0) else abs(length(a1) - length(e0)) end as cr from x),
z as (select trid, ord, "A", "B", "C", "D", sum(case when st <= cr then (a0 <> e0)::int + (a1 <> e1)::int else (a0 <> e1)::int + (a1 <> e0)::int end) as n_errors, sum(least(st, cr)) as sum_error from y group by all)
select trid, cast(n_errors as bigint) as n_errors, cast(sum_error as bigint) as sum_error, "A", "B", "C", "D" from (select *, row_number() over (partition by trid order by n_errors, sum_error, ord) as r from z) q where r = 1
""")
def tr_best_assign(tr):
    found = _candidates(tr)
    return rp.best_assignment(rp.assignments(found, _LABELS), found, _calls(tr), _LABELS)


@query("tr_summary", "A20 SK14", "fx_tr", sql="""
select trid, round_even(avg(length(seq)), 6) as mean_length, round_even(avg(purity_pct / 100.0), 6) as mean_purity, count(distinct seq) as n_alleles, count(*) as n from fx_tr group by trid
""")
def tr_summary(tr):
    return rp.summary(_alleles(tr), 6)


@query("tr_bins", "A20", "fx_tr", sql="""
select least(cast(round_even(length(seq) / 2, 0) as bigint) * 2, 16) as bin, count(*) as n from fx_tr group by 1
""")
def tr_bins(tr):
    return tr.groupBy(rp.length_bin(F.length("seq"), 2, 16).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("tr_deltas", "A21", "fx_tr", sql="""
with e as (select trid, slot, min(seq) as expected from fx_tr where i >= 8 group by trid, slot)
select t.i as id, cast(sum(greatest(length(seq) - length(expected), 0)) as bigint) as expansion, cast(sum(greatest(length(expected) - length(seq), 0)) as bigint) as contraction from fx_tr t join e on e.trid = t.trid and e.slot = t.slot group by t.i
""")
def tr_deltas(tr):
    # a window, not a join: alleles dealt by locus stay where they are
    line, counts = Window.partitionBy("trid", "slot"), F.col("i") >= 8
    expected = tr.withColumns({"expected": F.min(F.when(counts, F.col("seq"))).over(line), "_n": F.count_if(counts).over(line)})
    return rp.deltas(expected.where("_n > 0").select(F.col("i").alias("id"), "seq", "expected"))


@query("tr_locus_blocks", "J4", "fx_site", "fx_block", sql="""
select s.site_id, min(b.b) as b from fx_site s join fx_block b on b.chrom = s.chrom and b.start_pos <= s.pos0 and s.pos0 + 5000 <= b.end_pos group by s.site_id
""")
def tr_locus_blocks(site, block):
    loci = site.select("site_id", "chrom", F.col("pos0").alias("s"), (F.col("pos0") + 5000).alias("e"))
    return rp.locus_blocks(loci, block).select("site_id", "b")
