"""Queries of the hidden-Markov inheritance operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hmm
from .registry import query

_OBSERVED = """
ob as (select s.chrom, s.pos0, cast(sum(case when g.g0 > 0 or g.g1 > 0 then 1 << (g.i - 6) else 0 end) as bigint) as observed
  from fx_site s join fx_gt g on g.site_id = s.site_id where g.i between 6 and 13 group by s.chrom, s.pos0)
"""


def _observed(site, gt):
    """The children, 6 to 13, that carry an alternative at each site."""
    bit = F.when((F.col("g0") > 0) | (F.col("g1") > 0), F.expr("shiftleft(1L, cast(i - 6 as int))")).otherwise(0)
    return site.join(gt.where("i between 6 and 13"), "site_id").groupBy("chrom", "pos0").agg(F.sum(bit).alias("observed"))


@query("informative_snps", "F13", "fx_site", "fx_gt", sql="""
select s.site_id, case when d.g0 is null or m.g0 is null then 'variant_no_call' when d.g0 = d.g1 then 'variant_autosome_not_het' when m.g0 > 0 or m.g1 > 0 then 'variant_called_other_parent'
  when s.site_id % 5 = 0 then 'variant_multialleleic' end as reason
from fx_site s left join fx_gt d on d.site_id = s.site_id and d.id = 'S04' left join fx_gt m on m.site_id = s.site_id and m.id = 'S05'
""")
def informative_snps(site, gt):
    own = lambda who, name: gt.where(F.col("id") == who).select("site_id", F.array("g0", "g1").alias(name))
    both = site.join(own("S04", "dad"), "site_id", "left").join(own("S05", "mom"), "site_id", "left")
    alts = F.when(F.col("site_id") % 5 == 0, F.array("alt", "alt")).otherwise(F.array("alt"))
    return both.select("site_id", hmm.informative_reason(F.lit("dad"), F.col("chrom"), F.col("ref"), alts, F.col("dad"), F.col("mom")).alias("reason"))


@query("grandparent_haplotype", "G12", "fx_gt", sql="""
with p as (select site_id, max(case when id = 'S06' then g0 end) as a0, max(case when id = 'S06' then g1 end) as a1, max(case when id = 'S07' then g0 end) as b0, max(case when id = 'S07' then g1 end) as b1 from fx_gt group by site_id)
select site_id, case when a0 is not null and b0 is not null and greatest(a0, a1) > 0 and greatest(b0, b1) > 0 then 'A/B' when a0 is not null and b0 is not null and greatest(a0, a1) > 0 then 'A' when a0 is not null and b0 is not null and greatest(b0, b1) > 0 then 'B'
  when a0 is not null and b0 is null and greatest(a0, a1) = 0 then 'B_inferred' when b0 is not null and a0 is null and greatest(b0, b1) = 0 then 'A_inferred' when a0 is null and b0 is null then 'hap1' else 'unknown' end as haplotype from p
""")
def grandparent_haplotype(gt):
    pick = lambda who: F.max(F.when(F.col("id") == who, F.array("g0", "g1")))
    both = gt.groupBy("site_id").agg(pick("S06").alias("gf"), pick("S07").alias("gm"))
    return both.select("site_id", hmm.grandparent_haplotype(F.lit("dad"), F.col("gf"), F.col("gm")).alias("haplotype"))


@query("hmm_viterbi", "S5", "fx_site", "fx_gt")
def hmm_viterbi(site, gt):
    return hmm.viterbi_paths(hmm.cut_windows(_observed(site, gt), hmm.most_sites(8)), 8, ["chrom"])


_RUNS = f"""
{_OBSERVED}, rn as (select *, sum(n) over (partition by chrom order by pos0 rows unbounded preceding) as run from (select *, case when observed is distinct from lag(observed) over (partition by chrom order by pos0) then 1 else 0 end as n from ob) x)
"""


@query("state_runs", "W1", "fx_site", "fx_gt", sql=f"with {_RUNS} select chrom, pos0, observed, cast(run as bigint) as run from rn")
def state_runs(site, gt):
    return hmm.runs(_observed(site, gt), ["chrom"], "pos0", "observed")


@query("state_blocks", "W2 SK13", "fx_site", "fx_gt", sql=f"""
with {_RUNS}, kp as (select * from (select *, count(*) over (partition by chrom, run) as c from rn) x where c > 1),
r2 as (select *, sum(m) over (partition by chrom order by pos0 rows unbounded preceding) as run2 from (select *, case when observed is distinct from lag(observed) over (partition by chrom order by pos0) then 1 else 0 end as m from kp) y),
b as (select chrom, cast(run2 as bigint) as run, min(pos0) as start_pos, max(pos0) as last_pos, min(observed) as state, count(*) as n from r2 group by chrom, run2)
select *, coalesce(lead(start_pos) over (partition by chrom order by run), last_pos) as end_pos from b
""")
def state_blocks(site, gt):
    return hmm.state_blocks(_observed(site, gt), ["chrom"], value="observed")


@query("state_labels", "G20 G21", "fx_site", "fx_gt", sql=f"""
with {_OBSERVED} select chrom, pos0, case when pos0 % 2 = 0 then observed else 255 - observed end as state, case when ((case when pos0 % 2 = 0 then observed else 255 - observed end) >> 1) % 2 = 1 then 'A' else 'B' end as label from ob
""")
def state_labels(site, gt):
    turned = _observed(site, gt).withColumn("state", hmm.complement(F.col("observed"), F.when(F.col("pos0") % 2 == 0, "A").otherwise("B"), 8))
    return turned.select("chrom", "pos0", "state", hmm.state_labels(F.col("state"), 1, F.lit("dad")).alias("label"))


@query("child_summary", "A22", "fx_label", sql="""
with s as (select *, lag(h0) over w as p0, lag(h1) over w as p1, lag(end_pos) over w as pe from fx_label where i >= 6 window w as (partition by chrom, id order by start_pos))
select id, count(*) as n_blocks, count(*) filter (where p0 <> h0) as paternal_switches, count(*) filter (where p1 <> h1) as maternal_switches, cast(coalesce(sum(greatest(start_pos - pe - 1, 0)) filter (where pe is not null), 0) as bigint) as gap_bases,
  cast(sum(case when h0 = 'A' then end_pos - start_pos + 1 else 0 end) as bigint) as bases_a, cast(sum(case when h0 = 'B' then end_pos - start_pos + 1 else 0 end) as bigint) as bases_b,
  cast(sum(case when h1 = 'C' then end_pos - start_pos + 1 else 0 end) as bigint) as bases_c, cast(sum(case when h1 = 'D' then end_pos - start_pos + 1 else 0 end) as bigint) as bases_d from s group by id
""")
def child_summary(label):
    return hmm.child_summary(label.where("i >= 6"))


@query("gap_analysis", "W7 A22", "fx_label", sql="""
with s as (select *, lag(h0) over w as p0, lag(h1) over w as p1, lag(end_pos) over w as gap_start from fx_label where i >= 6 window w as (partition by chrom, id order by start_pos))
select chrom, id, gap_start, start_pos as gap_end, case when p0 <> h0 and p1 <> h1 then 'both' when p0 <> h0 then 'dad' else 'mom' end as parent, case when p0 <> h0 then h0 else '' end || case when p1 <> h1 then h1 else '' end as letters
from s where gap_start is not null and (p0 <> h0 or p1 <> h1)
""")
def gap_analysis(label):
    return hmm.gaps(label.where("i >= 6"))


@query("overlap_fix", "W8", "fx_block", sql="""
with x as (select chrom, b, start_pos, end_pos + 150000 as e, lead(start_pos) over (partition by chrom order by start_pos) as nx from fx_block)
select chrom, b, start_pos, case when e > nx then case when start_pos + 190000 <= nx then start_pos + 190000 else start_pos end else e end as end_pos from x
""")
def overlap_fix(block):
    long = block.withColumns({"end_pos": F.col("end_pos") + 150000, "support": F.array(F.col("start_pos"), F.col("start_pos") + 190000, F.col("start_pos") + 340000)})
    return hmm.fix_overlaps(long, ["chrom"]).select("chrom", "b", "start_pos", "end_pos")


@query("combined_fill", "W6", "fx_label", sql="""
with l as (select chrom, id, start_pos, case when b % 2 = 0 then h0 end as dad, case when b % 2 = 1 then h1 end as mom from fx_label where i >= 6)
select chrom, id, start_pos, coalesce((select arg_max(x.dad, x.start_pos) from l x where x.chrom = l.chrom and x.id = l.id and x.start_pos <= l.start_pos and x.dad is not null), (select arg_min(x.dad, x.start_pos) from l x where x.chrom = l.chrom and x.id = l.id and x.start_pos >= l.start_pos and x.dad is not null)) as dad,
  coalesce((select arg_max(x.mom, x.start_pos) from l x where x.chrom = l.chrom and x.id = l.id and x.start_pos <= l.start_pos and x.mom is not null), (select arg_min(x.mom, x.start_pos) from l x where x.chrom = l.chrom and x.id = l.id and x.start_pos >= l.start_pos and x.mom is not null)) as mom from l
""")
def combined_fill(label):
    from ..operators import hapmap

    pair = F.array(F.when(F.col("b") % 2 == 0, F.col("h0")), F.when(F.col("b") % 2 == 1, F.col("h1")))
    rows = label.where("i >= 6").select("chrom", F.col("start_pos").alias("b"), "id", F.posexplode(pair).alias("slot", "label"))
    filled = hapmap.fill_from_neighbours(rows, 1)
    return filled.groupBy("chrom", "id", F.col("b").alias("start_pos")).agg(F.max(F.when(F.col("slot") == 0, F.col("filled"))).alias("dad"), F.max(F.when(F.col("slot") == 1, F.col("filled"))).alias("mom"))
