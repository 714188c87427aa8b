"""Queries of the haplotype-map operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import hapmap as hm
from ..operators import mapbuilder
from ..operators.phases import flip_phases
from ..operators.storage import shared_folder
from ..operators.tracing import trace_sites
from ..sources import writers
from .registry import query

_LONG = """
lg as (select chrom, b, start_pos, end_pos, id, i, 0 as slot, h0 as label from fx_mark union all select chrom, b, start_pos, end_pos, id, i, 1, h1 from fx_mark)
"""


def _long(mark):
    return hm.to_long(mark, ["chrom", "b", "start_pos", "end_pos", "id", "i"])


@query("short_run_mask", "W3", "fx_mark", sql=f"""
with {_LONG}, k as (select *, row_number() over (partition by chrom, id, slot order by b) as r from lg where label is not null),
i as (select *, sum(n) over (partition by chrom, id, slot order by r rows unbounded preceding) as run from (select *, case when label is distinct from lag(label) over (partition by chrom, id, slot order by r) then 1 else 0 end as n from k) x),
m as (select *, row_number() over (partition by chrom, id, slot, run order by r) as bef, count(*) over (partition by chrom, id, slot, run) as len from i)
select chrom, b, id, slot, label, bef < 3 and len - bef + 1 < 3 as masked from m union all select chrom, b, id, slot, label, false from lg where label is null
""")
def short_run_mask(mark):
    return hm.short_run_mask(_long(mark), 3).select("chrom", "b", "id", "slot", "label", "masked")


@query("label_fill", "W5 W6", "fx_mark", sql=f"""
with {_LONG} select chrom, b, id, slot, case when count(*) over (partition by chrom, id, slot) >= 3 then coalesce(
  (select arg_max(x.label, x.b) from lg x where x.chrom = lg.chrom and x.id = lg.id and x.slot = lg.slot and x.b <= lg.b and x.label is not null),
  (select arg_min(x.label, x.b) from lg x where x.chrom = lg.chrom and x.id = lg.id and x.slot = lg.slot and x.b >= lg.b and x.label is not null)) else label end as filled from lg
""")
def label_fill(mark):
    return hm.fill_from_neighbours(_long(mark)).select("chrom", "b", "id", "slot", "filled")


@query("label_switches", "W4 SK3", "fx_mark", sql=f"""
with {_LONG}, s as (select *, lag(end_pos) over w as prev_end, lag(coalesce(label, '?')) over w as old, coalesce(label, '?') as new from lg window w as (partition by chrom, id, slot order by b))
select chrom, id, slot, prev_end, start_pos as next_start, old, new from s where old <> new
""")
def label_switches(mark):
    return hm.switches(_long(mark))


@query("block_consensus", "A23", "fx_block", "fx_mark", sql=f"""
with {_LONG}, n as (select k.chrom, k.b, m.id, m.slot, m.label, count(*) as n from (select chrom, b * 3 as b, min(start_pos) as start_pos, max(end_pos) + 400000 as end_pos from fx_block group by chrom, b) k
  join lg m on m.chrom = k.chrom and m.start_pos between k.start_pos and k.end_pos where m.label is not null group by k.chrom, k.b, m.id, m.slot, m.label)
select chrom, b, id, slot, label, n from (select *, row_number() over (partition by chrom, b, id, slot order by n desc, label) as r from n) t where r = 1
""")
def block_consensus(block, mark):
    wide = block.select("chrom", (F.col("b") * 3).alias("b"), "start_pos", (F.col("end_pos") + 400000).alias("end_pos"))
    markers = _long(mark).select("chrom", F.col("start_pos").alias("pos0"), "id", "slot", "label")
    return hm.consensus(wide, markers)


def _private(x: str, y: str, tells: str) -> str:
    """SQL: the lower allele of x that y lacks, if x can be told from y."""
    lacks = lambda a: f"{a} not in ({y}0, {y}1)"
    return f"case when {x}0 is null or {y}0 is null or not ({tells}) then null when {lacks(x + '0')} and {lacks(x + '1')} then least({x}0, {x}1) when {lacks(x + '0')} then {x}0 when {lacks(x + '1')} then {x}1 end"


@query("marker_trace", "S7 S8", "fx_gtx", sql=f"""
with p as (select site_id, max(chrom) = 'chrX' as x, max(case when id = 'S04' then g0 end) as d0, max(case when id = 'S04' then g1 end) as d1, max(case when id = 'S05' then g0 end) as m0, max(case when id = 'S05' then g1 end) as m1 from fx_gtx group by site_id),
u as (select *, {_private('d', 'm', 'x = (d0 = d1)')} as ud, {_private('m', 'd', 'm0 <> m1')} as um from p),
c as (select g.site_id, g.id, x, sex = 1 as son, coalesce(ud in (g.g0, g.g1), false) and not (x and sex = 1) as a, coalesce(um in (g.g0, g.g1), false) as c from fx_gtx g join u on u.site_id = g.site_id where g.i >= 6),
n as (select site_id, count(*) filter (where a) as na, count(*) filter (where not a) as nb, count(*) filter (where c) as nc, count(*) filter (where not c) as nd,
  min(id) filter (where a) as ia, min(id) filter (where not a) as ib, min(id) filter (where c) as ic, min(id) filter (where not c) as idd from c group by site_id)
select c.site_id, c.id, case when x and son then '.' when x then case when a then 'A' end when na = 0 then null when (nb > na or (nb = na and ib < ia)) = a then 'B' else 'A' end as h0,
  case when nc = 0 then null when (nd > nc or (nd = nc and idd < ic)) = c then 'D' else 'C' end as h1 from c join n on n.site_id = c.site_id
""")
def marker_trace(gtx):
    return trace_sites(gtx, _NUCLEAR, sex=_SEX)


_NUCLEAR = [("S04", None, None), ("S05", None, None)] + [(f"S{i:02d}", "S04", "S05") for i in range(6, 14)]
_SEX = {f"S{i:02d}": 1 + i % 2 for i in range(4, 14)}
#: Three generations: two couples' children marry S08 and S09.
_THREE = [("S04", None, None), ("S05", None, None), ("S06", "S04", "S05"), ("S07", "S04", "S05"), ("S08", None, None), ("S09", None, None), ("S10", "S06", "S08"), ("S11", "S06", "S08"), ("S12", "S09", "S07"), ("S13", "S09", "S07")]


def _three_sql() -> str:
    people, couples = [i for i, _, _ in _THREE], [("S04", "S05"), ("S06", "S08"), ("S09", "S07")]
    own = ", ".join(f"max(case when id = '{p}' then g{j} end) as {p}_{j}" for p in people for j in (0, 1))
    marks = ", ".join(f"{_private(a + '_', b + '_', f'{a}_0 <> {a}_1')} as u_{a}" for f, m in couples for a, b in ((f, m), (m, f)))
    has = lambda mark, who: f"coalesce({mark} in ({who}_0, {who}_1), false)"
    first = ", ".join(f"{has('u_S04', k)} as f_{k}, {has('u_S05', k)} as m_{k}" for k in ("S06", "S07"))
    # a parent of the second generation passes what it has, if its marker is the one that came last, its mother's before its father's
    second = ", ".join(f"case when f_{k} then 'A' when m_{k} then 'C' end as own_{k}, case when case when m_{k} then u_S05 when f_{k} then u_S04 end = u_{k} then u_{k} end as pass_{k}" for k in ("S06", "S07"))
    third = ", ".join([*(f"case when {has('pass_S06', k)} then own_S06 end as h0_{k}, {has('u_S08', k)} as m_{k}" for k in ("S10", "S11")), *(f"{has('u_S09', k)} as f_{k}, case when {has('pass_S07', k)} then own_S07 end as h1_{k}" for k in ("S12", "S13"))])
    # of two children with one traced the smaller id has the first letter
    fill = lambda x, a, b, letters: f"case when {x}_{a} or {x}_{b} then '{letters[0]}' end as {{0}}_{a}, case when {x}_{a} and {x}_{b} then '{letters[0]}' when {x}_{a} or {x}_{b} then '{letters[1]}' end as {{0}}_{b}"
    filled = ", ".join([fill("f", "S06", "S07", "AB").format("h0"), fill("m", "S06", "S07", "CD").format("h1"), fill("m", "S10", "S11", "EF").format("h1"), fill("f", "S12", "S13", "GH").format("h0"), "h0_S10", "h0_S11", "h1_S12", "h1_S13"])
    rows = " union all ".join(f"select site_id, '{k}' as id, h0_{k} as h0, h1_{k} as h1 from e" for k in ("S06", "S07", "S10", "S11", "S12", "S13"))
    return f"with p as (select site_id, {own} from fx_gt group by site_id), u as (select *, {marks} from p), a as (select *, {first} from u), b as (select *, {second} from a), c as (select *, {third} from b), e as (select site_id, {filled} from c) {rows}"


@query("marker_trace_generations", "S7 S8", "fx_gt", sql=_three_sql())
def marker_trace_generations(gt):
    return trace_sites(gt, _THREE)


_STRING = "string_agg(coalesce(h0, '?') || coalesce(h1, '?'), '' order by id)"
_MARKERS = f"mk as (select chrom, b, start_pos, end_pos, cast(1 as bigint) as n_markers, {_STRING} as labels from fx_mark where i between 6 and 13 group by chrom, b, start_pos, end_pos)"


def _markers(mark):
    """Labels of the children, 6 to 13, at each marker."""
    few = mark.where("i between 6 and 13")
    pair = F.struct("id", F.concat(F.coalesce("h0", F.lit("?")), F.coalesce("h1", F.lit("?"))).alias("x"))
    return few.groupBy("chrom", "start_pos", "end_pos").agg(F.lit(1).cast("long").alias("n_markers"), F.array_join(F.transform(F.sort_array(F.collect_list(pair)), lambda p: p["x"]), "").alias("labels"))


_BLOCKS = f"""
{_MARKERS}, r as (select *, row_number() over (partition by chrom order by start_pos) as k from mk),
w as (select chrom, k, start_pos, end_pos, n_markers, labels, cast(1 as bigint) as block from r where k = 1
  union all select r.chrom, r.k, case when ok then w.start_pos else r.start_pos end, r.end_pos, case when ok then w.n_markers + 1 else 1 end,
    case when ok then list_aggregate(list_transform(range(1, 17), lambda j: case when w.labels[j] = '?' then r.labels[j] else w.labels[j] end), 'string_agg', '') else r.labels end, case when ok then w.block else w.block + 1 end
  from w join r on r.chrom = w.chrom and r.k = w.k + 1,
  lateral (select len(list_filter(range(1, 17), lambda j: w.labels[j] <> r.labels[j] and w.labels[j] <> '?' and r.labels[j] <> '?')) = 0 as ok) o),
bl as (select chrom, start_pos, max(end_pos) as end_pos, max(n_markers) as n_markers, arg_max(labels, k) as labels from w group by chrom, block, start_pos)
"""


@query("block_collapse", "S1", "fx_mark", sql=f"with recursive {_BLOCKS} select * from bl")
def block_collapse(mark):
    return hm.collapse(_markers(mark))


_DIFFER = lambda a, b: f"len(list_filter(range(0, 8), lambda j: {a}[2 * j + 1:2 * j + 2] <> {b}[2 * j + 1:2 * j + 2]))"
_LETTERS = lambda x: f"list_distinct(list_filter(string_split({x}, ''), lambda l: l <> '?' and l <> ''))"


@query("phase_flips", "S2", "fx_mark", sql=f"""
with recursive {_BLOCKS}, n as (select *, row_number() over (partition by chrom order by start_pos, end_pos) as k, {_LETTERS("labels")} as own from bl),
f as (select chrom, k, labels, case when len(own) > 0 then labels end as last from n where k = 1
  union all select n.chrom, n.k, o.now, case when len(n.own) > 0 then o.now else f.last end
  from f join n on n.chrom = f.chrom and n.k = f.k + 1,
  lateral (select f.last is not null and len(n.own) > 0 and (list_has_all(n.own, {_LETTERS("f.last")}) or list_has_all({_LETTERS("f.last")}, n.own)) as turns, {_DIFFER("n.labels", "f.last")} as before, translate(n.labels, 'AB', 'BA') as t) c,
  lateral (select case when turns and {_DIFFER("c.t", "f.last")} < before then c.t else n.labels end as one) d,
  lateral (select translate(d.one, 'CD', 'DC') as t) e,
  lateral (select case when turns and {_DIFFER("e.t", "f.last")} < before then e.t else d.one end as now) o)
select n.chrom, n.start_pos, n.end_pos, n.n_markers, f.labels from n join f on f.chrom = n.chrom and f.k = n.k
""")
def phase_flips(mark):
    return flip_phases(hm.collapse(_markers(mark)), ["AB", "CD"], list(range(16)))


@query("map_builder", "SC4 F1 F2 F4 F5 S1 S2 S7 S8 W3 W4 W5 A1 A23 SK1 SK2 SK3", "fx_site", "fx_gtx")
def map_builder(site, gtx):
    """From a VCF file to the lines of a map, its markers and its recombinants, all read back from their files."""
    spark, at = site.sparkSession, f"{shared_folder(site.sparkSession)}/{uuid.uuid4().hex}"
    writers.write_lines(writers.vcf_lines(_records(site, gtx), sorted(_SEX)), f"{at}/vcf", writers.vcf_header(sorted(_SEX)))
    family = mapbuilder.Family(_NUCLEAR, _SEX)
    mapbuilder.write(mapbuilder.from_vcf(spark, f"{at}/vcf", family, run=3, min_qual=5.0), family, f"{at}/map")
    lines = [spark.read.text(f"{at}/map/{x}").where("value not like '#%'").select(F.lit(x).alias("file"), F.col("value").alias("line")) for x in ("iht", "markers", "recombinants")]
    return lines[0].unionByName(lines[1]).unionByName(lines[2])


def _records(site, gtx):
    """Records of the views: every 17th an insertion; depths that are usual but for those of under 6."""
    call = F.struct(F.col("id").alias("sample"), F.array("g0", "g1").alias("gt"), F.lit(False).alias("phased"), F.when(F.col("dp") < 6, 90).otherwise(30).alias("dp"), F.lit(None).cast("int").alias("gq"))
    calls = gtx.groupBy("site_id", "chrom").agg(F.collect_list(call).alias("calls"))
    alt = F.when(F.col("site_id") % 17 == 0, F.concat("alt", F.lit("A"))).otherwise(F.col("alt"))
    return site.drop("chrom").join(calls, "site_id").select(
        "chrom", "pos0", F.col("site_id").cast("string").alias("id"), "ref", F.array(alt).alias("alts"), F.col("qual").cast("double").alias("qual"), F.array(F.lit("PASS")).alias("filters"),
        F.create_map(F.lit("SITE"), F.col("site_id").cast("string")).alias("info"), "calls",
    )


@query("iht_unpivot", "2.13", "fx_label", sql="select chrom, b, id, 0 as slot, h0 as label from fx_label union all select chrom, b, id, 1, h1 from fx_label")
def iht_unpivot(label):
    return hm.to_long(label, ["chrom", "b", "id"])


_PEOPLE = [f"S{i:02d}" for i in range(4, 14)]
_PIVOT = ", ".join(f"""max(case when id = '{p}' then h0 || '{"/" if p in ("S04", "S05") else "|"}' || h1 end) as "{p}\"""" for p in _PEOPLE)


@query("iht_pivot", "2.13 SK1 SK13", "fx_label", sql=f"select chrom, b, {_PIVOT} from fx_label group by chrom, b")
def iht_pivot(label):
    text = hm.iht_text(F.col("h0"), F.col("h1"), F.col("id").isin("S04", "S05"))
    return label.groupBy("chrom", "b").pivot("id", _PEOPLE).agg(F.max(text))


@query("label_counts", "A2", "fx_mark", sql=f"with {_LONG} select id, count(label) as n_known from lg group by id")
def label_counts(mark):
    return hm.label_counts(_long(mark))


_COVER = """
cv as (select chrom, b, start_pos, end_pos, count(*) filter (where l = 'A') as n_a, count(*) filter (where l = 'B') as n_b, count(*) filter (where l = 'C') as n_c, count(*) filter (where l = 'D') as n_d
  from (select chrom, b, start_pos, end_pos, i, h0 as l from fx_mark union all select chrom, b, start_pos, end_pos, i, h1 from fx_mark) t where i >= 6 group by chrom, b, start_pos, end_pos),
cw as (select *, (n_a > 0)::int + (n_b > 0)::int + (n_c > 0)::int + (n_d > 0)::int as ncov, case when n_d = 0 then 'D' when n_c = 0 then 'C' when n_b = 0 then 'B' when n_a = 0 then 'A' end as paint from cv)
"""


@query("iht_stats", "A9", "fx_mark", sql=f"with {_COVER} select * from cw")
def iht_stats(mark):
    return hm.block_coverage(mark.where("i >= 6"))


@query("length_by_coverage", "A10", "fx_mark", sql=f"with {_COVER} select ncov, count(*) as n_blocks, cast(sum(end_pos - start_pos) as bigint) as bases from cw group by ncov")
def length_by_coverage(mark):
    return hm.length_by_coverage(hm.block_coverage(mark.where("i >= 6")))


@query("hap_length_sums", "A10 A22", "fx_label", sql="""
select id, l as label, cast(sum(end_pos - start_pos) as bigint) as bases from (select id, h0 as l, start_pos, end_pos from fx_label union all select id, h1, start_pos, end_pos from fx_label) t group by id, l
""")
def hap_length_sums(label):
    return hm.haplotype_lengths(label)


@query("label_merge", "G22", "fx_mark", sql="""
select chrom, b, id, case when h0 is null then l1 when l1 is null or h0 = l1 then h0 end as merged from (select *, lead(h0) over (partition by chrom, id order by b) as l1 from fx_mark) t
""")
def label_merge(mark):
    from pyspark.sql import Window

    nxt = mark.withColumn("l1", F.lead("h0").over(Window.partitionBy("chrom", "id").orderBy("b")))
    return nxt.select("chrom", "b", "id", hm.merge_labels(F.col("h0"), F.col("l1")).alias("merged"))
