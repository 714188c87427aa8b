"""Views that give the synthetic tables the shapes of pedigree data.

Each view is one SELECT that Spark and DuckDB both accept; names in braces are
tables or other views.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

VIEWS: dict[str, str] = {
    # 21 people, 4 generations: 0x1->4, 2x3->5, 4x5->6..13, 6x14->15..20
    "fx_ped": """
select n_nationkey as i, concat('S', lpad(cast(n_nationkey as string), 2, '0')) as id,
  case when n_nationkey = 4 then 'S00' when n_nationkey = 5 then 'S02' when n_nationkey between 6 and 13 then 'S04' when n_nationkey between 15 and 20 then 'S06' end as father,
  case when n_nationkey = 4 then 'S01' when n_nationkey = 5 then 'S03' when n_nationkey between 6 and 13 then 'S05' when n_nationkey between 15 and 20 then 'S14' end as mother,
  case when n_nationkey = 14 then 2 else 1 + n_nationkey % 2 end as sex
from {nation} where n_nationkey <= 20
""",
    # biallelic SNV sites
    "fx_site": """
select o_orderkey as site_id, concat('chr', cast(1 + o_orderkey % 5 as string)) as chrom,
  o_orderkey * 1000 + o_custkey % 997 as pos0, cast(floor(o_totalprice / 10000) as bigint) as qual,
  substr('ACGT', cast(1 + o_custkey % 4 as int), 1) as ref, substr('ACGT', cast(1 + (o_custkey + 1 + o_orderkey % 3) % 4 as int), 1) as alt
from {orders}
""",
    # closed 200 kb inheritance blocks; every 11th block is missing (exercises not_in_block)
    "fx_block": """
select distinct chrom, cast(floor(pos0 / 200000) as bigint) as b, cast(floor(pos0 / 200000) as bigint) * 200000 as start_pos,
  cast(floor(pos0 / 200000) as bigint) * 200000 + 199999 as end_pos
from {fx_site} where cast(floor(pos0 / 200000) as bigint) % 11 <> 10
""",
    # per block and child haplotype labels (long form of inheritance CSV v1)
    "fx_label": """
select chrom, b, start_pos, end_pos, id, i,
  case when i = 4 then 'A' when i = 5 then 'C' when (b * b + i * 3 + b * i) % 3 % 2 = 0 then 'A' else 'B' end as h0,
  case when i = 4 then 'B' when i = 5 then 'D' when (b * 2 + i * i + b * i * 5) % 5 % 2 = 0 then 'C' else 'D' end as h1
from {fx_block} cross join {fx_ped} where i between 4 and 13
""",
    # diploid genotypes of parents S04,S05 and 8 children; haplotype alleles are arithmetic, with sparse errors and no-calls
    "fx_gt": """
select site_id, id, i, case when nc = 0 then null else least(e0, a1) end as g0, case when nc = 0 then null else greatest(e0, a1) end as g1, dp, gq
from (select site_id, id, i, case when (site_id * 13 + i * 5) % 197 = 0 then 1 - a0 else a0 end as e0, a1,
    (site_id * 11 + i * 7) % 389 as nc, 5 + (site_id * 3 + i * 11) % 40 as dp, (site_id * 7 + i * 13) % 60 as gq
  from (select s.site_id, l.id, l.i,
      case when (s.site_id * 31 + (case l.h0 when 'A' then 1 when 'B' then 2 when 'C' then 3 else 4 end) * 17) % 7 < 3 then 1 else 0 end as a0,
      case when (s.site_id * 31 + (case l.h1 when 'A' then 1 when 'B' then 2 when 'C' then 3 else 4 end) * 17) % 7 < 3 then 1 else 0 end as a1
    from {fx_site} s join {fx_label} l on s.chrom = l.chrom and cast(floor(s.pos0 / 200000) as bigint) = l.b and s.pos0 between l.start_pos and l.end_pos) x) y
""",
    # with the children of S06 and S14: one allele of S06's and one of their own
    "fx_gen": """
select site_id, id, i, g0, g1, dp, gq from {fx_gt}
union all select g.site_id, p.id, p.i, case when (g.site_id + p.i) % 2 = 0 then g.g0 else g.g1 end, (g.site_id * 7 + p.i) % 2, 20 + p.i, 40 from {fx_gt} g join {fx_ped} p on p.father = 'S06' where g.id = 'S06'
union all select site_id, 'S14', 14, 0, 1, 30, 40 from {fx_gt} where id = 'S06'
""",
    # the same with chromosomes, one of them X
    "fx_gtx": """
select g.site_id, case when s.chrom = 'chr5' then 'chrX' else s.chrom end as chrom, s.pos0, g.id, g.i, g.g0, g.g1, g.dp, p.sex from {fx_gt} g join {fx_site} s on s.site_id = g.site_id join {fx_ped} p on p.id = g.id
""",
    # half-open intervals (BED), many overlaps
    "fx_iv": """
select l_returnflag as chrom, l_orderkey * 100 + l_linenumber as s, l_orderkey * 100 + l_linenumber + cast(l_quantity as bigint) as e
from {lineitem}
""",
    # second interval set, same chrom names
    "fx_rg": """
select case o_orderstatus when 'O' then 'N' when 'F' then 'A' else 'R' end as chrom, o_orderkey * 100 as s, o_orderkey * 100 + 60 as e
from {orders}
""",
    # structural variants from four callers, priority 0..3
    "fx_sv": """
select concat(case l_linenumber % 4 when 0 then 'HiFi_sawfish' when 1 then 'ONT_sniffles' when 2 then 'asm_pggb' else 'asm_pav' end, '_',
    cast(l_orderkey as string), '.', cast(l_linenumber as string), '.', cast(l_partkey as string), '.', cast(l_suppkey as string), '.', cast(cast(l_quantity as bigint) as string)) as id,
  l_linenumber % 4 as prio, concat('chr', cast(1 + l_suppkey % 5 as string)) as chrom,
  case l_returnflag when 'A' then 'INS' when 'N' then 'DEL' else 'INV' end as svtype,
  l_partkey * 2500 + l_orderkey % 400 as start_pos,
  l_partkey * 2500 + l_orderkey % 400 + case when l_returnflag = 'A' then 1 else cast(l_quantity as bigint) * 10 end as end_pos,
  case when l_returnflag = 'N' then -1 else 1 end * cast(l_quantity as bigint) * 10 as svlen
from {lineitem}
""",
    # sequencing depth observations per (chrom, sample)
    "fx_depth": """
select event_type as chrom, user_id as sample_id, event_id as site_id, cast(floor(value) as bigint) as dp from {events}
""",
    # tandem-repeat alleles, 10 samples x 2 alleles per locus
    "fx_tr": """
select p.p_partkey as trid, n.n_nationkey as i, a.slot, repeat(substr('ACGTAC', cast(1 + p.p_partkey % 4 as int), cast(1 + p.p_size % 3 as int)),
    cast(3 + (p.p_partkey + ((n.n_nationkey * 7 + a.slot * 3 + p.p_partkey) % 4) * 2) % 9 as int)) as seq,
  (p.p_partkey * 3 + n.n_nationkey) % 100 as purity_pct
from {part} p cross join (select n_nationkey from {nation} where n_nationkey between 4 and 13) n cross join (select 0 as slot union all select 1 as slot) a
""",
    # labels with unknown ones: every fourth first label is missing
    "fx_mark": """
select chrom, b, start_pos, end_pos, id, i, case when (b + i) % 4 = 0 then null else h0 end as h0, h1 from {fx_label}
""",
}

_NAME = re.compile(r"\{(\w+)\}")

#: Tables whose rows a view multiplies, with their key: a few megabytes would make one task's rows.
MULTIPLIED = {"part": "p_partkey"}


def dealt(table: DataFrame, key: str, rows: int = 5_000) -> DataFrame:
    """``table`` dealt out by ``key`` to tasks of about ``rows`` rows, however few bytes these are."""
    return table.repartition(max(1, -(-table.count() // rows)), key)


def view(spark: SparkSession, sf_dir: str, name: str, cache: dict[str, DataFrame] | None = None) -> DataFrame:
    """A view, or a table, as a DataFrame."""
    made = {} if cache is None else cache
    if name not in made:
        if name in VIEWS:
            needs = dict.fromkeys(_NAME.findall(VIEWS[name]))
            held = {n: view(spark, sf_dir, n, made) for n in needs}
            made[name] = spark.sql(VIEWS[name], **{n: dealt(x, MULTIPLIED[n]) if n in MULTIPLIED else x for n, x in held.items()})
        else:
            made[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return made[name]


def views(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    made: dict[str, DataFrame] = {}
    return [view(spark, sf_dir, n, made) for n in names]


def with_views(sql: str) -> str:
    """``sql`` for DuckDB with the views that it names in front."""
    order: list[str] = []

    def add(text: str) -> None:
        for n in re.findall(r"\bfx_\w+", text):
            if n in VIEWS and n not in order:
                add(VIEWS[n])
                order.append(n)

    add(sql)
    heads = ",\n".join(f"{n} as materialized ({_NAME.sub(lambda m: m[1], VIEWS[n]).strip()})" for n in order)
    rest = sql.strip()
    if not heads:
        return rest
    if m := re.match(r"with\s+(recursive\s+)?", rest, re.IGNORECASE):
        return f"with {m[1] or ''}{heads},\n{rest[m.end():]}"
    return f"with {heads}\n{rest}"
