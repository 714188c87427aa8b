"""Merging and comparing structural-variant call sets (columns id, prio, chrom, svtype, start_pos, end_pos, svlen).

``prio`` numbers the callers in the order in which they are merged.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import BIN, bins, overlap_join
from .storage import cut

MERGED_TYPES = ("INS", "DEL", "INV")


def flanked(df: DataFrame, flank: int = 200) -> DataFrame:
    """Add the half-open interval s, e that a call is matched by (D14): an insertion's end is one further."""
    return df.withColumns({"s": F.col("start_pos") - flank, "e": F.col("end_pos") + F.when(F.col("svtype") == "INS", 1).otherwise(0) + flank})


def keep_types(df: DataFrame, types: tuple[str, ...] = MERGED_TYPES) -> DataFrame:
    """Calls of the given types."""
    return df.where(F.col("svtype").isin(*types))


def shared_chromosomes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` on chromosomes that ``b`` has too."""
    return a.join(b.select("chrom").distinct(), "chrom", "left_semi")


def prefilter(df: DataFrame, shortest: int = 50, longest: int = 100_000) -> DataFrame:
    """Calls of a fitting size."""
    return df.where(F.abs("svlen").between(shortest, longest))


def infer_type(ref: Column, alt: Column) -> tuple[Column, Column]:
    """(svlen, svtype) from the alleles."""
    d = F.length(alt) - F.length(ref)
    return d, F.when(d > 0, "INS").when(d < 0, "DEL").otherwise("OTHER")


def strip_info(info: Column, always: list[str], if_set: list[str]) -> Column:
    """An INFO map without the keys ``always``, and without ``if_set`` keys whose value is set: not empty, 0 or false."""
    falsy = lambda v: v.isNull() | v.isin("", "0", "0.0", "False", "false")
    return F.map_filter(info, lambda k, v: ~k.isin(*always or [""]) & ~(k.isin(*if_set or [""]) & ~falsy(v)))


def number_duplicates(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Add ``unique_id``: the name, with ``_n`` from its second occurrence in ``order`` on."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(*order)) - 1
    return df.withColumn("unique_id", F.when(n > 0, F.concat(name, F.lit("_"), n.cast("string"))).otherwise(F.col(name)))


#: Calls of one task: a merge sorts them several times, and they are small where they were read.
CALLS = 100_000
_PLACE = ["chrom", "svtype", "s", "e"]
_OVERLAP = "s < b_e and b_s < e"


def _of_callers(calls: DataFrame, n_callers: int, flank: int, *carried: str) -> tuple[DataFrame, DataFrame]:
    """The callers' calls with a place, and those without one, which overlap nothing."""
    rows = flanked(keep_types(calls), flank).where(F.col("prio").between(0, n_callers - 1)).select("id", "prio", *_PLACE, *carried)
    placed = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in _PLACE])
    return rows.where(placed), rows.where(~placed)


def _tasks(calls: DataFrame) -> int:
    return max(1, -(-calls.count() // CALLS))


def _with_primary(rows: DataFrame, rounds: int, tasks: int) -> DataFrame:
    """Add ``primary`` to calls with a place: right for the first caller and ``rounds`` more.  No round makes pairs or moves a row.

    A call overlaps a primary of its type if one that begins up to its own start
    reaches over that, or if the next one begins before its end: a running maximum
    and a running minimum, inside bins and over the bins' totals.  Ends before
    starts are put where they end, and reach over nothing.
    """
    at, order = ["_home", "chrom", "svtype"], [F.least("s", "e"), F.col("s") < F.col("e")]
    # a number first tells most rows apart when they are sorted
    up, down = [Window.partitionBy("_key", *at).orderBy(*by) for by in (order, [x.desc() for x in order])]
    line = Window.partitionBy("chrom", "svtype")
    reach = F.max(F.when(F.col("primary") & (F.col("s") < F.col("e")), F.col("e")))
    begin = F.min(F.when(F.col("primary"), F.col("s")))
    rows = rows.withColumn("_home", F.expr(f"floor(least(s, e) / {BIN})")).repartition(tasks, *at).withColumns({"primary": F.col("prio") == 0, "_key": F.xxhash64(*at)})
    own = rows.columns
    for k in range(1, rounds + 1):
        totals = rows.groupBy(*at).agg(reach.alias("_reach"), begin.alias("_begin"))
        before = F.max("_reach").over(line.orderBy("_home").rowsBetween(Window.unboundedPreceding, -1))
        after = F.min("_begin").over(line.orderBy(F.desc("_home")).rowsBetween(Window.unboundedPreceding, -1))
        around = totals.select(*at, before.alias("_before"), after.alias("_after"))
        seen = rows.withColumns({"_reach": reach.over(up), "_begin": begin.over(down)}).join(around, at, "left")
        met = F.coalesce((F.greatest("_reach", "_before") > F.col("s")) | (F.least("_begin", "_after") < F.col("e")), F.lit(False))
        rows = seen.withColumn("primary", F.col("primary") | ((F.col("prio") == k) & ~met)).select(*own)
    return rows.drop("_home", "_key")


def _dealt(rows: DataFrame, rounds: int, tasks: int) -> tuple[DataFrame, DataFrame]:
    """Distinct calls in each bin that they reach into, with ``n``, how often they are there; the first also with ``primary``.

    Which calls are primaries is found out on their places alone; all columns are
    shuffled once, by bin, and both are read from that.
    """
    found = _with_primary(rows.select("prio", *_PLACE), rounds, tasks).where("primary").drop("primary").withColumn("_mark", F.lit(True))
    both = rows.withColumn("_mark", F.lit(None).cast("boolean")).unionByName(found, allowMissingColumns=True)
    binned = both.withColumn("_bin", F.explode(bins("s", "e"))).repartition(tasks, "_bin", "chrom", "svtype")
    # n also counts marks away: a filter on them would be moved below the shuffle, which would then be made twice
    counted = lambda df: df.groupBy(*[c for c in df.columns if c != "_mark"]).agg(F.count_if(F.col("_mark").isNull()).alias("n")).where("n > 0")
    same = Window.partitionBy("_bin", *_PLACE, "prio")
    return counted(binned.withColumn("primary", F.coalesce(F.bool_or("_mark").over(same), F.lit(False)))), counted(binned)


def _gathered(owners: DataFrame, others: DataFrame, meets: Column) -> DataFrame:
    """Pairs of dealt ``owners`` and ``others`` (their columns with the prefix ``b_``) that meet in a bin, each in one only; still dealt by ``_bin``.

    Both sides ask the same of their rows, so that they read one shuffle.
    """
    y = others.select(*[F.col(c).alias(f"b_{c}") for c in others.columns])
    first = F.col("_bin") == F.greatest(*[F.expr(f"floor({c} / {BIN})") for c in ("s", "b_s")])
    here = (F.col("_bin") == F.col("b__bin")) & (F.col("chrom") == F.col("b_chrom")) & (F.col("svtype") == F.col("b_svtype"))
    return owners.join(y, here & first & meets)


def merge_callers(calls: DataFrame, n_callers: int, flank: int = 200) -> tuple[DataFrame, DataFrame]:
    """Merge callers in the order of prio (S6): primaries, and support links (primary_id, support_id, round).

    A call that overlaps primaries of its type supports each of them; one that
    overlaps none becomes a primary.  Calls of one caller don't support each
    other, so a caller is joined as a set and the order within it doesn't matter.
    """
    rows = flanked(keep_types(calls), flank).select("id", "prio", "chrom", "svtype", "s", "e")
    primaries = rows.where("prio = 0")
    links = None
    for k in range(1, n_callers):
        mine = rows.where(F.col("prio") == k)
        met = overlap_join(mine, primaries.select("chrom", "svtype", "s", "e", "id"), keys=["chrom", "svtype"])
        met = cut(met.select(F.col("b_id").alias("primary_id"), F.col("id").alias("support_id"), F.lit(k).alias("round")))
        links = met if links is None else links.unionByName(met)
        primaries = primaries.unionByName(mine.join(met.select(F.col("support_id").alias("id")).distinct(), "id", "left_anti"))
        if k + 1 < n_callers:
            primaries = cut(primaries)
    return primaries, links


def closest_support(calls: DataFrame, links: DataFrame) -> DataFrame:
    """(primary_id, prio, support_id, diff): of each caller the support nearest in signed length (A16); ties to the smaller id."""
    p = calls.select(F.col("id").alias("primary_id"), F.col("svlen").alias("p_len"))
    s = calls.select(F.col("id").alias("support_id"), F.col("svlen").alias("s_len"), "prio")
    both = links.join(p, "primary_id").join(s, "support_id").withColumn("diff", F.abs(F.col("s_len") - F.col("p_len")))
    best = F.min(F.struct("diff", "support_id")).alias("m")
    return both.groupBy("primary_id", "prio").agg(best).select("primary_id", "prio", "m.support_id", "m.diff")


def _winner(tried: Column, threshold: int) -> Column:
    """The entry (s, e, id, diff, same_gt) that wins of sorted ones."""
    later = lambda best, x: F.when((x["diff"] < best["diff"]) | ((x["diff"] <= threshold) & x["same_gt"]), x).otherwise(best)
    return F.aggregate(tried, F.get(tried, 0), later)


def best_primary(matches: DataFrame, threshold: int = 50) -> DataFrame:
    """(support_id, primary_id) of supports with several primaries.

    ``matches`` has support_id, primary_id, s, e, diff, same_gt.  Primaries are
    tried in the order (s, e, id); a later one wins if it is nearer, or if it
    lies within the threshold and the parents' genotypes agree, even if farther.
    """
    entry = F.struct("s", "e", F.col("primary_id").alias("id"), "diff", "same_gt")
    tried = matches.groupBy("support_id").agg(F.sort_array(F.collect_list(entry)).alias("xs")).where(F.size("xs") > 1)
    return tried.select("support_id", _winner(F.col("xs"), threshold)["id"].alias("primary_id"))


def best_primaries(calls: DataFrame, n_callers: int, flank: int = 200, threshold: int = 50) -> DataFrame:
    """``best_primary`` of the merged ``calls``, which have svlen and gt too, without their links as rows."""
    # whatever overlaps an earlier primary is a support, and the last caller's primaries have none: their round isn't needed
    rows, every = _dealt(_of_callers(calls, n_callers, flank, "svlen", "gt")[0], n_callers - 2, _tasks(calls))
    primaries = rows.where("primary").drop("primary")
    entry = F.struct(F.col("b_s").alias("s"), F.col("b_e").alias("e"), F.col("b_id").alias("id"), F.abs(F.col("svlen") - F.col("b_svlen")).alias("diff"), (F.col("gt") == F.col("b_gt")).alias("same_gt"))
    pairs = _gathered(every, primaries, F.expr(f"{_OVERLAP} and b_prio < prio"))
    keys = [c for c in every.columns if c != "_bin"]
    here = pairs.groupBy("_bin", *keys).agg(F.collect_list(entry).alias("xs"), F.sum(F.col("n") * F.col("b_n")).alias("_links"))
    # calls inside one bin have all their primaries there
    here = here.where(F.size(bins("s", "e")) * F.col("_links") > 1)
    tried = here.groupBy(*keys).agg(F.sort_array(F.flatten(F.collect_list("xs"))).alias("xs"), F.sum("_links").alias("_links")).where("_links > 1")
    return tried.select(F.col("id").alias("support_id"), _winner(F.col("xs"), threshold)["id"].alias("primary_id"))


def support_table(calls: DataFrame, n_callers: int, flank: int = 200) -> DataFrame:
    """Each primary of the merged ``calls`` with its number of supports, of callers, and whether all genotypes agree.

    ``calls`` has gt too, the genotypes of all samples as text.  Calls that are
    there several times count as often as a join by their id would.
    """
    placed, nowhere = _of_callers(calls, n_callers, flank, "gt")
    rows, every = _dealt(placed, n_callers - 1, _tasks(calls))
    primaries = rows.where("primary").drop("primary")
    bit = lambda prio: F.expr(f"shiftleft(1L, cast({prio} as int))")
    supports = F.col("b_prio") > F.col("prio")
    # a primary meets itself too, so that those without supports stay
    itself = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"b_{c}")) for c in ("id", "prio", "s", "e", "gt")])
    parts = [F.sum(F.when(supports, F.col("b_n") * F.col("b_n"))).alias("_times"), F.bit_or(bit("b_prio")).alias("_callers"), F.min("b_gt").alias("_low"), F.max("b_gt").alias("_high")]
    met = _gathered(primaries, every, (F.expr(_OVERLAP) & supports) | itself)
    found = met.groupBy(*[c for c in primaries.columns if c != "_bin"]).agg(*parts)
    found = found.unionByName(nowhere.groupBy(*nowhere.columns).agg(F.count(F.lit(1)).alias("n")), allowMissingColumns=True)
    members = F.col("n") * F.coalesce("_times", F.lit(0)) + F.col("n") * F.col("n")
    callers = F.bit_count(F.coalesce("_callers", F.lit(0).cast("long")).bitwiseOR(bit("prio")))
    # nulls count as no genotype
    return found.select(
        F.col("id").alias("primary_id"), (members - 1).alias("n_support"), callers.cast("long").alias("n_sources"),
        F.coalesce(F.least("_low", "gt") == F.greatest("_high", "gt"), F.lit(True)).alias("gt_consistent"),
    )


def support_stats(supports: DataFrame) -> DataFrame:
    """Primaries by number of callers and genotype agreement."""
    return supports.groupBy("n_sources", "gt_consistent").agg(F.count(F.lit(1)).alias("n"))


def size_stats(calls: DataFrame) -> DataFrame:
    """Number and summed length by type, and of all (svtype null)."""
    return calls.rollup("svtype").agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs("svlen")).alias("total_len"))


def size_similarity(a: Column, b: Column) -> Column:
    """Smaller over larger length; two empty ones are alike, an empty and another aren't."""
    x, y = F.abs(a), F.abs(b)
    return F.when((x == 0) & (y == 0), 1.0).when((x == 0) | (y == 0), 0.0).otherwise(F.least(x, y) / F.greatest(x, y))


def matches(a: DataFrame, b: DataFrame, flank: int = 200, similar: float = 0.7) -> DataFrame:
    """(id, n): how many calls of ``b`` each call of ``a`` meets in place, type and size."""
    x = flanked(shared_chromosomes(a, b), flank).select("id", "chrom", "svtype", "svlen", "s", "e")
    y = b.select("chrom", "svtype", "svlen", F.col("start_pos").alias("s"), (F.col("end_pos") + F.when(F.col("svtype") == "INS", 1).otherwise(0)).alias("e"))
    met = overlap_join(x, y, keys=["chrom", "svtype"]).where(size_similarity(F.col("svlen"), F.col("b_svlen")) >= similar)
    n = met.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return a.select("id", "svtype").join(n, "id", "left").select("id", "svtype", F.coalesce("n", F.lit(0)).alias("n"))


def shared_exclusive(matched: DataFrame) -> DataFrame:
    """Shared and exclusive calls by type with the share in per cent."""
    sums = matched.groupBy("svtype").agg(F.count_if(F.col("n") > 0).alias("shared"), F.count_if(F.col("n") == 0).alias("exclusive"))
    return sums.withColumn("pct_shared", F.round(100 * F.col("shared") / (F.col("shared") + F.col("exclusive")), 4))


def one_hot_sources(df: DataFrame, sources: list[str], column: str = "sources") -> DataFrame:
    """A column of 0 or 1 for each source in an array column (2.13)."""
    return df.select("*", *[F.array_contains(column, s).cast("int").alias(s) for s in sources])
