"""Algebra of genomic intervals: half-open [s, e) on a chromosome (columns chrom, s, e).

Joins meet in bins of the coordinate, so that no task holds a whole chromosome
and no pair is made that doesn't share a bin.  Zero-length intervals overlap
nothing.  Null coordinates match nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import running

BIN = 1 << 14


def bins(s: str, e: str, size: int = BIN) -> Column:
    """The bins that an interval reaches into, as an array."""
    first = F.expr(f"floor({s} / {size})")
    return F.sequence(first, F.greatest(first, F.expr(f"floor(({e} - 1) / {size})")))


def _bins(s: str, e: str, size: int) -> Column:
    return F.explode(bins(s, e, size))


def _renamed(df: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
    return df.select(*[F.col(c).alias(c if c in keys else prefix + c) for c in df.columns])


def overlap_join(a: DataFrame, b: DataFrame, how: str = "inner", keys: list[str] | None = None, size: int = BIN, wide: int | None = None) -> DataFrame:
    """Pairs of overlapping intervals (J5): columns of ``a``, and those of ``b`` with the prefix ``b_``.

    ``keys`` are equal in both (chrom by default).  With ``how="left"`` rows of
    ``a`` without a partner stay; equal rows are told apart by nothing but their
    number, so a lost executor can't mix them up.  Intervals longer than ``wide`` bins meet in
    coarser bins, so that a few giant ones don't fill thousands of bins.
    """
    keys = keys or ["chrom"]
    right = _renamed(b, "b_", keys)
    overlaps = (F.col("s") < F.col("b_e")) & (F.col("b_s") < F.col("e"))

    def meet(x: DataFrame, y: DataFrame, size: int) -> DataFrame:
        # of the bins that a pair shares only the first makes the pair: no distinct is needed
        first = F.greatest(F.expr(f"floor(s / {size})"), F.expr(f"floor(b_s / {size})"))
        return x.withColumn("_bin", _bins("s", "e", size)).join(y.withColumn("_bin", _bins("b_s", "b_e", size)), [*keys, "_bin"]).where(overlaps & (F.col("_bin") == first)).drop("_bin")

    if how == "left":
        a = a.groupBy(*a.columns).agg(F.count(F.lit(1)).alias("_copies"))
    if wide is None:
        pairs = meet(a, right, size)
    else:
        long_a, long_b = F.expr(f"e - s > {wide * size}"), F.expr(f"b_e - b_s > {wide * size}")
        pairs = meet(a.where(~long_a), right.where(~long_b), size)
        pairs = pairs.unionByName(meet(a.where(long_a), right, size * wide)).unionByName(meet(a.where(~long_a), right.where(long_b), size * wide))
    if how != "left":
        return pairs
    own = [c for c in a.columns if c != "_copies"]
    only_b = [c for c in right.columns if c not in keys]
    alone = without(a, pairs.select(*own), own).select("*", *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in only_b])
    return _repeated(pairs.select(*a.columns, *only_b).unionByName(alone)).select(*own, *only_b)


def _repeated(df: DataFrame) -> DataFrame:
    """Each row as many times as ``_copies`` says."""
    return df.withColumn("_copies", F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int")))).drop("_copies")


def _matching(a: DataFrame, b: DataFrame, columns: list[str], how: str) -> DataFrame:
    other = b.select(*[F.col(c).alias(f"_other_{c}") for c in columns]).distinct()
    return a.join(other, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_other_{c}")) for c in columns]), how)


def without(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of ``a`` that ``b`` doesn't have in ``columns``; nulls are equal."""
    return _matching(a, b, columns, "left_anti")


def among(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of ``a`` that ``b`` has in ``columns``; nulls are equal."""
    return _matching(a, b, columns, "left_semi")


def _tally(a: DataFrame, pairs: DataFrame, value: Column, name: str) -> DataFrame:
    """Each distinct row of ``a`` with the sum of ``value`` over its ``pairs``, in one aggregation; zeros stay and nulls are equal."""
    rows = a.select("*", F.lit(1).alias("_own"), F.lit(0).cast("long").alias("_sum")).unionByName(pairs.select(*a.columns, F.lit(0).alias("_own"), value.cast("long").alias("_sum")))
    sums = rows.groupBy(*a.columns).agg(F.sum("_own").alias("_own"), F.sum("_sum").alias("_sum"))
    return sums.select(*a.columns, F.expr("_sum div _own").alias(name))


def count_overlaps(a: DataFrame, b: DataFrame, name: str = "n", size: int = BIN) -> DataFrame:
    """Each distinct interval of ``a`` with the number of intervals of ``b`` that overlap it (I5); zeros stay.

    Rows of ``a`` are told apart by all their columns.
    """
    return _tally(a, overlap_join(a, b.select("chrom", "s", "e"), size=size), F.lit(1), name)


def merge(df: DataFrame, size: int = BIN, gap: int = 0, keys: list[str] | None = None) -> DataFrame:
    """Islands of overlapping and book-ended intervals (I2): chrom, s, e, n intervals; with ``keys`` of each of them for itself."""
    keys = keys or ["chrom"]
    # equal rows are one first: both scans need the same total order
    rows = df.groupBy(*keys, "s", "e").agg(F.count(F.lit(1)).alias("_n")).withColumn("_bin", F.expr(f"floor(s / {size * 64})"))
    order = ["s", "e"]
    seen = running(rows, keys, "_bin", order, F.col("e"), "_reach")
    starts = F.col("_reach").isNull() | (F.col("s") > F.col("_reach") + gap)
    marked = seen.withColumn("_start", F.when(starts, F.col("s")))
    island = running(marked, keys, "_bin", order, F.col("_start"), "_island", inclusive=True)
    return island.groupBy(*keys, F.col("_island").alias("s")).agg(F.max("e").alias("e"), F.sum("_n").alias("n")).select(*keys, "s", "e", "n")


def intersect(a: DataFrame, b: DataFrame, size: int = BIN) -> DataFrame:
    """Overlaps of each pair, clipped to both."""
    pairs = overlap_join(a, b, size=size)
    return pairs.withColumns({"s": F.greatest("s", "b_s"), "e": F.least("e", "b_e")})


def keep_overlapping(a: DataFrame, b: DataFrame, size: int = BIN) -> DataFrame:
    """Rows of ``a`` that overlap ``b``, once each (I4)."""
    return among(a, overlap_join(a, merge(b).select("chrom", "s", "e"), size=size), a.columns)


def subtract(a: DataFrame, b: DataFrame, size: int = BIN) -> DataFrame:
    """What of each interval of ``a`` no interval of ``b`` covers (I6): columns of ``a`` with new s, e.

    ``a`` may hold equal rows; each gives its own pieces.
    """
    rows = a.groupBy(*a.columns).agg(F.count(F.lit(1)).alias("_copies"))
    pairs = overlap_join(rows, merge(b).select("chrom", "s", "e"), size=size)
    taken = pairs.select(*rows.columns, F.greatest("s", "b_s").alias("bs"), F.least("e", "b_e").alias("be"))
    # an empty stretch at each row's end: what lies before it is the last piece, or the whole row
    ends = rows.select("*", F.col("e").alias("bs"), F.col("e").alias("be"))
    order = Window.partitionBy(*rows.columns).orderBy("bs", "be")
    pieces = taken.unionByName(ends).withColumn("ps", F.coalesce(F.lag("be").over(order), F.col("s"))).where("ps < bs")
    columns = [F.col("ps").alias("s") if c == "s" else F.col("bs").alias("e") if c == "e" else F.col(c) for c in a.columns]
    return _repeated(pieces).select(*columns)


def depth_segments(df: DataFrame, size: int = BIN) -> DataFrame:
    """Segments between neighbouring ends with the number of intervals over them: chrom, s, e, depth."""
    ends = df.where("s < e").select("chrom", F.explode(F.array(F.struct(F.col("s").alias("p"), F.lit(1).alias("d")), F.struct(F.col("e").alias("p"), F.lit(-1).alias("d")))).alias("x"))
    steps = ends.groupBy("chrom", F.col("x.p").alias("p")).agg(F.sum("x.d").alias("d")).withColumn("_bin", F.expr(f"floor(p / {size * 64})"))
    deep = running(steps, ["chrom"], "_bin", ["p"], F.col("d"), "depth", how="sum", inclusive=True)
    return _with_next(deep, "p", ["p"]).where("_next is not null and depth > 0").select("chrom", F.col("p").alias("s"), F.col("_next").alias("e"), "depth")


def _with_next(df: DataFrame, position: str, order: list[str]) -> DataFrame:
    """Add ``_next``, the position of the next row on the chromosome; rows have a column _bin along the order."""
    inside = F.lead(position).over(Window.partitionBy("chrom", "_bin").orderBy(*order))
    firsts = df.groupBy("chrom", "_bin").agg(F.min(position).alias("_first"))
    after = firsts.select("chrom", "_bin", F.lead("_first").over(Window.partitionBy("chrom").orderBy("_bin")).alias("_after"))
    return df.withColumn("_inside", inside).join(after, ["chrom", "_bin"]).withColumn("_next", F.coalesce("_inside", "_after")).drop("_inside", "_after")


def multi_intersect(sets: list[DataFrame], k: int | None = None) -> DataFrame:
    """Segments that ``k`` of the sets cover, all of them by default (I7); each set is merged first, all in one pass."""
    k = len(sets) if k is None else k
    tagged = reduce(DataFrame.unionByName, [x.select("chrom", "s", "e", F.lit(i).alias("_set")) for i, x in enumerate(sets)])
    return depth_segments(merge(tagged, keys=["chrom", "_set"])).where(F.col("depth") == k).select("chrom", "s", "e")


def union_merge(sets: list[DataFrame]) -> DataFrame:
    """Islands of all sets together (I8)."""
    return merge(reduce(DataFrame.unionByName, [x.select("chrom", "s", "e") for x in sets]))


def windows(df: DataFrame, width: int, step: int) -> DataFrame:
    """Tiles of ``width`` at every ``step`` from each interval's start, clipped to its end (I9): columns of ``df`` with ws, we."""
    tile = df.where("s < e").withColumn("ws", F.explode(F.sequence(F.col("s"), F.col("e") - 1, F.lit(step).cast("long"))))
    return tile.withColumn("we", F.least(F.col("ws") + width, F.col("e")))


def coverage(a: DataFrame, b: DataFrame, size: int = BIN) -> DataFrame:
    """Each distinct interval of ``a`` with the part of it that ``b`` covers (I10): covered bases and fraction."""
    pairs = overlap_join(a, merge(b).select("chrom", "s", "e"), size=size)
    out = _tally(a, pairs, F.least("e", "b_e") - F.greatest("s", "b_s"), "covered")
    return out.withColumn("fraction", F.when(F.col("e") > F.col("s"), F.col("covered") / (F.col("e") - F.col("s"))).otherwise(F.lit(0.0)))


def smooth(regions: DataFrame, width: int = 100, step: int = 50, least: float = 0.75, longer: int = 50) -> DataFrame:
    """Regions without their thinly covered tiles, longer than ``longer`` (I10 chain).

    Tiles run over the merged regions' outer span; those covered less than
    ``least`` are taken out.
    """
    merged = merge(regions).select("chrom", "s", "e")
    span = merged.groupBy("chrom").agg(F.min("s").alias("_from"), F.max("e").alias("_to"))
    # only tiles that a region reaches into can take something from it: each region makes its own
    first, last = F.expr(f"greatest(0, floor((s - _from - {width}) / {step}) + 1)"), F.expr(f"floor((e - 1 - _from) / {step})")
    numbered = merged.where("s < e").join(span, "chrom").where(first <= last).withColumn("_k", F.explode(F.sequence(first, last)))
    tiles = numbered.select("chrom", (F.col("_from") + F.col("_k") * step).alias("ts"), "s", "e", "_to").withColumn("te", F.least(F.col("ts") + width, F.col("_to")))
    covered = tiles.groupBy("chrom", "ts", "te").agg(F.sum(F.least("e", "te") - F.greatest("s", "ts")).alias("covered"))
    thin = covered.where(F.col("covered") / (F.col("te") - F.col("ts")) < least).select("chrom", F.col("ts").alias("s"), F.col("te").alias("e"))
    return subtract(merged, thin).where(F.col("e") - F.col("s") > longer)


def slop(df: DataFrame, contigs: DataFrame, by: int = 10) -> DataFrame:
    """Intervals grown by ``by`` on both sides, clipped to the contig (I11); ``contigs`` is chrom, length (an index of contigs, small)."""
    return df.join(contigs, "chrom").withColumns({"s": F.greatest(F.col("s") - by, F.lit(0)), "e": F.least(F.col("e") + by, F.col("length"))}).drop("length")


def around(df: DataFrame, by: int = 10) -> DataFrame:
    """Distinct intervals grown by ``by`` on both sides, not below zero."""
    return df.select("chrom", F.greatest(F.col("s") - by, F.lit(0)).alias("s"), (F.col("e") + by).alias("e")).distinct()


def uncovered(a: DataFrame, b: DataFrame) -> DataFrame:
    """Intervals of ``a`` that no interval of ``b`` overlaps."""
    return count_overlaps(a.distinct(), b).where("n = 0").drop("n")


def region_text(chrom: Column, s: Column, e: Column) -> Column:
    """``chrom:s-e``."""
    return F.format_string("%s:%d-%d", chrom, s, e)


def overlapping_rows(df: DataFrame, size: int = BIN) -> DataFrame:
    """Distinct intervals of some length with ``overlaps``: whether another interval of the set overlaps."""
    rows = df.where("s < e").groupBy("chrom", "s", "e").agg(F.count(F.lit(1)).alias("copies")).withColumn("_bin", F.expr(f"floor(s / {size * 64})"))
    before = running(rows, ["chrom"], "_bin", ["s", "e"], F.col("e"), "_reach")
    nxt = _with_next(before, "s", ["s", "e"])
    some = (F.col("copies") > 1) | F.coalesce(F.col("_reach") > F.col("s"), F.lit(False)) | F.coalesce(F.col("_next") < F.col("e"), F.lit(False))
    return nxt.select("chrom", "s", "e", (some & (F.col("s") < F.col("e"))).alias("overlaps"))


def summary(df: DataFrame) -> DataFrame:
    """Intervals and bases by chromosome (I16)."""
    size = F.col("e") - F.col("s")
    return df.groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bases"), F.min(size).alias("shortest"), F.max(size).alias("longest"))


def concat_distinct(sets: list[DataFrame]) -> DataFrame:
    """Rows of all sets, equal rows once."""
    return reduce(DataFrame.unionByName, sets).dropDuplicates()


def chunks(df: DataFrame, n: int, keys: list[str], order: list[str], size: int = BIN) -> DataFrame:
    """Add ``chunk``, 1 to ``n``: rows of each key in order, in chunks of nearly equal size, the larger ones first.

    ``order`` is total and begins with a position; rows meet in bins of ``size``
    along it, and a row's chunk follows from its place and its key's count.
    """
    placed = running(df.withColumn("_bin", F.expr(f"floor({order[0]} / {size * 64})")), keys, "_bin", order, F.lit(1), "_place", how="sum")
    counts = placed.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.select(*keys, "_bin", F.sum("_n").over(Window.partitionBy(*keys)).alias("_n"))
    chunk = F.expr(f"case when _place < (_n % {n}) * (_n div {n} + 1) then _place div (_n div {n} + 1) else _n % {n} + (_place - (_n % {n}) * (_n div {n} + 1)) div (_n div {n}) end + 1")
    return placed.join(totals, [*keys, "_bin"]).select(*df.columns, chunk.cast("int").alias("chunk"))


def ranked(df: DataFrame, size: int = BIN) -> DataFrame:
    """Intervals with their place ``n`` on the chromosome in the order of (s, e)."""
    rows = df.select("chrom", "s", "e").withColumn("_bin", F.expr(f"floor(s / {size * 64})"))
    return running(rows, ["chrom"], "_bin", ["s", "e"], F.lit(1), "n", how="sum", inclusive=True).drop("_bin")
