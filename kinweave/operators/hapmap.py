"""Building a haplotype map: marker tracing, short-run masks, collapse into blocks, fills and switches.

Labels are letters of founder haplotypes; null stands for an unknown label and
``.`` for a slot that a sample doesn't have.  In long form a label is a row
(chrom, b, id, slot, label) with ``b`` the order along the chromosome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .hmm import runs
from .scans import neighbour, running
from .storage import cut


def depth_stats(depths: DataFrame) -> DataFrame:
    """Mean and population deviation of depth by chromosome and sample, over all records (A1); and, as whole numbers, the known depths, their sum and that of their squares."""
    dp = F.col("dp").cast("decimal(18,0)")
    exact = [F.count("dp").cast("decimal(12,0)").alias("known"), F.sum(dp).cast("decimal(19,0)").alias("total"), F.sum(dp * dp).cast("decimal(26,0)").alias("squares")]
    return depths.groupBy("chrom", "sample_id").agg(F.avg("dp").alias("mean"), F.stddev_pop("dp").alias("std"), F.count(F.lit(1)).alias("n"), *exact)


def depth_band(depths: DataFrame, stats: DataFrame) -> DataFrame:
    """(chrom, site_id, kept): whether every sample lies within one deviation of its mean (F5); without statistics it does, and null where no depth is known.

    ``stats`` is that of ``depth_stats``; depths are whole numbers.  The band is
    closed and a depth may lie on its edge, so the comparison is made in whole
    numbers: |n dp - sum| <= sqrt(n squares - sum^2).
    """
    away = (F.col("known") * F.col("dp").cast("decimal(18,0)") - F.col("total")).cast("decimal(19,0)")
    inside = away * away <= F.col("known") * F.col("squares") - F.col("total") * F.col("total")
    both = depths.join(stats.select("chrom", "sample_id", "known", "total", "squares"), ["chrom", "sample_id"], "left")
    return both.groupBy("chrom", "site_id").agg(F.bool_and(F.when(F.col("dp").isNotNull(), F.coalesce(inside, F.lit(True)))).alias("kept"))


def to_long(wide: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with h0 and h1 as rows by slot (2.13)."""
    return wide.select(*keys, F.posexplode(F.array("h0", "h1")).alias("slot", "label"))


def short_run_mask(labels: DataFrame, run: int = 10, size: int = 1 << 16) -> DataFrame:
    """Add ``masked``: known labels with fewer than ``run`` like ones before and after in their stretch.

    Both counts include the row itself and stop at another label; unknown labels
    are passed over.  Stretches of up to 2 * run - 3 lose their middle too.  Rows
    are placed by scans over bins of ``size`` along ``b``; a stretch's length comes
    from its parts by bin, so that a chromosome of one label stays many tasks.
    """
    line = ["chrom", "id", "slot"]
    known = runs(labels.where("label is not null"), line, "b", "label", size).withColumnRenamed("run", "_run")
    placed = running(known.withColumn("_bin", F.expr(f"floor(b / {size})")), line, "_bin", ["b"], F.lit(1), "_place", how="sum", inclusive=True)
    parts = placed.groupBy(*line, "_bin", "_run").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    stretches = parts.groupBy(*line, "_run").agg(F.min("_first").alias("_first"), F.sum("_n").alias("_n"))
    marked = placed.join(parts.select(*line, "_bin", "_run").join(stretches, [*line, "_run"]), [*line, "_bin", "_run"])
    before = F.col("_place") - F.col("_first") + 1
    mask = (before < run) & (F.col("_n") - before + 1 < run)
    return marked.select(*labels.columns, mask.alias("masked")).unionByName(labels.where("label is null").withColumn("masked", F.lit(False)))


def fill_from_neighbours(labels: DataFrame, least_blocks: int = 3, size: int = 1 << 16) -> DataFrame:
    """Add ``filled``: an unknown label from the nearest known one before, else after.

    Chromosomes with fewer than ``least_blocks`` blocks stay as they are.  Rows
    meet in bins of ``size`` along ``b``.
    """
    line = ["chrom", "id", "slot"]
    rows = labels.withColumns({"_bin": F.expr(f"floor(b / {size})"), "_from_end": -F.col("b")})
    nearest = lambda place: F.when(F.col("label").isNotNull(), F.struct(F.col(place).alias("at"), F.col("label").alias("label")))
    before = running(rows, line, "_bin", ["b"], nearest("b"), "_earlier", inclusive=True).withColumn("_bin", -F.col("_bin"))
    both = running(before, line, "_bin", ["_from_end"], nearest("_from_end"), "_later", inclusive=True)
    counts = both.groupBy(*line, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.select(*line, "_bin", F.sum("_n").over(Window.partitionBy(*line)).alias("_n"))
    filled = F.when(F.col("_n") >= least_blocks, F.coalesce("_earlier.label", "_later.label")).otherwise(F.col("label"))
    return both.join(totals, [*line, "_bin"]).select(*labels.columns, filled.alias("filled"))


def switches(labels: DataFrame, size: int = 1 << 16) -> DataFrame:
    """(chrom, id, slot, prev_end, next_start, old, new) where neighbouring blocks differ; unknown is a label here.

    Rows meet in bins of ``size`` along ``b``, so that no task holds a chromosome.
    """
    rows = labels.withColumns({"new": F.coalesce("label", F.lit("?")), "_bin": F.expr(f"floor(b / {size})")})
    steps = neighbour(rows, ["chrom", "id", "slot"], "_bin", ["b"], {"prev_end": F.col("end_pos"), "old": F.col("new")})
    return steps.where("old is not null and old <> new").select("chrom", "id", "slot", "prev_end", F.col("start_pos").alias("next_start"), "old", "new")


def consensus(blocks: DataFrame, markers: DataFrame, size: int = 1 << 18) -> DataFrame:
    """Most frequent known marker label of each (block, id, slot); ties go to the smaller label.

    ``markers`` has chrom, pos0, id, slot, label; a block holds markers in
    [start_pos, end_pos].
    """
    spread = F.explode(F.sequence(F.expr(f"floor(start_pos / {size})"), F.expr(f"floor(end_pos / {size})")))
    hit = markers.where("label is not null").withColumn("_bin", F.expr(f"floor(pos0 / {size})")).join(blocks.withColumn("_bin", spread), ["chrom", "_bin"]).where("pos0 between start_pos and end_pos")
    n = hit.groupBy("chrom", "b", "id", "slot", "label").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("chrom", "b", "id", "slot").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("label"), F.max("n").alias("n"))


BLOCK = ["chrom", "start_pos", "end_pos", "n_markers", "labels"]


def collapse(markers: DataFrame, size: int = 1 << 20, per_bin: int = 1 << 12) -> DataFrame:
    """Greedy collapse of neighbouring markers into blocks.

    ``markers`` has chrom, start_pos, end_pos, n_markers and ``labels``, one
    character for each slot of each sample, ``?`` if unknown.  The next marker
    joins the block while no known label differs from what the block has so far;
    it fills the block's unknown labels.

    A conflict is two neighbouring known labels of a slot that differ, the one at
    marker e, the other at b.  A block that begins at x ends before the least b of
    the conflicts with e at or after x, which a scan finds.  So only the places b
    can begin a block, each points to the next, and those reached from the first
    marker do.  The chain is followed in bins of ``per_bin`` markers: what leaves a
    bin for each place where it may be entered, then from bin to bin, then inside.
    """
    order = ["start_pos", "end_pos", "labels"]
    binned = markers.select(*BLOCK, F.expr(f"coalesce(floor(start_pos / {size}), -1)").alias("_bin"))
    placed = cut(running(binned, ["chrom"], "_bin", order, F.lit(1), "_at", how="sum").withColumn("_bin", F.expr(f"floor(_at / {per_bin})")))
    # the number of labels counts as one more, always known
    labels = F.concat(F.array(F.length("labels").cast("string")), F.split("labels", ""))
    known = placed.select("chrom", "_bin", "_at", F.posexplode(labels).alias("slot", "label")).where("label not in ('?', '')")
    near = neighbour(known, ["chrom", "slot"], "_bin", ["_at"], {"_e": F.col("_at"), "_label": F.col("label")})
    conflicts = near.where("_label <> label").groupBy("chrom", F.col("_e").alias("x")).agg(F.min("_at").alias("b"))
    places = conflicts.select("chrom", F.col("b").alias("x")).unionByName(placed.select("chrom", F.lit(0).cast("long").alias("x"))).distinct()
    both = conflicts.withColumn("kind", F.lit(0)).unionByName(places.select("chrom", "x", F.lit(None).cast("long").alias("b"), F.lit(1).alias("kind")))
    backwards = both.withColumns({"_x": -F.col("x"), "_bin": F.expr(f"floor(-x / {per_bin})")})
    pointed = running(backwards, ["chrom"], "_bin", ["_x", "kind"], -F.col("b"), "_next", inclusive=True)
    steps = pointed.where("kind = 1").select("chrom", "x", (-F.col("_next")).alias("next"), F.expr(f"floor(x / {per_bin})").alias("_bin"))
    bins = cut(steps.groupBy("chrom", "_bin").agg(F.sort_array(F.collect_list(F.struct("x", "next"))).alias("steps")))
    leaves = bins.select("chrom", F.expr(f"inline(filter(steps, s -> floor(s.next / {per_bin}) <> _bin))")).select("chrom", F.col("next").alias("x"))
    doors = leaves.unionByName(bins.select("chrom", F.lit(0).cast("long").alias("x"))).distinct().withColumn("_bin", F.expr(f"floor(x / {per_bin})"))
    crossed = doors.join(bins, ["chrom", "_bin"]).select("chrom", "x", F.expr("aggregate(steps, x, (at, s) -> if(s.x = at, s.next, at))").alias("exit"))
    chain = crossed.groupBy("chrom").agg(F.sort_array(F.collect_list(F.struct("x", "exit"))).alias("doors"))
    walk = lambda steps, start, to: f"aggregate({steps}, named_struct('at', {start}, 'out', cast(array() as array<bigint>)), (acc, s) -> if(s.x = acc.at, named_struct('at', s.{to}, 'out', concat(acc.out, array(s.x))), acc), acc -> acc.out)"
    entered = chain.select("chrom", F.explode(F.expr(walk("doors", "0L", "exit"))).alias("x")).withColumn("_bin", F.expr(f"floor(x / {per_bin})"))
    begins = entered.join(bins, ["chrom", "_bin"]).select("chrom", F.explode(F.expr(walk("steps", "x", "next"))).alias("_at"), F.lit(1).alias("_new"))
    numbered = running(placed.join(begins, ["chrom", "_at"], "left"), ["chrom"], "_bin", ["_at"], F.coalesce("_new", F.lit(0)), "_block", how="sum", inclusive=True)
    sums = numbered.groupBy("chrom", "_block").agg(F.min_by("start_pos", "_at").alias("start_pos"), F.max_by("end_pos", "_at").alias("end_pos"), F.sum("n_markers").alias("n_markers"))
    slots = numbered.select("chrom", "_block", F.posexplode(F.split("labels", "")).alias("slot", "label")).where("label <> ''").groupBy("chrom", "_block", "slot")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("slot", "label"))), lambda s: s["label"]), "")
    texts = slots.agg(F.coalesce(F.max(F.when(F.col("label") != "?", F.col("label"))), F.lit("?")).alias("label")).groupBy("chrom", "_block").agg(text.alias("labels"))
    return sums.join(texts, ["chrom", "_block"], "left").select("chrom", "start_pos", "end_pos", "n_markers", F.coalesce("labels", F.lit("")).alias("labels"))


def label_counts(labels: DataFrame) -> DataFrame:
    """Known labels of each individual (A2)."""
    return labels.groupBy("id").agg(F.count("label").alias("n_known"))


def iht_text(h0: Column, h1: Column, founder: Column) -> Column:
    """A pair of labels as text: founders ``A/B``, others ``A|B``; any ``.`` makes it ``|`` (SK1)."""
    a, b = F.coalesce(h0, F.lit("?")), F.coalesce(h1, F.lit("?"))
    return F.concat(a, F.when(founder & (a != ".") & (b != "."), "/").otherwise("|"), b)


def merge_labels(a: Column, b: Column) -> Column:
    """Two labels as one: an unknown one takes the other; known ones that differ are unknown."""
    return F.when(a.isNull(), b).when(b.isNull() | (a == b), a)


def block_coverage(labels: DataFrame) -> DataFrame:
    """How often A to D occur in each block, how many of them do, and the letter to paint.

    ``labels`` has chrom, b, start_pos, end_pos, h0, h1 of the children; paint is
    the last letter with no occurrence, null if all occur.
    """
    n = lambda x: F.count_if(F.col("label") == x).alias(f"n_{x.lower()}")
    counts = to_long(labels, ["chrom", "b", "start_pos", "end_pos"]).groupBy("chrom", "b", "start_pos", "end_pos").agg(*[n(x) for x in "ABCD"])
    ncov = sum(((F.col(f"n_{x}") > 0).cast("int") for x in "bcd"), (F.col("n_a") > 0).cast("int"))
    paint = F.lit(None).cast("string")
    for x in "abcd":
        paint = F.when(F.col(f"n_{x}") == 0, x.upper()).otherwise(paint)
    return counts.withColumns({"ncov": ncov, "paint": paint})


def length_by_coverage(covered: DataFrame) -> DataFrame:
    """Blocks and bases by the number of letters that occur, without chromosome X (A10)."""
    autosomes = covered.where("lower(chrom) not like '%chrx%'")
    return autosomes.groupBy("ncov").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum(F.col("end_pos") - F.col("start_pos")).alias("bases"))


def haplotype_lengths(labels: DataFrame) -> DataFrame:
    """Bases that each individual has of each haplotype, without chromosome X (A10)."""
    rows = to_long(labels.where("lower(chrom) not like '%chrx%'"), ["id", "start_pos", "end_pos"]).where("label is not null")
    return rows.groupBy("id", "label").agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("bases"))
