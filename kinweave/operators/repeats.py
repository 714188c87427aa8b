"""Tandem repeats: quality filters, candidate alleles by haplotype, assignment and summaries.

Alleles are rows (trid, id, slot, seq, purity); null purity is missing, and so is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import edit_or_length


def passing(alleles: DataFrame, n_samples: int = 10, least_purity: float = 0.5, least_length: int = 10) -> DataFrame:
    """(trid, n_alleles, longest) of loci that pass.

    All samples are there, every allele has a purity, their mean is high enough,
    no allele occurs once only, there are several, and the longest is long enough.
    """
    by_allele = alleles.groupBy("trid", "seq").agg(
        F.count(F.lit(1)).alias("n"), F.sum("purity").alias("purity"), F.count_if(F.coalesce(F.col("purity"), F.lit(0)) == 0).alias("impure"), F.collect_set("id").alias("ids")
    )
    loci = by_allele.groupBy("trid").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("samples"), F.sum("impure").alias("impure"), (F.sum("purity") / F.sum("n")).alias("mean"),
        F.min("n").alias("rarest"), F.count(F.lit(1)).alias("n_alleles"), F.max(F.length("seq")).alias("longest"),
    )
    return loci.where((F.col("samples") == n_samples) & (F.col("impure") == 0) & (F.col("mean") >= least_purity) & (F.col("rarest") > 1) & (F.col("n_alleles") > 1) & (F.col("longest") >= least_length)).select("trid", "n_alleles", "longest")


def candidates(alleles: DataFrame) -> DataFrame:
    """(trid, label, seq, n): the two most frequent alleles of the samples that share a haplotype.

    All that are as frequent as the second stay.  ``alleles`` has trid, label and
    seq: every allele of every sample with that haplotype.
    """
    n = alleles.groupBy("trid", "label", "seq").agg(F.count(F.lit(1)).alias("n"))
    line = Window.partitionBy("trid", "label")
    place = F.row_number().over(line.orderBy(F.col("n").desc(), "seq"))
    second = F.min(F.when(F.col("_r") <= 2, F.col("n"))).over(line)
    return n.withColumn("_r", place).withColumn("_second", second).where("n >= _second").select("trid", "label", "seq", "n")


def pair_distance(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """(errors, distance) of two alleles against an expected pair, the nearer way round."""
    straight = edit_or_length(a0, b0) + edit_or_length(a1, b1)
    crossed = edit_or_length(a0, b1) + edit_or_length(a1, b0)
    wrong = lambda x, y: (x != y).cast("int")
    return F.when(straight <= crossed, F.struct((wrong(a0, b0) + wrong(a1, b1)).alias("errors"), straight.alias("distance"))).otherwise(
        F.struct((wrong(a0, b1) + wrong(a1, b0)).alias("errors"), crossed.alias("distance"))
    )


def assignments(found: DataFrame, labels: list[str]) -> DataFrame:
    """All choices of one candidate for each label of a locus, ``ord`` numbering them in order (J18): trid, ord and a column for each label.

    Four haplotypes have a few candidates each, so a locus has few choices.
    """
    lists = found.groupBy("trid").agg(*[F.array_sort(F.collect_list(F.when(F.col("label") == x, F.struct((-F.col("n")).alias("n"), "seq")))).alias(x) for x in labels])
    out = lists.select("trid", *[F.transform(x, lambda c: c["seq"]).alias(x) for x in labels])
    for x in labels:
        out = out.select("trid", *[c for c in out.columns if c not in ("trid", x)], F.posexplode(x).alias(f"_o{x}", x))
    key = F.lit(0).cast("long")
    for x in labels:
        key = key * 1000 + F.col(f"_o{x}")
    return out.select("trid", key.alias("ord"), *labels)


def best_assignment(choices: DataFrame, found: DataFrame, calls: DataFrame, labels: list[str]) -> DataFrame:
    """The choice of fewest errors, then least distance, then first in order (A19): trid, n_errors, sum_error and the labels' alleles.

    ``found`` holds the candidates, ``calls`` trid, id, a0, a1 (a sample's
    alleles) and h0, h1 (its labels).  A sample's distance depends on the alleles
    of its two labels alone, so samples are compared once for each pair of
    candidates, and a choice adds up what its pairs cost.
    """
    # all meet by locus, so that tables dealt by locus stay where they are
    held = found.groupBy("trid").agg(F.collect_list(F.struct("label", "seq")).alias("_found"))
    of = lambda h: F.explode(F.transform(F.filter("_found", lambda x: x["label"] == F.col(h)), lambda x: x["seq"])).alias(f"s{h}")
    pairs = calls.join(held, "trid").select("*", of("h0")).select("*", of("h1")).where("h0 <> h1 or sh0 = sh1")
    scored = pairs.withColumn("_d", pair_distance(F.col("a0"), F.col("a1"), F.col("sh0"), F.col("sh1")))
    costs = scored.groupBy("trid", "h0", "h1", "sh0", "sh1").agg(F.sum("_d.errors").alias("errors"), F.sum("_d.distance").alias("distance"))
    key = lambda *x: F.concat_ws("|", *x)
    table = costs.groupBy("trid").agg(F.map_from_entries(F.collect_list(F.struct(key("h0", "h1", "sh0", "sh1").alias("k"), F.struct("errors", "distance").alias("v")))).alias("_costs"))
    both = choices.join(table, "trid")
    costs_of = [F.try_element_at("_costs", key(F.lit(x), F.lit(y), F.col(x), F.col(y))) for x in labels for y in labels]
    total = lambda f: sum((F.coalesce(c[f], F.lit(0)) for c in costs_of), F.lit(0).cast("long"))
    sums = both.select("trid", "ord", *labels, total("errors").alias("n_errors"), total("distance").alias("sum_error"))
    best = F.min(F.struct("n_errors", "sum_error", "ord", *labels)).alias("m")
    return sums.groupBy("trid").agg(best).select("trid", "m.n_errors", "m.sum_error", *[f"m.{x}" for x in labels])


def summary(alleles: DataFrame, digits: int = 2) -> DataFrame:
    """Mean length and purity (``digits`` digits, half to even) and allele counts by locus."""
    return alleles.groupBy("trid").agg(
        F.bround(F.avg(F.length("seq")), digits).alias("mean_length"), F.bround(F.avg("purity"), digits).alias("mean_purity"), F.countDistinct("seq").alias("n_alleles"), F.count(F.lit(1)).alias("n")
    )


def length_bin(length: Column, width: int = 50, cap: int = 1000) -> Column:
    """A length rounded half to even to a multiple of ``width``, at most ``cap``."""
    return F.least(F.bround(length / width).cast("long") * width, F.lit(cap).cast("long"))


def deltas(calls: DataFrame) -> DataFrame:
    """Expansion and contraction in bases of each sample against its expected alleles (A21): calls has id, seq, expected."""
    d = F.length("seq") - F.length("expected")
    return calls.groupBy("id").agg(F.sum(F.greatest(d, F.lit(0))).alias("expansion"), F.sum(F.greatest(-d, F.lit(0))).alias("contraction"))


def locus_blocks(loci: DataFrame, blocks: DataFrame, size: int = 1 << 18) -> DataFrame:
    """Each locus with the first block that contains it (J4): loci chrom, s, e; blocks chrom, b, start_pos, end_pos."""
    spread = F.explode(F.sequence(F.expr(f"floor(start_pos / {size})"), F.expr(f"floor(end_pos / {size})")))
    met = loci.withColumn("_bin", F.expr(f"floor(s / {size})")).join(blocks.withColumn("_bin", spread), ["chrom", "_bin"]).where("start_pos <= s and e <= end_pos")
    return met.groupBy(*loci.columns).agg(F.min("b").alias("b"))
