"""Truth sets from several callers: collapsing sites, conflicts, containment, annotation and haplotype choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def collapse_sites(calls: DataFrame) -> DataFrame:
    """One row for each site with its genotypes and callers as sorted lists.

    ``calls`` has site (``chrom:start:end:ref:alt``), genotype and caller.
    """
    lists = calls.groupBy("site").agg(F.sort_array(F.collect_list("genotype")).alias("genotypes"), F.sort_array(F.collect_list("caller")).alias("callers"))
    return lists


def conflicts(collapsed: DataFrame) -> DataFrame:
    """Add ``conflict`` (different genotypes), ``n_sources`` and ``genotype``, the first in order."""
    return collapsed.withColumns(
        {"conflict": F.size(F.array_distinct("genotypes")) > 1, "n_sources": F.size(F.array_distinct("callers")), "genotype": F.array_min("genotypes")}
    )


def parse_site(site: Column) -> Column:
    """``chrom:start:end:ref:alt[,alt]`` as a struct (SC15)."""
    part = F.split(site, ":")
    return F.struct(part[0].alias("chrom"), part[1].cast("long").alias("s"), part[2].cast("long").alias("e"), part[3].alias("ref"), F.split(part[4], ",").alias("alts"))


def contained(sites: DataFrame) -> DataFrame:
    """Add ``contained``: each alternative of the site is the one of another site at the place with the same reference.

    ``sites`` has site, chrom, pos, ref, alts, conflict; lines in conflict are
    not looked up.  Sites are told apart by ``site``.
    """
    single = sites.where("not conflict").select("chrom", "pos", "ref", F.explode("alts").alias("alt"), F.col("site").alias("other"))
    each = sites.select("site", "chrom", "pos", "ref", F.size("alts").alias("n_alts"), F.explode("alts").alias("alt"))
    hit = each.join(single, ["chrom", "pos", "ref", "alt"]).where("site <> other").select("site", "n_alts", "alt").distinct().groupBy("site", "n_alts").agg(F.count(F.lit(1)).alias("n"))
    full = hit.where("n = n_alts").select("site").withColumn("contained", F.lit(True))
    return sites.join(full, "site", "left").withColumn("contained", F.coalesce("contained", F.lit(False)))


def site_filter(conflict: Column, contained_: Column) -> Column:
    """gt_mismatch before contained before PASS."""
    return F.when(conflict, "gt_mismatch").when(contained_, "contained").otherwise("PASS")


def annotate(variants: DataFrame, annotations: DataFrame) -> DataFrame:
    """Left join of annotations by key; of equal keys the last in order (column n) wins."""
    last = annotations.groupBy("key").agg(F.max_by("anno", "n").alias("anno"))
    return variants.join(last, "key", "left")


def annotate_records(records: DataFrame, annotations: DataFrame, tag: str = "OVL") -> DataFrame:
    """Records (chrom, pos0, ref, alts, info, ...) with the annotation of their first alternative added to INFO's ``tag`` (SK10, J11).

    ``annotations`` has key (chrom:pos0:ref:alt), anno and n, the order.  A value
    that is there already stays in front.
    """
    key = F.concat_ws(":", "chrom", F.col("pos0").cast("string"), "ref", F.get("alts", 0))
    both = annotate(records.withColumn("key", key), annotations)
    old = F.try_element_at("info", F.lit(tag))
    value = F.when(old.isNull(), F.col("anno")).otherwise(F.concat(old, F.lit(","), "anno"))
    rest = F.map_filter("info", lambda k, v: k != tag)
    added = F.when(F.col("anno").isNull(), F.col("info")).otherwise(F.map_concat(rest, F.create_map(F.lit(tag), value)))
    return both.withColumn("info", added).select(*records.columns)


def best_haplotypes(alignments: DataFrame, least_block: int = 1500) -> DataFrame:
    """The best haplotype of each key (A11): least edits, then fewer indels, then first.

    ``alignments`` has key, n (row order), hap, block_len, edits, indels.  Rows
    with short blocks don't compete, but a key's first row always does.
    """
    first = alignments.groupBy("key").agg(F.min("n").alias("_first"))
    able = alignments.join(first, "key").where((F.col("block_len") >= least_block) | (F.col("n") == F.col("_first")))
    best = F.min_by(F.struct("hap", "edits", "indels"), F.struct("edits", "indels", "n")).alias("m")
    return able.groupBy("key").agg(best).select("key", "m.hap", "m.edits", "m.indels")


def haplotype_labels(variants: DataFrame, chosen: DataFrame) -> DataFrame:
    """Label each variant by whether it lies on a chosen haplotype.

    ``variants`` has key, hap, variant and overlaps: HAP_PASS on a chosen one,
    else HAP_FAIL if it overlaps another variant, HAP_OVLP if not.
    """
    on = chosen.select("key", "hap").withColumn("_on", F.lit(True))
    both = variants.join(on, ["key", "hap"], "left")
    return both.withColumn("label", F.when(F.col("_on"), "HAP_PASS").when(F.col("overlaps"), "HAP_FAIL").otherwise("HAP_OVLP")).drop("_on")


def false_positives(decisions: DataFrame) -> DataFrame:
    """Rows whose benchmark decision names a false positive."""
    return decisions.where(F.col("bd").rlike("FP"))


def problem_regions(scores: DataFrame, least: int = 6) -> DataFrame:
    """Merged regions where either count is high."""
    from .intervals import merge

    return merge(scores.where((F.col("x") >= least) | (F.col("y") >= least)))


def deep_windows(depths: DataFrame, above: int = 9) -> DataFrame:
    """Windows deeper than ``above``."""
    return depths.where(F.col("depth") > above)
