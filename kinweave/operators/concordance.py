"""Inheritance blocks and the variants in them.

A block [start_pos, end_pos], closed, gives every sample two founder-haplotype
labels.  A variant agrees with its block if some assignment of the founders'
alleles to the labels explains all samples.  Samples of a pedigree are few, so a
site's genotypes and a block's labels travel as arrays, and everything about a
site is decided in its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import without

BIN = 1 << 18


def block_join(sites: DataFrame, blocks: DataFrame, first_only: bool = True, size: int = BIN) -> DataFrame:
    """Sites with the block that holds them (J1): the first by ``b``, or all.

    ``sites`` has chrom, pos0; ``blocks`` has chrom, b, start_pos, end_pos.
    """
    spread = F.explode(F.sequence(F.expr(f"floor(start_pos / {size})"), F.expr(f"floor(end_pos / {size})")))
    tiles = blocks.select("chrom", "b", "start_pos", "end_pos").withColumn("_bin", spread)
    hit = sites.withColumn("_bin", F.expr(f"floor(pos0 / {size})")).join(tiles, ["chrom", "_bin"]).where("pos0 between start_pos and end_pos").drop("_bin")
    if not first_only:
        return hit
    keys = sites.columns
    return hit.groupBy(*keys).agg(F.min(F.struct("b", "start_pos", "end_pos")).alias("_m")).select(*keys, "_m.*")


def outside_blocks(sites: DataFrame, blocks: DataFrame, size: int = BIN) -> DataFrame:
    """Sites that no block holds."""
    return without(sites, block_join(sites, blocks, False, size), sites.columns)


def gather(sites: DataFrame, blocks: DataFrame, labels: DataFrame, gts: DataFrame, founders: list[str], first_only: bool = True) -> DataFrame:
    """Sites with their block and ``calls``, array<(id, g0, g1, dp, h0, h1)> by id; h0 and h1 are the block's labels.

    Columns ``f0_0``, ``f0_1``, ``f1_0`` and so on are the alleles of the
    founders in the order given, taken while the calls are gathered.
    """
    alleles = [F.max(F.when(F.col("id") == who, F.col(g))).alias(f"f{j}_{k}") for j, who in enumerate(founders) for k, g in enumerate(("g0", "g1"))]
    calls = gts.groupBy("site_id").agg(F.sort_array(F.collect_list(F.struct("id", "g0", "g1", "dp"))).alias("calls"), *alleles)
    marks = labels.groupBy("chrom", "b").agg(F.map_from_entries(F.collect_list(F.struct("id", F.struct("h0", "h1")))).alias("marks"))
    met = block_join(sites, blocks, first_only).join(marks, ["chrom", "b"], "left").join(calls, "site_id", "left")

    def labelled(c: Column) -> Column:
        mark = F.try_element_at(F.col("marks"), c["id"])
        return F.struct(c["id"].alias("id"), c["g0"].alias("g0"), c["g1"].alias("g1"), c["dp"].alias("dp"), mark["h0"].alias("h0"), mark["h1"].alias("h1"))

    return met.withColumn("calls", F.transform("calls", labelled)).drop("marks")


def founder_alleles(orientation: int, n_founders: int) -> list[Column]:
    """Allele columns for labels A, B, C, ... when bit j of ``orientation`` swaps founder j."""
    out: list[Column] = []
    for j in range(n_founders):
        pair = [F.col(f"f{j}_0"), F.col(f"f{j}_1")]
        out += pair[::-1] if orientation >> j & 1 else pair
    return out


def allele_of(label: Column, alleles: list[Column]) -> Column:
    """The allele that a label stands for; null for unknown labels."""
    out = F.lit(None).cast("int")
    for letter, a in zip("ABCDEFGHIJKLMNOPQRSTUVWX", alleles):
        out = F.when(label == letter, a).otherwise(out)
    return out


def label_number(label: Column) -> Column:
    """0 for A, 1 for B, and so on; null for labels that aren't one character."""
    return F.when(F.length(label) == 1, F.ascii(label) - 65)


def configurations(children: list[str] | None = None) -> Column:
    """The first of the four assignments of two parents' alleles that explains all labelled children, or null.

    The parents are the founders 0 (labels A, B) and 1 (C, D) of ``gather``; bit
    0 swaps the father's alleles, bit 1 the mother's.
    """
    calls = F.col("calls")
    kids = F.filter(calls, lambda c: c["id"].isin(children)) if children else calls
    # labels' numbers and alleles in order are made once for a site, not for each assignment
    numbered = F.transform(
        F.filter(kids, lambda c: c["h0"].isNotNull()),
        lambda c: F.struct(label_number(c["h0"]).alias("n0"), label_number(c["h1"]).alias("n1"), F.least(c["g0"], c["g1"]).alias("low"), F.greatest(c["g0"], c["g1"]).alias("high")),
    )

    def first(s: Column) -> Column:
        out = F.lit(None).cast("int")
        for k in range(3, -1, -1):
            alleles = s[f"a{k}"]

            def explained(c: Column) -> Column:
                x, y = F.get(alleles, c["n0"]), F.get(alleles, c["n1"])
                return (F.least(x, y) == c["low"]) & (F.greatest(x, y) == c["high"])

            out = F.when(F.coalesce(F.forall(s["calls"], explained), F.lit(False)), k).otherwise(out)
        return out

    return F.get(F.transform(F.array(F.struct(numbered.alias("calls"), *[F.array(*founder_alleles(k, 2)).alias(f"a{k}") for k in range(4)])), first), 0)


def statuses(gathered: DataFrame, least_qual: float = 20.0) -> DataFrame:
    """Add ``status`` and ``config`` (F10, G1): low_qual, nocall, all_ref, all_het, pass or fail, the first that holds.

    A site where all samples are alike heterozygous says nothing, and is all_het
    if the parents have just two alleles.
    """
    calls = F.col("calls")
    missing = calls.isNull() | F.exists(calls, lambda c: c["g0"].isNull() | c["g1"].isNull())
    all_ref = F.forall(calls, lambda c: (c["g0"] == 0) & (c["g1"] == 0))
    het = F.forall(calls, lambda c: c["g0"] != c["g1"])
    two = F.size(F.array_distinct(F.array("f0_0", "f0_1", "f1_0", "f1_1"))) == 2
    out = gathered.withColumn("config", configurations())
    status = (
        F.when(F.col("qual") < least_qual, "low_qual").when(missing, "nocall").when(all_ref, "all_ref").when(het & two, "all_het")
        .when(F.col("config").isNotNull(), "pass").otherwise("fail")
    )
    return out.withColumn("status", status).withColumn("config", F.when(F.col("status") == "pass", F.col("config")))


def block_stats(decided: DataFrame) -> DataFrame:
    """Sites of each block by outcome (A3, A4): passing, failing, nocall, rate; low quality left out."""
    n = lambda s: F.count_if(F.col("status") == s)
    sums = decided.where("status <> 'low_qual'").groupBy("chrom", "b", "start_pos", "end_pos").agg(n("pass").alias("passing"), n("fail").alias("failing"), n("nocall").alias("nocall"))
    total = F.col("passing") + F.col("failing")
    return sums.withColumn("rate", F.when(total > 0, F.round(F.col("passing") / total, 3)).otherwise(0.0))


def totals(decided: DataFrame, outside: DataFrame) -> DataFrame:
    """Sites by outcome over all blocks, with those outside of blocks (A4)."""
    counts = decided.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return counts.unionByName(outside.agg(F.count(F.lit(1)).alias("n")).select(F.lit("not_in_block").alias("status"), "n"))


def phased(decided: DataFrame) -> DataFrame:
    """(site_id, id, gt): phased genotypes of passing sites, first label's allele first."""
    by_config = [founder_alleles(k, 2) for k in range(4)]
    alleles = [F.element_at(F.array(*[x[i] for x in by_config]), F.col("config") + 1).alias(f"a{i}") for i in range(4)]
    # other sites have nothing to explode: a filter on the status would be pushed below, where it is decided a second time
    passing = F.when(F.col("status") == "pass", F.filter("calls", lambda c: c["h0"].isNotNull()))
    each = decided.select("site_id", F.explode(passing).alias("c"), *alleles)
    gt = F.concat_ws("|", *[allele_of(F.col(f"c.{h}"), [F.col(f"a{i}") for i in range(4)]).cast("string") for h in ("h0", "h1")])
    return each.select("site_id", F.col("c.id").alias("id"), gt.alias("gt"))
