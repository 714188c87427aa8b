"""Phasing by a haplotype map: which orientation of the founders fits best.

Each founder's two labels may stand for their alleles either way round, so F
founders have 2^F orientations; founders are numbered in the order of their ids
and bit j swaps founder j.  All orientations of a site are tried inside its row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.genotype import matches_ignoring_missing
from .concordance import founder_alleles, label_number


def _oriented(n: Column, orientation: Column, alleles: Column, n_founders: int) -> Column:
    swapped = F.call_function("shiftright", orientation, F.floor(n / 2).cast("int")).bitwiseAND(1)
    return F.when(n.between(0, 2 * n_founders - 1), F.get(alleles, n.bitwiseXOR(swapped.cast("int"))))


def oriented_allele(label: Column, orientation: Column, n_founders: int) -> Column:
    """The allele that a label stands for in an orientation; null for labels that no founder has.

    Labels are numbered A, B, C, ...; founder j has labels 2j and 2j + 1, and bit j
    of the orientation swaps them.
    """
    alleles = F.array(*[F.col(f"f{j}_{k}") for j in range(n_founders) for k in (0, 1)])
    return _oriented(label_number(label), orientation, alleles, n_founders)


def orientations(n_founders: int, written_out: int = 3) -> Column:
    """array<(mismatches, orientation, wrong ids)> over all orientations of ``gather``'s founders.

    Up to eight orientations are written out; more are the elements of a
    sequence, so that the plan doesn't grow with their number.  A label that no
    called founder has stands for a missing allele, which agrees with any.  A
    sample with first label ``.`` has its second allele twice.  What all
    orientations share, the labels' numbers and each orientation's alleles, is
    made once for a site: lambdas are interpreted, and repeat what they name.
    """
    if n_founders > 12:
        raise ValueError("2 ** founders orientations: 12 founders at most")
    few = n_founders <= written_out

    def wrong(c: Column) -> Column:
        alike = ((c["g0"] == c["x"]) & (c["g1"] == c["y"])) | ((c["g0"] == c["y"]) & (c["g1"] == c["x"]))
        # unknown only where an allele is missing
        return F.coalesce(~alike, ~matches_ignoring_missing(F.array(c["g0"], c["g1"]), F.array(c["x"], c["y"])))

    def bad(calls: Column, allele: Callable[[Column], Column]) -> Column:
        def expected(c: Column) -> Column:
            second = allele(c["n1"])
            return F.struct(c["id"].alias("id"), c["g0"].alias("g0"), c["g1"].alias("g1"), F.when(c["same"], second).otherwise(allele(c["n0"])).alias("x"), second.alias("y"))

        return F.transform(F.filter(F.transform(calls, expected), wrong), lambda c: c["id"])

    numbered = F.transform(
        F.filter("calls", lambda c: c["h0"].isNotNull()),
        lambda c: F.struct(c["id"].alias("id"), c["g0"].alias("g0"), c["g1"].alias("g1"), (c["h0"] == ".").alias("same"), label_number(c["h0"]).alias("n0"), label_number(c["h1"]).alias("n1")),
    )
    alleles = [F.array(*founder_alleles(k, n_founders)).alias(f"a{k}") for k in (range(1 << n_founders) if few else [0])]

    def of_site(s: Column) -> Column:
        if few:
            lists = F.array(*[bad(s["calls"], lambda n, k=k: F.get(s[f"a{k}"], n)) for k in range(1 << n_founders)])
        else:
            lists = F.transform(F.sequence(F.lit(0), F.lit((1 << n_founders) - 1)), lambda k: bad(s["calls"], lambda n: _oriented(n, k, s["a0"], n_founders)))
        return F.transform(lists, lambda ids, k: F.struct(F.size(ids).alias("mismatches"), k.alias("orientation"), ids.alias("wrong")))

    return F.get(F.transform(F.array(F.struct(numbered.alias("calls"), *alleles)), of_site), 0)


def best_orientation(gathered: DataFrame, n_founders: int, least_qual: float = 20.0, least_depth: int = 5) -> DataFrame:
    """Add ``best`` and ``status`` (G6): low_qual, nocall, pass or fail; ties go to the smallest orientation.

    A sample without depth or below ``least_depth`` makes the site a no-call.
    """
    calls = F.col("calls")
    unusable = calls.isNull() | F.exists(calls, lambda c: c["g0"].isNull() | c["g1"].isNull() | c["dp"].isNull() | (c["dp"] < least_depth))
    # the array's smallest entry has the fewest mismatches, then the smallest orientation
    out = gathered.withColumn("best", F.array_min(orientations(n_founders)))
    status = F.when(F.col("qual") < least_qual, "low_qual").when(unusable, "nocall").when(F.col("best.mismatches") == 0, "pass").otherwise("fail")
    return out.withColumn("status", status)


def _alone() -> Column:
    """The sample that alone makes a site fail, or null."""
    return F.when((F.col("status") == "fail") & (F.col("best.mismatches") == 1), F.get("best.wrong", 0))


# conditions on status and best are values of the aggregates: as filters they would be pushed below, where all orientations are tried again


def orientation_stats(decided: DataFrame) -> DataFrame:
    """Sites of each block by outcome, with the samples that alone made a site fail (A3): ``id:n`` in order of id."""
    outcomes = ["pass", "fail", "nocall"]
    counted = decided.groupBy("chrom", "b", _alone().alias("id")).agg(F.count_if(F.col("status") != "low_qual").alias("used"), *[F.count_if(F.col("status") == s).alias(s) for s in outcomes])
    single = F.when(F.col("id").isNotNull(), F.concat("id", F.lit(":"), F.col("fail").cast("string")))
    named = [F.sum(s).alias(n) for s, n in zip(outcomes, ["passing", "failing", "nocall"])]
    sums = counted.groupBy("chrom", "b").agg(*named, F.array_join(F.sort_array(F.collect_list(single)), ";").alias("singletons"), F.sum("used").alias("used")).where("used > 0").drop("used")
    total = F.col("passing") + F.col("failing")
    return sums.select("chrom", "b", "passing", "failing", "nocall", "singletons", F.when(total > 0, F.round(F.col("passing") / total, 3)).otherwise(0.0).alias("rate"))


def failed_singletons(decided: DataFrame) -> DataFrame:
    """(chrom, b, id, n): sites that fail because of one sample."""
    return decided.groupBy("chrom", "b", _alone().alias("id")).agg(F.count(_alone()).alias("n")).where("n > 0")


def phased_by_map(decided: DataFrame, n_founders: int, samples: list[str]) -> DataFrame:
    """(site_id, id, gt) of passing sites; samples without labels are ``./.``."""
    passing = decided.where("status = 'pass'")
    founders = [f"f{j}_{k}" for j in range(n_founders) for k in (0, 1)]
    each = passing.select("site_id", *founders, "best", "calls", F.explode(F.array(*[F.lit(s) for s in samples])).alias("id"))
    own = each.withColumn("c", F.get(F.filter("calls", lambda c: c["id"] == F.col("id")), 0))
    text = lambda h: F.coalesce(oriented_allele(F.col(f"c.{h}"), F.col("best.orientation"), n_founders).cast("string"), F.lit("."))
    gt = F.when(F.col("c.h0").isNull(), "./.").otherwise(F.concat(text("h0"), F.lit("|"), text("h1")))
    return own.select("site_id", "id", gt.alias("gt"))
