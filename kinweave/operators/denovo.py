"""De novo candidates by trios: a child's allele that no parent can have given."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.genotype import transmission
from .pedigree import children, trios


def classify(gts: DataFrame, ped: DataFrame, least_dp: int = 5, least_gq: int = 10, grandchildren: bool = False) -> DataFrame:
    """(site_id, child, kind, ...) of each trio at each site.

    ``gts`` has site_id, id, g0, g1, dp, gq.  The pedigree is small and is
    joined to the samples; a site's samples meet by site.  With ``grandchildren``,
    kinds are raised as ``inherited`` does it, in the site's own row.
    """
    called = F.col("g0").isNotNull() & F.col("g1").isNotNull() & (F.col("dp") >= least_dp) & (F.col("gq") >= least_gq)
    own = gts.select("site_id", "id", F.array("g0", "g1").alias("gt"), F.coalesce(called, F.lit(False)).alias("called"))
    by_site = own.groupBy("site_id").agg(F.map_from_entries(F.collect_list(F.struct("id", F.struct("gt", "called")))).alias("calls"))
    people, kind = trios(ped), transmission(F.col("mother.gt"), F.col("father.gt"), F.col("own.gt"), F.col("mother.called") & F.col("father.called") & F.col("own.called"))
    kids = []
    if grandchildren:
        own = children(ped).groupBy(F.col("id").alias("child")).agg(F.collect_set(F.col("child")).alias("names"))
        people = people.join(own, "child", "left")
        kids = [F.transform("names", lambda who: F.try_element_at("calls", who)["gt"]).alias("kids")]  # null without any
        shown = lambda i: F.exists("kids", lambda gt: F.array_contains(gt, F.col("own.gt")[i]))
        both = F.coalesce((F.col("own.gt")[0] != F.col("own.gt")[1]) & shown(0) & shown(1), F.lit(False))
        kind = F.when((kind == "CanDenovo") & both, "IhtDenovo").otherwise(kind)
    return (
        by_site.withColumn("child", F.explode(F.map_keys("calls")))
        .join(people, "child")  # a pedigree of usual size is broadcast by Spark's own check
        .select(
            "site_id",
            "child",
            *[F.try_element_at("calls", F.col(w)).alias(w) for w in ("mother", "father")],
            F.try_element_at("calls", F.col("child")).alias("own"),
            *kids,
        )
        .select("site_id", "child", F.col("own.gt").alias("gt"), kind.alias("kind"))
    )


def inherited(classes: DataFrame, gts: DataFrame, ped: DataFrame) -> DataFrame:
    """``classes`` with CanDenovo raised to IhtDenovo where both alleles show among the child's children."""
    alleles = gts.select("site_id", F.col("id").alias("grandchild"), F.explode(F.array("g0", "g1")).alias("allele"))
    kids = children(ped).select(F.col("id").alias("child"), F.col("child").alias("grandchild"))
    seen = (
        classes.where("kind = 'CanDenovo'")
        .select("site_id", "child", "gt")
        .join(kids, "child")
        .join(alleles, ["site_id", "grandchild"])
        .where(F.array_contains("gt", F.col("allele")))
        .groupBy("site_id", "child")
        .agg(F.countDistinct("allele").alias("n"))
    )
    return classes.join(seen, ["site_id", "child"], "left").withColumn("kind", F.when(F.col("n") == 2, "IhtDenovo").otherwise(F.col("kind"))).drop("n")


def _kinds() -> list:
    n = lambda k: F.count_if(F.col("kind") == k)
    return [
        n("Valid").alias("n_valid"), n("Violation").alias("n_violation"), n("Unknown").alias("n_unknown"), n("CanDenovo").alias("n_denovo"),
        n("IhtDenovo").alias("n_iht_denovo"), F.count(F.lit(1)).alias("n_total"),
    ]


def transmission_counts(classes: DataFrame) -> DataFrame:
    """Trios of each kind by site (A5)."""
    return classes.groupBy("site_id").agg(*_kinds())


def average_quality(gts: DataFrame, ped: DataFrame, least_dp: int = 5, least_gq: int = 10) -> DataFrame:
    """Mean GQ of a site over all people of the pedigree; no-calls and absent people count 0."""
    people = ped.select("id").distinct()
    n_people = people.count()
    called = F.col("g0").isNotNull() & F.col("g1").isNotNull() & (F.col("dp") >= least_dp) & (F.col("gq") >= least_gq)
    sums = gts.join(people, "id", "left_semi").groupBy("site_id").agg(F.sum(F.when(called, F.col("gq")).otherwise(0)).alias("gq"))
    return sums.select("site_id", (F.col("gq") / F.lit(n_people)).alias("avg_gq"))


def candidates(classes: DataFrame, max_unknown: int = 3) -> DataFrame:
    """Sites with a de novo candidate (G10, F12): the smallest candidate id; a violation clears the site."""
    first = F.min(F.when(F.col("kind").isin("CanDenovo", "IhtDenovo"), F.col("child"))).alias("child")
    sites = classes.groupBy("site_id").agg(*_kinds(), first).where(f"child is not null and n_violation = 0 and n_unknown < {int(max_unknown)}")
    return sites.select("site_id", "child", "n_denovo", "n_iht_denovo", "n_unknown", "n_valid")
