"""Family structure: who descends from whom (columns id, father, mother; null where unknown).

A pedigree is a table of people in one family study; generations are walked one
after the other, each person once in each, so that inbred lines don't multiply.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut


def parents(ped: DataFrame) -> DataFrame:
    """(child, parent): one row for each known parent."""
    return ped.select(F.col("id").alias("child"), F.explode(F.array("father", "mother")).alias("parent")).where("parent is not null").distinct()


def assert_acyclic(ped: DataFrame) -> None:
    """An error that names those who descend from themselves, if there are any.

    Leaves off people without parents among those left, generation by generation.
    """
    pairs = parents(ped)
    while True:
        inner = pairs.join(pairs.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi").select("child", "parent")
        inner = cut(inner)
        if inner.isEmpty():
            return
        if inner.count() == pairs.count():
            looped = [r["child"] for r in inner.select("child").distinct().orderBy("child").limit(10).collect()]
            raise ValueError(f"a pedigree in which someone descends from themselves: {', '.join(looped)}")
        pairs = inner


def depths(ped: DataFrame) -> DataFrame:
    """(id, depth): the longest way down from someone without parents (S10); a pedigree in which someone descends from themselves is an error."""
    assert_acyclic(ped)
    start = ped.where("father is null and mother is null").select("id")
    return _levels(start, parents(ped)).groupBy("id").agg(F.max("level").alias("depth"))


def _levels(start: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, level) of all who are so many generations below ``start`` (id) by ``pairs`` (child, parent); each once a level, however many ways lead there."""
    now, level = cut(start.select("id").distinct().withColumn("level", F.lit(0))), 0
    out = now
    while not now.isEmpty():
        level += 1
        now = cut(now.join(pairs, F.col("id") == F.col("parent")).select(F.col("child").alias("id")).distinct().withColumn("level", F.lit(level)))
        out = out.unionByName(now)
    return out


def founders(ped: DataFrame) -> DataFrame:
    """Ids without parents that have children."""
    pairs = parents(ped)
    return ped.where("father is null and mother is null").select("id").join(pairs, F.col("id") == F.col("parent"), "left_semi").distinct()


def offspring(ped: DataFrame) -> DataFrame:
    """(id, depth) of those with a parent; by (depth, id) is generation order."""
    return ped.where("father is not null or mother is not null").select("id").distinct().join(depths(ped), "id")


def children(ped: DataFrame) -> DataFrame:
    """(id, child): a row for each child of each parent."""
    return parents(ped).select(F.col("parent").alias("id"), "child")


def spouses(ped: DataFrame) -> DataFrame:
    """(id, spouse): the other parent of the first child, in generation order, that has two."""
    both = ped.where("father is not null and mother is not null").join(depths(ped), "id")
    pairs = both.select(F.col("father").alias("a"), F.col("mother").alias("b"), "depth", "id").unionByName(both.select(F.col("mother").alias("a"), F.col("father").alias("b"), "depth", "id"))
    return pairs.groupBy(F.col("a").alias("id")).agg(F.min_by("b", F.struct("depth", "id")).alias("spouse"))


def trios(ped: DataFrame) -> DataFrame:
    """(child, father, mother) where both parents are known."""
    return ped.where("father is not null and mother is not null").select(F.col("id").alias("child"), "father", "mother")


def founders_with_several_children(ped: DataFrame) -> DataFrame:
    """Founders with more than one child, with their number."""
    n = children(ped).groupBy("id").agg(F.count(F.lit(1)).alias("n_children")).where("n_children > 1")
    return founders(ped).join(n, "id")


def reachable(ped: DataFrame, focal: list[str]) -> DataFrame:
    """(id): members judged when transmission is followed from ``focal`` ids.

    Someone is judged only with both parents known; their children follow.
    """
    assert_acyclic(ped)
    both = ped.where("father is not null and mother is not null").select("id")
    judged = parents(ped).join(both, F.col("id") == F.col("child"), "left_semi")
    return _levels(both.where(F.col("id").isin(focal)), judged).select("id").distinct()


def check_samples(ped: DataFrame, samples: DataFrame) -> DataFrame:
    """Ids that only one of the pedigree and the samples (column id) has (SC9): id, missing_in."""
    one = lambda a, b, where: a.select("id").distinct().join(b.select("id").distinct(), "id", "left_anti").withColumn("missing_in", F.lit(where))
    return one(ped, samples, "samples").unionByName(one(samples, ped, "pedigree"))
