"""Running aggregates over ordered rows without one task per chromosome.

A window partitioned by chromosome alone puts a chromosome, up to a third of all
rows, into one task.  Here the rows of a key are cut into bins along the order;
a window inside each bin and one over the bins' totals give the same running
aggregate, and only bins meet in the second window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_AGGREGATES = {"max": (F.max, F.greatest), "sum": (F.sum, None)}


def running(df: DataFrame, keys: list[str], bin_column: str, order: list[str], value: Column, name: str, how: str = "max", inclusive: bool = False) -> DataFrame:
    """Add ``name``: the aggregate of ``value`` over the rows of ``keys`` before each row in ``order``.

    ``bin_column`` must not fall along ``order``.  ``how`` is max or sum; rows
    before which there is none get null (max) or 0 (sum).
    """
    aggregate, _ = _AGGREGATES[how]
    at = [*keys, bin_column]
    end = 0 if inclusive else -1
    inside = Window.partitionBy(*at).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    totals = df.groupBy(*at).agg(aggregate(value).alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy(bin_column).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*at, aggregate("_total").over(earlier).alias("_before"))
    out = df.withColumn("_inside", aggregate(value).over(inside)).join(before, at)
    both = F.greatest("_inside", "_before") if how == "max" else F.coalesce("_inside", F.lit(0)) + F.coalesce("_before", F.lit(0))
    return out.select(*df.columns, both.alias(name))


def neighbour(df: DataFrame, keys: list[str], bin_column: str, order: list[str], values: dict[str, Column], after: bool = False) -> DataFrame:
    """Add ``values`` of the row before each row of ``keys`` in ``order``, or of the row after; null where there is none.

    ``order`` must be total and ``bin_column`` must not fall along it.  The rows at
    the bins' ends get theirs from the nearest bin that has rows.
    """
    move, edge = (F.lead, F.min_by) if after else (F.lag, F.max_by)
    at = [*keys, bin_column]
    packed = F.struct(*[v.alias(n) for n, v in values.items()])
    inside = df.withColumn("_inside", move(packed).over(Window.partitionBy(*at).orderBy(*order)))
    edges = df.groupBy(*at).agg(edge(packed, F.struct(*order)).alias("_edge"))
    near = edges.select(*at, move("_edge").over(Window.partitionBy(*keys).orderBy(bin_column)).alias("_near"))
    both = inside.join(near, at).withColumn("_there", F.coalesce("_inside", "_near"))
    return both.select(*df.columns, *[F.col(f"_there.{n}").alias(n) for n in values])
