"""Bad lines with the reason why they are bad, for every text format, in the pass that reads them (2.14).

A run drops lines that can't be parsed; ``checked`` keeps them apart with a
reason, and ``counted`` reports how many there were of each once an action has
run, without a pass of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Reasons in the order in which they are looked for, by format: (reason, test that is true for a bad line, on fields f).
Rule = tuple[str, Column]


def _field(k: int) -> Column:
    return F.get("f", k)


def _no_long(k: int) -> Column:
    return _field(k).try_cast("long").isNull()


def _fewer(n: int) -> Rule:
    return f"fewer than {n} fields", F.size("f") < n


def _rules(kind: str) -> tuple[str, str, list[Rule]]:
    """(separator, pattern of lines that are no records, rules) of a format."""
    space, tab = r"\s+", "\t"
    interval = [("start or end is no number", _no_long(1) | _no_long(2)), ("end before start", _field(2).try_cast("long") < _field(1).try_cast("long"))]
    genotypes = F.exists(F.slice("f", 10, F.greatest(F.size("f") - 9, F.lit(0))), lambda c: ~F.split(c, ":")[0].rlike(r"^[0-9.]+([|/][0-9.]+)*$"))
    made = {
        "bed": (space, "^#", [_fewer(3), *interval]),
        "ped": (space, "^#", [_fewer(6), ("own parent", (_field(1) == _field(2)) | (_field(1) == _field(3))), ("sex is no number", _field(4).try_cast("int").isNull())]),
        "vcf": (tab, "^#", [_fewer(8), ("position is no number", _no_long(1)), ("reference is no sequence", ~_field(3).rlike("^[ACGTNacgtn]+$")), ("quality is no number", (_field(5) != ".") & _field(5).try_cast("double").isNull()), ("bad genotype", (F.size("f") > 9) & genotypes)]),
        "inheritance": (",", "(?i)^﻿?(#|chrom)", [_fewer(4), *interval, ("label of one letter", F.exists(F.slice("f", 4, F.greatest(F.size("f") - 3, F.lit(0))), lambda c: F.length(c) != 2))]),
        "iht": (space, "^#", [_fewer(5), *interval, ("label without two parts", ~_field(3).rlike(r"^.[|/].$"))]),
        "paf": (tab, "^$", [_fewer(12), ("block length is no number", _no_long(10)), ("no edit distance", ~F.exists("f", lambda x: x.startswith("NM:i:")))]),
        "sam": (tab, "^@", [_fewer(11), ("position is no number", _no_long(3)), ("bad alignment", ~_field(5).rlike(r"^(\*|([0-9]+[MIDNSHP=X])+)$"))]),
        "fai": (tab, "^$", [_fewer(2), ("length is no number", _no_long(1))]),
        "mash": (space, "^#", [_fewer(3), ("site without five parts", F.size(F.split(_field(0), ":")) != 5)]),
        "regions": (space, "^#", [("no chrom:start-end", ~_field(0).rlike(r"^.+:[0-9]+-[0-9]+$"))]),
        "sites": (tab, "^(site_id|CHROM)", [_fewer(3), ("position is no number", _no_long(2))]),
    }
    if kind not in made:
        raise ValueError(f"unknown format {kind}: one of {', '.join(sorted(made))}")
    return made[kind]


FORMATS = ("bed", "ped", "vcf", "inheritance", "iht", "paf", "sam", "fai", "mash", "regions", "sites")


def checked(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(value, reason) of every record line: the first reason for which it is bad, null if it is good; blank lines and headers are no records."""
    separator, head, rules = _rules(kind)
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").rlike(head))
    reason: Column | None = None
    for name, bad in rules:
        test = F.coalesce(bad, F.lit(False))
        reason = F.when(test, name) if reason is None else reason.when(test, name)
    text = F.trim("value") if separator == r"\s+" else F.col("value")
    return lines.withColumn("f", F.split(text, separator)).select("value", reason.alias("reason"))


def counted(rows: DataFrame, kind: str) -> tuple[DataFrame, Observation]:
    """``rows`` of ``checked`` as they are, and how many lines, bad ones and ones of each reason pass: to be asked for after an action."""
    watch = Observation(f"lines of {kind}")
    reasons = [name for name, _ in _rules(kind)[2]]
    return rows.observe(watch, F.count(F.lit(1)).alias("lines"), F.count("reason").alias("bad"), *[F.count_if(F.col("reason") == r).alias(r) for r in reasons]), watch
