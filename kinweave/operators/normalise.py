"""Normalising variants: left alignment, trimming, and counts recomputed from the calls."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.readers import CHUNK, fasta_region
from .storage import cut

_ALIGNED = T.StructType([T.StructField("pos0", T.LongType()), T.StructField("ref", T.StringType()), T.StructField("alt", T.StringType()), T.StructField("more", T.BooleanType())])


def align_left(pos: int, ref: str, alt: str, sequence: str, offset: int) -> tuple[int, str, str]:
    """The leftmost way to write a variant, with no more bases than needed.

    ``sequence`` is the reference from ``offset`` on; the variant moves no
    further than its first base.
    """
    while ref and alt:
        if ref[-1] == alt[-1] and (len(ref) > 1 or len(alt) > 1) and (min(len(ref), len(alt)) > 1 or pos > offset):
            ref, alt = ref[:-1], alt[:-1]
            if not ref or not alt:
                pos -= 1
                before = sequence[pos - offset]
                ref, alt = before + ref, before + alt
            continue
        break
    while len(ref) > 1 and len(alt) > 1 and ref[0] == alt[0]:
        pos, ref, alt = pos + 1, ref[1:], alt[1:]
    return pos, ref, alt


def left_align(variants: DataFrame) -> DataFrame:
    """``variants`` (pos0, ref, alt, sequence, offset, ...) with pos0, ref and alt left-aligned, and ``more``: whether only the sequence's begin stopped it."""

    @F.pandas_udf(_ALIGNED)
    def aligned(pos: pd.Series, ref: pd.Series, alt: pd.Series, sequence: pd.Series, offset: pd.Series) -> pd.DataFrame:
        made = [align_left(*x) for x in zip(pos, ref, alt, sequence, offset)]
        more = [o > 0 and p == o and min(len(r), len(a)) == 1 and len(r) != len(a) and r[-1] == a[-1] for (p, r, a), o in zip(made, offset)]
        return pd.DataFrame([(*m, x) for m, x in zip(made, more)], columns=["pos0", "ref", "alt", "more"])

    made = variants.withColumn("_v", aligned("pos0", "ref", "alt", "sequence", "offset"))
    return made.withColumns({c: F.col(f"_v.{c}") for c in ("pos0", "ref", "alt", "more")}).drop("_v")


def split_alternatives(records: DataFrame) -> DataFrame:
    """A row for each alternative of ``records`` (alts), ``alt`` and ``alt_no`` from 1 on."""
    each = F.posexplode("alts").alias("_k", "alt")
    return records.select(*[c for c in records.columns if c not in ("alt", "alt_no")], each).withColumn("alt_no", F.col("_k") + 1).drop("_k", "alts")


def normalise(records: DataFrame, chunks: DataFrame, size: int = CHUNK, reach: int = 64) -> DataFrame:
    """``records`` (chrom, pos0, ref, alts, ...) one alternative a row, in the shortest and leftmost way.

    ``chunks`` is the reference (``read_fasta_chunks``).  ``matches`` says whether
    ``ref`` is what the reference has there; if it isn't, the row stays as it is.
    Letters are compared in upper case.  A variant is looked at with ``reach``
    bases before it; those that arrive at the begin of what they see go on from
    there with eight times as many, until none does, so a shift may cross any
    number of chunks.
    """
    upper = split_alternatives(records).withColumns({"ref": F.upper("ref"), "alt": F.upper("alt")})
    keyed = upper.withColumns({"_s": F.greatest(F.col("pos0") - reach, F.lit(0)), "_e": F.col("pos0") + F.length("ref")})
    plain = F.col("alt").rlike("^[ACGTN]+$") & F.col("ref").rlike("^[ACGTN]+$") & (F.col("pos0") >= 0)

    def seen(rows: DataFrame) -> DataFrame:
        windows = fasta_region(chunks, rows.select("chrom", F.col("_s").alias("s"), F.col("_e").alias("e")), size)
        return rows.join(windows.select("chrom", F.col("s").alias("_s"), F.col("e").alias("_e"), F.upper("sequence").alias("sequence")), ["chrom", "_s", "_e"], "left").withColumn("offset", F.col("_s"))

    first = seen(keyed).withColumn("matches", F.coalesce(F.substr("sequence", (F.col("pos0") - F.col("_s") + 1).cast("int"), F.length("ref")) == F.col("ref"), F.lit(False)))
    first = cut(first)
    names = [*upper.columns, "matches"]
    done = first.where(~(F.col("matches") & plain)).select(*names)
    now = cut(left_align(first.where(F.col("matches") & plain)).select(*names, "more"))
    while True:
        done = done.unionByName(now.where("not more").select(*names))
        left = now.where("more").drop("more")
        if left.isEmpty():
            return done
        reach *= 8
        again = left.withColumns({"_s": F.greatest(F.col("pos0") - reach, F.lit(0)), "_e": F.col("pos0") + F.length("ref")})
        now = cut(left_align(seen(again)).select(*names, "more"))


def allele_counts(gts: Column, n_alts: Column) -> tuple[Column, Column]:
    """(AC by alternative, AN) from an array of genotypes."""
    alleles = F.filter(F.flatten(gts), lambda a: a.isNotNull())
    ac = F.transform(F.sequence(F.lit(1), n_alts), lambda k: F.size(F.filter(alleles, lambda a: a == k)))
    return F.when(n_alts > 0, ac).otherwise(F.array().cast("array<int>")), F.size(alleles)


def trim_alternatives(alts: Column, ac: Column) -> Column:
    """Alternatives that a call carries."""
    return F.filter(alts, lambda a, i: F.get(ac, i) > 0)


def label_combinations(ped: DataFrame, letters: str = "ABCD", most: int = 10) -> DataFrame:
    """(father, mother, combination, id, h0, h1): all ways in which the children of each couple of ``ped`` may have inherited.

    ``ped`` has id, father, mother.  Bits 2j and 2j + 1 of a combination choose the
    paternal and the maternal label of a couple's j-th child by id; the letters are
    the father's two and the mother's two.  A couple has 4 ** children
    combinations, so more than ``most`` children are an error.
    """
    couples = ped.where("father is not null and mother is not null").groupBy("father", "mother").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    n = F.size("ids")
    checked = couples.withColumn("n", F.when(n <= most, n).otherwise(F.raise_error(F.concat(F.lit("too many children of "), "father", F.lit(" and "), "mother"))))
    ways = checked.withColumn("combination", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("shiftleft(1L, 2 * n) - 1"))))
    each = ways.select("father", "mother", "combination", F.posexplode("ids").alias("j", "id"))
    label = lambda k, at: F.when(F.expr(f"(shiftright(combination, 2 * j + {k}) & 1) = 0"), letters[at]).otherwise(letters[at + 1])
    return each.select("father", "mother", "combination", "id", label(0, 0).alias("h0"), label(1, 2).alias("h1"))
