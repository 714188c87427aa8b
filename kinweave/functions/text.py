"""Column functions on sequences, identifiers and region text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reverse_complement(seq: Column) -> Column:
    """Reverse complement of upper-case bases; all else becomes N."""
    return F.reverse(F.translate(F.regexp_replace(seq, "[^ACGT]", "N"), "ACGT", "TGCA"))


def natural_key(text: Column, width: int = 20) -> Column:
    """A key that sorts digits by their number and letters without case."""
    chunks = F.regexp_extract_all(F.lower(text), F.lit("([0-9]+|[^0-9]+)"), 1)
    return F.array_join(F.transform(chunks, lambda c: F.when(c.rlike("^[0-9]"), F.lpad(c, width, "0")).otherwise(c)), "")


def parse_region(text: Column) -> Column:
    """``chr:a-b`` as (chrom, s, e), null if it isn't one (SC21)."""
    part = lambda k: F.nullif(F.regexp_extract(text, r"^([^:]+):(\d+)-(\d+)$", k), F.lit(""))
    return F.when(part(1).isNotNull(), F.struct(part(1).alias("chrom"), part(2).cast("long").alias("s"), part(3).cast("long").alias("e")))


def source_of(variant_id: Column) -> Column:
    """Caller prefix of a structural variant's id: up to the second separator; null if there is none."""
    return F.nullif(F.regexp_extract(variant_id, r"^([^_.:]*[_:.][^_.:]+)", 1), F.lit(""))


def prefix_name(line: Column, prefix: str) -> Column:
    """FASTA header lines with a prefix before the name (2.15)."""
    return F.when(line.startswith(">"), F.concat(F.lit(">" + prefix), F.substr(line, F.lit(2)))).otherwise(line)


def unphase_separators(line: Column) -> Column:
    """``|`` to ``/`` on all but ``##`` lines (2.15)."""
    return F.when(line.startswith("##"), line).otherwise(F.replace(line, F.lit("|"), F.lit("/")))


def normalise_id(variant_id: Column, caller: Column) -> Column:
    """``;`` to ``_``, and the caller in front unless the id names it."""
    clean = F.replace(variant_id, F.lit(";"), F.lit("_"))
    return F.when(F.contains(F.lower(clean), F.lower(caller)), clean).otherwise(F.concat(caller, F.lit("_"), clean))


def edit_or_length(a: Column, b: Column) -> Column:
    """Edit distance of sequences of one length, else the difference of lengths."""
    return F.when(F.length(a) == F.length(b), F.levenshtein(a, b)).otherwise(F.abs(F.length(a) - F.length(b)))
