"""Haplotypes through overlapping variants: chains, all paths, and their sequences.

A region's variants are few (a region is a handful of overlapping calls), but the
number of ways through them is exponential in its forks, and so are the rows.
Ways are numbered: how many lead on from each variant is counted backwards, so
that the k-th way is found without those before it.  Ranges of numbers are dealt
out to tasks, which hold a region's variants and one way.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def variant_kind(ref: str, alt: str) -> str:
    """SNV, DEL, or INS; alleles of one length beyond 1 count as INS."""
    if len(ref) == 1 and len(alt) == 1:
        return "SNV"
    return "DEL" if len(ref) > len(alt) else "INS"


def variant_end(pos: int, ref: str, alt: str) -> int:
    return pos + len(ref) - len(alt) if variant_kind(ref, alt) == "DEL" else pos


def overlaps(variants: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``idx``, the place among the variants of ``keys``, and ``overlap``: OvlNext, OvlPrev or NoOvl.

    A variant overlaps the one before if that ends at or behind its start, which
    for insertions and deletions is the base after the anchor; of one that overlaps
    both neighbours the next counts.  Keys are regions, with few variants each.
    """
    one = (F.length("ref") == 1) & (F.length("alt") == 1)
    start, end = F.col("pos") + F.when(one, 0).otherwise(1), F.col("pos") + F.when(~one & (F.length("ref") > F.length("alt")), F.length("ref") - F.length("alt")).otherwise(0)
    line = Window.partitionBy(*keys).orderBy("pos", "ref", "alt")
    placed = variants.withColumns({"_s": start, "_e": end})
    near = placed.withColumns({"_next": F.lead("_s").over(line), "_before": F.lag("_e").over(line), "idx": F.row_number().over(line)})
    kind = F.when(F.col("_e") >= F.col("_next"), "OvlNext").when(F.col("_before") >= F.col("_s"), "OvlPrev").otherwise("NoOvl")
    return near.withColumn("overlap", kind).drop("_s", "_e", "_next", "_before")


class Ways:
    """All ways, in order, through variants sorted by position that take no two overlapping ones.

    A way goes from a variant to those that begin behind it before any variant
    that it could have taken in between ends.  ``ways[k]`` is the k-th, as places
    of its variants.
    """

    def __init__(self, variants: list[tuple[int, str, str]]):
        start = [p + (variant_kind(r, a) != "SNV") for p, r, a in variants]
        end = [max(variant_end(p, r, a), s) for (p, r, a), s in zip(variants, start)]
        order = sorted(range(len(variants)), key=lambda i: -end[i])
        before = min(start, default=0) - 1
        self.first = before
        self.next: dict[int, list[tuple[int, int]]] = {}  # by where the last variant ends: what may follow, and where that ends
        self.count: dict[int, int] = {}
        ends = [variant_end(p, r, a) for p, r, a in variants]
        for last in [*dict.fromkeys(end[i] for i in order), before]:
            after = [i for i in range(len(variants)) if start[i] > last]
            first_end = min((ends[i] for i in after), default=0)
            self.next[last] = [(i, end[i]) for i in after if start[i] <= first_end]
            self.count[last] = sum(self.count[e] for _, e in self.next[last]) if self.next[last] else 1

    def __len__(self) -> int:
        return self.count[self.first]

    def __getitem__(self, k: int) -> list[int]:
        path, last = [], self.first
        while self.next[last]:
            for i, end in self.next[last]:
                if k < self.count[end]:
                    break
                k -= self.count[end]
            path.append(i)
            last = end
        return path


def haplotype(sequence: str, offset: int, chosen: list[tuple[int, str, str]]) -> str:
    """``sequence``, which begins at ``offset``, with the chosen variants.

    Bases are replaced and deleted first, so that places hold; insertions follow
    from the right.  A reference base that differs from the sequence's is an
    error.
    """
    bases = list(sequence)
    inserts = []
    for pos, ref, alt in chosen:
        at = pos - offset
        kind = variant_kind(ref, alt)
        if kind == "SNV":
            if bases[at].upper() != ref.upper():
                raise ValueError(f"reference {ref} at {pos} is {bases[at]}")
            bases[at] = alt
        elif kind == "DEL":
            for i in range(at + len(alt), min(at + len(ref), len(bases))):
                bases[i] = ""
        else:
            inserts.append((at, alt[len(ref) :] if len(alt) > len(ref) else alt))
    for at, text in sorted(inserts, reverse=True):
        bases.insert(at + 1, text)
    return "".join(bases)


def region_haplotypes(variants: DataFrame, share: int = 4096, with_variants: bool = False) -> DataFrame:
    """(region, path, n_variants, haplotype, complete) of each way through each region's variants, and ``variants`` if asked for.

    ``variants`` has region, sequence, offset, pos, ref, alt.  However many ways
    a region has, all are given, so ``complete`` is true; a task makes ``share`` of
    them at once.
    """
    regions, ranges = _gathered(variants), "region string, sequence string, offset long, found array<struct<pos:long,ref:string,alt:string>>, first long, until long"

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for region, sequence, offset, found in zip(pdf["region"], pdf["sequence"], pdf["offset"], pdf["found"]):
                n, rows = len_of(_sorted(found)), [{"pos": v["pos"], "ref": v["ref"], "alt": v["alt"]} for v in found]
                for low in range(0, n, share * 256):
                    firsts = list(range(low, min(n, low + share * 256), share))
                    yield pd.DataFrame({"region": region, "sequence": sequence, "offset": offset, "found": [rows] * len(firsts), "first": firsts, "until": [min(n, k + share) for k in firsts]})

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for region, sequence, offset, found, first, until in pdf.itertuples(index=False):
                rows = _sorted(found)
                yield _made(region, sequence, offset, rows, Ways(rows), range(first, until), with_variants)

    # so many tasks that small rows, which stand for much work, aren't put together again
    tasks = int(variants.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return regions.mapInPandas(split, ranges).repartition(tasks, "region", "first").mapInPandas(solve, _OUT + (", variants array<struct<pos:long,ref:string,alt:string>>" if with_variants else ""))


def some_haplotypes(variants: DataFrame, wanted: DataFrame) -> DataFrame:
    """As ``region_haplotypes``, of the ways that ``wanted`` (region, path) numbers; those before them are not made."""
    asked = wanted.select(F.col("region").cast("string").alias("region"), F.col("path").cast("long").alias("path")).distinct()
    both = _gathered(variants).join(asked, "region").select("region", "sequence", "offset", "found", "path")

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for region, sequence, offset, found, path in pdf.itertuples(index=False):
                rows = _sorted(found)
                ways = Ways(rows)
                if 0 <= path < len_of(rows, ways):
                    yield _made(region, sequence, offset, rows, ways, [path])

    return both.mapInPandas(solve, _OUT)


_OUT = "region string, path long, n_variants long, haplotype string, complete boolean"


def len_of(rows: list[tuple[int, str, str]], ways: Ways | None = None) -> int:
    """How many ways there are; an error if their numbers don't fit in 64 bits."""
    ways = ways or Ways(rows)
    n = ways.count[ways.first]
    if n >= 1 << 62:
        raise ValueError(f"{n} ways through one region")
    return n


def _sorted(found) -> list[tuple[int, str, str]]:
    return sorted((v["pos"], v["ref"], v["alt"]) for v in found)


def _made(region, sequence, offset, rows, ways: Ways, numbers, with_variants: bool = False) -> pd.DataFrame:
    out = []
    for k in numbers:
        chosen = [rows[i] for i in ways[k]]
        made = (region, k, len(chosen), haplotype(sequence, int(offset), chosen), True)
        out.append((*made, [{"pos": p, "ref": r, "alt": a} for p, r, a in chosen]) if with_variants else made)
    return pd.DataFrame(out, columns=["region", "path", "n_variants", "haplotype", "complete", *(["variants"] if with_variants else [])])


def _gathered(variants: DataFrame) -> DataFrame:
    rows = variants.select(F.col("region").cast("string").alias("region"), "sequence", F.col("offset").cast("long").alias("offset"), F.struct(F.col("pos").cast("long").alias("pos"), "ref", "alt").alias("v"))
    return rows.groupBy("region").agg(F.min_by("sequence", "offset").alias("sequence"), F.min("offset").alias("offset"), F.collect_set("v").alias("found"))
