"""How much the sources of a language differ in their words: joint count histograms.

Terms are runs of letters and non-ASCII characters, ASCII letters lower-cased.
Of each language the terms in ``min_docs`` of its documents are kept.  A group
(language, source), and a language as a whole, gives a kept term the share
p = 1 + floor(scale * (count + smooth) / (N + smooth * V)), N the sum of its
counts, V the number of kept terms, in whole numbers throughout.

Two sources of a language differ by the sum of f = |p - q| over all kept terms.
For each pair the combinations (count here, count there) are tallied, and f is
evaluated once for each combination and multiplied.  Cells with a zero follow
from what is known: terms with count x here and none there are those with x here
less those of the tally with x here, and likewise for the others, so only terms
that both have are tallied.  As f sums over terms, tasks tally a part of a
language's terms each, for two blocks of its sources; no task holds a language.

Defined results: a null text, language or source is empty; a group without terms
takes part with counts of zero; equal rows are documents of their own; a text of
any length is read in blocks; an empty table has no groups; other columns are
not read.  Ties go to the smaller item in UTF-8 order.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, column, cut, small

SCALE, SMOOTH, MIN_DOCS = 1_000_000_000, 5, 30
#: Cells a task tallies, and sources a block has, both on average.
CELLS, SOURCES = 50_000, 64
#: ASCII letters in lower case, other ASCII as spaces, all else as it is.
LETTERS = bytes(i if i > 127 or 97 <= i <= 122 else i + 32 if 65 <= i <= 90 else 32 for i in range(256))

COUNTED = "lang string, source string, term string, n long, docs long"


def counted(docs: DataFrame, most: int = 400_000) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, of a part of the rows each; what a task holds is bounded by ``most``."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def flush(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = pa.array(list(n), pa.binary()).view(pa.string())
            same = [pa.repeat(pa.scalar(x, pa.string()), len(n)) for x in (lang, source)]
            yield pa.RecordBatch.from_arrays([*same, terms, pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())], schema=schema)
        held.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in small(batches):
            for i, key in enumerate(zip(column(batch, "lang").to_pylist(), column(batch, "source").to_pylist())):
                n, docs = held.setdefault(key, (Counter(), Counter()))
                seen: set[bytes] = set()
                for block in blocks(batch, i, LETTERS):
                    words = block.split()
                    n.update(words)
                    seen.update(words)
                docs.update(seen)
            if sum(len(n) for n, _ in held.values()) > most:
                yield from flush(held)
        yield from flush(held)

    named = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text")
    return named.mapInArrow(run, COUNTED)


def kept_cells(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n, all): the counts of the kept terms that aren't zero, and their counts in the whole language."""
    by_term = Window.partitionBy("lang", "term")
    # one shuffle: groups and windows are within what is dealt out by language and term
    summed = counted(docs).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    both = summed.select("lang", "source", "term", "n", F.sum("n").over(by_term).alias("all"), F.sum("docs").over(by_term).alias("docs"))
    return both.where(F.col("docs") >= min_docs).drop("docs")


def share(n: Column, total: Column, kinds: Column, scale: int = SCALE, smooth: int = SMOOTH) -> Column:
    """1 + floor(scale * (n + smooth) / (total + smooth * kinds)) in whole numbers of any size; null without terms."""
    whole = lambda c: c.cast("decimal(19,0)")
    top, low = whole(n + smooth) * F.lit(scale).cast("decimal(10,0)"), whole(total + F.lit(smooth) * kinds)
    return F.call_function("div", top, F.nullif(low, F.lit(0).cast("decimal(19,0)"))) + 1


def group_table(docs: DataFrame, cells: DataFrame) -> DataFrame:
    """(lang, source, total, kinds, all_total, cells, sources): every group that occurs, with the figures of its language."""
    found = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    mine = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("held"))
    kinds = cells.groupBy("lang", "term").agg(F.max("all").alias("all")).groupBy("lang").agg(F.count(F.lit(1)).alias("kinds"), F.sum("all").alias("all_total"))
    whole = found.join(mine, ["lang", "source"], "left").groupBy("lang").agg(F.count(F.lit(1)).alias("sources"), F.coalesce(F.sum("held"), F.lit(0)).alias("cells"))
    out = found.join(mine, ["lang", "source"], "left").join(whole, "lang").join(kinds, "lang", "left")
    return out.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "kinds", "all_total")], "cells", "sources")


def shares(counts: np.ndarray, total: int, kinds: int, scale: int, smooth: int) -> np.ndarray:
    """As ``share``, of an array."""
    low = int(total) + smooth * int(kinds)
    return np.array([1 + scale * (int(c) + smooth) // low if low else 0 for c in counts], dtype=np.int64)


def _pairs(names: np.ndarray, block: np.ndarray, low: int, high: int) -> Iterator[tuple[int, int]]:
    """Places of the sources that this task compares: within a block each two once, of two blocks each of the one with each of the other."""
    for i in range(len(names)):
        for j in range(len(names)):
            if (i < j) if low == high else (block[i] == low and block[j] == high):
                yield i, j


class _Source:
    def __init__(self, part: pd.DataFrame, scale: int, smooth: int):
        first = part.iloc[0]
        values, self.at = np.unique(part["n"].to_numpy(), return_inverse=True)
        self.total, self.kinds = int(first["total"]), int(first["kinds"])
        self.p = shares(values, self.total, self.kinds, scale, smooth)
        self.zero = int(shares(np.zeros(1), self.total, self.kinds, scale, smooth)[0])
        self.part = part


def tally(part: pd.DataFrame, scale: int = SCALE, smooth: int = SMOOTH) -> pd.DataFrame:
    """What the terms that both sources of a pair have add to its value, beyond what they add as terms of one of them."""
    lang, low, high = part["lang"].iloc[0], int(part["low"].iloc[0]), int(part["high"].iloc[0])
    term, kinds = pd.factorize(part["term"])
    part = part.assign(at=term)
    names, sources = [], []
    for name, rows in part.groupby("source", sort=True):
        names.append(name)
        sources.append(_Source(rows, scale, smooth))
    block = np.array([s.part["block"].iloc[0] for s in sources])
    out, last, where = [], -1, np.full(len(kinds), -1)
    for i, j in _pairs(np.array(names, dtype=object), block, low, high):
        a, b = sources[i], sources[j]
        if i != last:
            where[:] = -1
            where[a.part["at"].to_numpy()] = a.at
            last = i
        met = where[b.part["at"].to_numpy()]
        both = met >= 0
        if not both.any():
            continue
        combination, times = np.unique(met[both] * len(b.p) + b.at[both], return_counts=True)
        p, q = a.p[combination // len(b.p)], b.p[combination % len(b.p)]
        f = np.abs(p - q) - np.abs(p - b.zero) - np.abs(a.zero - q) + abs(a.zero - b.zero)
        out.append((lang, names[i], names[j], int((times * f).sum())))
    return pd.DataFrame(out, columns=["lang", "a", "b", "value"])


def margins(part: pd.DataFrame, scale: int = SCALE, smooth: int = SMOOTH) -> pd.DataFrame:
    """The value of each pair if no term were in both: from how many terms (``times``) each source has with each count."""
    lang, low, high = part["lang"].iloc[0], int(part["low"].iloc[0]), int(part["high"].iloc[0])
    names, sources = [], []
    for name, rows in part.groupby("source", sort=True):
        names.append(name)
        one = _Source(rows, scale, smooth)
        one.times = np.bincount(one.at, rows["times"].to_numpy(), len(one.p)).astype(np.int64)
        sources.append(one)
    block = np.array([s.part["block"].iloc[0] for s in sources])
    out = []
    for i, j in _pairs(np.array(names, dtype=object), block, low, high):
        a, b = sources[i], sources[j]
        one = (a.times * np.abs(a.p - b.zero)).sum() + (b.times * np.abs(b.p - a.zero)).sum()
        rest = a.kinds - int(a.times.sum()) - int(b.times.sum())
        out.append((lang, names[i], names[j], int(one) + rest * abs(a.zero - b.zero)))
    return pd.DataFrame(out, columns=["lang", "a", "b", "value"])


def pair_values(cells: DataFrame, groups: DataFrame, scale: int = SCALE, smooth: int = SMOOTH, per_task: int = CELLS, per_block: int = SOURCES) -> DataFrame:
    """(lang, source, item, value) of each two sources of a language, both ways."""
    n_blocks = F.ceil(F.col("sources") / per_block).cast("int")
    placed = groups.withColumn("n_blocks", n_blocks).withColumn("block", F.pmod(F.xxhash64("source"), F.col("n_blocks")).cast("int"))
    placed = placed.withColumn("parts", F.ceil((F.col("cells") + 1) / per_task).cast("long"))
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other")
    ends = [F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")]

    def meet(rows: DataFrame, columns: list[str]) -> DataFrame:
        return rows.select(*columns, "block", other).select(*columns, "block", *ends)

    result = "lang string, a string, b string, value long"
    of_cells = cells.join(placed, ["lang", "source"]).withColumn("part", F.pmod(F.xxhash64("term"), F.col("parts")))
    both = meet(of_cells, ["lang", "source", "term", "n", "total", "kinds", "part"]).groupBy("lang", "low", "high", "part")
    counts = cells.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("times"))
    of_counts = placed.join(counts, ["lang", "source"], "left").select("*", F.lit(0).alias("part")).fillna(0, ["n", "times"])
    single = meet(of_counts, ["lang", "source", "n", "times", "total", "kinds"]).groupBy("lang", "low", "high")
    found = single.applyInPandas(lambda x: margins(x, scale, smooth), result).unionByName(both.applyInPandas(lambda x: tally(x, scale, smooth), result))
    summed = found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    return summed.select("lang", F.explode(ways).alias("way"), "value").select("lang", "way.source", "way.item", "value")


def term_values(cells: DataFrame, groups: DataFrame, scale: int = SCALE, smooth: int = SMOOTH) -> DataFrame:
    """(lang, source, item, value) of the terms that a source has with a larger share than its language."""
    whole = cells.join(groups.select("lang", "source", "total", "kinds", "all_total"), ["lang", "source"])
    p, q = share(F.col("n"), F.col("total"), F.col("kinds"), scale, smooth), share(F.col("all"), F.col("all_total"), F.col("kinds"), scale, smooth)
    return whole.select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = 50, scale: int = SCALE, smooth: int = SMOOTH, per_task: int = CELLS, per_block: int = SOURCES) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` the other sources by how much they differ, ``term`` the terms that stand out."""
    cells = cut(kept_cells(docs, min_docs))
    groups = cut(group_table(docs, cells))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_values(cells, groups, scale, smooth, per_task, per_block).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(best).alias("rank"))
    terms = term_values(cells, groups, scale, smooth).select("lang", "source", F.lit("term").alias("part"), "item", "value", F.row_number().over(best).alias("rank"))
    return pairs.unionByName(terms.where(F.col("rank") <= top_terms))
