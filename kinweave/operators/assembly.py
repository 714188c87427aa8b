"""Concordance of assembled haplotypes: projecting regions through alignments and comparing sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import reverse_complement
from .intervals import overlap_join


def project(cigar: Column, start: Column, target: Column) -> Column:
    """The query position of a target position under an alignment from ``start`` on (S11); null outside.

    ``cigar`` is array<(op, len)>.  Inside a deletion it is the position where
    the deletion stands.
    """
    # t and q walk along; once the target is reached, at is set
    zero = F.struct(start.cast("long").alias("t"), F.lit(0).cast("long").alias("q"), F.lit(None).cast("long").alias("at"))

    def step(a: Column, x: Column) -> Column:
        both, query, ref = x["op"].isin("M", "=", "X"), x["op"].isin("I", "S"), x["op"].isin("D", "N")
        inside = a["at"].isNull() & (both | ref) & (target >= a["t"]) & (target < a["t"] + x["len"])
        at = F.when(inside, F.when(both, a["q"] + target - a["t"]).otherwise(a["q"])).otherwise(a["at"])
        return F.struct(
            (a["t"] + F.when(both | ref, x["len"]).otherwise(0)).alias("t"), (a["q"] + F.when(both | query, x["len"]).otherwise(0)).alias("q"), at.alias("at")
        )

    return F.aggregate(cigar, zero, step, lambda a: a["at"])


def parse_cigar(text: Column) -> Column:
    """``10M2D5M`` as array<(op, len)>."""
    parts = F.regexp_extract_all(text, F.lit("([0-9]+[MIDNSHP=X])"), 1)
    return F.transform(parts, lambda p: F.struct(F.right(p, F.lit(1)).alias("op"), F.regexp_extract(p, "^[0-9]+", 0).cast("long").alias("len")))


def slice_query(seq: Column, q_start: Column, q_end: Column, reverse: Column) -> Column:
    """The query bases from ``q_start`` to ``q_end``, both in; null if out of range; turned if asked."""
    ok = (q_start >= 0) & (q_end >= q_start) & (q_end < F.length(seq))
    part = F.substr(seq, (q_start + 1).cast("int"), (q_end - q_start + 1).cast("int"))
    return F.when(ok, F.when(reverse, reverse_complement(part)).otherwise(part))


def target_range(cigar: Column, start: Column, t_start: Column, t_end: Column) -> Column:
    """(q_start, q_end) of the query for the target from ``t_start`` to ``t_end``, both in, under an alignment from ``start`` on.

    Soft clips and insertions move the query only, a skipped region the target
    only.  A start inside a deletion is where the deletion stands, and an
    alignment that begins after ``t_start`` gives its first base.  A start that is
    never reached is -1, an end that isn't is the query's length.
    """
    none = F.lit(None).cast("long")
    zero = F.struct(start.cast("long").alias("t"), F.lit(0).cast("long").alias("q"), none.alias("a"), none.alias("z"))

    def step(s: Column, x: Column) -> Column:
        both, query, deleted, ref = x["op"].isin("M", "=", "X"), x["op"].isin("I", "S"), x["op"] == "D", x["op"].isin("D", "N")
        end = s["t"] + x["len"]
        first = F.when(both, s["q"] + F.greatest(t_start - s["t"], F.lit(0))).when(deleted, s["q"])
        last = F.when(both, s["q"] + F.least(t_end - s["t"], x["len"])).when(deleted, s["q"])
        return F.struct(
            (s["t"] + F.when(both | ref, x["len"]).otherwise(0)).alias("t"), (s["q"] + F.when(both | query, x["len"]).otherwise(0)).alias("q"),
            F.coalesce(s["a"], F.when(end > t_start, first)).alias("a"), F.coalesce(s["z"], F.when(end >= t_end, last)).alias("z"),
        )

    return F.aggregate(cigar, zero, step, lambda s: F.struct(F.coalesce(s["a"], F.lit(-1)).alias("q_start"), F.coalesce(s["z"], s["q"]).alias("q_end")))


def target_length(cigar: Column) -> Column:
    """How many target bases an alignment covers."""
    return F.aggregate(cigar, F.lit(0).cast("long"), lambda n, x: n + F.when(x["op"].isin("M", "D", "N", "=", "X"), x["len"]).otherwise(0))


def region_sequences(contigs: DataFrame, regions: DataFrame, turn: bool = False) -> DataFrame:
    """(region, sample, hap, seq): what each contig has in each region that it overlaps.

    ``contigs`` has sample, hap (1 or 2), chrom, pos0, cigar (text), seq, reverse;
    ``regions`` region, chrom, s, e.  Contigs that don't reach across a region's
    begin, or end with it, have nothing there.  With ``turn`` those on the reverse
    strand are turned.
    """
    placed = contigs.withColumn("_ops", parse_cigar(F.col("cigar"))).select("chrom", F.col("pos0").alias("s"), (F.col("pos0") + target_length(F.col("_ops"))).alias("e"), "sample", "hap", "_ops", "seq", "reverse")
    met = overlap_join(regions.select("chrom", "s", "e", "region"), placed).withColumn("_q", target_range(F.col("b__ops"), F.col("b_s"), F.col("s"), F.col("e")))
    part = slice_query(F.col("b_seq"), F.col("_q.q_start"), F.col("_q.q_end"), F.col("b_reverse") & F.lit(turn))
    return met.select("region", F.col("b_sample").alias("sample"), F.col("b_hap").alias("hap"), part.alias("seq")).where("seq is not null")


def haplotypes(sequences: DataFrame, regions: DataFrame, samples: list[tuple[str, bool]]) -> DataFrame:
    """(region, sample, haps, problem) of every sample in every region: its two sequences in order, or why there are none.

    ``samples`` lists (sample, is male).  More than one contig of an assembly is
    ``multi``, none is ``missing``; on a male's X the one sequence there is stands
    for both.
    """
    own = sequences.groupBy("region", "sample").agg(*[F.collect_list(F.when(F.col("hap") == h, F.col("seq"))).alias(f"h{h}") for h in (1, 2)])
    every = regions.select("region", "chrom", F.inline(F.array(*[F.struct(F.lit(s).alias("sample"), F.lit(m).alias("male")) for s, m in samples])))
    both = every.join(own, ["region", "sample"], "left").withColumns({h: F.coalesce(h, F.array().cast("array<string>")) for h in ("h1", "h2")})
    alone = F.col("male") & F.col("chrom").isin("X", "chrX", "ChrX") & (F.size("h1") + F.size("h2") == 1)
    both = both.withColumn("all", F.concat("h1", "h2"))
    both = both.withColumns({h: F.when(alone, F.col("all")).otherwise(F.col(h)) for h in ("h1", "h2")})
    problem = F.when((F.size("h1") > 1) | (F.size("h2") > 1), "multi").when((F.size("h1") < 1) | (F.size("h2") < 1), "missing")
    return both.select("region", "sample", F.when(problem.isNull(), F.array_sort(F.concat("h1", "h2"))).alias("haps"), problem.alias("problem"))


def concordance(haps: DataFrame, labels: DataFrame, father: str, mother: str) -> DataFrame:
    """(region, concordant, config, n_missing, n_multi, in_block) of each region with assembled haplotypes.

    ``labels`` has region, sample, h0, h1 (A to D) of the inheritance block that
    the region lies in.  A region with a problem, or in no block, is not concordant;
    otherwise it is if one of four configurations (0: the parents' sequences as
    they are, 1: the father's swapped, 2: both, 3: the mother's) explains the two
    sequences of all samples; ``config`` is the first that does.
    """
    counts = haps.groupBy("region").agg(
        F.count_if(F.col("problem") == "missing").alias("n_missing"), F.count_if(F.col("problem") == "multi").alias("n_multi"),
        F.max(F.when(F.col("sample") == father, F.col("haps"))).alias("_f"), F.max(F.when(F.col("sample") == mother, F.col("haps"))).alias("_m"),
    )
    seen = haps.where("haps is not null").join(labels, ["region", "sample"]).groupBy("region").agg(F.collect_list(F.struct("haps", "h0", "h1")).alias("_seen"))
    block = labels.select("region").distinct().withColumn("in_block", F.lit(True))
    rows = counts.join(seen, "region", "left").join(block, "region", "left").withColumn("in_block", F.coalesce("in_block", F.lit(False)))
    config = F.lit(None).cast("int")
    for k, (father_swaps, mother_swaps) in reversed(list(enumerate([(0, 0), (1, 0), (1, 1), (0, 1)]))):
        of = {"A": F.get("_f", father_swaps), "B": F.get("_f", 1 - father_swaps), "C": F.get("_m", mother_swaps), "D": F.get("_m", 1 - mother_swaps)}
        seq = lambda h: F.when(h == "A", of["A"]).when(h == "B", of["B"]).when(h == "C", of["C"]).when(h == "D", of["D"])  # noqa: B023, E731
        fits = F.forall("_seen", lambda x: F.array_sort(F.array(seq(x["h0"]), seq(x["h1"]))) == x["haps"])
        config = F.when(F.coalesce(fits, F.lit(False)), k).otherwise(config)
    sound = (F.col("n_missing") + F.col("n_multi") == 0) & F.col("in_block") & (F.size("_seen") > 0)
    made = rows.withColumn("config", F.when(sound, config))
    return made.select("region", F.col("config").isNotNull().alias("concordant"), "config", "n_missing", "n_multi", "in_block")
