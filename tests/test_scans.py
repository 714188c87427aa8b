"""Scans over bins against scans over whole chromosomes."""

import itertools
import random

from pyspark.sql import functions as F

from kinweave.operators import hapmap, hmm, intervals
from kinweave.operators.scans import neighbour


def test_neighbours_runs_and_blocks_across_bins(spark):
    rng = random.Random(3)
    rows = [(c, p, rng.choice([1, 1, 1, 2, None])) for c in "ab" for p in sorted(rng.sample(range(400), 90))]
    df = spark.createDataFrame(rows, "chrom string, pos0 long, state long").repartition(3)
    binned = df.withColumn("_bin", F.expr("floor(pos0 / 7)"))
    for after in (False, True):
        got = {(r["chrom"], r["pos0"]): r["near"] for r in neighbour(binned, ["chrom"], "_bin", ["pos0"], {"near": F.col("pos0")}, after=after).collect()}
        for c in "ab":
            at = [p for x, p, _ in rows if x == c]
            assert [got[c, p] for p in at] == ([*at[1:], None] if after else [None, *at[:-1]])
    plan = lambda d: sorted(map(repr, d.collect()))
    for f in (hmm.runs, hmm.state_blocks):
        args = (["chrom"], "pos0", "state")
        assert plan(f(df, *args, size=7)) == plan(f(df, *args, size=10**6))
    run, last, want = 0, object(), []
    for c, p, s in (r for r in rows if r[0] == "a"):
        run, last = (run, last) if s == last else (run + 1, s)
        want.append((p, run))
    assert sorted((r["pos0"], r["run"]) for r in hmm.runs(df, ["chrom"], "pos0", "state", size=7).where("chrom = 'a'").collect()) == want


def test_masks_fills_and_collapse_across_bins(spark):
    rng = random.Random(8)
    rows = [(c, b, i, s, x) for c in "ab" for i in "pq" for s in (0, 1) for b in range(60) for x in [rng.choice(["A", "A", "A", "B", None])]]
    df = spark.createDataFrame(rows, "chrom string, b long, id string, slot int, label string").repartition(3)
    masked = {tuple(r)[:4]: r["masked"] for r in hapmap.short_run_mask(df, 3, size=7).collect()}
    filled = {tuple(r)[:4]: r["filled"] for r in hapmap.fill_from_neighbours(df, 3, size=7).collect()}
    assert len(masked) == len(filled) == len(rows)
    for c in "ab":
        for i in "pq":
            for s in (0, 1):
                line = [(b, x) for cc, b, ii, ss, x in rows if (cc, ii, ss) == (c, i, s)]
                known = [(b, x) for b, x in line if x is not None]
                for _, stretch in itertools.groupby(known, key=lambda t: t[1]):
                    at = [b for b, _ in stretch]
                    for k, b in enumerate(at):
                        assert masked[c, b, i, s] == (k + 1 < 3 and len(at) - k < 3)
                for b, x in line:
                    want = ([y for a, y in known if a <= b][-1:] or [y for a, y in known if a >= b][:1] or [None])[0]
                    assert filled[c, b, i, s] == want and (x is not None or not masked[c, b, i, s])
    short = df.where("b < 2")
    assert short.count() == hapmap.fill_from_neighbours(short, 3).where("filled <=> label").count()


def test_collapse_by_stretches_is_the_plain_fold(spark):
    rng = random.Random(9)
    rows = [(c, 10 * k, 10 * k + 5, 1, "".join(rng.choice("AAAB?" if rng.random() < 0.2 else "A????") for _ in range(4))) for c in "ab" for k in range(150)]
    want = []
    for c in "ab":
        for _, s, e, n, x in (r for r in rows if r[0] == c):
            last = want[-1] if want and want[-1][0] == c else None
            if last and all(p == q or "?" in (p, q) for p, q in zip(last[4], x)):
                last[2:] = [e, last[3] + n, "".join(q if p == "?" else p for p, q in zip(last[4], x))]
            else:
                want.append([c, s, e, n, x])
    df = spark.createDataFrame(rows, "chrom string, start_pos long, end_pos long, n_markers long, labels string").repartition(3)
    for size in (30, 1 << 20):
        assert sorted(map(list, hapmap.collapse(df, size).collect())) == want
    assert 5 < len(want) < 150


def test_chunks_summaries_and_ends_across_bins(spark):
    df = spark.createDataFrame([(c, p) for c, n in (("a", 23), ("b", 3)) for p in range(n)], "chrom string, s long")
    by = lambda n, k: [i for i in range(n) for _ in range(k // n + (i < k % n))]
    got = sorted(tuple(r) for r in intervals.chunks(df, 5, ["chrom"], ["s"], size=1).collect())
    assert [x for c, _, x in got if c == "a"] == [i + 1 for i in by(5, 23)] and [x for c, _, x in got if c == "b"] == [1, 2, 3]
    blocks = spark.createDataFrame([("a", 10 * k, 10 * k + 15, [10 * k + 4, 10 * k + 12]) for k in range(6)], "chrom string, start_pos long, end_pos long, support array<long>")
    assert sorted(r["end_pos"] for r in hmm.fix_overlaps(blocks, ["chrom"], size=7).collect()) == [4, 14, 24, 34, 44, 65]
    labels = spark.createDataFrame([("a", "k", 10 * k, 10 * k + 4, "AB"[k % 2], None if k == 2 else "C") for k in range(5)], "chrom string, id string, start_pos long, end_pos long, h0 string, h1 string")
    for size in (10, 1 << 26):
        row = hmm.child_summary(labels, bin_size=size).first()
        assert (row["n_blocks"], row["paternal_switches"], row["maternal_switches"], row["gap_bases"]) == (5, 4, 0, 20)


def test_depths_on_the_edge_of_the_band_are_kept(spark):
    """Two depths, each as often: both lie one deviation from the mean, however the rows are dealt out."""
    from kinweave.operators import hapmap

    rows = spark.range(60 * 700).repartition(7).selectExpr("'c' as chrom", "id % 60 as sample_id", "id as site_id", "if(id div 60 % 2 = 0, id % 60 + 3, 2 * (id % 60) + 100) as dp")
    assert hapmap.depth_band(rows, hapmap.depth_stats(rows)).where("not kept").count() == 0


def test_depth_band_of_unknown_depths_and_samples(spark, tmp_path):
    """As in SQL: rows without a sample or a chromosome go, and a site without a known depth is neither kept nor left out."""
    import duckdb

    from kinweave.plans import registry

    rows = [(0, 1, "a", 3.5), (1, 1, "a", 9.0), (2, 1, "a", None), (3, None, "a", 4.0), (4, 1, None, 4.0), (5, 2, "b", None), (6, 1, "a", 200.0), (7, 1, "a", 5.0), (7, None, "a", 900.0), (7, 3, "a", None)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = registry.QUERIES["depth_band_filter"](spark, str(tmp_path)).collect()
    db = duckdb.connect()
    db.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = db.sql(registry.ORACLES["depth_band_filter"]).fetchall()
    assert len(got) == len(want) and set(map(tuple, got)) == set(want)
    assert {r["site_id"]: r["kept"] for r in got} == {0: True, 1: True, 2: None, 5: None, 6: False, 7: True}
