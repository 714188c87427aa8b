"""Interval algebra against sets of bases."""

from hypothesis import HealthCheck, Phase, example, given, settings
from hypothesis import strategies as st

from kinweave.operators import intervals as iv

SETS = st.lists(st.tuples(st.sampled_from(["a", "b"]), st.integers(0, 60), st.integers(0, 12)).map(lambda x: (x[0], x[1], x[1] + x[2])), max_size=12)
SLOW = settings(max_examples=5, deadline=None, derandomize=True, phases=(Phase.explicit, Phase.generate), suppress_health_check=[HealthCheck.function_scoped_fixture])


def frame(spark, rows):
    return spark.createDataFrame(rows, "chrom string, s long, e long")


def bases(rows):
    return {(c, i) for c, s, e in rows for i in range(s, e)}


def rows_of(df):
    return [(r["chrom"], r["s"], r["e"]) for r in df.collect()]


@SLOW
@example(a=[("a", 16, 16), ("a", 44, 44), ("a", 16, 16)], b=[])
@given(a=SETS, b=SETS)
def test_bases(spark, a, b):
    x, y = frame(spark, a), frame(spark, b)
    merged = rows_of(iv.merge(x, size=4))
    assert bases(merged) == bases(a)
    assert sorted(rows_of(iv.merge(frame(spark, merged), size=4))) == sorted(merged)
    left, met = rows_of(iv.subtract(x, y, size=4)), rows_of(iv.intersect(x, y, size=4))
    assert bases(left) == bases(a) - bases(b)
    assert bases(met) == bases(a) & bases(b)
    assert bases(rows_of(iv.multi_intersect([x, y]))) == bases(a) & bases(b)


@SLOW
@given(a=SETS, b=SETS)
def test_pairs(spark, a, b):
    x, y = frame(spark, a), frame(spark, b)
    want = sorted((*p, q[1], q[2]) for p in a for q in b if p[0] == q[0] and p[1] < q[2] and q[1] < p[2])
    for wide in (None, 2):
        got = iv.overlap_join(x, y, size=3, wide=wide)
        assert sorted((r["chrom"], r["s"], r["e"], r["b_s"], r["b_e"]) for r in got.collect()) == want
    assert iv.overlap_join(x, y, how="left", size=3).count() == len(want) + sum(not any(p[0] == q[0] and p[1] < q[2] and q[1] < p[2] for q in b) for p in a)


def test_empty(spark):
    none = frame(spark, [])
    some = frame(spark, [("a", 1, 5)])
    assert rows_of(iv.merge(none)) == [] and rows_of(iv.subtract(some, none)) == [("a", 1, 5)] and rows_of(iv.intersect(none, some)) == []
    assert iv.coverage(some, none).first()["fraction"] == 0


def test_nulls_and_equal_rows_stay(spark):
    """A null in any other column loses no row, and equal rows keep their number, however the rows are dealt out."""
    a = [("c", 0, 10, None), ("c", 0, 10, "x"), ("c", 0, 10, "x"), ("c", 20, 30, None), ("c", 20, 30, None), (None, 1, 5, "y")]
    x = spark.createDataFrame(a, "chrom string, s long, e long, name string").repartition(3, "name")
    y = frame(spark, [("c", 5, 8), ("c", 6, 9), ("c", 28, 40)])
    named = lambda df, *more: sorted(map(repr, df.select("chrom", "s", "e", "name", *more).collect()))
    want = lambda rows, *more: sorted(map(repr, spark.createDataFrame(rows, ", ".join(["chrom string, s long, e long, name string", *more])).collect()))
    assert named(iv.keep_overlapping(x, y)) == want(a[:5])
    assert named(iv.count_overlaps(x, y), "n") == want([(*a[0], 2), (*a[1], 2), (*a[3], 1), (*a[5], 0)], "n long")
    assert named(iv.coverage(x, y), "covered") == want([(*a[0], 4), (*a[1], 4), (*a[3], 2), (*a[5], 0)], "covered long")
    left = [("c", s, e, n) for _, s0, _, n in a[:5] for s, e in (((0, 5), (9, 10)) if s0 == 0 else ((20, 28),))]
    assert named(iv.subtract(x, y)) == want([*left, a[5]])
    assert named(iv.overlap_join(x, y, how="left"), "b_s") == want([(*r, b) for r in a[:3] for b in (5, 6)] + [(*r, 28) for r in a[3:5]] + [(*a[5], None)], "b_s long")
    assert named(iv.uncovered(x, y)) == want([a[5]])


def test_sites_outside_blocks_with_nulls(spark):
    from kinweave.operators import concordance

    sites = spark.createDataFrame([("c", 5, None), ("c", 5, 1), ("c", 50, None)], "chrom string, pos0 long, qual int")
    blocks = spark.createDataFrame([("c", 0, 0, 10)], "chrom string, b long, start_pos long, end_pos long")
    assert [r["pos0"] for r in concordance.outside_blocks(sites, blocks).collect()] == [50]


def test_smooth_makes_no_tiles_between_regions(spark):
    """Two regions so far apart that the tiles of the span between them are more than an array holds."""
    from kinweave.operators import intervals as iv

    rows = [("c", 0, 150), ("c", 10**12, 10**12 + 200), ("c", 10**12 + 200, 10**12 + 210), ("d", 5, 5)]
    got = iv.smooth(spark.createDataFrame(rows, "chrom string, s long, e long"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute_smooth(rows))


def brute_smooth(rows, width=100, step=50, least=0.75, longer=50):
    """By tiles that a region reaches into; regions are apart or book-ended."""
    out = []
    for c in {r[0] for r in rows}:
        merged = []
        for _, s, e in sorted(r for r in rows if r[0] == c):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        low, high = merged[0][0], max(e for _, e in merged)
        for s, e in merged:
            near = {low + k * step for k in range((s - low) // step - 4, (e - low) // step + 4) if k >= 0 and low + k * step < high}
            bad = set()
            for ts in near:
                te = min(ts + width, high)
                if sum(max(0, min(te, y) - max(ts, x)) for x, y in merged) / (te - ts) < least:
                    bad |= set(range(max(ts, s), min(te, e)))
            run = []
            for p in [*range(s, e), None]:
                if p is not None and p not in bad:
                    run.append(p)
                elif run:
                    out.append((c, run[0], run[-1] + 1))
                    run = []
    return [x for x in out if x[2] - x[1] > longer]
