"""Near copies of the pipeline against brute force."""

import numpy as np
import pytest

import corpus_pipeline
from kinweave.llm import nearcopies

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def grams(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute(texts):
    """The smallest index of each text's component."""
    sets, root = [grams(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n * 5 >= (len(sets[i]) + len(sets[j]) - n) * 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def edited(rng, text, n):
    w = text.split()
    for i in rng.choice(len(w), n, replace=False):
        w[i] = f"x{rng.integers(1 << 30)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def planted():
    rng = np.random.default_rng(3)
    fresh = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 5000, n))
    texts = [fresh(int(n)) for n in rng.integers(1, 300, 60)]
    texts += [edited(rng, t, int(k)) for t in texts[:50] if len(t.split()) > 60 for k in (1, 2, 4, 8)]
    base = fresh(200)
    return texts + [base] + [edited(rng, base, int(rng.integers(1, 5))) for _ in range(120)] + ["", "a B", "A  b"]


@pytest.mark.parametrize("crowd", [8, 48])
def test_planted_near_copies_go(spark, planted, crowd):
    want = brute(planted)
    df = spark.createDataFrame(list(enumerate(planted)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in nearcopies.cluster(df, crowd=crowd).collect()}
    assert [got[i] for i in range(len(planted))] == want


def template(n, shared, own, pair, seed):
    """Texts around one long passage, two and two with some words more in common."""
    rng = np.random.default_rng(seed)
    fresh = lambda k: [f"w{x}" for x in rng.integers(0, 1 << 40, k)]
    base, out = fresh(shared), []
    for _ in range(n // 2):
        both = fresh(pair)
        out += [" ".join(base + both + fresh(own)) for _ in range(2)]
    return out


@pytest.mark.parametrize("crowd, block", [(48, 512), (8, 16), (200, 64)])
def test_pairs_among_texts_of_one_template(spark, crowd, block):
    """Pairs just above the bar among 300 texts that are just below it: all are found, whatever counts as a crowd."""
    texts = template(300, 350, 33, 12, 1) + template(120, 350, 45, 10, 2)
    want = brute(texts)
    assert 100 < len(texts) - len(set(want)) < 300
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in nearcopies.cluster(df, crowd=crowd, block=block).collect()}
    assert [got[i] for i in range(len(texts))] == want


@pytest.mark.parametrize("crowd", [8, 30])
def test_texts_of_frequent_shingles_only(spark, crowd):
    """Texts put together from a few passages, so that all their shingles are frequent: similar ones share no rare shingle."""
    rng = np.random.default_rng(6)
    passage = [" ".join(f"p{k}w{i}" for i in range(40)) for k in range(18)]
    texts = sorted({" ".join(passage[k] for k in sorted(rng.choice(18, 12, replace=False))) for _ in range(260)})
    want = brute(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in nearcopies.cluster(df, crowd=crowd, block=20).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert 1 < len(set(want)) < len(texts)


def test_stage_takes_near_copies(spark, planted):
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(planted)], DOCS)
    got = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, df, "").collect())
    assert got == sorted(set(brute(planted)))


def test_odd(spark):
    rows = [(None, "one two", "", "", 0), (4, "One two", "", "", 0), (4, "One two", "", "", 0), (5, None, "", "", 0), (6, " ", "", "", 0), (7, "one two three", "", "", 0)]
    got = nearcopies.deduplicate(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(r["doc_id"] for r in got) == [4, 4, 5, 7]
    assert nearcopies.cluster(spark.createDataFrame([], DOCS)).count() == 0


def test_long_texts_in_blocks():
    """Fingerprints, marks and sets are those of the whole text however it is cut, and need little more than the text."""
    import random
    import tracemalloc

    from kinweave.llm import common, simhash

    rng = random.Random(2)
    sep = [" ", "  ", "\n", "\t", " \x0b", "\x1c", " "]
    for n in (0, 1, 2, 3, 4, 5, 6, 40, 400):
        text = "".join("Ab" * rng.randrange(1, 6) + str(rng.randrange(30)) + rng.choice(sep) for _ in range(n))
        words = text.encode().lower().split()
        for most in (1, 7, 64, 1 << 20):
            assert [w for part in common.word_lists(text, most) for w in part] == words
            assert simhash.fingerprint(text, 3, 42, most) == simhash.fingerprint(text)
            got = list(simhash.hash_blocks(text, 5, 0, most))
            assert (np.concatenate(got).tolist() if got else []) == (simhash.shingle_hashes(words, 5, 0).tolist() if words else [])
    assert nearcopies.mark("One  two\nthree") == nearcopies.mark("one two THREE ") != nearcopies.mark("one twothree")
    long = "some words that come again and again " * 400_000  # 15 MB
    tracemalloc.start()
    simhash.fingerprint(long)
    nearcopies.mark(long)
    nearcopies.shingles(long)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * len(long) + 100_000_000


def test_near_fingerprints_are_links(spark):
    """Every pair within two bits is in one component, also where the sets of shingles differ: here one line that repeats outweighs the rest."""
    from kinweave.llm.simhash import fingerprint

    rng = np.random.default_rng(8)
    fresh = lambda k: " ".join(f"w{x}" for x in rng.integers(0, 1 << 40, k))
    line = fresh(10)
    texts = [fresh(40) for _ in range(20)] + [f"{' '.join([line] * 60)} {fresh(20)}" for _ in range(70)]
    fps = [fingerprint(t) for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    assert near and all(len(grams(texts[i]) & grams(texts[j])) < 0.8 * len(grams(texts[i])) for i, j in near)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in nearcopies.cluster(df, fingerprints=True).collect()}
    assert all(got[i] == got[j] for i, j in near)
    assert [got[i] for i in range(20)] == list(range(20))
