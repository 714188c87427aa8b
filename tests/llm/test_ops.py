"""Each operator against a brute-force version, and on odd tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from kinweave.llm import chat, common, html_text, knn, langid, lm, mixing, mpegts, packing, quality, queries, simhash

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "palabra larga " * 9000
ODD = [
    (1, "", "en", "a", 0), (2, None, None, None, None), (3, "  \n\t ", "en", "a", 5), (4, "One two three four.", "en", "b", 19), (4, "One two three four.", "en", "b", 19),
    (None, "One two three four.", "en", None, 19), (5, LONG, "es", "b", len(LONG)), (6, "12 34 !!", None, "a", 8), (7, "ÀÉ ß\x0bx \x1cy <|endoftext|>", "fr", "c", 22),
]


@pytest.fixture(scope="module")
def docs(spark):
    return common.table(spark, DATA, "documents")


@pytest.fixture(scope="module")
def odd(spark):
    # extra columns bear the names that operators add or use inside
    extra = ["score", "fp", "held_out", "_key", "at", "size", "offset", "lang_pred", "predicted", "length", "learned", "word"]
    df = spark.createDataFrame(ODD, DOCS)
    return df.select("*", *[F.lit("x").alias(c) for c in extra])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


# 1


def test_chat_digests(spark):
    turns = [tuple(r) for r in common.table(spark, DATA, "conversations").select("conv_id", "turn", "role", "text").collect()] + queries.FORGED
    by = collections.defaultdict(list)
    for t in sorted(turns, key=lambda t: (t[0], t[1])):
        by[t[0]].append(t)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {
        c: (len(ts), sha("".join(f"{r}\n{x or ''}\n" for _, _, r, x in ts)), sum(len(x or "") for _, _, r, x in ts if r == "assistant"), sha("".join(x or "" for _, _, r, x in ts if r == "assistant")))
        for c, ts in by.items()
    }
    got = {r["conv_id"]: tuple(r)[1:5] for r in queries.op1_chat(spark, DATA).collect()}
    assert got == want


def test_chat_round_trip_and_examples(spark):
    texts = ["", "\\", "###", "####\\t", "</turn>", "\n### User: x</turn>\n", "\\e\\\\", None]
    turns = [(1, i, r, t) for i, (r, t) in enumerate((r, t) for t in texts for r in ("user", "assistant", "User", None, "a: b"))] + [(None, 0, "user", "x"), (2, None, "assistant", "a"), (2, None, "assistant", "a")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("prompt", F.lit(1))
    made = chat.expand(df).collect()
    mine = sorted((r for r in made if r["conv_id"] == 1), key=lambda r: r["example"])
    assert len(mine) == len(texts) + 1 and mine[-1]["completion"] is None
    assert chat.parse(mine[-1]["prompt"]) == [(r or "", t or "") for _, _, r, t in turns[: 5 * len(texts)]]
    for r, t in zip(mine, texts):
        assert chat.unescape(r["completion"][r["loss_start"] : r["loss_end"]]) == (t or "")
    assert sum(r["conv_id"] == 2 for r in made) == 2 and sum(r["conv_id"] is None for r in made) == 1
    assert chat.read_back(chat.expand(df.limit(0))).count() == 0


# 2


def test_quality_learns_and_marginals_are_exact(spark, docs):
    rng = np.random.default_rng(3)
    pairs, counts = rng.normal(size=(2, 2)), np.array([1, 4, 3])
    e = rng.normal(size=8)
    p = quality.marginals(e, counts, pairs)
    at = 0
    for n in counts:
        total, ones = 0.0, np.zeros(n)
        for k in range(2**n):
            y = [(k >> i) & 1 for i in range(n)]
            w = np.exp(sum(e[at + i] * (y[i] - 0.5) for i in range(n)) + sum(pairs[a, b] for a, b in zip(y, y[1:])))
            total, ones = total + w, ones + w * np.array(y)
        assert np.allclose(p[at : at + n], ones / total)
        at += n
    found = queries.op2_quality(spark, "/root/testdata/sf0.01").join(common.table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in found]) > 0.93


def test_quality_long_texts():
    """Long chains by pieces, and long texts by blocks, give what the plain recurrences give."""
    rng = np.random.default_rng(3)
    pairs = rng.normal(size=(2, 2))
    counts = np.array([5000, 2, 1, 2500, 2048, 2049])
    e = rng.normal(size=counts.sum()) * 3
    whole = quality.marginals(e, counts, pairs, expected=True, piece=10**6)
    pieces = quality.marginals(e, counts, pairs, expected=True)
    assert np.allclose(whole[0], pieces[0]) and np.allclose(whole[1], pieces[1])
    sizes = rng.integers(0, 90, len(e))
    assert quality.long_mean(e, sizes, pairs, segment=1500) == pytest.approx((quality.marginals(e, np.array([len(e)]), pairs) @ (sizes + 1.0)) / (sizes + 1.0).sum())
    w = rng.normal(size=quality.N_FEATURES)
    lines = [" ".join(rng.choice(["the", "cat", "Über", "12", "|", "!!!", "on", "on"], rng.integers(0, 12))) for _ in range(30_000)]
    for text in ("\n".join([*lines, "x y " * 200_000, "", "z"]), "", "\n", "a\n", "a\n\nb"):
        x, size, _ = quality.line_features([text])
        by_blocks = quality.long_emission(text.encode(), w)
        assert np.allclose(x @ w, by_blocks[0], atol=1e-4) and (size == by_blocks[1]).all()
    model = quality.Crf(0.3 * w, pairs)
    text = "\n".join(lines)
    assert quality.score([text], model, most_bytes=1000) == pytest.approx(quality.score([text], model, most_bytes=10**9))


def test_quality_learning_is_bounded(spark, docs):
    labels = common.table(spark, DATA, "labels").select("doc_id", F.col("quality").alias("label"))
    assert quality.train(docs, labels, max_lines=0).learned is False
    assert quality.train(docs, labels, max_lines=400).learned


def test_quality_odd(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (6, 0), (6, 0), (5, 1), (5, 0), (None, 1), (9, None)], "doc_id long, label int")
    model = quality.train(odd, labels)
    got = quality.annotate(odd, model, keep=["doc_id"]).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (4, None)}) == 1
    assert quality.annotate(none, model).count() == 0 and not quality.train(none, labels).learned
    assert {r["score"] for r in quality.annotate(odd, quality.train(odd, labels.limit(0)), keep=[]).collect()} == {0.5}


# 3


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = collections.defaultdict(list)
    sequences = collections.defaultdict(list)
    for r in queries.op3_packing(spark, DATA).collect():
        got[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for d in docs.collect():
        ids = np.array([*tk.encode(d["text"] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        parts = sorted(got.pop(d["doc_id"]), key=lambda r: r["piece"])
        for k, p in enumerate(parts):
            own = ids[4096 * k : 4096 * (k + 1)]
            assert (p["piece"], p["start"], p["length"], p["ids_crc32"]) == (k, 4096 * k, len(own), zlib.crc32(own.tobytes()))
        assert sum(p["length"] for p in parts) == len(ids)
    assert not got
    for parts in sequences.values():
        ends = np.cumsum([0] + [n for _, n in sorted(parts)])
        assert ends[-1] <= 4096 and [o for o, _ in sorted(parts)] == ends[:-1].tolist()
    total = sum(n for parts in sequences.values() for _, n in parts)
    assert len(sequences) <= -(-total // 4096) + 1


def test_packing_encoders_agree_with_their_tokenizers(docs):
    from tokenizers import Tokenizer

    texts = [r["text"] or "" for r in docs.limit(80).collect()] + ["", "Don't  stop\n\nnow", "ÀÉ 日本 a_b"]
    for name, by_word in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        path = public_tokenizers.path(name)
        coder, tk = packing.Encoder(path), Tokenizer.from_file(path)
        assert coder.by_word is by_word
        for text, ids in zip(texts, coder.encode(texts)):
            assert np.frombuffer(ids, dtype="<u4").tolist() == tk.encode(text, add_special_tokens=False).ids


def test_packing_plan():
    rng = np.random.default_rng(1)
    for capacity in (7, 64):
        for _ in range(40):
            counts = {int(x): int(rng.integers(1, 30)) for x in rng.integers(1, capacity + 1, 9)}
            used = collections.Counter()
            for parts, n in packing.plan(counts, capacity):
                assert n > 0 and sum(parts) <= capacity
                for x in parts:
                    used[x] += n
            assert used == counts
    assert packing.plan({}, 8) == [] and sum(n for _, n in packing.plan({5: 10**9, 3: 10**9}, 8)) == 10**9
    assert sum(n for _, n in packing.plan({6: 5, 1: 10}, 8)) == 5 and sum(n for _, n in packing.plan({5: 4, 1: 12}, 8)) == 4


def test_packing_odd(spark, odd, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack_documents(odd, path, capacity=64).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)
    assert sum(r["doc_id"] == 4 for r in got) == 2 and [r["length"] for r in got if r["doc_id"] == 2] == [1]
    assert packing.pack_documents(none, path).count() == 0


# 4


def test_html(spark):
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><header><h2>Site name</h2></header><nav><ul><li><a href=x>One</a><li><a>Two</a></ul></nav>"
        "<script>var t='</p><p>no</p>';</script><div class='cookie-notice'>We use cookies on this site</div><article><h1>The &amp; title</h1><p>First <b>para</b>graph\n with&nbsp;words.<br>Short.<p>Another one that is longer than the rest of the page."
        "<!-- ad --><div class=ad>Buy this now</div><form>Name <input><button>Send</button></form></article><section id=comments><p>A reader says that it is a very nice article.</p></section><aside>Related</aside><footer>&copy; us</footer>"
    )
    want = "The & title First paragraph with words. Short. Another one that is longer than the rest of the page."
    assert html_text.extract(page) == want
    bare = "<body><div id=menu><a>Home</a> <a>About</a></div><div><p>A first paragraph of some length here.<p>Tiny.<p>A second paragraph of some length here.</div><div class=footer>contact</div>"
    assert html_text.extract(bare) == "A first paragraph of some length here. Tiny. A second paragraph of some length here."
    odd = ["", None, "plain text only", "<p>", "<<<>>>&&&", "<article>" + "<b>" * 3000 + "deep", "<article><p>x" + " y" * 50_000]
    df = spark.createDataFrame([(i, h, "u") for i, h in enumerate(odd)], "page_id long, html string, text string")
    got = {r["page_id"]: r["text"] for r in html_text.extract_pages(df, keep=["page_id"]).collect()}
    assert got[0] == got[1] == got[3] == "" and got[2] == "plain text only" and got[5] == "deep" and len(got[6]) == 100_001
    assert html_text.extract_pages(df.limit(0)).count() == 0


ONE = "<p>A first paragraph of some length here and more words so that it counts as text.</p>"
TWO = "<p>A second paragraph of some length here, which ends the story as it should.</p>"


@pytest.mark.parametrize(
    "page, parts",
    [
        # names on wrappers don't take an article away, nor weak names its paragraphs
        (f'<div class="layout has-sidebar"><article>{ONE}{TWO}</article></div>', [ONE, TWO]),
        (f'<div class="with-sidebar sidebar"><article>{ONE}{TWO}</article></div>', [ONE, TWO]),
        (f'<body class="no-comments"><div class="no-comments widget-area side-by-side main-menu-open"><article>{ONE}{TWO}</article></div>', [ONE, TWO]),
        (f'<article>{ONE}<p class="notice">Short.</p><p class=tags>One.</p>{TWO}</article>', [ONE, "Short.", "One.", TWO]),
        # the clusters decide: no article or main element
        (f"<body><nav><a>x</a></nav><div>{ONE}{'<p>S.</p>' * 6}{TWO}<p>End.</p></div><div>Copyright us</div>", [ONE, *["S."] * 6, TWO, "End."]),
        (f'<body><div id=top><a href=/>Home</a> <a>Two</a></div><div class=post><h2>Head</h2>{ONE}<p>Tiny.</p>{TWO}</div><div class="related-posts"><p>{"Other story that is long. " * 9}</p></div>', ["Head", ONE, "Tiny.", TWO]),
        (f"<body><p>Site</p><h1>T</h1>{ONE}<p>x</p>{TWO}<ul><li><a>a</a><li><a>b</a><li><a>c</a></ul>", ["T", ONE, "x", TWO]),
        (f"<form id=f><input>{ONE * 3}{TWO}</form>", [ONE, ONE, ONE, TWO]),
        (f"<body><article><h3><a href=x>A teaser</a></h3></article><div>{ONE * 3}{TWO}</div>", [ONE, ONE, ONE, TWO]),
        # several regions
        (f"<main><h1>Title</h1><p>Lead.</p><article>{ONE * 6}</article><article><p>Tiny one here in a sibling.</p></article></main><footer>f</footer>", ["Title", "Lead.", *[ONE] * 6, "Tiny one here in a sibling."]),
        (f"<article>{ONE * 6}</article><article><p>Shorter article in here.</p></article>", [*[ONE] * 6, "Shorter article in here."]),
        (f"<article>{ONE}{TWO}</article><article class=comment><p>I like it a lot, thank you very much.</p></article><section class=comments>{ONE}</section>", [ONE, TWO]),
        # names that also say something else, and names around all there is
        (f'<body><div class="social-history">{ONE}{TWO}</div>', [ONE, TWO]),
        (f'<body><div class="cookie-recipes">{ONE}{TWO}</div>', [ONE, TWO]),
        (f'<body><div id="ad-hoc-committee">{ONE}{TWO}</div>', [ONE, TWO]),
        (f'<body><div class="sidebar">{ONE}{TWO}</div>', [ONE, TWO]),
        (f'<article>{ONE}<p class="share-price">Now 12.</p>{TWO}<p class="share-buttons">Share</p></article>', [ONE, "Now 12.", TWO]),
        (f'<body><div class="header"><h1>Head</h1></div><div>{ONE}{TWO}</div>', ["Head", ONE, TWO]),
        (f'<body><div class="header"><h1>Head</h1></div><article>{ONE}{TWO}</article>', ["Head", ONE, TWO]),
        (f'<body><div class="header"><h1><a href=/>Site</a></h1></div><article>{ONE}{TWO}</article>', [ONE, TWO]),
        # marks that can't be read
        ("<p>x</p><![foo[ y ]]>", ["x"]), ("<![ %", []), ("<p>a</p><!-- never closed <p>b", ["a", "b"]), ('<p>a <a href="x>b</a> c', ["a b c"]), ("<p>a<script>x", ["a"]),
    ],
)
def test_html_regions(page, parts):
    assert html_text.extract(page) == " ".join(re.sub("<[^>]+>", "", x) for x in parts)


def layouts():
    """Pages without article elements or telling names: (html, main text)."""
    rng = np.random.default_rng(12)
    words = lambda n: " ".join("".join(rng.choice(list("aeionrst"), 5)) for _ in range(n))
    for k in range(60):
        story = [words(int(n)) for n in rng.integers(4 if k % 3 else 12, 60, 7)]
        story[0], story[-1] = words(40), words(40)
        menu = "".join(f"<li><a href=x>{words(2)}</a></li>" for _ in range(6))
        short = lambda n: "".join(f"<div><span>{words(2)}</span></div>" for _ in range(n))
        body = "".join(f"<p>{x}</p>" for x in story)
        page = [
            f"<body><div><ul>{menu}</ul></div>{short(5)}<div><h1>{words(4)}</h1>{body}</div>{short(5)}",
            f"<body><table><tr><td><ul>{menu}</ul></td><td>{body}</td><td>{short(4)}</td></tr></table>",
            f"<body>{short(3)}<h1>{words(4)}</h1>{body}{short(6)}<p>{words(3)}</p>",
        ][k % 3]
        heading = re.findall("<h1>(.*?)</h1>", page)
        yield page, " ".join(heading + story)


def test_html_clusters_decide(monkeypatch):
    """Where nothing but the lines' ratios tells content, smoothing and threshold do: without them a third of the pages are wrong."""
    pages = list(layouts())
    assert sum(html_text.extract(page) == want for page, want in pages) == len(pages)
    monkeypatch.setattr(html_text, "clusters", lambda ratio: (ratio > 0, ratio, 0.0))
    assert sum(html_text.extract(page) != want for page, want in pages) >= 20


def test_html_deep():
    """An article at any depth is a region, and tags keep their attributes however many there are."""
    assert html_text.extract("<p>outside</p>" + "<div>" * 3000 + f"<article>{ONE}{TWO}</article>" + "</div>" * 3000 + "<p>outside</p>") == " ".join(re.sub("<[^>]+>", "", x) for x in (ONE, TWO))
    many = "<b b='x' <" * 50_000
    assert html_text.extract(f"{many}><article>{ONE}<div hidden>no</div>{TWO}</article>") == " ".join(re.sub("<[^>]+>", "", x) for x in (ONE, TWO))


def test_html_time_is_linear():
    """Hostile pages of a megabyte: seconds at most, where a quadratic scan takes hours."""
    import time

    pages = ["<i>" * 150_000 + "</b>" * 150_000, "<a " * 300_000, "<a " * 300_000 + ">", '<a href="' * 100_000 + ">", "<!-- >" * 150_000, "<a b='" * 3 + "<p>x" * 250_000, "<b>" * 9999 + "<i>" * 150_000 + "</b>" * 100_000, "<div><nav>" * 50_000 + "</div></nav>" * 50_000]
    for page in pages:
        began = time.time()
        html_text.extract(page)
        assert time.time() - began < 20
    deep = "<div>" * 2000
    assert html_text.extract(f"<article>{deep}<nav>menu</nav>text</article>") == "text"


def test_html_articles_of_the_table(spark):
    import html

    for r in common.table(spark, DATA, "pages").collect():
        parts = re.split(r"</?(?:p|h1|br)>", re.search(r"<article>(.*?)</article>", r["html"], re.S)[1])
        want = " ".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]+>", "", p)).split()) for p in parts) if x)
        assert html_text.extract(r["html"]) == want


# 5


def brute_knn(rows_, k):
    """The k best of every id that 20 divides; of several vectors with such an id the smallest asks."""
    ok = [(i, np.floor(64 * np.array(x, dtype=np.float64)).astype(np.int64)) for i, x in rows_ if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)]
    asks = {}
    for i, v in ok:
        if i % 20 == 0 and (i not in asks or v.tolist() < asks[i].tolist()):
            asks[i] = v
    best = {q: sorted((-int(w @ v), i) for i, w in ok if i != q and len(w) == len(v))[:k] for q, v in asks.items()}
    return {q: [(n + 1, i, -s) for n, (s, i) in enumerate(x)] for q, x in best.items() if x}


def vectors():
    v = np.random.default_rng(2).normal(size=(260, 6)).astype(np.float32)
    v[40:120] = v[0]  # more copies than are asked for
    return [(i, [float(c) for c in x]) for i, x in enumerate(v)]


ODD_VECTORS = [(500, None), (520, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (540, [float("nan")] * 6), (560, [float("inf")] + [0.0] * 5), (None, [0.0] * 6), (580, [1.0, 2.0]), (600, [2.0, 1.0]), (20, [1.0, 1.0]), (0, [1.0] * 6)]
#: Many rows with the query's own id and vector, which mustn't push out its neighbours.
OWN = [(0, [1.0, 1.0])] * 25 + [(1, [1.0, 1.0]), (2, [0.5, 0.5])]


@pytest.mark.parametrize(
    "rows_, k, shard_rows",
    [(vectors() + ODD_VECTORS, 20, 60), (vectors() + ODD_VECTORS, 1, 40), (vectors(), 50, None), (OWN, 20, 8), ([(i, [1.0, 1.0]) for i in range(60)], 40, 16), (vectors()[:3] * 70 + vectors(), 20, 30)],
)
def test_knn(spark, rows_, k, shard_rows):
    df = spark.createDataFrame(rows_, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).repartition(3)
    got = collections.defaultdict(list)
    for r in knn.top_k(df, F.col("vec_id") % 20 == 0, k=k, shard_rows=shard_rows, part_queries=7).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert {q: sorted(x) for q, x in got.items()} == brute_knn(rows_, k)
    assert knn.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_knn_tree_prunes():
    """Clustered vectors: a search opens few of the tree's nodes, and finds what brute force does."""
    rng = np.random.default_rng(7)
    centre = rng.integers(-60, 60, (16, 8))
    v = (centre[rng.integers(0, 16, 8000)] + rng.integers(-3, 4, (8000, 8))).astype(np.int64)
    tree = knn.Tree(np.arange(8000), v, leaf_size=64)
    inner = tree.child[:, 0] >= 0
    assert (tree.low[tree.child[inner, 0]] >= tree.low[inner]).all() and (tree.high[tree.child[inner, 1]] <= tree.high[inner]).all()
    scores = v[:50] @ v.T
    scores[np.arange(50), np.arange(50)] = np.iinfo(np.int64).min
    reads = []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, slice):
                reads.append(at)
            return super().__getitem__(at)

    tree.vectors = tree.vectors.view(Counted)
    for q in range(50):
        _, score, ids = tree.search(np.array([q]), v[q : q + 1], 10, np.array([np.iinfo(np.int64).min]))
        want = sorted((-int(s), i) for i, s in enumerate(scores[q]))[:10]
        assert [(-int(s), int(i)) for s, i in zip(score, ids)] == want
    assert len(reads) < 50 * (~inner).sum() / 4


def test_sql(spark):
    """The queries that SQL can express."""
    import duckdb

    con = duckdb.connect()
    for t in ("conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    for name, sql in ((n, queries.ORACLES[n]) for n in ("op1_chat", "op5_knn")):  # the others are in test_words
        df = queries.QUERIES[name](spark, DATA)
        assert sorted(map(tuple, df.collect())) == sorted(con.execute(f"select {', '.join(df.columns)} from ({sql})").fetchall())


# 6


def test_language_model(spark, docs):
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    counts = collections.Counter()
    for i, t in texts.items():
        if not held(i):
            counts.update([*words(t), None])
    n, v = sum(counts.values()), len(counts)
    found = queries.op6_language_model(spark, DATA).collect()
    assert len(found) == len(texts)
    better = 0.0
    for r in found:
        w = [*words(texts[r["doc_id"]]), None]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), len(w), sum(counts[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        better += (r["score"] - r["base_score"]) if r["held_out"] else 0
    assert better > 0


def test_language_model_sums_to_one_and_state_is_carried(spark, docs):
    texts = [r["text"] for r in docs.limit(60).collect()]
    counts = common.cut(lm.count_words(docs.limit(60)))
    whole, small = lm.make_vocabulary(counts), lm.make_vocabulary(counts, 300)
    assert whole.words[0] == lm.END and len(small.words) <= 300
    net = lm.fit(lm.Reader(whole, None).arrays(texts[:20]), whole, hidden=8, epochs=1)
    reader = lm.Reader(whole, net)
    # over all known words and the unknown one, after some beginning
    start = texts[0].split()[:7]
    ids, sizes, _, _ = reader.read([" ".join(start)])
    h = np.zeros((1, 8), dtype=np.float32)
    x = np.array([[lm._START], *[[i] for i in reader.input[ids][:-1]]])
    out, _, _ = net.run(x, x == lm._START, h)
    logs = net.classes(out[-1])[0]
    total = sum(np.exp(logs[c]) * np.exp(net.inside(c, out[-1])[0]).sum() for c in range(lm.HEAD_CLASSES))
    total += np.exp(logs[lm.HEAD_CLASSES :]).sum()
    assert total == pytest.approx(1, abs=1e-4)
    tail = whole.kinds[lm._HEAD :]
    share = np.bincount(tail, 10 ** reader.inside[lm._HEAD :], lm.TAIL_CLASSES) + np.where(whole.tail_n > 0, whole.unknown(), 0)
    assert np.allclose(share[whole.tail_n > 0], 1)
    # windows and lanes don't matter
    a, b = reader.score(texts, lanes=4, window=5), reader.score(texts, lanes=64, window=64)
    assert np.allclose(a[3], b[3], rtol=1e-4)


def test_language_model_goes_on_learning_on_workers(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents").select(F.xxhash64("doc_id").alias("h"), "text")
    counts = common.cut(lm.count_words(docs))
    vocab = lm.make_vocabulary(counts)
    rows_ = sorted((r["h"], r["text"] or "") for r in docs.collect())
    reader = lm.Reader(vocab, None)
    start = lm.fit(reader.arrays([t for _, t in rows_[:60]]), vocab, hidden=8, epochs=1)
    before = {k: x.copy() for k, x in start.p.items()}
    spread = lm.refine(start, vocab, docs, rounds=2, worker_docs=150)
    again = lm.refine(start, vocab, docs.repartition(5), rounds=2, worker_docs=150)
    assert all(np.array_equal(before[k], start.p[k]) for k in before)
    assert all(np.allclose(spread.p[k], again.p[k], atol=1e-5) for k in before)
    texts = [t for _, t in rows_[-200:]]
    assert lm.Reader(vocab, spread).score(texts)[3].sum() > lm.Reader(vocab, start).score(texts)[3].sum()
    # one worker and one round: the same as learning here
    alone = lm.refine(start, vocab, docs, rounds=1, worker_docs=10**6)
    own = lm.Network.__new__(lm.Network)
    own.hidden, own.p = 8, {k: x.copy() for k, x in before.items()}
    here = lm.fit(reader.arrays([t for _, t in rows_]), None, epochs=1, lanes=128, rate=3e-3, seed=0, start=own)
    assert all(np.allclose(alone.p[k], here.p[k], atol=1e-4) for k in before)
    assert lm.refine(start, vocab, docs.limit(0)) is start


def test_language_model_learns_from_every_learning_document_and_token(spark, docs, monkeypatch):
    seen = []

    def refine(net, vocab, texts_, rounds):
        seen.extend(r["text"] for r in texts_.collect())
        return net

    monkeypatch.setattr(lm, "refine", refine)
    learns = F.col("doc_id") % 5 != 1
    lm.score_documents(docs, learns, sample_docs=20, epochs=1)
    assert collections.Counter(seen) == collections.Counter(r["text"] for r in docs.where(learns).collect())
    # a last token that fills no lane
    vocab = lm.Vocabulary([lm.END], np.array([5]), np.array([0]), 5, 1, 0.5, np.ones(lm.TAIL_CLASSES), np.ones(lm.TAIL_CLASSES))
    y = np.full(73, lm._HEAD)
    x = np.concatenate(([lm._START], y[:-1]))
    one, other = (lm.fit([(x, np.append(y[:-1], lm._HEAD + k))], vocab, hidden=4, epochs=1) for k in (0, 1))
    assert not np.array_equal(one.p["cb"], other.p["cb"])


def test_language_model_odd(spark, odd, none):
    got = lm.score_documents(odd, F.col("doc_id") < 5, epochs=1).collect()
    assert len(got) == len(ODD) and all(np.isfinite(r["score"]) for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    nothing = lm.score_documents(odd, F.lit(False)).collect()
    assert {(r["base_score"], r["score"], r["n_known"], r["train_tokens"]) for r in nothing} == {(0.0, 0.0, 0, 0)}
    assert lm.score_documents(none, F.lit(True)).count() == 0


# 7


def brute_fingerprint(text):
    w = words(text)
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_simhash(spark, docs):
    marks = {r["doc_id"]: brute_fingerprint(r["text"]) for r in docs.collect()}
    linked = [(a, b) for a in marks for b in marks if a < b and (marks[a] ^ marks[b]).bit_count() <= 2]
    want = brute_components(marks, linked)
    assert rows(queries.op7_simhash(spark, DATA), "doc_id", "fingerprint", "component_id") == sorted(((i, f"{f:016x}", want[i]) for i, f in marks.items()), key=repr)


@pytest.mark.parametrize("crowd", [2, 48])
def test_crowded_blocks_lose_no_link(spark, crowd):
    rng = np.random.default_rng(4)
    centre = int(rng.integers(1 << 63))
    fps = {centre ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in rng.integers(0, 63, (60, 3))} | {int(x) for x in rng.integers(1 << 62, size=40)} | {0, 1, 3, 7, (1 << 63) - 1}
    fps |= {-1 - x for x in list(fps)[:20]}
    linked = [(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    found = simhash.links(df, crowd=crowd).collect()
    assert all(((r["a"] ^ r["b"]) & (2**64 - 1)).bit_count() <= 2 for r in found)
    assert brute_components(fps, [tuple(r) for r in found]) == brute_components(fps, linked)
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, crowd=crowd)).collect()}
    want = brute_components(fps, linked)
    assert all(want[n] == r for n, r in got.items()) and all(want[n] == n for n in fps if n not in got)


def test_simhash_odd(spark, odd, none):
    got = simhash.cluster(odd).collect()
    assert len(got) == len(ODD)
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    assert {r["component_id"] for r in got if r["doc_id"] in (None, 4)} == {4}
    assert sorted(r["doc_id"] for r in simhash.deduplicate(odd).collect()) == [1, 4, 4, 5, 6, 7]
    assert simhash.cluster(none).count() == 0


# 8


def test_transport_stream(spark, odd, none):
    rng = np.random.default_rng(5)
    for n in [*range(0, 600, 13), 168, 169, 170, 171, 183, 184, 185, 47_999, 48_000, 48_001, 300_000]:
        payload = mpegts.padded(rng.bytes(n))
        media = mpegts.mux(payload)
        s = mpegts.parse(media)
        assert len(media) % 188 == 0 and s.data(0x101) == payload and (s.lost, s.broken, s.bad_tables, s.repeated) == (0, 0, 0, 0)
    media = mpegts.mux(rng.bytes(500_000))
    s = mpegts.parse(media)
    assert s.programs == {1: 0x100} and s.repeated == 0 and s.streams == {0x101: 6} and [p.pts for p in s.pes[:2]] == [90_000, 93_600] and [p.random_access for p in s.pes[:5]] == [True, False, False, False, True]
    assert mpegts.parse(media[: 188 * 9] + media[188 * 10 :]).lost == 1
    assert mpegts.parse(media[: 188 * 9] + media[188 * 8 :]).repeated == 1
    assert mpegts.parse(b"junk" + media).broken == 4
    assert mpegts.parse(bytes([*media[:20], media[20] ^ 1, *media[21:188]])).bad_tables == 1
    got = {r["doc_id"]: r for r in mpegts.digests(mpegts.store_texts(odd, keep=["doc_id", "n_chars"])).collect()}
    for i, text, *_ in ODD:
        raw = mpegts.padded((text or "").encode())
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len((text or "").encode()), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))
    assert mpegts.digests(mpegts.store_texts(none)).count() == 0
    df = spark.createDataFrame([(1, bytearray(media), "x"), (2, None, "x"), (3, bytearray(b""), "x"), (4, bytearray(b"none"), "x")], "id long, media binary, packets string")
    cols = {r["id"]: r for r in mpegts.media_columns(df).collect()}
    assert cols[1]["programs"] == 1 and len(cols[1]["pes"]) == 11 and cols[2]["pes"] is None and cols[3]["packets"] == 0 and cols[4]["broken_bytes"] == 4


def test_transport_stream_tables_over_packets_and_damage():
    import struct

    # a program map of 60 streams, which is longer than a packet
    body = struct.pack(">BHHBBBHH", 2, 0xB000 | (13 + 5 * 60), 1, 0xC1, 0, 0, 0xE101, 0xF000) + b"".join(struct.pack(">BHH", 6, 0xE000 | (0x101 + k), 0xF000) for k in range(60))
    section = body + struct.pack(">I", mpegts.crc32_mpeg(body))
    payloads = [b"\x00" + section[:183], section[183:] + b"\xff" * (184 - len(section[183:]))]
    pmt = b"".join(struct.pack(">BHB", 0x47, (0x4000 if k == 0 else 0) | 0x100, 0x10 | k) + x for k, x in enumerate(payloads))
    media = mpegts.mux(bytes(range(256)) * 200, pes_bytes=20_000)
    head, rest = media[:188], media[376:]
    s = mpegts.parse(head + pmt + rest)
    assert (len(s.streams), s.bad_tables, len(s.pes), s.lost) == (60, 0, 3, 0) and s.data(0x101) == bytes(range(256)) * 200
    assert mpegts.parse(head + pmt[:188] + rest).streams == {} and mpegts.parse(head + pmt[:188] + rest).unnamed == len(rest) // 188
    # a lost packet marks its own PES packet only
    packets = [media[i : i + 188] for i in range(0, len(media), 188)]
    s = mpegts.parse(b"".join(packets[:20] + packets[21:]))
    assert s.lost == 1 and [p.damaged for p in s.pes] == [True, False, False] and len(s.pes[0].data) == 20_000 - 184
    # the same counter with other bytes isn't a repeat
    other = packets[20][:60] + bytes([packets[20][60] ^ 1]) + packets[20][61:]
    s = mpegts.parse(b"".join(packets[:21] + [other] + packets[21:]))
    assert (s.repeated, s.lost) == (0, 1) and s.pes[0].damaged
    assert mpegts.parse(b"".join(packets[:21] + packets[20:])).data(0x101) == bytes(range(256)) * 200


def test_transport_stream_read_from_anywhere():
    """Stray sync bytes before and between packets, spoilt sync bytes, marked packets, a stream cut at its start."""
    payload = np.random.default_rng(8).bytes(400_000)
    media = mpegts.mux(payload, pes_bytes=20_000)
    packets = [media[i : i + 188] for i in range(0, len(media), 188)]
    for stray in (b"\x47", b"\x47\x47", b"ab\x47cd\x47", bytes(187), b"\x47" * 187):
        s = mpegts.parse(stray + media)
        assert (s.data(0x101), s.lost, s.broken) == (payload, 0, len(stray))
        s = mpegts.parse(b"".join(packets[:50]) + stray + b"".join(packets[50:]))
        assert (s.data(0x101), s.lost, s.broken) == (payload, 0, len(stray))
    spoilt = mpegts.parse(b"".join([*packets[:50], b"\x00" + packets[50][1:], *packets[51:]]))
    assert spoilt.lost == 1 and sum(p.damaged for p in spoilt.pes) == 1 and spoilt.broken == 188
    for at, bits in ((1, 0x80), (3, 0x80), (3, 0xC0)):
        marked = bytes([*packets[50][:at], packets[50][at] | bits, *packets[50][at + 1 :]])
        s = mpegts.parse(b"".join([*packets[:50], marked, *packets[51:]]))
        assert (s.unreadable, s.lost) == (1, 1) and [p.damaged for p in s.pes].count(True) == 1
    # tables come again: a reader that begins in the middle has all from the next random-access point on
    s = mpegts.parse(media[188 * 300 + 77 :])
    assert s.programs == {1: 0x100} and s.unnamed > 0 and payload.endswith(s.data(0x101)) and s.pes[0].random_access and len(s.data(0x101)) >= 160_000


# 9


def test_mixing_targets():
    assert mixing.targets([100, 100, 100], [3, 1, 2]) == pytest.approx([200, 250 / 3, 500 / 3])
    assert mixing.targets([10, 0, 1000], [3, 1, 2])[0] == 20 and mixing.targets([], []) == []
    for n in (1, 2, 5, 64, 1000):
        p = mixing.permute(np.arange(n), n, 11)
        assert sorted(p.tolist()) == list(range(n)) and mixing.permute(p, n, 11, inverse=True).tolist() == list(range(n))


def test_mixing(spark, docs):
    sources = {r["doc_id"]: r["source"] for r in docs.collect()}
    got = queries.op9_mixing(spark, DATA).collect()
    assert len(got) == len(sources)
    taken, target, size = collections.Counter(), {}, collections.Counter()
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        s = sources[r["doc_id"]]
        taken[s] += r["taken"]
        size[s] += r["size"]
        target[s] = r["target"]
    names = sorted(size)
    want = mixing.targets([size[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))])
    assert [target[s] for s in names] == pytest.approx(want)
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    assert rows(queries.op9_mixing(spark, DATA), "doc_id", "taken") == sorted(((r["doc_id"], r["taken"]) for r in got), key=repr)


def test_mixing_odd(spark, odd, none):
    got = mixing.taken_words(odd, block=4).collect()
    assert len(got) == len(ODD) and all(r["taken"] <= 2 * r["size"] for r in got)
    mixed = mixing.mixed_documents(odd, block=4).collect()
    assert sum(len(words(r["text"])) for r in mixed) == sum(r["taken"] for r in got)
    assert all(r["text"] and r["n_chars"] == len(r["text"]) for r in mixed)
    assert mixing.taken_words(none).count() == 0 and mixing.mixed_documents(none).count() == 0


# 10


def test_language(spark, odd, none):
    found = queries.op10_language(spark, "/root/testdata/sf0.01").join(common.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in found]) > 0.95 and all(0 <= r["score"] <= 1 for r in found)
    model = langid.train(odd)
    got = langid.annotate(odd, model, keep=["doc_id"]).collect()
    assert len(got) == len(ODD)
    for r in got:
        if r["doc_id"] in (1, 2, 3, 6):
            assert (r["lang_pred"], r["score"]) == (langid.UNKNOWN, 0.0)
        else:
            assert r["lang_pred"] in ("en", "es", "fr")
    assert langid.train(none) is None and {r["lang_pred"] for r in langid.annotate(odd, None).collect()} == {"und"}
    assert langid.annotate(none, model).count() == 0


def test_language_evidence(spark, docs):
    """Texts in none of the learned languages are told by the n-grams that no landmark knows; clean ones stay."""
    model = langid.train(common.table(spark, "/root/testdata/sf0.01", "documents"))
    foreign = ["Вчера вечером мы гуляли по набережной и говорили о книгах.", "昨日の夜、友達と川へ行きました。", "Χθες το βράδυ πήγαμε στο ποτάμι με φίλους."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(foreign)], "doc_id long, text string")
    assert langid.annotate(df, model, min_known=0.6, only_kept=True).count() == 0
    clean = docs.where("lang is not null")
    assert langid.annotate(clean, model, min_known=0.6, only_kept=True).count() == clean.count()
    long = "palabra larga " * 200_000
    assert np.array_equal(langid.predict([long], model)[1] > 0.2, [True])


def test_kernel_is_the_presence_kernel(spark):
    model = langid.fit(["abc abd", "xyz", "abc"], ["p", "q", "p"])
    symbol, number = model.ready()
    p = langid.presence(["abc", "xyz q"], (symbol, number), len(model.grams))
    k = langid._kernel(p, model.landmarks, model.landmark_sizes)
    assert k[0, 2] == pytest.approx(1) and k[0, 1] < 0.35 and 0 < k[0, 0] < 1


# pipeline


def test_pipeline(spark):
    import corpus_pipeline as cp

    docs = common.table(spark, DATA, "documents")
    sizes = [docs.count()]
    for i, (_, stage) in enumerate(cp.STAGES):
        before = docs
        docs = common.cut(stage(spark, docs, DATA))
        sizes.append(docs.count())
        if i < 3:
            assert docs.columns == cp.COLUMNS and docs.join(before, "doc_id", "left_anti").count() == 0
    assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3] > 0 and docs.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 4096
    assert cp.run(spark, DATA).count() == sizes[-1]


@pytest.mark.parametrize("kind", ["odd", "none", "unlabelled"])
def test_pipeline_on_odd_tables(spark, tmp_path, kind):
    """Nulls, empty and long texts, repeated rows, clashing columns; no rows; no labels."""
    import corpus_pipeline as cp

    real = common.table(spark, DATA, "documents").limit(60).select("doc_id", "text", "lang", "source", "n_chars")
    docs = spark.createDataFrame([] if kind == "none" else ODD, DOCS)
    docs = docs.unionByName(real) if kind == "unlabelled" else docs
    docs.select("*", F.lit("x").alias("score"), F.lit(1).alias("mark"), F.lit(2).alias("_key")).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [] if kind != "odd" else [(4, 1, 0), (5, 1, 0), (6, 0, 0), (None, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(str(tmp_path / "labels.parquet"))
    rows = cp.run(spark, str(tmp_path)).collect()
    assert all(r["length"] <= 4096 and r["offset"] + r["length"] <= 4096 for r in rows) and (rows == [] or kind != "none")
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
