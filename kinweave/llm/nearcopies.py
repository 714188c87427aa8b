"""Near copies by SimHash fingerprints, and by the Jaccard similarity of their sets of five-word shingles.

Texts whose fingerprints differ in two bits at most are linked as ``simhash`` links
them: pigeonhole blocks, verified Hamming distance, star components.  Two bits are
few, so that texts of similarity 0.8 mostly differ in more; these are linked too.
Their candidates come from MinHash: ``bands`` keys a text, each of ``rows`` minima.
Texts of similarity s share a key with probability 1 - (1 - s^rows)^bands, which
is 0.99993 at 0.8 with 24 bands of 5 rows, and more above.  Each candidate is
then verified by the exact similarity of the two sets, so that nothing below
``similarity`` is ever linked by it.

Only different texts are compared: copies (equal words, ASCII letters
lower-cased) share a mark, so large groups of copies cost nothing.  In a key with
more than ``crowd`` texts pairs would be too many.  There the texts are compared
with one hub first, and what that leaves in several components is searched
without loss, family by family (texts joined by crowded keys):

* Two sets of that similarity share one of the first n - ceil(0.8 n) + 1 shingles
  of either, in any common order.  The order is by how many texts of the family
  have a shingle, rare ones first.  Texts that share a rare one among their first
  (``crowd`` texts have it at most) are compared as pairs.
* What is missed then are pairs of texts that share frequent shingles only, which
  are at least four fifths of both.  Those not in the family's largest component
  are compared with all such texts, in blocks, by a matrix product over the
  frequent shingles; only links leave a block.

So ``crowd`` and ``block`` decide what it costs, not what is found.

Defined results: a text of fewer than five words is one shingle, null and empty
texts are copies of each other; a null id belongs to a component but never names
one, unless all of its ids are null; an empty table has no components; columns
other than doc_id and text are not read, and stay where rows are kept.  A text
of any length is read in blocks of a megabyte; its task holds its set of 64-bit
numbers, eight bytes for each different shingle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, map_batches, texts, word_lists
from .simhash import components, fingerprint, hash_blocks, links

WIDTH, SIMILARITY, BANDS, ROWS, CROWD, BLOCK = 5, 0.8, 24, 5, 48, 512


def mark(text: str) -> int:
    """A signed 64-bit number that texts of equal words share."""
    h, first = xxhash.xxh3_64(), True
    for words in word_lists(text):
        if not first:
            h.update(b" ")
        h.update(b" ".join(words))
        first = False
    return int(np.uint64(h.intdigest()).view(np.int64))


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """The different hashes of the shingles, sorted; of no words that of the empty one."""
    found = [np.unique(x) for x in hash_blocks(text, width, 0)]
    return np.unique(np.concatenate(found)) if found else np.array([xxhash.xxh64_intdigest(b"")], dtype=np.uint64)


def band_keys(hashes: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> list[int]:
    """The MinHash key of each band, signed."""
    rng = np.random.default_rng(11)
    odd = rng.integers(0, 1 << 63, (bands * rows, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    plus = rng.integers(0, 1 << 63, (bands * rows, 1), dtype=np.uint64)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[a : a + 4096] * odd + plus).min(axis=1))
    minima = least.reshape(bands, rows)
    return [int(np.uint64(xxhash.xxh64_intdigest(m.tobytes(), i)).view(np.int64)) for i, m in enumerate(minima)]


def shared_keys(keyed: DataFrame) -> DataFrame:
    """(key, mark, n, h) of the keys of ``keyed`` (key, mark) that n > 1 marks have; h ranks and deals out the marks of a key."""
    size = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return keyed.join(size, "key").withColumn("h", F.xxhash64("key", "mark"))


def with_hubs(many: DataFrame) -> DataFrame:
    """(a, b): the hub of each key of ``many`` (key, mark, h) with the other marks of the key."""
    hubs = many.groupBy("key").agg(F.min_by("mark", "h").alias("a"))
    return many.join(hubs, "key").where("a <> mark").select("a", F.col("mark").alias("b")).distinct()


def in_pairs(few: DataFrame, keys: list[str]) -> DataFrame:
    """(a, b), a < b: marks of ``few`` (keys, mark, label) that share ``keys`` but not a label; a key has a bounded number of marks."""
    left, right = few.select(*keys, F.col("mark").alias("a"), F.col("label").alias("la")), few.select(*keys, F.col("mark").alias("b"), F.col("label").alias("lb"))
    return left.join(right, keys).where("a < b and la <> lb").select("a", "b").distinct()


def by_fingerprint(of_mark: DataFrame) -> DataFrame:
    """(a, b): marks of ``of_mark`` (mark, fp) whose SimHash fingerprints differ in two bits at most, enough of them for the same components."""
    fps = of_mark.groupBy("fp").agg(F.min("mark").alias("m"))
    equal = of_mark.select("fp", F.col("mark").alias("b")).join(fps, "fp").where("m <> b").select(F.col("m").alias("a"), "b")
    near = links(fps.select("fp")).join(fps.select(F.col("fp").alias("a"), F.col("m").alias("ma")), "a")
    return near.join(fps.select(F.col("fp").alias("b"), F.col("m").alias("mb")), "b").select(F.col("ma").alias("a"), F.col("mb").alias("b")).unionByName(equal)


def sets_of(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """(mark, set): the shingles of each of ``marks`` (mark)."""
    marked = map_batches(docs.select("text"), lambda batch: {"mark": [mark(t) for t in texts(batch)]}, {"mark": T.LongType()})
    one = marked.join(marks, "mark", "left_semi").dropDuplicates(["mark"])

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        return {"set": [shingles(t).view(np.int64) for t in texts(batch)]}

    return map_batches(one, run, {"set": T.ArrayType(T.LongType())}, keep=["mark"])


def similar(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY, most: int = 1024) -> DataFrame:
    """The ``pairs`` (a, b) of marks whose ``sets`` (mark, set) have that similarity at least.

    The set of a mark that is ``a`` of many pairs is there once for each ``most`` of them.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / most).alias("parts"))
    dealt = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    of_a = sets.join(parts, sets["mark"] == parts["a"]).select("a", F.col("set").alias("sa"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    # b first: then a hub's set is only copied to what has arrived
    both = dealt.join(sets.select(F.col("mark").alias("b"), F.col("set").alias("sb")), "b").join(of_a, ["a", "part"])
    n = F.size(F.array_intersect("sa", "sb"))
    # in whole numbers where the similarity is one of hundredths, so that 0.8 itself counts
    return both.where(n * 100 >= (F.size("sa") + F.size("sb") - n) * round(similarity * 100)).select("a", "b")


def profiles(members: DataFrame, sets: DataFrame, crowd: int, similarity: float = SIMILARITY) -> DataFrame:
    """(family, mark, label, n, rare, frequent): of each of ``members`` (mark, family, label) its number of shingles, the rare ones among its first, and, if there are frequent ones among them, all its frequent ones."""
    each = members.join(sets, "mark").select("family", "mark", "label", F.explode("set").alias("shingle"))
    counts = each.groupBy("family", "shingle").agg(F.count(F.lit(1)).alias("held"))
    ordered = each.join(counts, ["family", "shingle"]).groupBy("family", "mark", "label").agg(F.sort_array(F.collect_list(F.struct("held", "shingle"))).alias("all"))
    n, hundredths = F.size("all"), round(similarity * 100)
    first = F.slice("all", F.lit(1), n - F.ceil(n * hundredths / F.lit(100)).cast("int") + 1)
    names = lambda x: F.transform(x, lambda s: s["shingle"])
    rare, often = F.filter(first, lambda s: (s["held"] > 1) & (s["held"] <= crowd)), F.filter("all", lambda s: s["held"] > crowd)
    return ordered.select("family", "mark", "label", n.alias("n"), names(rare).alias("rare"), F.when(F.exists(first, lambda s: s["held"] > crowd), names(often)).alias("frequent"))


def compare(part: pd.DataFrame, similarity: float = SIMILARITY) -> pd.DataFrame:
    """Links (a, b) between the rows of one block that ask and those that are asked, by their frequent shingles."""
    asks = part["asks"].to_numpy(dtype=bool)
    codes, names = pd.factorize(np.concatenate(part["frequent"].to_list()))
    sizes = part["frequent"].map(len).to_numpy()
    row = np.repeat(np.arange(len(part)), sizes)
    n, mark_, label = (part[c].to_numpy() for c in ("n", "mark", "label"))
    ask, asked = np.flatnonzero(asks), np.flatnonzero(~asks)
    place = np.zeros(len(part), dtype=np.int64)
    place[ask], place[asked] = np.arange(len(ask)), np.arange(len(asked))
    shared = np.zeros((len(ask), len(asked)), dtype=np.float32)
    for low in range(0, len(names), 8192):  # a share of the columns at a time
        here = (codes >= low) & (codes < low + 8192)
        left, right = np.zeros((len(ask), 8192), dtype=np.float32), np.zeros((len(asked), 8192), dtype=np.float32)
        own = asks[row]
        left[place[row[here & own]], codes[here & own] - low] = 1
        right[place[row[here & ~own]], codes[here & ~own] - low] = 1
        shared += left @ right.T
    met = shared.astype(np.int64)
    total = n[ask][:, None] + n[asked][None, :]
    i, j = np.nonzero((met * 100 >= (total - met) * round(similarity * 100)) & (label[ask][:, None] != label[asked][None, :]))
    return pd.DataFrame({"a": mark_[ask[i]], "b": mark_[asked[j]]})


def in_blocks(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between ``rows`` (family, mark, label, n, frequent) of one family: those outside its largest component ask all."""
    sizes = rows.groupBy("family", "label").agg(F.count(F.lit(1)).alias("held"))
    largest = sizes.groupBy("family").agg(F.max_by("label", F.struct("held", "label")).alias("largest"), F.sum("held").alias("n_all"), F.max("held").alias("n_largest"))
    parts = lambda n: F.greatest(F.lit(1), F.ceil(n / block)).cast("int")
    named = rows.join(largest, "family").where("n_all > n_largest").withColumns({"asking": parts(F.col("n_all") - F.col("n_largest")), "chunks": parts(F.col("n_all"))})
    to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "mark"), F.col(n)).cast("int")
    columns = ["family", "mark", "label", "n", "frequent"]
    ask = named.where("label <> largest").select(*columns, F.lit(True).alias("asks"), own("asking", 1).alias("i"), to("chunks").alias("j"))
    asked = named.select(*columns, F.lit(False).alias("asks"), to("asking").alias("i"), own("chunks", 2).alias("j"))
    return ask.unionByName(asked).groupBy("family", "i", "j").applyInPandas(lambda part: compare(part), "a long, b long")


def cluster(docs: DataFrame, crowd: int = CROWD, block: int = BLOCK, fingerprints: bool = False) -> DataFrame:
    """(doc_id, component_id) of each row of ``docs`` (doc_id, text), linked by similarity and, with ``fingerprints``, by these too."""

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        found = texts(batch)
        fp = np.array([fingerprint(t) if fingerprints else 0 for t in found], dtype=np.uint64).view(np.int64)
        return {"mark": [mark(t) for t in found], "fp": fp, "keys": [band_keys(shingles(t)) for t in found]}

    new = {"mark": T.LongType(), "fp": T.LongType(), "keys": T.ArrayType(T.LongType())}
    marked = cut(map_batches(docs.select("doc_id", "text"), run, new, keep=["doc_id"]))
    # one row for each different text: what copies have in common is equal
    of_mark = cut(marked.groupBy("mark").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    shared = cut(shared_keys(of_mark.select(F.explode(F.array_distinct("keys")).alias("key"), "mark")))
    # once, for all comparisons: texts that share no key are in none
    sets = cut(sets_of(docs, shared.select("mark").distinct()))
    label = F.coalesce("root", "mark").alias("label")
    few = shared.where(F.col("n") <= crowd).withColumn("label", F.col("mark"))
    hubs = cut(with_hubs(shared.where(F.col("n") > crowd)))
    # the pairs of small keys and one hub for each large one: what they and the fingerprints link needs no other comparison
    first = similar(cut(in_pairs(few, ["key"]).unionByName(hubs).distinct()), sets)
    if fingerprints:
        first = first.unionByName(by_fingerprint(of_mark))
    # both graphs in the same rounds
    parts = components(first.select(F.lit(0).alias("graph"), "a", "b").unionByName(hubs.select(F.lit(1).alias("graph"), "a", "b")), ["graph"])
    grouped = parts.where("graph = 0").select("node", "root")
    families = parts.where("graph = 1").select(F.col("node").alias("mark"), F.col("root").alias("family"))
    members = families.join(grouped, F.col("mark") == F.col("node"), "left").select("mark", "family", label)
    several = members.groupBy("family").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("family")
    left = cut(members.join(several, "family", "left_semi"))
    found = cut(profiles(left, sets, crowd))
    rare = found.select("family", "mark", "label", F.explode("rare").alias("shingle"))
    more = cut(similar(cut(in_pairs(rare, ["family", "shingle"])), sets).unionByName(in_blocks(found.where("frequent is not null"), block)))
    if not more.isEmpty():
        # the components of all links: those of the first, joined by the others
        grouped = components(grouped.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    named = of_mark.join(grouped, F.col("mark") == F.col("node"), "left").select("mark", F.coalesce("root", "mark").alias("root"), "least")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.select("doc_id", "mark").join(named.join(ids, "root").select("mark", "component_id"), "mark").select("doc_id", "component_id")


def deduplicate(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """The rows of ``docs`` without near copies: the smallest id of each component stays.

    Of equal rows with that id all stay, as they are one document.
    """
    stays = cluster(docs, crowd, fingerprints=True).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("stays")).distinct()
    return docs.join(stays, F.col("doc_id").eqNullSafe(F.col("stays")), "left_semi")
