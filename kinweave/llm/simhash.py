"""Near-duplicate detection by SimHash fingerprints.

A fingerprint has a bit for each bit of the 64-bit shingle hashes: 1 where more
than half of the hashes have it set.  Fingerprints that differ in ``distance``
bits at most are linked, and documents reachable by links form a component.

Links are found by pigeonhole: the 64 bits are split into blocks, and of
fingerprints that differ in two bits all but two blocks agree, so each choice
of blocks that may agree is a join key.  Fingerprints with an equal key are
compared and verified by Hamming distance.  A key with more than ``crowd``
different fingerprints isn't compared in pairs: two fingerprints within two
bits have a common neighbour at one bit at most, so each of them sends itself
to its 65 neighbours, and those that meet there are linked to the smallest.
That is exact, costs 65 rows a fingerprint instead of pairs, and no meeting
has more than 65 guests.

Only different fingerprints are compared: copies share one, so large groups of
copies cost nothing.

Defined results: a null or empty text has fingerprint zero and is linked like
any other; rows are kept as they are, equal rows included; a null id belongs to
a component but never names one, unless all of its ids are null; an empty table
has no components; columns other than doc_id and text are not read by ``cluster``
and stay in ``deduplicate``, a column ``fp`` is replaced in ``fingerprints``.  A text
of any length is hashed in blocks of a megabyte.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, map_batches, release, texts, word_lists

_BITS = 64


def shingle_hashes(words: list[bytes], width: int, seed: int) -> np.ndarray:
    """XXH64 of each stretch of ``width`` words, of all words if there are fewer."""
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    ends = np.cumsum(sizes)
    n = max(1, len(words) - width + 1)
    starts, stops = (ends - sizes)[:n].tolist(), (ends[min(width, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:z], seed) for a, z in zip(starts, stops)), dtype=np.uint64, count=n)


def hash_blocks(text: str, width: int, seed: int, most: int = 1 << 20) -> Iterator[np.ndarray]:
    """The hashes of all shingles of a text, block by block; shingles run over the blocks' borders."""
    kept: list[bytes] = []
    whole = False
    for words in word_lists(text, most):
        kept += words
        if len(kept) >= width:
            whole = True
            yield shingle_hashes(kept, width, seed)
            kept = kept[len(kept) - width + 1 :]
    if kept and not whole:
        yield shingle_hashes(kept, width, seed)


def fingerprint(text: str, width: int = 3, seed: int = 42, most: int = 1 << 20) -> int:
    """The SimHash of one text (unsigned)."""
    ones, n = np.zeros(_BITS, dtype=np.int64), 0
    for hashes in hash_blocks(text, width, seed, most):
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0]) if n else 0


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, keep: list[str] | None = None) -> DataFrame:
    """Add ``fp``, the fingerprint as a signed 64-bit number."""

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        fp = np.array([fingerprint(t, width, seed) for t in texts(batch)], dtype=np.uint64)
        return {"fp": fp.view(np.int64)}

    return map_batches(docs, run, {"fp": T.LongType()}, keep=keep)


def _masks(n_blocks: int, distance: int) -> list[int]:
    """Bits of each choice of ``n_blocks - distance`` blocks, as signed numbers."""
    edge = [round(i * _BITS / n_blocks) for i in range(n_blocks + 1)]
    block = [((1 << edge[i + 1]) - 1) ^ ((1 << edge[i]) - 1) for i in range(n_blocks)]
    out = []
    for agree in combinations(range(n_blocks), n_blocks - distance):
        m = sum(block[i] for i in agree)
        out.append(m - (1 << 64) if m >= 1 << 63 else m)
    return out


def links(fps: DataFrame, distance: int = 2, n_blocks: int = 5, crowd: int = 48) -> DataFrame:
    """Links (a, b) between the different fingerprints of ``fps`` (fp), a < b or a > b.

    Not all pairs, but enough for the same components: the members of a crowded
    key are linked by meetings (only for a distance of two or less).
    """
    if distance > 2:
        raise ValueError("meetings at common neighbours are exact up to a distance of two")
    masks = _masks(n_blocks, distance)
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("choice", "key"))
    size = keyed.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = keyed.join(size, ["choice", "key"])
    few = shared.where(F.col("n") <= crowd).select("choice", "key", "fp")
    pairs = (
        few.withColumnRenamed("fp", "a")
        .join(few.withColumnRenamed("fp", "b"), ["choice", "key"])
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
        .select("a", "b")
    )
    crowded = shared.where(F.col("n") > crowd).select("fp").distinct()
    flips = [0] + [1 << i if i < 63 else -(1 << 63) for i in range(_BITS)]
    met = (
        crowded.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(f)) for f in flips])).alias("at"))
        .groupBy("at")
        .agg(F.collect_set("fp").alias("guests"))  # 65 at most, as each is the place or one bit off it
        .where(F.size("guests") > 1)
        .select(F.array_min("guests").alias("a"), F.explode("guests").alias("b"))
        .where("a <> b")
    )
    return pairs.unionByName(met).distinct()


def components(edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(node, root) of the connected components of ``edges`` (a, b): root is the smallest node.

    With ``keys``, columns of ``edges`` that tell several graphs apart, all of them
    are taken in the same rounds, and the keys come first in the result.

    Alternating large-star and small-star rounds, until nothing changes: their
    number grows with the logarithm of the nodes.  Each round writes its links to
    the checkpoint folder, and the driver sees two sums a round only.
    """
    of = keys or []
    now = cut(edges.select(*of, "a", "b").where("a <> b").distinct())
    before = None
    while True:
        # large star: each node links its larger neighbours to the smallest of its neighbours and itself
        both = now.unionByName(now.select(*of, F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(*of, "a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, [*of, "a"]).select(*of, F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: each node links its smaller neighbours and itself to the smallest of them
        down = large.select(*of, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        floor = down.groupBy(*of, "a").agg(F.min("b").alias("m"))
        small = (
            down.join(floor, [*of, "a"])
            .select(*of, F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(floor.select(*of, "a", F.col("m").alias("b")))
            .where("a <> b")
            .distinct()
        )
        now = cut(small)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*of, "a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    release(edges.sparkSession)
    roots = now.select(*of, F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(*of, F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def cluster(docs: DataFrame, width: int = 3, seed: int = 42, distance: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) of each row of ``docs`` (doc_id, text)."""
    marked = cut(fingerprints(docs.select("doc_id", "text"), width, seed, keep=["doc_id"]))
    fps = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    grouped = components(links(fps.select("fp"), distance))
    # each fingerprint's component first, then its smallest id; fingerprints without links are their own
    named = (
        fps.join(grouped, F.col("fp") == F.col("node"), "left")
        .select("fp", F.coalesce("root", "fp").alias("root"), "least")
    )
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = named.join(ids, "root").select("fp", "component_id")
    return marked.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    """A signed fingerprint as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def deduplicate(docs: DataFrame, width: int = 3, seed: int = 42, distance: int = 2) -> DataFrame:
    """The rows of ``docs`` without near duplicates: the smallest id of each component stays.

    Of equal rows with that id all stay, as they are one document.
    """
    stays = cluster(docs, width, seed, distance).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("stays")).distinct()
    return docs.join(stays, F.col("doc_id").eqNullSafe(F.col("stays")), "left_semi")
