"""Mixing sources to target weights.

The words of a source's documents, in a pseudorandom order of documents, are
one long row of tokens that is cut into blocks of ``block`` words.  A source's
target is its share of the mix by weight, at most ``max_repeats`` times its
size.  The mix is a row of slots, each of which takes one block, dealt over
``shards`` output shards: each shard draws the counts of its sources from a
multinomial distribution over the quotas that are left, so that shards vary and
the quotas are met exactly.  Slot k of a source takes block p(k mod n), where n
is the source's number of blocks and p a pseudorandom permutation of them, one
for each pass over the source.  So no block is taken a further time before all
were, and no document exceeds ``max_repeats`` times its size.  The last slot of
a source takes the words that its target lacks.  Slots and document parts meet
by a join on the block's index.

The driver sees the sources' sizes (``max_sources`` at most, else an error) and
a count for each shard and source; positions, slots and joins are distributed.

Defined results: null and wordless texts take part with size 0 and are taken 0
times; a null source is a source of its own and comes last; rows may repeat,
each counts for itself; an empty table gives an empty mix.  Equal inputs and
parameters give equal mixes.  A text of any length is one string in its task, and
what the mix takes of it is cut from it there; of other columns ``mixed_documents``
keeps those of its input, ``taken_words`` reads none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, small

WORD = "[^\\x20\\x09-\\x0D]+"


def words_in(text: Column) -> Column:
    """Number of words of a text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], share: float = 1.5, max_repeats: float = 2.0) -> list[float]:
    """Words that each source gives: ``share`` of all words by weight, none over ``max_repeats`` its size.

    The excess of a capped source goes to the others by weight until none is
    over its cap.
    """
    out = [0.0] * len(sizes)
    open_, left = {i for i, s in enumerate(sizes) if s > 0}, share * sum(sizes)
    while open_:
        weight = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / weight > max_repeats * sizes[i]}
        if not over:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = max_repeats * sizes[i]
            left -= out[i]
        open_ -= over
    return out


@dataclass
class Plan:
    """What the driver knows of a mix; arrays by source, ``counts`` by shard and source."""

    names: list[str | None]
    sizes: np.ndarray
    targets: np.ndarray
    quota: np.ndarray
    blocks: np.ndarray
    slots: np.ndarray
    counts: np.ndarray
    block: int
    seed: int


def draw(slots: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Slots of each source in each shard: multinomial draws over what is left, none above it."""
    rng = np.random.default_rng(seed)
    left = slots.astype(np.int64).copy()
    out = np.zeros((shards, len(slots)), dtype=np.int64)
    total = int(left.sum())
    for s in range(shards):
        need = total * (s + 1) // shards - total * s // shards
        while need > 0:
            got = np.minimum(rng.multinomial(need, left / left.sum()), left)
            out[s] += got
            left -= got
            need -= int(got.sum())
    return out


def permute(k: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """Images of ``k`` (each below ``n``) under a pseudorandom permutation of 0..n-1, or their origins.

    Four Feistel rounds on the smallest even number of bits that holds n;
    images of n and above are sent on until they fall below it.
    """
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask, low = np.uint64((1 << half) - 1), np.uint64(half)
    mul, again = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)

    def noise(v: np.ndarray, r: int) -> np.ndarray:
        f = (v + np.uint64((key * 4 + r + 1) & 0xFFFFFFFFFFFF)) * mul
        f = (f ^ (f >> np.uint64(29))) * again
        return (f >> np.uint64(31)) & mask

    def once(v: np.ndarray) -> np.ndarray:
        a, b = v >> low, v & mask
        for r in reversed(range(4)) if inverse else range(4):
            a, b = (b ^ noise(a, r), a) if inverse else (b, a ^ noise(b, r))
        return (a << low) | b

    with np.errstate(over="ignore"):
        v = once(np.asarray(k).astype(np.uint64))
        while len(wide := np.flatnonzero(v >= np.uint64(n))):
            v[wide] = once(v[wide])
    return v.astype(np.int64)


def make_plan(names, sizes, weights, share=1.5, max_repeats=2.0, block=256, shards=64, seed=7) -> Plan:
    """The plan of a mix of sources with ``sizes`` words and ``weights``."""
    size = np.array(sizes, dtype=np.int64)
    want = np.array(targets([int(s) for s in sizes], list(weights), share, max_repeats), dtype=np.float64)
    quota = np.minimum(np.floor(want + 0.5), np.floor(max_repeats * size)).astype(np.int64)
    blocks = -(-size // block)
    # slots that take the quota: whole passes first, then blocks of the last pass, one of which may be short
    slots = np.zeros(len(size), dtype=np.int64)
    for i in range(len(size)):
        if quota[i]:
            passes, rest = divmod(int(quota[i]), int(size[i]))
            slots[i] = passes * blocks[i] + _blocks_for(rest, int(size[i]), int(blocks[i]), block, seed, i, passes)
    return Plan(list(names), size, want, quota, blocks, slots, draw(slots, shards, seed), block, seed)


def _key(seed: int, source: int, passed: int) -> int:
    return (seed * 1_000_003 + source * 7919 + passed * 104_729) & 0x3FFFFFFF


def _short_at(n: int, key: int) -> int:
    """The k whose image is the last block, which may be short."""
    return int(permute(np.array([n - 1]), n, key, inverse=True)[0])


def _blocks_for(rest: int, size: int, blocks: int, block: int, seed: int, source: int, passed: int) -> int:
    """Slots that hold ``rest`` words when the source's last block is short."""
    if not rest:
        return 0
    missing = blocks * block - size
    k = -(-rest // block)
    if missing and _short_at(blocks, _key(seed, source, passed)) < k:
        k = -(-(rest + missing) // block)
    return k


def _slot_rows(plan: Plan, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """(source, block index, words taken, shard, pass) of the slots numbered ``start``, source after source."""
    ends = np.cumsum(plan.slots)
    source = np.searchsorted(ends, start, side="right")
    k = start - (ends - plan.slots)[source]
    index, take, shard, turn = (np.empty_like(k) for _ in range(4))
    for s in np.unique(source):
        at = np.flatnonzero(source == s)
        n, ks = int(plan.blocks[s]), k[at]
        turn[at] = passed = ks // n
        for p in np.unique(passed):
            here = at[passed == p]
            index[here] = permute(k[here] % n, n, _key(plan.seed, int(s), int(p)))
        take[at] = np.where(index[at] == n - 1, plan.sizes[s] - (n - 1) * plan.block, plan.block)
        last = at[ks == plan.slots[s] - 1]
        if len(last):
            # the whole slots before the last: all passes but what the last pass lacks
            whole = int(plan.slots[s]) - 1
            passes, rest = divmod(whole, n)
            words = passes * int(plan.sizes[s]) + rest * plan.block
            missing = n * plan.block - int(plan.sizes[s])
            if missing and rest and _short_at(n, _key(plan.seed, int(s), passes)) < rest:
                words -= missing
            take[last] = plan.quota[s] - words
        shard[at] = np.searchsorted(np.cumsum(plan.counts[:, s]), ks, side="right")
    return source, index, take, shard, turn


def slots(spark: SparkSession, plan: Plan, per_task: int = 1 << 18) -> DataFrame:
    """The mix: (shard, source_no, slot, turn, block_no, take), one row for each slot; turn is the pass over the source."""
    total = int(plan.slots.sum())
    names = ["shard", "source_no", "slot", "turn", "block_no", "take"]
    schema = "shard long, source_no long, slot long, turn long, block_no long, take long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column(0).to_numpy(zero_copy_only=False)
            source, index, take, shard, turn = _slot_rows(plan, number)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (shard, source, number, turn, index, take)], names=names)

    return spark.range(0, total, 1, max(1, -(-total // per_task))).mapInArrow(run, schema)


def place(docs: DataFrame, salts: int | None = None) -> DataFrame:
    """Add ``at``, the position of a document's first word among its source's words.

    ``docs``, a stored table, has doc_id, source and size, and may have ``_key``,
    which tells rows apart that tie in these.  Documents are dealt into ``salts``
    groups of each source by a hash, of some 200,000 rows if one source has them
    all; running sums inside the groups and over the groups' totals give the
    positions, so no source is summed up in one task.
    """
    salts = salts or max(512, -(-docs.count() // 200_000))
    spread = docs.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "size"), F.lit(salts)).cast("int"))
    group = ["source", "_salt"]
    totals = spread.groupBy(*group).agg(F.sum("size").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("source").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    firsts = totals.select(*group, F.coalesce(before, F.lit(0)).alias("_first"))
    order = Window.partitionBy(*group).orderBy(F.xxhash64("doc_id"), "doc_id", "size", *[c for c in docs.columns if c == "_key"]).rowsBetween(Window.unboundedPreceding, -1)
    inside = spread.withColumn("_inside", F.coalesce(F.sum("size").over(order), F.lit(0)))
    same = inside["source"].eqNullSafe(firsts["source"]) & (inside["_salt"] == firsts["_salt"])
    return inside.join(firsts, same).select(*[inside[c] for c in docs.columns], (F.col("_first") + F.col("_inside")).alias("at"))


def mix(docs: DataFrame, weights=(3.0, 1.0, 2.0), share: float = 1.5, max_repeats: float = 2.0, block: int = 256, shards: int = 64, seed: int = 7, max_sources: int = 100_000):
    """Mix ``docs`` (doc_id, source, size; a stored table).

    Sources by code point, null last, have ``weights``, repeating.  Returns the
    plan, the documents with their positions and source numbers, and the taken
    parts (source_no, at, shard, slot, turn, first, words): ``words`` of the document
    at ``at`` from its word ``first`` on.
    """
    by_source = docs.groupBy("source").agg(F.sum("size").alias("n")).limit(max_sources + 1).collect()
    if len(by_source) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    found = sorted(((r["source"], int(r["n"] or 0)) for r in by_source), key=lambda x: (x[0] is None, x[0] or ""))
    plan = make_plan([s for s, _ in found], [n for _, n in found], [weights[i % len(weights)] for i in range(len(found))], share, max_repeats, block, shards, seed)
    spark = docs.sparkSession
    numbers = spark.createDataFrame(
        [(i, s, int(plan.sizes[i]), float(plan.targets[i])) for i, s in enumerate(plan.names)], "source_no long, name string, source_size long, target double"
    )
    placed = place(docs)
    placed = placed.join(F.broadcast(numbers), placed["source"].eqNullSafe(numbers["name"])).drop("name")
    some = placed.where("size > 0").select("source_no", "at", "size")
    parts = some.withColumn("block_no", F.explode(F.sequence(F.expr(f"at div {block}"), F.expr(f"(at + size - 1) div {block}"))))
    start = F.greatest(F.col("at"), F.col("block_no") * block)
    stop = F.least(F.col("at") + F.col("size"), F.col("block_no") * block + F.col("take"))
    taken = (
        slots(spark, plan)
        .join(parts, ["source_no", "block_no"])
        .where(stop > start)
        .select("source_no", "at", "shard", "slot", "turn", (start - F.col("at")).alias("first"), (stop - start).alias("words"))
    )
    return plan, placed, taken


def taken_words(docs: DataFrame, **parameters) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each row of ``docs`` (doc_id, source, text)."""
    sized = cut(docs.select("doc_id", "source", words_in(F.col("text")).alias("size")))
    _, placed, taken = mix(sized, **parameters)
    # a position belongs to one document of its source that has words
    sums = taken.groupBy("source_no", "at").agg(F.sum("words").alias("taken"))
    some = placed.where("size > 0").join(sums, ["source_no", "at"], "left")
    none = placed.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    columns = ["doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")]
    return some.select(*columns).unionByName(none.select(*columns))


def mixed_documents(docs: DataFrame, **parameters) -> DataFrame:
    """The mix as rows of doc_id, text, lang, source, n_chars.

    A row is a stretch of words that one pass over the source takes from a
    document without a break: the text as it is where the pass takes all of it,
    else the text from the stretch's first word to its last.
    """
    columns = ["doc_id", "text", "lang", "source"]
    keyed = docs.select(*columns, F.xxhash64(*columns).alias("_key"))
    sized = cut(keyed.select("doc_id", "_key", "source", words_in(F.col("text")).alias("size")))
    _, placed, taken = mix(sized, **parameters)
    parts = taken.groupBy("source_no", "at").agg(F.sort_array(F.collect_list(F.struct("turn", "first", "words"))).alias("parts"))
    rows = placed.where("size > 0").select("source_no", "at", "size", F.col("doc_id").alias("_id"), "_key").join(parts, ["source_no", "at"]).drop("source_no", "at")
    # equal rows have parts of their own but share one text
    once = keyed.dropDuplicates(["doc_id", "_key"])
    joined = once.join(rows, F.col("doc_id").eqNullSafe(F.col("_id")) & (once["_key"] == rows["_key"])).select(*columns, "size", "parts")
    schema = T.StructType([*(docs.schema[c] for c in columns), T.StructField("n_chars", T.LongType())])
    word = re.compile("[^\x20\x09-\x0D]+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            get = lambda name: batch.column(batch.schema.get_field_index(name))
            at, made = [], []
            for i, (text, size, own) in enumerate(zip(get("text").to_pylist(), get("size").to_pylist(), get("parts").to_pylist())):
                spans = None
                for first, words in _stretches(own):
                    if words == size:
                        made.append(text)
                    else:
                        spans = spans or [m.span() for m in word.finditer(text)]
                        made.append(text[spans[first][0] : spans[first + words - 1][1]])
                    at.append(i)
            where = pa.array(at, pa.int64())
            arrays = {"text": pa.array(made, pa.string()), "n_chars": pa.array([len(x) for x in made], pa.int64())}
            yield pa.RecordBatch.from_arrays([arrays[f.name] if f.name in arrays else get(f.name).take(where) for f in schema], names=schema.names)

    return joined.mapInArrow(run, schema)


def _stretches(parts: list[dict]) -> list[tuple[int, int]]:
    """(first word, words) of the unbroken stretches of each pass, from parts sorted by pass and first word."""
    out: list[list[int]] = []
    turn = None
    for p in parts:
        if p["turn"] == turn and out[-1][0] + out[-1][1] == p["first"]:
            out[-1][1] += p["words"]
        else:
            out.append([p["first"], p["words"]])
            turn = p["turn"]
    return [(a, n) for a, n in out]
