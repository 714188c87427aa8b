"""Collocations: frequent phrases whose words belong together, by pivot partitioning.

The pivot of a phrase is its rarest word (of equal ones the first).  Each place
in the text sends the stretch in which it is the pivot to that word's partition:
up to three words to each side, as long as they aren't rarer.  Equal stretches of
a task travel once, with their number.  A partition counts the phrases that hold
its pivot and gives out those that are frequent; as every occurrence of a phrase
has the same pivot, no other partition counts it.  Partitions of very frequent
words are split by their stretches and their counts added up.

Words travel as their places in a dictionary of each language's frequent words,
the most frequent first.  It has ``most_words`` entries at most, which bounds what
each worker holds.  If no more words are frequent, words outside can't be part of
a frequent phrase and end a stretch.  If more are, those outside travel as text
and count as rarer than all inside; results are the same.

A phrase that occurs ``a`` times is cut in two at each place; with ``l`` and ``r``
the occurrences of its parts the score of a cut is floor(scale * a / (l + r)), in
whole numbers of any size.  The cut with the lowest score counts, of equals the
first.  Phrases inside a longer one with 100 * f(longer) >= ``cover`` * a go.

Defined results: a null text is empty, a null language is ``und``; equal rows are
documents of their own; a text of any length is read in blocks; an empty table
has no phrases; other columns are not read.  Ties go to the phrase that occurs
more often, then to the smaller one in UTF-8 order.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, column, cut, small

LONGEST, MIN_COUNT, SCALE, COVER, TOP = 4, 30, 2_000_000, 80, 2000
MOST_WORDS = 1 << 18
#: Different stretches of one pivot that a task counts at once, at most on average.
PER_PART = 1 << 18
#: ASCII letters in lower case; what ends a piece as a line end, a tab as a space.
ENDS = bytes(10 if i in b".,;:!?\n\x0b\x0c\r" else 32 if i == 9 else i + 32 if 65 <= i <= 90 else i for i in range(256))

#: Codes of a stretch: 0 is none, words of the dictionary come from 1 on, others after them.
_BITS, _MASK = 20, (1 << 20) - 1
_SIDE = LONGEST - 1


def word_counts(docs: DataFrame, min_count: int = MIN_COUNT, most: int = 400_000) -> DataFrame:
    """(lang, word, n): how often each word occurs in each language; those with fewer than ``min_count`` occurrences are one row, word null."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def flush(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, n in held.items():
            words = pa.array(list(n), pa.binary()).view(pa.string())
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(n)), words, pa.array(list(n.values()), pa.int64())], schema=schema)
        held.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for batch in small(batches):
            for i, lang in enumerate(column(batch, "lang").to_pylist()):
                for block in blocks(batch, i, ENDS):
                    n = held.setdefault(lang, Counter())
                    n.update(block.replace(b"\n", b" ").split(b" "))
                    n.pop(b"", None)
                    if len(n) > most:
                        yield from flush(held)
            if sum(map(len, held.values())) > most:
                yield from flush(held)
        yield from flush(held)

    summed = docs.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return summed.select("lang", F.when(F.col("n") >= min_count, F.col("word")).alias("word"), "n").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Dictionary:
    """The most frequent words of each language and their counts; ``complete`` if no other word is frequent."""

    def __init__(self, words: dict[str, list[bytes]], counts: dict[str, np.ndarray], complete: bool, least: int):
        self.words, self.counts, self.complete, self.least = words, counts, complete, least
        self.names = sorted(words)
        self.codes: dict[str, dict[bytes, int]] | None = None

    def __getstate__(self):
        return self.__dict__ | {"codes": None}

    def of(self, lang: str) -> dict[bytes, int]:
        """The code of each word, built once a process."""
        if self.codes is None:
            self.codes = {}
        if lang not in self.codes:
            self.codes[lang] = {w: i + 1 for i, w in enumerate(self.words.get(lang, []))}
        return self.codes[lang]

    def number(self, lang: str) -> int:
        """The place of a language among those that have words here."""
        return bisect_left(self.names, lang)

    def parts(self, lang: str, pivots: np.ndarray, per_part: int) -> np.ndarray:
        """In how many parts the partition of each pivot, a word of the dictionary, is counted."""
        counts = self.counts.get(lang, np.zeros(0, dtype=np.int64))
        # a frequent word has few more frequent ones beside it, so that its stretches are few different ones; the bar keeps the power in 64 bits
        return 1 + np.minimum(counts[pivots - 1], np.minimum(pivots, 1000) ** (2 * _SIDE)) // per_part


def dictionary(counts: DataFrame, min_count: int = MIN_COUNT, most_words: int = MOST_WORDS) -> Dictionary:
    """The words of ``counts`` (lang, word, n) with at least ``min_count`` occurrences, or, if these are more than ``most_words``, those with a higher bar."""
    bar, complete = min_count, True
    while counts.where(F.col("n") >= bar).count() > most_words:
        bar, complete = bar * 2, False
    found = counts.where(F.col("n") >= bar).toArrow().to_pydict()
    words: dict[str, list] = {}
    for lang, word, n in zip(found["lang"], found["word"], found["n"]):
        words.setdefault(lang, []).append((-n, word.encode("utf-8", "surrogatepass")))
    for held in words.values():
        held.sort()
    return Dictionary({k: [w for _, w in v] for k, v in words.items()}, {k: np.array([-n for n, _ in v], dtype=np.int64) for k, v in words.items()}, complete, bar)


def _pack(items: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(items[0]), dtype=np.int64)
    for x in items:
        out = (out << _BITS) | x
    return out


def _unpack(packed: np.ndarray, n: int) -> list[np.ndarray]:
    return [(packed >> (_BITS * (n - 1 - i))) & _MASK for i in range(n)]


class _Stream:
    """The stretches of one language's words, read as one stream in which piece ends are words that nothing passes."""

    def __init__(self, known: dict[bytes, int], complete: bool):
        self.known, self.complete, self.first = known, complete, len(known) + 1
        self.outside: dict[bytes, int] = {}
        self.orders: list[int] = []  # of the words outside: how rare they count
        none = np.zeros(_SIDE, dtype=np.int64)
        self.codes, self.order = none, none  # begins with what is context only
        self.held: list[pa.Table] = []
        self.rows = 0

    def code(self, word: bytes) -> int:
        got = self.outside.get(word)
        if got is None:
            got = self.outside[word] = self.first + len(self.outside)
            self.orders.append(self.first + (xxhash.xxh64_intdigest(word) >> 2))
        return got

    def add(self, block: bytes) -> None:
        words = block.replace(b"\n", b" \n ").split(b" ")
        known = self.known
        if self.complete:
            codes = np.fromiter((known.get(w, 0) if w else -1 for w in words), dtype=np.int64, count=len(words))
        else:
            codes = np.fromiter((known.get(w) or (0 if w == b"\n" else self.code(w)) if w else -1 for w in words), dtype=np.int64, count=len(words))
        codes = codes[codes >= 0]
        order = codes
        if self.outside:
            order, out = codes.copy(), codes >= self.first
            order[out] = np.array(self.orders, dtype=np.int64)[codes[out] - self.first]
        self.codes, self.order = np.concatenate([self.codes, codes]), np.concatenate([self.order, order])
        self.take(len(self.codes) - _SIDE)

    def end(self) -> None:
        """End of a text: nothing passes it."""
        none = np.zeros(1, dtype=np.int64)
        self.codes, self.order = np.concatenate([self.codes, none]), np.concatenate([self.order, none])

    def take(self, stop: int) -> None:
        """The stretches of the places before ``stop`` that have not been taken."""
        start = _SIDE
        if stop <= start:
            return
        codes, order = self.codes, self.order
        at = np.nonzero(codes[start:stop])[0] + start
        mine = order[at]
        sides = []
        for step in (-1, 1):
            open_, side = np.ones(len(at), dtype=bool), []
            for k in range(1, _SIDE + 1):
                next_ = order[at + step * k]
                # to the left only more frequent words pass, so that the first of equals is the pivot
                open_ &= (next_ > 0) & ((next_ < mine) if step < 0 else (next_ <= mine))
                side.append(np.where(open_, codes[at + step * k], 0))
            sides.append(side)
        left, right = _pack(sides[0]), _pack(sides[1])
        some = (left > 0) | (right > 0)
        self.held.append(pa.table({"pivot": codes[at][some], "left": left[some], "right": right[some], "n": np.ones(int(some.sum()), dtype=np.int64)}))
        self.rows += int(some.sum())
        self.codes, self.order = codes[stop - _SIDE :], order[stop - _SIDE :]

    def full(self) -> bool:
        return self.rows > 1_000_000 or len(self.outside) > 1 << 18

    def flush(self) -> pa.Table | None:
        """Different stretches with their numbers.  What is kept back goes on."""
        if not self.held:
            return None
        found = pa.concat_tables(self.held).group_by(["pivot", "left", "right"]).aggregate([("n", "sum")])
        self.held, self.rows = [], 0
        return found.rename_columns(["pivot", "left", "right", "n"])

    def forget(self, found: pa.Table | None) -> tuple[list, ...] | None:
        """The words outside in ``found`` as text; the numbers of those in the context begin anew."""
        words = list(self.known) + list(self.outside) if found is not None and self.outside else None
        old = {v: k for k, v in self.outside.items()}
        self.outside, self.orders = {}, []
        self.codes = np.array([self.code(old[c]) if c >= self.first else c for c in self.codes.tolist()], dtype=np.int64)
        return words


STRETCH = "key long, data binary, words array<string>, at int, n long"
_SCHEMA = pa.schema([("key", pa.int64()), ("data", pa.binary()), ("words", pa.list_(pa.string())), ("at", pa.int32()), ("n", pa.int64())])
#: A key is language, pivot and part in so many bits.
_PART_BITS = 22


def _packed(found: pa.Table, lang: int, known: Dictionary, name: str, per_part: int) -> Iterator[pa.RecordBatch]:
    """One row for each pivot and part of ``found``: the left side, right side and number of each of its stretches."""
    pivot, left, right, n = (found.column(c).to_numpy() for c in ("pivot", "left", "right", "n"))
    mixed = (left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (right.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    part = ((mixed >> np.uint64(33)) % known.parts(name, pivot, per_part).astype(np.uint64)).astype(np.int64)
    key = (((np.int64(lang) << _BITS) | pivot) << _PART_BITS) | part
    order = np.lexsort((right, left, key))
    key, data = key[order], np.stack([left, right, n], axis=1)[order]
    starts = np.nonzero(np.diff(key, prepend=-1))[0]
    bounds = np.append(starts, len(key))
    for a in range(0, len(starts), 8192):
        ends = bounds[a : a + 8193]
        offsets = ((ends - ends[0]) * data.itemsize * 3).astype(np.int32)
        size = len(ends) - 1
        blob = pa.BinaryArray.from_buffers(pa.binary(), size, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[ends[0] : ends[-1]]))])
        yield pa.RecordBatch.from_arrays([pa.array(key[ends[:-1]]), blob, pa.nulls(size, _SCHEMA.field("words").type), pa.nulls(size, pa.int32()), pa.nulls(size, pa.int64())], schema=_SCHEMA)


def _as_text(found: pa.Table, stream: _Stream, words: list[bytes], name: str, orders: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Stretches with words outside the dictionary: their language and words as text, the pivot's place and their number."""
    pivot, left, right, n = (found.column(c).to_numpy() for c in ("pivot", "left", "right", "n"))
    sides = np.stack(_unpack(left, _SIDE)[::-1] + [pivot] + _unpack(right, _SIDE), axis=1)
    for a in range(0, len(pivot), 4096):
        rows = sides[a : a + 4096].tolist()
        text = [[name, *[words[c - 1].decode("utf-8", "surrogatepass") for c in row if c]] for row in rows]
        at = [sum(c > 0 for c in row[:_SIDE]) for row in rows]
        key = orders[pivot[a : a + 4096] - stream.first]
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.nulls(len(rows), pa.binary()), pa.array(text, _SCHEMA.field("words").type), pa.array(at, pa.int32()), pa.array(n[a : a + 4096])], schema=_SCHEMA)


def stretches(docs: DataFrame, shared, per_part: int = PER_PART) -> DataFrame:
    """The stretches of ``docs`` (lang, text) by ``key``, which is language, pivot and part.

    A row of ``data`` has many, as packed codes, nearest word first.  If a word is
    outside the dictionary a stretch is a row of its own with its words.
    """

    def given(name: str, stream: _Stream, known: Dictionary) -> Iterator[pa.RecordBatch]:
        found, orders = stream.flush(), np.array(stream.orders, dtype=np.int64)
        words = stream.forget(found)
        if found is None:
            return
        if words is not None:
            # the pivot is the rarest, so a word outside is there if and only if the pivot is one
            outside = pc.greater_equal(found["pivot"], stream.first)
            yield from _as_text(found.filter(outside), stream, words, name, orders)
            found = found.filter(pc.invert(outside))
        yield from _packed(found, known.number(name), known, name, per_part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        streams: dict[str, _Stream] = {}
        for batch in small(batches):
            for i, lang in enumerate(column(batch, "lang").to_pylist()):
                if lang not in streams:
                    streams[lang] = _Stream(known.of(lang), known.complete)
                stream = streams[lang]
                for block in blocks(batch, i, ENDS):
                    stream.add(block)
                    if stream.full():
                        yield from given(lang, stream, known)
                stream.end()
            if sum(s.rows for s in streams.values()) > 1_500_000:
                for lang, stream in streams.items():
                    yield from given(lang, stream, known)
        for lang, stream in streams.items():
            for _ in range(_SIDE):
                stream.end()
            stream.take(len(stream.codes) - _SIDE)
            yield from given(lang, stream, known)

    return docs.mapInArrow(run, STRETCH)


#: Which words beside the pivot a phrase has: so many to the left, so many to the right.
_WINDOWS = [(a, b) for a in range(LONGEST) for b in range(LONGEST) if 1 <= a + b < LONGEST]


def _phrases(pivot: np.ndarray, split: np.ndarray, data: np.ndarray) -> pa.Table:
    """(split, head, tail, n): the phrases around each stretch's pivot, their codes packed two and two."""
    left, right, n = _unpack(data[:, 0], _SIDE), _unpack(data[:, 1], _SIDE), data[:, 2]
    none = np.zeros(len(n), dtype=np.int64)
    found = []
    for a, b in _WINDOWS:
        has = (left[a - 1] > 0) if a else np.ones(len(n), dtype=bool)
        if b:
            has = has & (right[b - 1] > 0)
        items = [x[has] for x in [*left[:a][::-1], pivot, *right[:b], *[none] * (_SIDE - a - b)]]
        found.append(pa.table({"split": split[has], "head": _pack(items[:2]), "tail": _pack(items[2:]), "n": n[has]}))
    return pa.concat_tables(found).group_by(["split", "head", "tail"]).aggregate([("n", "sum")]).rename_columns(["split", "head", "tail", "n"])


def mined(sent: DataFrame, shared, min_count: int = MIN_COUNT, per_part: int = PER_PART, most: int = 400_000) -> DataFrame:
    """(lang, phrase, words, n): how often phrases of two words and more occur; those of split pivots may come in several rows.

    Whole partitions of pivots are counted together, about ``most`` stretches at once.
    """
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("n", pa.int64())])

    def given(keys: np.ndarray, data: np.ndarray, known: Dictionary) -> Iterator[pa.RecordBatch]:
        lang = keys >> (_BITS + _PART_BITS)
        for number in np.unique(lang).tolist():
            name, here = known.names[number], lang == number
            pivot = (keys[here] >> _PART_BITS) & _MASK
            found = _phrases(pivot, known.parts(name, pivot, per_part) > 1, data[here])
            # a phrase has one pivot: what isn't split is complete
            found = found.filter(pc.or_(found["split"], pc.greater_equal(found["n"], min_count)))
            words, n = known.words[name], found["n"].to_numpy()
            codes = np.stack(_unpack(found["head"].to_numpy(), 2) + _unpack(found["tail"].to_numpy(), 2), axis=1)
            text = [b" ".join([words[c - 1] for c in row if c]) for row in codes.tolist()]
            table = pa.table([pa.repeat(pa.scalar(name, pa.string()), len(text)), pa.array(text, pa.binary()).view(pa.string()), pa.array((codes > 0).sum(axis=1).astype(np.int32)), pa.array(n)], schema=schema)
            yield from table.to_batches(max_chunksize=50_000)

    def as_batch(found: Counter) -> pa.RecordBatch:
        lang, phrase, words = zip(*found)
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(phrase, pa.string()), pa.array(words, pa.int32()), pa.array(list(found.values()), pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, text = shared.value, Counter()
        keys, data, rows = [], [], 0
        for batch in small(batches):
            as_text = batch.filter(pc.is_valid(column(batch, "words")))
            for words, at, n in zip(*(column(as_text, c).to_pylist() for c in ("words", "at", "n"))):
                own = words[1:]
                for a, b in _WINDOWS:
                    if at >= a and at + b < len(own):
                        text[(words[0], " ".join(own[at - a : at + b + 1]), a + b + 1)] += n
            if len(text) > 200_000:
                yield as_batch(text)
                text.clear()
            packed = batch.filter(pc.is_valid(column(batch, "data")))
            if not packed.num_rows:
                continue
            blob = column(packed, "data")
            keys.append(np.repeat(column(packed, "key").to_numpy(), pc.binary_length(blob).to_numpy() // 24))
            data.append(np.concatenate([np.frombuffer(x.as_buffer(), dtype=np.int64) for x in blob]).reshape(-1, 3))
            rows += len(keys[-1])
            if rows > most:
                # the last pivot may go on in the next batch
                whole, all_ = np.concatenate(keys), np.concatenate(data)
                end = int(np.searchsorted(whole, whole[-1]))
                if end:
                    yield from given(whole[:end], all_[:end], known)
                keys, data, rows = [whole[end:]], [all_[end:]], len(whole) - end
        if keys:
            yield from given(np.concatenate(keys), np.concatenate(data), known)
        if text:
            yield as_batch(text)

    return sent.repartition("key").sortWithinPartitions("key").mapInArrow(run, "lang string, phrase string, words int, n long")


def frequent(docs: DataFrame, counts: DataFrame, min_count: int = MIN_COUNT, most_words: int = MOST_WORDS, per_part: int = PER_PART) -> DataFrame:
    """(lang, phrase, words, n): all phrases of one to four words with ``min_count`` occurrences."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionary(counts, min_count, most_words))
    longer = mined(stretches(docs, shared, per_part), shared, min_count, per_part)
    summed = longer.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    return summed.unionByName(counts.where(F.col("n") >= min_count).select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), "n"))


def scored(phrases: DataFrame, scale: int = SCALE, salts: int = 16) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of several words, by their worst cut.

    A single word may be the part of many phrases: its row is there ``salts`` times,
    and phrases are dealt out to them.
    """
    split = F.split("phrase", " ")
    part = lambda a, n: F.array_join(F.slice(split, a, n), " ")
    cuts = phrases.where("words > 1").select("lang", "phrase", F.col("n").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    ends = F.array(F.struct(F.lit("l").alias("end"), part(F.lit(1), F.col("k")).alias("part")), F.struct(F.lit("r").alias("end"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("part")))
    asked = cuts.select("lang", "phrase", "a", "k", F.explode(ends).alias("x")).select("lang", "phrase", "a", "k", "x.end", "x.part")
    salt = F.when(F.instr("part", " ") == 0, F.pmod(F.xxhash64("phrase"), F.lit(salts))).otherwise(0)
    copies = F.when(F.col("words") == 1, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))).cast("array<long>")
    known = phrases.select("lang", F.col("phrase").alias("part"), F.explode(copies).alias("salt"), "n")
    met = asked.withColumn("salt", salt).join(known, ["lang", "part", "salt"])
    both = met.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("end") == "l", F.col("n"))).alias("l"), F.max(F.when(F.col("end") == "r", F.col("n"))).alias("r"))
    whole = lambda c: c.cast("decimal(19,0)")
    score = F.call_function("div", whole(F.col("a")) * F.lit(scale).cast("decimal(10,0)"), whole(F.col("l")) + whole(F.col("r")))
    worst = both.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    return worst.select("lang", "phrase", "a", "x.l", "x.r", "x.score")


def uncovered(scores: DataFrame, phrases: DataFrame, cover: int = COVER) -> DataFrame:
    """The rows of ``scores`` whose phrases aren't inside a longer one that occurs nearly as often."""
    inner = F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' '))))")
    inside = phrases.where("words > 2").select("lang", "n", F.explode(inner).alias("phrase"))
    most = inside.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    over = F.col("longer").cast("decimal(19,0)") * 100 >= F.col("a").cast("decimal(19,0)") * cover
    return scores.join(most, ["lang", "phrase"], "left").where(F.col("longer").isNull() | ~over).drop("longer")


def best(scores: DataFrame, top: int = TOP, parts: int = 64) -> DataFrame:
    """The first ``top`` phrases of each language with their ranks; the first of each of ``parts`` parts come first, so that no task sorts a language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = Window.partitionBy("lang", "part").orderBy(*order)
    few = scores.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts))).withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)
    return few.drop("part").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def mine(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, scale: int = SCALE, cover: int = COVER, most_words: int = MOST_WORDS, per_part: int = PER_PART) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the collocations of each language, the best first."""
    named = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    # rare words are no phrase and no part of one; only their sum counts
    counts = cut(word_counts(named, min_count))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    counts = counts.where("word is not null")
    phrases = cut(frequent(named, counts, min_count, most_words, per_part))
    found = best(uncovered(scored(phrases, scale), phrases, cover), top)
    return found.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
