"""Packing tokenised documents into sequences of a fixed capacity.

A document is its token ids and one end token; only documents longer than the
capacity are cut, into full pieces and a rest.  Packing needs the lengths
alone, and there are no more different lengths than the capacity: the driver
gets one count for each length, whatever the number of documents.

The plan is made on those counts by exact-complement hashing.  From the longest
length down, the gap that a piece leaves is looked up among single lengths, then
among the sums of two and of three lengths that are still available; each hit is
consumed as often as the counts allow, so it exhausts a length.  What has no
exact complement is packed best fit, longest first, again by counts.  Then the
pieces of each length are numbered, and a piece's number tells its place.

Defined results: a null text counts as the empty text, which is the end token
alone; ids may be null and rows may repeat, each row is packed for itself;
equal inputs give equal plans, and rows that tie get places in the order of
their id and piece; an empty table gives no sequence; only doc_id and text are
read.  A text of any length is tokenized word by word, as a whole where the
tokenizer can't be read so, and its ids are held in its task.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, small, texts

#: White space by Python's rule that tokenizers may take for something else.
_UNSURE = re.compile("[\x0b\x0c\x1c-\x1f\x85]")
#: A word of Latin-1 letters and trailing marks: two runs to the tokenizer, in normal form but for the case.
_PLAIN = re.compile("([a-zA-ZÀ-ÖØ-öø-ÿ]+)([.,;:!?*%&$#|]*)")


def _byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Encoder:
    """Token ids of texts as bytes, remembering the ids of words and letter runs seen before.

    Made for ``word_bpe``: it folds case, cuts at white space, and keeps runs
    of letters and runs of marks apart, so ids of words are those of their runs.
    Words that aren't plainly letters and marks go through the whole tokenizer.
    A tokenizer that reads a text of all these kinds otherwise gets whole texts.
    ``remember`` bounds the words and the runs kept.
    """

    PROBE = "The CAT's hats, naïve Übung; word2vec don't stop... 12,5 % off! (x) a_b $9 #tag ÀÉ ß ÑANDÚ 日本 Tokens:\n\n two  spaces\tand a_long/path -- end"

    def __init__(self, path: str, remember: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks of an executor share its cores already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.remember = remember
        self.words: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {"": b""}
        self.shown = _byte_characters()
        self.by_word = True
        self.by_word = self._agrees()

    def _agrees(self) -> bool:
        try:
            return next(self.encode([self.PROBE])) == self._ids(self.PROBE)
        except Exception:  # a model that can't be asked for single words
            return False

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _run(self, run: str) -> bytes:
        ids = self.runs.get(run)
        if ids is None:
            # printable ASCII stands for itself
            made = self.tokenizer.model.tokenize(run if run.isascii() else "".join([self.shown[b] for b in run.encode()]))
            ids = made[0].id.to_bytes(4, "little") if len(made) == 1 else array("I", [t.id for t in made]).tobytes()
            self.runs[run] = ids
        return ids

    def _word(self, word: str) -> bytes:
        m = _PLAIN.fullmatch(word)
        return self._run(m[1].lower()) + self._run(m[2]) if m else self._ids(word)

    def encode(self, docs: list[str]) -> Iterator[bytes]:
        """Ids of each text, four bytes an id."""
        words = self.words
        for text in docs:
            if not self.by_word or _UNSURE.search(text):
                yield self._ids(text)
                continue
            split = text.split()
            try:
                yield b"".join([words[w] for w in split])
            except KeyError:
                if len(words) > self.remember:
                    words.clear()
                if len(self.runs) > self.remember:
                    self.runs.clear()
                    self.runs[""] = b""
                for w in split:
                    if w not in words:
                        words[w] = self._word(w)
                yield b"".join([words[w] for w in split])


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each piece of ``docs`` (doc_id, text).

    ``tokenizer`` is the path of a tokenizer file that each executor can read.
    """
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
        ]
    )
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(tokenizer)  # for this task alone: a worker that goes on to other stages doesn't keep its words
        for batch in small(batches):
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(coder.encode(texts(batch))):
                ids += end
                for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[a : a + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(a // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            ids = batch.column(batch.schema.get_field_index("doc_id")).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths, how many alike), for ``counts`` pieces of each length.

    The number of entries depends on the number of lengths, not on the counts.
    """
    have = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} doesn't fit a capacity of {capacity}")
        have[length] = n
    out: list[tuple[tuple[int, ...], int]] = []

    def use(parts: tuple[int, ...]) -> int:
        n = min(int(have[x]) // parts.count(x) for x in parts)
        if n:
            for x in parts:
                have[x] -= n
            out.append((parts, n))
        return n

    if have[capacity]:
        use((capacity,))
    for first in range(capacity - 1, 0, -1):
        gap = capacity - first
        if have[first] and gap <= capacity and have[gap]:
            use((first, gap))
        while have[first] and (pair := _pair(have, gap, first)):
            if not use((first, *pair)):
                break
        while have[first] and (triple := _triple(have, gap, first)):
            if not use((first, *triple)):
                break
    return out + _best_fit(have, capacity)


def _pair(have: np.ndarray, gap: int, first: int = 0) -> tuple[int, int] | None:
    """Two available lengths with sum ``gap``, the larger as large as it can be; ``first`` is taken once already."""
    if gap < 2:
        return None
    small = np.arange(1, gap // 2 + 1)
    large = gap - small
    need_small = 1 + (small == large) + (small == first)
    need_large = 1 + (small == large) + (large == first)
    good = np.flatnonzero((have[small] >= need_small) & (have[large] >= need_large))
    if not len(good):
        return None
    s = int(small[good[0]])
    return gap - s, s


def _triple(have: np.ndarray, gap: int, first: int) -> tuple[int, int, int] | None:
    """Three available lengths with sum ``gap``, from the largest down."""
    for large in np.flatnonzero(have[: gap - 1])[::-1]:
        large = int(large)
        if large < 1 or 3 * large < gap:
            break
        if have[large] < 1 + (large == first):
            continue
        have[large] -= 1
        rest = _pair(have, gap - large, first)
        have[large] += 1
        if rest and rest[0] <= large:
            parts = (large, *rest)
            if all(have[x] >= parts.count(x) + (x == first) for x in parts):
                return parts
    return None


def _best_fit(have: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first: alike sequences are filled and split together."""
    open_gaps: list[int] = []
    by_gap: dict[int, list[list]] = defaultdict(list)
    full: list[tuple[tuple[int, ...], int]] = []

    def put(parts: tuple[int, ...], n: int, gap: int) -> None:
        if gap == 0:
            full.append((parts, n))
            return
        if not by_gap[gap]:
            insort(open_gaps, gap)
        by_gap[gap].append([parts, n])

    for length in np.flatnonzero(have)[::-1].tolist():
        left = int(have[length])
        while left:
            at = bisect_left(open_gaps, length)
            if at == len(open_gaps):
                # as many new sequences as hold all that is left of this length
                each = min(left, capacity // length)
                n = left // each
                put((length,) * each, n, capacity - each * length)
                left -= n * each
                continue
            gap = open_gaps[at]
            parts, n = by_gap[gap].pop()
            if not by_gap[gap]:
                open_gaps.pop(at)
            took = min(n, left)
            if took < n:
                put(parts, n - took, gap)
            put((*parts, length), took, gap - length)
            left -= took
    return full + [(tuple(p), n) for gap in by_gap for p, n in by_gap[gap]]


def _places(planned: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first number, first sequence, offset), sorted: which pieces of a length go where."""
    cursor: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for parts, n in planned:
        offset = 0
        for length in parts:
            rows.append((length, cursor[length], sequence, offset))
            cursor[length] += n
            offset += length
        sequence += n
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def pack(cut_pieces: DataFrame, capacity: int = 4096, salts: int | None = None) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (doc_id, piece, length, ...), which should be a stored table.

    Pieces of a length are numbered in ``salts`` groups by their id, of some 200,000
    rows if all have one length, whose sizes a running sum turns into the groups'
    first numbers, so that a length with a third of all rows is spread.
    """
    salts = salts or max(512, -(-cut_pieces.count() // 200_000))
    spread = cut_pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    sizes = spread.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    per_length = {int(r["length"]): int(r["n"]) for r in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    places = _places(plan(per_length, capacity))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    firsts = sizes.select("length", "_salt", F.coalesce(before, F.lit(0)).alias("_first"))
    within = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece"))
    numbered = (
        spread.withColumn("_within", within)
        .join(firsts, ["length", "_salt"])
        .select(*cut_pieces.columns, (F.col("_first") + F.col("_within") - 1).alias("_number"))
    )
    kept = [f for f in cut_pieces.schema if f.name not in ("sequence_id", "offset")]
    schema = T.StructType([*kept, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    # one sorted key: a length's numbers lie within its own range
    wide = np.int64(1) << np.int64(48)
    keys = places[:, 0] * wide + places[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda name: batch.column(batch.schema.get_field_index(name))
            length, number = get("length").to_numpy(zero_copy_only=False), get("_number").to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, length * wide + number, side="right") - 1
            columns = [get(f.name) for f in kept]
            columns += [pa.array(places[at, 2] + number - places[at, 1]), pa.array(places[at, 3])]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return numbered.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Cut and pack ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(cut(pieces(docs, tokenizer, capacity, end_id)), capacity)
