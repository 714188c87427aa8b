"""Alignments in binary form (BAM) as a Spark data source (SC18).

A file is a chain of compressed blocks of 64 KB at most, and records run on from
block to block.  A split is a range of the file's bytes and owns the records that
begin in a block that begins in the range.  Where a split starts, the first block
is found by its marks and by the block after it; the first record in it by what a
record must be (a reference that exists, a position inside it, a name that ends,
lengths that fit) and by the records after it.  A record that runs over the
split's end is read to its own.

Files are opened through Arrow's file systems, so paths may be local or in any
store that these know; a folder means all of its files.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "name string, flag int, chrom string, pos0 long, mapq int, cigar string, seq string"
_ARROW = pa.schema([("name", pa.string()), ("flag", pa.int32()), ("chrom", pa.string()), ("pos0", pa.int64()), ("mapq", pa.int32()), ("cigar", pa.string()), ("seq", pa.string())])

# Fixed values of the format: letters of bases and of alignment operations, which of these use the read, the first bytes of a block.
_BASES = np.frombuffer(b"=ACMGRSVTWYHKDBN", dtype=np.uint8)
_OPERATIONS = "MIDNSHP=X"
_USES_READ = frozenset((0, 1, 4, 7, 8))
_BLOCK = b"\x1f\x8b\x08\x04"
_FIXED = struct.Struct("<iiBBHHHiiii")


def _block_size(head: bytes) -> int:
    """Whole length of the block that ``head`` begins, 0 if it begins none."""
    if len(head) < 18 or head[:4] != _BLOCK:
        return 0
    extra = struct.unpack_from("<H", head, 10)[0]
    at, end = 12, min(12 + extra, len(head))
    while at + 6 <= end:
        a, b, size = struct.unpack_from("<BBH", head, at)
        if (a, b, size) == (66, 67, 2):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + size
    return 0


def _blocks(file, at: int) -> Iterator[tuple[int, bytes]]:
    """(place in the file, data) of each block from ``at`` on."""
    size = file.size()
    while at < size:
        file.seek(at)
        head = file.read(64)
        n = _block_size(head)
        if not n:
            raise ValueError(f"no block at byte {at}")
        file.seek(at)
        raw = file.read(n)
        start = 12 + struct.unpack_from("<H", raw, 10)[0]
        yield at, zlib.decompress(raw[start:-8], -15)
        at += n


def _first_block(file, start: int) -> int | None:
    """The first place at or after ``start`` where a block begins."""
    size = file.size()
    file.seek(start)
    window = file.read(min(2 << 16, size - start))
    at = window.find(_BLOCK)
    while at >= 0:
        n = _block_size(window[at : at + 64])
        if n:
            after = start + at + n
            if after == size:
                return start + at
            file.seek(min(after, size))
            if _block_size(file.read(64)):
                return start + at
        at = window.find(_BLOCK, at + 1)
    return None


def _fits(data: bytes, at: int, lengths: list[int]) -> int:
    """The place after the record at ``at`` if one can begin there, else -1; 0 if too little is there to tell."""
    if at + 36 > len(data):
        return 0
    size = struct.unpack_from("<i", data, at)[0]
    ref, pos, n_name, _, _, n_ops, _, n_bases, next_ref, next_pos, _ = _FIXED.unpack_from(data, at + 4)
    inside = lambda r, p: -1 <= r < len(lengths) and -1 <= p <= (lengths[r] if r >= 0 else 1 << 31)
    if size < 32 or size > 1 << 28 or n_name < 1 or n_bases < 0 or not inside(ref, pos) or not inside(next_ref, next_pos):
        return -1
    if 32 + n_name + 4 * n_ops + (n_bases + 1) // 2 + n_bases > size:
        return -1
    name = data[at + 36 : at + 36 + n_name]
    if len(name) == n_name and (name[-1] != 0 or not all(33 <= c <= 126 for c in name[:-1])):
        return -1
    ops = data[at + 36 + n_name : at + 36 + n_name + 4 * n_ops]
    if len(ops) == 4 * n_ops and n_ops:
        codes = np.frombuffer(ops, dtype="<u4")
        if (codes & 15).max() > 8:
            return -1
        if n_bases and int(sum(c >> 4 for c in codes.tolist() if c & 15 in _USES_READ)) != n_bases:
            return -1
    return at + 4 + size


def _first_record(data: bytes, lengths: list[int], complete: bool, chain: int = 6) -> int | None:
    """The first place in ``data`` where records begin, one after the other."""
    for at in range(len(data)):
        now, found = at, 0
        while found < chain:
            after = _fits(data, now, lengths)
            if after <= 0:
                break
            now, found = after, found + 1
            if now >= len(data):
                break
        if found and (found == chain or now > len(data) or (now == len(data) and complete) or (now < len(data) and _fits(data, now, lengths) == 0) or (now == len(data))):
            return at
    return None


def _long_cigar(data: bytes, at: int, end: int) -> np.ndarray | None:
    """Operations of a record that has too many for its own place: the tag CG."""
    sizes = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
    while at + 3 <= end:
        tag, kind = data[at : at + 2], chr(data[at + 2])
        at += 3
        if kind in "ZH":
            at = data.index(0, at) + 1
        elif kind == "B":
            sub, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            if tag == b"CG" and sub == "I":
                return np.frombuffer(data, dtype="<u4", count=n, offset=at + 5)
            at += 5 + n * sizes[sub]
        else:
            at += sizes[kind]
    return None


def _record(data: bytes, names: list[str]) -> tuple | None:
    """A record without its length as a row; None if it isn't aligned."""
    ref, pos, n_name, mapq, _, n_ops, flag, n_bases, _, _, _ = _FIXED.unpack_from(data, 0)
    if ref < 0 or pos < 0 or not n_ops:
        return None
    at = 32 + n_name
    ops = np.frombuffer(data, dtype="<u4", count=n_ops, offset=at)
    packed = np.frombuffer(data, dtype=np.uint8, count=(n_bases + 1) // 2, offset=at + 4 * n_ops)
    letters = _BASES[np.stack([packed >> 4, packed & 15], axis=1).ravel()[:n_bases]]
    if n_ops == 2 and n_bases and int(ops[0]) == (n_bases << 4 | 4) and int(ops[1]) & 15 == 3:
        more = _long_cigar(data, at + 4 * n_ops + len(packed) + n_bases, len(data))
        ops = ops if more is None else more
    cigar = "".join(f"{c >> 4}{_OPERATIONS[c & 15]}" for c in ops.tolist())
    return data[32 : 31 + n_name].decode(), flag, names[ref], pos, mapq, cigar, letters.tobytes().decode() or "*"


def _header(file) -> tuple[list[str], list[int], int, int]:
    """Reference names and lengths, and where records begin: block and place in it."""
    data, starts = b"", []
    blocks = _blocks(file, 0)

    def need(n: int) -> None:
        nonlocal data
        while len(data) < n:
            at, more = next(blocks)
            starts.append((len(data), at))
            data += more

    need(8)
    if data[:4] != b"BAM\1":
        raise ValueError("not a BAM file")
    at = 8 + struct.unpack_from("<i", data, 4)[0]
    need(at + 4)
    n, at = struct.unpack_from("<i", data, at)[0], at + 4
    names, lengths = [], []
    for _ in range(n):
        need(at + 4)
        size = struct.unpack_from("<i", data, at)[0]
        need(at + 8 + size)
        names.append(data[at + 4 : at + 3 + size].decode())
        lengths.append(struct.unpack_from("<i", data, at + 4 + size)[0])
        at += 8 + size
    if at == len(data):
        following = next(blocks, None)
        return (names, lengths, following[0], 0) if following else (names, lengths, file.size(), 0)
    offset, place = max((s for s in starts if s[0] <= at), key=lambda s: s[0])
    return names, lengths, place, at - offset


class _Split(InputPartition):
    def __init__(self, path: str, start: int, end: int, first: tuple[int, int] | None):
        self.path, self.start, self.end, self.first = path, start, end, first


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.bytes = options["path"], int(options.get("splitBytes", 32 << 20))

    def _open(self, path: str):
        system, _ = fs.FileSystem.from_uri(self.root)
        return system.open_input_file(path)

    def partitions(self) -> list[InputPartition]:
        system, root = fs.FileSystem.from_uri(self.root)
        info = system.get_file_info(root)
        files = [info] if info.is_file else sorted((f for f in system.get_file_info(fs.FileSelector(root)) if f.is_file and not f.base_name.startswith((".", "_"))), key=lambda f: f.path)
        out: list[InputPartition] = []
        for f in files:
            with self._open(f.path) as file:
                *_, block, place = _header(file)
            ends = [*range(block + self.bytes, f.size, self.bytes), f.size]
            out += [_Split(f.path, a, z, (block, place) if a == block else None) for a, z in zip([block, *ends], ends) if a < z]
        return out

    def read(self, split: _Split) -> Iterator[pa.RecordBatch]:
        with self._open(split.path) as file:
            names, lengths, *_ = _header(file)
            rows = []
            for raw in _records(file, split, lengths):
                row = _record(raw, names)
                if row is not None:
                    rows.append(row)
                if len(rows) >= 4096:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


def _records(file, split: _Split, lengths: list[int]) -> Iterator[bytes]:
    """The records that begin in the split's blocks, without their lengths."""
    start = split.first[0] if split.first else _first_block(file, split.start)
    if start is None or start >= split.end:
        return
    blocks = _blocks(file, start)
    data, own, done = b"", 0, False  # ``own``: up to there data is of blocks of the split

    def more() -> bool:
        nonlocal data, own, done
        for at, new in blocks:
            data += new
            if at < split.end:
                own = len(data)
            return True
        done = True
        return False

    if split.first:
        while len(data) < split.first[1] and more():
            pass
        at = split.first[1]
    else:
        # enough to see records follow each other, then on until one begins
        found = None
        while found is None:
            size = max(1 << 18, 2 * len(data))
            while len(data) < size and more():
                pass
            found = _first_record(data, lengths, done)
            if found is None and (done or own < len(data)):
                return
        at = found
    while at < own or not done:
        while len(data) < at + 4 and more():
            pass
        if at >= own or len(data) < at + 4:
            return
        end = at + 4 + struct.unpack_from("<i", data, at)[0]
        while len(data) < end and more():
            pass
        if len(data) < end:
            raise ValueError("the file ends inside a record")
        yield data[at + 4 : end]
        at = end
        if at > 1 << 20:
            data, own, at = data[at:], own - at, 0


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "kinweave_bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_bam(spark: SparkSession, path: str, split_bytes: int = 32 << 20) -> DataFrame:
    """The rows that ``read_sam`` gives of the same alignments: name, flag, chrom, pos0, mapq, cigar, seq."""
    spark.dataSource.register(BamSource)
    return spark.read.format(BamSource.name()).option("splitBytes", split_bytes).load(path)
