"""BAM files, written here block by block, against the same records as SAM."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from kinweave.sources import bam
from kinweave.sources import readers as rd

CONTIGS = [("chr1", 200_000), ("chr2", 90_000), ("a_longer_name", 5_000)]
OPS = "MIDNSHP=X"


def block(data):
    """One compressed block."""
    raw = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = raw.compress(data) + raw.flush()
    return struct.pack("<4BIBBHBBHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def record(name, flag, ref, pos, mapq, ops, seq, tags=b""):
    packed = ["=ACMGRSVTWYHKDBN".index(c) for c in seq] + [0] * (len(seq) % 2)
    cigar = [n << 4 | OPS.index(o) for n, o in ops]
    if len(cigar) > 65_535:
        tags += b"CGBI" + struct.pack(f"<i{len(cigar)}I", len(cigar), *cigar)
        cigar = [len(seq) << 4 | 4, sum(n for n, o in ops if o in "MDN=X") << 4 | 3]
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, mapq, 0, len(cigar), flag, len(seq), -1, -1, 0) + name.encode() + b"\0"
    body += struct.pack(f"<{len(cigar)}I", *cigar) + bytes(a << 4 | b for a, b in zip(packed[::2], packed[1::2])) + b"\xff" * len(seq) + tags
    return struct.pack("<i", len(body)) + body


def header():
    text = b"@HD\tVN:1.6\n"
    out = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(CONTIGS))
    for n, size in CONTIGS:
        out += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size)
    return out


def some_records(rng, n, long):
    for k in range(n):
        ref = rng.randrange(len(CONTIGS))
        ops = [(rng.randrange(1, 40), rng.choice("MIDNS=X")) for _ in range(rng.randrange(1, 6))]
        if k == long:
            ops = [(1, "MI"[i % 2]) for i in range(70_000)]
        bases = sum(c for c, o in ops if o in "MIS=X")
        seq = "".join(rng.choices("ACGTN", k=bases))
        yield (f"read{k}/{'x' * rng.randrange(30)}", rng.choice([0, 16, 256]), ref, rng.randrange(CONTIGS[ref][1]), rng.randrange(60), ops, seq)


def files(tmp_path, seed, n, sizes, long=None):
    """The same records as BAM, in blocks of those sizes, and as SAM."""
    rng = random.Random(seed)
    rows = list(some_records(rng, n, long))
    data = header() + b"".join(record(*r, tags=b"NMC" + bytes([rng.randrange(200)]) + b"ZZZtext\0" if rng.random() < 0.5 else b"") for r in rows)
    data += record("lost", 4, -1, -1, 0, [], "ACGT")
    out, at = b"", 0
    while at < len(data):
        size = rng.choice(sizes)
        out += block(data[at : at + size])
        at += size
    (tmp_path / "x.bam").write_bytes(out + block(b""))
    text = ["\t".join([name, str(flag), CONTIGS[ref][0], str(pos + 1), str(q), "".join(f"{c}{o}" for c, o in ops), "*", "0", "0", seq or "*", "*"]) for name, flag, ref, pos, q, ops, seq in rows]
    (tmp_path / "x.sam").write_text("@HD\tVN:1.6\n" + "\n".join(text) + "\n")
    return len(out)


@pytest.mark.parametrize("sizes, split, long", [([60_000], 10_000, None), ([37, 300, 5000], 3_000, None), ([1, 2, 11], 20_000, None), ([60_000], 40_000, 400), ([60_000], 1 << 25, None)])
def test_bam_is_sam(spark, tmp_path, sizes, split, long):
    """Records over block borders, blocks without a record's begin, a record over many blocks, any number of splits."""
    n = 300 if 1 in sizes else 2500
    size = files(tmp_path, 3, n, sizes, long)
    got = bam.read_bam(spark, str(tmp_path / "x.bam"), split)
    assert got.rdd.getNumPartitions() == max(1, -(-size // split)) or split < size
    same = lambda df: sorted(tuple(r) for r in df.collect())
    assert same(got) == same(rd.read_sam(spark, str(tmp_path / "x.sam")))
    if split < size:
        used = got.groupBy(F.spark_partition_id()).count().collect()
        assert len(used) > 2


def test_no_records_and_no_bam(spark, tmp_path):
    (tmp_path / "empty.bam").write_bytes(block(header()) + block(b""))
    assert bam.read_bam(spark, str(tmp_path / "empty.bam")).count() == 0
    (tmp_path / "bad.bam").write_bytes(block(b"no such thing"))
    with pytest.raises(Exception, match="not a BAM file"):
        bam.read_bam(spark, str(tmp_path / "bad.bam")).count()
