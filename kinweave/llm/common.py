"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names, which all executors share.

    ``spark.checkpoint.dir`` is read from the session.  Only where it is unset
    (tests, a single machine) a temporary folder takes its place; on a cluster
    that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="kinweave-checkpoint-"))
    return sc.getCheckpointDir()


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it is on."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let go of the shuffles and checkpoints that nothing refers to, and of the driver's memory for them.

    Spark's cleaner hears of them when the driver collects its garbage, which it may not do for long.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def id_remainder(column: str, m: int) -> Column:
    """crc32 of the id as text, modulo ``m``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(m)


def sample_ids(ids: DataFrame, name: str, n: int) -> DataFrame:
    """The ``n`` rows of ``ids`` (distinct ids in column ``name``) with the smallest hashes of their ids.

    A bar on the hash that about twice as many pass comes first, so that the
    rows which are sorted together don't grow with the input.
    """
    h = F.xxhash64(F.coalesce(F.col(name).cast("string"), F.lit("")))
    bar = min(1.0, (2 * n + 50) / max(1, ids.count()))
    return ids.where(h.cast("double") / 2.0**64 + 0.5 <= bar).orderBy(h, name).limit(n)


def map_batches(
    df: DataFrame,
    per_batch: Callable[[pa.RecordBatch], dict[str, list]],
    new: dict[str, T.DataType],
    keep: list[str] | None = None,
    where: str | None = None,
) -> DataFrame:
    """Add columns computed by ``per_batch`` from Arrow batches.

    ``keep`` lists the input columns that stay (all by default).  An input
    column with the name of a new one is replaced.  With ``where``, only rows
    whose new column of that name is true stay and that column is dropped.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c not in new]
    fields = [df.schema[c] for c in keep] + [T.StructField(k, t) for k, t in new.items() if k != where]
    schema = T.StructType(fields)
    arrow = to_arrow_schema(schema)
    flag = pa.bool_()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            made = per_batch(batch)
            mask = None if where is None else pa.array(made.pop(where), flag)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            columns += [pa.array(made[k], arrow.field(k).type) for k in new if k != where]
            columns = [c.cast(f.type) if c.type != f.type else c for c, f in zip(columns, arrow)]
            out = pa.RecordBatch.from_arrays(columns, schema=arrow)
            yield out if mask is None else out.filter(mask)

    return df.mapInArrow(run, schema)


def small(batches: Iterator[pa.RecordBatch], most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``most`` bytes, without empty ones; at the end memory goes back to the system.

    Workers outlive a task, and what their allocators keep adds up with that of
    other stages.
    """
    for batch in batches:
        step = max(1, int(batch.num_rows * most / max(1, batch.nbytes)))
        for a in range(0, batch.num_rows, step):
            yield batch.slice(a, step)
    give_back()


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The strings of a column; null counts as the empty text."""
    return [x or "" for x in column(batch, name).to_pylist()]


def blocks(batch: pa.RecordBatch, row: int, table: bytes, name: str = "text", most: int = 1 << 20) -> Iterator[bytes]:
    """The UTF-8 bytes of one text through the translation ``table``, in blocks of about ``most`` bytes.

    A block ends after a space or line end, so that no word is cut and a text of
    any length needs the memory of a block (or of its longest word).
    """
    data = column(batch, name)[row].as_buffer()
    if data is None:
        return
    view, rest = memoryview(data), b""
    for a in range(0, len(view), most):
        now = rest + bytes(view[a : a + most]).translate(table)
        end = max(now.rfind(b" "), now.rfind(b"\n")) + 1
        if end:
            yield now[:end]
        rest = now[end:]
    if rest:
        yield rest


def word_lists(text: str, most: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text as UTF-8 bytes, ASCII letters lower-cased, a list for each ``most`` bytes or so."""
    data, rest = text.encode("utf-8", "surrogatepass"), b""
    for a in range(0, len(data), most):
        now = rest + data[a : a + most].lower()
        if a + most < len(data):
            end = max(now.rfind(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")) + 1
            now, rest = now[:end], now[end:]
        if words := now.split():
            yield words


def slices(n: int, size: int) -> Iterator[tuple[int, int]]:
    for a in range(0, n, size):
        yield a, min(n, a + size)


def by_bytes(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges whose sizes add up to ``most`` at most (one item at least)."""
    a, total = 0, 0
    for i, n in enumerate(sizes):
        if i > a and total + n > most:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)

