"""Helpers shared by the training-data operators: shared scratch tables, stable hashes, Arrow text access."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def packed_row(df: DataFrame, columns: list[str] | None = None) -> Column:
    """All columns of a row, whatever their names, as one struct ``row``, so that none can clash with an operator's own."""
    names = df.columns if columns is None else columns
    return F.struct(*(F.col(f"`{c}`") for c in names)).alias("row") if names else F.struct(F.lit(0).alias("none")).alias("row")


def row_columns(names: list[str]) -> list[Column]:
    """The columns that ``packed_row`` packed."""
    return [F.col("row").getField(c).alias(c) for c in names]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it. Where that is unset, a session
    within one process takes a folder of its own, and a cluster one in the warehouse, which its executors reach."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        alone = re.match(r"local(\[|$)", spark.sparkContext.master)
        path = tempfile.mkdtemp(prefix="pairloom-") if alone else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/pairloom-scratch"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """Hand Python a few megabytes and at most some thousand rows at a time, which bounds the memory of a batch on both
    sides (a longer text comes alone). All operators of this package ask for the same bounds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


@contextlib.contextmanager
def wider_batches(spark: SparkSession):
    """Twice those bounds for the jobs that run inside, for an operator that gains by seeing more texts together."""
    bound_batches(spark)
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    held = {name: spark.conf.get(name) for name in names}
    try:
        for name, value in held.items():
            spark.conf.set(name, str(2 * int(value)))
        yield
    finally:
        for name, value in held.items():
            spark.conf.set(name, value)


@contextlib.contextmanager
def no_cycles():
    """Without looks for cyclic garbage, which take long among millions of small objects, while a batch is worked on."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


_CACHES: dict[str, dict] = {}


def tidy(mapped: int = 1 << 20) -> None:
    """Give back what a worker's earlier tasks have freed; called as a task begins. Arrays of ``mapped`` bytes or more are mapped
    from here on, and so go back at once: otherwise each stage's peak stays with its workers until the end of the job."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, mapped)  # M_MMAP_THRESHOLD
        libc.malloc_trim(0)


def worker_cache(owner: str, mapped: int = 1 << 20) -> dict:
    """What a Python worker remembers for one operator from task to task. Workers are reused across operators, so asking
    for one operator's memory frees what the others left."""
    others = [k for k in _CACHES if k != owner]
    for k in others:
        del _CACHES[k]
    if others:
        gc.collect()
    tidy(mapped)
    return _CACHES.setdefault(owner, {})


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/pairloom-{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage: write ``df`` once as Parquet in the shared folder and read it back with the same schema."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps: its cleaner only learns of them when the driver collects
    garbage, which a driver that does little else puts off while disks fill."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release(*tables: DataFrame) -> None:
    """Delete the files of tables that ``materialize`` wrote, once nothing reads them any more."""
    for df in tables:
        _delete(df)


def _delete(df: DataFrame) -> None:
    spark = df.sparkSession
    roots = {p.rsplit("/", 1)[0] for p in df.inputFiles()}
    jvm = spark.sparkContext._jvm
    for root in roots:
        if "/pairloom-" in root:
            where = jvm.org.apache.hadoop.fs.Path(root)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def write_shared_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Write one file through Hadoop's file system, so that it also works where the shared folder isn't a mount."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        for i in range(0, len(data), 1 << 20):
            out.write(bytearray(data[i : i + (1 << 20)]))
    finally:
        out.close()


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply) over unsigned arrays."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Rolling:
    """Prefix sums of a polynomial hash modulo 2**64: the hash of any span is one subtraction and one product."""

    def __init__(self, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.base = U64(int(rng.integers(1 << 60)) * 8 + 5)
        self.inverse = U64(pow(int(self.base), -1, 1 << 64))
        self.up = self.down = np.ones(1, U64)

    def grow(self, n: int) -> None:
        if len(self.up) <= n:
            size = max(n + 1, 2 * len(self.up))
            for name, base in (("up", self.base), ("down", self.inverse)):
                powers = np.full(size, base, U64)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers, dtype=U64))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self.grow(len(values))
        out = np.zeros(len(values) + 1, U64)
        np.cumsum(values * self.up[: len(values)], dtype=U64, out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (prefix[end] - prefix[start]) * self.down[start]


#: Word separators: 0x20 and 0x09-0x0D; all are single bytes of UTF-8, so words can be found in raw bytes.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def text_slices(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of about ``limit`` bytes (a longer text stands alone): first row, last
    row + 1, the bytes, and the offsets of the rows in them. Nulls become empty texts."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        last = min(last, n)
        yield first, last, raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each row the index of its first word (one more entry at the end)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = IS_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    word = ~space
    starts = word.copy()
    starts[1:] &= space[:-1] | edge[1:-1]
    ends = word.copy()
    ends[:-1] &= space[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


_BYTES = Rolling(11)
_TABLE = np.random.Generator(np.random.PCG64(12)).integers(0, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word's bytes."""
    prefix = _BYTES.prefix(_TABLE[raw])
    return mix64(_BYTES.spans(prefix, starts, ends) + (ends - starts).astype(U64) * U64(0x9E3779B97F4A7C15))
