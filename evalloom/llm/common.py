"""Shared helpers of the training-data operators: shared-folder tables, Arrow slices, word hashes."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one vectorised step handles at once; bounds the memory of a Python worker.
SLICE_BYTES = 2 << 20
#: Bytes of an Arrow batch between Spark and a Python worker.
BATCH_BYTES = 16 << 20

_LOCAL_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session may go without that setting; it then gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by driver and executors")
    if not _LOCAL_DIR:
        _LOCAL_DIR.append("file://" + tempfile.mkdtemp(prefix="evalloom-"))
    return _LOCAL_DIR[0]


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries that run inside go when each query ends, not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Folders that this driver wrote and hasn't deleted, with their sessions.
_WRITTEN: dict[str, SparkSession] = {}


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet under the shared folder and reads it back: a cut in the lineage that survives lost executors.

    ``discard`` deletes the table; what is left goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/evalloom/{name}-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``materialise`` wrote and no later step reads."""
    for table in tables:
        _delete(getattr(table, "_written_to", ""))


def _delete(path: str) -> None:
    if spark := _WRITTEN.pop(path, None):
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@atexit.register
def _delete_all() -> None:
    with suppress(Exception):  # a session that has ended before
        for path in list(_WRITTEN):
            _delete(path)


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores before it until no column in ``taken`` has it (in any case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def sliced(docs: DataFrame, text_col: str, name: str, slice_bytes: int) -> tuple[DataFrame, str, str]:
    """``docs`` in a table of its own with two more columns: a number for each row and one for each slice.

    A slice is a run of rows of one task with at most ``slice_bytes`` of text, or one longer row; slices are
    the units that later steps hash and join, so that a hot source or a group of copies is spread evenly.
    Returns the table and the two columns' names.
    """
    bounded_batches(docs.sparkSession)
    row, part = fresh("row_no", docs.columns), fresh("slice_no", docs.columns)
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    numbered = docs.withColumn(row, F.monotonically_increasing_id()).withColumn(part, size)
    at = numbered.columns.index(part)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, filled = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            sizes = batch.column(at).to_numpy(zero_copy_only=False)
            out = np.empty(len(sizes), np.int64)
            for i, n in enumerate(sizes.tolist()):
                if filled and filled + n > slice_bytes:
                    now, filled = now + 1, 0
                out[i] = now
                filled += n + 64
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(out)], schema=batch.schema)

    return materialise(numbered.mapInArrow(number, numbered.schema), name), row, part


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_BYTES``, so that long texts don't add up to more than a worker holds."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    if not now.rstrip("bB").isdigit() or not 0 < int(now.rstrip("bB")) <= BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


#: Keys that may count as frequent: each has more than this part of all rows, so there are no more of them.
FREQUENT = 10_000
LEAST_FREQUENT = 1_000


def looked_up(rows: DataFrame, key: str, labels: DataFrame, size: str, total: int) -> DataFrame:
    """``rows`` joined by ``key`` with ``labels``, which has a row for each key and in ``size`` how many rows share it.

    Keys of more than a 10,000th of the ``total`` rows, of which there can't be more than 10,000, go to all
    tasks, so that no key brings more rows than that into one task.
    """
    frequent = F.col(size) > max(LEAST_FREQUENT, total // FREQUENT)
    hot = labels.where(frequent).drop(size)
    near = rows.join(F.broadcast(hot), key)
    far = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(labels.where(~frequent).drop(size), key)
    return near.unionByName(far)


def text_frame(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents table, its columns pruned to those named (all, if none is)."""
    bounded_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def vocabulary_path(name: str) -> str:
    """Where the public tokenizer file ``name`` lies: the installed package, or EVALLOOM_TOKENIZERS."""
    if base := os.environ.get("EVALLOOM_TOKENIZERS"):
        return os.path.join(base, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's UTF-8 bytes and its n + 1 offsets into them; nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of at most ``limit`` bytes each, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


#: White space that separates words in every contract here.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes that aren't white space; runs end at row ends."""
    n = len(data)
    if not n:
        return (np.empty(0, np.int64),) * 3
    space = SPACE[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = True, space[:-1]
    after[-1], after[:-1] = True, space[1:]
    edges = offsets[1:-1]
    before[edges[edges < n]] = True
    after[edges[edges > 0] - 1] = True
    start = np.flatnonzero(~space & before)
    end = np.flatnonzero(~space & after) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit permutation (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


#: The Mersenne prime that range hashes are taken modulo.
PRIME = np.uint64((1 << 61) - 1)
#: Bytes of a range that are summed without a reduction between.
UNREDUCED = 1 << 23


#: Ranges that are hashed at once, so that their numbers stay in a core's cache.
HASHED = 1 << 14


def folded(x: np.ndarray) -> np.ndarray:
    """Any 64-bit numbers modulo PRIME, but for up to 7 beyond it."""
    return (x & PRIME) + (x >> np.uint64(61))


def times(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """Products modulo PRIME of numbers of ``folded``, by halves of 31 bits."""
    low = np.uint64((1 << 31) - 1)
    a1, a0, b1, b0 = a >> np.uint64(31), a & low, b >> np.uint64(31), b & low
    middle = a0 * b1 + a1 * b0
    # four parts of at most 2^61, 2^32, 2^61 and 2^62
    out = folded(((a1 * b1) << np.uint64(1)) + (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << np.uint64(31)) + a0 * b0)
    return out - PRIME * (out >= PRIME)


def prime_powers(base: int, n: int) -> np.ndarray:
    """base to the 0th, 1st, ... power modulo PRIME."""
    out, filled = np.ones(max(n, 1), np.uint64), 1
    while filled < n:
        more = min(filled, n - filled)
        out[filled : filled + more] = times(out[:more], np.uint64(pow(base, filled, int(PRIME))))
        filled += more
    return out[:n]


#: Sums up to each byte of its code times the low and the high half of its power.
Prefix = tuple[np.ndarray, np.ndarray]


class RollingHash:
    """Polynomial hashes modulo 2^61 - 1 of any byte ranges: two texts of n bytes have one hash for at most n of all bases."""

    def __init__(self, seed: int = 1) -> None:
        self.base = int(np.random.default_rng(seed).integers(1 << 40, int(PRIME) - 1))
        self.release()

    def grow(self, n: int) -> None:
        if len(self.down) < n:
            n += -n % (1 << 19)
            up = prime_powers(self.base, n)
            self.low, self.high = (up & np.uint64((1 << 31) - 1)).astype(np.uint32), (up >> np.uint64(31)).astype(np.uint32)
            self.down = prime_powers(pow(self.base, -1, int(PRIME)), n)

    def release(self) -> None:
        self.low = self.high = np.empty(0, np.uint32)
        self.down = np.empty(0, np.uint64)

    def prefix(self, data: np.ndarray) -> Prefix:
        n = len(data)
        self.grow(n + 1)
        code = data.astype(np.uint64) + np.uint64(1)
        low, high = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
        np.cumsum(code * self.low[:n], dtype=np.uint64, out=low[1:])
        np.cumsum(code * self.high[:n], dtype=np.uint64, out=high[1:])
        return low, high

    def ranges(self, prefix: Prefix, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        self.grow(len(prefix[0]))
        out = np.empty(len(start), np.uint64)
        for i in range(0, len(start), HASHED):
            out[i : i + HASHED] = self._ranges(prefix, start[i : i + HASHED], end[i : i + HASHED])
        return out

    def _ranges(self, prefix: Prefix, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        low, high = prefix
        total = np.uint64(0)
        for k in range(0, max(1, int((end - start).max(initial=0))), UNREDUCED):
            a = np.minimum(start + k, end) if k else start
            b = np.minimum(a + UNREDUCED, end)
            h = folded(high[b] - high[a])
            # the high half counts 2^31 times, a rotation of 61 bits
            h = ((h << np.uint64(31)) & PRIME) + (h >> np.uint64(30))
            total = folded(total + folded(h + folded(low[b] - low[a])))
        return mix(times(total, self.down[start]))


#: One for all operators, so that a worker holds its tables once.
HASH = RollingHash()


def trim() -> None:
    """Gives freed memory back to the machine, which a worker shares with the JVM of its executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def ascii_lower(data: np.ndarray) -> np.ndarray:
    """A-Z lowered, other bytes as they are."""
    upper = (data >= 65) & (data <= 90)
    return data + (upper * np.uint8(32)).astype(np.uint8)
