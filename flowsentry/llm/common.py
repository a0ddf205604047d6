"""Helpers shared by the operators: scratch tables, Arrow text buffers, word hashes."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir


class Workspace:
    """Intermediate Parquet tables below the cluster's shared folder (``spark.checkpoint.dir``).

    Writing a table cuts the lineage and survives the loss of any executor.  ``drop`` removes
    a table that no later step reads.
    """

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark = spark
        self.base = f"{shared_dir(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        schema = df.schema
        df.write.parquet(self.path(name))
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have yet (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = "_" + name
    return name


def held_out(id_col: str | Column) -> Column:
    """True for the test fold: crc32 of the id's text modulo 4 is 2 (null ids: false)."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def low_hashes(rows: DataFrame, hash_col: str, limit: int) -> DataFrame:
    """The rows of low 64-bit hashes, about 1.2 x ``limit`` of them (all rows, if there are few).

    Ordering these instead of all rows keeps what a bounded sample sends to one place bounded:
    the plain top rows would send ``limit`` rows of every partition.
    """
    share = 1.2 * (limit + 200) / max(rows.count(), 1)
    return rows if share >= 1 else rows.filter(F.col(hash_col) < F.lit(int(share * 2.0 ** 64) - (1 << 63)))


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if len(offsets) == 0:
        offsets = np.zeros(1, np.int64)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int):
    """Row ranges of at most ``limit`` bytes each (one longer row stands alone)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


# ---------------------------------------------------------------- word hashes

_M64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


SEGMENT = 1 << 16  # powers of the base start anew every so many bytes
LONG_WORD = 64     # longer words are hashed by a digest


class WordHasher:
    """Hashes of all words of a byte buffer in a few vector operations.

    ``table`` maps each byte to the byte it counts as; 0 marks a separator.  A word of up to
    ``LONG_WORD`` bytes is hashed as a polynomial over its mapped bytes modulo 2^64 (prefix
    sums give every word at once), then mixed.  Long words, among which such polynomials are
    known to collide, take 64 bits of BLAKE2b instead.  Powers and sums start anew per segment,
    so neither grows with the text; the few words across a segment's edge are summed alone.
    """

    def __init__(self, table: np.ndarray):
        self.table = table
        self.values = mix(table.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))
        self.power, self.inverse = self._powers(_BASE & _M64), self._powers(_INVERSE)

    @staticmethod
    def _powers(base: int) -> np.ndarray:
        factors = np.full(SEGMENT, base, np.uint64)
        factors[0] = 1
        return np.cumprod(factors)

    def words(self, data: np.ndarray, offsets: np.ndarray):
        """(hash, start, end, row) of every word; a word never spans two rows."""
        n = len(data)
        if n == 0:
            z = np.zeros(0, np.int64)
            return np.zeros(0, np.uint64), z, z, z
        inside = self.table[data] != 0
        first = np.empty(n, bool)
        first[0] = True
        np.logical_not(inside[:-1], out=first[1:])
        cuts = offsets[1:-1]
        first[cuts[cuts < n]] = True
        start = np.flatnonzero(inside & first)
        last = np.empty(n, bool)
        last[-1] = True
        np.logical_not(inside[1:], out=last[:-1])
        last[cuts[(cuts > 0) & (cuts <= n)] - 1] = True
        end = np.flatnonzero(inside & last) + 1
        length = end - start
        h = np.empty(len(start), np.uint64)
        sums = np.zeros(SEGMENT + 1, np.uint64)
        bounds = np.searchsorted(start, np.arange(0, n + SEGMENT, SEGMENT))
        for base, lo, hi in zip(range(0, n, SEGMENT), bounds, bounds[1:]):
            piece = data[base:base + SEGMENT]
            m = len(piece)
            np.cumsum(self.values[piece] * self.power[:m], out=sums[1:m + 1])
            a, z = start[lo:hi] - base, np.minimum(end[lo:hi] - base, m)
            h[lo:hi] = mix((sums[z] - sums[a]) * self.inverse[a] + length[lo:hi].astype(np.uint64))
        for i in np.flatnonzero((length > LONG_WORD) | (start // SEGMENT != (end - 1) // SEGMENT)).tolist():
            h[i] = self._alone(data[start[i]:end[i]])
        row = np.searchsorted(offsets, start, "right") - 1
        return h, start, end, row

    def _alone(self, word: np.ndarray) -> np.uint64:
        if len(word) > LONG_WORD:
            return np.uint64(int.from_bytes(blake2b(self.table[word].tobytes(), digest_size=8).digest(), "little"))
        total = np.cumsum(self.values[word] * self.power[:len(word)])[-1:]
        return mix(total + np.uint64(len(word)))[0]


def byte_table(is_word) -> np.ndarray:
    """Byte map of a word class: A-Z count as a-z, bytes outside the class as 0."""
    table = np.zeros(256, np.uint8)
    for b in range(256):
        low = b + 32 if 65 <= b <= 90 else b
        if is_word(b):
            table[b] = low if low else 1
    return table


#: ``[^\x20\x09-\x0D]+`` over UTF-8 bytes (byte 0 is a word byte and counts as 1 or 1 as itself:
#: NUL is mapped to 0xFF, which UTF-8 never uses).
SPACE_WORDS = byte_table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
SPACE_WORDS[0] = 0xFF
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z: digits, letters, non-ASCII.
ALNUM_WORDS = byte_table(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)


def worker_cache(key: tuple, make):
    """An object that a Python worker keeps between tasks.

    The package is shipped to workers by value, so module globals start anew with each task.
    """
    import sys
    store = sys.__dict__.setdefault("_flowsentry_worker_cache", {})
    if key not in store:
        store.clear()  # one at a time: memory of a worker stays bounded
        store[key] = make()
    return store[key]


def free_worker_cache() -> None:
    """Give back what earlier tasks kept in this worker: memos, and memory that is free already.

    Workers are reused from stage to stage.  An operator that calls this first (or last) does not
    hold the memos of another operator beside its own work.
    """
    import ctypes
    import gc
    import sys
    sys.__dict__.get("_flowsentry_worker_cache", {}).clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no such call outside glibc
        pass


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Python tasks planned and run inside get batches of at most ``rows`` rows (Spark's default is 10,000).

    A batch of whole texts is held by the JVM and by the Python worker of every task at once.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(usual)) if int(usual) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, usual)


@contextmanager
def spent_shuffles(spark: SparkSession):
    """Shuffle files of a query run inside go when it has ended, not when the driver next collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    usual = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, usual)


class Shared:
    """A broadcast object of this package's classes (shipped with their code)."""

    def __init__(self, spark: SparkSession, value):
        from pyspark import cloudpickle
        self._sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self._value = None

    @property
    def value(self):
        if self._value is None:
            import pickle
            self._value = pickle.loads(self._sent.value)
        return self._value

    def __getstate__(self):
        return {"_sent": self._sent, "_value": None}
