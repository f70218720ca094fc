"""Shared helpers: durable tables, Arrow text access and vectorised word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.store import written

U64 = np.uint64
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage ends there."""
    return written(df, name)


def whole_or_pieces(text: str, most: int, pieces: int = 20) -> Column:
    """The column ``text``; one of over ``most`` characters is ``pieces`` parts, evenly spread over all of it, joined by line
    breaks: what a model is fitted on stays bounded, and long texts are learned from."""
    own, size = F.col(text), F.length(text)
    part = most // pieces
    begin = [(F.floor((size - part) * k / (pieces - 1)) + 1).cast("int") for k in range(pieces)]
    return F.when(size > most, F.concat_ws("\n", *[F.substring(own, b, F.lit(part)) for b in begin])).otherwise(own)


def fresh(name: str, taken: list[str]) -> str:
    """``name``, lengthened until no column in ``taken`` is called so."""
    used = {t.lower() for t in taken}
    while name in used:
        name += "_"
    return name


#: A key with more than one in so many rows is hot: there are fewer hot keys than this.
HOT = 1000


def split_join(left: DataFrame, right: DataFrame, key: str, name: str, how: str = "inner") -> DataFrame:
    """``left`` joined on ``key`` with ``right``, which has one row a key: the hot keys of ``left`` by broadcast (fewer
    than ``HOT`` rows), so that no task gets all rows of one key; the others by shuffle. ``left`` is read twice."""
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    hot = durable(counts.where(F.col("n") > max(HOT // 10, left.count() // HOT)).select(key), name)
    flag = fresh("is_hot", left.columns + right.columns)
    marked = left.join(F.broadcast(hot.withColumn(flag, F.lit(True))), key, "left")
    few = F.broadcast(right.join(F.broadcast(hot), key, "left_semi"))
    parts = (marked.where(F.col(flag)), few), (marked.where(F.col(flag).isNull()), right)
    one, two = (side.drop(flag).join(other, key, how) for side, other in parts)
    return one.unionByName(two)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of texts stay small in both processes; a smaller setting of the session's own is kept."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


_SEEN = [0]


def release() -> None:
    """Give memory that a worker no longer needs back to the machine: workers live on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def shrink_heaps(spark: SparkSession) -> None:
    """Collect garbage in the driver and in all executors: a heap grows while tasks run and keeps what it took, a whole
    collection gives the machine back what is beyond its use. The driver goes first, as executors hold broadcasts for as long
    as it hasn't found them unused. One short task for each core; calls that meet in one process are one collection."""
    context = spark.sparkContext
    context._jvm.java.lang.System.gc()
    cores = context.defaultParallelism
    spark.range(0, cores, 1, cores).selectExpr("java_method('java.lang.System', 'gc') AS done").collect()


def trimmed(run):
    """``run`` over Arrow batches, giving memory back when a task's input ends: an idle worker keeps none of it."""

    def until_end(batches):
        yield from run(batches)
        release()

    return until_end


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string array; null is empty."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``most`` bytes of text; a longer text stands alone."""
    _, at = text_buffer(batch.column(column))
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        yield batch.slice(row, end - row)
        row = end
    _SEEN[0] += batch.num_rows
    if _SEEN[0] >= 10_000:  # trimmed pages cost faults, so not after every batch
        _SEEN[0] = 0
        release()


def int_ids(column: pa.Array) -> np.ndarray:
    """Ids as int64, null as the smallest value."""
    return pc.fill_null(column.cast(pa.int64()), NULL_ID).to_numpy(zero_copy_only=False)


def id_column(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BASE = 0x5851F42D4C957F2D
_VALUES = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_VALUES[65:91] = _VALUES[97:123]  # A-Z count as a-z
_POWERS: list[np.ndarray] = []

SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
NOT_LETTERS = np.ones(256, bool)
NOT_LETTERS[65:91] = NOT_LETTERS[97:123] = NOT_LETTERS[128:] = False


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(17, int(n - 1).bit_length())
        made = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            made.append(np.cumprod(steps, dtype=U64))
        _POWERS[:] = made
    return _POWERS[0], _POWERS[1]


def word_spans(data: np.ndarray, at: np.ndarray, outside: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words: maximal runs without ``outside`` bytes that stay within a row."""
    inside = ~outside[data]
    if not inside.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = at[1:-1]
    edge = edge[edge < data.size]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = edge[edge > 0]
    last[edge - 1] = inside[edge - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 17) -> np.ndarray:
    """64-bit hash of each word's bytes with A-Z as a-z: differences of a prefix polynomial, block by block."""
    out = np.empty(len(starts), U64)
    row = 0
    while row < len(starts):
        end = max(row + 1, int(np.searchsorted(ends, starts[row] + block, "right")))
        low, high = starts[row], ends[end - 1]
        power, inverse = _powers(int(high - low))
        total = np.zeros(high - low + 1, U64)
        np.cumsum(_VALUES[data[low:high]] * power[: high - low], out=total[1:])
        s, e = starts[row:end] - low, ends[row:end] - low
        out[row:end] = mix64((total[e] - total[s]) * inverse[s] + (e - s).astype(U64))
        row = end
    return out


def shingle_sets(column: pa.Array, width: int = 5) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its ``width``-word shingles; a shorter text is one sequence."""
    data, at = text_buffer(column)
    starts, ends = word_spans(data, at)
    words = word_hashes(data, starts, ends)
    first = np.searchsorted(starts, at)
    mixed = np.zeros(len(words), U64)
    if len(words) >= width:
        span = len(words) - width + 1
        acc = np.zeros(span, U64)
        for k in range(width):
            acc = (acc ^ words[k : k + span]) * U64(0x9FB21C651E98DF25)
            acc ^= acc >> U64(32)
        mixed[:span] = mix64(acc)
    found = []
    for row in range(len(at) - 1):
        low, high = first[row], first[row + 1]
        if high - low >= width:
            found.append(np.unique(mixed[low : high - width + 1]))
        elif high > low:
            key = U64(high - low)
            for w in words[low:high]:
                key = mix64(np.array([(int(key) * 0x9FB21C651E98DF25 ^ int(w)) & (2**64 - 1)], U64))[0]
            found.append(np.array([key], U64))
        else:
            found.append(np.zeros(0, U64))
    return found
