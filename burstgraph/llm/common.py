"""Shared helpers: written intermediates, text batches, hashes of bytes, words and word shingles.

Texts are handled as UTF-8 bytes in numpy. A batch of texts is cut into chunks of about ``CHUNK`` bytes (a longer text is a
chunk of its own), so memory follows one text or one chunk, never a partition.
"""

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from burstgraph.session import scratch_path

CHUNK = 1 << 19
BATCH_ROWS, BATCH_BYTES = 1000, 2 << 20
SEPARATORS = np.zeros(256, dtype=bool)
SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
BYTE_CODES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER_CODES = BYTE_CODES[LOWER]
_powers: list[np.ndarray] = []


def park(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here, columns can be pruned."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept._parked = path
    return kept


def forget(df: DataFrame | None) -> None:
    """Delete the files of a result of ``park`` that nothing reads any more."""
    if path := getattr(df, "_parked", None):
        context = df.sparkSession.sparkContext
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def bound_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches held to ``BATCH_ROWS`` rows and about ``BATCH_BYTES``: a batch of long texts is
    held by the JVM and by Python at once, on every core. The settings stay; smaller ones are left as they are."""
    conf = df.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < int(conf.get(name).rstrip("b")) <= most:
            conf.set(name, str(most))
    return df


def release() -> None:
    """Give memory that this Python worker has freed back to the system: workers wait for the next task beside busy ones, and
    what they hold counts for their executor."""
    import ctypes

    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):  # glibc
        libc.malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, with memory given back when the task's rows are through."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return whole


def powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least ``length`` of each."""
    if not _powers or len(_powers[0]) < length:
        size = max(length, CHUNK + 1)
        both = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _powers[:] = both
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that all bits depend on all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """s with s[j] - s[i] = hash of data[i:j] times base**i."""
    up, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((_LOWER_CODES if lower else BYTE_CODES)[data] * up[: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hash of each span; equal spans have equal hashes wherever they stand."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def fixed_hashes(sums: np.ndarray, length: int) -> np.ndarray:
    """``span_hashes`` of all spans of ``length``, without an index for each."""
    _, down = powers(len(sums))
    hashes = sums[length:] - sums[: max(0, len(sums) - length)]
    hashes *= down[: len(hashes)]
    hashes += np.uint64(length)
    return mix(hashes)


def digest64(data: bytes) -> int:
    """A signed 64-bit key of ``data``."""
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def text_chunks(batches: Iterator[pa.RecordBatch], text: str = "text", chunk: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """(rows, their texts as bytes; null as empty), about ``chunk`` bytes of text at a time."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
        first, size = 0, 0
        lengths = [0 if n is None else n for n in pa.compute.binary_length(column).to_pylist()]
        for i, n in enumerate(lengths):
            if size and size + n > chunk:
                yield batch.slice(first, i - first), [x or b"" for x in column.slice(first, i - first).to_pylist()]
                first, size = i, 0
            size += n
        if first < len(lengths):
            yield batch.slice(first), [x or b"" for x in column.slice(first).to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` a few at a time, for code that makes Python objects of them."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(start, end, hash of each lower-cased word, offsets of each text's words, joined bytes)."""
    joined = b" ".join(texts) + b" "
    data = np.frombuffer(joined, dtype=np.uint8)
    gap = SEPARATORS[data]
    edge = np.flatnonzero(np.diff(gap, prepend=True))
    starts, ends = edge[0::2], edge[1::2]
    hashes = span_hashes(prefix_sums(data, lower=True), starts, ends)
    begins = np.cumsum([0, *(len(x) + 1 for x in texts)])
    return starts, ends, hashes, np.searchsorted(starts, begins), joined


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive words; of the whole sequence when it is shorter; none of none."""
    n = len(words)
    if n == 0:
        return words
    count, width = max(1, n - size + 1), min(n, size)
    up, _ = powers(size + 1)
    total = np.full(count, width, dtype=np.uint64)
    for k in range(width):
        total += words[k : k + count] * up[k + 1]
    return mix(total)


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    _, _, hashes, at, _ = words_of(texts)
    return [np.unique(shingle_hashes(hashes[a:b], size)) for a, b in zip(at[:-1], at[1:], strict=True)]
