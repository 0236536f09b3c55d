"""Shared helpers: settings, durable cuts, and numpy views of Arrow text columns.

All numpy work is done inside ``mapInArrow`` tasks on slices of a bounded number of bytes, so
the memory of a task depends on the largest single document, never on a partition or a group.
"""

import contextlib
import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir

SLICE_BYTES = 1 << 21
BLOCK_BYTES = 1 << 20
MASK = (1 << 64) - 1


def tune(spark: SparkSession) -> SparkSession:
    """Settings that every job here relies on: adaptive plans, and Arrow batches of few rows."""
    for key, value in {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
    }.items():
        spark.conf.set(key, value)
    _ship(spark)
    return spark


def _ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once for each application."""
    sc = spark.sparkContext
    if getattr(sc, "_saldoscope_sent", None):
        return
    package = Path(__file__).resolve().parent.parent
    folder = tempfile.TemporaryDirectory()  # on the driver, which serves it to the executors until it ends
    target = Path(folder.name) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    sc.addPyFile(str(target))
    sc._saldoscope_sent = folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lost executor costs a re-read.

    The table is compressed and lives as long as the application's checkpoint folder.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES, rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """Row ranges of ``batch`` with at most ``limit`` bytes of text and ``rows`` rows each, one row at least."""
    if not batch.num_rows:
        return
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    group = np.cumsum(size) // limit
    part = np.arange(batch.num_rows) // (rows or batch.num_rows)
    edges = np.flatnonzero(np.diff(group) | np.diff(part)) + 1
    at = 0
    for end in [*edges.tolist(), batch.num_rows]:
        yield batch.slice(at, end - at)
        at = end


def flat(texts: pa.Array, after: str = "", before: str = "") -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in one array, and the offsets of each; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if before or after:  # joined by nothing
        before, after, none = (pa.scalar(x, pa.large_string()) for x in (before, after, ""))
        texts = pc.binary_join_element_wise(before, texts, after, none)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]] if len(texts) else raw[:0], offsets - (offsets[0] if len(texts) else 0)


def lower_ascii() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit values over all bits (xor-shift and multiply, twice)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the odd base and of its inverse, modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, BLOCK_BYTES + 4096)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"], _POWERS["down"]


def words(buf: np.ndarray, is_word: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words in ``buf``, which ends with a separator.

    A word is a longest run of bytes with ``is_word``; ``fold`` maps bytes before hashing. The
    hash is a polynomial over the word's bytes, taken from running sums; work goes by blocks
    that end at a separator.
    """
    starts, ends, hashes = [], [], []
    at, total = 0, len(buf)
    salt = mix(np.arange(1, 257, dtype=np.uint64))
    while at < total:
        end = min(at + BLOCK_BYTES, total)
        while end < total and is_word[buf[end - 1]]:
            stop = np.flatnonzero(~is_word[buf[end:end + BLOCK_BYTES]])
            end = end + int(stop[0]) + 1 if len(stop) else min(end + BLOCK_BYTES, total)
        part = buf[at:end]
        inside = is_word[part]
        change = np.diff(inside.astype(np.int8), prepend=0, append=0)
        s, e = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        up, down = _powers(len(part) + 1)
        run = np.empty(len(part) + 1, np.uint64)
        run[0] = 0
        np.cumsum(salt[fold[part]] * up[:len(part)], out=run[1:])
        hashes.append(mix((run[e] - run[s]) * down[s] + (e - s).astype(np.uint64)))
        starts.append(s + at)
        ends.append(e + at)
        at = end
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each position on; the last n - 1 positions have none."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for j in range(n):
        out *= np.uint64(_BASE)
        out += hashes[j:len(hashes) - n + 1 + j]
    return mix(out + np.uint64(n))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, as many as its length, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, lengths)


def gathered(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES, rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in batches of about ``limit`` bytes of text, or one longer row,
    and of less than twice ``rows`` rows."""
    held, size, count = [], 0, 0
    for batch in batches:
        for part in slices(batch, column, limit, rows):
            held.append(part)
            size += part.column(column).nbytes
            count += part.num_rows
            if size >= limit or rows and count >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size, count = [], 0, 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def give_back() -> None:
    """Return freed memory to the system: a worker process outlives its task and waits for others."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # a C library without it keeps its own pools
        ctypes.CDLL(None).malloc_trim(0)


def by_slice(fn: Callable[[pa.RecordBatch], pa.RecordBatch], column: str, limit: int = SLICE_BYTES, rows: int | None = None):
    """A ``mapInArrow`` function that applies ``fn`` to rows of bounded bytes of a column, and
    to about ``rows`` rows at most if what ``fn`` needs grows with their number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = None
        for part in gathered(batches, column, limit, rows):
            yield fn(part)
        part = None
        give_back()
    return run
