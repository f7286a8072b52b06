"""Shared pieces: the shared folder, Arrow maps, integer mixing and word splitting."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows of one Arrow batch are cut into chunks of about this many bytes of text before numpy sees them.
CHUNK_BYTES = 1 << 21
SLICE_ROWS = 1024
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Odd base of the polynomial hash over bytes, and its inverse modulo 2**64.
BASE = 0x100000001B3
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where it is set, else a new one, which is then set; that only in local mode, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not found:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="pagemill-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """df written once under the shared folder and read back: cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow over slices of its batches, so that few rows are Python objects at a time; a task that ends gives its worker's free memory back, as workers stay for later stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(b.slice(i, SLICE_ROWS) for b in batches for i in range(0, b.num_rows, SLICE_ROWS))
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    conf = df.sparkSession.conf
    if conf.get(BATCH_ROWS) == "10000":  # Spark's own value: batches of long texts would take tens of MB on both sides
        conf.set(BATCH_ROWS, str(SLICE_ROWS))
    return df.mapInArrow(run, schema)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [b or b"" for b in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def as_texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def chunks(sizes: list[int], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes each; a longer row is alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, modulo 2**64; kept for reuse up to 32 MB each."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        made = []
        for base in (BASE, BASE_INVERSE):
            p = np.empty(size, np.uint64)
            p[0] = 1
            done = 1
            while done < size:
                step = min(done, size - done)
                p[done : done + step] = p[:step] * np.uint64(pow(base, done, 1 << 64))
                done += step
            made.append(p)
        if size > 1 << 22:
            return made[0], made[1]
        _POWERS[:] = made
    return _POWERS[0], _POWERS[1]


_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and how many words each text has.

    A word is a maximal run of ASCII letters, digits and bytes of non-ASCII characters; ASCII letters count in lower case.
    """
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    word = _WORD_BYTE[joined]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if word[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[::2], edge[1::2]
    up, down = powers(len(joined) + 1)
    total = np.empty(len(joined) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_LOWER[joined] * up[: len(joined)], out=total[1:])
    hashed = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * GOLDEN)
    last = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    return hashed, np.diff(np.searchsorted(starts, last), prepend=0)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
