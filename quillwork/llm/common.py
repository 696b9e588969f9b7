"""Helpers shared by the corpus operators: tables, words, hashes, Arrow maps, shared scratch tables."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch sent to Python: bounds a worker's memory whatever the length of texts.
BATCH_BYTES = "8m"
BATCH_ROWS = "2000"
#: Rows of one batch of Spark's Parquet reader: texts are long, and its buffers hold a batch of them.
READER_ROWS = "1024"

#: A-Z become a-z, digits, a-z and all bytes from 0x80 stay, every other byte becomes a space.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256)
)
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches bounded in bytes as well as rows; a worker gives its free memory back after each task."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    conf.set("spark.sql.parquet.columnarReaderBatchSize", READER_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        _give_back()

    return df.mapInArrow(run, schema)


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library: its memory stays with the worker
        pass


def texts(column: pa.Array) -> list[bytes | None]:
    """The column's texts as UTF-8 bytes, without decoding them."""
    if pa.types.is_large_string(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist()


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that the whole cluster shares: spark.checkpoint.dir, or the context's checkpoint folder.

    Only a session within one process, as in tests, may do without: it gets a folder of its own.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quillwork-"))
        root = context.getCheckpointDir()
    return f"{root.rstrip('/')}/quillwork/{context.applicationId}/{label}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def clear_scratch(spark: SparkSession) -> None:
    """Removes this application's written tables, when no result that reads them is needed any more."""
    _delete(spark, scratch(spark, "x").rpartition("/")[0])


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows, written to the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame, release: bool = False) -> None:
    """Removes written tables that nothing reads any more, and with `release` the shuffle files of finished jobs.

    Spark's cleaner removes these when the driver's heap is collected; else they stay on the executors' disks until the
    application ends.  Python's references to plans reach the driver's heap about a second after they are dropped.
    """
    for each in tables:
        _delete(each.sparkSession, each.scratch_path)
    for _ in range(2 if release else 0):  # what the first pass drops may hold more
        gc.collect()
        time.sleep(1.2)
        tables[0].sparkSession.sparkContext._jvm.System.gc()


def held_out(doc_id) -> F.Column:
    """Whether crc32(doc_id as text) mod 4 is 2; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


MASK = (1 << 64) - 1
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix), element by element."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word bytes -> 64-bit hash; a bounded cache, emptied when it is full."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        import xxhash

        self.hash, self.most = xxhash.xxh3_64_intdigest, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = self.hash(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class Rolling:
    """Hashes of all windows of n words by prefix sums of h[i] * base**i modulo 2**64."""

    def __init__(self, base: int):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 4096, 2 * len(self.up))
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, self.base, np.uint64)], dtype=np.uint64)
                self.down = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, self.inverse, np.uint64)], dtype=np.uint64)

    def prefix(self, h: np.ndarray) -> np.ndarray:
        self._grow(len(h) + 1)
        with np.errstate(over="ignore"):
            return np.r_[np.uint64(0), np.cumsum(h * self.up[: len(h)], dtype=np.uint64)]

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hash of words start..end-1, position independent."""
        with np.errstate(over="ignore"):
            return mix((prefix[end] - prefix[start]) * self.down[start] + (end - start).astype(np.uint64))

    def windows(self, prefix: np.ndarray, n: int) -> np.ndarray:
        count = len(prefix) - n
        with np.errstate(over="ignore"):
            return mix((prefix[n:] - prefix[:count]) * self.down[:count] + np.uint64(n))


def arrow_append(
    df: DataFrame, inputs: list[str], fn: Callable[[], Callable[[pa.RecordBatch], dict[str, pa.Array]]], fields: str, keep: list[str] | None = None
) -> DataFrame:
    """The kept columns of `df` (all by default) with new columns computed from `inputs`, batch by batch.

    `fn()` is called once a task and returns the function that maps a batch of the inputs (columns 0, 1, ...) to the
    new columns by name.  Kept columns travel by position, so any names, clashing or not, are safe.
    """
    kept = df.columns if keep is None else keep
    have = {c: i for i, c in reversed(list(enumerate(df.columns)))}
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    at = list(range(len(df.columns))) if keep is None else [have[c] for c in keep]
    cols = [F.col(f"c{have[c]}").alias(f"i{k}") for k, c in enumerate(inputs)] + [F.col(f"c{i}").alias(f"kept_{j}") for j, i in enumerate(at)]
    kinds = [f"kept_{j} {df.schema[i].dataType.simpleString()}" for j, i in enumerate(at)]
    n = len(inputs)
    names = [f.split()[0] for f in _split_ddl(fields)]
    kinds += [f"new_{j} {f.split(None, 1)[1]}" for j, f in enumerate(_split_ddl(fields))]
    plain_names = [k.split()[0] for k in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = None
        for batch in batches:
            each = each or fn()
            new = each(batch)
            arrays = [batch.column(n + j) for j in range(len(at))] + [new[k] for k in names]
            yield pa.RecordBatch.from_arrays(arrays, plain_names)

    out = arrow_map(plain.select(*cols), run, ", ".join(kinds))
    return out.toDF(*kept, *names)


def _split_ddl(fields: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(fields):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(fields[start:i].strip())
            start = i + 1
    return [*out, fields[start:].strip()]
