"""What the training-data operators share: tables, the shared folder, raw files there, batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import mmap
import os
import re
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a materialised table that no later step reads."""
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def settle(spark: SparkSession) -> None:
    """Let the driver drop what no step needs any more: the shuffle files of steps whose results are written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


# Raw files: plain files under file:, else through pyarrow's file systems.


def _local(uri: str) -> str | None:
    if uri.startswith("file:"):
        return re.sub(r"^file:/*", "/", uri)
    return uri if uri.startswith("/") else None


def write_file(uri: str, parts) -> None:
    """Write buffers one after another under a name of this attempt, then rename: repeated attempts do no harm."""
    if path := _local(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        own = f"{path}.{uuid.uuid4().hex}.tmp"
        with open(own, "wb") as f:
            for p in parts:
                f.write(p)
        os.replace(own, path)
        return
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(uri)
    files.create_dir(os.path.dirname(path), recursive=True)
    with files.open_output_stream(own := f"{path}.{uuid.uuid4().hex}.tmp") as f:
        for p in parts:
            f.write(p)
    files.move(own, path)


UNTRACKED = {"trackfd": False} if sys.version_info >= (3, 13) else {}


def read_array(uri: str, dtype) -> np.ndarray:
    """Memory-mapped where the shared folder is mounted, with no file left open from Python 3.13 on, else read whole."""
    if path := _local(uri):
        if not os.path.getsize(path):
            return np.zeros(0, dtype)
        with open(path, "rb") as f:
            return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **UNTRACKED), dtype=dtype)
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(uri)
    with files.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=dtype)


def open_input(uri: str):
    if path := _local(uri):
        return open(path, "rb")
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(uri)
    return files.open_input_file(path)


def task_id() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


# Batches


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.view(kind).to_pylist() if column.type != kind else column.to_pylist()


#: What drops the memory that an operator keeps between tasks of a worker process.
KEPT: list = []


def release() -> None:
    """Give back what earlier tasks of this worker process left, before a task of another kind begins."""
    for drop in KEPT:
        drop()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 4 << 20, fresh: bool = True) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a text column has about so many bytes in each; a longer text stands alone. Not ``fresh``: what
    tasks before remember is of use."""
    if fresh:
        release()
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def need_compute() -> None:
    import pyarrow.compute  # noqa: F401


need_compute()


class Words(dict):
    """Numbers words from 0 in the order they come: words[w] gives w's number, new or old."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def numbered(words: Words, tokens: list) -> np.ndarray:
    return np.fromiter(map(words.__getitem__, tokens), dtype=np.int64, count=len(tokens))


def planes(x: np.ndarray) -> bytes:
    """Bytes of one significance together: sorted or small numbers then compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def unplanes(b: bytes, dtype) -> np.ndarray:
    k = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(k, -1).T).reshape(-1).view(dtype)


MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), element by element."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + MIX
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


P = np.uint64(0x9E3779B97F4A7C15)
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        with np.errstate(over="ignore"):
            inverse = np.uint64(pow(int(P), -1, 1 << 64))
            _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, x)])) for x in (P, inverse)]
    return _POWERS[0], _POWERS[1]


def bounded_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Smaller Arrow batches, so that long texts don't fill a worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def is_held_out(column: str, modulus: int):
    return (F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus)) == 1)
