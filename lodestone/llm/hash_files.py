"""Sets of 64-bit hashes that workers look up: sorted arrays in bucket files of the shared folder, memory-mapped.

Every bucket has a file, if an empty one, so a file that is lost is an error and not an empty set.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import planes, read_array, unplanes, write_file

#: What a hash keeps while occurrences are counted: two that differ below it count as one, which only adds candidates.
KEPT_BITS = 48
AT_ONCE = 4_000_000


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """By size of the hash, so that a bucket's file is a stretch of the sorted whole."""
    return (((hashes >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


class HashFiles:
    """Looks hashes up in the files ``folder/name-bucket``. Hashes are cut to their upper ``bits``."""

    def __init__(self, folder: str, name: str, buckets: int, bits: int = 64, often: str | None = None):
        self.folder, self.name, self.buckets, self.drop, self.often = folder, name, buckets, np.uint64(64 - bits), often
        self.files: dict[tuple[str, int], np.ndarray] = {}

    def __reduce__(self):  # workers open files themselves
        return HashFiles, (self.folder, self.name, self.buckets, 64 - int(self.drop), self.often)

    def file(self, name: str, b: int) -> np.ndarray:
        if (name, b) not in self.files:
            self.files[name, b] = read_array(f"{self.folder}/{name}-{b}", np.uint64)
        return self.files[name, b]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """0: not in the set, 1: in it, 2: in the set of frequent ones too."""
        order = np.argsort(hashes)
        h, out = (hashes[order] >> self.drop) << self.drop, np.zeros(len(hashes), np.int8)
        cuts = np.searchsorted(bucket_of(h, self.buckets), np.arange(self.buckets + 1))
        for b, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            for name in (self.name, self.often):
                if j > i and name and len(known := self.file(name, b)):
                    k = np.minimum(np.searchsorted(known, h[i:j]), len(known) - 1)
                    out[order[i:j]] += known[k] == h[i:j]
        return out


def write_hashes(rows: DataFrame, folder: str, name: str, buckets: int) -> HashFiles:
    """Files of the distinct values of the column ``hash`` (64 bits as a signed long)."""

    def deal(batches):
        for batch in batches:
            h = np.unique(batch.column(0).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(bucket_of(h, buckets).astype(np.int32)), pa.array(h.view(np.int64))], ["bucket", "hash"])

    def write(batches):
        now, parts = None, []

        def done():
            write_file(f"{folder}/{name}-{now}", [np.unique(np.concatenate(parts)).tobytes()])
            return pa.RecordBatch.from_pydict({"bucket": pa.array([now], pa.int32())})

        for batch in batches:
            bucket, h, known = batch.column(0).to_numpy(), batch.column(1).fill_null(0).to_numpy().view(np.uint64), batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            for i in np.unique(bucket).tolist():
                if i != now and parts:
                    yield done()
                    parts = []
                now = i
                parts.append(h[(bucket == i) & known])
        if parts:
            yield done()

    every = rows.sparkSession.range(buckets).selectExpr("cast(id as int) bucket", "cast(null as long) hash")
    dealt = rows.select("hash").mapInArrow(deal, "bucket int, hash long").union(every).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    dealt.mapInArrow(write, "bucket int").collect()  # a row for each bucket
    return HashFiles(folder, name, buckets)


def repeated(rows: DataFrame, hashes: Callable, folder: str, buckets: int, often: int) -> HashFiles:
    """The hashes that occur twice or more, and of these those that occur more than ``often`` times. ``hashes`` makes of
    an iterator of batches of ``rows`` one of arrays of hashes; equal ones are summed before they are shuffled."""
    drop = np.uint64(64 - KEPT_BITS)

    def blocks(held):
        h, n = np.unique((np.concatenate(held) >> drop) << drop, return_counts=True)
        cuts = np.searchsorted(bucket_of(h, buckets), np.arange(buckets + 1))
        found = [(b, planes(np.diff(h[i:j] >> drop, prepend=np.uint64(0))), planes(n[i:j].astype(np.min_scalar_type(int(n[i:j].max()))))) for b, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if j > i]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int32(), pa.binary(), pa.binary()))], ["bucket", "hashes", "counts"])

    def count(batches):
        held, size = [], 0
        for h in hashes(batches):
            held.append(h)
            size += len(h)
            if size > AT_ONCE:
                yield blocks(held)
                held, size = [], 0
        if size:
            yield blocks(held)

    def merge(batches):
        now, parts = None, []

        def done():
            h, n = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
            order = np.argsort(h, kind="stable")
            h, n = h[order], n[order]
            head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            h, n = h[head] << drop, np.add.reduceat(n, head) if len(h) else n
            write_file(f"{folder}/repeated-{now}", [h[n > 1].tobytes()])
            write_file(f"{folder}/often-{now}", [h[n > often].tobytes()])
            return pa.RecordBatch.from_pydict({"bucket": pa.array([now], pa.int32())})

        for batch in batches:
            for b, h, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if b != now and parts:
                    yield done()
                    parts = []
                now = b
                parts.append((np.cumsum(unplanes(h, np.uint64), dtype=np.uint64), unplanes(n, f"<u{len(n) * 8 // max(1, len(h)) or 1}").astype(np.int64)))
        if parts:
            yield done()

    schema = "bucket int, hashes binary, counts binary"
    every = rows.sparkSession.range(buckets).selectExpr("cast(id as int) bucket", "X'' hashes", "X'' counts")
    dealt = rows.mapInArrow(count, schema).union(every).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    dealt.mapInArrow(merge, "bucket int").collect()  # a row for each bucket
    return HashFiles(folder, "repeated", buckets, KEPT_BITS, "often")
