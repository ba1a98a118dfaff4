"""SimHash near-duplicates by multi-index hashing.

Fingerprints of 64 bits are cut into two segments of 32. Two that differ in at most 3 bits differ in at most one
bit of some segment, so each fingerprint enumerates the Hamming ball of radius 1 in each segment and looks it up
in that segment's table; complete distances are verified on the matches. Of two neighbours only the one with the
cleared bit probes, so each match is met once a segment.

All documents with one fingerprint are one class, so copies are never expanded. Probes and table rows meet by
segment value; a value shared by very many classes is dealt over chunks of the table, probes being repeated for
each, and what leaves a task is a spanning forest of its verified links, never all pairs.

Null, empty and blank texts have the fingerprint zero and are linked like any other. Texts with fewer words than
a shingle have one shingle, all their words. Repeated rows, and rows with a null id, give a row each; a
component's id is the least id in it (null if it has none). An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, partitions, release, slices, text_bytes
from .components import components

SEGMENTS, SEGMENT_BITS, MOST_BITS = 2, 32, 3
#: Table rows of one segment value that one task compares with; a value with more is dealt over chunks.
CHUNK = 4096
#: Segment values with more than CHUNK rows that are broadcast; beyond, they are joined.
MOST_HOT = 50_000


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Bit i is set if it is set in over half of the XXH64 (seed 42) of the text's shingles, repeats included."""
    from xxhash import xxh64_intdigest as h

    words = text.lower().split()  # of bytes: A-Z, and exactly \x20\x09-\x0D
    if not words:
        return 0
    if len(words) > shingle:
        hashes = [h(s, 42) for s in map(b" ".join, zip(*(words[i:] for i in range(shingle))))]
    else:
        return h(b" ".join(words), 42)
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    set_ = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(set_, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, *keep): fp as a signed long with the fingerprint's bits."""
    others = [f"keep_{i}" for i in range(len(keep))]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *(F.col(c).alias(k) for c, k in zip(keep, others)))
    schema = rows.select("doc_id", F.lit(0).cast("long").alias("fp"), *others).schema

    def work(batches):
        for batch in slices(batches, 1):
            found = np.array([fingerprint(t, shingle) for t in text_bytes(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), *batch.columns[2:]], schema.names)

    bounded_batches(docs.sparkSession)
    return rows.mapInArrow(work, schema).select("doc_id", "fp", *(F.col(k).alias(c) for k, c in zip(others, keep)))


def probes(fps: DataFrame) -> DataFrame:
    """(seg, key, fp, is_table): each fingerprint once in each segment's table, and its probes: the segment itself
    and the segment with one cleared bit set."""

    def work(batches):
        flips = np.concatenate([[0], np.uint64(1) << np.arange(SEGMENT_BITS, dtype=np.uint64)]).astype(np.uint64)
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for seg in range(SEGMENTS):
                value = (fp >> np.uint64(seg * SEGMENT_BITS)) & np.uint64((1 << SEGMENT_BITS) - 1)
                for i in range(0, len(fp), 20_000):
                    v = value[i : i + 20_000, None]
                    keys = v | flips
                    on = (v & flips) == 0
                    row, _ = np.nonzero(on)
                    key = np.concatenate([value[i : i + 20_000], keys[on]])
                    who = np.concatenate([fp[i : i + 20_000], fp[i : i + 20_000][row]])
                    is_table = np.zeros(len(key), bool)
                    is_table[: len(v)] = True
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), seg, np.int32)), pa.array(key.astype(np.int64)), pa.array(who.view(np.int64)), pa.array(is_table)], ["seg", "key", "fp", "is_table"])

    return fps.select("fp").mapInArrow(work, "seg int, key long, fp long, is_table boolean")


class Forest:
    """Union-find over fingerprints that gives each joining link once."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        p = self.parent
        r = x
        while (q := p.get(r, r)) != r:
            r = q
        while (q := p.get(x, x)) != r:
            p[x] = r
            x = q
        return r

    def join(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        new = []
        for x, y in zip(a.tolist(), b.tolist()):
            r, s = self.root(x), self.root(y)
            if r != s:
                self.parent[r] = s
                new.append((x, y))
        return new


def links(fps: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """(a, b): links between distinct fingerprints that differ in at most ``most_bits`` bits, as spanning forests:
    whatever is connected by links stays connected."""
    if most_bits >= 2 * SEGMENTS:
        raise ValueError("balls of radius 1 in two segments find up to 3 differing bits")
    spark = fps.sparkSession
    fps = materialise(fps.select("fp").distinct(), "fingerprints")
    segment = lambda s: F.shiftrightunsigned("fp", s * SEGMENT_BITS).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))
    values = fps.select(F.explode(F.array(*(F.struct(F.lit(s).alias("seg"), segment(s).alias("key")) for s in range(SEGMENTS)))).alias("x")).select("x.*")
    hot = values.groupBy("seg", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CHUNK)
    hot = materialise(hot.select("seg", "key", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")), "hot")
    n_hot = hot.count()
    rows = probes(fps)
    if n_hot:
        rows = rows.join(F.broadcast(hot) if n_hot <= MOST_HOT else hot, ["seg", "key"], "left")
        own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
        chunk = F.when(F.col("chunks").isNull(), F.array(F.lit(0))).when(F.col("is_table"), F.array(own)).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))
        rows = rows.select("seg", "key", "fp", "is_table", F.explode(chunk).alias("chunk"))
    else:
        rows = rows.withColumn("chunk", F.lit(0))
    rows = rows.repartition(partitions(spark), "seg", "key", "chunk").sortWithinPartitions("seg", "key", "chunk", F.desc("is_table"))

    def match(batches):
        release()
        forest, group, table, wait = Forest(), None, [], []

        def compare():
            """All probes of the group against its table, a block at a time."""
            if not table or not wait:
                return []
            t, w, new = np.concatenate(table).view(np.uint64), np.concatenate(wait).view(np.uint64), []
            if len(t) * len(w) == 1:
                a = t ^ w
                return forest.join(t, w) if 0 < int(a[0]).bit_count() <= most_bits else []
            for i in range(0, len(w), max(1, (1 << 20) // len(t))):
                part = w[i : i + max(1, (1 << 20) // len(t))]
                bits = np.bitwise_count(part[:, None] ^ t[None, :])
                x, y = np.nonzero((bits <= most_bits) & (bits > 0))
                new += forest.join(part[x], t[y])
            return new

        def out(new):
            a = np.array(new, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["a", "b"])

        for batch in batches:
            seg, key, fp, is_table, chunk = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            change = np.flatnonzero((seg[1:] != seg[:-1]) | (key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1])) + 1
            starts = np.concatenate([[0], change])
            ends = np.concatenate([change, [len(seg)]])
            new = []
            # groups without a table row or without a foreign probe can't match; look at the others only
            counts = np.add.reduceat(is_table.astype(np.int64), starts)
            for k, (i, j, n) in enumerate(zip(starts.tolist(), ends.tolist(), counts.tolist())):
                g = (seg[i], key[i], chunk[i])
                if g != group:
                    new += compare()
                    group, table, wait = g, [], []
                last = j == len(seg)
                if not last and (n == 0 or j - i - n == 0) and not table:
                    continue
                if n:
                    table.append(fp[i : i + n])
                if j - i - n:
                    wait.append(fp[i + n : j])
                if sum(map(len, wait)) > 1 << 16:
                    new += compare()
                    wait = []
            if len(forest.parent) > 1 << 21:  # bounded memory: what is emitted may then repeat
                forest.parent.clear()
            yield out(new)
        yield out(compare())

    return rows.select("seg", "key", "fp", "is_table", "chunk").mapInArrow(match, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, most_bits: int = MOST_BITS, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, component_id, root, *keep), a row for each document. root, one of the component's fingerprints, names
    the component even where no row of it has an id."""
    each = materialise(fingerprints(docs, shingle, doc_id, text, keep), "simhash")
    classes = materialise(each.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    found = components(links(classes, most_bits))
    of = classes.join(found.select(F.col("node").alias("fp"), F.col("component").alias("root")), "fp", "left")
    linked = of.where("root is not null").groupBy("root").agg(F.min("least").alias("component_id"))
    linked = of.where("root is not null").join(linked, "root").select("fp", "component_id", "root")
    whole = linked.union(of.where("root is null").select("fp", F.col("least").alias("component_id"), F.col("fp").alias("root")))
    return each.join(whole, "fp").select("doc_id", "fp", "component_id", "root", *keep)
