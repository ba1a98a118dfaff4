"""Exact removal of repeated byte strings, by column-wise construction over many documents.

Every window of ``width`` bytes has an anchor: its least-hashed ``gram``, leftmost on ties, so equal windows have
equal anchors at equal offsets. Runs of windows with one anchor form a segment, and segments are aligned at their
anchors. Anchors that occur once can't belong to a repeated window; all others' segments form collections, whole
anchors together. A collection is built column by column, right to left: each round inserts one symbol of every
segment by a stable counting sort of the previous order (the positional Burrows-Wheeler transform of the
collection) and updates the common prefixes of neighbours from the least of those between their previous places.
A column's runs with common prefixes of ``width`` or more hold its repeated windows. As aligned segments meet only
in the same column, a round costs the number of segments, not the bytes built so far.

Columns are read and written one after another; a collection beyond ``IN_MEMORY`` bytes lies in a column-major
file in the shared folder, where that is mounted. A segment that comes twice repeats whole, so its spans are given out
at once and only one copy of it, with a weight, joins a collection. Anchors that occur more than ``HOT`` times have
their windows dealt one by one, by their own bytes, so that no task gets all that surrounds a frequent passage: what
a task holds is bounded by ``COLLECTION`` and ``HOT`` segments, whatever the corpus. Repeated anchors are sorted hash
files in the shared folder, memory-mapped by the tasks that filter segments.

This departs from building one transform over whole documents: its rounds would number as many as the longest
document has bytes, each over all documents. Aligned segments make it about ``2 * width`` rounds over the repeated parts alone.

Null and empty texts have no bytes and nothing removed. Rows repeated with the same id and text are documents of
their own, repeat each other, and get the same answer. Null ids are kept. An empty table gives an empty result.
Other columns are not read. Texts of any length are whole: beyond 2 MB they are worked on in overlapping pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import bounded_batches, mixed, partitions, powers, release, scratch, slices, text_bytes
from .hash_files import repeated

WIDTH, GRAM = 200, 48
PIECE = 2 << 20  # of at most 2**24 bytes, as anchors are found by place in a piece
COLLECTION, IN_MEMORY = 12 << 20, 96 << 20
HOT = 50_000  # occurrences of an anchor beyond which its windows are dealt one by one


def segments(texts: list[bytes], width: int = WIDTH, gram: int = GRAM):
    """Yields (data, doc, at, start, count, left, anchor): a piece's bytes, and for each segment its document's number,
    its place in the piece and in the document, how many windows, its anchor's offset and hash."""
    room, who, offsets, size = [], [], [], 0

    def flush():
        data = np.frombuffer(b"".join(room), np.uint8)
        sizes = np.fromiter(map(len, room), np.int64, len(room))
        begins = np.cumsum(sizes) - sizes
        up, down = powers(len(data) + 1)
        with np.errstate(over="ignore"):
            sums = np.empty(len(data) + 1, np.uint64)
            sums[0] = 0
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
            grams = mixed((sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1])
        del sums
        least = ((grams >> np.uint64(24)) << np.uint64(24)) | np.arange(len(grams), dtype=np.uint64)
        span, wide = 1, width - gram + 1
        while span * 2 <= wide:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if wide > span:
            least = np.minimum(least[: len(least) - (wide - span)], least[wide - span :])
        n = sizes - width + 1
        first = np.cumsum(n) - n
        window = np.repeat(begins - first, n) + np.arange(int(n.sum()))
        anchor = (least[window] & np.uint64((1 << 24) - 1)).astype(np.int64)
        head = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        count = np.diff(np.concatenate([head, [len(anchor)]]))
        at, place = window[head], anchor[head]
        doc = np.searchsorted(begins, at, side="right") - 1
        return data, np.array(who)[doc], at, at - begins[doc] + np.array(offsets)[doc], count, place - at, grams[place]

    for i, t in enumerate(texts):
        for o in range(0, max(0, len(t) - width + 1), PIECE):
            part = t[o : o + PIECE + width - 1] if len(t) > PIECE else t
            if size and size + len(part) > PIECE:
                yield flush()
                room, who, offsets, size = [], [], [], 0
            room.append(part), who.append(i), offsets.append(o)
            size += len(part)
    if room:
        yield flush()


class Columns:
    """A collection's aligned segments, column by column; a large one is a file in the shared folder."""

    def __init__(self, strings: list[bytes], lefts: np.ndarray, anchor_at: int, n_columns: int, folder: str):
        import os

        n = len(strings)
        self.n, self.n_columns, self.path = n, n_columns, None
        if n * n_columns <= IN_MEMORY or not folder.startswith(("file:", "/")):
            self.cells = np.zeros((n_columns, n), np.uint8)
        else:
            import re
            import uuid

            self.path = f"{re.sub(r'^file:/*', '/', folder)}/columns-{uuid.uuid4().hex}"
            os.makedirs(os.path.dirname(self.path), exist_ok=True)
            self.cells = np.memmap(self.path, np.uint8, "w+", shape=(n_columns, n))
        for i in range(0, n, 8192):
            part = strings[i : i + 8192]
            sizes = np.fromiter(map(len, part), np.int64, len(part))
            flat = np.frombuffer(b"".join(part), np.uint8)
            row = np.repeat(np.arange(len(part)), sizes)
            column = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(anchor_at - lefts[i : i + 8192], sizes)
            block = np.zeros((n_columns, len(part)), np.uint8)
            block[column, row] = flat
            self.cells[:, i : i + len(part)] = block

    def close(self) -> None:
        import os

        del self.cells
        if self.path:
            os.remove(self.path)


def least_between(common: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For rising places: the least of ``common`` after one place up to the next."""
    if len(places) < 2:
        return np.zeros(0, common.dtype)
    lo = int(places[0]) + 1
    return np.minimum.reduceat(common[lo : int(places[-1]) + 1], places[:-1] + 1 - lo)


def repeated_windows(columns: Columns, first: np.ndarray, count: np.ndarray, weight: np.ndarray, width: int) -> np.ndarray:
    """(window column, segment) -> repeated. first, count: each segment's window columns; weight: how often it occurs.

    Cells outside a segment are zero; they can't make windows alike, as only windows inside their segments count."""
    n, cells = columns.n, columns.cells
    order, common = np.arange(n), np.full(n, width, np.int32)  # nothing inserted: all suffixes are empty and alike
    common[0] = 0
    last_window = columns.n_columns - width
    out = np.zeros((last_window + 1, n), bool)
    for c in range(columns.n_columns - 1, -1, -1):  # a round: insert this column's symbol of every segment
        symbol = np.asarray(cells[c])[order]
        places = np.argsort(symbol, kind="stable")
        new, s = np.zeros(n, np.int32), symbol[places]
        heads = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        for i, j in zip(heads.tolist(), [*heads[1:].tolist(), n]):
            if j - i > 1:
                new[i + 1 : j] = least_between(common, places[i:j]) + 1
        order, common = order[places], np.minimum(new, width)
        if c <= last_window:
            own = (first[order] <= c) & (c < first[order] + count[order])
            run = np.flatnonzero(common < width)
            total = np.add.reduceat(np.where(own, weight[order], 0), run)
            many = np.repeat(total > 1, np.diff(np.concatenate([run, [n]])))
            out[c, order[many & own]] = True
    return out


def spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, k, s, e): byte intervals covered by repeated windows, some overlapping; k is the row's key, as in keyed()."""
    spark = docs.sparkSession
    bounded_batches(spark)
    folder, parts = scratch(spark, "repeats"), partitions(spark)

    def found(batches):
        for batch in slices(batches, 0, PIECE):
            for *_, anchor in segments(text_bytes(batch.column(0)), width, gram):
                yield anchor

    files = repeated(docs.select("text"), found, folder, parts, HOT)
    anchor_at, n_columns = width - gram, 2 * width - gram

    def candidates(batches):
        for batch in slices(batches, 1, PIECE):
            ids, keys = batch.column(0).fill_null(0).to_numpy(), batch.column(2).to_numpy()
            for data, doc, at, start, count, left, anchor in segments(text_bytes(batch.column(1)), width, gram):
                rows: dict[tuple, list] = {}
                kind = files.find(anchor)  # 0: never elsewhere, 1: repeated, 2: very often
                on = np.flatnonzero(kind == 1)
                raw = data.tobytes()
                for d, a, s, n, b, h in zip(*(x[on].tolist() for x in (doc, at, start, count, left, anchor.view(np.int64)))):
                    rows.setdefault((h, b, raw[a : a + n + width - 1]), []).append((d, s))
                if (often := np.flatnonzero(kind == 2)).size:  # windows of very frequent anchors stand alone, dealt by their own bytes
                    for d, a, s, n, b in zip(*(x[often].tolist() for x in (doc, at, start, count, left))):
                        for j in range(n):
                            window = raw[a + j : a + j + width]
                            rows.setdefault((xxh64_intdigest(window) - (1 << 63), b - j, window), []).append((d, s + j))
                keep = list(rows.items())
                for i in range(0, len(keep), 20_000):
                    part = keep[i : i + 20_000]
                    docs_of = [np.array([d for d, _ in v], np.int64) for _, v in part]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([k[0] for k, _ in part], pa.int64()),
                            pa.array([k[1] for k, _ in part], pa.int32()),
                            pa.array([k[2] for k, _ in part], pa.binary()),
                            pa.array([ids[d].tobytes() for d in docs_of], pa.binary()),
                            pa.array([keys[d].tobytes() for d in docs_of], pa.binary()),
                            pa.array([np.array([s for _, s in v], np.int64).tobytes() for _, v in part], pa.binary()),
                        ],
                        ["anchor", "left", "segment", "ids", "keys", "starts"],
                    )

    def build(batches):
        release()
        strings: dict[tuple, int] = {}
        weight: list[int] = []
        alone: list[tuple | None] = []  # (id, key, start) of a segment that has come once; the others' spans are out already
        size, now, spans_ = 0, None, []

        def add(where, begin, length):
            """The spans of a row's documents; those of one document that overlap or touch, as in a text that goes on
            repeating itself, are one."""
            ids, keys, starts = (np.frombuffer(x, np.int64) for x in where)
            ends = starts + length
            if len(starts) > 1:  # a document's starts come together and rise
                on = (ids[1:] == ids[:-1]) & (keys[1:] == keys[:-1]) & (starts[1:] >= starts[:-1]) & (starts[1:] <= ends[:-1])
                head, last = np.flatnonzero(np.concatenate([[True], ~on])), np.flatnonzero(np.concatenate([~on, [True]]))
                ids, keys, starts, ends = ids[head], keys[head], starts[head], ends[last]
            spans_.append((ids, keys, starts + begin, ends + begin))

        def rows_of():
            columns = [pa.array(np.concatenate(c)) for c in zip(*spans_)]
            spans_.clear()
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "k", "s", "e"])

        def done():
            names = list(strings)
            lefts = np.array([b for _, b, _ in names], np.int64)
            first = anchor_at - lefts
            count = np.array([len(s) for *_, s in names]) - width + 1
            columns = Columns([s for *_, s in names], lefts, anchor_at, n_columns, folder)
            hit = repeated_windows(columns, first, count, np.array(weight), width)
            columns.close()
            on = np.array([i for i, x in enumerate(alone) if x], np.int64)
            edge = np.diff(np.pad(hit[:, on].T.astype(np.int8), ((0, 0), (1, 1))), axis=1)
            seg, begin = np.nonzero(edge == 1)
            end = np.nonzero(edge == -1)[1]
            for i, b, e in zip(on[seg].tolist(), begin.tolist(), end.tolist()):
                add(alone[i], b - int(first[i]), e - b + width - 1)

        for batch in batches:
            for h, b, s, i, k, at in zip(*(batch.column(j).to_pylist() for j in range(6))):
                if h != now and size > COLLECTION:
                    done()
                    strings, weight, alone, size = {}, [], [], 0
                now = h
                n = strings.setdefault((h, b, s), len(weight))
                if n == len(weight):
                    weight.append(0), alone.append(None)
                    size += len(s)
                times = len(i) // 8
                if weight[n] + times > 1:  # the whole segment repeats
                    for x in (alone[n], (i, k, at)):
                        if x:
                            add(x, 0, len(s))
                    alone[n] = None
                else:
                    alone[n] = (i, k, at)
                weight[n] += times
            if spans_:
                yield rows_of()
        if weight:
            done()
        if spans_:
            yield rows_of()

    rows = docs.select("doc_id", "text", "k").mapInArrow(candidates, "anchor long, left int, segment binary, ids binary, keys binary, starts binary")
    return rows.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(build, "doc_id long, k long, s long, e long")


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *others: str) -> DataFrame:
    """(doc_id, text, k, ...): k, a hash of the id and the text, tells rows with one id and different texts apart."""
    d = F.col(doc_id).cast("long")
    return docs.select(d.alias("doc_id"), F.col(text).alias("text"), F.xxhash64(d, F.col(text)).alias("k"), *others)


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, kept, kept_text, n_bytes, removed, *keep): the bytes left of each document, as text without the characters
    of which a cut took a part (null texts stay null), and the removed runs [(from, to), ...]."""
    own = keyed(docs, doc_id, text, *(F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)))
    found = spans(own, width, gram).groupBy("doc_id", "k").agg(F.collect_set(F.struct("s", "e")).alias("found"))
    found = found.select(F.col("doc_id").alias("found_id"), F.col("k").alias("found_k"), "found")
    joined = own.join(found, (F.coalesce("doc_id", F.lit(0)) == F.col("found_id")) & (F.col("k") == F.col("found_k")), "left")
    others = [f"keep_{i}" for i in range(len(keep))]
    joined = joined.select("doc_id", "text", "found.s", "found.e", *others)
    schema = joined.select("doc_id", F.lit(b"").alias("kept"), F.col("text").alias("kept_text"), F.lit(0).cast("long").alias("n_bytes"), F.array(F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("e"))).alias("removed"), *others).schema

    def cut(batches):
        pair = pa.struct([("s", pa.int64()), ("e", pa.int64())])
        for batch in batches:
            kept, texts, sizes, removed = [], [], [], []
            for t, s, e in zip(text_bytes(batch.column(1)), batch.column(2), batch.column(3)):
                runs = merged(s.values.to_numpy(), e.values.to_numpy()) if s.is_valid else []
                at, parts = 0, []
                for b, f in runs:
                    parts.append(t[at:b])
                    at = f
                parts.append(t[at:])
                kept.append(b"".join(parts) if runs else t)
                texts.append("".join(p.decode("utf-8", "ignore") for p in parts))  # part by part: no two halves make a character
                sizes.append(len(t))
                removed.append([{"s": b, "e": f} for b, f in runs])
            arrays = [batch.column(0), pa.array(kept, pa.binary()), pa.array(texts, pa.string(), mask=batch.column(1).is_null().to_numpy(zero_copy_only=False)), pa.array(sizes, pa.int64()), pa.array(removed, pa.list_(pair)), *batch.columns[4:]]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "kept", "kept_text", "n_bytes", "removed", *others])

    out = joined.mapInArrow(cut, schema)
    return out.select("doc_id", "kept", "kept_text", "n_bytes", "removed", *(F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)))


def merged(s: np.ndarray, e: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of intervals that overlap or touch."""
    order = np.argsort(s, kind="stable")
    s, e = s[order], np.maximum.accumulate(e[order])
    head = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
    return list(zip(s[head].tolist(), e[np.concatenate([head[1:], [len(s)]]) - 1].tolist()))
