"""Packing documents into sequences, shortest pack first, over the histogram of lengths.

Documents are encoded and cut into pieces of at most ``size`` tokens. The histogram of piece lengths (at most
``size`` rows, whatever the corpus) goes to the driver, which places lengths longest first, each into the packs
with the most room, and keeps only packing patterns with counts. Patterns are then joined back to the pieces by
each piece's rank among those of its length.

Each task numbers its own pieces of a length while it cuts them; the ranks of a length begin, task after task, at the
sum of the counts before. So ranks need no sort and no window over pieces, and a length that a third of the pieces
have is dealt like any other. Only numbers meet the patterns: the ids stay in the table of pieces where the task
wrote them, and are read with the places by those who select them.

Null and empty texts give a piece of the end id alone. Rows repeated with the same id are packed each time. An empty
table gives no pieces. Other columns are not read. ``memory`` is how many runs of non-blanks a worker remembers
while it encodes; it changes no result.
"""

from __future__ import annotations

from collections import defaultdict
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, slices, task_id
from .encode import default_path, encoder, with_end

#: Counts of pieces by task and length that are broadcast; more are joined by shuffle.
MOST_COUNTS = 1_000_000
PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary, ids_crc32 long, task int, own long"


def pieces(docs: DataFrame, size: int = 2048, tokenizer: str | None = None, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", memory: int = 600_000) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids, ids_crc32, task, own): every document's ids with the end id, cut at each
    ``size`` ids. ids are little-endian unsigned 32-bit integers; own is the piece's place, from 0, among those of its
    length that its task made. The numbers of a task hold together only once the table is written."""
    tokenizer = tokenizer or default_path()

    def cut(batches):
        enc, task, made = encoder(tokenizer, memory), task_id(), np.zeros(size + 1, np.int64)
        for batch in slices(batches, 1, fresh=False):
            flat, counts = with_end(*enc.encode(batch.column(1)), end_id)
            n = -(-counts // size)  # pieces of each document
            doc = np.repeat(np.arange(len(counts)), n)
            start = (np.arange(len(doc)) - (np.cumsum(n) - n)[doc]) * size
            length = np.minimum(size, counts[doc] - start)
            ends = np.cumsum(length)
            raw = memoryview(flat).cast("B")
            crc = [crc32(raw[i:j]) for i, j in zip((4 * (ends - length)).tolist(), (4 * ends).tolist())]
            order = np.argsort(length, kind="stable")
            head = np.flatnonzero(np.diff(length[order], prepend=0))
            many = np.diff(np.concatenate([head, [len(order)]]))
            own = np.empty(len(order), np.int64)
            own[order] = np.arange(len(order)) - np.repeat(head, many) + made[length[order]]
            made[length[order[head]]] += many
            ids = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(np.concatenate([[0], 4 * ends]).astype(np.int32)), pa.py_buffer(flat)])
            columns = [batch.column(0).take(pa.array(doc)), start, length, counts[doc], ids, np.array(crc, np.int64), np.full(len(doc), task, np.int32), own]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], NAMES)

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(cut, PIECES)


NAMES = [c.split()[0] for c in PIECES.split(", ")]


def patterns(histogram: dict[int, int], size: int = 2048) -> list[tuple[int, list[tuple[int, int]]]]:
    """Packing patterns: (count, [(length, how many of it in a pack), ...]), lengths falling."""
    by_room: dict[int, list[tuple[int, list]]] = defaultdict(list)
    done: list[tuple[int, list]] = []
    rest = sum(k * v for k, v in histogram.items())
    spare = 0  # room in packs that are still open

    def put(count, pack, length, times, room):
        nonlocal spare
        left = room - length * times
        runs = pack + [(length, times)] if not pack or pack[-1][0] != length else [*pack[:-1], (length, pack[-1][1] + times)]
        spare -= count * length * times
        if left:
            by_room[left].append((count, runs))
        else:
            done.append((count, runs))

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            room = max((r for r in by_room if r >= length), default=None)
            if room is None:  # open as many packs as all that is still to place needs
                each = size // length
                packs = min(n, max(-(-n // each), -(-max(0, rest - spare) // size), 1))
                times, more = divmod(n, packs)
                spare += packs * size
                for count, k in ((more, times + 1), (packs - more, times)):
                    if count:
                        put(count, [], length, k, size)
                rest -= n * length
                n = 0
                continue
            count, pack = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
            # one into each of the emptiest packs, or more at a time if there are more than all open packs can take singly
            times = max(1, min(room // length, n // max(1, sum(c for v in by_room.values() for c, _ in v) + count)))
            used = min(count, n // times)
            if used < count:
                by_room[room].append((count - used, pack))
            put(used, pack, length, times, room)
            rest -= used * times * length
            n -= used * times
    return done + [x for v in by_room.values() for x in v]


def slots(found: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: from which rank each slot serves, its first sequence, its place in the sequence."""
    out, sequence, taken = defaultdict(list), 0, defaultdict(int)
    for count, runs in found:
        place = 0
        for length, times in runs:
            for _ in range(times):
                out[length].append((taken[length], sequence, place))
                taken[length] += count
                place += length
        sequence += count
    return {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in out.items()}


def ranked(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds rank: each piece's place, from 0, among those of its length. counts: (task, length, n)."""
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)  # a row for each task
    bases = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    small = counts.limit(MOST_COUNTS + 1).count() <= MOST_COUNTS
    return rows.join(F.broadcast(bases) if small else bases, ["task", "length"]).withColumn("rank", F.col("base") + F.col("own")).drop("task", "own", "base")


def pack(docs: DataFrame, size: int = 2048, tokenizer: str | None = None, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", memory: int = 600_000) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids, ids_crc32, sequence_id, offset): where each piece lies."""
    rows = materialise(pieces(docs, size, tokenizer, end_id, doc_id, text, memory), "pieces")
    counts = materialise(rows.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    table = slots(patterns(histogram, size))

    @F.pandas_udf("sequence_id long, offset long")  # of two columns: the ids stay in the JVM
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        length, rank = length.to_numpy(), rank.to_numpy()
        order = np.argsort(length, kind="stable")
        heads = np.flatnonzero(np.diff(length[order], prepend=-1))
        sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        for i, j in zip(heads.tolist(), [*heads[1:].tolist(), len(order)]):
            on = order[i:j]
            first, seq, at = table[int(length[on[0]])]
            k = np.searchsorted(first, rank[on], side="right") - 1
            sequence[on], offset[on] = seq[k] + rank[on] - first[k], at[k]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    out = ranked(rows, counts).withColumn("at", place("length", F.col("rank").cast("long")))
    return out.select("doc_id", "start", "length", "doc_tokens", "ids", "ids_crc32", "at.sequence_id", "at.offset")
