"""Benchmark decontamination by spaced-seed hashing.

Fixed masks over token positions ignore some of them, so a hash of the others survives a substitution there. The
benchmark items' masked hashes are a sorted array (a block of items at a time, of a bounded size), joined with
every document's masked hashes where the documents are read; nothing is shuffled. Each hit names a diagonal
between a document and an item, along which the complete overlap is verified: some window of ``window`` words, or
the item if it is shorter, must agree in at least ``similarity`` of its words. Where a document begins or ends within
a window, ``least`` words or more must all agree. The masks hit every window of 8 to 16 words that agrees in 0.8.

Words are [^\\x20\\x09-\\x0D]+ with A-Z lowered and punctuation stripped from their ends. Null and empty texts have
no words. Items of fewer than ``least`` words are found where all their words stand one after another; those of fewer
than ``shortest`` are no evidence and are not searched for. Repeated rows of documents
or items are answered each time; null ids are kept. An empty table on either side gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, bounded_batches, mixed, numbered, slices, text_bytes

#: Fixed masks: 1 is a position that counts.
MASKS = ("11011", "1110111", "11010011", "101101011")
PUNCTUATION = string.punctuation.encode()
BLOCK_WORDS = 4_000_000  # of a block of items: its table has at most as many hashes for each mask


def plain(word: bytes) -> bytes:
    return word.lower().strip(PUNCTUATION)


def masked_hashes(ids: np.ndarray, mask: str) -> np.ndarray:
    """A hash for each place at which the mask fits."""
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for k, on in enumerate(mask):
            if on == "1":
                out = out * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n].astype(np.uint64)
        return mixed(out)


class Items:
    """A block of items: word numbers (from 1; 0 is any other word) and a sorted table of masked hashes."""

    def __init__(self, rows: list[tuple[int, bytes]], least: int, shortest: int):
        self.least = least
        self.words: dict[bytes, int] = {}
        self.ids, self.tokens = [], []
        for item, text in rows:
            words = [w for w in map(plain, text.split()) if w]
            if len(words) >= shortest:
                self.ids.append(item)
                self.tokens.append(np.array([self.words.setdefault(w, len(self.words) + 1) for w in words], np.int64))
        self.masks, self.tables = [*MASKS, *("1" * n for n in sorted({len(t) for t in self.tokens if len(t) < least}))], []
        for mask in self.masks:
            fits = (lambda t: len(t) == len(mask)) if mask not in MASKS else lambda t: len(t) >= least
            hashes = [masked_hashes(t, mask) if fits(t) else np.zeros(0, np.uint64) for t in self.tokens]
            h = np.concatenate([np.zeros(0, np.uint64), *hashes])
            item = np.repeat(np.arange(len(hashes)), [len(x) for x in hashes])
            place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(x)) for x in hashes)]).astype(np.int64)
            order = np.argsort(h, kind="stable")
            h = h[order]
            some = np.zeros(1 << 20, bool)  # most places of a document are settled by this
            some[(h >> np.uint64(44)).astype(np.int64)] = True
            self.tables.append((h, item[order], place[order], some))

    def hits(self, ids: np.ndarray):
        """(place, item, place in the item) of all hits in a run of word numbers."""
        places, items, at = [], [], []
        for mask, (h, item, place, some) in zip(self.masks, self.tables):
            own = masked_hashes(ids, mask)
            maybe = np.flatnonzero(some[(own >> np.uint64(44)).astype(np.int64)])
            lo, hi = np.searchsorted(h, own[maybe], "left"), np.searchsorted(h, own[maybe], "right")
            n = hi - lo
            which = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            places.append(np.repeat(maybe, n)), items.append(item[which]), at.append(place[which])
        return np.concatenate(places), np.concatenate(items), np.concatenate(at)


def verify(doc: np.ndarray, item: np.ndarray, shift: int, window: int, similarity: float, least: int) -> tuple[int, int, int, float] | None:
    """Along a diagonal: the stretch covered by windows that agree enough (from, to, words that agree, best share)."""
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    size = min(window, len(item))
    if hi - lo < size:  # the document begins or ends here
        if hi - lo < least:
            return None
        size, similarity = hi - lo, 1.0
    if size < least:
        similarity = 1.0
    same = (doc[lo + shift : hi + shift] == item[lo:hi]) & (item[lo:hi] > 0)
    sums = np.concatenate([[0], np.cumsum(same)])
    share = (sums[size:] - sums[:-size]) / size
    good = np.flatnonzero(share >= similarity - 1e-9)
    if not len(good):
        return None
    a, b = lo + int(good[0]), lo + int(good[-1]) + size
    return a + shift, b + shift, int(same[a - lo : b - lo].sum()), float(share.max())


def item_blocks(benchmark: DataFrame, item_id: str, text: str):
    """Blocks of (item, text), each of at most BLOCK_WORDS words or one item."""
    rows, size = [], 0
    for r in benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).orderBy("i").toLocalIterator():
        t = (r.t or "").encode()
        n = t.count(b" ") + t.count(b"\n") + 1
        if rows and size + n > BLOCK_WORDS:
            yield rows
            rows, size = [], 0
        rows.append((r.i, t))
        size += n
    if rows:
        yield rows


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = 16, similarity: float = 0.8, least: int = 8, shortest: int = 3, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, item_id, from_word, to_word, n_same, similarity, *keep): a row for each document and item that overlap,
    with the best diagonal's stretch of words."""
    spark = docs.sparkSession
    bounded_batches(spark)
    names = [f"keep_{i}" for i in range(len(keep))]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *(F.col(c).alias(k) for c, k in zip(keep, names)))
    zero = F.lit(0).cast("long")
    schema = rows.select("doc_id", zero.alias("item_id"), zero.alias("from_word"), zero.alias("to_word"), zero.alias("n_same"), F.lit(0.0).alias("similarity"), *names).schema
    def found(batch, items):
        words = Words()
        lists = [t.split() for t in text_bytes(batch.column(1))]
        local = np.concatenate([np.zeros(0, np.int64), *(numbered(words, x) for x in lists)])
        number, blank = np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        for i, w in enumerate(words):
            w = plain(w)
            number[i], blank[i] = items.words.get(w, 0), not w
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        owner, ids = np.repeat(np.arange(len(lists)), sizes), number[local]
        word_at = np.arange(len(local)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        solid = ~blank[local]  # words of punctuation alone don't count
        owner, ids, word_at = owner[solid], ids[solid], word_at[solid]
        begins = np.searchsorted(owner, np.arange(len(lists) + 1))
        place, item, at = items.hits(ids)
        doc = owner[place] if len(place) else place
        pair = np.unique(np.stack([doc, item, place - begins[doc] - at], axis=1), axis=0) if len(place) else np.zeros((0, 3), np.int64)
        best: dict[tuple[int, int], tuple] = {}
        for d, i, shift in pair.tolist():
            v = verify(ids[begins[d] : begins[d + 1]], items.tokens[i], shift, window, similarity, items.least)
            if v and (v[2], v[3]) > best.get((d, i), (0, 0, -1, 0))[2:]:
                best[d, i] = v
        if best:
            who = np.array([d for d, _ in best])
            v = list(best.values())
            arrays = [pa.array([items.ids[i] for _, i in best], pa.int64()), pa.array(word_at[begins[who] + [x[0] for x in v]]), pa.array(word_at[begins[who] + [x[1] - 1 for x in v]] + 1), pa.array([x[2] for x in v], pa.int64()), pa.array([x[3] for x in v])]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who)), *arrays, *(c.take(pa.array(who)) for c in batch.columns[2:])], schema.names)

    out = None
    for block in item_blocks(benchmark, item_id, item_text):
        shared = spark.sparkContext.broadcast(Items(block, least, shortest))

        def work(batches, shared=shared):
            items = shared.value
            for batch in slices(batches, 1):
                yield from found(batch, items)

        part = rows.mapInArrow(work, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = rows.limit(0).mapInArrow(lambda batches: iter(()), schema)

    return out.select("doc_id", "item_id", "from_word", "to_word", "n_same", "similarity", *(F.col(k).alias(c) for k, c in zip(names, keep)))
