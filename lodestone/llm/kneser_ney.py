"""An interpolated modified Kneser-Ney model of order 2 or 3, counted in Spark, kept as sorted hash arrays, memory-mapped to score.

Training takes three passes of map-side combined counts: words, bigrams, and the number of contexts of each word.
The vocabulary is a sorted array of 64-bit word hashes in bucket files; a word's rank in it is its number. A
bigram's key is its context's rank above its word's rank, in sorted bucket files with counts. Contexts are dealt
to buckets by rank, but those frequent enough to fill a bucket, and the start of a text, are dealt by hash of the
whole key. Workers map the files and search them with each batch's distinct keys; no table goes to the driver but
the frequent contexts (at most two for each bucket) and a few sums.

Order 3 takes two more passes. A trigram's key is the place of its first two words in the bigram files above its last
word's rank; what follows two words that fill a bucket is dealt by hash of the whole key. A bigram then counts the
words before it, but at a text's start, where nothing is before, how often it occurs. Up to 2**32 - 1 distinct bigrams.

Tokens: words [^\\x20\\x09-\\x0D]+ with A-Z lowered, then one end a text. Null and empty texts are an end alone.
Repeated rows count each time. With no training text every token has the unknown's share, 1. Null ids are never
held out. Other columns are not read. Up to 2**32 - 3 distinct words.
"""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import bounded_batches, discard, materialise, mixed, partitions, planes, read_array, scratch, settle, slices, unplanes, write_file

START, UNKNOWN = 0xFFFFFFFF, 0xFFFFFFFE
END = b" "  # no word has a blank
CONTEXT = np.dtype([("total", "<u8"), ("n", "<u4", (3,))])
HALF = np.uint64(32)


def batch_tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Local numbers of all tokens, texts one after another, how many each text has, and the hashes
    of what is numbered, which rise: known words' ranks then do too, and files are searched from front to back."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        column = column.view(pa.large_string() if pa.types.is_large_binary(column.type) else pa.string())
    if column.null_count:
        column = column.fill_null("")
    # a blank behind the last word makes an empty string of each end; of bytes, so any are passed through
    text = pa.compute.ascii_trim_whitespace(pa.compute.ascii_lower(column))
    blank, nothing = (pa.scalar(x, text.type) for x in (" ", ""))
    text = pa.compute.binary_join_element_wise(text, pa.compute.if_else(pa.compute.greater(pa.compute.binary_length(text), 0), blank, nothing), nothing)
    lists = pa.compute.ascii_split_whitespace(text)
    tokens = lists.flatten().dictionary_encode()
    words = tokens.dictionary.view(pa.large_binary() if pa.types.is_large_string(text.type) else pa.binary()).to_numpy(zero_copy_only=False)
    hashed = np.fromiter((xxh64_intdigest(w or END, 42) for w in words), np.uint64, len(words))
    order = np.argsort(hashed)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place[tokens.indices.to_numpy()], np.diff(lists.offsets.to_numpy()).astype(np.int64), hashed[order]


def by_range(values: np.ndarray, n: int) -> np.ndarray:
    return (((values >> HALF) * np.uint64(n)) >> HALF).astype(np.int64)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts.astype(np.int64)
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[head], np.add.reduceat(counts.astype(np.int64), head)


def in_order(bucket: np.ndarray) -> np.ndarray:
    """A stable order; numbers of 16 bits are sorted by their digits, which is much quicker."""
    return np.argsort(bucket.astype(np.uint16) if len(bucket) and bucket.max() < 1 << 16 else bucket, kind="stable")


def by_bucket(bucket: np.ndarray):
    """(bucket, which elements are in it) for each bucket that has any."""
    order = in_order(bucket)
    own = bucket[order]
    heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else own
    for i, j in zip(heads.tolist(), [*heads[1:].tolist(), len(own)]):
        yield int(own[i]), order[i:j]


def blocks(buckets: np.ndarray, n: int, keys: np.ndarray, counts: np.ndarray):
    """A row (bucket, keys, counts) for each bucket; keys rise within it."""
    order = in_order(buckets)
    cuts = np.searchsorted(buckets[order], np.arange(n + 1))
    rows = []
    for b, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
        if j > i:
            own = counts[order[i:j]]
            rows.append((b, planes(np.diff(keys[order[i:j]], prepend=np.uint64(0))), planes(own.astype(np.min_scalar_type(int(own.max()))))))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((),) * 3, (pa.int32(), pa.binary(), pa.binary()))], ["bucket", "keys", "counts"])


BLOCK = "bucket int, keys binary, counts binary"


def dealt(rows: DataFrame, n: int) -> DataFrame:
    """Blocks by bucket, with an empty one for each bucket: every bucket then writes its files, and a missing file is an error."""
    every = rows.sparkSession.range(n).selectExpr("cast(id as int) bucket", "X'' keys", "X'' counts")
    return rows.unionByName(every, allowMissingColumns=True).repartition(n, "bucket").sortWithinPartitions("bucket")


def grouped(batches, done):
    """Calls done(bucket, keys, counts) with each bucket's sums; rows come sorted by bucket. Counts are as wide as their
    block needs."""
    now, keys, counts = None, [], []
    for batch in batches:
        for b, k, c in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if b != now and keys:
                yield from done(now, *summed(np.concatenate(keys), np.concatenate(counts)))
                keys, counts = [], []
            now = b
            keys.append(np.cumsum(unplanes(k, np.uint64), dtype=np.uint64)), counts.append(unplanes(c, f"<u{len(c) * 8 // max(1, len(k)) or 1}").astype(np.int64))
    if keys:
        yield from done(now, *summed(np.concatenate(keys), np.concatenate(counts)))


def discounts(n: np.ndarray) -> np.ndarray:
    """Of counts 1, 2 and 3 or more, from how many things have counts 1 to 4."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if not (n1 and n2 and n3):
        return np.array([0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    d = np.array([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(d, 0.01, [0.99, 1.99, 2.99])


def read(path: str, dtype: str) -> np.ndarray:
    """A model's file. Every bucket has one, if empty."""
    return read_array(path, CONTEXT if dtype == "context" else np.dtype(dtype))


#: Files that a worker keeps, mapped (a process may have 65,530 maps) or in memory.
mapped, loaded = lru_cache(maxsize=32768 if sys.version_info >= (3, 13) else 512)(read), lru_cache(maxsize=512)(read)


class Model:
    """What a worker needs to know of the files; a few kilobytes."""

    def __init__(self, folder: str, buckets: int, sizes: list[int], tokens: int):
        self.folder, self.buckets, self.tokens = folder, buckets, tokens
        self.sizes = np.array(sizes, np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])
        self.words = int(self.offsets[-1])
        self.hot = np.zeros(0, np.int64)  # frequent contexts, rising
        self.hot_stats = np.zeros(0, CONTEXT)
        self.discounts = self.low_discounts = np.array([0.5, 1.0, 1.5])
        self.low_total, self.low_gamma = 0, 0.0
        self.order, self.contexts, self.pair_offsets = 2, "contexts", np.zeros(buckets + 1, np.int64)
        self.hot_pairs = np.zeros(0, np.int64)  # places of frequent bigrams, rising
        self.hot_pair_stats = np.zeros(0, CONTEXT)
        self.top_discounts = self.discounts

    def file(self, name: str, b: int, dtype: str) -> np.ndarray:
        return (mapped if self.folder.startswith(("file:", "/")) else loaded)(f"{self.folder}/{name}-{b}", dtype)

    def low(self, b: int) -> int:
        """The first rank dealt to a bucket."""
        return -(-b * self.words // self.buckets)

    def rank_bucket(self, ranks: np.ndarray) -> np.ndarray:
        return ranks.astype(np.int64) * self.buckets // max(1, self.words)

    def ranks(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words' ranks (UNKNOWN if never seen) and counts."""
        rank, count = np.full(len(hashed), UNKNOWN, np.int64), np.zeros(len(hashed), np.int64)
        for b, on in by_bucket(by_range(hashed, self.buckets)):
            if self.sizes[b]:
                known = self.file("words", b, "<u8")
                k = np.minimum(np.searchsorted(known, hashed[on]), len(known) - 1)
                ok = known[k] == hashed[on]
                rank[on[ok]] = self.offsets[b] + k[ok]
                count[on[ok]] = self.file("counts", b, "<u8")[k[ok]]
        return rank, count

    def pair_bucket(self, keys: np.ndarray) -> np.ndarray:
        context = (keys >> HALF).astype(np.int64)
        out = self.rank_bucket(np.minimum(context, max(0, self.words - 1)))
        k = np.minimum(np.searchsorted(self.hot, context), max(0, len(self.hot) - 1))
        hot = (context == START) | ((self.hot[k] == context) if len(self.hot) else False)
        out[hot] = by_range(mixed(keys[hot]), self.buckets)
        return out

    def by_rank(self, name: str, ranks: np.ndarray, dtype: str) -> np.ndarray:
        """Rows of dense files for known ranks."""
        out = np.zeros(len(ranks), CONTEXT if dtype == "context" else np.dtype(dtype))
        for b, on in by_bucket(self.rank_bucket(ranks)):
            out[on] = self.file(name, b, dtype)[ranks[on] - self.low(b)]
        return out

    def found(self, name: str, keys: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Places of keys in their buckets' sorted files; -1 if never seen."""
        out = np.full(len(keys), -1, np.int64)
        for b, on in by_bucket(bucket):
            if len(known := self.file(name, b, "<u8")):
                k = np.minimum(np.searchsorted(known, keys[on]), len(known) - 1)
                ok = known[k] == keys[on]
                out[on[ok]] = k[ok]
        return out

    def pairs(self, keys: np.ndarray) -> np.ndarray:
        """Places of distinct bigram keys in all files, one after another; -1 if never seen."""
        bucket = self.pair_bucket(keys)
        out = self.found("pairs", keys, bucket)
        return np.where(out < 0, -1, out + self.pair_offsets[bucket])

    def of_pairs(self, name: str, places: np.ndarray, dtype: str) -> np.ndarray:
        """What a file beside the bigrams' has for known ones; small counts if it has no type."""
        out = np.zeros(len(places), dtype or np.int64)
        for b, on in by_bucket(np.searchsorted(self.pair_offsets, places, side="right") - 1):
            at = places[on] - self.pair_offsets[b]
            out[on] = self.file(name, b, dtype)[at] if dtype else self.small(name, b, at)
        return out

    def small(self, name: str, b: int, at: np.ndarray) -> np.ndarray:
        """Counts that are kept in a byte, the few large ones apart."""
        out = self.file(name, b, "u1")[at].astype(np.int64)
        if (large := np.flatnonzero(out == 255)).size:
            out[large] = self.file(f"{name}_large", b, "<u8")[np.searchsorted(self.file(f"{name}_large_at", b, "<u8"), at[large])]
        return out

    def write_small(self, name: str, b: int, counts: np.ndarray) -> None:
        large = np.flatnonzero(counts >= 255)
        write_file(f"{self.folder}/{name}-{b}", [np.minimum(counts, 255).astype("u1").tobytes()])
        write_file(f"{self.folder}/{name}_large_at-{b}", [large.astype("<u8").tobytes()])
        write_file(f"{self.folder}/{name}_large-{b}", [counts[large].astype("<u8").tobytes()])

    def context_weights(self, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What discounts leave to the lower order behind each context, and how much follows it; 0 behind unknown ones."""
        stats = np.zeros(len(contexts), CONTEXT)
        k = np.minimum(np.searchsorted(self.hot, contexts), len(self.hot) - 1)
        hot = self.hot[k] == contexts
        stats[hot] = self.hot_stats[k[hot]]
        plain = ~hot & (contexts != START) & (contexts != UNKNOWN)
        stats[plain] = self.by_rank(self.contexts, contexts[plain], "context")
        return stats["n"].astype(float) @ self.discounts, stats["total"].astype(float)

    def pair_counts(self, places: np.ndarray) -> np.ndarray:
        """Bigrams' counts, at order 3 of the words before them; 0 at -1."""
        out, on = np.zeros(len(places), np.int64), np.flatnonzero(places >= 0)
        out[on] = self.of_pairs("pair_counts" if self.order == 2 else "pair_befores", places[on], "")
        return out

    def triple_bucket(self, keys: np.ndarray) -> np.ndarray:
        context = (keys >> HALF).astype(np.int64)
        out = np.searchsorted(self.pair_offsets, context, side="right") - 1
        if len(self.hot_pairs):
            hot = self.hot_pairs[np.minimum(np.searchsorted(self.hot_pairs, context), len(self.hot_pairs) - 1)] == context
            out[hot] = by_range(mixed(keys[hot]), self.buckets)
        return out

    def triples(self, keys: np.ndarray) -> np.ndarray:
        """Counts of distinct trigram keys."""
        bucket, out = self.triple_bucket(keys), np.zeros(len(keys), np.int64)
        at = self.found("triples", keys, bucket)
        known = np.flatnonzero(at >= 0)
        for b, on in by_bucket(bucket[known]):
            out[known[on]] = self.small("triple_counts", b, at[known[on]])
        return out

    def pair_stats(self, places: np.ndarray) -> np.ndarray:
        """What follows distinct known bigrams. After one that occurs once a single word does, so it is in no file."""
        out = np.zeros(len(places), CONTEXT)
        out["total"] = self.of_pairs("pair_counts", places, "")
        out["n"][:, 0] = 1
        hot = np.isin(places, self.hot_pairs)
        out[hot] = self.hot_pair_stats[np.searchsorted(self.hot_pairs, places[hot])]
        many = np.flatnonzero((out["total"] > 1) & ~hot)
        for b, on in by_bucket(np.searchsorted(self.pair_offsets, places[many], side="right") - 1):
            on = many[on]
            k = np.searchsorted(self.file("followed", b, "<u4"), places[on] - self.pair_offsets[b])
            out["n"][on] = self.file("followers", b, "<u4").reshape(-1, 3)[k]
        return out


def stats_of(context: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct contexts, rising as given, and their sums."""
    head = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.zeros(0, np.int64)
    stats = np.zeros(len(head), CONTEXT)
    if len(head):
        stats["total"] = np.add.reduceat(counts, head)
        for i in range(3):
            stats["n"][:, i] = np.add.reduceat((np.minimum(counts, 3) == i + 1).astype(np.int64), head)
    return context[head], stats


def train(docs: DataFrame, text: str = "text", order: int = 2) -> Model:
    """Count all of ``docs`` and write the model to the shared folder."""
    spark = docs.sparkSession
    bounded_batches(spark)
    folder, nb = scratch(spark, "model"), partitions(spark)
    docs = docs.select(F.col(text).alias("text"))

    # words
    def words_of(batches):
        held, n = [], 0
        for batch in slices(batches, 0):
            ids, _, hashed = batch_tokens(batch.column(0))
            held.append((hashed, np.bincount(ids, minlength=len(hashed))))
            n += len(hashed)
            if n > 1_200_000:
                held = [summed(*map(np.concatenate, zip(*held)))]
                n = len(held[0][0])
                if n > 600_000:
                    yield blocks_of(held)
                    held, n = [], 0
        if n:
            yield blocks_of(held)

    def blocks_of(held):
        keys, counts = summed(*map(np.concatenate, zip(*held)))
        return blocks(by_range(keys, nb), nb, keys, counts)

    def write_words(batches):
        def done(b, keys, counts):
            write_file(f"{folder}/words-{b}", [keys.astype("<u8").tobytes()])
            write_file(f"{folder}/counts-{b}", [counts.astype("<u8").tobytes()])
            often = np.flatnonzero(counts * 64 > counts.sum())
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([int(counts.sum())], pa.int64()), pa.array([often.tolist()], pa.list_(pa.int64())), pa.array([counts[often].tolist()], pa.list_(pa.int64()))], ["bucket", "n", "total", "often", "times"])

        yield from grouped(batches, done)

    rows = dealt(docs.mapInArrow(words_of, BLOCK), nb)
    found = {r.bucket: r for r in rows.mapInArrow(write_words, "bucket int, n long, total long, often array<long>, times array<long>").collect()}
    del rows
    settle(spark)
    model = Model(folder, nb, [found[b].n if b in found else 0 for b in range(nb)], sum(r.total for r in found.values()))
    if model.words > UNKNOWN - 1:
        raise ValueError("too many distinct words for 32-bit ranks")
    model.hot = np.array(sorted(int(model.offsets[b]) + i for b, r in found.items() for i, c in zip(r.often, r.times) if c * 2 * nb > model.tokens), np.int64)

    # bigrams
    def pairs_of(batches):
        held, n = [], 0
        for batch in slices(batches, 0):
            ids, sizes, hashed = batch_tokens(batch.column(0))
            rank = model.ranks(hashed)[0].astype(np.uint64)
            w = rank[ids]
            before = np.concatenate([[np.uint64(START)], w[:-1]])
            before[np.cumsum(sizes) - sizes] = START
            held.append((before << HALF) | w)
            n += len(w)
            if n > 3_000_000:
                yield pair_blocks(held)
                held, n = [], 0
        if n:
            yield pair_blocks(held)

    def pair_blocks(held):
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        return blocks(model.pair_bucket(keys), nb, keys, counts)

    def write_pairs(batches):
        def done(b, keys, counts):
            write_file(f"{folder}/pairs-{b}", [keys.astype("<u8").tobytes()])
            model.write_small("pair_counts", b, counts)
            of_counts = [int((counts == i).sum()) for i in (1, 2, 3, 4)]
            who, stats = stats_of((keys >> HALF).astype(np.int64), counts)
            hot = (who == START) | np.isin(who, model.hot)
            if order == 2:
                dense = np.zeros(model.low(b + 1) - model.low(b), CONTEXT)
                dense[who[~hot] - model.low(b)] = stats[~hot]
                write_file(f"{folder}/contexts-{b}", [dense.tobytes()])
            word, times = np.unique(keys & np.uint64(0xFFFFFFFF), return_counts=True)
            cont = blocks(model.rank_bucket(word), nb, word, times)
            nothing = [None] * cont.num_rows
            yield pa.RecordBatch.from_arrays([*cont.columns, pa.array(nothing, pa.list_(pa.int64())), pa.array(nothing, pa.int64()), pa.array(nothing, pa.list_(pa.int64()))], names)
            often = np.flatnonzero(counts * 2 * nb > model.tokens)  # at most 2 for each bucket
            some = [(None, None, None, of_counts, None, None), (None, None, None, None, None, [b, len(keys), *often.tolist()])] + [(None, None, None, None, int(c), [int(s["total"]), *map(int, s["n"])]) for c, s in zip(who[hot], stats[hot])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), (pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64())))], names)

        names = ["bucket", "keys", "counts", "of_counts", "context", "stats"]
        yield from grouped(batches, done)

    rows = dealt(docs.mapInArrow(pairs_of, BLOCK), nb)
    out = materialise(rows.mapInArrow(write_pairs, f"{BLOCK}, of_counts array<long>, context long, stats array<long>"), "pairs")
    n = out.where("of_counts is not null").agg(*(F.sum(F.col("of_counts")[i]) for i in range(4))).first()
    model.discounts = discounts(np.array([x or 0 for x in n]))
    hot = out.where("context is not null").groupBy("context").agg(*(F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(4))).orderBy("context").collect()
    model.hot = np.array([r.context for r in hot], np.int64)
    model.hot_stats = np.zeros(len(hot), CONTEXT)
    for i, r in enumerate(hot):
        model.hot_stats[i] = (r.s0, (r.s1, r.s2, r.s3))

    sizes = {r.stats[0]: r.stats[1:] for r in out.where("stats is not null and context is null").select("stats").collect()}
    model.pair_offsets = np.concatenate([[0], np.cumsum([sizes[b][0] if b in sizes else 0 for b in range(nb)])]).astype(np.int64)
    often = np.array(sorted(int(model.pair_offsets[b]) + i for b, x in sizes.items() for i in x[1:]), np.int64)

    # contexts of each word
    def write_continuations(batches):
        def done(b, keys, counts):
            dense = np.zeros(model.low(b + 1) - model.low(b), "<u4")
            dense[keys.astype(np.int64) - model.low(b)] = counts  # contexts are words, of which there are fewer than 2**32
            write_file(f"{folder}/continuations-{b}", [dense.tobytes()])
            n = [b, int(counts.sum()), *(int((counts == i).sum()) for i in (1, 2, 3, 4)), int((counts > 2).sum())]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in n], ["b", "total", "n1", "n2", "n3", "n4", "more"])

        yield from grouped(batches, done)

    rows = dealt(out.where("keys is not null").select("bucket", "keys", "counts"), nb)
    low = rows.mapInArrow(write_continuations, "b long, total long, n1 long, n2 long, n3 long, n4 long, more long").collect()  # a row for each bucket
    n = [sum(r[i] for r in low) for i in range(1, 7)]
    model.low_discounts, model.low_total = discounts(np.array(n[1:5])), n[0]
    discard(out)
    del rows, out
    settle(spark)
    model.low_gamma = float(model.low_discounts @ np.array([n[1], n[2], n[5]]))
    if order == 3:
        train_triples(docs, model, often)
    elif order != 2:
        raise ValueError("order is 2 or 3")
    return model


LEVELS = "level int, of_counts array<long>, context long, stats array<long>"


def level_rows(level: int, counts: np.ndarray, who: np.ndarray, stats: np.ndarray, blocks: pa.RecordBatch | None = None) -> pa.RecordBatch:
    """A bucket's counts of counts and its share of frequent contexts' sums, and blocks to be dealt further."""
    rows = [(level, [int((counts == i).sum()) for i in (1, 2, 3, 4)], None, None)]
    rows += [(level, None, int(c), [int(x["total"]), *map(int, x["n"])]) for c, x in zip(who, stats)]
    some = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64())))]
    if blocks is None:
        return pa.RecordBatch.from_arrays(some, ["level", "of_counts", "context", "stats"])
    more = [pa.concat_arrays([pa.nulls(len(rows), c.type), c]) for c in blocks.columns]
    some = [pa.concat_arrays([c, pa.nulls(blocks.num_rows, c.type)]) for c in some]
    return pa.RecordBatch.from_arrays([*more, *some], ["bucket", "keys", "counts", "level", "of_counts", "context", "stats"])


def train_triples(docs: DataFrame, model: Model, often: np.ndarray) -> None:
    """Count trigrams, and of each bigram the words before it."""
    nb, folder = model.buckets, model.folder
    if model.pair_offsets[-1] >= 1 << 32:
        raise ValueError("too many distinct bigrams for 32-bit places")
    model.hot_pairs = often

    def triples_of(batches):
        held, n = [], 0
        for batch in slices(batches, 0):
            ids, sizes, hashed = batch_tokens(batch.column(0))
            w = model.ranks(hashed)[0].astype(np.uint64)[ids]
            starts = np.cumsum(sizes) - sizes
            before = np.concatenate([[np.uint64(START)], w[:-1]])
            before[starts] = START
            keys, where = np.unique((before << HALF) | w, return_inverse=True)
            inner = np.ones(len(w), bool)
            inner[starts] = False
            inner = np.flatnonzero(inner)
            held.append((model.pairs(keys).astype(np.uint64)[where[inner - 1]] << HALF) | w[inner])
            n += len(inner)
            if n > 5_000_000:
                yield triple_blocks(held)
                held, n = [], 0
        if n:
            yield triple_blocks(held)

    def triple_blocks(held):
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        return blocks(model.triple_bucket(keys), nb, keys, counts)

    def write_triples(batches):
        def done(b, keys, counts):
            write_file(f"{folder}/triples-{b}", [keys.astype("<u8").tobytes()])
            model.write_small("triple_counts", b, counts)
            context = (keys >> HALF).astype(np.int64)
            who, stats = stats_of(context, counts)
            hot = np.isin(who, model.hot_pairs)
            many = ~hot & (stats["total"] > 1)
            write_file(f"{folder}/followed-{b}", [(who[many] - model.pair_offsets[b]).astype("<u4").tobytes()])
            write_file(f"{folder}/followers-{b}", [np.ascontiguousarray(stats["n"][many]).tobytes()])
            middle = model.of_pairs("pairs", context, "<u8") & np.uint64(0xFFFFFFFF)
            ends, times = np.unique((middle << HALF) | (keys & np.uint64(0xFFFFFFFF)), return_counts=True)
            yield level_rows(3, counts, who[hot], stats[hot], blocks(model.pair_bucket(ends), nb, ends, times))

        yield from grouped(batches, done)

    def write_befores(batches):
        def done(b, keys, counts):
            pairs = model.file("pairs", b, "<u8")
            context = (pairs >> HALF).astype(np.int64)
            n = np.where(context == START, model.small("pair_counts", b, np.arange(len(pairs))), 0)
            n[np.searchsorted(pairs, keys)] = counts
            model.write_small("pair_befores", b, n)
            who, stats = stats_of(context, n)
            hot = (who == START) | np.isin(who, model.hot)
            dense = np.zeros(model.low(b + 1) - model.low(b), CONTEXT)
            dense[who[~hot] - model.low(b)] = stats[~hot]
            write_file(f"{folder}/before_contexts-{b}", [dense.tobytes()])
            yield level_rows(2, n, who[hot], stats[hot])

        def rest():
            for batch in batches:
                passed = pa.compute.is_null(batch.column(0))
                if (own := batch.filter(passed)).num_rows:
                    sums.append(pa.RecordBatch.from_arrays(own.columns[3:], ["level", "of_counts", "context", "stats"]))
                yield batch.filter(pa.compute.invert(passed))

        sums = []
        yield from grouped(rest(), done)
        yield from sums

    rows = dealt(docs.mapInArrow(triples_of, BLOCK), nb)
    found = rows.mapInArrow(write_triples, f"{BLOCK}, {LEVELS}")
    rows = dealt(found, nb)
    out = materialise(rows.mapInArrow(write_befores, LEVELS), "levels")
    n = {r.level: [r[i] for i in range(1, 5)] for r in out.where("of_counts is not null").groupBy("level").agg(*(F.sum(F.col("of_counts")[i]) for i in range(4))).collect()}
    hot = out.where("context is not null").groupBy("level", "context").agg(*(F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(4))).orderBy("level", "context").collect()
    discard(out)
    ids, stats = {}, {}
    for level in (2, 3):
        own = [r for r in hot if r.level == level]
        ids[level] = np.array([r.context for r in own], np.int64)
        stats[level] = np.array([(r.s0, (r.s1, r.s2, r.s3)) for r in own], CONTEXT)
    model.order, model.contexts = 3, "before_contexts"
    model.discounts, model.top_discounts = (discounts(np.array(n.get(level, [0] * 4))) for level in (2, 3))
    model.hot, model.hot_stats, model.hot_pair_stats = ids[2], stats[2], np.zeros(len(often), CONTEXT)
    model.hot_pair_stats[np.searchsorted(often, ids[3])] = stats[3]


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, *keep): log10 probabilities of whole texts, by
    add-half unigrams and by the model. Perplexity is 10 ** (-score / n_tokens)."""
    others = [f"keep_{i}" for i in range(len(keep))]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *(F.col(c).alias(k) for c, k in zip(keep, others)))
    zero, one = F.lit(0).cast("long"), F.lit(0.0)
    schema = rows.select("doc_id", zero.alias("n_tokens"), zero.alias("n_known"), zero.alias("train_tokens"), one.alias("base_score"), one.alias("score"), *others).schema

    def work(batches):
        V, N, D = model.words, model.tokens, np.concatenate([[0.0], model.discounts])
        low_d, top = np.concatenate([[0.0], model.low_discounts]), np.concatenate([[0.0], model.top_discounts])
        for batch in slices(batches, 1):
            ids, sizes, hashed = batch_tokens(batch.column(1))
            rank, count = model.ranks(hashed)
            cc = np.zeros(len(rank), np.int64)
            known = rank != UNKNOWN
            if known.any():
                cc[known] = model.by_rank("continuations", rank[known], "<u4")
            total = max(1, model.low_total)
            low = (np.maximum(cc - low_d[np.minimum(cc, 3)], 0) + model.low_gamma / (V + 1)) / total if model.low_total else np.full(len(cc), 1 / (V + 1))
            base = np.log10((count + 0.5) / (N + 0.5 * (V + 1)))
            starts = np.cumsum(sizes) - sizes
            none = len(rank)  # the local number of what stands before a text
            before = np.concatenate([[none], ids[:-1]])
            before[starts] = none
            contexts = np.concatenate([rank, [START]])
            p = low[ids]
            if model.tokens:
                gamma, total = (x[before] for x in model.context_weights(contexts))
                # each distinct pair of neighbours is looked up once, by local numbers
                key, where = np.unique(before * (none + 1) + ids, return_inverse=True)
                first, then = contexts[key // (none + 1)], rank[key % (none + 1)]
                place, ok = np.full(len(key), -1, np.int64), np.flatnonzero((first != UNKNOWN) & (then != UNKNOWN))
                place[ok] = model.pairs((first[ok].astype(np.uint64) << HALF) | then[ok].astype(np.uint64))
                c = model.pair_counts(place)[where]
                has = total > 0
                p = np.where(has, (np.maximum(c - D[np.minimum(c, 3)], 0) + gamma * p) / np.where(has, total, 1), p)
                if model.order == 3:
                    two = np.concatenate([[0], where[:-1]])  # the pair of the two words before each
                    seen = place[two] >= 0
                    seen[starts] = False
                    seen = np.flatnonzero(seen)
                    two = two[seen]
                    some = np.zeros(len(key), bool)
                    some[two] = True
                    stats, some = np.zeros(len(key), CONTEXT), np.flatnonzero(some)
                    stats[some] = model.pair_stats(place[some])
                    triple, of = np.unique((place[two].astype(np.uint64) << HALF) | rank[ids[seen]].astype(np.uint64), return_inverse=True)
                    c = model.triples(triple)[of]
                    g = (stats["n"].astype(float) @ model.top_discounts)[two]
                    p[seen] = (np.maximum(c - top[np.minimum(c, 3)], 0) + g * p[seen]) / stats["total"].astype(float)[two]
            arrays = [pa.array(sizes), pa.array(np.add.reduceat((count[ids] > 0).astype(np.int64), starts)), pa.array(np.full(len(sizes), N, np.int64)), pa.array(np.add.reduceat(base[ids], starts)), pa.array(np.add.reduceat(np.log10(p), starts))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays, *batch.columns[2:]], schema.names)

    out = rows.mapInArrow(work, schema)
    return out.select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", *(F.col(k).alias(c) for k, c in zip(others, keep)))
