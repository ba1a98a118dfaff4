"""Quality rules as a short-circuit cascade.

A rule is a predicate on a document. Each rule's cost, beyond the counts that every document gets, and how often it
rejects are measured on a bounded random sample of the rows, and the cascade then runs the rules by rejections per second, falling; a document that a rule
rejects is not shown to the later ones. All rules must hold for a document to be kept, so the verdict doesn't
depend on the order, only the work does.

Toxic words are learned, not listed: words and beginnings of words that mark the toxic among labelled documents, in
any language. At most about ``LABELLED`` labelled rows are read, chosen by hash of the id; equal texts
count once. A rule rejects a document with ``HITS`` such words or more.

Null and empty texts have no words, and fail the base rule. Repeated rows are answered each time; null ids are
kept; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import time
import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, bounded_batches, numbered, slices

#: The symbols that are counted.
SYMBOLS = b"#*$%&|<>"
#: Labelled rows that are learned from; texts that a word must mark, and the share of its texts that must be toxic; hits.
LABELLED, SUPPORT, PRECISION, HITS = 10_000, 6, 0.9, 2
BEGINNINGS = range(4, 9)
LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class Doc:
    text: bytes
    words: list[bytes]
    n_words: int
    word_chars: int
    n_symbols: int
    n_lines: int
    n_dup_lines: int
    n_repeat_words: int


def repeat_words(words: list[bytes], window: int = 3) -> int:
    """Words in windows found twice or more, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    numbers = Words()
    ids = numbered(numbers, words)
    key = ids[:n]
    for k in range(1, window):
        if len(numbers) > 1 << 21:  # keys stay exact, however many distinct words
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            key = key << 32 | ids[k : k + n]
        else:
            key = key << 21 | ids[k : k + n]
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    many = np.zeros(n, bool)
    many[order[1:][same]] = True
    many[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for k in range(window):
        covered[k : k + n] |= many
    return int(covered.sum())


def document(text: bytes) -> Doc:
    words = text.split()
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    chars = sum(len(w.decode()) for w in words) if not text.isascii() else sum(map(len, words))
    return Doc(text, words, len(words), chars, sum(map(text.count, (bytes([c]) for c in SYMBOLS))), len(lines), len(lines) - len(set(lines)), repeat_words(words))


def base_failed(d: Doc) -> bool:
    return d.n_words < 50 or 100 * d.n_repeat_words > 50 * d.n_words


def letter_share(d: Doc) -> bool:
    """Under 80 % of the words have a letter."""
    return sum(1 for w in d.words if any(map(str.isalpha, w.decode()))) < 0.8 * d.n_words


def shouting(d: Doc) -> bool:
    text = d.text.decode()
    up = sum(map(str.isupper, text))
    return up > 0.5 * max(1, up + sum(map(str.islower, text)))


#: name -> does the document fail? The numbers are parameters of the rules.
RULES: dict[str, Callable[[Doc], bool]] = {
    "symbols": lambda d: d.n_symbols > 0.1 * d.n_words,
    "word_length": lambda d: not 2 <= d.word_chars / max(1, d.n_words) <= 15,
    "repeated_lines": lambda d: d.n_dup_lines >= 3 and d.n_dup_lines > 0.3 * d.n_lines,
    "letters": letter_share,
    "shouting": shouting,
    "compressible": lambda d: len(zlib.compress(d.text, 1)) < 0.1 * len(d.text),
}


def marks(word: str):
    """What may mark a word: its beginnings, and itself after an equals sign."""
    yield "=" + word
    for k in BEGINNINGS:
        if len(word) >= k:
            yield word[:k]


def toxic_marks(docs: DataFrame, labels: DataFrame, rows: int = LABELLED, support: int = SUPPORT, precision: float = PRECISION, doc_id: str = "doc_id", text: str = "text") -> frozenset[str]:
    """Marks of words that stand in ``support`` toxic texts or more and, of the texts they stand in, mostly in toxic ones."""

    def work(batches):
        for batch in slices(batches, 0):
            toxic, clean = Counter(), Counter()
            for t, bad in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (toxic if bad else clean).update({m for w in set(LETTERS.findall(t.lower())) for m in marks(w)})
            every = list(toxic.keys() | clean.keys())
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([toxic[m] for m in every], pa.int64()), pa.array([clean[m] for m in every], pa.int64())], ["mark", "toxic", "clean"])

    bounded_batches(docs.sparkSession)
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    if n > rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(np.ceil(1_000_003 * rows / n)))
    labelled = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null").join(F.broadcast(known), "doc_id")
    labelled = labelled.groupBy(F.sha2("text", 256)).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    found = labelled.select("text", (F.col("toxic") > 0).alias("toxic")).mapInArrow(work, "mark string, toxic long, clean long").groupBy("mark").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    return frozenset(r.mark for r in found.where((F.col("toxic") >= support) & (F.col("toxic") >= precision * (F.col("toxic") + F.col("clean")))).select("mark").collect())


class Marked(dict):
    """How many marked words a token holds; few tokens are looked at twice."""

    def __init__(self, known: frozenset[str]):
        super().__init__()
        self.known = known

    def __missing__(self, token: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[token] = n = sum(not self.known.isdisjoint(marks(w)) for w in LETTERS.findall(token.decode().lower()))
        return n

    def __reduce__(self):  # workers begin with nothing looked at
        return Marked, (self.known,)


def with_marks(known: frozenset[str], hits: int = HITS, rules: dict[str, Callable[[Doc], bool]] = RULES) -> dict[str, Callable[[Doc], bool]]:
    """The rules and one more: does a document hold ``hits`` marked words or more?"""
    seen = Marked(known)
    return rules | {"learned_toxic": lambda d: sum(map(seen.__getitem__, d.words)) >= hits} if known else rules


def measure(docs: DataFrame, rules: dict[str, Callable[[Doc], bool]] = RULES, sample_rows: int = 2000, text: str = "text") -> list[str]:
    """The rules' names by rejections per second, falling, as measured on about ``sample_rows`` rows."""

    def work(batches):
        cost, rejected = dict.fromkeys(rules, 0.0), dict.fromkeys(rules, 0)
        for batch in slices(batches, 0):
            for t in batch.column(0).fill_null("").to_pylist():
                d = document(t.encode())
                if base_failed(d):
                    continue
                for name, fails in rules.items():
                    began = time.perf_counter()
                    rejected[name] += fails(d)
                    cost[name] += time.perf_counter() - began
        yield pa.RecordBatch.from_pydict({"rule": list(rules), "cost": [cost[r] for r in rules], "rejected": pa.array([rejected[r] for r in rules], pa.int64())})

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(text).alias("text"))
    n = rows.count()
    if n > sample_rows:
        rows = rows.where(F.rand(7) < sample_rows / n)  # row by row, so that a text that many rows have can't fill the sample
    seen = rows.mapInArrow(work, "rule string, cost double, rejected long").groupBy("rule").agg(F.sum("cost").alias("cost"), F.sum("rejected").alias("rejected")).collect()
    rate = {r.rule: r.rejected / max(r.cost, 1e-9) for r in seen}
    return sorted(rules, key=lambda r: (-rate.get(r, 0.0), r))


def cascade(docs: DataFrame, order: list[str], rules: dict[str, Callable[[Doc], bool]] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rejected_by)."""

    def work(batches):
        for batch in slices(batches, 1):
            found = [document(t.encode()) for t in batch.column(1).fill_null("").to_pylist()]
            base = [base_failed(d) for d in found]
            by = ["base" if b else None for b in base]
            left = [i for i, b in enumerate(base) if not b]
            for name in order:
                fails = rules[name]
                out = [i for i in left if fails(found[i])]
                for i in out:
                    by[i] = name
                left = [i for i in left if by[i] is None]
            numbers = [pa.array([getattr(d, c) for d in found], pa.int64()) for c in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), *numbers, pa.array(base), pa.array([b is None for b in by]), pa.array(by, pa.string())], ["doc_id", *names, "base_failed", "kept", "rejected_by"])

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(work, "doc_id long, " + ", ".join(f"{c} long" for c in names) + ", base_failed boolean, kept boolean, rejected_by string")
