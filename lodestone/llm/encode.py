"""Whole texts to token ids with the tokenizers library, remembering what each run of non-blanks gives.

No token spans a blank or a line feed in a tokenizer that drops white space, so a text's ids are those of its
runs, one after another. A batch's runs are found and told apart as arrays of bytes: runs with one hash are compared
byte by byte, so the hash only saves work. Each distinct run of a batch is looked up once, and encoded once while it is
remembered; a text's ids are then gathered from those of its runs. At most about ``limit`` runs are remembered, and
the batch's own. Tokenizers that keep white space get their texts whole.

Where the tokenizer takes letters and marks apart, lowers letters and marks word ends in its tokens, a run of
letters with closing marks is its lowered letters and its marks; new letters are then encoded many at a time,
their ids being parted after each word's end.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import KEPT, Words, mixed, numbered, powers, release

#: Closing marks that are one piece together, and the pieces of a pattern that takes letters and marks apart.
MARKS, LETTERS, REST = b".,!?;:|%$#&*", r"[\p{L}]+|", r"[^\s\p{L}\p{N}]+"
_BY_PATH: dict[tuple[str, int], Encoder] = {}
KEPT.append(_BY_PATH.clear)


def lowered(word: bytes) -> bytes | None:
    """Of letters of Latin-1, which stay single letters whatever their case; None of anything else."""
    text = word.decode()
    if not text.isalpha():
        return None
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return None
    return text.lower().encode()


class Encoder:
    def __init__(self, path: str, limit: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already use every core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_runs = drops_blanks(self.tokenizer)
        self.limit, self.known = limit, Known()
        self.ends = word_ends(self.tokenizer) if self.by_runs else None

    def encode(self, texts: pa.Array, with_ids: bool = True) -> tuple[np.ndarray | None, np.ndarray]:
        """All texts' ids, one after another, as unsigned 32-bit integers, and how many each text has. Nulls are empty."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = texts.fill_null("").cast(pa.large_string())
        if not self.by_runs:
            found = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.zeros(0, "<u4"), *found]), np.fromiter(map(len, found), np.int64, len(found))
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        raw = memoryview(raw)[offsets[0] : offsets[-1]] if raw is not None else b""
        data, offsets = np.frombuffer(raw, np.uint8), offsets - offsets[0]
        begins, ends, run, firsts = runs_of(data, offsets)
        names = [bytes(raw[i:j]) for i, j in zip(begins[firsts].tolist(), ends[firsts].tolist())]
        if len(self.known.number) > self.limit:
            self.known.forget(self.limit // 2)
        known = self.known.number
        if new := [x for x in names if x not in known]:
            self.learn(new)
        numbers = np.fromiter(map(known.__getitem__, names), np.int64, len(names))
        self.known.uses[numbers] += 1
        which = numbers[run]
        sizes = self.known.sizes[which]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        counts = np.diff(upto[np.searchsorted(begins, offsets)])
        if not with_ids:
            return None, counts
        return self.known.gather(which), counts

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        flat, counts = self.encode(pa.array(texts, pa.string()))
        data, ends = flat.astype("<u4").tobytes(), np.cumsum(counts) * 4
        return iter([data[i:j] for i, j in zip((ends - counts * 4).tolist(), ends.tolist())])

    def learn(self, runs: list[bytes]) -> None:
        """Remember new runs."""
        known, words, others, whole, lows, marks = self.known.number, {}, {}, [], [], []
        for r in runs:
            word = r.rstrip(MARKS) if self.ends is not None else b""
            low = word.lower() if word.isalpha() else lowered(word)  # of bytes: A-Z alone
            if low is None:
                others[r] = None
                continue
            if low not in known:
                words[low] = None
            if len(low) == len(r) and low == r:
                continue
            mark = r[len(word) :]
            if mark not in known:
                others[mark] = None
            whole.append(r), lows.append(low), marks.append(mark)
        words = [w for w in words if w not in known]
        for i in range(0, len(words), 500):
            self.learn_words(words[i : i + 500])
        others = [x for x in others if x not in known]
        if others:
            found = [e.ids for e in self.tokenizer.encode_batch_fast([x.decode() for x in others], add_special_tokens=False)]
            self.known.add(others, np.array([i for x in found for i in x], np.uint32), np.fromiter(map(len, found), np.int64, len(found)))
        if whole:
            self.known.add_joined(whole, *(np.fromiter(map(known.__getitem__, x), np.int64, len(x)) for x in (lows, marks)))

    def learn_words(self, words: list[bytes]) -> None:
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, np.uint32)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words):
            found = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
            ids, cuts = np.array([i for x in found for i in x], np.uint32), np.cumsum([len(x) for x in found])
        self.known.add(words, ids, np.diff(cuts, prepend=0))


class Known:
    """Runs by number, and the ids of each in one array that grows by doubling."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.at, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.uses = np.zeros(1 << 14, np.int32)  # batches that had the run, since it was last thinned out

    def add(self, runs: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        first, last = len(self.number), len(self.number) + len(runs)
        self.ids = grown(self.ids, self.used + len(ids))
        self.at, self.sizes, self.uses = grown(self.at, last), grown(self.sizes, last), grown(self.uses, last)
        self.ids[self.used : self.used + len(ids)] = ids
        self.at[first:last] = self.used + np.cumsum(sizes) - sizes
        self.sizes[first:last], self.uses[first:last] = sizes, 0
        self.used += len(ids)
        self.number.update(zip(runs, range(first, last)))

    def gather(self, numbers: np.ndarray) -> np.ndarray:
        sizes = self.sizes[numbers]
        place = np.repeat(self.at[numbers] - (np.cumsum(sizes) - sizes), sizes)
        place += np.arange(len(place))
        return self.ids[place]

    def add_joined(self, runs: list[bytes], first: np.ndarray, then: np.ndarray) -> None:
        """Runs that are two known ones."""
        self.add(runs, self.gather(np.stack([first, then], axis=1).reshape(-1)), self.sizes[first] + self.sizes[then])

    def forget(self, most: int) -> None:
        """Keep at most so many runs: those that most batches had."""
        n = len(self.number)
        kept = np.sort(np.argsort(-self.uses[:n], kind="stable")[:most])
        kept = kept[self.uses[kept] > 1]
        runs = list(self.number)
        runs, ids, sizes = [runs[i] for i in kept.tolist()], self.gather(kept), self.sizes[kept]
        self.__init__()
        self.add(runs, ids, sizes)


def grown(x: np.ndarray, least: int) -> np.ndarray:
    if least <= len(x):
        return x
    out = np.zeros(max(least, 2 * len(x)), x.dtype)
    out[: len(x)] = x
    return out


def runs_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes that are neither blank nor line feed and don't cross an offset: (begins, ends, which distinct run
    each is, where each distinct run comes first)."""
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = (data != 32) & (data != 10)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = np.flatnonzero(solid[1:] & (~solid[:-1] | edge))
    ends = np.flatnonzero(solid[:-1] & (~solid[1:] | edge))
    begins = begins[begins < len(data)]
    if not len(begins):
        return begins, ends, begins, begins
    up, down = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
        hashes = mixed((sums[ends] - sums[begins]) * down[begins])
    del sums
    _, firsts, run = np.unique(hashes, return_index=True, return_inverse=True)
    sizes = ends - begins
    like = firsts[run]  # compare each run with the first one of its hash
    if (sizes[like] == sizes).all():
        inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        if (data[inner + np.repeat(begins, sizes)] == data[inner + np.repeat(begins[like], sizes)]).all():
            return begins, ends, run, firsts
    numbers = Words()  # two runs have one hash
    raw = data.tobytes()
    run = numbered(numbers, [raw[i:j] for i, j in zip(begins.tolist(), ends.tolist())])
    return begins, ends, run, np.unique(run, return_index=True)[1]


def with_end(flat: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and counts of texts with an end id behind each text."""
    out = np.full(len(flat) + len(counts), end_id, "<u4")
    out[np.arange(len(flat)) + np.repeat(np.arange(len(counts)), counts)] = flat
    return out, counts + 1


def word_ends(tokenizer) -> np.ndarray | None:
    """Which ids end a word, if the tokenizer is of the kind that the module's text describes."""
    steps = json.loads(tokenizer.to_str())
    lowers = any(s.get("type") == "Lowercase" for s in (steps.get("normalizer") or {}).get("normalizers", []))
    suffix = steps["model"].get("end_of_word_suffix")
    pattern = json.dumps(steps.get("pre_tokenizer"))
    if not (lowers and suffix and json.dumps(LETTERS)[1:-1] in pattern and json.dumps(REST)[1:-1] in pattern):
        return None
    vocabulary = tokenizer.get_vocab()
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
    return ends


def drops_blanks(tokenizer) -> bool:
    """Is white space dropped before tokens are made, by a split that removes all but what it names?"""
    steps = json.loads(tokenizer.to_str()).get("pre_tokenizer") or {}
    steps = steps.get("pretokenizers", [steps])
    first = steps[0] if steps else {}
    return first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed" and not any(
        t["content"] != t["content"].strip() or " " in t["content"] for t in json.loads(tokenizer.to_str()).get("added_tokens", [])
    )


def encoder(path: str, limit: int = 600_000) -> Encoder:
    """One for each worker process; later tasks of the process go on with what it remembers, the first gives back what
    tasks of other kinds left."""
    key = (path, limit)
    if key not in _BY_PATH:
        release()
        _BY_PATH[key] = Encoder(path, limit)
    return _BY_PATH[key]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
