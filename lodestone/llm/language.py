"""Language identification by error-correcting output codes.

Each language has a codeword of bits. For each bit a binary multinomial classifier over hashed byte n-grams
(2 to 4 bytes of the lower-cased letters, runs of anything else being one blank) tells the languages with the bit
set from the others. Its log-odds come from n-gram counts of each language over all training texts, summed in
Spark, where the log-odds are made too: only features x bits numbers go to the driver. Decoding takes the codeword of least loss, bits weighted
by how well each separates the language in training; near ties are flagged as ambiguous.

Null texts and texts without a letter are ``und`` with score 0, as is everything if nothing could be learned.
Training rows with a null text, null language or no letter are left out. Repeated rows count and are answered each
time. Null ids are kept. Other columns are not read. At most ``most`` languages are learned, else an error is raised.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, slices

ORDERS, FEATURES = (2, 3, 4), 1 << 16
SMOOTH = 0.1  # added to each count
OTHER = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> bytes:
    """The text's letters, lower case, as the classifiers see them; empty if it has none."""
    if not text or not any(map(str.isalpha, text)):
        return b""
    return b" " + OTHER.sub(" ", text.lower()).strip().encode() + b" "


def ngrams(texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order, a feature for each place of the joined texts (FEATURES where it would leave its text); and
    where each text begins."""
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    out, code = [], data
    with np.errstate(over="ignore"):
        for n in range(2, max(ORDERS) + 1):
            code = code[: len(data) - n + 1] * np.uint32(263) + data[n - 1 :]
            if n in ORDERS:
                feature = np.full(len(data), FEATURES, np.int32)
                feature[: len(code)] = ((code ^ np.uint32(n * 0x5BD1E995 & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)) >> np.uint32(16)
                for k in range(1, n):
                    feature[(ends - k)[ends >= k]] = FEATURES
                out.append(feature)
    return out, ends - sizes


def count(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, feature, n) over all rows with both."""

    def work(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in slices(batches, 0):
            rows = sorted((l, t) for l, t in zip(batch.column(1).to_pylist(), map(letters, batch.column(0).to_pylist())) if t)
            i = 0
            while i < len(rows):
                j = i
                while j < len(rows) and rows[j][0] == rows[i][0]:
                    j += 1
                own = totals.setdefault(rows[i][0], np.zeros(FEATURES + 1, np.int64))
                for feature in ngrams([t for _, t in rows[i:j]])[0]:
                    own += np.bincount(feature, minlength=FEATURES + 1)
                i = j
        for l, n in totals.items():
            on = np.flatnonzero(n[:FEATURES])
            for k in range(0, len(on), 10_000):
                part = on[k : k + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([l] * len(part)), pa.array(part.astype(np.int32)), pa.array(n[part])], ["lang", "feature", "n"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    return rows.mapInArrow(work, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1: every split of the languages if they are few, else the best of many random codes."""
    if n < 2:
        return np.zeros((n, 0))
    if n <= 6:
        return np.array([[1 if (2 * c + 1) >> i & 1 else -1 for c in range(2 ** (n - 1) - 1)] for i in range(n)], float)
    rng, width, best, least = np.random.default_rng(7), int(np.ceil(10 * np.log2(n))), None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, width))
        code = code[:, abs(code.sum(axis=0)) < n]
        distance = int(((code.shape[1] - code @ code.T) / 2 + np.eye(n) * 1e9).min())
        if distance > least:
            best, least = code, distance
    return best


def log_odds(share: np.ndarray, code: np.ndarray) -> np.ndarray:
    """(features, bits): how much a feature speaks for each bit; share: (languages, features)."""
    out = np.empty((share.shape[1], code.shape[1]))
    for b in range(code.shape[1]):
        on = code[:, b] > 0
        out[:, b] = np.log(share[on].mean(axis=0)) - np.log(share[~on].mean(axis=0))
    return out


class Classifiers:
    """weights: a row of log-odds for each feature, the last for no feature. speaks: of each language and bit, what its
    own n-grams say on average."""

    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, speaks: np.ndarray):
        self.languages, self.code, self.weights = languages, code, weights.astype(np.float32)
        bits = code.shape[1]
        sure = np.maximum(code * speaks, 1e-3) if bits else np.zeros((len(languages), 0))
        self.sure = sure / sure.sum(axis=1, keepdims=True) * bits if bits else sure

    def margins(self, texts: list[bytes]) -> np.ndarray:
        features, starts = ngrams(texts)
        total = np.zeros((len(texts), self.code.shape[1]))
        for f in features:
            for b in range(total.shape[1]):
                total[:, b] += np.add.reduceat(self.weights[:, b][f], starts, dtype=np.float64)
        return total / len(features)  # each place is seen once by each order

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest codeword's row, its share of all by loss, and the runner-up's share."""
        loss = np.stack([(self.sure[i] * np.logaddexp(0, -self.code[i] * margins)).sum(axis=1) for i in range(len(self.languages))], axis=1)
        near = np.exp(np.maximum(loss.min(axis=1, keepdims=True) - loss, -700))
        near /= near.sum(axis=1, keepdims=True)
        best = near.argmax(axis=1)
        top = near[np.arange(len(best)), best]
        near[np.arange(len(best)), best] = 0
        return best, top, near.max(axis=1)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = 1000) -> Classifiers:
    """The driver gets a total for each language, and a row of weights for each feature: at most FEATURES x bits numbers."""
    counts = materialise(count(docs, text, lang), "features")
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy("lang").limit(most + 1).collect()}
    if len(totals) > most:
        raise ValueError(f"more than {most} languages")
    languages, code = sorted(totals), codewords(len(totals))
    total = np.array([totals[x] + SMOOTH * FEATURES for x in languages])
    unseen = (SMOOTH / total)[:, None] if languages else np.zeros((0, 1))
    weights = np.zeros((FEATURES + 1, code.shape[1]))
    speaks = np.zeros(code.shape)
    if code.shape[1]:
        numbers = {x: i for i, x in enumerate(languages)}

        def work(batches):
            speaks = np.zeros(code.shape)
            for batch in batches:
                rows = batch.column(1).to_pylist()  # of one feature: a number for each language that has it
                share = np.repeat(unseen, len(rows), axis=1)
                for k, row in enumerate(rows):
                    for x in row:
                        share[numbers[x["lang"]], k] += x["n"] / total[numbers[x["lang"]]]
                found = log_odds(share, code)
                speaks += share @ found
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in found], pa.binary())], ["feature", "weights"])
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([speaks.tobytes()], pa.binary())], ["feature", "weights"])

        by_feature = counts.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("lang", "n"))).alias("rows"))
        weights[:FEATURES] = log_odds(unseen, code)
        seen = 0
        for r in by_feature.mapInArrow(work, "feature int, weights binary").toLocalIterator():
            if r.feature < 0:
                speaks += np.frombuffer(r.weights).reshape(code.shape)
            else:
                weights[r.feature] = np.frombuffer(r.weights)
                seen += 1
        speaks += (FEATURES - seen) * (unseen @ log_odds(unseen, code))
    return Classifiers(languages, code, weights, speaks)


def predict(docs: DataFrame, model: Classifiers, text: str = "text", keep: tuple[str, ...] = ("doc_id",), margin: float = 0.2) -> DataFrame:
    """(*keep, lang_pred, score, ambiguous): ambiguous if the runner-up comes within ``margin`` of the score."""
    names = [f"keep_{i}" for i in range(len(keep))]
    rows = docs.select(F.col(text).alias("text"), *(F.col(c).alias(k) for c, k in zip(keep, names)))
    schema = rows.select(*names, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous")).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)  # features x bits numbers, whatever the corpus

    def work(batches):
        model = shared.value
        for batch in slices(batches, 0, 1 << 20):
            texts = [letters(t) for t in batch.column(0).to_pylist()]
            pred, score, unsure = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            on = [i for i, t in enumerate(texts) if t]
            if on and model.languages:
                best, top, second = model.decode(model.margins([texts[i] for i in on]))
                for i, b in zip(on, best):
                    pred[i] = model.languages[b]
                score[on], unsure[on] = np.minimum(top, 1.0), top - second < margin
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(pred), pa.array(score), pa.array(unsure)], schema.names)

    bounded_batches(docs.sparkSession)
    out = rows.mapInArrow(work, schema)
    return out.select(*(F.col(k).alias(c) for k, c in zip(names, keep)), "lang_pred", "score", "ambiguous")
