"""Vectors: normalising, exact cosine search, index statistics, a pluggable embedder."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS, BATCH = 1024, 50


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalise(v: Column) -> Column:
    """To length 1; a zero vector stays zero."""
    # the norm is bound by a lambda of its own: it is made once, not for each element
    return F.transform(F.array(F.sqrt(dot(v, v))), lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0))))[0]


def cosine(v: Column, query: list[float]) -> Column:
    """To 4 places; 0 with a zero vector."""
    q = np.asarray(query, float)
    q = F.array(*(F.lit(float(x)) for x in q / (np.linalg.norm(q) or 1)))
    return F.round(F.coalesce(F.try_divide(dot(v, q), F.sqrt(dot(v, v))), F.lit(0.0)), 4)


def top_k(vectors: DataFrame, query: list[float], k: int = 10, where: Column | None = None, after: bool = False) -> DataFrame:
    """The k nearest by cosine. ``where`` filters before the search, or, with ``after``, among the best 2k only."""
    rows = vectors if where is None or after else vectors.where(where)
    scored = rows.withColumn("score", cosine(F.col("embedding"), query)).drop("embedding")
    if where is not None and after:
        return scored.orderBy(F.desc("score"), "vec_id").limit(2 * k).where(where).orderBy(F.desc("score"), "vec_id").limit(k)
    return scored.orderBy(F.desc("score"), "vec_id").limit(k)


def index_counts(chunks: DataFrame, by: str) -> DataFrame:
    """(by, n): an index's chunks by type, language or another column."""
    return chunks.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def index_stats(chunks: DataFrame) -> DataFrame:
    counts = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("path").alias("files"))
    return counts.select("chunks", "files", F.round(F.try_divide("chunks", "files"), 4).alias("per_file"))


def lookup(index: DataFrame, ids: list, key: str = "id", position: str | None = None) -> DataFrame:
    """Rows of an index by id; of several with one id the last by ``position``, if that is given."""
    found = index.where(F.col(key).isin(ids))
    if position is None:
        return found
    rest = [c for c in index.columns if c != key]
    return found.groupBy(key).agg(F.max_by(F.struct(*rest), position).alias("r")).select(key, "r.*")


def append(index: DataFrame, new: DataFrame) -> DataFrame:
    """The index with new rows; ids that were there stay twice, and lookup says which counts."""
    return index.unionByName(new)


def hashed_embedding(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """The offline default: each word adds a signed hash coordinate."""
    out = np.zeros((len(texts), dimensions), np.float32)
    for i, t in enumerate(texts):
        for w in (t or "").lower().split():
            h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
            out[i, h % dimensions] += 1.0 if h >> 63 else -1.0
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=out, where=norm > 0)


def embed(chunks: DataFrame, provider: Callable[[list[str]], np.ndarray] = hashed_embedding, text: str = "content", batch: int = BATCH, retries: int = 3, pause: float = 0.1, usage: bool = False) -> DataFrame:
    """(id, embedding): batches of texts go to the provider, a call that fails up to ``retries`` times more with growing
    pauses, then the task's retries. With ``usage`` a column tokens, which sums to what the provider was given."""

    def asked(texts: list[str]) -> list:
        for n in range(retries + 1):
            try:
                found = list(provider(texts))
                break
            except Exception:
                if n == retries:
                    raise
                time.sleep(pause * 2**n)
        if len(found) != len(texts):
            raise ValueError(f"{len(texts)} texts, {len(found)} vectors")
        return found

    def work(batches: Iterator[pd.DataFrame]):
        for b in batches:
            for i in range(0, len(b), batch):
                part = b.iloc[i : i + batch]
                texts = part[text].fillna("").tolist()
                out = pd.DataFrame({"id": part.id, "embedding": asked(texts)})
                yield out.assign(tokens=[len(t) // 4 for t in texts]) if usage else out

    return chunks.select("id", text).mapInPandas(work, "id string, embedding array<float>" + (", tokens long" if usage else ""))
