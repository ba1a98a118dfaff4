"""Building, checking and searching a vector index of a corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunks, search, vectors
from ..sources import store


def build(files: DataFrame, path: str, pattern: str | list[str] | None = None, force: bool = False, provider: Callable = vectors.hashed_embedding) -> dict:
    """Chunks, embeds and saves a corpus; an index that is there and not empty stays unless forced.

    Returns built (False if it stayed), the tokens that the provider was given, and the index's statistics. No chunks, and vectors that don't answer to the chunks
    one by one, are errors."""
    spark = files.sparkSession
    if not force and store.exists(spark, path) and spark.read.parquet(path).take(1):
        return {"built": False} | stats(spark, path)
    found = chunks.code_chunks(search.visible(files, pattern, glob=True))
    text = chunks.embed_text(*(F.col(c) for c in ("chunk_type", "name", "parent_name", "language", "path", "content", "parameters", "decorators")))
    rows = store.staged(found.withColumn("embedded", text), path)
    try:
        n = rows.count()
        if not n:
            raise ValueError("no chunks: check the pattern and the corpus")
        made = store.staged(vectors.embed(rows.dropDuplicates(["id"]), provider, "embedded", usage=True), f"{path.rstrip('/')}.vectors")
        tokens = made.agg(F.sum("tokens")).first()[0]
        made = made.select("id", vectors.normalise(F.col("embedding")).cast("array<float>").alias("embedding"))
        store.save_index(rows.drop("embedded").join(made, "id"), path)
    finally:
        store.unstage(spark, path)
        store.unstage(spark, f"{path.rstrip('/')}.vectors")
    if spark.read.parquet(path).count() != n:
        raise RuntimeError("chunks and vectors differ in number")
    return {"built": True, "tokens": tokens} | stats(spark, path)


def stats(spark: SparkSession, path: str) -> dict:
    """Chunks, files and chunks by file; chunks by type and by language; all empty if there is no index."""
    index = store.load_index(spark, path, store.INDEX)
    row = vectors.index_stats(index).first()
    by = {c: {r[0]: r.n for r in vectors.index_counts(index, c).collect()} for c in ("chunk_type", "language")}  # a few values each
    return {"chunks": row.chunks, "files": row.files, "per_file": row.per_file, "by_type": by["chunk_type"], "by_language": by["language"]}


def status(spark: SparkSession, path: str) -> dict:
    """Whether an index is there and how large it is."""
    there = store.exists(spark, path)
    return {"exists": there, "chunks": spark.read.parquet(path).count() if there else 0}


def find(spark: SparkSession, path: str, question: str, k: int = 10, where=None, provider: Callable = vectors.hashed_embedding) -> DataFrame:
    """The chunks nearest to a question, with a preview of 200 characters."""
    index = store.load_index(spark, path).withColumn("vec_id", F.col("id"))
    best = vectors.top_k(index, [float(x) for x in provider([question])[0]], k, where)
    return best.drop("vec_id").withColumn("preview", F.when(F.length("content") > 200, F.concat(F.substring("content", 1, 200), F.lit("..."))).otherwise(F.col("content")))
