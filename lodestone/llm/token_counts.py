"""Token counts from an exact histogram of encoded lengths.

Documents are aggregated by encoded length; suffix sums over the histogram answer totals, quantiles and truncated
totals for every context limit, with no further pass over texts.

Nulls and empty texts have length 0 (plus the end token, if one is counted). Repeated rows count each time. An
empty table gives an empty histogram. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, slices
from .encode import default_path, encoder

#: Lengths in a block of the two-level suffix sums.
BLOCK = 256


def lengths(docs: DataFrame, tokenizer: str, text: str = "text", end_tokens: int = 0) -> DataFrame:
    """(n_tokens, n_docs) of each task's share: a partial histogram, made where the texts are."""

    def count(batches):
        enc, seen = encoder(tokenizer), Counter()
        for batch in slices(batches, 0, fresh=False):
            seen.update((enc.encode(batch.column(0), with_ids=False)[1] + end_tokens).tolist())
        yield pa.RecordBatch.from_pydict({"n_tokens": pa.array(list(seen), pa.int64()), "n_docs": pa.array(list(seen.values()), pa.int64())})

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(text).alias("text")).mapInArrow(count, "n_tokens long, n_docs long")


def histogram(docs: DataFrame, tokenizer: str | None = None, text: str = "text", end_tokens: int = 0) -> DataFrame:
    """(n_tokens, n_docs), a row for each length that occurs."""
    return lengths(docs, tokenizer or default_path(), text, end_tokens).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For every length L that occurs, with L as the context limit.

    docs_over, tokens_over: documents longer than L and their tokens; docs_to, tokens_to: the others;
    truncated_total: tokens left if each document is cut at L; share_to: docs_to by all documents.
    The sums run in blocks of lengths, so that no task gets the whole histogram. The histogram, which several steps
    read, is written first: texts are encoded once.
    """
    hist = materialise(hist.select("n_tokens", "n_docs"), "histogram")
    own = hist.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("n"), F.floor(F.col("n_tokens") / BLOCK).alias("block"))
    blocks = own.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("n").alias("block_n"))
    after = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)  # a row for each BLOCK of lengths
    every = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    zero = F.lit(0).cast("long")
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("block_docs").over(after), zero).alias("d0"),
        F.coalesce(F.sum("block_n").over(after), zero).alias("n0"),
        F.sum("block_docs").over(every).alias("total_docs"),
        F.sum("block_n").over(every).alias("total_n"),
    )
    inside = W.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, -1)
    out = own.join(blocks, "block").select(
        "n_tokens",
        "n_docs",
        (F.col("d0") + F.coalesce(F.sum("n_docs").over(inside), zero)).alias("docs_over"),
        (F.col("n0") + F.coalesce(F.sum("n").over(inside), zero)).alias("tokens_over"),
        "total_docs",
        "total_n",
    )
    return out.select(
        "n_tokens",
        "n_docs",
        "docs_over",
        "tokens_over",
        (F.col("total_docs") - F.col("docs_over")).alias("docs_to"),
        (F.col("total_n") - F.col("tokens_over")).alias("tokens_to"),
        (F.col("total_n") - F.col("tokens_over") + F.col("docs_over") * F.col("n_tokens")).alias("truncated_total"),
        ((F.col("total_docs") - F.col("docs_over")) / F.col("total_docs")).alias("share_to"),
    )


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """Tokens left if each document is cut at any limit, whether or not a document has that length."""
    at = sums.where(F.col("n_tokens") <= limit)
    return at.agg(F.max_by(F.struct("tokens_to", "docs_over"), "n_tokens").alias("s")).crossJoin(  # one row each
        sums.agg(F.sum("n_docs").alias("docs"))
    ).select(F.coalesce(F.col("s.tokens_to") + F.col("s.docs_over") * limit, F.col("docs") * limit, F.lit(0)).alias("truncated_total"))


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """The smallest length that at least a share q of the documents don't exceed."""
    return sums.where(F.col("share_to") >= q).agg(F.min("n_tokens").alias("n_tokens"))
