"""From documents to packed sequences, in five stages.

Each stage works on all that its predecessor kept and is written as Parquet before the next one reads it. All but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, language, packing, repeats, simhash
from lodestone.llm.common import materialise, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Document ids that are broadcast; more are joined by shuffle.
MOST_IDS = 1_000_000


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; null texts, those without a letter, and near ties, go. Repeated rows go or
    stay together; null ids stay. If no row has a language nothing can be told, and all go. An empty table gives an empty one."""
    found = language.predict(docs, language.fit(docs), keep=COLUMNS).where("lang_pred <> 'und' and not ambiguous")
    return found.select(*COLUMNS)


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows whose id and text_key are not in ``gone``."""
    few = gone.limit(MOST_IDS + 1).count() <= MOST_IDS
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key"))
    alike = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("text_key") == F.col("gone_key"))
    return rows.join(F.broadcast(gone) if few else gone, alike, "left_anti")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of SimHash near-duplicates one document: the one with the least id (rows without an id come last),
    of these the one with the least fingerprint and hash of the text. Rows alike in id and text are one document.
    An empty table gives an empty one."""
    keyed = docs.select(*COLUMNS, F.xxhash64("text").alias("text_key"))
    found = simhash.near_duplicates(keyed, shingle=3, keep=("text_key",))
    each = materialise(found.groupBy("root", "doc_id", "fp", "text_key").agg(F.count(F.lit(1)).alias("n")), "documents_of_groups")
    name = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "fp", "text_key")
    kept = each.groupBy("root").agg(F.min(name).alias("f")).select(F.col("root").alias("of"), *(F.col(f"f.{c}").alias(f"kept_{c}") for c in ("doc_id", "fp", "text_key")))
    # joined by all that names a document, so that a large group is dealt like any other rows
    same = (F.col("root") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("kept_doc_id")) & (F.col("fp") == F.col("kept_fp")) & (F.col("text_key") == F.col("kept_text_key"))
    gone = materialise(each.join(kept, same, "left_anti").select("doc_id", "text_key"), "gone")
    left = without(keyed, gone)
    again = materialise(each.where("n > 1").select("doc_id", "text_key"), "again")
    if again.take(1):
        same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("text_key") == F.col("gone_key"))
        copies = left.join(again.select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")), same, "left_semi").dropDuplicates(["doc_id", "text_key"])
        left = without(left, again).unionByName(copies)
    return left.select(*COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 200 bytes that repeat; every document stays, if empty. What a cut leaves of a
    character goes with the cut. Null texts stay null with no length; rows alike in id and text repeat each other.
    An empty table gives an empty one."""
    found = repeats.remove_repeats(docs, keep=("lang", "source"))
    return found.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with a benchmark item. Null and empty texts share none; repeated rows go or
    stay together; rows with one id and different texts are told apart. An empty table on either side drops nothing."""
    keyed = docs.select(*COLUMNS, F.xxhash64("text").alias("text_key"))
    hits = materialise(decontaminate.overlaps(keyed, table(spark, sf_dir, "benchmark"), keep=("text_key",)).select("doc_id", "text_key").distinct(), "hits")
    return without(keyed, hits).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 2048 tokens, with its ids."""
    return packing.pack(docs, memory=150_000)  # workers also hold what the earlier stages left


#: 10, 5, 8, 1 and 6 of the operators.
STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each_group),
    ("repeated_strings", without_repeats),
    ("decontamination", not_in_benchmark),
    ("packing", packed),
]
#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
