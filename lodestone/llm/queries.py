"""One query for each operator, over its whole table, with the columns its contract names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_text, kneser_ney, language, packing, quality, records, repeats, simhash, token_counts
from .common import is_held_out, table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that overlap."""
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each encoded length, with suffix sums for it as the context limit."""
    return token_counts.suffix_sums(token_counts.histogram(table(spark, sf_dir, "documents"), end_tokens=1))


def op3_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = records.write_records(table(spark, sf_dir, "documents"))
    return records.read_records(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = html_text.extract(table(spark, sf_dir, "pages"))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op7_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality.with_marks(quality.toxic_marks(docs, table(spark, sf_dir, "labels")))
    found = quality.cascade(docs, quality.measure(docs, rules), rules)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x.e - x.s)
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(is_held_out("doc_id", 5), F.lit(False))
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held)
    model = kneser_ney.train(docs.where("not held_out"), order=3)
    found = kneser_ney.score(docs, model, keep=("held_out",))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(is_held_out("doc_id", 3), F.lit(False))
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held)
    model = language.fit(docs.where("not held_out"))
    return language.predict(docs, model, keep=("doc_id", "held_out")).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op7's cascade counts and its base rule, which SQL can express too."""
    found = quality.cascade(table(spark, sf_dir, "documents"), [], {})
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def unigram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9's counts and base score, learned from all documents, which SQL can express too."""
    docs = table(spark, sf_dir, "documents")
    found = kneser_ney.score(docs, kneser_ney.train(docs, order=2))
    return found.select("doc_id", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_WORD = "[^\\x20\\x09-\\x0D]"
_DOCS = f"d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents), w AS (SELECT r, doc_id, text, regexp_extract_all(text, '{_WORD}+') AS words FROM d)"
_COUNTS = (
    f"WITH {_DOCS}, grams AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),"
    " again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1),"
    " inside AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY r),"
    f" lines AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{_WORD}') GROUP BY r),"
    " found AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,"
    " CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(i.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN lines l USING (r) LEFT JOIN inside i USING (r))"
    " SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM found"
)
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SCORES = (
    f"WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_LOWER} AS text FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),"
    f" t AS (SELECT r, doc_id, unnest(list_append(regexp_extract_all(text, '{_WORD}+'), ' ')) AS token FROM d), c AS (SELECT token, count(*) AS c FROM t GROUP BY token), n AS (SELECT sum(c) AS n, count(*) AS v FROM c)"
    " SELECT any_value(doc_id) AS doc_id, count(*) AS n_tokens, count(*) AS n_known, CAST(any_value(n) AS BIGINT) AS train_tokens, round(sum(log10((c + 0.5::DOUBLE) / (n + 0.5::DOUBLE * (v + 1)))), 4) AS base_score FROM t JOIN c USING (token), n GROUP BY r"
)
QUERIES = {f.__name__: f for f in (op1_decontamination, op2_token_histogram, op3_binary_records, op4_html_text, op5_simhash, op6_packing, op7_quality_cascade, op8_repeated_strings, op9_kneser_ney, op10_language, pipeline, quality_counts, unigram_scores)}
#: SQL can express the counts of op7 and op9 alone; the tests hold the rest against brute force.
ORACLE_SQL: dict[str, str] = {"quality_counts": _COUNTS, "unigram_scores": _SCORES}
