"""The engine's queries over the driver's tables, and the same in DuckDB's SQL.

documents are files (path, content); embeddings are an index whose labels are chunk types; lineitem is a dependency
graph from suppliers to fifty groups of parts; pages' addresses are paths.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import chunks, graph, rank, search, symbols, vectors

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
QUESTION = "how to find the function of this class and test the with error"
TERMS = rank.analyse(QUESTION).keywords + rank.analyse(QUESTION).concepts


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(sql: str | Callable[[], str] | None = None):
    """Registers a query and its SQL; SQL that needs what is defined further down is a function."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def files(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("content"))


def mixed(spark, d):
    """Documents under names of which the policy shows some and others not, in several languages, some of tests."""
    docs, k = table(spark, d, "documents"), F.col("doc_id")
    suffix = F.element_at(F.array(*map(F.lit, SUFFIXES)), (k % len(SUFFIXES) + 1).cast("int"))
    folder = F.when(k % 11 == 0, "node_modules/").otherwise("")
    return docs.select(F.concat(folder, "source", F.lit("/"), "lang", F.lit("/doc_"), k.cast("string"), suffix).alias("path"), F.col("text").alias("content"))


def urls(spark, d):
    return table(spark, d, "pages").select(F.regexp_replace("url", "^https?://", "").alias("path"), F.col("html").alias("content"))


def edges(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 50).alias("dst"), F.col("l_returnflag").alias("kind"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return e.withColumn("weight", F.when(F.col("kind") == "A", 2.0).when(F.col("kind") == "R", 3.0).otherwise(1.0))


def summed(spark, d):
    return edges(spark, d).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


FILES = "files AS (SELECT source || '/' || lang || '/doc_' || doc_id || '.txt' AS path, text AS content FROM documents)"
SUFFIXES = (".py", ".js", ".exe", "_test.py", ".txt", ".java")
MIXED = f"files AS (SELECT CASE WHEN doc_id % 11 = 0 THEN 'node_modules/' ELSE '' END || source || '/' || lang || '/doc_' || doc_id || {list(SUFFIXES)!r}[doc_id % {len(SUFFIXES)} + 1] AS path, text AS content FROM documents)"
SHOWN = "NOT starts_with(path, 'node_modules/') AND NOT path LIKE '%.exe'"
_SPLIT = ", lines AS (SELECT path, CAST(unnest(range(1, len(l) + 1)) AS INTEGER) AS line, unnest(l) AS text FROM (SELECT path, string_split(content, chr(10)) AS l FROM files))"
MIXED_LINES = MIXED + _SPLIT
LINES = FILES + ", lines AS (SELECT path, CAST(unnest(range(1, len(l) + 1)) AS INTEGER) AS line, unnest(l) AS text FROM (SELECT path, string_split(content, chr(10)) AS l FROM files))"
URLS = "files AS (SELECT regexp_replace(url, '^https?://', '') AS path, html AS content FROM pages)"
EDGES = "edges AS (SELECT l_suppkey AS src, l_partkey % 50 AS dst, l_returnflag AS kind, l_orderkey * 10 + l_linenumber AS pos, CASE l_returnflag WHEN 'A' THEN 2.0::DOUBLE WHEN 'R' THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM lineitem)"
SUMMED = EDGES + ", summed AS MATERIALIZED (SELECT src, dst, sum(weight) AS weight FROM edges GROUP BY ALL)"
STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
SUFFIX = "regexp_extract({0}, '[^/](\\.[^./]+)$', 1)"


# scans and search


@query(f"WITH {FILES} SELECT path FROM files")
def list_files(spark, d):
    return search.list_files(files(spark, d))


@query(f"WITH {FILES} SELECT path FROM files WHERE path LIKE 'src1/en/%' AND strpos(substr(path, 9), '/') = 0")
def list_files_flat(spark, d):
    return search.list_files(files(spark, d), "src1/en", recursive=False)


@query(f"WITH {MIXED} SELECT path FROM files WHERE {SHOWN} AND regexp_matches(path, '^.*src1.*/doc_.[0-5][._].*$')")
def find_files_fnmatch(spark, d):
    return search.find_files(mixed(spark, d), "*src1*/doc_?[0-5][._]*")


@query(f"WITH {MIXED} SELECT path FROM files WHERE {SHOWN} AND regexp_matches(path, '^src1[^/]*/(?:[^/]+/)*doc_[^/]*7[^/]*$')")
def find_files_glob(spark, d):
    return search.find_files(mixed(spark, d), "src1*/**/doc_*7*", glob=True)


@query(f"WITH {MIXED} SELECT path FROM files WHERE {SHOWN} AND (path LIKE '%.py' OR regexp_matches(path, '/en/doc_[^/]*7[^/]*$'))")
def find_files_any(spark, d):
    return search.find_files(mixed(spark, d), ["**/*.py", "**/en/doc_*7*"], glob=True)


@query(f"WITH {MIXED} SELECT path, true AS truncated FROM files WHERE {SHOWN} AND path LIKE '%.py' ORDER BY path LIMIT 7")
def find_files_limit(spark, d):
    return search.find_files(mixed(spark, d), "*.py", limit=7, flag=True)


@query(f"WITH {MIXED} SELECT path FROM files WHERE lower({SUFFIX.format('path')}) IN ({', '.join(repr(s) for s in paths.ALLOWED)}) AND NOT list_has_any(string_split(path, '/'), {paths.FORBIDDEN!r})")
def policy_filter(spark, d):
    return mixed(spark, d).where(paths.allowed(F.col("path"))).select("path")


@query(f"WITH {URLS} SELECT path, lower(regexp_extract(path, '[^/]*$')) IN ({', '.join(map(repr, paths.TEXT_NAMES))}) AS is_text FROM (SELECT path FROM files UNION ALL SELECT path || '/README' FROM files)")
def text_file_names(spark, d):
    u = urls(spark, d).select("path")
    both = u.unionByName(u.select(F.concat("path", F.lit("/README")).alias("path")))
    return both.select("path", paths.text_name(F.col("path")).alias("is_text"))


@query(f"WITH {LINES} SELECT path, line FROM lines WHERE length({STRIP.format('text')}) >= 50")
def min_length_filter(spark, d):
    return search.explode_lines(files(spark, d), False).where(F.length(text.strip(F.col("text"))) >= chunks.LEAST_CHARS).select("path", "line")


@query(f"WITH {URLS} SELECT path, {SUFFIX.format('path')} AS suffix, regexp_extract(path, '[^/]*$') AS name FROM files")
def path_suffix(spark, d):
    return urls(spark, d).select("path", paths.suffix(F.col("path")).alias("suffix"), paths.basename(F.col("path")).alias("name"))


@query(f"WITH {MIXED} SELECT path, CASE WHEN path LIKE '%test%' OR path LIKE '%spec%' THEN 'test' ELSE 'implementation' END AS category FROM files")
def category_filter(spark, d):
    return mixed(spark, d).select("path", paths.category(F.col("path")).alias("category"))


@query(f"WITH {FILES} SELECT path, CASE WHEN len(l) >= 4 THEN array_to_string(l[4:6], chr(10)) END AS content, CASE WHEN len(l) < 4 THEN 'start is beyond the end of the file' END AS error FROM (SELECT path, string_split(content, chr(10)) AS l FROM files)")
def read_line_range(spark, d):
    return search.read_lines(files(spark, d), 4, 6)


@query(f"WITH {FILES} SELECT path, CAST(CASE WHEN len(l) > 20 THEN 5 ELSE len(l) END AS BIGINT) AS shown, len(l) > 20 AS truncated FROM (SELECT path, string_split(content, chr(10)) AS l FROM files)")
def view_file_capped(spark, d):
    return search.view_file(files(spark, d), 20, 5).select("path", F.size("lines").cast("long").alias("shown"), "truncated")


@query(f"WITH {FILES} SELECT path, CASE WHEN len(l) >= 3 THEN 3 END AS start_line, CASE WHEN len(l) >= 3 THEN least(len(l), 9) END AS end_line, CASE WHEN len(l) >= 3 THEN array_to_string(l[3:9], chr(10)) END AS content FROM (SELECT path, string_split(content, chr(10)) AS l FROM files)")
def view_range(spark, d):
    out = search.view_range(files(spark, d), 3, 9).select("path", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "content")
    return out


@query(f"WITH {FILES} SELECT path, CAST(strlen(content) AS BIGINT) AS bytes FROM files WHERE strlen(content) > 2000")
def too_large(spark, d):
    return search.too_large(files(spark, d), 2000)


_LANGUAGE = "CASE regexp_extract(path, '[.]([a-z]+)$', 1) WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'java' THEN 'java' ELSE 'unknown' END"


@query(f"WITH {MIXED} SELECT path, {_LANGUAGE} AS language, CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.java' THEN 'java' END AS configured FROM files")
def detect_language(spark, d):
    return mixed(spark, d).select("path", paths.language(F.col("path"), F.col("content")).alias("language"), paths.config_language(F.col("path")).alias("configured"))


@query(f"WITH {MIXED} SELECT language FROM (SELECT {_LANGUAGE} AS language, count(*) AS n FROM files WHERE path NOT LIKE '%.py' GROUP BY ALL) WHERE language <> 'unknown' ORDER BY n DESC, language DESC LIMIT 1")
def primary_language(spark, d):
    return search.primary_language(mixed(spark, d).where(~F.col("path").endswith(".py")))


@query(f"WITH {MIXED} SELECT count(*) AS files, count(*) FILTER ({SHOWN}) AS shown, CAST(sum(strlen(content)) AS BIGINT) AS bytes, count(DISTINCT nullif({_LANGUAGE}, 'unknown')) AS languages, false AS is_git_repo FROM files")
def workspace_info(spark, d):
    return search.workspace_info(mixed(spark, d))


@query(
    f"WITH {MIXED}, tests AS (SELECT string_agg(path, ',' ORDER BY path) AS t FROM (SELECT path FROM files WHERE path LIKE '%_test.py' ORDER BY path LIMIT 10))"
    " SELECT 'pytest' AS framework, 'setup.cfg' AS config_files, t AS test_files, NULL AS command FROM tests"
    " UNION ALL SELECT 'jest', 'jest.config.js', '', 'jest --ci' UNION ALL SELECT 'mocha', '', '', 'jest --ci'"
    " UNION ALL SELECT 'gradle', 'build.gradle.kts', '', './gradlew test'"
)
def detect_test_frameworks(spark, d):
    root = [("package.json", '{"scripts": {"test": "jest --ci"}, "dependencies": {"mocha": "^9"}}'), ("setup.cfg", ""), ("jest.config.js", ""), ("build.gradle.kts", ""), ("sub/manage.py", ""), ("sub/pom.xml", "")]
    found = search.test_frameworks(mixed(spark, d).unionByName(spark.createDataFrame(root, "path string, content string")))
    return found.select("framework", F.array_join("config_files", ",").alias("config_files"), F.array_join("test_files", ",").alias("test_files"), "command")


@query(f"WITH {LINES} SELECT path, line, text FROM lines")
def explode_lines(spark, d):
    return search.explode_lines(files(spark, d))


@query(f"WITH {MIXED_LINES} SELECT path, line, {STRIP.format('text')} AS content FROM lines WHERE {SHOWN} AND regexp_matches(text, '(?i)license|idiot')")
def grep(spark, d):
    return search.grep(mixed(spark, d), "license|idiot")


@query(f"WITH {MIXED_LINES} SELECT path, line, {STRIP.format('text')} AS content FROM lines WHERE {SHOWN} AND regexp_matches(text, '(?i)\\bof\\s+the\\b') AND path LIKE '%/doc_%1%'")
def grep_file_pattern(spark, d):
    return search.grep(mixed(spark, d), r"\bof\s+the\b", "doc_*1*")


@query(f"WITH {MIXED_LINES} SELECT path, line, {STRIP.format('text')} AS content, true AS truncated FROM lines WHERE {SHOWN} AND regexp_matches(text, '(?i)the') ORDER BY path, line LIMIT 100")
def grep_limit(spark, d):
    return search.grep(mixed(spark, d), "the", limit=100, flag=True)


@query(f"WITH {MIXED_LINES} SELECT path, count(*) AS n FROM lines WHERE {SHOWN} AND regexp_matches(text, '(?i)the') GROUP BY path")
def grep_count_by_file(spark, d):
    return search.grep(mixed(spark, d), "the").groupBy("path").agg(F.count(F.lit(1)).alias("n"))


# DuckDB's \\b knows ASCII alone: separators are doubled, and a word stands between two, or at an end.
_WORD = "[^\\pL\\pM\\p{Nd}\\p{Nl}\\p{Pc}]"



def _count(keyword: str) -> str:
    """How often a word stands in a line of text, as SQL; lines without it are told apart by a plain search."""
    found = f"len(regexp_extract_all(regexp_replace(text, '({_WORD})', '\\1\\1', 'g'), '(?i)(?:^|{_WORD}){keyword}(?:$|{_WORD})'))"
    return f"CAST(CASE WHEN contains(lower(text), '{keyword}') THEN {found} ELSE 0 END AS BIGINT)"


@query(f"WITH {LINES} SELECT * FROM (SELECT path, 'with' AS keyword, line, {_count('with')} AS n FROM lines UNION ALL SELECT path, 'from', line, {_count('from')} FROM lines) WHERE n > 0")
def keyword_occurrences(spark, d):
    return search.keyword_occurrences(files(spark, d), ["with", "from"]).select("path", "keyword", "line", "n")


# text


@query(f"WITH {FILES} SELECT path, md5(replace(content, 'the', '<the>')) AS digest FROM files WHERE contains(content, 'the')")
def string_replace_all(spark, d):
    out = files(spark, d).select("path", text.replace_nth(F.col("content"), "the", "<the>", 0).alias("c")).where("c is not null")
    return out.select("path", F.md5(F.col("c").cast("binary")).alias("digest"))


@query(f"WITH {FILES} SELECT path, md5(array_to_string(p[1:2], 'the') || 'THE' || array_to_string(p[3:], 'the')) AS digest FROM (SELECT path, string_split(content, 'the') AS p FROM files) WHERE len(p) > 2")
def string_replace_nth(spark, d):
    out = files(spark, d).select("path", text.replace_nth(F.col("content"), "the", "THE", 2).alias("c")).where("c is not null")
    return out.select("path", F.md5(F.col("c").cast("binary")).alias("digest"))


@query(f"WITH {FILES} SELECT path, CAST((length(content) - length(replace(content, 'an', ''))) / 2 AS BIGINT) AS n FROM files")
def string_count(spark, d):
    return files(spark, d).select("path", text.occurrences(F.col("content"), "an").alias("n"))


@query(f"WITH {FILES} SELECT path, CAST(len(string_split(content, chr(10))) AS BIGINT) AS n_lines, CAST(strlen(content) AS BIGINT) AS n_bytes FROM files")
def content_stats(spark, d):
    c = F.col("content")
    return files(spark, d).select("path", F.size(text.lines(c)).cast("long").alias("n_lines"), F.octet_length(c).cast("long").alias("n_bytes"))


@query("SELECT conv_id, turn, regexp_extract('```json' || chr(10) || text || chr(10) || '```', '(?s)```json\\n(.*?)\\n```', 1) AS block FROM conversations")
def extract_fenced_block(spark, d):
    c = table(spark, d, "conversations")
    made = F.concat(F.lit("<think>"), "role", F.lit("</think>```json\n"), "text", F.lit("\n```"))
    return c.select("conv_id", "turn", text.fenced(text.without_thoughts(made), "json").alias("block"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 <> 0 THEN '{\"turn\": ' || turn || '}' END AS module_groups, '@startuml' || chr(10) || role AS plantuml_diagram, CASE WHEN turn % 3 <> 0 THEN turn END AS parsed FROM conversations")
def parse_llm_output(spark, d):
    block = F.concat(F.lit('```json\n{"turn": '), F.when(F.col("turn") % 3 != 0, F.col("turn").cast("string")).otherwise("?"), F.lit("}\n```"))
    made = F.concat(F.lit("so:\n"), block, F.lit("\n```plantuml\n@startuml\n"), "role", F.lit("\n```"))
    c = table(spark, d, "conversations").select("conv_id", "turn", text.llm_output(made).alias("o"), text.unfenced_json(block, "turn long").alias("p"))
    return c.select("conv_id", "turn", "o.*", F.col("p.turn").alias("parsed"))


@query("SELECT conv_id, turn, text || '!' AS text FROM conversations")
def strip_think(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", text.without_thoughts(F.concat("text", F.lit("<think>a\nb</think>!"))).alias("text"))


@query("SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k FROM events")
def json_field(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT * FROM (VALUES ('pytest', 7, 5, 2, 0, 0, '1.20'), ('pytest', 4, 4, 0, 0, 0, '0.50'), ('jest', 9, 6, 3, 0, 0, NULL), ('maven', 10, 6, 3, 1, 0, NULL), ('django', 8, 8, 0, 0, 0, NULL), ('django', 0, 0, 2, 0, 1, NULL)) t(framework, total, passed, failed, skipped, errors, duration)")
def parse_test_summary(spark, d):
    logs = [("pytest", "== 2 failed, 5 passed in 1.20s =="), ("pytest", "=== 4 passed in 0.50s ==="), ("jest", "Tests: 3 failed, 6 passed, 9 total"), ("maven", "Tests run: 10, Failures: 2, Errors: 1, Skipped: 1"), ("django", "Ran 8 tests in 1s\n\nOK"), ("django", "FAILED (failures=2, errors=1)")]
    return spark.createDataFrame(logs, "framework string, log string").select("framework", text.test_summary(F.col("framework"), F.col("log")).alias("s")).select("framework", "s.*")


# ranked retrieval


@query("SELECT 'find_function' AS intent, 'error test' AS concepts, 'class error find function test this' AS keywords")
def query_analysis(spark, d):
    q = rank.analyse(QUESTION)
    return spark.createDataFrame([(q.intent, " ".join(q.concepts), " ".join(q.keywords))], "intent string, concepts string, keywords string")


_STARTS = lambda patterns: "regexp_matches(s, '^(?:" + "|".join(patterns).replace("'", "''") + ")')"
KIND = (
    f"CASE WHEN {_STARTS(rank.FUNCTION)} THEN 'function_definition' WHEN {_STARTS(rank.CLASS)} THEN 'class_definition' WHEN {_STARTS(rank.IMPORT)} THEN 'import_statement' WHEN {_STARTS(rank.COMMENT)} THEN 'documentation'"
    f" WHEN contains(s, '=') AND NOT regexp_matches(s, '^(?:if|while|for|elif|else)') AND {_STARTS(rank.ASSIGNMENT)} THEN 'variable_assignment' WHEN regexp_matches(lower(text), '{{words}}') THEN 'test_code' ELSE 'general_code' END"
)
KIND, SCORED_KIND = KIND.replace("{words}", "test|assert|expect"), KIND.replace("{words}", "test|assert|expect|mock")
_SCORE = lambda *v: "CASE match_type " + " ".join(f"WHEN '{k}' THEN {x}::DOUBLE" for k, x in zip(rank.CONTEXT, v)) + " ELSE 1.0::DOUBLE END"
CODE_FILES = "files AS (SELECT source || '/' || lang || '/doc_' || doc_id || '.txt' AS path, text AS content FROM documents UNION ALL SELECT path, {python} FROM part_)"


def with_code(spark, d):
    """Documents, and the Python files made from part: lines of every kind."""
    return files(spark, d).unionByName(code(spark, d))


@query(lambda: f"WITH {CODE}, {CODE_FILES.format(python=_PYTHON)}{_SPLIT}, kinds AS (SELECT path, line, {KIND} AS match_type FROM (SELECT path, line, text, {STRIP.format('text')} AS s FROM lines)) SELECT * FROM kinds")
def line_classify(spark, d):
    return search.explode_lines(with_code(spark, d), False).select("path", "line", rank.kind_of(F.col("text")).alias("match_type"))


@query(lambda: f"WITH {CODE}, {CODE_FILES.format(python=_PYTHON)}{_SPLIT}, kinds AS (SELECT path, line, {SCORED_KIND} AS match_type, {KIND} AS plain FROM (SELECT path, line, text, {STRIP.format('text')} AS s FROM lines)) SELECT path, line, {_SCORE(3.5, 2.2, 1.8, 1.8, 1.5, 1.8)} AS score, CASE WHEN plain IN ('function_definition', 'general_code') THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS relevance FROM kinds")
def context_score(spark, d):
    line = F.col("text")
    return search.explode_lines(with_code(spark, d), False).select("path", "line", rank.context_score(line, "find_function").alias("score"), rank.context_relevance(line, "find_function").alias("relevance"))


_CONCEPTS = "CASE WHEN contains(lower(content), 'error') THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN contains(lower(content), 'test') THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END"
_OWN = "CASE WHEN regexp_matches(path, '[.](py|js|java)$') THEN 1.5::DOUBLE ELSE 0.0::DOUBLE END"


@query(f"WITH {MIXED} SELECT path, {_CONCEPTS} AS concepts, {_OWN} AS own FROM files")
def concept_and_file_bonus(spark, d):
    return mixed(spark, d).select("path", rank.concept_bonus(F.col("content"), ["error", "test"]).alias("concepts"), rank.file_bonus(F.col("path"), "find_function").alias("own"))


_M = " + ".join(f"(CASE WHEN contains(lower(text), '{t}') THEN 1 ELSE 0 END)" for t in TERMS)
NEAR = f"m AS (SELECT path, line, {_M} AS m FROM lines), near AS (SELECT a.path, a.line, any_value(a.m) AS m, coalesce(sum(CASE WHEN a.m >= 1 THEN 0.3::DOUBLE * b.m / (abs(a.line - b.line) + 1) END), 0) AS s FROM m a LEFT JOIN m b ON a.path = b.path AND abs(a.line - b.line) BETWEEN 1 AND 5 GROUP BY a.path, a.line), bonus AS (SELECT path, least(sum(CASE WHEN m > 1 THEN m * 0.8::DOUBLE ELSE 0 END + s), 10) AS bonus FROM near GROUP BY path)"


@query(f"WITH {LINES}, {NEAR} SELECT path, round(bonus, 4) AS bonus FROM bonus")
def proximity_bonus(spark, d):
    return rank.proximity(files(spark, d), TERMS).select("path", F.round("bonus", 4).alias("bonus"))


@query(
    f"WITH {MIXED_LINES}, {NEAR}, hits AS (SELECT path, line, text, {' + '.join(map(_count, rank.analyse(QUESTION).keywords))} AS n FROM lines),"
    f" scored AS (SELECT path, sum(n * score) AS s FROM (SELECT path, n, {_SCORE(3.5, 2.2, 1.8, 1.8, 1.5, 1.8)} AS score FROM (SELECT path, n, {SCORED_KIND} AS match_type FROM (SELECT path, text, n, {STRIP.format('text')} AS s FROM hits WHERE n > 0))) GROUP BY path)"
    f" SELECT path, round({_CONCEPTS} + {_OWN} + coalesce(s, 0) + coalesce(bonus, 0), 4) AS score FROM files LEFT JOIN scored USING (path) LEFT JOIN bonus USING (path) ORDER BY score DESC, path LIMIT 20"
)
def keyword_rank_topk(spark, d):
    return rank.rank_files(mixed(spark, d), QUESTION, 20)


@query(
    f"WITH {LINES}, kinds AS (SELECT path, line, keyword, {SCORED_KIND} AS match_type FROM (SELECT path, line, text, keyword, {STRIP.format('text')} AS s FROM (SELECT *, 'agreement' AS keyword FROM lines WHERE {_count('agreement')} > 0 UNION ALL SELECT *, 'license' FROM lines WHERE {_count('license')} > 0))),"
    f" best AS (SELECT path, line FROM (SELECT path, line, row_number() OVER (PARTITION BY path ORDER BY {_SCORE(2.5, 2.2, 1.8, 1.8, 1.5, 1.8)} DESC, line, keyword) AS r FROM kinds) WHERE r <= 3),"
    " wanted AS (SELECT path, line, row_number() OVER (PARTITION BY path ORDER BY line) AS r FROM (SELECT DISTINCT l.path, l.line FROM lines l JOIN best b ON l.path = b.path AND abs(l.line - b.line) <= 2))"
    " SELECT path, line, text FROM lines JOIN wanted USING (path, line) WHERE r <= 15"
)
def match_preview_top3(spark, d):
    return rank.previews(files(spark, d), "license agreement")


# chunks

CHUNKS = f"{FILES}, blocks AS (SELECT path, i, len(l) AS n, array_to_string(l[i * 40 + 1 : i * 40 + 40], chr(10)) AS content FROM (SELECT path, l, unnest(range(0, CAST(ceil(len(l) / 40.0) AS BIGINT))) AS i FROM (SELECT path, string_split(content, chr(10)) AS l FROM files))), chunks AS (SELECT path || ':' || (i * 40 + 1) || ':' || substr(md5(content), 1, 8) AS id, path, CAST(i * 40 + 1 AS BIGINT) AS start_line, CAST(least(n, i * 40 + 40) AS BIGINT) AS end_line, 'chunk_' || (i + 1) AS name, content FROM blocks WHERE length({STRIP.format('content')}) >= 50)"


def chunk_rows(spark, d):
    return chunks.line_chunks(files(spark, d)).withColumn("start_line", F.col("start_line").cast("long")).withColumn("end_line", F.col("end_line").cast("long"))


@query(f"WITH {CHUNKS} SELECT id, path, start_line, end_line, name FROM chunks")
def chunk_lines_40(spark, d):
    return chunk_rows(spark, d).select("id", "path", "start_line", "end_line", "name")


@query(f"WITH {CHUNKS} SELECT id, CAST(floor(length(content) / 4) AS BIGINT) AS tokens, md5('Text_Chunk ' || name || ' in ' || path || chr(10) || chr(10) || content) AS embedded, CASE WHEN length(content) > 2000 THEN substr(content, 1, 2000) || chr(10) || '# ... (truncated)' ELSE content END AS block, CASE WHEN length(content) > 200 THEN substr(content, 1, 200) || '...' ELSE content END AS preview FROM chunks")
def chunk_embed_text(spark, d):
    c = chunk_rows(spark, d)
    embedded = chunks.embed_text(F.col("chunk_type"), F.col("name"), F.lit(None).cast("string"), F.col("language"), F.col("path"), F.col("content"))
    return c.select("id", chunks.tokens(F.col("content")).alias("tokens"), F.md5(embedded.cast("binary")).alias("embedded"), chunks.truncate_block(F.col("content")).alias("block"), text.clip(F.col("content"), 200).alias("preview"))


@query()
def token_split(spark, d):
    return chunks.token_split(chunk_rows(spark, d), 200)


@query(f"WITH {CHUNKS} SELECT count(*) AS chunks, count(DISTINCT path) AS files, round(count(*)::DOUBLE / count(DISTINCT path), 4) AS per_file FROM chunks")
def index_stats_files(spark, d):
    return vectors.index_stats(chunk_rows(spark, d))


# vectors

UNIT = "unit AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings)"
_Q = [1.0 if i % 3 == 0 else -0.5 for i in range(64)]
_L = sum(x * x for x in _Q) ** 0.5
SCORED = f"{UNIT}, scored AS (SELECT vec_id, label, round(list_sum(list_transform(list_zip(v, {[x / _L for x in _Q]!r}::DOUBLE[]), lambda p: p[1] * p[2])), 4) AS score FROM unit)"


@query(f"WITH {UNIT} SELECT vec_id, round(v[1], 4) AS first, round(list_sum(v), 3) AS total FROM unit")
def vector_normalize(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", vectors.normalise(F.col("embedding")).alias("v"))
    return v.select("vec_id", F.round(F.col("v")[0], 4).alias("first"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 3).alias("total"))


@query(f"WITH {SCORED} SELECT * FROM scored ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk(spark, d):
    return vectors.top_k(table(spark, d, "embeddings"), _Q)


@query(f"WITH {SCORED} SELECT 'd' || label || '.txt' AS path, max(score) AS score FROM scored GROUP BY ALL ORDER BY score DESC, path LIMIT 5")
def retrieve_by_vector(spark, d):
    index = table(spark, d, "embeddings").withColumn("path", F.concat(F.lit("d"), F.col("label").cast("string"), F.lit(".txt")))
    return rank.retrieve(index, QUESTION, index=index, limit=5, provider=lambda texts: [_Q] * len(texts))


@query(f"WITH {SCORED} SELECT * FROM (SELECT * FROM scored ORDER BY score DESC, vec_id LIMIT 20) WHERE label = 3 ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk_postfilter(spark, d):
    return vectors.top_k(table(spark, d, "embeddings"), _Q, where=F.col("label") == 3, after=True)


@query(f"WITH {SCORED} SELECT * FROM scored WHERE label = 3 ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk_prefilter(spark, d):
    return vectors.top_k(table(spark, d, "embeddings"), _Q, where=F.col("label") == 3)


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def index_stats_by_type(spark, d):
    return vectors.index_counts(table(spark, d, "embeddings"), "label")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id IN (3, 7, 11)")
def chunk_lookup(spark, d):
    return vectors.lookup(table(spark, d, "embeddings").select("vec_id", "label"), [3, 7, 11], "vec_id")


@query("SELECT label, count(*) AS n FROM (SELECT label FROM embeddings UNION ALL SELECT label + 100 FROM embeddings WHERE vec_id % 2 = 0) GROUP BY label")
def index_append(spark, d):
    index = table(spark, d, "embeddings").select("vec_id", "label")
    new = index.where("vec_id % 2 = 0").withColumn("label", F.col("label") + 100)
    return vectors.append(index, new).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


# graphs

KINDS_OF_EDGE = {"A": "Call", "R": "Import", "N": "Use(possible)"}
_WEIGHT = "CASE kind " + " ".join(f"WHEN '{k}' THEN {graph.TYPE_WEIGHTS[v.split('(')[0]]}::DOUBLE" for k, v in KINDS_OF_EDGE.items()) + " ELSE 0.0::DOUBLE END"


@query(f"WITH {EDGES} SELECT src, dst, round(sum({_WEIGHT}), 6) AS weight FROM edges GROUP BY ALL")
def edge_weights(spark, d):
    kind = F.lit(None).cast("string")
    for k, v in KINDS_OF_EDGE.items():
        kind = F.when(F.col("kind") == k, v).otherwise(kind)
    counts = edges(spark, d).groupBy("src", "dst", "kind").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("src", "dst").agg(F.round(F.sum(graph.type_weight(kind) * F.col("n")), 6).alias("weight"))


@query(f"WITH {EDGES} SELECT src, dst, max_by(weight, pos) AS weight FROM edges GROUP BY ALL")
def edge_last_wins(spark, d):
    return graph.last_wins(edges(spark, d).drop("kind"), "pos")


@query(f"WITH {SUMMED} SELECT dst AS src, src AS dst, weight FROM summed")
def reverse_edges(spark, d):
    return graph.reverse(summed(spark, d))


_PR = 5
_STEPS = ", ".join(
    f"r{k + 1} AS MATERIALIZED (SELECT n.node, (0.15::DOUBLE + 0.85 * (SELECT coalesce(sum(rank), 0) FROM r{k} WHERE node NOT IN (SELECT src FROM share))) / (SELECT count(*) FROM nodes) + 0.85 * coalesce(g.given, 0) AS rank FROM nodes n LEFT JOIN (SELECT dst, sum(rank * share) AS given FROM r{k} JOIN share ON node = src GROUP BY dst) g ON n.node = g.dst)"
    for k in range(_PR)
)


@query(f"WITH {SUMMED}, nodes AS MATERIALIZED (SELECT src AS node FROM summed UNION SELECT dst FROM summed), share AS MATERIALIZED (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM summed), r0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS rank FROM nodes), {_STEPS} SELECT node, round(rank, 6) AS rank FROM r{_PR}")
def pagerank_k(spark, d):
    return graph.pagerank(summed(spark, d), rounds=_PR, tolerance=None).select("node", F.round("rank", 6).alias("rank"))


@query("SELECT c_custkey AS node FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def degree_isolates(spark, d):
    links = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("src"), F.col("o_custkey").alias("dst"))
    return graph.isolates(table(spark, d, "customer").select(F.col("c_custkey").alias("node")), links)


@query("SELECT c_custkey AS node FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def remove_isolates(spark, d):
    links = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("src"), F.col("o_custkey").alias("dst"))
    return graph.without_isolates(table(spark, d, "customer").select(F.col("c_custkey").alias("node")), links)


TREE = "tree AS (SELECT p_partkey // 3 AS src, p_partkey AS dst FROM part WHERE p_partkey > 0)"
LINKS = "links AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem)"


def tree(spark, d):
    return table(spark, d, "part").where("p_partkey > 0").select(F.floor(F.col("p_partkey") / 3).alias("src"), F.col("p_partkey").alias("dst"))


@query(f"WITH RECURSIVE {TREE}, walk AS (SELECT CAST(0 AS BIGINT) AS node, CAST(0 AS BIGINT) AS level UNION SELECT dst, level + 1 FROM walk JOIN tree ON src = node) SELECT node, min(level) AS level FROM walk GROUP BY node")
def bfs_levels(spark, d):
    found = graph.bfs_levels(tree(spark, d), spark.createDataFrame([(0,)], "node long"))
    return found.select("node", F.col("level").cast("long").alias("level"))


@query(f"WITH RECURSIVE {TREE}, walk AS (SELECT CAST(0 AS BIGINT) AS node, CAST(0 AS BIGINT) AS level UNION SELECT dst, level + 1 FROM walk JOIN tree ON src = node) SELECT node, max(level) AS level FROM walk GROUP BY node")
def topo_levels(spark, d):
    found = graph.topological_levels(tree(spark, d))
    return found.select("node", F.col("level").cast("long").alias("level"))


# A cycle runs through nodes that have links both ways, so only these are walked.
@query(f"WITH RECURSIVE {LINKS}, inner_ AS (SELECT src, dst FROM links WHERE dst IN (SELECT src FROM links)), reach AS (SELECT src, dst FROM inner_ UNION SELECT r.src, l.dst FROM reach r JOIN inner_ l ON r.dst = l.src) SELECT 'tree' AS graph, true AS is_dag UNION ALL SELECT 'links', NOT EXISTS (SELECT 1 FROM reach WHERE src = dst)")
def is_dag(spark, d):
    links = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    return spark.createDataFrame([("tree", graph.is_dag(tree(spark, d))), ("links", graph.is_dag(links))], "graph string, is_dag boolean")


@query(f"WITH {SUMMED}, rank AS (SELECT node, 1.0::DOUBLE / (1 + node) AS rank, 1.0::DOUBLE + node % 5 AS rel FROM (SELECT src AS node FROM summed UNION SELECT dst FROM summed)) SELECT src, dst, round((a.rank + b.rank) * (a.rel / b.rel) * weight, 6) AS weight FROM summed JOIN rank a ON src = a.node JOIN rank b ON dst = b.node")
def edge_reweight(spark, d):
    e = summed(spark, d)
    nodes = graph.nodes_of(e)
    out = graph.reweight(e, nodes.withColumn("rank", 1.0 / (1 + F.col("node"))), nodes.withColumn("relevance", 1.0 + F.col("node") % 5))
    return out.select("src", "dst", F.round("weight", 6).alias("weight"))


MEMBERS = "member AS (SELECT node, node % 7 AS community FROM (SELECT src AS node FROM summed UNION SELECT dst FROM summed))"


def membership(e):
    return graph.nodes_of(e).withColumn("community", F.col("node") % 7)


@query(f"WITH {SUMMED}, {MEMBERS} SELECT a.community AS src, b.community AS dst, sum(weight) AS weight FROM summed JOIN member a ON src = a.node JOIN member b ON dst = b.node WHERE a.community <> b.community GROUP BY ALL")
def contract_sum(spark, d):
    e = summed(spark, d)
    return graph.contract(e, membership(e))


@query(f"WITH {SUMMED}, {MEMBERS} SELECT a.community AS src, b.community AS dst, max_by(weight, pos) AS weight FROM edges JOIN member a ON src = a.node JOIN member b ON dst = b.node WHERE a.community <> b.community GROUP BY ALL")
def contract_last_wins(spark, d):
    return graph.contract(edges(spark, d), membership(summed(spark, d)), "last", "pos")


@query(f"WITH {SUMMED}, {MEMBERS} SELECT a.community AS src, b.community AS dst, sum(weight) AS weight, sum(CASE WHEN kind = 'A' THEN 1 ELSE 0 END)::DOUBLE AS a, sum(CASE WHEN kind = 'N' THEN 1 ELSE 0 END)::DOUBLE AS n, sum(CASE WHEN kind = 'R' THEN 1 ELSE 0 END)::DOUBLE AS r FROM edges JOIN member a ON src = a.node JOIN member b ON dst = b.node WHERE a.community <> b.community GROUP BY ALL")
def merge_type_maps(spark, d):
    e = edges(spark, d)
    typed = e.select("src", "dst", "weight", F.create_map("kind", F.lit(1.0)).alias("types"))
    out = graph.contract_types(typed, membership(summed(spark, d)))
    return out.select("src", "dst", "weight", *(F.coalesce(F.try_element_at("types", F.lit(k)), F.lit(0.0)).alias(k.lower()) for k in "ANR"))


_MODULES = [("Core", "inner", [5, 0, 99]), ("Edge", "outer", [3]), ("None", "unknown only", [77])]


@query(f"WITH {SUMMED}, {MEMBERS}, listed(module_name, reasoning, community, place) AS (VALUES " + ", ".join(f"('{m}', '{r}', {c}, {i})" for m, r, cs in _MODULES for i, c in enumerate(cs)) + ") SELECT module_name, any_value(reasoning) AS reasoning, coalesce(string_agg('file_' || node, ',' ORDER BY place, node) FILTER (node IS NOT NULL), '') AS nodes FROM listed LEFT JOIN member USING (community) GROUP BY module_name")
def architecture_rollup(spark, d):
    member = membership(summed(spark, d))
    names = member.select(F.col("node").alias("id"), F.concat(F.lit("file_"), F.col("node").cast("string")).alias("name"))
    modules = spark.createDataFrame(_MODULES, "module_name string, reasoning string, communities array<long>")
    return graph.roll_up(modules, member, names).withColumn("nodes", F.array_join("nodes", ","))


@query(f"WITH {SUMMED}, {MEMBERS}, links AS (SELECT a.community AS source, b.community AS target, sum(weight) AS weight FROM summed JOIN member a ON src = a.node JOIN member b ON dst = b.node WHERE a.community <> b.community GROUP BY ALL) SELECT (SELECT CAST(to_json(list({{'id': community, 'size': n}} ORDER BY community)) AS VARCHAR) FROM (SELECT community, count(*) AS n FROM member GROUP BY community)) AS communities, (SELECT CAST(to_json(list({{'source': source, 'target': target, 'weight': CAST(weight AS BIGINT)}} ORDER BY source, target)) AS VARCHAR) FROM links) AS edges")
def graph_payload(spark, d):
    e, member = summed(spark, d), membership(summed(spark, d))
    sizes = member.groupBy(F.col("community").alias("id")).agg(F.count(F.lit(1)).alias("size"))
    return graph.payload(sizes, graph.contract(e, member).withColumn("weight", F.col("weight").cast("long")))


@query(f"WITH {SUMMED}, {MEMBERS} SELECT 'Community_' || (row_number() OVER (ORDER BY n DESC, least) - 1) AS community_id, n AS size, least AS least_node FROM (SELECT community, count(*) AS n, min(node) AS least FROM member GROUP BY community)")
def community_table(spark, d):
    return graph.community_table(membership(summed(spark, d))).select("community_id", "size", F.col("nodes")[0].alias("least_node"))


_NEAR = "m.ththth.example.net/en/25"


@query(f"WITH {URLS}, s AS (SELECT path, list_distinct(string_split(trim(path, '/'), '/')) AS p, string_split('{_NEAR}', '/') AS q FROM files) SELECT path, round(len(list_intersect(p, q))::DOUBLE / len(list_distinct(list_concat(p, q))), 6) AS similarity FROM s")
def jaccard_path(spark, d):
    near = F.array(*map(F.lit, _NEAR.split("/")))
    return urls(spark, d).select("path", F.round(graph.jaccard(graph.path_parts(F.col("path")), near), 6).alias("similarity"))


PARTS = f"{URLS}, parts AS (SELECT DISTINCT path, list_distinct(string_split(trim(path, '/'), '/')) AS p FROM files)"
MEAN = f"{PARTS}, member AS (SELECT length(path) % 4 AS community, p FROM parts WHERE length(path) % 2 = 0), sim AS (SELECT a.path, CAST(m.community AS BIGINT) AS community, avg(len(list_intersect(a.p, m.p))::DOUBLE / len(list_distinct(list_concat(a.p, m.p)))) AS s FROM parts a, member m WHERE length(a.path) % 2 = 1 GROUP BY ALL)"


def similarity(spark, d):
    p = urls(spark, d).select("path").distinct()
    even = p.where(F.length("path") % 2 == 0).select("path", (F.length("path") % 4).cast("long").alias("community"))
    return graph.mean_similarity(p.where(F.length("path") % 2 == 1), even)


@query(f"WITH {MEAN} SELECT path, community, round(s, 6) AS similarity FROM sim WHERE s > 0")
def mean_path_similarity(spark, d):
    return similarity(spark, d).select("path", "community", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {MEAN} SELECT path, community FROM (SELECT path, community, row_number() OVER (PARTITION BY path ORDER BY round(s, 9) DESC, community) AS r FROM sim WHERE s >= 0.1) WHERE r = 1")
def assign_isolated_oneshot(spark, d):
    rounded = similarity(spark, d).withColumn("similarity", F.round("similarity", 9))
    return graph.assign_isolated(rounded, 0.1).select("path", "community")


@query()
def community_detect(spark, d):
    return graph.communities(summed(spark, d))


@query()
def recluster(spark, d):
    return graph.recluster(summed(spark, d), below=8)


@query()
def assign_isolated_sequential(spark, d):
    p = urls(spark, d).select("path").distinct()
    even = p.where(F.length("path") % 2 == 0).select("path", (F.length("path") % 4).alias("community"))
    odd = p.where(F.length("path") % 2 == 1).select("path", F.lit(0).alias("turn"))
    return graph.assign_isolated_in_turn(odd, even, 0.2)


# code: a class and a function for each part, as Python and as JavaScript


def code(spark, d, language: str = "python"):
    p = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("k"), F.col("p_size").alias("s"))
    if language == "python":
        content = F.concat(F.lit("import os\n\n\nclass Part"), "k", F.lit("(Base, Other):  # a part of the catalogue and its price\n    def price(self, amount):\n"), F.repeat(F.lit("        amount += 1\n"), F.col("s")), F.lit("        return amount\n\n\ndef make_"), "k", F.lit("(size):\n    return size\n"))
        return p.select(F.concat(F.lit("src/part_"), "k", F.lit(".py")).alias("path"), content.alias("content"))
    content = F.concat(F.lit("class Part"), "k", F.lit(" {\n  price(amount) {\n"), F.repeat(F.lit("    amount += 1;\n"), F.col("s")), F.lit("    return amount;\n  }\n}\nfunction make_"), "k", F.lit("(size) {\n  return size;\n}\n"))
    return p.select(F.concat(F.lit("web/part_"), "k", F.lit(".js")).alias("path"), content.alias("content"))


CODE = "part_ AS (SELECT CAST(p_partkey AS VARCHAR) AS k, CAST(p_size AS INTEGER) AS s, 'src/part_' || p_partkey || '.py' AS path FROM part)"
_METHOD = "'    def price(self, amount):' || chr(10) || repeat('        amount += 1' || chr(10), s) || '        return amount'"
_CLASS = "'class Part' || k || '(Base, Other):  # a part of the catalogue and its price'"
_PYTHON = f"'import os' || chr(10) || chr(10) || chr(10) || {_CLASS} || chr(10) || {_METHOD} || chr(10) || chr(10) || chr(10) || 'def make_' || k || '(size):' || chr(10) || '    return size' || chr(10)"
COLUMNS_OF_SYMBOLS = ("path", "name", "type", "start_line", "end_line", "parent_name")


@query(f"WITH {CODE} SELECT path, 'Part' || k AS name, 'class' AS type, 4 AS start_line, s + 6 AS end_line, NULL::VARCHAR AS parent_name, 'Base,Other' AS bases, '' AS parameters FROM part_ UNION ALL SELECT path, 'price', 'method', 5, s + 6, 'Part' || k, '', 'self,amount' FROM part_ UNION ALL SELECT path, 'make_' || k, 'function', s + 9, s + 10, NULL, '', 'size' FROM part_")
def symbols_python(spark, d):
    found = symbols.symbols(code(spark, d))
    return found.select(*COLUMNS_OF_SYMBOLS, F.array_join("base_classes", ",").alias("bases"), F.array_join("parameters", ",").alias("parameters"))


@query("WITH part_ AS (SELECT CAST(p_partkey AS VARCHAR) AS k, CAST(p_size AS INTEGER) AS s, 'web/part_' || p_partkey || '.js' AS path FROM part) SELECT path, 'Part' || k AS name, 'class' AS type, 1 AS start_line, s + 5 AS end_line, NULL::VARCHAR AS parent_name FROM part_ UNION ALL SELECT path, 'price', 'method', 2, s + 4, 'Part' || k FROM part_ UNION ALL SELECT path, 'make_' || k, 'function', s + 6, s + 8, NULL FROM part_")
def symbols_regex(spark, d):
    return symbols.symbols(code(spark, d, "javascript")).select(*COLUMNS_OF_SYMBOLS)


@query(f"WITH {CODE} SELECT path, 'Part7' AS name, 4 AS start_line, s + 6 AS end_line FROM part_ WHERE k = '7'")
def find_class(spark, d):
    return symbols.find_class(code(spark, d), "catalogue.Part7").select("path", "name", "start_line", "end_line")


@query(f"WITH {CODE} SELECT path, 'Part' || k AS name, 4 AS start_line FROM part_ WHERE k = '7'")
def find_class_in_files(spark, d):
    return symbols.find_class(code(spark, d), "Part7", "src/**/part_*7.py").select("path", "name", "start_line")


def broken(spark, d):
    """The same Python files with a last line that can't be parsed."""
    return code(spark, d).withColumn("content", F.concat("content", F.lit("def broken(:\n")))


@query(f"WITH {CODE} SELECT path, 'Part' || k AS name, 'class' AS type, 4 AS start_line, s + 8 AS end_line, NULL::VARCHAR AS parent_name FROM part_ UNION ALL SELECT path, 'price', 'method', 5, s + 8, 'Part' || k FROM part_ UNION ALL SELECT path, 'make_' || k, 'function', s + 9, s + 10, NULL FROM part_ UNION ALL SELECT path, 'broken', 'function', s + 11, s + 12, NULL FROM part_")
def symbols_fallback(spark, d):
    return symbols.symbols(broken(spark, d), fallback=True).select(*COLUMNS_OF_SYMBOLS)


@query(f"WITH {CODE} SELECT path, 5 AS start_line, 'method' AS type, s + 8 AS end_line FROM part_ UNION ALL SELECT path, 4, 'class', s + 8 FROM part_ UNION ALL SELECT path, 5, 'block', CASE WHEN s < 47 THEN s + 8 ELSE 35 END FROM part_")
def block_ends(spark, d):
    kinds = F.explode(F.array(*(F.struct(F.lit(n).alias("start_line"), F.lit(k).alias("type")) for n, k in ((5, "method"), (4, "class"), (5, "block")))))
    asked = code(spark, d).select("path", "content", kinds.alias("a")).select("path", "content", "a.*")
    return symbols.block_ends(asked)


@query(f"WITH {CODE} SELECT path, 'price' AS name, 5 AS start_line, 'Part' || k AS parent_name FROM part_")
def find_function(spark, d):
    return symbols.find_function(code(spark, d), "price").select("path", "name", "start_line", "parent_name")


@query(f"WITH {CODE} SELECT path, 'price' AS name, 5 AS start_line, s + 6 AS end_line FROM part_ WHERE k = '7'")
def find_class_method(spark, d):
    return symbols.find_function(code(spark, d), "Part7.price").select("path", "name", "start_line", "end_line")


@query(f"WITH {CODE} SELECT path, 'Part7.price' AS name, 5 AS start_line, s + 6 AS end_line, {_METHOD} AS content FROM part_ WHERE k = '7' UNION ALL SELECT path, 'make_8', s + 9, s + 10, 'def make_8(size):' || chr(10) || '    return size' FROM part_ WHERE k = '8'")
def view_span(spark, d):
    return symbols.view_spans(code(spark, d), ["Part7.price", "make_8"])


@query(
    f"WITH {CODE}, found AS (SELECT path, 4 AS start_line, 4 AS end_line, 'class_header' AS chunk_type, 'Part' || k AS name, {_CLASS} AS content FROM part_ UNION ALL SELECT path, 5, s + 6, 'method', 'price', {_METHOD} FROM part_"
    f" UNION ALL SELECT path, CAST(i * 40 + 1 AS INTEGER), CAST(least(len(l), i * 40 + 40) AS INTEGER), 'context', 'context_' || (i + 1), array_to_string(l[i * 40 + 1 : i * 40 + 40], chr(10)) FROM (SELECT path, l, unnest(range(0, CAST(ceil(len(l) / 40.0) AS BIGINT))) AS i FROM (SELECT path, string_split({_PYTHON}, chr(10)) AS l FROM part_)))"
    f" SELECT path || ':' || start_line || ':' || substr(md5(content), 1, 8) AS id, path, start_line, end_line, chunk_type, name FROM found WHERE length({STRIP.format('content')}) >= 50"
)
def code_chunks(spark, d):
    return chunks.code_chunks(code(spark, d)).select("id", "path", "start_line", "end_line", "chunk_type", "name")


ORACLE_SQL.update({name: sql() for name, sql in ORACLE_SQL.items() if callable(sql)})
