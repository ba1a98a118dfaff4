"""Ranked keyword retrieval: query analysis, line context, proximity, file scores."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.text import lines as lines_of
from . import search, vectors
from .search import keyword_occurrences, word_regex

# Intents in order with words that show them.
INTENTS = {
    "find_function": ("function", "method", "def", "implement", "call"),
    "find_class": ("class", "object", "type", "model", "entity"),
    "find_variable": ("variable", "constant", "config", "setting"),
    "find_import": ("import", "module", "library", "dependency"),
    "find_test": ("test", "spec", "unittest", "pytest"),
    "find_error": ("error", "exception", "bug", "fix", "debug"),
    "find_documentation": ("doc", "comment", "readme", "documentation"),
    "find_pattern": ("pattern", "example", "usage", "how to"),
}
# Concepts, stop words, and the kinds of lines that matter to an intent.
CONCEPTS = (
    "authentication authorization validation serialization database orm query migration model api endpoint route handler controller "
    "middleware decorator factory singleton async await promise callback event exception error logging debug test mock fixture assertion "
    "configuration settings environment cache redis session cookie"
).split()
STOP_WORDS = frozenset(
    "the a an and or but in on at to for of with by is are was were be been have has had do does did will would could should can may might how what where when why which who".split()
)
RELEVANT = {
    "find_function": ["function_definition", "general_code"],
    "find_class": ["class_definition", "general_code"],
    "find_test": ["test_code", "function_definition"],
    "find_import": ["import_statement"],
    "find_documentation": ["documentation"],
    "find_variable": ["variable_assignment", "general_code"],
}
# How lines of each kind begin.
FUNCTION = [r"def\s+\w+\s*\(", r"function\s+\w+\s*\(", r"async\s+def\s+\w+\s*\(", r"const\s+\w+\s*=\s*\(", r"(public|private|protected)?\s*(static)?\s*\w+\s+\w+\s*\("]
CLASS = [r"class\s+\w+", r"export\s+class\s+\w+", r"(public|private)?\s*class\s+\w+"]
IMPORT = [r"import\s+", r"from\s+\w+\s+import\s+", r"#include\s*<", r"using\s+"]
COMMENT = [r"#", r"//", r"/\*", '"""', "'''", r"\*"]
ASSIGNMENT = [r"\w+\s*=\s*", r"self\.\w+\s*=\s*", r"const\s+\w+\s*=\s*", r"let\s+\w+\s*=\s*", r"var\s+\w+\s*=\s*"]
# What a match of each kind adds to its score: with its own intents, and otherwise.
CONTEXT = {
    "function_definition": (("find_function", "find_pattern"), 2.5, 1.5),
    "class_definition": (("find_class", "find_pattern"), 2.5, 1.2),
    "import_statement": (("find_import",), 2.0, 0.8),
    "documentation": (("find_documentation",), 1.5, 0.8),
    "variable_assignment": (("find_variable",), 1.5, 0.5),
    "test_code": (("find_test",), 2.0, 0.8),
}
# What terms near each other are worth, how far that reaches, what several on one line are worth, the most.
NEAR, AROUND, SEVERAL, MOST_BONUS = 0.3, 5, 0.8, 10.0


@dataclass
class Query:
    intent: str
    concepts: list[str]
    keywords: list[str]


def analyse(query: str) -> Query:
    low = query.lower()
    intent = next((k for k, v in INTENTS.items() if any(w in low for w in v)), "general")
    keywords = [w for w in re.findall(r"\b\w+\b", low) if len(w) > 2 and w not in STOP_WORDS]
    pascal = ["".join(p.title() for p in w.split("_")) for w in keywords if "_" in w]
    return Query(intent, [c for c in CONCEPTS if c in low], sorted({*keywords, *pascal}))


def kind_of(line: Column, test_words: tuple[str, ...] = ("test", "assert", "expect")) -> Column:
    stripped = F.regexp_replace(line, r"(?U)^\s+|\s+\z", "")
    starts = lambda patterns: stripped.rlike("(?U)^(?:" + "|".join(patterns) + ")")
    assigned = stripped.contains("=") & ~stripped.rlike("^(?:if|while|for|elif|else)") & starts(ASSIGNMENT)
    tested = F.lower(line).rlike("|".join(test_words))
    kinds = ((starts(FUNCTION), "function_definition"), (starts(CLASS), "class_definition"), (starts(IMPORT), "import_statement"), (starts(COMMENT), "documentation"), (assigned, "variable_assignment"), (tested, "test_code"))
    out = F.lit("general_code")
    for is_, name in reversed(kinds):
        out = F.when(is_, name).otherwise(out)
    return out


def context_score(line: Column, intent: str) -> Column:
    kind = kind_of(line, ("test", "assert", "expect", "mock"))
    out = F.lit(1.0)
    for name, (own, more, less) in CONTEXT.items():
        out = F.when(kind == name, F.lit(1.0 + (more if intent in own else less))).otherwise(out)
    return out


def context_relevance(line: Column, intent: str) -> Column:
    return F.when(kind_of(line).isin(RELEVANT.get(intent, ["general_code"])), 1.0).otherwise(0.5)


def file_bonus(path: Column, intent: str) -> Column:
    if intent == "find_test":
        return F.when(F.lower(path).contains("test"), 3.0).otherwise(0.0)
    if intent in ("find_class", "find_function"):
        return F.when(paths.suffix(path).isin(".py", ".js", ".ts", ".java", ".cpp", ".cs"), 1.5).otherwise(0.0)
    return F.lit(0.0)


def concept_bonus(content: Column, concepts: list[str]) -> Column:
    out = F.lit(0.0)
    for c in concepts:
        out = out + F.when(F.lower(content).contains(c), 2.0).otherwise(0.0)
    return out


def matches(files: DataFrame, query: Query) -> DataFrame:
    """A row for each line and keyword, with how often, what kind and how high."""
    found = keyword_occurrences(files, query.keywords) if query.keywords else files.select("path", F.lit("").alias("keyword"), F.lit(0).alias("line"), F.lit("").alias("text"), F.lit(0).cast("long").alias("n")).limit(0)
    line = F.col("text")
    return found.select("path", "keyword", "line", "text", "n", kind_of(line).alias("match_type"), context_score(line, query.intent).alias("score"), context_relevance(line, query.intent).alias("context_relevance"))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """A value made once and used by name: a lambda's variable isn't copied into what uses it."""
    return F.transform(F.array(value), body)[0]


def proximity_of(lines: Column, terms: list[str]) -> Column:
    """For lines with several terms, and for lines with any within five lines of each other; at most 10."""
    m = F.transform(lines, lambda x: bound(F.lower(x), lambda low: sum((F.when(low.contains(t), 1).otherwise(0) for t in terms), F.lit(0))))

    def bonus(m: Column) -> Column:
        at = lambda i: F.coalesce(F.get(m, i), F.lit(0))
        near = lambda i: sum(((at(i - d) + at(i + d)) * (NEAR / (d + 1)) for d in range(1, AROUND + 1)), F.lit(0.0))
        each = F.transform(m, lambda x, i: F.when(x >= 1, near(i) + F.when(x > 1, x * SEVERAL).otherwise(0.0)).otherwise(0.0))
        return F.least(F.aggregate(each, F.lit(0.0), lambda s, x: s + x), F.lit(MOST_BONUS))

    return bound(m, bonus)


def proximity(files: DataFrame, terms: list[str]) -> DataFrame:
    """(path, bonus) of files with a text; computed within each row."""
    return files.where("content is not null").select("path", proximity_of(lines_of(F.col("content")), terms).alias("bonus"))


def keyword_score(lines: Column, query: Query) -> Column:
    """The sum over lines of how often keywords stand there, times what the line's kind is worth."""
    if not query.keywords:
        return F.lit(0.0)
    any_ = r"(?iuU)\b(?:" + "|".join(rf"\Q{k}\E" for k in query.keywords) + r")\b"
    count = lambda x: sum((F.regexp_count(x, F.lit(word_regex(k))) for k in query.keywords), F.lit(0))
    return F.aggregate(F.filter(lines, lambda x: x.rlike(any_)), F.lit(0.0), lambda s, x: s + count(x) * context_score(x, query.intent))


def rank_files(files: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """(path, score): the best files, each row scored by itself, so nothing but the best is shuffled."""
    query = analyse(text)
    lines = lines_of(F.col("content"))
    own = file_bonus(F.col("path"), query.intent) + concept_bonus(F.col("content"), query.concepts)
    in_lines = F.coalesce(keyword_score(lines, query) + proximity_of(lines, query.keywords + query.concepts), F.lit(0.0))
    scored = files.select("path", F.round(own + in_lines, 4).alias("score"))
    return scored.where("score > 0").orderBy(F.desc("score"), "path").limit(limit)


def best_matches(lines: Column, query: Query, best: int) -> Column:
    """array<struct<low DOUBLE, line INT, keyword, match_type STRING>>: the lines and keywords that score highest, by
    falling score, line and keyword; low is the score below zero."""

    def hits(k: str) -> Column:
        match = lambda x, i: F.struct((-context_score(x, query.intent)).alias("low"), (i + 1).alias("line"), F.lit(k).alias("keyword"), kind_of(x).alias("match_type"))
        return F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(word_regex(k)), match(x, i))), lambda h: h.isNotNull())

    return F.slice(F.array_sort(F.concat(*map(hits, query.keywords))), 1, best)


def previews(files: DataFrame, text: str, best: int = 3, around: int = 2, most: int = 15) -> DataFrame:
    """(path, line, text): the lines around each file's best matches, each line once, the first ``most`` of them."""
    query = analyse(text)
    if not query.keywords:
        return files.select("path", F.lit(0).alias("line"), F.lit("").alias("text")).limit(0)
    lines = lines_of(F.col("content"))
    near = F.flatten(F.transform(best_matches(lines, query, best), lambda h: F.sequence(F.greatest(h["line"] - around, F.lit(1)), F.least(h["line"] + around, F.size(lines)))))
    shown = files.select("path", "content", F.explode(F.slice(F.array_sort(F.array_distinct(near)), 1, most)).alias("line"))
    return shown.select("path", "line", F.get(lines_of(F.col("content")), F.col("line") - 1).alias("text"))


def preview_text(files: DataFrame, text: str, best: int = 3, around: int = 2, most: int = 15) -> DataFrame:
    """(path, preview): a block for each of the best matches, saying what and where it is; at most ``most`` lines."""
    query = analyse(text)
    lines = lines_of(F.col("content"))
    block = lambda h: F.concat(
        F.array(F.concat(F.lit("Match in "), h["match_type"], F.lit(" (line "), h["line"].cast("string"), F.lit("):"))),
        F.transform(F.slice(lines, F.greatest(h["line"] - around + 1, F.lit(1)), F.least(h["line"] + around, F.size(lines)) - F.greatest(h["line"] - around, F.lit(0))), lambda x: F.concat(F.lit("  "), x)),
        F.array(F.lit("---")),
    )
    plain = F.concat(F.array_join(F.slice(lines, 1, 3), "\n"), F.when(F.size(lines) > 3, "...").otherwise(""))
    if not query.keywords:
        return files.select("path", plain.alias("preview"))
    hits = best_matches(lines, query, best)
    made = F.array_join(F.slice(F.flatten(F.transform(hits, block)), 1, most), "\n")
    return files.select("path", F.when(F.size(hits) > 0, made).otherwise(plain).alias("preview"))


def retrieve(files: DataFrame, text: str, index: DataFrame | None = None, limit: int = 10, pattern: str | None = None, category: str | None = None, provider: Callable = vectors.hashed_embedding) -> DataFrame:
    """(path, score): by vectors where there is an index (path, embedding, ...), else by keywords; of files whose path fits
    a pattern and whose category is asked for. A file scores as its best chunk."""
    if not text.strip():
        raise ValueError("the query is empty")
    rows = search.visible(index if index is not None else files, pattern, glob=True)
    if category:
        rows = rows.where(paths.category(F.col("path")) == category)
    if index is None:
        return rank_files(rows, text, limit)
    score = vectors.cosine(F.col("embedding"), [float(x) for x in provider([text])[0]])
    best = rows.select("path", score.alias("score")).groupBy("path").agg(F.max("score").alias("score"))
    return best.orderBy(F.desc("score"), "path").limit(limit)
