"""Operators by name, as a service would offer them: a function of DataFrames and the arguments it can't do without."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import chunks, graph, rank, search, symbols, vectors


@dataclass(frozen=True)
class Operator:
    run: Callable[..., DataFrame]
    about: str
    required: tuple[str, ...] = ()


OPERATORS: dict[str, Operator] = {}


def register(name: str, run: Callable[..., DataFrame], about: str, *required: str) -> None:
    """A name that is there already is overwritten."""
    OPERATORS[name] = Operator(run, about, required)


def register_sql(spark: SparkSession) -> None:
    """The table functions symbols_of(path, content) and chunks_of(path, content), for SQL with LATERAL."""

    class SymbolsOf:
        def eval(self, path: str, content: str):
            language = symbols.language_of(path, content)
            for name, kind, start, end, parent, *_ in symbols.found_in(content, language) if language else ():
                yield name, kind, start, end, parent

    class ChunksOf:
        def eval(self, path: str, content: str):
            if content and content.strip():
                for r in chunks._code_rows(path, content, symbols.language_of(path, content) or "unknown", chunks.MOST_TOKENS):
                    yield r[1], r[2], r[3], r[4], r[-1]

    for function, name, schema in (
        (SymbolsOf, "symbols_of", "name string, type string, start_line int, end_line int, parent_name string"),
        (ChunksOf, "chunks_of", "start_line int, end_line int, chunk_type string, name string, content string"),
    ):
        spark.udtf.register(name, F.udtf(function, returnType=schema))


def call(name: str, table: DataFrame, **arguments) -> DataFrame:
    if name not in OPERATORS:
        raise KeyError(f"no operator {name!r}; there are {', '.join(sorted(OPERATORS))}")
    missing = [a for a in OPERATORS[name].required if arguments.get(a) is None]
    if missing:
        raise ValueError(f"{name} needs {', '.join(missing)}")
    return OPERATORS[name].run(table, **arguments)


register("list_files", search.list_files, "files that the policy shows")
register("find_files", search.find_files, "paths by a pattern", "pattern")
register("grep", search.grep, "lines by a regular expression", "pattern")
register("read_lines", search.read_lines, "a range of lines of each file")
register("find_class", symbols.find_class, "classes by name", "name")
register("find_function", symbols.find_function, "functions and methods by name", "name")
register("view_spans", symbols.view_spans, "the lines of definitions", "names")
register("rank_files", rank.rank_files, "files by relevance to a question", "text")
register("view_range", search.view_range, "a range of lines, cut to the file", "start")
register("too_large", search.too_large, "files that searches leave out for their size")
register("workspace_info", search.workspace_info, "what a corpus holds")
register("test_frameworks", search.test_frameworks, "test frameworks that a corpus shows")
register("replace_in_files", search.replace_in_files, "a text replaced in files", "old", "new")
register("keyword_occurrences", search.keyword_occurrences, "whole words by line", "keywords")
register("symbols", symbols.symbols, "definitions")
register("previews", rank.previews, "lines around the best matches", "text")
register("preview_text", rank.preview_text, "a text of the best matches", "text")
register("retrieve", rank.retrieve, "files by vectors or keywords", "text")
register("line_chunks", chunks.line_chunks, "chunks of lines")
register("code_chunks", chunks.code_chunks, "chunks of code and text")
register("embed", vectors.embed, "vectors of chunks")
register("top_k", vectors.top_k, "nearest vectors", "query")
register("index_counts", vectors.index_counts, "chunks by type or language", "by")
register("lookup", vectors.lookup, "rows of an index by id", "ids")
register("pagerank", graph.pagerank, "ranks of nodes")
register("communities", graph.communities, "communities of bounded size")
register("recluster", graph.recluster, "communities of nodes")
