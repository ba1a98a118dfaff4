"""Classes, functions and methods of source files: Python by its own parser, other languages by patterns."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths
from . import search, spans

SCHEMA = (
    "path string, name string, type string, start_line int, end_line int, parent_name string, parameters array<string>, decorators array<string>, "
    "base_classes array<string>, is_async boolean, is_static boolean, is_class_method boolean, language string, error string"
)
#: Definitions in languages without a parser here, a line at a time: what they define, and their pattern.
DEFINITIONS = [
    ("class", re.compile(r"^\s*(?:export\s+|public\s+|private\s+|abstract\s+|final\s+)*(?:class|interface|struct)\s+(\w+)")),
    ("function", re.compile(r"^\s*(?:export\s+|default\s+|async\s+)*function\s*\*?\s*(\w+)\s*\(")),
    ("function", re.compile(r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>")),
    ("function", re.compile(r"^\s*(\w+)\s*:\s*(?:async\s+)?function\s*\(")),
    ("function", re.compile(r"^\s*(?:fn|func|def)\s+(\w+)\s*[(<]")),
    ("function", re.compile(r"^\s*(?:(?:public|private|protected|static|final|virtual|inline|async)\s+)*(?!return\b|else\b|new\b|throw\b)[\w:<>\[\],*&]+\s+(\w+)\s*\([^;]*\)\s*(?:const\s*)?(?:throws\s+[\w, ]+)?\{")),
    ("function", re.compile(r"^\s+(?:async\s+|static\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b)(\w+)\s*\([^)]*\)\s*\{")),
]


def python_symbols(source: str):
    def visit(node, parent):
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef):
                bases = [b.id for b in child.bases if isinstance(b, ast.Name)]
                yield (child.name, "class", child.lineno, child.end_lineno, parent, [], [ast.unparse(d) for d in child.decorator_list], bases, False, False, False)
                yield from visit(child, child.name)
            elif isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                marks = [ast.unparse(d) for d in child.decorator_list]
                args = [a.arg for a in (*child.args.posonlyargs, *child.args.args)]
                kind = "method" if parent else "function"
                yield (child.name, kind, child.lineno, child.end_lineno, parent, args, marks, [], isinstance(child, ast.AsyncFunctionDef), "staticmethod" in marks, "classmethod" in marks)
            elif not isinstance(child, ast.expr):
                yield from visit(child, parent)

    yield from visit(ast.parse(source), None)


def block_end(lines: list[str], start: int) -> int:
    """The last line of a block in braces, from its first; the first line itself if no brace opens near."""
    depth, opened = 0, False
    for i in range(start, len(lines)):
        for c in lines[i]:
            if c == "{":
                depth, opened = depth + 1, True
            elif c == "}":
                depth -= 1
        if opened and depth <= 0:
            return i
        if not opened and i - start > 3:
            break
    return start if not opened else len(lines) - 1


def pattern_symbols(source: str):
    lines, inside = source.split("\n"), []
    for i, line in enumerate(lines):
        inside = [(n, e) for n, e in inside if e >= i]
        for kind, pattern in DEFINITIONS:
            m = pattern.match(line)
            if m and not re.match(r"\s*(?:if|for|while|switch|catch|return|else)\b", line):
                end, parent = block_end(lines, i), inside[-1][0] if inside else None
                yield (m[1], "method" if kind == "function" and parent else kind, i + 1, end + 1, parent, [], [], [], "async " in line, " static " in f" {line} ", False)
                if kind == "class":
                    inside.append((m[1], end))
                break


def language_of(path: str, content: str | None) -> str | None:
    """As paths.language, of one file; None if it is unknown."""
    name = path.rsplit("/", 1)[-1]
    suffix = "." + name.rsplit(".", 1)[1].lower() if "." in name.lstrip(".") else ""
    first = (content or "").split("\n", 1)[0].lower()
    by_line = next((l for word, l in paths.SHEBANGS if first.startswith("#!") and word in first), None)
    return next((l for l, suffixes in paths.LANGUAGES.items() if suffix and suffix in suffixes.split()), by_line)


def found_in(content: str | None, language: str) -> list:
    """The definitions of one file; of Python that can't be parsed, what its lines show."""
    try:
        return list((python_symbols if language == "python" else pattern_symbols)(content or ""))
    except (SyntaxError, ValueError, RecursionError):
        return list(spans.python_by_lines(content))


def symbols(files: DataFrame, fallback: bool = False, source: bool = False) -> DataFrame:
    """A row for each definition; a file that can't be parsed gives one row with the error. With ``fallback``, Python that
    can't be parsed gives what its lines show, each with the error; with ``source``, a column of the definition's lines."""

    def work(batches):
        for b in batches:
            rows = []
            for path, content, language in zip(b.path, b.content, b.language):
                try:
                    found = list((python_symbols if language == "python" else pattern_symbols)(content or ""))
                    error = None
                except (SyntaxError, ValueError, RecursionError) as e:
                    found, error = list(spans.python_by_lines(content)) if fallback and language == "python" else [], str(e)
                    if not found:
                        rows.append((path, None, None, None, None, None, [], [], [], None, None, None, language, error, None))
                lines = (content or "").split("\n") if source and found else []
                rows += [(path, *s, language, error, "\n".join(lines[s[2] - 1 : s[3]]) if source else None) for s in found]
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in (SCHEMA + ", source string").split(", ")])
            yield out.astype({"start_line": "Int32", "end_line": "Int32", "is_async": "boolean", "is_static": "boolean", "is_class_method": "boolean"})

    with_language = files.select("path", "content", paths.language(F.col("path"), F.col("content")).alias("language")).where("language <> 'unknown'")
    out = with_language.mapInPandas(work, SCHEMA + ", source string")
    return out if source else out.drop("source")


def find_class(files: DataFrame, name: str, glob: str | None = None) -> DataFrame:
    """By the last part of a dotted name, in the files that the policy shows."""
    found = symbols(search.visible(files, glob, glob=True), fallback=True)
    return found.where((F.col("type") == "class") & (F.col("name") == name.split(".")[-1]))


def find_function(files: DataFrame, name: str, glob: str | None = None) -> DataFrame:
    """Functions and methods in the files that the policy shows; of several on one line the first counts."""
    parts = name.split(".")
    found = symbols(search.visible(files, glob, glob=True), fallback=True).where(F.col("type").isin("function", "method") & (F.col("name") == parts[-1]))
    if len(parts) == 2:
        found = found.where(F.col("parent_name") == parts[0])
    first = W.partitionBy("path", "start_line").orderBy(F.when(F.col("type") == "function", 0).otherwise(1))
    return found.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")


def view_spans(files: DataFrame, names: list[str]) -> DataFrame:
    """(path, name, start_line, end_line, content) of definitions by name or Class.method."""
    found = symbols(search.visible(files), fallback=True, source=True).where("name is not null").withColumn("full", F.concat_ws(".", "parent_name", "name"))
    found = found.where(F.col("name").isin(names) | F.col("full").isin(names))
    return found.select("path", F.col("full").alias("name"), "start_line", "end_line", F.col("source").alias("content"))


def block_ends(asked: DataFrame) -> DataFrame:
    """(path, start_line, type, end_line) for rows of (path, content, start_line, type): where a block of that type that
    begins at that line ends, judged by indentation."""

    def work(batches):
        for b in batches:
            ends = [spans.ENDS.get(kind, spans.block_end)(spans.Lines(content or ""), start) for content, start, kind in zip(b.content, b.start_line, b.type)]
            yield pd.DataFrame({"path": b.path, "start_line": b.start_line, "type": b.type, "end_line": pd.Series(ends, dtype="int32")})

    return asked.select("path", "content", F.col("start_line").cast("int").alias("start_line"), "type").mapInPandas(work, "path string, start_line int, type string, end_line int")
