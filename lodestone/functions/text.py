"""Column expressions over text: lines, replacement, fenced blocks, test logs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

BREAKS = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"


def lines(text: Column) -> Column:
    """Split at line feeds; a last empty line stays."""
    return F.split(text, "\n", -1)


def splitlines(text: Column) -> Column:
    """Split at every line boundary; no empty line after the last one."""
    parts = F.split(text, BREAKS, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def occurrences(text: Column, old: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(old), F.lit("")))) / len(old)).cast("long")


def replace_nth(text: Column, old: str, new: str, n: int) -> Column:
    """Replace the n-th occurrence, from 1; 0: all. Null if there are fewer."""
    if n == 0:
        return F.when(F.contains(text, F.lit(old)), F.replace(text, F.lit(old), F.lit(new)))
    parts = F.split(text, re.sub(r"([^\w\s])", r"\\\1", old), -1)
    joined = F.concat(F.array_join(F.slice(parts, F.lit(1), F.lit(n)), old), F.lit(new), F.array_join(F.slice(parts, F.lit(n + 1), F.size(parts)), old))
    return F.when(F.size(parts) > n, joined)


def indent(line: Column) -> Column:
    return F.length(line) - F.length(F.regexp_replace(line, r"(?U)^\s+", ""))


def fenced(text: Column, kind: str) -> Column:
    """The first block fenced by ``` and its kind; null if none."""
    pattern = f"(?s)```{kind}\\n(.*?)\\n```"
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))


def llm_output(text: Column) -> Column:
    """STRUCT<module_groups, plantuml_diagram STRING>: the stripped JSON block, null if it can't be parsed, and the diagram."""
    block = strip(fenced(text, "json"))
    return F.struct(F.when(F.try_parse_json(block).isNotNull(), block).alias("module_groups"), strip(fenced(text, "plantuml")).alias("plantuml_diagram"))


def unfenced_json(text: Column, schema: str) -> Column:
    """The text without its fences, parsed; null where it can't be."""
    return F.from_json(F.replace(F.replace(text, F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")), schema)


def without_thoughts(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)<think>.*?</think>", "")


def clip(text: Column, n: int, marker: str = "...") -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(marker))).otherwise(text)


def test_summary(framework: Column, log: Column) -> Column:
    """STRUCT<total, passed, failed, skipped, errors INT, duration STRING> of a test run's output."""
    number = lambda pattern, group: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(log, pattern, group), F.lit("")), F.lit("999999999")).cast("int"), F.lit(0))
    word = lambda pattern, group: F.nullif(F.regexp_extract(log, pattern, group), F.lit(""))

    def made(total, passed, failed, skipped=F.lit(0), errors=F.lit(0), duration=F.lit(None).cast("string")):
        return F.struct(total.alias("total"), passed.alias("passed"), failed.alias("failed"), skipped.alias("skipped"), errors.alias("errors"), duration.alias("duration"))

    both, only = r"=+ (\d+) failed.*?(\d+) passed.*?in ([\d.]+)s =+", r"=+ (\d+) passed.*?in ([\d.]+)s =+"
    pytest_ = F.when(log.rlike(both), made(number(both, 1) + number(both, 2), number(both, 2), number(both, 1), duration=word(both, 3))).otherwise(
        made(number(only, 1), number(only, 1), F.lit(0), duration=word(only, 2))
    )
    js = r"Tests:\s+(\d+) failed,\s+(\d+) passed,\s+(\d+) total"
    jvm = r"Tests run: (\d+), Failures: (\d+), Errors: (\d+), Skipped: (\d+)"
    bad = number(jvm, 2) + number(jvm, 3)
    ran, failed = r"Ran (\d+) test", r"FAILED \(failures=(\d+)(?:, errors=(\d+))?\)"
    django = F.when(log.contains("OK"), made(number(ran, 1), number(ran, 1), F.lit(0))).otherwise(made(F.lit(0), F.lit(0), number(failed, 1), errors=number(failed, 2)))
    return (
        F.when(framework == "pytest", pytest_)
        .when(framework.isin("jest", "mocha"), made(number(js, 3), number(js, 2), number(js, 1)))
        .when(framework.isin("maven", "gradle"), made(number(jvm, 1), number(jvm, 1) - bad - number(jvm, 4), bad, number(jvm, 4)))
        .when(framework == "django", django)
    )
