"""Scans of a corpus of files (path, content): listing, search, line ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths, text


def first_rows(rows: DataFrame, limit: int | None, *order: str, flag: bool = False) -> DataFrame:
    """The first rows in an order, all without a limit; with ``flag`` the column truncated says whether there were more."""
    if not limit:
        return rows.withColumn("truncated", F.lit(False)) if flag else rows
    if not flag:
        return rows.orderBy(*order).limit(limit)
    some = rows.orderBy(*order).limit(limit + 1)  # the windows below see no more rows than these
    place = some.withColumn("place", F.row_number().over(W.orderBy(*order))).withColumn("n", F.count(F.lit(1)).over(W.partitionBy()))
    return place.where(F.col("place") <= limit).withColumn("truncated", F.col("n") > limit).drop("place", "n")


def visible(files: DataFrame, pattern: str | list[str] | None = None, glob: bool = False) -> DataFrame:
    """The files that the policy shows, of these the ones whose path one of the patterns fits."""
    out = files.where(paths.allowed(F.col("path")))
    if not pattern:
        return out
    regexes = [paths.glob_regex(p) if glob else paths.fnmatch_regex(p) for p in ([pattern] if isinstance(pattern, str) else pattern)]
    return out.where(reduce(lambda a, b: a | b, [F.col("path").rlike(r) for r in regexes]))


def list_files(files: DataFrame, directory: str = "", recursive: bool = True, limit: int | None = None, flag: bool = False) -> DataFrame:
    out = visible(files).where(F.col("path").startswith(f"{directory}/" if directory else ""))
    if not recursive:
        out = out.where(F.instr(F.substring(F.col("path"), len(directory) + 2 if directory else 1, 1 << 30), "/") == 0)
    return first_rows(out.select("path"), limit, "path", flag=flag)


def find_files(files: DataFrame, pattern: str | list[str], glob: bool = False, limit: int | None = None, flag: bool = False) -> DataFrame:
    """Paths that one of the patterns fits, each once however many do."""
    return first_rows(visible(files, pattern, glob).select("path"), limit, "path", flag=flag)


def explode_lines(files: DataFrame, every_break: bool = True) -> DataFrame:
    split = text.splitlines if every_break else text.lines
    return files.select("path", F.posexplode(split(F.col("content"))).alias("p", "text")).select("path", (F.col("p") + 1).alias("line"), "text")


def grep(files: DataFrame, pattern: str, file_pattern: str | None = None, limit: int | None = None, flag: bool = False, most_bytes: int = paths.MAX_FILE_SIZE) -> DataFrame:
    """A row for each line that matches, whatever its case, in the files that the policy shows; with a limit, the first
    ones by path and line. Files of more than ``most_bytes`` are not searched; too_large names them."""
    files = visible(files)
    if file_pattern:
        files = files.where(F.col("path").rlike(paths.glob_regex(file_pattern, anywhere=True)))
    regex = paths.java_regex(pattern)
    out = explode_lines(files.where(F.octet_length("content") <= most_bytes)).where(F.col("text").rlike(regex))
    return first_rows(out.select("path", "line", text.strip(F.col("text")).alias("content")), limit, "path", "line", flag=flag)


def too_large(files: DataFrame, most_bytes: int = paths.MAX_FILE_SIZE) -> DataFrame:
    """(path, bytes) of files that grep leaves out for their size."""
    return visible(files).where(F.octet_length("content") > most_bytes).select("path", F.octet_length("content").cast("long").alias("bytes"))


def view_range(files: DataFrame, start: int, end: int | None = None) -> DataFrame:
    """(path, start_line, end_line, content, error): 1-based, inclusive, cut to the file; without an end one line. A start
    beyond the file is an error."""
    all_, first = text.lines(F.col("content")), max(1, start)
    n = F.size(all_)
    last = F.least(n, F.lit(max(end or first, first)))
    ok = n >= first
    return files.select(
        "path",
        F.when(ok, F.lit(first)).alias("start_line"),
        F.when(ok, last).alias("end_line"),
        F.when(ok, F.array_join(F.slice(all_, F.lit(first), F.greatest(last - first + 1, F.lit(0))), "\n")).alias("content"),
        F.when(~ok, F.concat(F.lit(f"start line {start} is beyond the file's "), n.cast("string"), F.lit(" lines"))).alias("error"),
    )


def read_lines(files: DataFrame, start: int = 1, end: int | None = None) -> DataFrame:
    """1-based, inclusive; files shorter than start, or start after end, give an error instead of lines."""
    all_ = text.splitlines(F.col("content"))
    n = F.size(all_)
    to = F.least(n, F.lit(end)) if end else n
    error = F.when(n < start, "start is beyond the end of the file").when(F.lit(start) > to, "start is after end")
    return files.select("path", F.when(error.isNull(), F.array_join(F.slice(all_, F.lit(start), F.greatest(to - start + 1, F.lit(0))), "\n")).alias("content"), error.alias("error"))


def view_file(files: DataFrame, most: int = 1000, shown: int = 100) -> DataFrame:
    all_ = text.lines(F.col("content"))
    return files.select("path", F.when(F.size(all_) > most, F.slice(all_, 1, shown)).otherwise(all_).alias("lines"), (F.size(all_) > most).alias("truncated"))


def replace_in_files(files: DataFrame, old: str, new: str, occurrence: int = 0) -> DataFrame:
    """(path, content, replaced, total, error): the text with one occurrence replaced, from 1, or all with 0. A text without
    it, or with fewer, stays as it is and has an error."""
    content = F.col("content")
    total = text.occurrences(content, old)
    error = F.when(total == 0, "the text is not there").when(total < occurrence, F.concat(F.lit(f"occurrence {occurrence} of "), total.cast("string")))
    made = F.coalesce(text.replace_nth(content, old, new, occurrence), content)
    return files.select("path", made.alias("content"), F.when(error.isNotNull(), 0).when(F.lit(occurrence) == 0, total).otherwise(1).cast("long").alias("replaced"), total.alias("total"), error.alias("error"))


def word_regex(keyword: str) -> str:
    """A whole word, whatever its case."""
    return rf"(?iuU)\b\Q{keyword}\E\b"


def keyword_occurrences(files: DataFrame, keywords: list[str]) -> DataFrame:
    """(path, keyword, line, text, n): whole words, whatever their case. A pattern for each keyword, compiled once; only
    lines with hits are multiplied."""
    counted = [F.struct(F.lit(k).alias("keyword"), F.regexp_count("text", F.lit(word_regex(k))).cast("long").alias("n")) for k in keywords]
    hits = explode_lines(files, every_break=False).withColumn("hit", F.explode(F.filter(F.array(*counted), lambda h: h.n > 0)))
    return hits.select("path", "hit.keyword", "line", "text", "hit.n")


def workspace_info(files: DataFrame) -> DataFrame:
    """One row on a corpus: files in all and shown by the policy, bytes, languages, and whether it holds a git folder."""
    known = paths.language(F.col("path"), F.col("content"))
    return files.agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(paths.allowed(F.col("path"))).alias("shown"),
        F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).cast("long").alias("bytes"),
        F.count_distinct(F.when(known != "unknown", known)).alias("languages"),
        F.coalesce(F.bool_or(F.array_contains(F.split("path", "/"), ".git")), F.lit(False)).alias("is_git_repo"),
    )


def primary_language(files: DataFrame) -> DataFrame:
    """The most frequent of four families of suffixes; python if there is none."""
    kind = F.when(paths.suffix(F.col("path")).isin(".py"), "python").when(paths.suffix(F.col("path")).isin(".js", ".jsx", ".ts", ".tsx"), "javascript")
    kind = kind.when(paths.suffix(F.col("path")) == ".java", "java").when(paths.suffix(F.col("path")).isin(".cpp", ".cc", ".c", ".h", ".hpp"), "cpp")
    counts = files.select(kind.alias("language")).where("language is not null").groupBy("language").count()
    best = counts.agg(F.max_by("language", F.struct("count", F.col("language"))).alias("language"))
    return best.select(F.coalesce("language", F.lit("python")).alias("language"))


# The files at a corpus's root that configure a framework, and the command that runs its tests.
CONFIGS = {
    "pytest": ("pytest.ini", "pyproject.toml", "setup.cfg"),
    "jest": ("jest.config.js", "jest.config.json", "__tests__"),
    "mocha": (),
    "maven": ("pom.xml",),
    "gradle": ("build.gradle", "build.gradle.kts"),
    "django": ("manage.py",),
}
COMMANDS = {"maven": "mvn test", "gradle": "./gradlew test", "django": "python manage.py test"}
TEST_FILES = 10


def test_frameworks(files: DataFrame) -> DataFrame:
    """(framework, config_files, test_files, command), a row for each that a corpus shows: by the files at its root, by
    names of Python tests anywhere, and by what package.json asks for. At most TEST_FILES test files, first by path."""
    path, name = F.col("path"), paths.basename(F.col("path"))
    is_test = name.rlike(r"^test_.*\.py\z|_test\.py\z")
    node = "scripts map<string,string>, devDependencies map<string,string>, dependencies map<string,string>"
    every = sorted({c for cs in CONFIGS.values() for c in cs})
    seen = files.withColumn("root", F.substring_index("path", "/", 1)).agg(
        F.collect_set(F.when(F.col("root").isin(every) & ((path == F.col("root")) | (F.col("root") == "__tests__")), F.col("root"))).alias("configs"),
        F.max(F.when(path == "package.json", F.struct(F.lit(1).alias("there"), F.col("content")))).alias("package"),
    )
    tests = first_rows(files.where(is_test).select("path"), TEST_FILES, "path").agg(F.array_sort(F.collect_list("path")).alias("tests"))
    one = seen.withColumn("one", F.lit(1)).join(tests.withColumn("one", F.lit(1)), "one").withColumn("node", F.from_json("package.content", node))  # a row each
    holds = lambda part, what: F.coalesce(F.map_contains_key(f"node.{part}", what), F.lit(False))
    uses = lambda what: holds("devDependencies", what) | holds("dependencies", what)
    script = F.coalesce(F.try_element_at("node.scripts", F.lit("test")), F.lit("npm test"))
    has = lambda *names: F.arrays_overlap("configs", F.array(*map(F.lit, names)))
    shown = {
        "pytest": has("pytest.ini", "pyproject.toml") | (F.size("tests") > 0),
        "jest": uses("jest") | holds("scripts", "test"),
        "mocha": uses("mocha"),
        **{k: has(*CONFIGS[k]) for k in ("maven", "gradle", "django")},
    }
    rows = [
        F.struct(
            F.lit(k).alias("framework"),
            F.array_intersect(F.array(*map(F.lit, CONFIGS[k])) if CONFIGS[k] else F.array().cast("array<string>"), F.col("configs")).alias("config_files"),
            (F.col("tests") if k == "pytest" else F.array().cast("array<string>")).alias("test_files"),
            (script if k in ("jest", "mocha") else F.lit(COMMANDS.get(k))).cast("string").alias("command"),
            F.coalesce(v, F.lit(False)).alias("shown"),
        )
        for k, v in shown.items()
    ]
    return one.select(F.explode(F.array(*rows)).alias("r")).where("r.shown").select("r.framework", "r.config_files", "r.test_files", "r.command")
