"""Column expressions over relative paths: parts, policy, language, globs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Which files a workspace shows.
ALLOWED = (
    ".py .java .js .ts .jsx .tsx .c .cpp .h .hpp .cs .php .rb .go .rs .swift .kt .scala .dart .lua .perl .sh .bash .zsh .ps1 .bat .cmd .asm .s "
    ".html .css .scss .sass .less .vue .svelte .astro .json .yaml .yml .toml .xml .cfg .ini .conf .properties .env .sql .graphql .proto "
    ".md .txt .rst .adoc .tex .dockerfile .dockerignore .gitignore .gitattributes .editorconfig .eslintrc .prettierrc .babelrc .tsconfig .csv .tsv .log"
).split() + [""]
FORBIDDEN = ["node_modules", ".venv", "venv", "__pycache__", ".pytest_cache"]
TEXT_NAMES = "readme license changelog makefile dockerfile pipfile gemfile rakefile gulpfile gruntfile procfile buildfile justfile".split()
MAX_FILE_SIZE = 10 * 1024 * 1024
# Languages by suffix, and by what a first line starting with #! contains.
LANGUAGES = {
    "python": ".py .pyw",
    "javascript": ".js .jsx .mjs",
    "typescript": ".ts .tsx",
    "java": ".java",
    "c": ".c .h",
    "cpp": ".cpp .cxx .cc .hpp .hxx",
    "rust": ".rs",
    "go": ".go",
    "ruby": ".rb",
    "php": ".php",
    "c_sharp": ".cs",
}
SHEBANGS = [("python", "python"), ("node", "javascript"), ("javascript", "javascript"), ("ruby", "ruby"), ("php", "php")]


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """With its dot; a name that only begins with a dot, or ends with one, has none."""
    return F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)


def allowed(path: Column, hidden: bool = True, version_control: bool = True) -> Column:
    parts = F.split(path, "/")
    ok = ~F.arrays_overlap(parts, F.array(*map(F.lit, FORBIDDEN)))
    if not version_control:
        ok = ok & ~F.arrays_overlap(parts, F.array(*map(F.lit, (".git", ".svn", ".hg"))))
    if not hidden:
        ok = ok & ~F.exists(parts, lambda p: p.startswith("."))
    return ok & (F.lower(suffix(path)).isin(ALLOWED) | text_name(path))


def text_name(path: Column) -> Column:
    """Whether a file is known as text by its name alone."""
    return F.lower(basename(path)).isin(TEXT_NAMES)


def language(path: Column, content: Column | None = None) -> Column:
    out = F.lit(None).cast("string")
    for name, suffixes in reversed(LANGUAGES.items()):
        out = F.when(F.lower(suffix(path)).isin(suffixes.split()), name).otherwise(out)
    if content is not None:
        first, by_line = F.lower(F.substring_index(content, "\n", 1)), F.lit("unknown")
        for word, name in reversed(SHEBANGS):
            by_line = F.when(first.startswith("#!") & first.contains(word), name).otherwise(by_line)
        return F.coalesce(out, by_line)
    return F.coalesce(out, F.lit("unknown"))


def config_language(path: Column) -> Column:
    """The language of the two suffixes that a workspace's settings know; null for others."""
    return F.when(F.lower(suffix(path)) == ".py", "python").when(F.lower(suffix(path)) == ".java", "java")


def category(path: Column) -> Column:
    return F.when(F.lower(path).rlike("test|spec"), "test").otherwise("implementation")


def _klass(pattern: str, at: int) -> tuple[str, int]:
    """A bracket expression from its [ on, as a regular expression; a [ that isn't closed is itself."""
    end = pattern.find("]", at + 2 if pattern[at + 1 : at + 2] != "!" else at + 3)
    if end < 0:
        return re.escape("["), at + 1
    body = pattern[at + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
    body = "^" + body[1:] if body.startswith("!") else "\\" + body if body.startswith("^") else body
    return f"[{body}]", end + 1


def fnmatch_regex(pattern: str) -> str:
    """A shell pattern over the whole relative path; * also crosses /."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "[":
            piece, i = _klass(pattern, i)
        else:
            piece, i = {"*": ".*", "?": "."}.get(c, re.escape(c)), i + 1
        out.append(piece)
    return "(?s)^" + "".join(out) + r"\z"


def glob_regex(pattern: str, anywhere: bool = False) -> str:
    """A path pattern: * and ? stay within a part, ** is any number of parts; anywhere: it may begin at any depth."""
    out = []
    parts = (["**"] if anywhere and not pattern.startswith("**/") else []) + pattern.split("/")
    for k, part in enumerate(parts):
        if part == "**":
            out.append("(?:[^/]+/)*" if k < len(parts) - 1 else "[^/]+(?:/[^/]+)*")
            continue
        i, piece = 0, []
        while i < len(part):
            if part[i] == "[":
                p, i = _klass(part, i)
            else:
                p, i = {"*": "[^/]*", "?": "[^/]"}.get(part[i], re.escape(part[i])), i + 1
            piece.append(p)
        out.append("".join(piece) + ("/" if k < len(parts) - 1 else ""))
    return "(?s)^" + "".join(out) + r"\z"


def java_regex(pattern: str, ignore_case: bool = True) -> str:
    """A Python pattern for the JVM: Unicode classes and case, . stops at line feeds only; what can't be said raises."""
    if re.search(r"\(\?\(|\(\?P=", pattern):
        raise ValueError("conditionals and named back references are not supported")
    re.compile(pattern)
    pattern = re.sub(r"\(\?P<", "(?<", pattern).replace(r"\Z", r"\z")
    return ("(?iuUd)" if ignore_case else "(?uUd)") + pattern
