"""Where a definition ends, judged by indentation alone: for source that its parser can't read.

Lines are numbered from 1 outside this module. An end is the number of the definition's last line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

# What a line begins with that goes on with the one before, and that begins another definition.
CONTINUES = (")", "]", "}", ",", "->", ":", '"""', "'''", "else:", "elif", "except:", "finally:", "catch")
BEGINS = ("class ", "def ", "import ", "from ")
#: How far each kind of block is looked at, and how long it counts if no end is found.
CLASS_REACH, CLASS_LENGTH = 1000, 200
FUNCTION_REACH, FUNCTION_LENGTH = 200, 50
OTHER_REACH, OTHER_LENGTH = 50, 30
#: Lines after a return in which a function's end is looked for, and how many belong to it otherwise.
RETURN_REACH, RETURN_LENGTH = 5, 3

PYTHON = re.compile(r"\s*(class)\s+(\w+)\s*[(:]|\s*(?:async\s+)?(def)\s+(\w+)\s*\(")


class Lines:
    """A text's lines with their indents."""

    def __init__(self, text: str):
        self.stripped = [x.strip() for x in text.split("\n")]
        self.indent = [len(x) - len(x.lstrip()) for x in text.split("\n")]

    def __len__(self) -> int:
        return len(self.stripped)

    def outside(self, i: int, base: int) -> bool:
        """Does line i stand no deeper than the base, and not go on with the line before?"""
        return bool(self.stripped[i]) and self.indent[i] <= base and not self.stripped[i].startswith(CONTINUES)

    def code(self, first: int, last: int) -> Iterator[int]:
        """Lines that are not blank, comments, or in a docstring."""
        quotes = None
        for i in range(first, min(last, len(self))):
            line = self.stripped[i]
            if quotes:
                quotes = None if quotes in line else quotes
            elif line.startswith(('"""', "'''")):
                quotes = line[:3] if line.count(line[:3]) < 2 else None
            elif line and not line.startswith("#"):
                yield i


def class_end(lines: Lines, start: int) -> int:
    """Before the next definition or import that is no deeper, or the next top-level line."""
    base = lines.indent[start - 1]
    for i in range(start + 1, min(start + CLASS_REACH, len(lines))):
        line = lines.stripped[i]
        if not line.startswith("#") and lines.indent[i] <= base and (line.startswith(BEGINS) or (not lines.indent[i] and lines.outside(i, 0))):
            return i
    return min(start + CLASS_LENGTH, len(lines))


def function_end(lines: Lines, start: int) -> int:
    """Before the next line of code that is no deeper; a return ends a function within a few lines."""
    base = lines.indent[start - 1]
    for i in lines.code(start, start + FUNCTION_REACH):
        if i > start and lines.outside(i, base):
            return i
        if lines.indent[i] > base and lines.stripped[i].startswith("return"):
            after = (j for j in range(i + 1, min(i + RETURN_REACH, len(lines))) if lines.outside(j, base))
            return next(after, min(i + RETURN_LENGTH, len(lines)))
    return min(start + FUNCTION_LENGTH, len(lines))


def block_end(lines: Lines, start: int) -> int:
    """Of any other block: before the next line that is no deeper."""
    base = lines.indent[start - 1]
    inside = range(start + 1, min(start + OTHER_REACH, len(lines)))
    return next((i for i in inside if lines.outside(i, base)), min(start + OTHER_LENGTH, len(lines)))


ENDS = {"class": class_end, "function": function_end, "method": function_end}


def python_by_lines(source: str):
    """Definitions of a Python source line by line, as symbols.python_symbols gives them; a definition inside a class's
    lines, and deeper than it, is its own."""
    lines, classes = Lines(source), []
    for i, text in enumerate(source.split("\n")):
        m = PYTHON.match(text)
        if not m:
            continue
        start, name = i + 1, m[2] or m[4]
        classes = [c for c in classes if c[1] >= start and c[2] < lines.indent[i]]
        parent = classes[-1][0] if classes else None
        kind = "class" if m[1] else "method" if parent else "function"
        end = ENDS[kind](lines, start)
        yield (name, kind, start, end, parent, [], [], [], "async" in text[: m.end()].split(), False, False)
        if kind == "class":
            classes.append((name, end, lines.indent[i]))
