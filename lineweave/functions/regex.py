"""Python regular expressions on Spark's (Java's) engine.

Rules and searches are written for Python's ``re`` with IGNORECASE and, mostly, VERBOSE. ``to_java`` rewrites them:
white space and comments outside classes go (Java's own (?x) would drop spaces inside classes too), ``[`` and ``&&``
inside classes and lone braces are escaped, named groups and the end anchor are respelt. The flags (?iUd) make case,
classes and line ends mean what they mean in Python: case ignored, Unicode classes, only line feed ends a line.
"""

from __future__ import annotations

import re
import warnings
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_QUANTIFIER = re.compile(r"\{\d*,?\d*\}")


def to_java(pattern: str, verbose: bool = True, ignore_case: bool = True) -> str:
    """The Java spelling of a Python pattern. Raises ``re.error`` for what Python would not compile."""
    _compile(pattern, verbose)
    out, i, in_class, start = [], 0, False, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            out.append(_escape(pattern[i + 1]))
            i += 2
            continue
        if in_class:
            if c == "]" and not start:
                in_class = False
                out.append(c)
            elif c == "]":
                out.append("\\]")
            elif c == "[" or (c == "&" and pattern[i + 1 : i + 2] == "&"):
                out.append("\\" + c)
            else:
                out.append(c)
            start = start and c == "^" and out[-2] == "["
        elif c == "[":
            in_class, start = True, True
            out.append(c)
        elif verbose and c.isspace():
            pass
        elif verbose and c == "#":
            while i < len(pattern) and pattern[i] != "\n":
                i += 1
        elif c == "{" and not (m := _QUANTIFIER.match(pattern, i)):
            out.append("\\{")
        elif c == "{":
            out.append("{0" + m[0][1:] if m[0].startswith("{,") and m[0] != "{,}" else m[0] if m[0] not in ("{}", "{,}") else "\\" + m[0][:-1] + "\\}")
            i = m.end() - 1
        elif c == "}":
            out.append("\\}")
        elif pattern.startswith("(?P<", i):
            name = pattern[i + 4 : pattern.index(">", i)]
            out.append(f"(?<{name.replace('_', '')}>")
            i = pattern.index(">", i)
        elif pattern.startswith("(?P=", i):
            out.append(f"\\k<{pattern[i + 4 : pattern.index(')', i)].replace('_', '')}>")
            i = pattern.index(")", i)
        else:
            out.append(c)
        i += 1
    return ("(?iUd)" if ignore_case else "(?Ud)") + "".join(out)


def _compile(pattern: str, verbose: bool) -> re.Pattern:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", FutureWarning)
        return re.compile(pattern, re.X if verbose else 0)


def _escape(c: str) -> str:
    return {"Z": "\\z", "A": "\\A", " ": "\\x20", "#": "\\x23"}.get(c, "\\" + c)


def group_count(pattern: str, verbose: bool = True) -> int:
    return _compile(pattern, verbose).groups


def first_group(text: Column, java: str, groups: int) -> Column:
    """The first capture group with something in it, stripped; '' if there is none."""
    if not groups:
        return F.lit("")
    found = [F.nullif(F.regexp_extract(text, java, g), F.lit("")) for g in range(1, groups + 1)]
    return F.coalesce(strip(F.coalesce(*found)), F.lit(""))


def strip(text: Column) -> Column:
    """Python's ``str.strip``: all Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


class Searches:
    """Positive and negative searches: the first positive that matches wins, any negative vetoes.

    ``params`` are rows (positive, raw, regex). As in the rule language, regular expressions are verbose and ignore case
    unless ``case_sensitive``.
    """

    def __init__(self, params: list[tuple[bool, str, str]], case_sensitive: bool = False) -> None:
        spell = lambda r: to_java(r, True, not case_sensitive)
        self.positive = [(raw, regex, spell(regex), group_count(regex)) for positive, raw, regex in params if positive]
        self.negative = [spell(regex) for positive, _, regex in params if not positive]

    def index(self, text: Column) -> Column:
        """Number of the winning positive search, null if none or vetoed."""
        if not self.positive:
            return F.lit(None).cast("int")
        first = reduce(lambda acc, x: acc.when(text.rlike(x[1][2]), F.lit(x[0])), enumerate(self.positive), F)
        veto = reduce(lambda a, b: a | b, (text.rlike(n) for n in self.negative), F.lit(False))
        return F.when(~veto, first) if self.negative else first

    def hit(self, text: Column) -> Column:
        return self.index(text).isNotNull()

    def pick(self, index: Column, values: list) -> Column:
        out = F.when(F.lit(False), F.lit(None))
        for i, v in enumerate(values):
            out = out.when(index == i, v)
        return out

    def regex(self, index: Column, width: int = 255) -> Column:
        return self.pick(index, [F.lit(p[1][:width]) for p in self.positive])

    def raw(self, index: Column) -> Column:
        return self.pick(index, [F.lit(p[0]) for p in self.positive])

    def match(self, index: Column, text: Column) -> Column:
        return self.pick(index, [first_group(text, p[2], p[3]) for p in self.positive])
