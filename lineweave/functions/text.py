"""Text as the measures need it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from lineweave.functions.regex import strip

WIDTH = 255


def lines_of(text: Column) -> Column:
    """The lines of a text with universal line ends; the text after the last line end counts only if there is any."""
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n|\r", "\n"), "\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def strip_nul(text: Column) -> Column:
    return F.translate(text, "\x00", "")


def cut(text: Column, width: int = WIDTH) -> Column:
    """Cut to ``width`` characters, then drop NULs."""
    return strip_nul(F.left(text, F.lit(width)))


def collapse(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return strip(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def safe(value: Column) -> Column:
    """Any value as text that can be written: '' for null, UTF-8 with U+FFFD where bytes were none."""
    return F.coalesce(value.cast("string"), F.lit(""))


_SIGNS = {i: "_" for i in range(31)}


def shown(line: str) -> str:
    """A line as reports show it: no white space at its end, tabs to the next even column, control characters 0 to 30 as '_'."""
    return line.rstrip().expandtabs(2).replace("\n", " <\n> ").translate(_SIGNS)


def fit(text: Column, width: int, replacement: str = "...") -> Column:
    """Shorten the middle of a text to fit into ``width``."""
    tail = width // 2
    head = width - len(replacement) - tail
    return F.when((F.lit(width) <= 0) | (F.length(text) <= width), text).otherwise(F.concat(F.left(text, F.lit(head)), F.lit(replacement), F.right(text, F.lit(tail))))


def indent(line: str, size: int = 4) -> int:
    """Width of the white space a line starts with, tabs reaching to the next multiple of ``size``."""
    wide = line.expandtabs(size)
    return len(wide) - len(wide.lstrip())


def mostly_of(texts: list[str], good: str, skip: int, least: int, share: float) -> np.ndarray:
    """Whether the characters outside ``good`` stay within ``share`` of each text.

    Characters before place ``skip`` do not count; the share is looked at from place ``least`` on, at every place, and at a text's end.
    """
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    table = np.zeros(max(map(ord, good)) + 2, bool)
    table[[ord(c) for c in good]] = True
    sizes = np.array([len(x) for x in texts], np.int64)
    ends = np.cumsum(sizes)
    place = np.arange(1, len(codes) + 1) - np.repeat(ends - sizes, sizes)
    bad = ~table[np.minimum(codes, len(table) - 1)] & (place >= skip)
    total = np.cumsum(bad)
    within = total - np.repeat(np.concatenate([[0], total])[ends - sizes], sizes) if len(codes) else total
    failed = ((place >= least) | (place == np.repeat(sizes, sizes))) & (place >= skip) & (within / np.maximum(place, 1) > share)
    count = np.concatenate([[0], np.cumsum(failed)])
    return count[ends] == count[ends - sizes]
