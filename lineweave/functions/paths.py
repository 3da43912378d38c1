"""Paths, file name filters and measure filters."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lineweave.functions.regex import to_java

# Fixed values of the rule language.
NO_EXT = "NO_EXT"
EXCLUDE = "EX:"
REGEX = "RE:"
NO_EXTENSION = ".(NoExt)"

# Extensions that hardly ever hold code. 'tgztar' stands where a missing comma joined two of them.
COMPRESSED = ("zip", "tgztar", "gz", "rar")
NON_CODE = (
    "svn", "svn-base", "scc", "cvs", "exe", "com", "bin", "dll", "dylib", "lib", "mo", "so", "ko", "a", "o", "obj", "jar", "war", "ear", "pyc", "class", "pdb", "pch", "tlb", "ocx", "cab", "msi",
    "7z", "iso", "bak", "rpm", "lha", "lhz", "csv", "tsv", "old", "rc", "resx", "doc", "docx", "dot", "dotx", "xls", "xlsx", "xlsm", "ppt", "pptx", "pdf", "rtf", "vsd", "vsx", "mdb",
    "png", "jpg", "jp2", "gif", "bmp", "tif", "tiff", "tga", "raw", "ico", "avi", "mpg", "mpeg", "m1v", "m2v", "m4v", "wmv", "dat", "flv", "avchd", "mov", "wav", "m4a", "wma", "mp2", "mp3", "aac", "swa",
    "vhd", "vmdk", "vmem", "vmss", "vmx", "vm", "er1", "ai", "eps", "dxf", "svg", "wmf", "ps", "chm", "hlp",
)


def extension(name: Column) -> Column:
    """The extension with its dot, as ``os.path.splitext`` gives it: none for a name that only starts with dots."""
    return F.regexp_extract(name, r"^\.*[^.](?:.*)?(\.[^.]*)$", 1)


def stem(name: Column) -> Column:
    return F.left(name, F.length(name) - F.length(extension(name)))


def folder(path: Column) -> Column:
    """Everything before the last slash."""
    slashed = F.translate(path, "\\", "/")
    return F.when(F.contains(slashed, F.lit("/")), F.regexp_extract(slashed, r"^(.*)/[^/]*$", 1)).otherwise("")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1)


def directories(path: Column, depth: int) -> list[Column]:
    """dir1 ... dirN: parts of the folder from the second on; '' where there is none."""
    parts = F.split(folder(path), "/")
    return [F.coalesce(F.get(parts, F.lit(i)), F.lit("")).alias(f"dir{i}") for i in range(1, depth + 1)]


def _positive(name: Column, one: str) -> Column:
    if one == NO_EXT:
        return (extension(name) == "") & ~name.startswith(".")
    if one.startswith(REGEX):
        return name.rlike(to_java(f"^(?:{one[len(REGEX):]})", verbose=False))
    body = re.sub(r"^\(\?s:|\)\\[zZ]$", "", fnmatch.translate(one))
    return name.rlike("(?is)^(?:" + body.replace("(?>", "(?>") + ")\\z")


def matches(name: Column, one: str) -> Column:
    """Whether a file name passes one filter: a glob without regard to case, NO_EXT, EX:a:b (none of them) or RE:regex (at the start)."""
    if not one:
        return F.lit(True)
    if one.startswith(EXCLUDE):
        out = F.lit(False)
        for x in one[len(EXCLUDE) :].split(":"):
            out = out | _positive(name, x)
        return ~out
    return _positive(name, one)


def matches_any(name: Column, filters: list[str]) -> Column:
    """Whether a file name passes some filter; no filters pass everything."""
    if not filters:
        return F.lit(True)
    out = F.lit(False)
    for x in filters:
        out = out | matches(name, x)
    return out


def code_extension(name: Column) -> Column:
    """The extension that decides on code: without dot, in lower case, numeric ones stripped first (a.zip.001 is zip)."""
    bare = F.regexp_replace(name, r"(?:(?<=[^.])\.\d+)+$", "")
    return F.lower(F.ltrim(extension(bare), F.lit(".")))


def is_non_code(name: Column) -> Column:
    return code_extension(name).isin(*COMPRESSED, *NON_CODE)


def filter_measures(names: list[str], filters: list[str]) -> list[str]:
    """The measures that pass: any without a dot, equal ones, and wildcards at the end in either direction."""

    def passes(name: str) -> bool:
        if "." not in name:
            return True
        return any(f == "*" or f == name or (f.endswith("*") and name.startswith(f[:-1])) or (name.endswith("*") and f.startswith(name[:-1])) for f in filters)

    return [n for n in names if passes(n)]
