"""Analyses over code lines: imports and repeated lines of a file or of all files."""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineweave.functions import match as M
from lineweave.operators import scan
from lineweave.plans import rules as R
from lineweave.plans.rules import Rules

GROUPED = "array<struct<line:string,crc:bigint,count:bigint,numbers:array<bigint>>>"
_ITEM = pa.struct([("line", pa.string()), ("crc", pa.int64()), ("count", pa.int64()), ("numbers", pa.list_(pa.int64()))])
LINES = "array<struct<line:string,count:bigint>>"


def _wanted(s: scan.Scanned) -> np.ndarray:
    rules = s.rules
    return s.is_comment if rules.only_comments else s.is_code | s.is_comment if rules.comments else s.is_code


def grouped(texts: pa.Array, library: pa.Array | None = None, *, rules: Rules, imports: bool) -> pa.ListArray:
    """The lines of each file, white space collapsed, that are alike as one item with their numbers, in order of their lower case.

    Repeated lines are alike by CRC-32, imports by their text.
    """
    s = scan.scanner(rules).scan(texts, library)
    keep = _wanted(s)
    at = s.some(keep)
    plain = [" ".join(x.split()) for x in s.lines.take(pa.array(at)).to_pylist()]
    if imports:
        lines = pa.array(plain, pa.string())
        hit = M.pattern(rules.imports).mask(lines, M.beyond_ascii(lines))
        keep &= np.isin(s.ids, at[hit])
    names = dict(zip(at.tolist(), plain, strict=True))
    sums = {i: zlib.crc32(x.encode()) for i, x in names.items()}
    rows, cuts = scan.chosen(keep, s.offsets)
    ids, number, out = s.ids[rows].tolist(), s.number[rows].tolist(), []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        own: dict = {}
        for i, n in zip(ids[a:b], number[a:b], strict=True):
            own.setdefault(names[i] if imports else sums[i], (names[i], sums[i], []))[2].append(n)
        out.append([{"line": x, "crc": c, "count": len(ns), "numbers": ns} for x, c, ns in sorted(own.values(), key=lambda v: v[0].lower())])
    return pa.array(out, pa.list_(_ITEM))


def counted_lines(texts: pa.Array, library: pa.Array | None = None, *, rules: Rules) -> pa.ListArray:
    """The different code lines of each file, white space collapsed, with their number."""
    s = scan.scanner(rules).scan(texts, library)
    keep = _wanted(s)
    at = s.some(keep)
    names = dict(zip(at.tolist(), (" ".join(x.split()) for x in s.lines.take(pa.array(at)).to_pylist()), strict=True))
    rows, cuts = scan.chosen(keep, s.offsets)
    ids, out = s.ids[rows].tolist(), []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        own: dict[str, int] = {}
        for i in ids[a:b]:
            own[names[i]] = own.get(names[i], 0) + 1
        out.append([{"line": x, "count": n} for x, n in own.items()])
    return pa.array(out, pa.list_(pa.struct([("line", pa.string()), ("count", pa.int64())])))


def _items(files: DataFrame, kernel, ddl: str, keep: list[str]) -> DataFrame:
    return scan.items(files.withColumn("_a", scan.per_file(kernel, ddl, F.col("text"))), keep, F.col("_a"), "_x")


def import_columns(x: Column) -> list[Column]:
    return [x["line"].alias("depend_using"), x["count"].alias("depend_count"), x["numbers"].alias("line_numbers")]


def repeated_columns(x: Column) -> list[Column]:
    return [x["crc"].alias("dupeline_crc"), x["line"].alias("dupeline_content"), x["count"].alias("dupeline_count"), x["numbers"].alias("line_numbers")]


def imports(files: DataFrame, rules: Rules = R.CODE, keep: list[str] = ("file_id",)) -> DataFrame:
    """(keep..., depend_using, depend_count, line_numbers): import statements of each file, in order of their lower case."""
    return _items(files, functools.partial(grouped, rules=rules, imports=True), GROUPED, keep).select(*keep, *import_columns(F.col("_x")))


def repeated_lines(files: DataFrame, rules: Rules = R.CODE, keep: list[str] = ("file_id",)) -> DataFrame:
    """(keep..., dupeline_crc, dupeline_content, dupeline_count, line_numbers): every distinct code line of each file, by CRC-32, in order of its lower case."""
    return _items(files, functools.partial(grouped, rules=rules, imports=False), GROUPED, keep).select(*keep, *repeated_columns(F.col("_x")))


def lines_across_files(files: DataFrame, rules: Rules = R.CODE, least: int = 1, key: str = "file_id") -> DataFrame:
    """(dupeline_content, dupeline_count, files): code lines that occur more than ``least`` times in all files together.

    A file's lines are counted in the file; what is shuffled are its different lines, partly summed before. ``key`` is unique.
    """
    lines = _items(files, functools.partial(counted_lines, rules=rules), LINES, [key])
    return lines.groupBy(F.col("_x.line").alias("dupeline_content")).agg(F.sum("_x.count").alias("dupeline_count"), F.count("*").alias("files")).where(F.col("dupeline_count") > least)
