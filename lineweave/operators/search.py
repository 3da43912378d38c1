"""Searches: one row per line (or file) that some positive expression matches and no negative one."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineweave.functions import match as M
from lineweave.functions import text as T
from lineweave.operators import scan
from lineweave.plans.rules import Rules, replace

HITS = "struct<total:bigint,hits:array<struct<line:string,number:bigint,match:string,raw:string,regex:string>>>"


def _hits(own: M.Searches, at: np.ndarray, tried: list[str], shown: list[str], numbers: np.ndarray, most: int | None = T.WIDTH) -> pa.StructArray:
    matches = [own.match(i, x)[:most] for i, x in zip(at.tolist(), tried, strict=True)]
    return pa.StructArray.from_arrays(
        [pa.array(shown, pa.string()), pa.array(numbers, pa.int64()), pa.array(matches, pa.string()), pa.array([own.positive[i][0] for i in at.tolist()], pa.string()), pa.array([own.positive[i][1][: T.WIDTH] for i in at.tolist()], pa.string())],
        names=["line", "number", "match", "raw", "regex"],
    )


def _of_files(totals: np.ndarray, offsets: np.ndarray, hits: pa.StructArray) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(totals, pa.int64()), scan.lists(offsets, hits)], names=["total", "hits"])


def raw_hits(texts: pa.Array, library: pa.Array | None = None, *, rules: Rules) -> pa.StructArray:
    """Hits in the raw lines, NULs aside."""
    lines, counts = scan.split_lines(scan.normal_ends(texts))
    offsets, own = scan.offsets_of(counts), rules.searches
    some, ids = scan.distinct(scan.without_nul(lines))
    index = own.index(some, M.beyond_ascii(some))[ids]
    rows, cuts = scan.chosen(index >= 0, offsets)
    tried = some.take(pa.array(ids[rows])).to_pylist()
    return _of_files(counts, cuts, _hits(own, index[rows], tried, [T.shown(x.strip()[: T.WIDTH])[: T.WIDTH] for x in tried], scan.numbers_of(offsets)[rows]))


def code_hits(texts: pa.Array, library: pa.Array | None = None, *, rules: Rules) -> pa.StructArray:
    """Hits in the lines of the measured block that the rules want, without strings and inline comments unless they want those."""
    own = rules.searches
    s = scan.scanner(replace(rules, params=())).scan(texts, library)
    wanted = s.is_comment if rules.only_comments else s.is_code | s.is_comment if rules.comments else s.is_code
    at = s.some(wanted)
    whole = s.lines.take(pa.array(at))
    text = whole if rules.strings else s.bare.take(pa.array(at))
    if not rules.comments:
        text, _ = s.own.without_inline(text)
    found = np.full(len(s.lines), -1, np.int32)
    found[at] = own.index(text, s.beyond[at])
    place = np.zeros(len(s.lines), np.int64)
    place[at] = np.arange(len(at))
    index = np.where(wanted, found[s.ids], -1)
    rows, cuts = scan.chosen(index >= 0, s.offsets)
    ids = s.ids[rows]
    return _of_files(s.raw_counts, cuts, _hits(own, index[rows], text.take(pa.array(place[ids])).to_pylist(), [x.strip()[: T.WIDTH] for x in s.lines.take(pa.array(ids)).to_pylist()], s.number[rows]))


def file_hits(texts: pa.Array, library: pa.Array | None = None, *, rules: Rules) -> pa.StructArray:
    """At most one hit a file, in its text as one."""
    whole, own = scan.without_nul(scan.normal_ends(texts)), rules.searches
    index = own.index(whole, M.beyond_ascii(whole))
    rows, cuts = scan.chosen(index >= 0, np.arange(len(texts) + 1))
    return _of_files(np.zeros(len(texts), np.int64), cuts, _hits(own, index[rows], whole.take(pa.array(rows)).to_pylist(), [""] * len(rows), np.zeros(len(rows), np.int64), None))


def _exploded(files: DataFrame, kernel, keep: list[str]) -> DataFrame:
    found = files.where(F.col("text").isNotNull()).withColumn("_s", scan.per_file(kernel, HITS, F.col("text")))
    return scan.items(found, [*keep, F.col("_s.total").alias("_total"), F.size("_s.hits").cast("long").alias("_hits")], F.col("_s.hits"), "_x")


def hit_columns(x: Column, total: Column, hits: Column, number_is_text: bool = False) -> list[Column]:
    number = x["number"].cast("string") if number_is_text else x["number"]
    return [x["line"].alias("search_line"), number.alias("search_linenum"), x["match"].alias("search_match"), x["raw"].alias("search_regex"), x["regex"].alias("search_regex_full"), total.alias("file_total"), hits.alias("search_total")]


def lines(files: DataFrame, rules: Rules, keep: list[str] = ("file_id",), totals: bool = True) -> DataFrame:
    """Search every raw line: (keep..., search_line, search_linenum, search_match, search_regex, search_regex_full[, file_total, search_total]).

    The totals of a file come with its hits, so they cost neither a shuffle nor a second pass. Files without text have no rows.
    """
    one = _exploded(files, functools.partial(raw_hits, rules=rules), keep)
    columns = hit_columns(F.col("_x"), F.col("_total"), F.col("_hits"))
    return one.select(*keep, *(columns if totals else columns[:-2]))


def whole_files(files: DataFrame, rules: Rules, keep: list[str] = ("file_id",)) -> DataFrame:
    """Search each file's text as one: at most one row per file, by the first positive expression that matches."""
    one = _exploded(files, functools.partial(file_hits, rules=rules), keep)
    return one.select(*keep, F.col("_x.match").alias("search_match"), F.col("_x.raw").alias("search_regex"), F.col("_x.regex").alias("search_regex_full"))


def code(files: DataFrame, rules: Rules, keep: list[str] = ("file_id",)) -> DataFrame:
    """Search code lines of the measured block; strings and inline comments are left out unless the rules say otherwise."""
    one = _exploded(files, functools.partial(code_hits, rules=rules), keep)
    return one.select(*keep, *hit_columns(F.col("_x"), F.col("_total"), F.col("_hits"), True)[:-2])
