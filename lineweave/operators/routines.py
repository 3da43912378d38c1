"""Routines: a file's code cut at routine starts and block changes, with size, comments, nesting and complexity of each part."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineweave.functions import match as M
from lineweave.functions import ranks
from lineweave.functions import text as T
from lineweave.operators import scan
from lineweave.plans import rules as R
from lineweave.plans.rules import Rules

_PARTS = ("decisions", "escapes", "cases", "booleans")
_NUMBERS = ("number", "nbnc", "comments", *_PARTS, "nesting", "complexity")
_TEXTS = ("name", "line", "raw", "regex")
CUT = "array<struct<" + ",".join([f"{n}:bigint" for n in _NUMBERS] + [f"{n}:string" for n in _TEXTS]) + ",computed:boolean>>"
_ITEM = pa.struct([(n, pa.int64()) for n in _NUMBERS] + [(n, pa.string()) for n in _TEXTS] + [("computed", pa.bool_())])


def cut(texts: pa.Array, library: pa.Array | None = None, *, rules: Rules) -> pa.ListArray:
    """The routines of each text.

    A routine's size runs from save to save: its start line is measured before the previous routine is saved and so
    belongs to that one, and the first routine also gets the lines before it.
    """
    s = scan.scanner(rules).scan(texts, library)
    marks = s.code_marks(True)
    noted = s.is_comment & ((s.comment_marks(False) & scan.DEAD) == 0)
    total = lambda x: np.concatenate([[0], np.cumsum(x)]).tolist()
    code, notes = total(s.is_code), total(noted)
    parts = [total((marks & bit) != 0) for bit in (scan.DECISION, scan.ESCAPE, scan.CASE, scan.BOOLEAN)]
    decided = np.flatnonzero((marks & scan.DECISION) != 0)
    depth = np.zeros(len(s.flags), np.int64)
    depth[decided] = [T.indent(x, rules.nesting_indent) // rules.nesting_indent - rules.nesting_bias for x in s.lines.take(pa.array(s.ids[decided])).to_pylist()]
    change, start = np.flatnonzero(s.codes & scan.CHANGE), np.flatnonzero(marks & scan.START)
    at = np.concatenate([change, start])
    kind = np.concatenate([np.zeros(len(change), np.int8), np.ones(len(start), np.int8)])
    order = np.lexsort((kind, at))
    at, kind = at[order], kind[order]
    edges, block = np.searchsorted(at, s.offsets).tolist(), s.codes & scan._BLOCK
    where, kinds, sizes = at.tolist(), kind.tolist(), [0]
    rows: list[tuple] = []
    alone = rules.file_lines or rules.empties
    for file, (a, b) in enumerate(zip(s.offsets[:-1].tolist(), s.offsets[1:].tolist(), strict=True)):
        own = range(edges[file], edges[file + 1])
        if own or alone:
            _file(a, b, [(where[i], kinds[i]) for i in own], code, notes, parts, depth, block, rules, rows)
        sizes.append(len(rows))
    return scan.lists(np.array(sizes), _table(s, rows))


def _file(a: int, b: int, events: list, code: list, notes: list, parts: list, depth: np.ndarray, block: np.ndarray, rules: Rules, rows: list) -> None:
    """Add the routines of the lines ``a`` to ``b`` to ``rows``; ``events`` are block changes (0) and routine starts (1)."""
    begin, first, found, active = a, -1, False, 0
    last_code, last_notes = code[a], notes[a]
    for i, kind in [*events, (b, 2)]:
        until = i + 1 if kind == 1 else i  # the start line is measured already
        if kind == 1 or active == rules.measure_block:
            if found or rules.file_lines:
                rows.append((first, code[until] - last_code, notes[until] - last_notes, *(p[i] - p[begin] for p in parts), max(0, int(depth[begin:i].max(initial=0))), True))
                last_code, last_notes = code[until], notes[until]
            elif rules.empties:
                rows.append((-1, 0, 0, 0, 0, 0, 0, 0, False))
        if kind == 1:
            begin, first, found = i, i, True
        elif kind == 0:
            begin, first, found, active = i, -1, False, int(block[i])


def _table(s: scan.Scanned, rows: list[tuple]) -> pa.StructArray:
    rules, own = s.rules, s.own.searches
    columns = list(zip(*rows, strict=True)) or [()] * 9
    first = np.array(columns[0], np.int64)
    numbers = {n: np.array(c, np.int64) for n, c in zip(("nbnc", "comments", *_PARTS, "nesting"), columns[1:8], strict=True)}
    named = first >= 0
    lines = s.lines.take(pa.array(s.ids[first[named]])) if named.any() else pa.array([], s.lines.type)
    texts = lines.to_pylist()
    if own:
        index = own.index(lines, M.beyond_ascii(lines)).tolist()
        found = [(own.match(i, x), own.positive[i][0], own.positive[i][1]) for i, x in zip(index, texts, strict=True)]
    else:
        found = [(M.first_group(m), rules.routine, rules.routine) if (m := s.own.routine.find(x)) else ("", "", "") for x in texts]
    rest = iter([(name.strip(), x.strip(), raw[: T.WIDTH], full[: T.WIDTH]) for (name, raw, full), x in zip(found, texts, strict=True)])
    words = [next(rest) if n else (rules.no_routine, "", "", "") for n in named.tolist()]
    numbers["number"] = np.where(named, s.number[np.maximum(first, 0)] if len(s.number) else 0, 0)
    computed = np.array(columns[8], bool)
    complexity = numbers["decisions"] + (np.maximum(1, numbers["escapes"]) if rules.with_escapes else 0) + (numbers["cases"] if rules.with_cases else 0) + (numbers["booleans"] if rules.with_booleans else 0)
    numbers["complexity"] = np.where(computed, complexity, 0)
    return pa.StructArray.from_arrays([*(pa.array(numbers[n], pa.int64()) for n in _NUMBERS), *(pa.array([w[i] for w in words], pa.string()) for i in range(4)), pa.array(computed)], fields=list(_ITEM))


def routine_columns(r: Column) -> list[Column]:
    density = F.when(r["comments"] > 0, r["nbnc"] / r["comments"]).otherwise(0.0)
    some = lambda c: F.when(r["computed"], c)
    return [
        r["name"].alias("routine_name"), r["line"].alias("routine_line"), r["number"].cast("string").alias("routine_linenum"),
        some(r["decisions"]).alias("routine_c_decisions"), some(F.greatest(F.lit(1), r["escapes"])).alias("routine_c_escapes"), some(r["cases"]).alias("routine_c_cases"), some(r["booleans"]).alias("routine_c_booleans"),
        r["nbnc"].alias("routine_nbnc"), ranks.rank(r["nbnc"], ranks.ROUTINE_SIZE).alias("routine_nbnc_rank"), r["nesting"].cast("string").alias("routine_nesting"), ranks.rank(r["nesting"], ranks.NESTING).alias("routine_nesting_rank"),
        r["complexity"].alias("routine_complexity"), ranks.rank(r["complexity"], ranks.COMPLEXITY).alias("routine_complexity_rank"), some(r["comments"]).alias("routine_comments"), some(ranks.rank(density, ranks.COMMENT_DENSITY)).alias("routine_comments_rank"),
        r["raw"].alias("routine_regex"), r["regex"].alias("routine_regex_full"),
    ]


def routines(files: DataFrame, rules: Rules = R.CODE, keep: list[str] = ("file_id",)) -> DataFrame:
    """One row per routine: name, line, size, comments, nesting, complexity and their ranks.

    Complexity is decisions + escapes (at least one) + cases, as the rules say which count. Files without a routine have no
    row unless the rules group their lines as one; null and empty texts have none either way but for that group's row.
    """
    one = scan.items(files.withColumn("_r", scan.per_file(functools.partial(cut, rules=rules), CUT, F.col("text"))), keep, F.col("_r"), "_x")
    return one.select(*keep, *routine_columns(F.col("_x")))


def file_totals(parts: DataFrame, keep: list[str] = ("file_id",)) -> DataFrame:
    """(keep..., nbnc_routines, nbnc_decisions) of files from their routines."""
    return parts.groupBy(*keep).agg(F.count_if(F.col("routine_regex") != "").alias("nbnc_routines"), F.sum("routine_c_decisions").alias("nbnc_decisions"))
