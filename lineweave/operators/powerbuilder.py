"""Lines of exported or library sources of one environment: binary, generated, routine, table or code."""

from __future__ import annotations

import re
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.functions import match as M
from lineweave.functions import text as T
from lineweave.operators import scan

# What generated lines, routines and tables start and end with, and what text lines of a library are made of.
GENERATED = (r"^\s*text\(", r"^\s*column\(")
ROUTINES = ((r"\s+function\s+.*;", r"^end\s+function"), (r"\s+subroutine\s+.*;", r"^end\s+subroutine"), (r"\bevent\s+.*;", r"^end\s+event"))
TABLE = (r"^\s*table\(", r"^[^\s]+")
TEXT = string.ascii_letters + string.digits + string.whitespace + "~$\\/-_<>=():*|;,\""
WINDOW, SKIP, LEAST, SHARE = 80, 1, 15, 0.2
_TOKEN = re.compile(r"DAT\*.{0,3}", re.S)
_BEYOND = {c: None for c in range(127, 255)}

KINDS = ("bin", "gen", "routines", "tables", "code")
LINES = "array<struct<number:bigint,line:string,kind:string>>"


def left_out(raw: pa.Array, library: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(binary, generated): the raw lines that are not measured; ``library`` marks the lines of library files."""
    lines = scan.without_nul(raw)
    live = np.array(pc.binary_length(pc.utf8_trim_whitespace(lines)), np.int64) > 0
    binary = np.zeros(len(raw), bool)
    at = np.flatnonzero(live & library)
    if len(at):
        starts = []
        for line in lines.take(pa.array(at)).to_pylist():
            while "DAT*" in line:
                line = _TOKEN.sub("", line)
            starts.append(line.lstrip()[:WINDOW])
        binary[at] = ~T.mostly_of(starts, TEXT, SKIP, LEAST, SHARE)
    beyond = M.beyond_ascii(lines)
    generated = np.zeros(len(raw), bool)
    for p in GENERATED:
        generated |= M.pattern(p).mask(lines, beyond)
    return binary, generated & live & ~binary


def kinds(texts: pa.Array, library: pa.Array | None = None) -> pa.ListArray:
    """The lines of each text that a side file gets, with its kind; a line that starts a routine comes in pieces, after an empty one."""
    raw, counts = scan.split_lines(scan.normal_ends(texts))
    offsets = scan.offsets_of(counts)
    flags = np.array(library) if library is not None else np.zeros(len(texts), bool)
    binary, generated = left_out(raw, np.repeat(flags, counts))
    routines = [(re.compile(a), re.compile(b)) for a, b in ROUTINES]
    table = [re.compile(p) for p in TABLE]
    lines, out = raw.to_pylist(), []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        rows, end, in_table = [], None, False
        for i in range(a, b):
            line = lines[i].replace("\0", "").translate(_BEYOND)
            if not line.strip():
                continue
            put = lambda kind, x=None: rows.append({"number": i - a + 1, "line": (line if x is None else x).rstrip("\n"), "kind": kind})  # noqa: B023, E731
            if binary[i] or generated[i]:
                put("bin" if binary[i] else "gen")
            elif end:
                put("routines")
                end = None if end.search(line) else end
            elif end := next((e for s, e in routines if s.search(line)), None):
                put("routines", "")
                for piece in line.split(";"):
                    put("routines", piece if piece.endswith("\n") else piece + ";")
            else:
                in_table = not table[1].search(line) if in_table else bool(table[0].search(line))
                put("tables" if in_table else "code")
        out.append(rows)
    return pa.array(out, pa.list_(pa.struct([("number", pa.int64()), ("line", pa.string()), ("kind", pa.string())])))


def line_kinds(files: DataFrame, keep: list[str] = ("file_id",)) -> DataFrame:
    """(keep..., line_number, line, kind): kind is bin, gen, routines, tables or code; blank lines have none.

    Lines of library files (.pbl) whose first 80 characters are no text are binary. Routine and table are states between a
    start and an end line; each kind of routine has its own end.
    """
    one = scan.items(files.withColumn("_k", scan.per_file(kinds, LINES, F.col("text"), F.lower("ext") == ".pbl")), keep, F.col("_k"), "_x")
    return one.select(*keep, F.col("_x.number").alias("line_number"), F.col("_x.line").alias("line"), F.col("_x.kind").alias("kind"))


def write_kinds(files: DataFrame, folder: str) -> None:
    """The lines of each file and kind as text, under ``folder``/name=.../kind=..."""
    line_kinds(files, ["name"]).select("name", "kind", F.col("line").alias("value")).write.mode("overwrite").partitionBy("name", "kind").text(folder)
