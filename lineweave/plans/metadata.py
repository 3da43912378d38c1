"""Metadata columns of report rows: which file a row is about, and what is known of the file without opening it."""

from __future__ import annotations

import ast
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineweave.functions import paths as P
from lineweave.functions import ranks
from lineweave.operators.joins import left_by_key
from lineweave.plans.rules import OptionError


@dataclass(frozen=True)
class Metadata:
    """Which columns a row carries besides its measures."""

    name: bool = True
    full_name: bool = True
    abs_path: bool = True
    dirs: int = 7
    tags: bool = True
    dates: tuple[str, ...] = ()
    size: bool = False
    folder: bool = False
    debug: bool = False
    dupe: bool = False


DEFAULT = Metadata()
LEAST = Metadata(full_name=False, abs_path=False, dirs=0)
ALL = Metadata(dirs=8, dates=("%Y", "%m", "%d"), size=True, folder=True, dupe=True)
_KEYS = {"NAME": "name", "FULLNAME": "full_name", "ABSPATH": "abs_path", "DIRS": "dirs", "TAGS": "tags", "DATE": "dates", "SIZE": "size", "FOLDER": "folder", "DEBUG": "debug", "DUPE": "dupe"}


def from_dict(given: dict) -> Metadata:
    """Exactly the columns that a dictionary names, as the option METADATA gives them."""
    out = Metadata(False, False, False, 0, False)
    for key, value in given.items():
        if key not in _KEYS:
            raise OptionError(f"unknown metadata {key}")
        out = replace(out, **{_KEYS[key]: int(value) if key == "DIRS" else tuple(value or ()) if key == "DATE" else True})
    return out


def with_options(base: Metadata, options: dict) -> Metadata:
    """``base`` as the options of an entry change it."""
    if options.get("METADATA"):
        try:
            base = from_dict(dict(ast.literal_eval(options["METADATA"])))
        except (ValueError, SyntaxError, TypeError) as e:
            raise OptionError(f"METADATA: {options['METADATA']!r}") from e
    if "METADATA_ALL" in options:
        base = ALL
    return replace(base, debug=True) if "METADATA_DEBUG" in options else base


# Strftime directives and their spelling in Java date patterns.
_DATES = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "b": "MMM", "B": "MMMM", "j": "DDD", "p": "a", "I": "hh", "a": "E", "A": "EEEE"}


def java_date(pattern: str) -> str:
    out, i = "", 0
    while i < len(pattern):
        if pattern[i] == "%" and i + 1 < len(pattern):
            out += _DATES.get(pattern[i + 1], "'" + pattern[i + 1] + "'")
            i += 2
        else:
            out += f"'{pattern[i]}'" if pattern[i].isalpha() else pattern[i]
            i += 1
    return out


def columns(m: Metadata, available: list[str]) -> dict[str, Column]:
    """The columns of files (path, name and, where there are such, size, mtime, dir_files) that ``m`` asks for, by name."""
    out: dict[str, Column] = {}
    ext = P.extension(F.col("name"))
    if m.name:
        out |= {"file_name": P.stem(F.col("name")), "file_type": F.when(ext == "", P.NO_EXTENSION).otherwise(ext)}
    if m.full_name or m.dupe:
        out["file_full_name"] = F.col("name")
    if m.abs_path or m.dupe:
        out["file_abs_path"] = F.col("path")
    if (m.size or m.dupe) and "size" in available:
        out["file_bytes"] = F.col("size").cast("long")
    out |= {f"dir{i}": c for i, c in enumerate(P.directories(F.col("path"), m.dirs), 1)}
    if m.folder and "dir_files" in available:
        out |= {"dir_files": F.col("dir_files"), "dir_files_rank": ranks.rank(F.col("dir_files"), ranks.FILES_IN_FOLDER)}
    if "mtime" in available:
        out |= {"file_date" + (d if len(m.dates) > 1 else ""): F.date_format("mtime", java_date(d)) for d in m.dates}
    return out


def with_folder_counts(files: DataFrame) -> DataFrame:
    """``files`` with ``dir_files``, the number of files in the same folder. Only folder names are counted; a folder of a third of all files is no hot spot."""
    counts = files.groupBy(F.col("folder").alias("_folder")).agg(F.count("*").alias("dir_files"))
    return left_by_key(files, counts, F.col("folder"), "_folder", "dir_files", F.col("path"))


def described(files: DataFrame, m: Metadata = DEFAULT, keep: list[str] = ("file_id",)) -> DataFrame:
    """(keep..., metadata columns) of files. No content is read."""
    own = with_folder_counts(files) if m.folder else files
    return own.select(*keep, *(c.alias(n) for n, c in columns(m, own.columns).items()))
