"""Files as rows: (file_id, path, folder, name, ext, size, mtime, content) from folders or tables, and what lets them in."""

from __future__ import annotations

import difflib
import os
import re
import string
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as K

from lineweave.functions import paths as P
from lineweave.functions import text as T
from lineweave.session import checkpointed

# How files that hold no text begin, and how the text test looks at a file's first characters.
MAGIC = (b"\x7fELF", b"PK\x03\x04", b"\x1f\x8b\x08")
PDF, _PAGE = b"%PDF", re.compile(rb"/Type */Page *>")
TEXT = string.ascii_letters + string.digits + string.punctuation + string.whitespace
TEXT_WINDOW, TEXT_SKIP, TEXT_LEAST, TEXT_SHARE = 128, 4, 32, 0.2
DETECTED = 16 * 1024  # bytes of a file's start that its encoding is told by
BIG_FILE = 5_000_000

_ROUNDS, _FOLDERS_A_CORE = 6, 16
_BATCH = 1 << 25  # bytes of text that are handed on together


# -- folders -------------------------------------------------------------------------------------------------------


def _entries(folder: str) -> Iterator[tuple[str, bool, int, datetime]]:
    """(path, whether it is a folder, size, time of change) of all that lies in a folder, whatever its name begins with."""
    if "://" not in folder and not folder.startswith("file:"):
        with os.scandir(folder) as found:
            for e in sorted(found, key=lambda e: e.name):
                if e.is_dir(follow_symlinks=False):
                    yield e.path, True, 0, datetime.fromtimestamp(0, timezone.utc)
                elif e.is_file():
                    state = e.stat()
                    yield e.path, False, state.st_size, datetime.fromtimestamp(state.st_mtime, timezone.utc)
        return
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    head = folder[: len(folder) - len(path)] if folder.endswith(path) else ""
    for e in sorted(system.get_file_info(fs.FileSelector(path)), key=lambda e: e.path):
        yield head + e.path, e.type == fs.FileType.Directory, e.size or 0, e.mtime or datetime.fromtimestamp(0, timezone.utc)


_LISTED = "path string, is_folder boolean, size long, mtime timestamp"


def _list(deep: bool):
    """Lists folders, with ``deep`` all folders below them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.bool_(), pa.int64(), pa.timestamp("us", "UTC"))

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 4, kinds, strict=True)], names=["path", "is_folder", "size", "mtime"])

        rows: list[tuple] = []
        for batch in batches:
            todo = batch.column(0).to_pylist()[::-1]
            while todo:
                for row in _entries(todo.pop()):
                    if deep and row[1]:
                        todo.append(row[0])
                    else:
                        rows.append(row)
                        if len(rows) == 10_000:
                            yield out(rows)
                            rows = []
        yield out(rows)

    return run


def folder_tree(spark: SparkSession, roots: str | list[str], recursive: bool = True, glob: str | None = None, content: bool = True) -> DataFrame:
    """Files of one or several folder trees, those whose names begin with a dot or underscore included.

    Executors list the folders, level by level until there are enough to share out, then each the trees below its own. Links to folders are not
    followed. ``content`` is read only where it is used; without it ``opened`` reads the files that pass its gates by themselves.
    """
    tops = [roots] if isinstance(roots, str) else list(roots)
    tops = [t if "://" in t or t.startswith("file:") else os.path.abspath(t) for t in tops]
    enough = _FOLDERS_A_CORE * spark.sparkContext.defaultParallelism
    level = spark.createDataFrame([(t.rstrip("/") or "/",) for t in tops], "path string")
    if recursive:
        parts = []
        for _ in range(_ROUNDS):
            seen = checkpointed(level.repartition(spark.sparkContext.defaultParallelism).mapInArrow(_list(False), _LISTED))
            parts.append(seen.where("not is_folder"))
            level = seen.where("is_folder").select("path")
            folders = level.count()
            if not folders or folders >= enough:
                break
        if folders:
            parts.append(level.repartition(max(enough, 1)).mapInArrow(_list(True), _LISTED))
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
    else:
        found = level.mapInArrow(_list(False), _LISTED).where("not is_folder")
    found = with_names(found.select("path", "mtime", "size"))
    if glob:
        found = found.where(P.matches(F.col("name"), glob))
    return found.withColumn("content", _content(F.col("path"))) if content else found


def walk_order(files: DataFrame) -> DataFrame:
    """Files in the order of a walk: those of a folder by name before those of its child folders, which come in order."""
    return files.orderBy(F.split("folder", "/"), "name")


def with_names(files: DataFrame) -> DataFrame:
    """Adds folder, name and ext (with its dot) of ``path``; ``file_id`` from the path where there is none."""
    out = files.withColumn("folder", P.folder(F.col("path"))).withColumn("name", P.file_name(F.col("path"))).withColumn("ext", P.extension(F.col("name")))
    return out if "file_id" in files.columns else out.withColumn("file_id", F.xxhash64("path"))


def text_table(table: DataFrame, key: str, text: str, folder: Column, ext: Column) -> DataFrame:
    """A table of texts as files: one row per key, (file_id, path, folder, name, ext, size, text)."""
    name = F.concat(F.col(key).cast("string"), F.when(F.coalesce(ext, F.lit("")) == "", "").otherwise(F.concat(F.lit("."), ext)))
    where = F.coalesce(folder, F.lit(""))
    return table.select(F.col(key).alias("file_id"), F.concat(where, F.lit("/"), name).alias("path"), where.alias("folder"), name.alias("name"), P.extension(name).alias("ext"), F.octet_length(F.coalesce(text, F.lit(""))).cast("long").alias("size"), F.col(text).alias("text"))


def skip_folders(files: DataFrame, globs: list[str]) -> DataFrame:
    """Leave out files below a folder whose name matches a glob."""
    parts = F.split("folder", "/")
    return files.where(~F.exists(parts, lambda x: P.matches_any(x, list(globs)))) if globs else files


def include_folders(files: DataFrame, globs: list[str]) -> DataFrame:
    """Keep files whose whole folder path matches a glob."""
    return files.where(P.matches_any(F.col("folder"), globs)) if globs else files


def select_files(files: DataFrame, only: list[str] = (), skip: list[str] = ()) -> DataFrame:
    """Keep names that pass ``only`` (all, if empty) and no filter of ``skip``."""
    out = files.where(P.matches_any(F.col("name"), list(only)))
    return out.where(~P.matches_any(F.col("name"), list(skip))) if skip else out


# -- content -------------------------------------------------------------------------------------------------------


def read(path: str) -> bytes:
    """The bytes of a file, on whatever file system its path names."""
    if "://" not in path and not path.startswith("file:"):
        with open(path, "rb") as f:
            return f.read()
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    with system.open_input_stream(inner) as f:
        return f.readall()


def probe(path: str) -> None:
    """Open a file and read one byte."""
    if "://" not in path and not path.startswith("file:"):
        with open(path, "rb") as f:
            f.read(1)
        return
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    with system.open_input_stream(inner) as f:
        f.read(1)


def _read_or_none(path: str) -> bytes | None:
    """The bytes of a file, none of one that cannot be read (``api.unreadable`` lists those)."""
    try:
        return read(path)
    except OSError:
        return None


@F.arrow_udf(K.BinaryType())
def _content(paths: pa.Array) -> pa.Array:
    return pa.array([None if p is None else _read_or_none(p) for p in paths.to_pylist()], pa.binary())


_MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
_NEVER = re.compile("[\x00-\x06\x0e-\x1a\x1c-\x1f\x7f]")  # control characters that texts do not hold


def decode(raw: bytes) -> tuple[str, bool]:
    """(text, whether it is none after all): by byte order mark, else UTF-16 where every other byte is NUL, else UTF-8 if valid (in a long
    file: if its start is), else Latin-1. What then holds control characters that no text has, at its start, is binary."""
    marked = next(((mark, name) for mark, name in _MARKS if raw.startswith(mark)), None)
    if marked:
        text = raw[len(marked[0]) :].decode(marked[1], "replace")
    elif wide := _wide(raw[:DETECTED]):
        text = raw.decode(wide, "replace")
    else:
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError as e:
            late = e.start >= DETECTED - 4 or (e.start >= len(raw) - 3 > 0 and e.reason == "unexpected end of data")
            text = raw.decode("utf-8", "replace") if late else raw.decode("latin-1")
    return text, bool(_NEVER.search(text, 0, DETECTED))


def _wide(start: bytes) -> str | None:
    """The name of UTF-16 without a mark, where one of two bytes is mostly NUL and the other hardly ever."""
    if b"\0" in start and len(start) >= 8:
        even, odd = start[::2], start[1::2]
        shares = even.count(0) / len(even), odd.count(0) / len(odd)
        if max(shares) > 0.4 and min(shares) < 0.1:
            return "utf-16-le" if shares[1] > shares[0] else "utf-16-be"
    return None


_SEEN = K.StructType([K.StructField("text", K.StringType()), K.StructField("binary", K.BooleanType()), K.StructField("plain", K.BooleanType()), K.StructField("magic", K.BooleanType()), K.StructField("pages", K.LongType())])
_SEEN_ARROW = pa.struct([("text", pa.string()), ("binary", pa.bool_()), ("plain", pa.bool_()), ("magic", pa.bool_()), ("pages", pa.int64())])


def _seen(raws: list[bytes | None]) -> pa.StructArray:
    """What opening each file shows: its text, whether it is binary, whether its first characters are mostly text, whether it begins like an archive or program, the pages of a PDF."""
    found = [("", False) if r is None else decode(r) for r in raws]
    plain = T.mostly_of([t[:TEXT_WINDOW].replace("\0", "") for t, _ in found], TEXT, TEXT_SKIP, TEXT_LEAST, TEXT_SHARE)
    return pa.StructArray.from_arrays(
        [pa.array([None if r is None else t for r, (t, _) in zip(raws, found, strict=True)], pa.string()), pa.array([b for _, b in found], pa.bool_()), pa.array(plain), pa.array([r is not None and r.startswith(MAGIC) for r in raws], pa.bool_()), pa.array([len(_PAGE.findall(r)) if r is not None and r.startswith(PDF) else None for r in raws], pa.int64())],
        fields=list(_SEEN_ARROW),
    )


@F.arrow_udf(_SEEN)
def _seen_content(content: pa.Array) -> pa.Array:
    return _seen(content.to_pylist())


def _read_and_see(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``_seen`` of the files whose ``_read`` is set; what is handed on at a time is bounded by the files' sizes."""
    for batch in batches:
        names = batch.schema.names
        wanted, sizes, paths = (batch.column(names.index(n)).to_pylist() for n in ("_read", "size", "path"))
        begin, held = 0, 0
        for i, size in enumerate(sizes):
            held += (size or 0) if wanted[i] else 0
            if held >= _BATCH or i == len(sizes) - 1:
                part = batch.slice(begin, i + 1 - begin)
                seen = _seen([_read_or_none(p) if w else None for p, w in zip(paths[begin : i + 1], wanted[begin : i + 1], strict=True)])
                yield pa.RecordBatch.from_arrays([*part.columns, seen], names=[*names, "_seen"])
                begin, held = i + 1, 0


def seen(files: DataFrame, wanted: Column | None = None) -> DataFrame:
    """``files`` with ``_seen`` (text, binary, plain, magic) of those that are ``wanted``, from ``content`` or else read by their paths.

    Reading by path hands on no bytes, only text. Files without ``content`` need ``path`` and ``size``.
    """
    wanted = F.lit(True) if wanted is None else F.coalesce(wanted, F.lit(False))
    if "content" in files.columns:
        return files.withColumn("_seen", _seen_content(F.when(wanted, F.col("content")))).drop("content")
    marked = files.withColumn("_read", wanted)
    return marked.mapInArrow(_read_and_see, K.StructType([*marked.schema.fields, K.StructField("_seen", _SEEN)])).drop("_read")


def passes(binary: bool = True, largest: int | None = None, path_part: str | None = None, non_code: bool = False, metadata_only: bool = False) -> tuple[Column, Column]:
    """(what names and sizes say, what ``_seen`` says) on whether a file is opened."""
    if metadata_only:
        return F.lit(False), F.lit(False)
    known, shown = F.lit(True), F.lit(True)
    if largest is not None:
        known = known & (F.col("size") <= largest)
    if path_part:
        known = known & ~F.contains("path", F.lit(path_part))
    if non_code:
        known, shown = known & ~P.is_non_code(F.col("name")), shown & ~F.col("_seen.binary") & ~F.col("_seen.magic")
    if binary:
        known, shown = known & (P.code_extension(F.col("name")) != "pdf"), shown & ~F.col("_seen.binary") & F.col("_seen.plain")
    return F.coalesce(known, F.lit(True)), F.coalesce(shown, F.lit(True))


def opened(files: DataFrame, **gates) -> DataFrame:
    """``files`` with ``text`` instead of ``content``: null where the gates keep a file shut, or where it was not read. The rows stay, for their metadata."""
    known, shown = passes(**gates)
    return seen(files, known).withColumn("text", F.when(known & shown, F.col("_seen.text"))).drop("_seen")


# -- delta ---------------------------------------------------------------------------------------------------------


def _added(deleted: bool, first_character_lost: bool):
    @F.arrow_udf(K.ArrayType(K.StringType()))
    def run(new: pa.Array, old: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(new.to_pylist(), old.to_pylist(), strict=True):
            if a is None and b is None:
                out.append([])
                continue
            marks = ("+", "-") if deleted else ("+",)
            changes = [x for x in difflib.unified_diff((b or "").splitlines(True), (a or "").splitlines(True)) if x.startswith(marks) and not x.startswith(("+++", "---"))]
            out.append([x[2 if first_character_lost else 1 :].rstrip("\n") for x in changes])
        return pa.array(out, pa.list_(pa.string()))

    return run


def delta(new: DataFrame, old: DataFrame, on: str = "path", deleted: bool = False, first_character_lost: bool = False) -> DataFrame:
    """``new`` with ``text`` reduced to what is not in the file of the same ``on`` in ``old``.

    A file that ``old`` lacks stays whole; one that is equal gets no text and its ``dupe_first_path``; otherwise the
    added lines (and with ``deleted`` the removed ones) remain. ``first_character_lost`` cuts each as a known bug did. Files are
    compared by length and a hash of 64 bits; only the old texts of those that differ are moved. A null text is equal to a null text.
    """
    def state(df: DataFrame) -> Column:
        return F.struct(F.coalesce(F.length("text"), F.lit(-1)).alias("n"), F.xxhash64("text").alias("h"))

    there = old.select(F.col(on).alias("_on"), state(old).alias("_was"))
    changed = new.select(F.col(on).alias("_on"), state(new).alias("_is")).join(there, "_on").where("_is <> _was").select("_on").distinct()
    texts = old.select(F.col(on).alias("_on"), F.col("text").alias("_text")).join(changed, "_on", "left_semi")
    both = new.join(there, F.col(on) == F.col("_on"), "left").drop("_on").join(texts, F.col(on) == F.col("_on"), "left").drop("_on")
    same = F.col("_was").isNotNull() & (F.col("_was") == state(new))
    differs = F.col("_was").isNotNull() & (F.col("_was") != state(new))
    lines = _added(deleted, first_character_lost)(F.when(differs, F.col("text")), F.when(differs, F.col("_text")))
    text = F.when(differs, F.array_join(lines, "\n")).when(same, F.lit("")).otherwise(F.col("text"))
    return both.withColumns({"dupe_first_path": F.when(same, F.col(on)), "text": text}).drop("_was", "_text")
