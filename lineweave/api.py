"""Entry points: measure folders or tables of texts by a config, from Python or the command line."""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.operators import aggregate, dupes, output, powerbuilder
from lineweave.plans import config, jobs
from lineweave.plans import metadata as MD
from lineweave.session import ship
from lineweave.sources import files as S

CONFIG = "lineweave.code"  # the config file that is looked for in the measured folders and, as a default, where one works


def _selected(found: DataFrame, skip_folders: list[str], include: list[str], only: list[str], skip: list[str]) -> DataFrame:
    return S.select_files(S.include_folders(S.skip_folders(found, list(skip_folders)), list(include)), list(only), list(skip))


def measure_folders(
    spark: SparkSession, roots: list[str], entries: list[config.Entry], recursive: bool = True, skip_folders: list[str] = (), include: list[str] = (), only: list[str] = (), skip: list[str] = (), options: tuple = (), override: list[str] | None = None,
    older: str | None = None, metadata: MD.Metadata = MD.DEFAULT, nearest: str | None = None, deleted: bool = False,
) -> list[jobs.Result]:
    """Run entries over folder trees; with ``older`` (a tree with the same relative paths) over what is new in them.

    With ``nearest`` (the name of config files) each file is measured by the config in the nearest folder above it; ``entries`` hold where there is none.
    """
    ship(spark)
    found = S.folder_tree(spark, roots, recursive, content=False)
    stack = config.stack_of(found, nearest, entries, lambda p: S.read(p).decode("utf-8")) if nearest else None
    found = _selected(found, skip_folders, include, only, skip)
    if older:
        relative = lambda df, tops: df.withColumn("relative", F.coalesce(*(F.nullif(F.regexp_extract("path", f"^{re.escape(t.rstrip('/'))}/(.*)$", 1), F.lit("")) for t in tops)))
        tops = lambda ts: [os.path.abspath(t) if "://" not in t else t for t in ts]
        old = relative(S.opened(S.folder_tree(spark, older, recursive, content=False)), tops([older]))
        found = S.delta(relative(S.opened(found), tops(roots)), old, "relative", deleted)
    return jobs.run(found, entries, options, override, metadata, stack)


def measure_text(files: DataFrame, entry: str, params: list[str] = ()) -> DataFrame:
    """Run one ad-hoc entry over files that carry their text."""
    one = config.parse_entry(entry)
    return jobs.run_entry(files, replace(one, params=tuple(config.param(p, p) for p in params)))


def unreadable(files: DataFrame) -> DataFrame:
    """(path, error) of the files that cannot be opened."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                try:
                    S.probe(path)
                except OSError as e:
                    rows.append((path, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["path", "error"])

    return files.select("path").mapInArrow(run, "path string, error string")


# -- command line --------------------------------------------------------------------------------------------------


class UsageError(ValueError):
    """Arguments that mean nothing."""


@dataclass
class Options:
    """What the command line asks for."""

    roots: list[str] = field(default_factory=list)
    only: list[str] = field(default_factory=list)
    preset: config.Preset | None = None
    config_file: str | None = None
    config_info: bool = False
    entries: list[str] = field(default_factory=list)
    older: str | None = None
    deleted: bool = False
    dupes: str | None = None
    measure_filter: str | None = None
    groups: list[tuple[str, list[str] | None]] = field(default_factory=list)
    threshold: tuple[str, float] | None = None
    include: list[str] = field(default_factory=list)
    metadata: MD.Metadata = MD.DEFAULT
    recursive: bool = True
    out: str = "lineweave-out"
    out_file: str | None = None
    result: str = "csv"
    skip_folders: list[str] = field(default_factory=list)
    skip_files: list[str] = field(default_factory=list)
    skip_empty: bool = False
    job: dict[str, str | None] = field(default_factory=dict)
    totals: bool = False
    detailed: int | None = None
    break_on_error: bool = False
    quiet: bool = False
    progress: bool = False
    cores: int | None = None
    profile: bool = False
    debug: bool = False
    help: bool = False


USAGE = """lineweave [options] [folder | folder/filters | filters]...
  -a[n|d|m]            measure everything: all files, n only code, d code in detail, m only metadata
  -b                   stop at a file that cannot be read
  -c FILE, -ci, -cc "ENTRY"   config file; show what it does; one entry
  -d[d] FOLDER         only what is new against an older tree (dd: and what was deleted)
  -e [crc|N]           mark duplicates by checksum or by name and size within N bytes
  -f FILTER            measure filter (metadata: do not open files)
  -g KEY NAMES|all [NAME N]   group analysis rows; keep groups whose NAME is above N
  -i FOLDERS           only folders that match, -n do not descend
  -m OPTION            metadata: r reset, a all, b absolute path, f folder, s size, d date [FORMAT], m depth N, z debug
  -o FILE|FOLDER|stdout, -r csv|tab|txt|xml   where to and how
  -sd|-sf|-ss|-se|-sb|-sn   skip folders, files, sizes above N, empty folders, binary files, files that hold no code
  -t only totals, -v [N] totals by file type, -q quiet, -p progress, -w N cores, -y profile, -z debug
  -                    separates an option from a path"""


class _Arguments:
    """The arguments, read one by one. An option is told by its first letter."""

    def __init__(self, args: list[str]) -> None:
        self.left = list(args)

    def has_value(self) -> bool:
        return bool(self.left) and not self.left[0].startswith("-")

    def value(self, default: str | None = None) -> str:
        if self.has_value():
            return self.left.pop(0)
        if default is None:
            raise UsageError("a value is missing")
        return default

    def number(self, default: int | None = None) -> int | None:
        if default is not None and not (self.left and re.fullmatch(r"\d+", self.left[0])):
            return default
        try:
            return int(self.value())
        except ValueError as e:
            raise UsageError(str(e)) from e


def _metadata(o: Options, a: _Arguments) -> None:
    kind = a.value()[0].lower()
    now = o.metadata
    if kind == "r":
        o.metadata = MD.LEAST
    elif kind == "d":
        o.metadata = replace(now, dates=(*(now.dates or ("%Y",)), *([a.value()] if a.has_value() else [])))
    elif kind == "m":
        o.metadata = replace(now, dirs=a.number())
    else:
        every = {"b": "abs_path", "f": "folder", "s": "size", "z": "debug"}
        if kind != "a" and kind not in every:
            raise UsageError(f"metadata {kind}")
        o.metadata = replace(now, **{v: True for k, v in every.items() if kind in ("a", k)})
        if kind == "a":
            o.metadata = replace(o.metadata, dates=o.metadata.dates or ("%Y",), dirs=8)


def _skip(o: Options, kind: str, a: _Arguments) -> None:
    if kind in ("d", "f"):
        (o.skip_folders if kind == "d" else o.skip_files).extend(a.value().split(";"))
    elif kind == "s":
        o.job["IGNORE_SIZE"] = str(a.number())
    elif kind == "e":
        o.skip_empty = True
    elif kind in ("b", "n"):
        o.job["IGNORE_BINARY" if kind == "b" else "IGNORE_NONCODE"] = None
    else:
        raise UsageError(f"skip {kind!r}")


def _path(o: Options, given: str) -> None:
    """A folder, or filters of files, the first of them in the folder that is meant."""
    if "://" in given or os.path.isdir(given.rstrip("/") or "/"):
        o.roots.append(given)
        return
    for i, part in enumerate(given.split(";")):
        folder, name = os.path.split(part)
        if folder and not os.path.isdir(folder):
            raise UsageError(f"no such folder: {part}")
        o.only.append(name)
        if i == 0:
            o.roots.append(folder or ".")


def parse_arguments(args: list[str]) -> Options:
    """Options of a command line; letters count, words after them do not (-totals is -t)."""
    o, a = Options(), _Arguments(args)
    while a.left:
        word = a.left.pop(0)
        if not word.startswith("-"):
            _path(o, word)
            continue
        letter, second = word[1:2].lower(), word[2:3].lower()
        if not letter:
            if a.has_value():
                _path(o, a.value())
        elif letter == "a":
            o.preset = config.PRESETS.get("a" + second) or config.PRESETS["a"]
            o.metadata = replace(o.metadata, size=True) if second != "m" else replace(o.preset.metadata, debug=o.metadata.debug)
            o.detailed = o.detailed or 10
            o.job |= dict(o.preset.options)
            o.skip_folders += o.preset.skip_folders
            o.skip_files += o.preset.skip_files
        elif letter == "c":
            if second == "c":
                o.entries.append(a.left.pop(0) if a.left else a.value())
            elif second == "i":
                o.config_info, o.config_file = True, a.value("") or o.config_file
            else:
                o.config_file = a.value()
        elif letter == "d":
            o.deleted, o.older = second == "d", a.value()
        elif letter == "e":
            o.dupes, o.metadata = a.value("crc") if not a.left or a.left[0] == "crc" or a.left[0].isdigit() else "crc", replace(o.metadata, dupe=True)
        elif letter == "f":
            o.measure_filter = a.value()
            if o.measure_filter == "metadata":
                o.measure_filter = "*"
                o.job["METADATA_ONLY"] = None
        elif letter == "g":
            key, names = a.value(), a.value()
            o.groups.append((key, None if names.lower() == "all" else [n.strip(" '\"") for n in names.strip("[]()").split(",") if n.strip()]))
            if a.has_value() and len(a.left) > 1 and re.fullmatch(r"-?\d+(\.\d+)?", a.left[1]):
                o.threshold = (a.value(), float(a.left.pop(0)))
        elif letter == "i":
            o.include += a.value().split(";")
        elif letter == "m":
            _metadata(o, a)
        elif letter == "n":
            o.recursive = False
        elif letter == "o":
            target = a.value()
            if target.lower() == "stdout":
                o.out = "stdout"
            elif os.path.isdir(target):
                o.out = target
            else:
                folder, name = os.path.split(target)
                o.out, o.out_file = folder or o.out, name
        elif letter == "r":
            o.result = a.value().lower()
            if o.result not in (*output.DELIMITERS, "xml"):
                raise UsageError(f"result {o.result}")
        elif letter == "s":
            _skip(o, second, a)
        elif letter == "v":
            o.detailed = a.number(10)
        elif letter == "p":
            o.progress = True
            a.number(80)
        elif letter == "w":
            o.cores = a.number()
            if not 1 <= o.cores <= 1023:
                raise UsageError("1 to 1023 cores")
        elif letter == "y":
            o.profile = True
            a.number(0)
        elif letter == "z":
            o.debug = True
        elif letter in "btq":
            setattr(o, {"b": "break_on_error", "t": "totals", "q": "quiet"}[letter], True)
        elif letter in "h?":
            o.help = True
        else:
            raise UsageError(f"no such option: {word}")
    o.roots = o.roots or ["."]
    return o


def _entries(o: Options) -> tuple[list[config.Entry], str | None]:
    """(entries that hold by default, name of the config files to look for in the folders)."""
    if o.preset or o.entries:
        return [config.parse_entry(e) for e in ([o.preset.entry] if o.preset else []) + o.entries], None
    name = o.config_file or CONFIG
    if os.path.isfile(name):
        with open(name, encoding="utf-8") as f:
            return config.parse(f.read(), os.path.dirname(os.path.abspath(name))), os.path.basename(name)
    return [], os.path.basename(name)


def marked(o: Options, result: jobs.Result) -> DataFrame:
    """Measures whose files repeat an earlier one blanked, by checksum or by name and size."""
    rows = result.rows
    if o.dupes == "crc":
        found = dupes.by_key(rows, F.col("nbnc_crc") if "nbnc_crc" in rows.columns else F.lit(None).cast("string"), "file_abs_path")
    else:
        found = dupes.by_size(rows, "file_full_name", "file_bytes", "file_abs_path", F.col("entry").cast("string"), int(o.dupes))
    return dupes.blanked(found, ["file_id", "entry", "out"])


def _totals(o: Options, result: jobs.Result, rows: DataFrame) -> Iterator[str]:
    numbers = [c for c in aggregate.SUMMARY if c in rows.columns]
    totals = aggregate.summary(rows, numbers, "file_type" if o.detailed and "file_type" in rows.columns else None)
    for r in totals.where("file_type = ''").orderBy("measure").collect():
        yield f"{result.verb}\t{r.measure}\t{r.total:g}"
    if o.detailed:
        for r in aggregate.top_totals(totals.where("file_type <> ''"), o.detailed).orderBy("measure", "place").collect():
            yield f"{result.verb}\t{r.measure}\t{r.file_type}\t{r.total:g}"


def _grouped(o: Options, rows: DataFrame) -> Iterator[tuple[str, DataFrame]]:
    """(name of the report, rows) for each key that is grouped by; keys and names may be those of reports."""
    of = {output.report_name(c): c for c in rows.columns} | {c: c for c in rows.columns}
    for key, names in o.groups:
        if key in of:
            plain = rows.drop("entry", "out", "file_id")
            threshold = (of.get(o.threshold[0], o.threshold[0].replace(".", "_")), o.threshold[1]) if o.threshold else None
            yield of[key].replace("_", ""), aggregate.grouped(plain, of[key], [of[n] for n in names if n in of] if names is not None else None, threshold=threshold)


def _report(o: Options, rows: DataFrame, folder: str) -> Iterator[str]:
    if o.out == "stdout":
        yield from output.show(rows)
    elif o.result == "xml":
        output.write_rows_xml(rows, f"{o.out}/{folder}")
    else:
        output.write_routed(rows, f"{o.out}/{folder}", kind=o.result, override=o.out_file)


def run(args: list[str], spark: SparkSession | None = None) -> Iterator[str]:
    """Run a command line; the lines that it prints."""
    o = parse_arguments(args)
    if o.help:
        yield USAGE
        return
    if spark is None:
        builder = SparkSession.builder.appName("lineweave")
        if o.cores:
            builder = builder.master(f"local[{o.cores}]")
        if o.progress:
            builder = builder.config("spark.ui.showConsoleProgress", "true")
        if o.profile:
            builder = builder.config("spark.sql.pyspark.udf.profiler", "perf")
        spark = builder.getOrCreate()
    ship(spark)
    entries, nearest = _entries(o)
    if not entries and nearest is None:
        raise UsageError("nothing to do")
    tree = _selected(S.folder_tree(spark, o.roots, o.recursive, content=False), o.skip_folders, o.include, o.only, o.skip_files)
    if o.config_info:
        stack = config.stack_of(S.folder_tree(spark, o.roots, o.recursive, content=False), nearest, entries) if nearest else config.Stack(entries)
        pairs, entries = stack.joined(tree)
        for r in pairs.select("path", "entry").orderBy("path", "entry").toLocalIterator():
            yield f"{r.path}\t{entries[r.entry]}"
        return
    if o.break_on_error and (bad := unreadable(tree).first()):
        raise OSError(bad.error)
    override = o.measure_filter.split(";") if o.measure_filter else None
    options = tuple(o.job.items()) + ((("METADATA_DEBUG", None),) if o.debug else ())
    results = measure_folders(spark, o.roots, entries, o.recursive, o.skip_folders, o.include, o.only, o.skip_files, options, override, o.older, o.metadata, nearest, o.deleted)
    if not results and not o.quiet:
        yield "no config for any folder"
    for result in results:
        rows = marked(o, result) if o.dupes and result.verb in ("measure", "tempmeasure") else result.rows
        name = result.verb.replace(" ", "_")
        if o.totals:
            yield from _totals(o, result, rows)
            continue
        groups = list(_grouped(o, rows))
        for key, table in groups:
            yield from _report(o, table, f"{name}_{key}")
        if not groups:
            yield from _report(o, rows, name)
        if not o.quiet and o.out != "stdout":
            yield from _totals(o, result, rows)
    for e in entries:
        if "PB_OUTFILES" in e.rules().base:
            own = S.opened(S.select_files(tree, list(e.file_filters)))
            powerbuilder.write_kinds(own, f"{o.out if o.out != 'stdout' else '.'}/powerbuilder")
    if o.profile:
        spark.profile.show(type="perf")
    if not o.quiet:
        for r in unreadable(tree).limit(200 if o.debug else 15).collect():
            yield f"error\t{r.path}\t{r.error}"


def main(args: list[str] | None = None) -> int:
    """lineweave [options] folder...: measure folders and write one folder of reports per verb."""
    try:
        for line in run(sys.argv[1:] if args is None else args):
            print(line)
    except (UsageError, config.ConfigError, OSError) as e:
        print(f"lineweave: {e}\n\n{USAGE}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
