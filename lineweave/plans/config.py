"""The rule language: which files are measured how. Parsed on the driver into entries; nothing in it is ever executed.

    verb  Module  measures  files  tag1 ... OPT:NAME:value ... OUT:file
       parameter
    verb_end
"""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.functions import paths as P
from lineweave.plans.metadata import DEFAULT, Metadata
from lineweave.plans.rules import MODULES, OptionError, Rules, rules_for

# Fixed values of the language.
MOST_ROUNDS = 10
END = {("Search", "search"): "search_end", ("Search", "search_multi"): "search_end", ("Code", "search"): "search_end", ("Code", "routines"): "routines_end", ("Code", "tempmeasure"): "tempmeasure_end"}
VERBS = {"Code": ("measure", "tempmeasure", "routines", "search"), "Search": ("search", "search_multi"), "NBNC": ("measure",), "Document": ("measure",), "DupeLines": ("analyze",), "Depends": ("analyze",)}
MEASURES = {"Code": ("file.*", "nbnc.*", "routine.*", "search.*"), "Search": ("search.*", "file.total"), "NBNC": ("file.*",), "Document": ("file.*", "doc.*"), "DupeLines": ("DupeLine.*",), "Depends": ("Depend.*",)}



@dataclass(frozen=True)
class Preset:
    """A scan of everything: its entry, options of the job, what it skips and which metadata its rows carry."""

    entry: str
    options: tuple[tuple[str, str | None], ...] = ()
    skip_folders: tuple[str, ...] = ()
    skip_files: tuple[str, ...] = ()
    metadata: Metadata = replace(DEFAULT, size=True)


_ALL_FILES = "measure NBNC file.* * OPT:IGNORE_BINARY"
_OF_CODE = {"options": (("IGNORE_SIZE", "5000000"), ("IGNORE_BINARY", None), ("IGNORE_NONCODE", None)), "skip_folders": (".?*", "cvs"), "skip_files": (".*",)}
PRESETS = {
    "a": Preset(_ALL_FILES),
    "an": Preset(_ALL_FILES, **_OF_CODE),
    "ad": Preset("measure Code * * OPT:MEASURE_EMPTIES", **_OF_CODE),
    "am": Preset(_ALL_FILES.replace("file.*", "*"), (("METADATA_ONLY", None),), metadata=replace(DEFAULT, size=True, dates=("%Y", "%m", "%d"))),
}


class ConfigError(ValueError):
    """A text that is not of the language, or entries that contradict each other."""


@dataclass(frozen=True)
class Entry:
    verb: str
    module: str
    measure_filters: tuple[str, ...]
    file_filters: tuple[str, ...]
    tags: tuple[str, ...] = ()
    options: tuple[tuple[str, str | None], ...] = ()
    params: tuple[tuple[bool, str, str], ...] = ()
    file_filter: str = ""
    entry_id: int | None = None

    def rules(self, more: tuple = ()) -> Rules:
        """Rules of the entry; options given for the whole job come first."""
        try:
            return rules_for(self.module, [*more, *self.options], list(self.params))
        except OptionError as e:
            raise ConfigError(f"{self}: {e}") from e

    @property
    def out(self) -> str | None:
        return next((t[4:] for t in self.tags if t.startswith("OUT:")), None)

    @property
    def plain_tags(self) -> tuple[str, ...]:
        return tuple(t for t in self.tags if not t.startswith("OUT:"))

    def __str__(self) -> str:
        options = " ".join(f"{n}:{v}" for n, v in self.options)
        return " ".join(x for x in (";".join(self.file_filters), self.verb, self.module, ";".join(self.measure_filters), " ".join(self.tags), options) if x)


def _tagged(items: list[str]) -> tuple[tuple[str, ...], tuple]:
    tags, options = [], []
    for item in items:
        if item.startswith("OPT:"):
            name, _, value = item[4:].partition(":")
            options.append((name, value if ":" in item[4:] else None))
        else:
            tags.append(item)
    return tuple(tags), tuple(options)


def parse_entry(line: str) -> Entry:
    parts = line.split()
    if len(parts) < 4:
        raise ConfigError(f"an entry needs verb, module, measures and files: {line!r}")
    tags, options = _tagged(parts[4:])
    return Entry(parts[0].lower(), parts[1], tuple(parts[2].split(";")), tuple(x for x in parts[3].split(";") if x), tags, options, file_filter=parts[3])


def _family(module: str) -> str:
    """The module whose verbs and measures hold: rule sets that are registered behave as Code."""
    return module if module in VERBS else "Code"


def param(line: str, raw: str) -> tuple[bool, str, str]:
    """(positive, raw, regex) of a parameter line; POSITIVE__ is the default."""
    for mark, positive in (("POSITIVE__", True), ("NEGATIVE__", False)):
        if line.startswith(mark):
            return positive, raw, line[len(mark) :]
    return True, raw, line


# -- texts ---------------------------------------------------------------------------------------------------------


def statements(text: str) -> Iterator[tuple[str, str]]:
    """(statement, its first line as written): what is left of a text without comments, blank lines and ignored parts, continued lines joined."""
    held: list[str] = []
    first, ignoring = "", False
    for written in map(str.strip, text.splitlines()):
        if held:
            held.append(written)
        elif ignoring:
            ignoring = not written.startswith("IGNORE_STOP")
            continue
        elif not written or written[0] == "#":
            continue
        elif written.startswith("IGNORE_START"):
            ignoring = True
            continue
        else:
            held, first = [written], written
        if not written.endswith("\\"):
            yield "".join(x.removesuffix("\\") for x in held), first
            held = []
    if held:
        yield "".join(x.removesuffix("\\") for x in held), first


def expanded(line: str, constants: dict[str, str]) -> str:
    """A line with the names of constants replaced, those in their values too."""
    if not constants:
        return line
    names = re.compile("|".join(re.escape(n) for n in sorted(constants, key=len, reverse=True)))
    for _ in range(MOST_ROUNDS):
        line, n = names.subn(lambda m: constants[m[0]], line)
        if not n:
            return line
    raise ConfigError(f"constants nested more than {MOST_ROUNDS} deep: {line[:200]!r}")


class _Reader:
    """Entries gathered from statements. ``KINDS`` tells what each statement is by how it looks; what is none of them is an entry, or within an entry's block a parameter."""

    KINDS = ((re.compile(r"INCLUDE:(?P<path>.+?):\s*(?P<rest>.*)$"), "include"), (re.compile(r"CONSTANT:(?P<name>.+?):(?P<value>.*)$"), "constant"))

    def __init__(self, folder: str, open_text: Callable[[str], str], validate: bool) -> None:
        self.folder, self.open_text, self.validate = folder, open_text, validate
        self.entries: list[Entry] = []
        self.constants: dict[str, str] = {}
        self.block: tuple[Entry, str, list] | None = None  # an entry, what ends its block, its parameters so far

    def read(self, text: str) -> list[Entry]:
        for statement, written in statements(text):
            found = next(((name, m) for shape, name in self.KINDS if (m := shape.match(statement))), None)
            if found:
                getattr(self, found[0])(**found[1].groupdict())
            elif self.block and re.match(self.block[1], statement):
                self.entries.append(replace(self.block[0], params=tuple(self.block[2])))
                self.block = None
            else:
                plain = expanded(statement, self.constants).partition(" #")[0]
                if self.block:
                    self.parameter(plain, written)
                else:
                    self.entry(plain)
        return self.entries

    def include(self, path: str, rest: str) -> None:
        """The entries of another text whose file filter none here has; they get the tags and options of the statement."""
        whole = path if os.path.isabs(path) else os.path.join(self.folder, path)
        tags, options = _tagged(rest.split())
        taken = {e.file_filter for e in self.entries}
        more = parse(self.open_text(whole), os.path.dirname(whole), self.open_text, self.validate)
        self.entries += [replace(e, tags=e.tags + tags, options=e.options + options) for e in more if e.file_filter not in taken]

    def constant(self, name: str, value: str) -> None:
        self.constants[name] = value

    def parameter(self, plain: str, written: str) -> None:
        one = param(plain, written)
        try:
            re.compile(one[2], re.X)
        except re.error as e:
            raise ConfigError(f"{self.block[0]}: {written}: {e}") from e
        self.block[2].append(one)

    def entry(self, plain: str) -> None:
        one = parse_entry(plain)
        if self.validate:
            _check(one)
        end = END.get((_family(one.module), one.verb))
        if end:
            self.block = (one, end, [])
        else:
            self.entries.append(one)


def parse(text: str, folder: str = "", read: Callable[[str], str] | None = None, validate: bool = True) -> list[Entry]:
    """The entries of a config text. ``read`` opens included files (default: the file system). A block that is not closed gives no entry."""
    entries = _Reader(folder, read or _read, validate).read(text)
    if validate:
        check_counts(entries)
    return entries


def _read(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _overlap(a: str, b: str) -> bool:
    return a == b or "*" in (a, b) or (a.endswith("*") and b.startswith(a[:-1])) or (b.endswith("*") and a.startswith(b[:-1]))


def _check(entry: Entry) -> None:
    if entry.module not in MODULES:
        raise ConfigError(f"unknown module {entry.module}")
    family = _family(entry.module)
    if entry.verb not in VERBS.get(family, ()):
        raise ConfigError(f"{entry.module} cannot {entry.verb}")
    if not any(_overlap(m, f) for m in MEASURES[family] for f in entry.measure_filters):
        raise ConfigError(f"{entry.module} has no measure {';'.join(entry.measure_filters)}")
    entry.rules()


def check_counts(entries: list[Entry]) -> None:
    """Refuse entries that would count a file twice: same verb, parameters and tags, a file filter in common, measures that overlap."""
    counted: dict[tuple, list[Entry]] = {}
    for e in entries:
        for f in set(e.file_filters):
            rivals = counted.setdefault((e.verb, f, frozenset(e.tags), e.params), [])
            for other in rivals:
                if any(_overlap(x, y) for x in other.measure_filters for y in e.measure_filters):
                    raise ConfigError(f"counts files twice: {other} and {e}")
            rivals.append(e)


def from_table(table: DataFrame, most: int = 10_000) -> list[Entry]:
    """Entries of a config table (a parameter table, refused beyond ``most`` rows)."""
    rows = table.orderBy("entry_id").limit(most + 1).collect()
    if len(rows) > most:
        raise ConfigError(f"more than {most} entries")
    return [Entry(r.verb, r.module, tuple(r.measure_filters or ()), tuple(r.file_filters or ()), tuple(r.tags or ()), tuple((o.name, o.value) for o in r.options or ()), tuple((p.positive, p.raw, p.regex) for p in r.params or ()), ";".join(r.file_filters or ()), r.entry_id) for r in rows]


_PLAIN = re.compile(r"\*\.([^*?\[\].]+)$")


def wanted(files: DataFrame, entries: list[Entry]) -> DataFrame:
    """``files`` with ``_wanted``: the positions of the entries whose filters a name passes, in order of the entries' text.

    Filters by extension (``*.c``), the bulk of any config, are a join with a broadcast table of extensions, no larger than the config
    (``from_table`` bounds it); all others are conditions on the name. A file is read once however many entries want it.
    """
    order = sorted(range(len(entries)), key=lambda i: str(entries[i]))
    by_ext: dict[str, set[int]] = {}
    others: list[tuple[int, list[str]]] = []
    for rank, i in enumerate(order):
        rest = [f for f in entries[i].file_filters if not _PLAIN.match(f)]
        for f in entries[i].file_filters:
            if m := _PLAIN.match(f):
                by_ext.setdefault(m[1].lower(), set()).add(rank)
        if rest or not entries[i].file_filters:
            others.append((rank, rest))
    if not entries:
        return files.withColumn("_wanted", F.array().cast("array<int>"))
    none = F.array().cast("array<int>")
    named = F.array_compact(F.array(*(F.when(P.matches_any(F.col("name"), rest), F.lit(rank)) for rank, rest in others))) if others else none
    out = files
    if by_ext:
        table = files.sparkSession.createDataFrame([(x, sorted(ranks)) for x, ranks in sorted(by_ext.items())], "_ext string, _ranks array<int>")
        last = F.when(F.contains(F.col("name"), F.lit(".")), F.lower(F.substring_index("name", ".", -1)))
        out = files.join(F.broadcast(table), last == F.col("_ext"), "left")
        named = F.array_union(F.coalesce("_ranks", none), named)
    positions = F.array(*(F.lit(i) for i in order))
    return out.withColumn("_wanted", F.transform(F.array_sort(named), lambda r: F.get(positions, r))).drop("_ext", "_ranks")


def joined(files: DataFrame, entries: list[Entry]) -> DataFrame:
    """files x entries whose filters a name passes: one row per pair, with ``entry`` (position); files that no entry wants are dropped."""
    return wanted(files, entries).withColumn("entry", F.explode("_wanted")).drop("_wanted")


@dataclass
class Stack:
    """Config texts by folder: the nearest one at or above a folder holds for it, else the default. An empty one skips its branch."""

    default: list[Entry]
    folders: dict[str, list[Entry]] = field(default_factory=dict)

    def nearest(self, folder: str) -> list[Entry]:
        at = self._place({f.rstrip("/") or "/": f for f in self.folders}, folder)
        return self.default if at is None else self.folders[at]

    @staticmethod
    def _place(known: dict, folder: str):
        while True:
            if folder in known:
                return known[folder]
            if "/" not in folder or folder == "/":
                return None
            folder = folder.rpartition("/")[0] or "/"

    def wanted(self, files: DataFrame) -> tuple[DataFrame, list[Entry]]:
        """(``files`` with ``_wanted``, entries): of the entries of its nearest config those that want a file.

        Each different folder of a batch walks up to its config in a table of config folders, as large as there are config files.
        """
        names = sorted(self.folders)
        entries, owner = list(self.default), [-1] * len(self.default)
        for i, f in enumerate(names):
            entries += self.folders[f]
            owner += [i] * len(self.folders[f])
        known, place = {f.rstrip("/") or "/": i for i, f in enumerate(names)}, self._place

        @F.arrow_udf("int")
        def nearest(folders: pa.Array) -> pa.Array:
            coded = pc.fill_null(folders, "").dictionary_encode()
            return pa.array([-1 if (at := place(known, f)) is None else at for f in coded.dictionary.to_pylist()], pa.int32()).take(coded.indices)

        out = wanted(files, entries)
        if not entries:
            return out, entries
        owners = F.array(*(F.lit(o) for o in owner))
        own = out.withColumn("_config", nearest(F.col("folder")))
        return own.withColumn("_wanted", F.filter("_wanted", lambda e: F.get(owners, e) == F.col("_config"))).drop("_config"), entries

    def joined(self, files: DataFrame) -> tuple[DataFrame, list[Entry]]:
        """(files x entries, entries): each file joined with the entries of its nearest config."""
        out, entries = self.wanted(files)
        return out.withColumn("entry", F.explode("_wanted")).drop("_wanted"), entries


def stack_of(files: DataFrame, name: str, default: list[Entry], read: Callable[[str], str] | None = None, most: int = 10_000) -> Stack:
    """The config texts called ``name`` among ``files`` (path, folder, name), with the entries that hold where there is none above."""
    found = files.where(F.col("name") == name).select("folder", "path").orderBy("path").limit(most + 1).collect()
    if len(found) > most:
        raise ConfigError(f"more than {most} config files")
    return Stack(default, {r.folder: parse((read or _read)(r.path), r.folder, read) for r in found})


def globbed(name: str, filters: list[str]) -> bool:
    """Driver-side twin of the file filters, for tests and for listing a config."""
    if not filters:
        return True
    for f in filters:
        if f.startswith(P.EXCLUDE):
            if not any(globbed(name, [x]) for x in f[len(P.EXCLUDE) :].split(":")):
                return True
        elif f == P.NO_EXT:
            if os.path.splitext(name)[1] == "" and not name.startswith("."):
                return True
        elif f.startswith(P.REGEX):
            if re.match(f[len(P.REGEX) :], name, re.I):
                return True
        elif re.match(fnmatch.translate(f), name, re.I):
            return True
    return False
