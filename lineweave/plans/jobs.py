"""Jobs: files joined with entries, each entry run by its module and verb, results under one schema per verb.

All entries of one form share one pass: a file is listed, read, decoded and sent to Python once, whatever the number of entries that want
it, and rules that are equal are applied once. What differs between entries (tags, metadata, measure filters) is a small table that
is broadcast and joined with the rows afterwards; it is as large as the config.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineweave.functions import paths as P
from lineweave.operators import analyze, measure, routines, scan, search
from lineweave.operators.output import report_name
from lineweave.plans import metadata as MD
from lineweave.plans.config import Entry, Stack, wanted
from lineweave.plans.metadata import Metadata
from lineweave.plans.rules import Rules
from lineweave.sources import files as S


@dataclass(frozen=True)
class Result:
    """Rows of one verb: measures per file, or analysis items (searches, routines, lines)."""

    verb: str
    rows: DataFrame


def gates(rules: Rules) -> tuple:
    """How an entry wants files opened, as arguments of ``sources.files.passes``."""
    base = rules.base
    return tuple({
        "binary": base.get("IGNORE_BINARY") != "0", "largest": int(base["IGNORE_SIZE"]) if base.get("IGNORE_SIZE") else None, "path_part": base.get("IGNORE_PATH"),
        "non_code": "IGNORE_NONCODE" in base, "metadata_only": "METADATA_ONLY" in base,
    }.items())


def _own_items(texts, library=None, *, rules: Rules):
    return rules.hooks.items(scan.scanner(rules).scan(texts, library))


def form(entry: Entry, rules: Rules) -> tuple[str, str, scan.Kernel]:
    """(form, type of its values, what an entry makes of a text)."""
    if entry.module == "Document":
        return "document", measure.DOCUMENT, measure.document_counts
    if entry.module in ("DupeLines", "Depends"):
        return entry.module, analyze.GROUPED, functools.partial(analyze.grouped, rules=rules, imports=entry.module == "Depends")
    if entry.verb == "analyze":
        return "items", "array<struct<number:bigint,name:string,text:string>>", functools.partial(_own_items, rules=rules)
    if entry.verb == "search_multi":
        return "whole", search.HITS, functools.partial(search.file_hits, rules=rules)
    if entry.module == "Search":
        return "lines", search.HITS, functools.partial(search.raw_hits, rules=rules)
    if entry.verb == "search":
        return "code", search.HITS, functools.partial(search.code_hits, rules=rules)
    if entry.verb == "routines":
        return "routines", routines.CUT, functools.partial(routines.cut, rules=rules)
    if entry.module == "NBNC":
        return "nbnc", measure.COUNTED, functools.partial(measure.counted, rules=rules, checksums=False)
    return "measures", measure.COUNTED, functools.partial(measure.counted, rules=rules)


def _rows(kind: str, found: DataFrame, keep: list[str], size: Column | None) -> DataFrame:
    """The rows of one form, from (keep..., r): what its kernel said of each file and entry."""
    r = F.col("r")
    if kind == "document":
        pages = [F.col("_pages").alias("doc_pages")] if "_pages" in found.columns else []
        return found.where("not _shut or _pages is not null" if pages else "not _shut").select(*keep, *measure.document_columns(r), *pages)
    if kind == "nbnc":
        return found.select(*keep, *measure.nbnc_columns(r))
    if kind == "measures":
        return found.select(*keep, *measure.code_columns(r, size, F.col("_empties"), power=F.col("_module") == "customPowerBuilder"))
    if kind in ("lines", "code", "whole"):
        hits = scan.items(found, [*keep, F.col("r.total").alias("_t"), F.size("r.hits").cast("long").alias("_n")], F.col("r.hits"), "_x")
        columns = search.hit_columns(F.col("_x"), F.col("_t"), F.col("_n"), kind == "code")
        return hits.select(*keep, *(columns if kind == "lines" else columns[:-2] if kind == "code" else columns[2:5]))
    one = scan.items(found, keep, r, "_x")
    x, name = F.col("_x"), F.col("name")
    if kind == "routines":
        return one.select(*keep, *routines.routine_columns(x))
    if kind == "items":
        return one.select(*keep, x["number"].alias("item_linenum"), x["name"].alias("item_name"), x["text"].alias("item_text"))
    per_file = [F.create_map(name, F.array("folder")).alias("files"), F.create_map(name, x["numbers"]).alias("file_lines"), F.create_map(name, x["count"]).alias("file_line_count")]
    columns, head, maps = (analyze.repeated_columns(x), "dupeline", per_file) if kind == "DupeLines" else (analyze.import_columns(x), "depend", per_file[:2])
    return one.select(*keep, *columns, *(m.alias(f"{head}_{n}") for m, n in zip(maps, ("files", "file_lines", "file_line_count"), strict=False)))


def _one_form(files: DataFrame, kind: str, ddl: str, own: dict[int, scan.Kernel], rules: dict[int, Rules], table: DataFrame, described: dict[str, Column]) -> DataFrame:
    """Rows of all entries of one form: (file_id, entry, _module, _empties, metadata..., measures...)."""
    numbers = sorted(own)
    mine = files.withColumn("_wanted", F.array_intersect("_wanted", F.array(*(F.lit(n) for n in numbers)))).where(F.size("_wanted") > 0)
    if "text" in files.columns:
        shut, text = F.array().cast("array<int>"), F.col("text")
    else:
        alike: dict[tuple, list[int]] = {}
        for n in numbers:
            alike.setdefault(gates(rules[n]), []).append(n)
        known = {g: S.passes(**dict(g)) for g in alike}
        any_of = reduce(lambda a, b: a | b, (k & F.arrays_overlap("_wanted", F.array(*(F.lit(n) for n in ns))) for g, ns in alike.items() for k, _ in [known[g]]))
        if kind == "document":  # PDFs are no text, but their pages are counted
            any_of = any_of | (P.code_extension(F.col("name")) == "pdf")
        mine = S.seen(mine, any_of)
        shut = F.flatten(F.array(*(F.when(F.col("_seen.text").isNull() | ~(k & s), F.array(*(F.lit(n) for n in ns))).otherwise(F.array().cast("array<int>")) for g, ns in alike.items() for k, s in [known[g]])))
        text = F.col("_seen.text")
    mine = mine.withColumn("_shut_for", shut).withColumn("_text", text)
    found = mine.withColumn("_r", scan.per_entry(own, ddl, F.col("_text"), F.col("_wanted"), F.col("_shut_for"), F.lower("ext") == ".pbl" if "ext" in files.columns else F.lit(False)))
    plain = [c for c in ("name", "folder", "size") if c in files.columns]
    extra = [F.col("_seen.pages").alias("_pages")] if "text" not in files.columns and kind == "document" else []
    one = scan.items(found, ["file_id", *plain, *extra, *(c.alias("_md_" + n) for n, c in described.items()), F.col("_text").isNull().alias("_no_text"), "_shut_for"], F.col("_r"), "_e")
    one = one.select("file_id", *plain, *(["_pages"] if extra else []), *("_md_" + n for n in described), F.col("_e.entry").alias("entry"), F.col("_e.r").alias("r"), (F.col("_no_text") | F.array_contains("_shut_for", F.col("_e.entry"))).alias("_shut"))
    one = one.join(F.broadcast(table.select("entry", "_module", "_empties")), "entry")
    rows = _rows(kind, one, ["file_id", "entry", *plain, *("_md_" + n for n in described)], F.col("size").cast("long") if "size" in plain else None)
    return rows.drop(*plain)


def run(files: DataFrame, entries: list[Entry], options: tuple = (), override: list[str] | None = None, metadata: Metadata = MD.DEFAULT, stack: Stack | None = None) -> list[Result]:
    """All entries over ``files``, united per verb: rows (file_id, entry, out, metadata..., tag1..., measures that pass the entry's filter).

    With a ``stack`` its configs hold for the files below them, and ``entries`` are its default ones. Files carry ``text``, or ``content``, or
    are read by their path.
    """
    if stack:
        pairs, entries = stack.wanted(files)
    else:
        pairs = wanted(files, entries)
    if not entries:
        return []
    own_rules = {i: e.rules(options) for i, e in enumerate(entries)}
    kinds = {i: MD.with_options(metadata, own_rules[i].base) for i in own_rules}
    if any(m.folder for m in kinds.values()):
        pairs = MD.with_folder_counts(pairs.where(F.size("_wanted") > 0))
    by_verb: dict[str, dict[str, tuple[str, dict]]] = {}
    for i, e in enumerate(entries):
        name, ddl, kernel = form(e, own_rules[i])
        by_verb.setdefault("analyze " + e.module if e.verb == "analyze" else e.verb, {}).setdefault(name, (ddl, {}))[1][i] = kernel
    results = []
    for verb, forms in by_verb.items():
        own = sorted(i for _, ks in forms.values() for i in ks)
        described: dict[str, Column] = {}
        for i in own:
            described |= {n: c for n, c in MD.columns(kinds[i], pairs.columns).items() if n not in described}
        table = _entry_table(files, entries, own, own_rules, kinds, list(described), pairs.columns)
        parts = [_one_form(pairs, name, ddl, ks, own_rules, table, described) for name, (ddl, ks) in forms.items()]
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        makes = {i: set(part.columns) - (set() if entries[i].module == "customPowerBuilder" else {"file_pb_bin_lines", "file_pb_gen_lines"}) for part, (_, ks) in zip(parts, forms.values(), strict=True) for i in ks}
        results.append(Result(verb, _filtered(rows, entries, own, own_rules, override, kinds, table, list(described), makes)))
    return results


def _entry_table(files: DataFrame, entries: list[Entry], own: list[int], rules: dict[int, Rules], kinds: dict[int, Metadata], described: list[str], available: list[str]) -> DataFrame:
    """One row per entry: what its rows carry besides measures."""
    most = max((len(entries[i].plain_tags) for i in own if kinds[i].tags), default=0)
    rows = []
    for i in own:
        e, tags = entries[i], entries[i].plain_tags if kinds[i].tags else ()
        has = set(MD.columns(kinds[i], available))
        rows.append((i, e.out, e.module, rules[i].empties, e.module if kinds[i].debug else None, str(e) if kinds[i].debug or kinds[i].dupe else None, [d for d in described if d in has], [tags[n] if n < len(tags) and tags[n] else None for n in range(most)]))
    return files.sparkSession.createDataFrame(rows, "entry int, out string, _module string, _empties boolean, _debug_module string, _debug_config string, _has array<string>, _tags array<string>")


def _filtered(rows: DataFrame, entries: list[Entry], own: list[int], rules: dict[int, Rules], override: list[str] | None, kinds: dict[int, Metadata], table: DataFrame, described: list[str], makes: dict[int, set[str]]) -> DataFrame:
    """Rows with what each entry's metadata and measure filter let pass; a column that no entry lets pass is dropped."""
    most = max((len(entries[i].plain_tags) for i in own if kinds[i].tags), default=0)
    measured = [c for c in rows.columns if c not in ("file_id", "entry") and not c.startswith("_md_") and c != "extra"]
    names = {c: report_name(c) for c in (*measured, *described)}
    filters = {i: override or ([rules[i].base["MEASURE_FILTER"]] if rules[i].base.get("MEASURE_FILTER") else list(entries[i].measure_filters)) for i in own}
    passed = {f: set(P.filter_measures(list(names.values()), list(f))) for f in {tuple(f) for f in filters.values()}}
    kept = {c: [i for i in own if (c in described or c in makes[i]) and names[c] in passed[tuple(filters[i])]] for c in names}
    out = rows.join(F.broadcast(table.drop("_module", "_empties")), "entry")
    only = lambda c, value: value if len(kept[c]) == len(own) else F.when(F.col("entry").isin(kept[c]), value)
    columns = ["file_id", "entry", "out"]
    columns += [only(d, F.when(F.array_contains("_has", d), F.col("_md_" + d))).alias(d) for d in described if kept[d] and d not in measured]
    columns += [F.get("_tags", F.lit(n)).alias(f"tag{n + 1}") for n in range(most)]
    if any(kinds[i].debug for i in own):
        columns.append(F.col("_debug_module").alias("measure_module"))
    if any(kinds[i].debug or kinds[i].dupe for i in own):
        columns.append(F.col("_debug_config").alias("measure_config"))
    columns += [only(c, F.col(c)).alias(c) for c in measured if kept[c]]
    if "extra" in rows.columns and any(rules[i].hooks and rules[i].hooks.measures for i in own):
        columns.append(F.col("extra"))
    return out.select(*columns)


def run_entry(files: DataFrame, entry: Entry, options: tuple = (), metadata: Metadata = MD.LEAST) -> DataFrame:
    """The rows of one entry over all of ``files``, whatever its file filter."""
    return run(files, [Entry(**{**entry.__dict__, "file_filters": (), "file_filter": ""})], options, ["*"], metadata)[0].rows
