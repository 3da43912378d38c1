"""Result files: delimited text and XML, routed by tag, with columns in a fixed order."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.functions import text as T

# The column order of reports, delimiters by kind, and names of columns that differ from the rule.
ORDER = (
    "dir1", "dir2", "dir3", "dir4", "dir5", "dir6", "dir7", "fileName", "fileType", "tag1", "tag2", "tag3",
    "file.nbnc", "file.comment", "file.dead", "file.machine", "file.content", "file.blank", "file.nbncRank", "file.commentRank", "dupe.nbnc",
    "routine.line", "routine.nbnc", "routine.nbncRank", "routine.complexity", "routine.complexityRank", "routine.nesting", "routine.nestingRank", "routine.name", "routine.linenum", "routine.regex",
    "search.line", "search.linenum", "search.regex", "search.match", "file.fullName", "fileAbsPath",
)
DELIMITERS = {"csv": ",", "tab": "\t", "txt": "¶"}
_FIXED = {
    "file_name": "fileName", "file_type": "fileType", "file_abs_path": "fileAbsPath", "search_regex_full": "search.regex-full", "routine_regex_full": "routine.regex-full", "file_code_content": "file.code+content",
    "dupeline_crc": "DupeLine.CRC", "dupeline_content": "DupeLine.Content", "dupeline_count": "DupeLine.Count", "dupeline_files": "DupeLine.Files", "dupeline_file_lines": "DupeLine.FileLines", "dupeline_file_line_count": "DupeLine.FileLineCount",
    "depend_using": "Depend.Using", "depend_count": "Depend.Count", "depend_files": "Depend.Files", "depend_file_lines": "Depend.FileLines", "measure_module": "measure.Module", "measure_config": "measure.Config",
}
_C = re.compile(r"^routine_c_(\w+)$")
_ITEM = re.compile(r"^(?:search_(?!total)|routine_|dupeline_|depend_|item_|line_numbers)")


def report_name(column: str) -> str:
    """The name of a column in reports: file_nbnc_rank becomes file.nbncRank."""
    if column in _FIXED:
        return _FIXED[column]
    if m := _C.match(column):
        return f"routine.c-{m[1]}"
    head, _, rest = column.partition("_")
    if not rest:
        return column
    words = rest.split("_")
    return f"{head}.{words[0]}" + "".join(w.capitalize() for w in words[1:])


def ordered(names: list[str]) -> list[str]:
    """Report columns in order: the fixed ones first, the others by name."""
    return [n for n in ORDER if n in names] + sorted(n for n in names if n not in ORDER)


def report(rows: DataFrame, drop: tuple = ("file_id", "entry", "out")) -> DataFrame:
    """Rows under report names, as strings ('' for null, as MEASURE_EMPTIES has it), in report order."""
    named = {report_name(c): c for c in rows.columns if c not in drop}
    kinds = dict(rows.dtypes)
    text = lambda c: F.to_json(c) if kinds[c].startswith(("array", "map", "struct")) else F.col(c)
    kept = [F.col(c) for c in ("_out",) if c in rows.columns]
    return rows.select(*kept, *(T.safe(text(named[n])).alias(n) for n in ordered([n for n in named if n != "_out"])))


def write_delimited(rows: DataFrame, path: str, kind: str = "csv", mode: str = "overwrite") -> None:
    """One folder of delimited files with a header, every value quoted."""
    report(rows).write.mode(mode).csv(path, sep=DELIMITERS[kind], header=True, quoteAll=True, emptyValue="", escape='"')


def write_routed(rows: DataFrame, folder: str, default: str = "lineweave", kind: str = "csv", override: str | None = None) -> None:
    """Write rows to ``folder``/out=<name>: by the column ``out`` where there is one, unless ``override`` names one target for all."""
    out = F.lit(override) if override else F.coalesce(F.col("out"), F.lit(default)) if "out" in rows.columns else F.lit(default)
    table = report(rows.withColumn("_out", out)).withColumnRenamed("_out", "out")
    table.write.mode("overwrite").partitionBy("out").csv(folder, sep=DELIMITERS[kind], header=True, quoteAll=True, emptyValue="", escape='"')


def _attributes(df: DataFrame, columns: list[str]) -> list:
    kinds = dict(df.dtypes)
    return [T.safe(F.to_json(c) if kinds[c].startswith(("array", "map", "struct")) else F.col(c)).alias("_" + report_name(c).replace("+", "-").replace("%", "")) for c in columns]


def write_xml(measures: DataFrame, items: DataFrame | None, path: str, key: str = "file_id") -> None:
    """One <file> element per row of measures with its measures as attributes and an <item> per analysis row."""
    nested = measures.select(F.col(key).alias("_k"), *_attributes(measures, [c for c in measures.columns if c != key]))
    if items is not None:
        rows = items.groupBy(F.col(key).alias("_i")).agg(F.collect_list(F.struct(*_attributes(items, [c for c in items.columns if c != key]))).alias("item"))
        nested = nested.join(rows, F.col("_k") == F.col("_i"), "left").drop("_i")
    nested.drop("_k").write.mode("overwrite").format("xml").option("rowTag", "file").option("rootTag", "files").save(path)


def write_rows_xml(rows: DataFrame, path: str) -> None:
    """Rows of a job as XML: one <file> element per file and entry, its analysis rows as <item> elements within."""
    own = [c for c in rows.columns if _ITEM.match(c)]
    parent = [c for c in rows.columns if c not in own and c not in ("file_id", "entry", "out", "extra")]
    if not own:
        write_xml(rows.select("file_id", *parent), None, path)
        return
    attributes = _attributes(rows, parent)
    items = F.collect_list(F.struct(*_attributes(rows, own))).alias("item")
    nested = rows.groupBy("file_id", "entry", *attributes).agg(items).drop("file_id", "entry")
    nested.write.mode("overwrite").format("xml").option("rowTag", "file").option("rootTag", "files").save(path)


def with_items(measures: DataFrame, items: DataFrame, key: str = "file_id", keep_files: bool = True) -> DataFrame:
    """Each analysis row with its file's measures; where both have a column, the row's own holds. Files without rows stay if ``keep_files``."""
    own = set(items.columns) - {key}
    parent = measures.select(*(c for c in measures.columns if c not in own))
    return parent.join(items, key, "left" if keep_files else "inner")


def show(rows: DataFrame, most: int | None = None) -> Iterator[str]:
    """Report rows as plain lines in the order of a walk through the folders, streamed to the caller partition by partition."""
    if "file_abs_path" in rows.columns:
        number = [F.col(c).cast("long") for c in ("search_linenum", "routine_linenum") if c in rows.columns]
        rows = rows.orderBy(F.split(F.regexp_replace("file_abs_path", "/[^/]*$", ""), "/"), "file_abs_path", *(c for c in ("entry",) if c in rows.columns), *number)
    table = report(rows)
    yield ",".join(table.columns)
    for i, r in enumerate(table.toLocalIterator()):
        if most is not None and i >= most:
            return
        yield ",".join(r)
