"""Measures per file: line counts, densities, checksums, ranks, and measures of plain documents."""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineweave.functions import paths as P
from lineweave.functions import ranks
from lineweave.operators import scan
from lineweave.plans import rules as R
from lineweave.plans.rules import Rules

COUNTS = ("raw", "total", "ignored", "true_blank", "blank", "code", "comment", "inline", "dead", "template", "machine", "content", "code_content", "imports", "classes", "preprocessor", "routines", "decisions", "semicolons", "bin", "gen")
COUNTED = "struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ",nbnc_crc:bigint,file_crc:bigint,noted:bigint,extra:map<string,bigint>>"
_TYPE = pa.struct([(c, pa.int64()) for c in (*COUNTS, "nbnc_crc", "file_crc", "noted")] + [("extra", pa.map_(pa.string(), pa.int64()))])


def counted(texts: pa.Array, library: pa.Array | None = None, *, rules: Rules, routines: bool = False, checksums: bool = True) -> pa.StructArray:
    """The numbers of each text. Those that a rule set does not know (NBNC has three) are 0."""
    s = scan.scanner(rules).scan(texts, library)
    live, block = (s.codes & scan.LIVE) != 0, s.codes & scan._BLOCK
    has = lambda bit: (s.flags & bit) != 0
    ignored, blank, comment = has(scan.IGNORED), has(scan.BLANK), (s.codes & scan.COMMENT) != 0
    deep = rules.module != "NBNC"
    on_code, on_comment = (s.code_marks(routines) if deep else np.zeros(len(s.flags), np.int64)), s.comment_marks(not routines)
    template = (on_comment & scan.TEMPLATE) != 0
    dead = ((on_comment & scan.DEAD) != 0) & ~template
    seen, other = live & ~blank, (block != rules.measure_block) | ~comment
    content = s.sums(seen & (block == rules.content_block) & other)
    code = s.sums(s.is_code)
    code_is = lambda bit: s.sums((on_code & bit) != 0)
    inline, plain = code_is(scan.INLINE), s.sums(s.is_comment & ~template & ~dead)
    out = {
        "raw": s.raw_counts, "total": s.sums(~ignored), "ignored": s.sums(ignored & ~s.skipped), "true_blank": s.sums(has(scan.TRUE_BLANK)), "blank": s.sums(live & blank & (block == rules.measure_block)), "code": code, "comment": plain,
        "inline": inline, "dead": s.sums(dead), "template": s.sums(template), "machine": s.sums(seen & (block == R.MACHINE) & other), "content": content, "code_content": content + code,
        "imports": code_is(scan.IMPORT), "classes": code_is(scan.CLASS), "preprocessor": code_is(scan.PREPROCESSOR), "routines": code_is(scan.ROUTINE), "decisions": code_is(scan.DECISION), "noted": plain + (inline if rules.inline_is_comment else 0),
    }
    nothing = np.zeros(len(texts), np.int64)
    out |= {"semicolons": _semicolons(s) if deep else nothing, "bin": nothing, "gen": nothing}
    if rules.module == "customPowerBuilder":
        per_raw = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[s.raw_offsets])
        out |= {"bin": per_raw(s.binary), "gen": per_raw(s.generated)}
    out |= {"nbnc_crc": _code_sums(s) if checksums else nothing, "file_crc": np.array([zlib.adler32(x, 0) for x in s.texts.cast(pa.binary()).to_pylist()], np.int64) if checksums else nothing}
    extra = rules.hooks.measures(s) if rules.hooks and rules.hooks.measures else {}
    own = pa.array([[(k, int(v[i])) for k, v in extra.items()] for i in range(len(texts))] if extra else [None] * len(texts), pa.map_(pa.string(), pa.int64()))
    return pa.StructArray.from_arrays([*(pa.array(out[f.name], pa.int64()) for f in list(_TYPE)[:-1]), own], fields=list(_TYPE))


def _semicolons(s: scan.Scanned) -> np.ndarray:
    at, code, _ = s.code
    per = np.zeros(len(s.lines), np.int64)
    per[at] = np.array(pc.count_substring(code, ";"), np.int64)
    total = np.concatenate([[0], np.cumsum(np.where(s.is_code, per[s.ids], 0))])
    return np.diff(total[s.offsets])


def _code_sums(s: scan.Scanned) -> np.ndarray:
    """Adler-32 from 0 over the code lines of each file, white space collapsed."""
    at = s.some(s.is_code)
    where = np.zeros(len(s.lines), np.int64)
    where[at] = np.arange(len(at))
    plain = [" ".join(x.split()).encode() for x in s.lines.take(pa.array(at)).to_pylist()]
    rows, offsets = scan.chosen(s.is_code, s.offsets)
    used = where[s.ids[rows]].tolist()
    return np.array([zlib.adler32(b"".join([plain[i] for i in used[a:b]]), 0) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.int64)


def _positive(value: Column) -> Column:
    return F.when(value > 0, value)


def numbers(files: DataFrame, rules: Rules, text: str = "text", **more: bool) -> DataFrame:
    """``files`` with ``_n``, the struct of all counts."""
    library = F.lower("ext") == ".pbl" if "ext" in files.columns else None
    return files.withColumn("_n", scan.per_file(functools.partial(counted, rules=rules, **more), COUNTED, F.col(text), library))


def nbnc(files: DataFrame, rules: Rules = R.NBNC, keep: list[str] = ("file_id",)) -> DataFrame:
    """(keep..., file_total, file_nbnc, file_comment): lines, code lines and comment lines of every file, empty ones included."""
    return numbers(files, rules, checksums=False).select(*keep, *nbnc_columns(F.col("_n")))


def nbnc_columns(n: Column) -> list[Column]:
    return [n["total"].alias("file_total"), n["code"].alias("file_nbnc"), n["comment"].alias("file_comment")]


def code(files: DataFrame, rules: Rules = R.CODE, keep: list[str] = ("file_id",), routines: bool = False, checksums: bool = True) -> DataFrame:
    """All measures of the Code family, one row per file.

    Measures that are written only when positive are null otherwise. ``file_bytes`` is taken from ``size`` where there is
    one. With ``routines`` decisions and routines are left to the routine measures. A null or empty text has no lines.
    """
    size = F.col("size").cast("long") if "size" in files.columns else None
    power = rules.module == "customPowerBuilder"
    out = numbers(files, rules, routines=routines, checksums=checksums).select(*keep, *code_columns(F.col("_n"), size, F.lit(rules.empties), routines, checksums, F.lit(True) if power else None))
    if rules.hooks and rules.hooks.measures:
        return out.withColumn("extra", F.col("extra"))
    return out.drop("extra") if "extra" not in keep else out


def code_columns(n: Column, size: Column | None, empties: Column, routines: bool = False, checksums: bool = True, power: Column | None = None) -> list[Column]:
    ratio = F.when(n["comment"] > 0, n["code"] / n["comment"]).otherwise(0.0)
    columns = [
        n["total"].alias("file_total"),
        F.when(n["raw"] != n["total"], n["raw"]).alias("file_raw_total"),
        _positive(n["ignored"]).alias("file_ignored"),
        n["true_blank"].alias("file_blank_only"),
        n["code"].alias("file_nbnc"),
        ranks.rank(n["code"], ranks.FILE_SIZE).alias("file_nbnc_rank"),
        _positive(n["machine"]).alias("file_machine"),
        _positive(n["content"]).alias("file_content"),
        F.when((n["content"] > 0) | empties, n["code_content"]).alias("file_code_content"),
        n["blank"].alias("file_blank"),
        n["noted"].alias("file_comment"),
        _positive(n["inline"]).alias("nbnc_inline_comments"),
        _positive(n["dead"]).alias("file_dead"),
        ranks.rank(ratio, ranks.COMMENT_DENSITY).alias("file_comment_rank"),
        _positive(n["preprocessor"]).alias("nbnc_preprocessor"),
        _positive(n["template"]).alias("file_template"),
        _positive(n["imports"]).alias("nbnc_imports"),
        F.when(n["imports"] > 0, ranks.rank(n["imports"], ranks.IMPORTS)).alias("nbnc_import_rank"),
        _positive(n["classes"]).alias("nbnc_classes"),
    ]
    if not routines:
        columns += [_positive(n["decisions"]).alias("nbnc_decisions"), _positive(n["routines"]).alias("nbnc_routines")]
    if size is not None:
        columns += [size.alias("file_bytes"), byte_ratio(size, n["code"], n["machine"], n["content"]).alias("nbnc_byte_ratio")]
    columns.append(_positive(n["semicolons"]).alias("nbnc_semicolons"))
    if checksums:
        columns += [F.nullif(n[c], F.lit(0)).cast("string").alias(c) for c in ("nbnc_crc", "file_crc")]
    if power is not None:
        columns += [F.when(power, n["bin"]).alias("file_pb_bin_lines"), F.when(power, n["gen"]).alias("file_pb_gen_lines")]
    return [*columns, n["extra"].alias("extra")]


def byte_ratio(size: Column, nbnc: Column, machine: Column, content: Column) -> Column:
    """Bytes a code line, of files that are mostly code."""
    return F.when((size > 0) & (nbnc > 0) & (nbnc > F.coalesce(machine, F.lit(0))) & (nbnc > F.coalesce(content, F.lit(0))), size / nbnc)


# -- line classes --------------------------------------------------------------------------------------------------

CLASSES = ("ignored", "blank", "symbols", "other block", "template", "dead", "comment", "code")
CLASSED = "array<struct<number:bigint,line:string,line_class:string,block:int>>"


def classed(texts: pa.Array, library: pa.Array | None = None, *, rules: Rules) -> pa.ListArray:
    s = scan.scanner(rules).scan(texts, library)
    notes, has = s.comment_marks(), lambda bit: (s.flags & bit) != 0
    kind = np.select([has(scan.IGNORED), has(scan.TRUE_BLANK), has(scan.BLANK), ~(s.is_code | s.is_comment), (notes & scan.TEMPLATE) != 0, (notes & scan.DEAD) != 0, s.is_comment], range(7), 7)
    lines = pc.replace_substring_regex(s.lines.take(pa.array(s.ids)), "\n\\z", "")
    values = pa.StructArray.from_arrays([pa.array(s.number, pa.int64()), lines, pa.array(CLASSES).take(pa.array(kind.astype(np.int32))), pa.array((s.codes & scan._BLOCK).astype(np.int32))], names=["number", "line", "line_class", "block"])
    return scan.lists(s.offsets, values)


def line_classes(files: DataFrame, rules: Rules = R.CODE, keep: list[str] = ("file_id",)) -> DataFrame:
    """(keep..., line_number, line, line_class, block): every line with its class."""
    one = scan.items(files.withColumn("_c", scan.per_file(functools.partial(classed, rules=rules), CLASSED, F.col("text"))), keep, F.col("_c"), "_x")
    return one.select(*keep, F.col("_x.number").alias("line_number"), F.col("_x.line").alias("line"), F.col("_x.line_class").alias("line_class"), F.col("_x.block").alias("block"))


# -- documents -----------------------------------------------------------------------------------------------------

DOCUMENT = "struct<total:bigint,blank:bigint>"


def document_counts(texts: pa.Array, library: pa.Array | None = None) -> pa.StructArray:
    lines, counts = scan.split_lines(scan.normal_ends(texts))
    blank = np.array(pc.binary_length(pc.utf8_trim_whitespace(scan.without_nul(lines))), np.int64) == 0
    per = np.diff(np.concatenate([[0], np.cumsum(blank)])[scan.offsets_of(counts)]) if len(texts) else np.zeros(0, np.int64)
    return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(per, pa.int64())], names=["total", "blank"])


def document(files: DataFrame, keep: list[str] = ("file_id",)) -> DataFrame:
    """(keep..., file_total, file_blank, file_content): lines of plain text. Files without text (null) give no row."""
    rows = files.where(F.col("text").isNotNull()).withColumn("_n", scan.per_file(document_counts, DOCUMENT, F.col("text")))
    return rows.select(*keep, *document_columns(F.col("_n")))


def document_columns(n: Column) -> list[Column]:
    return [n["total"].alias("file_total"), n["blank"].alias("file_blank"), (n["total"] - n["blank"]).alias("file_content")]


def pdf_pages(files: DataFrame, keep: list[str] = ("file_id",)) -> DataFrame:
    """(keep..., doc_pages): page objects in a PDF's bytes."""
    return files.where(P.code_extension(F.col("name")) == "pdf").select(*keep, F.regexp_count(F.decode("content", "ISO-8859-1"), F.lit(r"/Type */Page *>")).cast("long").alias("doc_pages"))
