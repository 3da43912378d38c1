"""The engine's queries over the test tables, by name."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.functions import paths as P
from lineweave.functions import ranks
from lineweave.operators import aggregate, analyze, dupes, measure, output, powerbuilder, routines, search
from lineweave.plans import config, jobs, metadata
from lineweave.plans import rules as R
from lineweave.session import ensure_checkpoint_dir, spread, table
from lineweave.sources import files as S
from lineweave.streaming import arrivals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# parameters are verbose expressions, so white space is written out
SEARCH = [(True, "throw", r"(?:throw\s+new|raise)\s+(\w+)"), (True, "call", r"(\w+)\(\w+\)"), (False, "cannot", "cannot")]
WHOLE = [(True, "version", r"version\s+(\d+)"), (True, "code", r"code\s+(\d+)\."), (False, "manual", r"according\s+to\s+the\s+manual")]
ROUTINES = [(True, "def", r"(?:def|func|function)\s+(\w+)"), (True, "class", r"\bclass\s+(\w+)"), (False, "async", "async")]


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files: folder = source, name = doc_id.lang."""
    return S.text_table(spread(table(spark, sf, "documents").select("doc_id", "text", "source", "lang")), "doc_id", "text", F.col("source"), F.lower("lang"))


def tree(spark: SparkSession, sf: str) -> DataFrame:
    return S.with_names(table(spark, sf, "file_tree").drop("ext", "name"))


def tree_text(spark: SparkSession, sf: str) -> DataFrame:
    return S.opened(S.with_names(spread(table(spark, sf, "file_tree").select("file_id", "path", "size", "content"))))


def once(rows: DataFrame, key: str) -> DataFrame:
    """Repeated deliveries of a key as one row: the one that was loaded last."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*(c for c in rows.columns if c != key)), "loaded_at").alias("r")).select(key, "r.*")


def by_doc(rows: DataFrame) -> DataFrame:
    return rows.withColumnRenamed("file_id", "doc_id")


# -- line measures -------------------------------------------------------------------------------------------------


@query
def nbnc_documents(spark: SparkSession, sf: str) -> DataFrame:
    return by_doc(measure.nbnc(documents(spark, sf)))


@query
def nbnc_files(spark: SparkSession, sf: str) -> DataFrame:
    return measure.nbnc(tree_text(spark, sf))


@query
def code_measures_documents(spark: SparkSession, sf: str) -> DataFrame:
    return by_doc(measure.code(documents(spark, sf)))


@query
def code_measures_files(spark: SparkSession, sf: str) -> DataFrame:
    return measure.code(tree_text(spark, sf))


@query
def python_measures_files(spark: SparkSession, sf: str) -> DataFrame:
    return measure.code(tree_text(spark, sf).where(P.matches(F.col("name"), "*.py")), R.rules_for("Code", [("PYTHON", None)]))


@query
def web_measures_files(spark: SparkSession, sf: str) -> DataFrame:
    return measure.code(tree_text(spark, sf).where(P.matches_any(F.col("name"), ["*.php", "*.js", "*.css"])), R.WEB)


@query
def delphi_measures_files(spark: SparkSession, sf: str) -> DataFrame:
    return measure.code(tree_text(spark, sf), R.DELPHI)


@query
def machine_measures_files(spark: SparkSession, sf: str) -> DataFrame:
    return measure.code(tree_text(spark, sf), R.rules_for("Code", [("MACHINE_MEASURE", None)]), checksums=False)


@query
def line_class_counts(spark: SparkSession, sf: str) -> DataFrame:
    return measure.line_classes(documents(spark, sf), keep=["file_id"]).groupBy("line_class").agg(F.count("*").alias("lines"), F.countDistinct("file_id").alias("files"))


@query
def template_measures_documents(spark: SparkSession, sf: str) -> DataFrame:
    rules = R.rules_for("Code", [], [(True, "note", r"//\s*(\w+)")])
    return by_doc(measure.code(documents(spark, sf), rules, checksums=False).select("file_id", "file_nbnc", "file_comment", "file_template", "file_dead"))


@query
def document_lines(spark: SparkSession, sf: str) -> DataFrame:
    return by_doc(measure.document(documents(spark, sf)))


@query
def file_crc_documents(spark: SparkSession, sf: str) -> DataFrame:
    return by_doc(measure.code(documents(spark, sf)).select("file_id", "file_crc"))


@query
def powerbuilder_lines_documents(spark: SparkSession, sf: str) -> DataFrame:
    return powerbuilder.line_kinds(documents(spark, sf)).groupBy("kind").agg(F.count("*").alias("lines"))


# -- searches ------------------------------------------------------------------------------------------------------


@query
def search_lines_documents(spark: SparkSession, sf: str) -> DataFrame:
    return by_doc(search.lines(documents(spark, sf), R.rules_for("Search", [], SEARCH), totals=False)).select("doc_id", "search_line", "search_linenum", "search_match", "search_regex")


@query
def search_totals_documents(spark: SparkSession, sf: str) -> DataFrame:
    rows = search.lines(documents(spark, sf), R.rules_for("Search", [], SEARCH))
    return by_doc(rows.groupBy("file_id").agg(F.max("file_total").alias("file_total"), F.max("search_total").alias("search_total"), F.count("*").alias("hits")))


@query
def search_multi_documents(spark: SparkSession, sf: str) -> DataFrame:
    return by_doc(search.whole_files(documents(spark, sf), R.rules_for("Search", [], WHOLE))).select("doc_id", "search_match", "search_regex")


@query
def search_code_documents(spark: SparkSession, sf: str) -> DataFrame:
    return by_doc(search.code(documents(spark, sf), R.rules_for("Code", [], SEARCH)))


@query
def search_comments_files(spark: SparkSession, sf: str) -> DataFrame:
    return search.code(tree_text(spark, sf), R.rules_for("Code", [("ONLY_COMMENTS", None), ("INCLUDE_COMMENTS", None)], [(True, "word", r"cannot\s+(\w+)")]))


@query
def search_by_config(spark: SparkSession, sf: str) -> DataFrame:
    entries = [e for e in config.from_table(table(spark, sf, "config_entries")) if e.verb == "search"]
    found = jobs.run(S.with_names(spread(table(spark, sf, "file_tree").select("file_id", "path", "size", "content"))), entries)
    rows = reduce(lambda a, b: a.unionByName(b, True), [r.rows for r in found])
    return rows.groupBy("entry").agg(F.count("*").alias("hits"), F.countDistinct("file_id").alias("files"))


@query
def hits_by_entry(spark: SparkSession, sf: str) -> DataFrame:
    return once(table(spark, sf, "search_hits"), "hit_id").groupBy("entry_id").agg(F.count("*").alias("hits"), F.countDistinct("file_name").alias("file_names"))


# -- routines ------------------------------------------------------------------------------------------------------


@query
def routines_documents(spark: SparkSession, sf: str) -> DataFrame:
    return by_doc(routines.routines(documents(spark, sf), R.rules_for("Code", [], ROUTINES)))


@query
def routines_files(spark: SparkSession, sf: str) -> DataFrame:
    return routines.routines(tree_text(spark, sf), R.rules_for("Code", [("ROUTINE_FILE_LINES", None)]))


@query
def routine_totals_files(spark: SparkSession, sf: str) -> DataFrame:
    return routines.file_totals(routines.routines(tree_text(spark, sf), R.CODE))


@query
def routine_ranks(spark: SparkSession, sf: str) -> DataFrame:
    rows = once(table(spark, sf, "routine_rows"), "routine_id")
    return rows.select(
        "routine_id", ranks.rank(F.col("routine_nbnc"), ranks.ROUTINE_SIZE).alias("size_rank"), ranks.rank(F.col("routine_complexity"), ranks.COMPLEXITY).alias("complexity_rank"), ranks.rank(F.col("routine_nesting").cast("int"), ranks.NESTING).alias("nesting_rank"),
        ranks.rank(F.when(F.col("routine_comments") > 0, F.col("routine_nbnc") / F.col("routine_comments")).otherwise(0.0), ranks.COMMENT_DENSITY).alias("comments_rank"),
    )


@query
def routine_complexity_parts(spark: SparkSession, sf: str) -> DataFrame:
    rows = once(table(spark, sf, "routine_rows"), "routine_id")
    return rows.select("routine_id", (F.col("routine_c_decisions") + F.greatest(F.lit(1), F.col("routine_c_escapes")) + F.col("routine_c_cases")).alias("complexity"))


# -- analyses ------------------------------------------------------------------------------------------------------


@query
def import_lines_files(spark: SparkSession, sf: str) -> DataFrame:
    return analyze.imports(tree_text(spark, sf)).withColumn("line_numbers", F.array_join("line_numbers", ","))


@query
def dupe_lines_files(spark: SparkSession, sf: str) -> DataFrame:
    return analyze.repeated_lines(tree_text(spark, sf)).withColumn("line_numbers", F.array_join("line_numbers", ","))


@query
def dupe_lines_global(spark: SparkSession, sf: str) -> DataFrame:
    return analyze.lines_across_files(documents(spark, sf))


# -- duplicates ----------------------------------------------------------------------------------------------------


@query
def dupes_by_crc(spark: SparkSession, sf: str) -> DataFrame:
    rows = once(table(spark, sf, "file_measures"), "file_id").withColumn("path", F.coalesce(F.translate("file_full_name", "\\", "/"), F.concat(F.lit("?"), F.col("file_id"))))
    return dupes.by_key(rows, F.col("file_crc")).where("dupe_first_path is not null").select("file_id", "dupe_first_path")


@query
def dupes_by_size(spark: SparkSession, sf: str) -> DataFrame:
    return dupes.by_size(tree(spark, sf)).where("dupe_first_path is not null").select("file_id", "dupe_first_path")


@query
def dupes_by_size_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return dupes.by_size(tree(spark, sf), threshold=40).where("dupe_first_path is not null").select("file_id", "dupe_first_path")


@query
def dupe_totals(spark: SparkSession, sf: str) -> DataFrame:
    return dupes.totals(dupes.by_size(tree(spark, sf)))


@query
def dupe_rows_blanked(spark: SparkSession, sf: str) -> DataFrame:
    rows = once(table(spark, sf, "file_measures"), "file_id").withColumn("path", F.coalesce(F.translate("file_full_name", "\\", "/"), F.concat(F.lit("?"), F.col("file_id"))))
    return dupes.blanked(dupes.by_key(rows, F.col("file_crc")).select("file_id", "file_name", "file_type", "file_nbnc", "file_total", "dupe_first_path"))


# -- aggregates ----------------------------------------------------------------------------------------------------


@query
def routines_by_file_name(spark: SparkSession, sf: str) -> DataFrame:
    rows = once(table(spark, sf, "routine_rows"), "routine_id").where("file_name is not null").select("file_name", "routine_id", "routine_complexity", "routine_nbnc", "routine_nesting")
    return aggregate.grouped(rows, "file_name", ["routine_complexity", "routine_nbnc", "routine_nesting"], ["routine_id"], ("aggregate_count", 3))


@query
def summary_totals(spark: SparkSession, sf: str) -> DataFrame:
    rows = once(table(spark, sf, "file_measures"), "file_id")
    return aggregate.summary(rows, ["file_bytes", "file_comment", "file_machine", "file_nbnc", "file_type"], "file_type")


@query
def summary_top(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.top_totals(summary_totals(spark, sf), 5)


@query
def comment_density(spark: SparkSession, sf: str) -> DataFrame:
    ratio = F.when(F.col("file_comment") > 0, F.col("file_nbnc") / F.col("file_comment")).otherwise(0.0)
    return once(table(spark, sf, "file_measures"), "file_id").where("file_nbnc is not null").select("file_id", ratio.alias("ratio"), ranks.rank(ratio, ranks.COMMENT_DENSITY).alias("file_comment_rank"))


@query
def byte_ratio(spark: SparkSession, sf: str) -> DataFrame:
    rows = once(table(spark, sf, "file_measures"), "file_id")
    return rows.select("file_id", measure.byte_ratio(F.col("file_bytes"), F.col("file_nbnc"), F.col("file_machine"), F.lit(0)).alias("nbnc_byte_ratio")).where("nbnc_byte_ratio is not null")


@query
def job_counts(spark: SparkSession, sf: str) -> DataFrame:
    every = tree(spark, sf)
    chosen = S.select_files(every, ["*.py", "*.js"])
    return aggregate.job_counts(chosen, every, chosen)


# -- sources, names, filters ---------------------------------------------------------------------------------------


@query
def folder_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tree(spark, sf).groupBy("folder").agg(F.count("*").alias("dir_files")).select("folder", "dir_files", ranks.rank(F.col("dir_files"), ranks.FILES_IN_FOLDER).alias("dir_files_rank"))


@query
def path_parts(spark: SparkSession, sf: str) -> DataFrame:
    kinds = metadata.Metadata(full_name=False, abs_path=False, dirs=4, dates=("%Y-%m-%d",), folder=True)
    return metadata.described(tree(spark, sf), kinds).select("file_id", "file_name", "file_type", "dir1", "dir2", "dir3", "dir4", "dir_files", "file_date")


@query
def config_matches(spark: SparkSession, sf: str) -> DataFrame:
    entries = config.from_table(table(spark, sf, "config_entries"))
    ids = F.array(*(F.lit(e.entry_id) for e in entries))
    return config.joined(tree(spark, sf), entries).select("file_id", F.get(ids, F.col("entry")).cast("long").alias("entry_id"))


@query
def config_measures(spark: SparkSession, sf: str) -> DataFrame:
    entries = [e for e in config.from_table(table(spark, sf, "config_entries")) if e.verb == "measure"]
    return jobs.run(tree(spark, sf), entries)[0].rows


@query
def report_rows(spark: SparkSession, sf: str) -> DataFrame:
    """What reports say of files: names, folders, tags and targets with the measures that each entry lets pass."""
    entries = config.parse("measure NBNC file.* *.py py OUT:py.csv\nmeasure NBNC file.total;file.nbnc *.js;*.ts web js\n")
    return jobs.run(tree(spark, sf), entries)[0].rows


@query
def skip_filters(spark: SparkSession, sf: str) -> DataFrame:
    chosen = S.select_files(S.include_folders(S.skip_folders(tree(spark, sf), ["vendor", "node_modules", "t*"]), ["*/src*", "*/lib*"]), ["*.js", "*.py", "NO_EXT"], ["*.min.js", "index.*"])
    return chosen.select("file_id", "name")


@query
def exclude_filters(spark: SparkSession, sf: str) -> DataFrame:
    return tree(spark, sf).where(P.matches(F.col("name"), "EX:*.js:*.py:*.java") & P.matches(F.col("name"), r"RE:[a-m]\w+")).select("file_id", "name")


@query
def non_code_gate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "file_tree").select("file_id", P.code_extension(F.col("name")).alias("code_ext"), P.is_non_code(F.col("name")).alias("non_code"))


@query
def text_gate(spark: SparkSession, sf: str) -> DataFrame:
    """What opening each file shows: binary control characters, a start of mostly text, an archive's or program's first bytes."""
    found = S.seen(table(spark, sf, "file_tree").select("file_id", "content"))
    return found.select("file_id", F.col("_seen.text").isNotNull().alias("was_read"), F.col("_seen.binary").alias("is_binary"), F.col("_seen.plain").alias("is_text"), F.col("_seen.magic").alias("is_archive"))


@query
def size_gate(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.opened(S.with_names(table(spark, sf, "file_tree").where("content is not null").select("file_id", "path", "size", "content")), binary=False, largest=5000)
    return rows.groupBy((F.col("text").isNotNull()).alias("opened")).agg(F.count("*").alias("files"))


@query
def measure_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = once(table(spark, sf, "file_measures"), "file_id")
    names = {c: output.report_name(c) for c in rows.columns if c not in ("file_id", "measured_at", "loaded_at")}
    kept = set(P.filter_measures(list(names.values()), ["file.nbnc*", "file.bytes"]))
    return rows.select("file_id", *(c for c, n in names.items() if n in kept))


@query
def delta_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    new = docs.where("duplicate_of is not null").select(F.col("doc_id").alias("file_id"), F.col("duplicate_of").cast("string").alias("path"), "text")
    old = docs.select(F.col("doc_id").cast("string").alias("path"), "text")
    return measure.nbnc(S.delta(new, old), keep=["file_id", "dupe_first_path"])


@query
def measures_with_hits(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    return by_doc(output.with_items(measure.nbnc(docs), search.lines(docs, R.rules_for("Search", [], SEARCH), totals=False).select("file_id", "search_linenum", "search_match"), keep_files=False))


# -- streaming -----------------------------------------------------------------------------------------------------


@query
def stream_nbnc_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents measured as they arrive; run to the end of what is there and read back."""
    ensure_checkpoint_dir(spark)
    folder = os.path.join(spark.sparkContext.getCheckpointDir(), f"stream-{uuid.uuid4()}")
    schema = table(spark, sf, "documents").schema
    # a file stream reads a folder; where a table is one file, the glob picks it from its folder
    stream = spark.readStream.schema(schema).parquet(f"{sf}/documents.parquet/" if _is_folder(spark, f"{sf}/documents.parquet") else f"{sf}/documents[.]parquet")

    def operator(s: DataFrame) -> DataFrame:
        return measure.nbnc(S.text_table(s, "doc_id", "text", F.col("source"), F.lower("lang")))

    arrivals.measured(stream, operator, f"{folder}/out", f"{folder}/state").awaitTermination()
    return by_doc(spark.read.parquet(f"{folder}/out"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
