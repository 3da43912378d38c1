"""Queries pN_ over the test tables and, where SQL can state them, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.llm import handwritten, leakage, mojibake, packing, quantiles, secrets, topn, truncation
from lineweave.session import spread
from lineweave.session import table as stored



def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spread(stored(spark, sf, name))


PERCENTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.exposed(table(spark, sf, "search_hits")).select("hit_id")


def p1_masked(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.exposed(table(spark, sf, "search_hits"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    top = topn.top_n_per_group(table(spark, sf, "routine_rows"), "file_name", "routine_complexity", "routine_name", "routine_id", 5)
    return top.select("file_name", "routine_id")


def p2_ranked(spark: SparkSession, sf: str) -> DataFrame:
    top = topn.top_n_per_group(table(spark, sf, "routine_rows"), "file_name", "routine_complexity", "routine_name", "routine_id", 5)
    return top.select("file_name", F.col("rank").cast("long").alias("rank"), "routine_id", "routine_complexity")


def p3_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    days = quantiles.daily_summaries(table(spark, sf, "file_measures"), "file_type", "file_nbnc", "measured_at", "file_id")
    return quantiles.percentiles(quantiles.combine(days), PERCENTILES).select(F.col("grp").alias("file_type"), "n", *PERCENTILES, "rank_error")


def p3_daily(spark: SparkSession, sf: str) -> DataFrame:
    days = quantiles.daily_summaries(table(spark, sf, "file_measures"), "file_type", "file_nbnc", "measured_at", "file_id")
    return quantiles.percentiles(days, PERCENTILES).select(F.col("grp").alias("file_type"), "day", "n", *PERCENTILES, "rank_error")


def _texts_with_encodings(spark: SparkSession, sf: str) -> DataFrame:
    hits = table(spark, sf, "search_hits").select(F.lit("search_hits").alias("table_name"), F.col("hit_id").alias("row_id"), F.col("search_line").alias("text"))
    routines = table(spark, sf, "routine_rows").select(F.lit("routine_rows").alias("table_name"), F.col("routine_id").alias("row_id"), F.col("routine_name").alias("text"))
    return hits.unionByName(routines)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return mojibake.garbled_rows(_texts_with_encodings(spark, sf)).select("table_name", "row_id").distinct()


def p4_restored(spark: SparkSession, sf: str) -> DataFrame:
    return mojibake.garbled_rows(_texts_with_encodings(spark, sf))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return handwritten.not_hand_written(table(spark, sf, "file_tree"), table(spark, sf, "file_measures"))


def p5_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return handwritten.judged(table(spark, sf, "file_tree"), table(spark, sf, "file_measures")).groupBy("kind", "evidence").agg(F.count("*").alias("files"))


def p6_pack(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), table(spark, sf, "context_windows"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark")).where("literal").select("item_id", "doc_id")


def p7_reparameterised(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark")).where("not literal").select("item_id", "doc_id", "words", "replaced")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.truncated(table(spark, sf, "documents"))


def p8_sources(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.share_by_source(table(spark, sf, "documents"))


def p8_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.ends(table(spark, sf, "documents")).where("cut").groupBy("evidence").agg(F.count("*").alias("texts"))


QUERIES = {f.__name__: f for f in (p1_found, p1_masked, p2_found, p2_ranked, p3_percentiles, p3_daily, p4_found, p4_restored, p5_found, p5_kinds, p6_pack, p7_found, p7_reparameterised, p8_found, p8_sources, p8_evidence)}

_RANKED = """
SELECT file_name, row_number() OVER (PARTITION BY file_name ORDER BY routine_complexity DESC, routine_name ASC NULLS LAST, routine_id) AS rank,
       routine_id, routine_complexity
FROM (SELECT DISTINCT file_name, routine_id, routine_name, routine_complexity FROM routine_rows
      WHERE file_name IS NOT NULL AND routine_complexity IS NOT NULL AND routine_id IS NOT NULL)
QUALIFY rank <= 5"""

ORACLES = {
    "p2_ranked": _RANKED,
    "p2_found": f"SELECT file_name, routine_id FROM ({_RANKED})",
}
