"""Totals over files and groupings of analysis rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The measures of the short summary.
SUMMARY = ("file_type", "file_nbnc", "file_comment", "file_machine", "dupe_nbnc", "file_bytes", "file_content", "file_dead", "routine_complexity", "search_total")


def summary(measured: DataFrame, measures: list[str], by: str | None = None) -> DataFrame:
    """(measure, file_type, total): numbers add up, anything else counts 1; '' as type is the total over all types.

    One pass: the measures are summed side by side in one grouping-set aggregation and turned to rows afterwards.
    """
    numeric = {f.name for f in measured.schema.fields if isinstance(f.dataType, T.NumericType)}
    sums = [(F.sum(F.col(m).cast("double")) if m in numeric else F.count(m).cast("double")).alias(f"_{i}") for i, m in enumerate(measures)]
    if by is None:
        agg = measured.agg(*sums).withColumn("_type", F.lit(""))
    else:
        agg = measured.withColumn("_by", F.coalesce(F.lower(by), F.lit(".(noext)"))).rollup("_by").agg(*sums).withColumn("_type", F.coalesce("_by", F.lit("")))
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(f"_{i}").alias("total")) for i, m in enumerate(measures))))
    return agg.select(F.col("_type").alias("file_type"), pairs.alias("x")).select("x.measure", "file_type", "x.total").where("total is not null")


def top_totals(totals: DataFrame, most: int = 10) -> DataFrame:
    """The ``most`` + 1 highest totals per measure; equal totals of a measure show once."""
    once = totals.groupBy("measure", "total").agg(F.max("file_type").alias("file_type"))
    w = Window.partitionBy("measure").orderBy(F.col("total").desc())
    return once.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= most + 1)


def grouped(rows: DataFrame, key: str, names: list[str] | None = None, order: list[str] = (), threshold: tuple[str, float] | None = None) -> DataFrame:
    """Analysis rows grouped by ``key``: numbers add up, arrays join, maps merge by key, anything else takes its last value in ``order``
    (without one: the greatest value, so that the answer does not depend on partitions); ``aggregate_count`` counts.

    ``names`` are the columns to aggregate (all but the key and ``order``, if None). With ``threshold`` (name, n) only groups stay
    whose value of that name exceeds n.
    """
    fields = {f.name: f.dataType for f in rows.schema.fields}
    names = [n for n in fields if n != key and n not in order] if names is None else names
    when = F.struct(*order) if order else F.lit(0)
    out = []
    for n in names:
        kind = fields[n]
        if isinstance(kind, T.NumericType):
            out.append(F.sum(n).alias(n))
        elif isinstance(kind, T.ArrayType):
            out.append(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(when.alias("o"), F.col(n).alias("v")))), lambda x: x["v"])).alias(n))
        elif not isinstance(kind, T.MapType):
            out.append(F.max(F.struct(when.alias("o"), F.col(n).cast("string").alias("v"))).getField("v").alias(n))
    grouped_ = rows.groupBy(key).agg(*out, F.count("*").alias("aggregate_count"))
    for n in names:
        if isinstance(fields[n], T.MapType):
            grouped_ = grouped_.join(_merged(rows, key, n, fields[n], when), key, "left")
    return grouped_.where(F.col(threshold[0]) > threshold[1]) if threshold else grouped_


def _merged(rows: DataFrame, key: str, name: str, kind: T.MapType, when) -> DataFrame:
    flat = rows.select(key, when.alias("o"), F.explode(name).alias("k", "v"))
    if isinstance(kind.valueType, T.NumericType):
        value = F.sum("v")
    elif isinstance(kind.valueType, T.ArrayType):
        value = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("o", "v"))), lambda x: x["v"]))
    else:
        value = F.max(F.struct("o", "v")).getField("v")
    per = flat.groupBy(key, "k").agg(value.alias("v"))
    return per.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias(name))


def job_counts(selected: DataFrame, all_files: DataFrame, rows: DataFrame) -> DataFrame:
    """(folders, unfiltered_files, measured_files, measure_rows) of a job."""
    parts = [all_files.agg(F.countDistinct("folder").alias("folders"), F.count("*").alias("unfiltered_files")), selected.agg(F.countDistinct("file_id").alias("measured_files")), rows.agg(F.count("*").alias("measure_rows"))]
    names = [c for p in parts for c in p.columns]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).agg(*(F.max(c).alias(c) for c in names))
