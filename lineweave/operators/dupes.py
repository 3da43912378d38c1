"""Duplicate files: by checksum, or by name and size within a threshold of an earlier leader."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineweave.operators.joins import left_by_key


def by_key(files: DataFrame, key: Column, order: str = "path") -> DataFrame:
    """Adds ``dupe_first_path``: the first path with the same key, null for that one itself and for a null key.

    Keys and first paths are aggregated, partly before the shuffle. Keys of many files are broadcast and null keys spread
    (``joins.left_by_key``), so neither gathers in one task.
    """
    keyed = files.withColumn("_dupe_key", key)
    first = keyed.where("_dupe_key is not null").groupBy(F.col("_dupe_key").alias("_k")).agg(F.min(order).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    out = left_by_key(keyed, first, F.col("_dupe_key"), "_k", "_n", F.col(order))
    return out.withColumn("dupe_first_path", F.when(F.col(order) != F.col("_first"), F.col("_first"))).drop("_dupe_key", "_first", "_n")


class _Leaders:
    """Leaders of one name, kept sorted by size. Those within reach of a size lie next to each other there, and as leaders keep more than
    ``threshold`` apart, they are two at most."""

    def __init__(self, threshold: int) -> None:
        self.threshold, self.kept, self.seen = threshold, [], 0

    def follow(self, size, path: str) -> str:
        """The path of the earliest leader within reach, or ``path`` itself, which then is a leader."""
        self.seen += 1
        at, near = bisect_left(self.kept, (size - self.threshold,)), None
        while at < len(self.kept) and self.kept[at][0] <= size + self.threshold:
            near = min(near or self.kept[at][1:], self.kept[at][1:])
            at += 1
        if near:
            return near[1]
        insort(self.kept, (size, self.seen, path))
        return path


def _leaders(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, _Leaders(threshold)
        for batch in batches:
            found = []
            for name, config, size, path in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                if (name, config) != last:
                    last, own = (name, config), _Leaders(threshold)
                found.append(own.follow(size, path))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found, pa.string())], names=["_name", "_c", "_size", "_n", "_leader"])

    return run


def by_size(files: DataFrame, name: str = "name", size: str = "size", order: str = "path", config: Column | None = None, threshold: int = 0) -> DataFrame:
    """Adds ``dupe_first_path``: the leader of the same name whose size is within ``threshold``, null for leaders.

    Leaders are found in the order of paths: a file joins the first leader within reach or becomes one. Without a
    threshold that is an equality. With one, only distinct sizes with their first path are folded per name, n log n in their number: files of a
    size that has a leader follow it. Distinct sizes of a name are bounded by the sizes files have, not by the number of files. Null names and sizes have no duplicates.
    """
    keyed = files.withColumn("_config", F.coalesce(config, F.lit("")) if config is not None else F.lit(""))
    known = F.col(name).isNotNull() & F.col(size).isNotNull()
    if threshold == 0:
        return by_key(keyed, F.when(known, F.struct(name, "_config", size)), order).drop("_config")
    sizes = keyed.where(known).groupBy(F.col(name).alias("_name"), F.col("_config").alias("_c"), F.col(size).alias("_size")).agg(F.min(order).alias("_path"), F.count("*").alias("_n"))

    kind = files.schema[size].dataType.simpleString()
    # sorted splits, one pass over each: a call of Python per name would cost more than the names
    ordered = sizes.repartition("_name", "_c").sortWithinPartitions("_name", "_c", "_path", "_size").select("_name", "_c", "_size", "_n", "_path")
    led = ordered.mapInArrow(_leaders(threshold), f"_name string, _c string, _size {kind}, _n long, _leader string")
    led = led.select(F.struct(F.col("_name").alias("n"), F.col("_c").alias("c"), F.col("_size").alias("s")).alias("_k"), "_n", "_leader")
    out = left_by_key(keyed, led, F.when(known, F.struct(F.col(name).alias("n"), F.col("_config").alias("c"), F.col(size).alias("s"))), "_k", "_n", F.col(order))
    return out.withColumn("dupe_first_path", F.when(F.col(order) != F.col("_leader"), F.col("_leader"))).drop("_config", "_n", "_leader")


# The columns that a duplicate keeps.
KEPT = ("file_type", "file_name", "file_abs_path", "dir", "tag", "nbnc_crc", "dupe_nbnc", "dupe_file_name", "dupe_first_path", "dupe_dir")


def blanked(measured: DataFrame, keep: list[str] = ("file_id",)) -> DataFrame:
    """Measures of duplicates (rows with ``dupe_first_path``) replaced by those that tell where the first one is."""
    dupe = F.col("dupe_first_path").isNotNull()
    out = measured
    if "file_nbnc" in measured.columns:
        out = out.withColumn("dupe_nbnc", F.when(dupe, F.col("file_nbnc")))
    for c in measured.columns:
        if c not in keep and c.rstrip("0123456789") not in KEPT:
            out = out.withColumn(c, F.when(~dupe, F.col(c)))
    return out


def totals(files: DataFrame) -> DataFrame:
    """(files_with_dupes, dupe_files): first files that have duplicates, and these with their duplicates together."""
    per = files.where("dupe_first_path is not null").groupBy("dupe_first_path").agg((F.count("*") + 1).alias("n"))
    return per.agg(F.count("*").alias("files_with_dupes"), F.coalesce(F.sum("n"), F.lit(0)).alias("dupe_files"))
