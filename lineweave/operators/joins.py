"""Left joins of rows with a table of one row per key, where some keys may hold a great part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOTTEST = 1000
_SPREAD = 4096


def left_by_key(rows: DataFrame, table: DataFrame, key: Column, table_key: str, count: str, unique: Column, hottest: int = HOTTEST) -> DataFrame:
    """``rows`` with the columns of the row of ``table`` whose ``table_key`` is ``key``, null where there is none.

    ``count`` says how many rows a key has. The ``hottest`` keys are broadcast, a bound that does not grow with the data; their rows, and
    those with a null key, go by a hash of ``unique`` through the shuffle for the rest, where each key holds less than
    1/``hottest`` of the counted rows.
    """
    values = [c for c in table.columns if c != table_key]
    hot = table.orderBy(F.col(count).desc(), table_key).limit(hottest)
    hot = hot.select(F.col(table_key).alias("_hot_key"), F.struct(*values).alias("_hot"))
    rest = table.select(F.col(table_key).alias("_cold_key"), F.struct(*values).alias("_cold"), F.lit(0).alias("_cold_salt"))
    out = rows.withColumn("_key", key).join(F.broadcast(hot), F.col("_key") == F.col("_hot_key"), "left")
    lone = F.col("_key").isNull() | F.col("_hot_key").isNotNull()
    out = out.withColumn("_salt", F.when(lone, 1 + F.pmod(F.xxhash64(unique), F.lit(_SPREAD))).otherwise(0).cast("int")).withColumn("_key", F.when(~lone, F.col("_key")))
    out = out.join(rest, (F.col("_key") == F.col("_cold_key")) & (F.col("_salt") == F.col("_cold_salt")), "left")
    return out.withColumns({v: F.coalesce(F.col(f"_hot.{v}"), F.col(f"_cold.{v}")) for v in values}).drop("_key", "_hot_key", "_hot", "_cold_key", "_cold", "_cold_salt", "_salt")


def inner_by_key(rows: DataFrame, table: DataFrame, key: str, table_key: str, count: str, hottest: int = HOTTEST) -> DataFrame:
    """``rows`` that have a row of ``table``, with its columns, as ``left_by_key`` joins them; nothing but the columns of ``rows`` is shuffled.

    ``rows`` are read twice, so they should be cheap to make, as from a checkpoint.
    """
    hot = F.broadcast(table.orderBy(F.col(count).desc(), table_key).limit(hottest))
    frequent = rows.join(hot, F.col(key) == F.col(table_key))
    others = rows.where(F.col(key).isNotNull()).join(hot.select(F.col(table_key).alias("_hot_key")), F.col(key) == F.col("_hot_key"), "left_anti")
    return frequent.unionByName(others.join(table, F.col(key) == F.col(table_key))).drop(table_key)
