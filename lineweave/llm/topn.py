"""The N highest-scoring items of every group, by a loser-tree merge of sorted runs.

Run phase, one run per input split: Spark's external sorter orders the split by (bucket, group, score, tie, id);
a streaming pass keeps the first N distinct ids of each group and seeks past the rest. What is left of a split
is a run of at most N rows a group, stored as one row per bucket with the run's columns as arrays, so a group
that holds a third of all rows sends no more than N rows per split through the shuffle.

Merge phase, one task per few buckets: a loser tree merges the bucket's runs. When a group has put out N
items, each run whose head is still in that group seeks (binary search) to its next group.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as K
from pyspark.sql.pandas.types import to_arrow_type

_DONE = (1,)  # sorts after every (0, ...) key


class Run:
    """A sorted run: parallel lists ordered by group, score descending, tie ascending with null last, id."""

    __slots__ = ("groups", "ids", "pos", "scores", "ties")

    def __init__(self, groups: list, scores: list, ties: list, ids: list) -> None:
        self.groups, self.scores, self.ties, self.ids, self.pos = groups, scores, ties, ids, 0

    def key(self) -> tuple:
        p = self.pos
        if p >= len(self.groups):
            return _DONE
        tie = self.ties[p]
        return (0, self.groups[p], -self.scores[p], tie is None, tie or "", self.ids[p])

    def seek_past(self, group: str) -> None:
        self.pos = bisect_right(self.groups, group, self.pos)


class LoserTree:
    """Tournament tree over runs: inner nodes hold the losers, ``winner`` the run with the least key."""

    def __init__(self, runs: list[Run]) -> None:
        self.runs, k = runs, max(1, len(runs))
        self.keys = [r.key() for r in runs] or [_DONE]
        self.losers, self.k = [0] * k, k
        champions = [0] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            a, b = champions[2 * node], champions[2 * node + 1]
            champions[node], self.losers[node] = (b, a) if self.keys[b] < self.keys[a] else (a, b)
        self.winner = champions[1] if k > 1 else 0

    def replay(self) -> None:
        """Restore the tree after the winner's run has moved on."""
        w, keys, losers = self.winner, self.keys, self.losers
        keys[w] = self.runs[w].key()
        node = (w + self.k) >> 1
        while node:
            if keys[losers[node]] < keys[w]:
                losers[node], w = w, losers[node]
            node >>= 1
        self.winner = w


def merge_runs(runs: list[Run], n: int) -> Iterator[tuple]:
    """(group, rank, id, score, tie) of the first ``n`` distinct ids of every group over all runs."""
    if not runs:
        return
    tree = LoserTree(runs)
    group, taken, seen = None, 0, set()
    while (key := tree.keys[tree.winner]) is not _DONE:
        run = runs[tree.winner]
        if key[1] != group:
            group, taken, seen = key[1], 0, set()
        if taken >= n:
            run.seek_past(group)
        else:
            if key[5] not in seen:
                seen.add(key[5])
                taken += 1
                yield group, taken, key[5], run.scores[run.pos], run.ties[run.pos]
            run.pos += 1
        tree.replay()


def _first_n(n: int):
    """Streaming pass over a sorted split: keep the first n distinct ids of each group, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        run_id, seq = TaskContext.get().partitionId(), 0
        group, taken, seen = None, 0, set()
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = batch.column(1)
            # rows that can matter: heads of groups by arrow, then at most a few steps a group in Python
            change = [0]
            if len(groups) > 1:
                differs = pc.not_equal(groups.slice(1), groups.slice(0, len(groups) - 1))
                change += (pc.indices_nonzero(differs).to_numpy() + 1).tolist()
            keep, ids = [], batch.column(4)
            for begin, end in zip(change, change[1:] + [len(groups)], strict=True):
                head = groups[begin].as_py()
                if head != group:
                    group, taken, seen = head, 0, set()
                at, step = begin, max(16, 2 * n)
                while taken < n and at < end:
                    for offset, one in enumerate(ids.slice(at, min(step, end - at)).to_pylist()):
                        if one not in seen:
                            seen.add(one)
                            keep.append(at + offset)
                            taken += 1
                            if taken == n:
                                break
                    at += step
            if not keep:
                continue
            kept = batch.take(pa.array(keep, pa.int32()))
            buckets = kept.column(0).to_pylist()
            cuts = [0] + [i for i in range(1, len(buckets)) if buckets[i] != buckets[i - 1]] + [len(buckets)]
            offsets = pa.array(cuts, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, kept.column(c)) for c in (1, 2, 3, 4)]
            rows = len(cuts) - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([buckets[c] for c in cuts[:-1]], pa.int32()), pa.array([run_id] * rows, pa.int32()), pa.array([seq] * rows, pa.int32()), *lists],
                names=["bucket", "run", "seq", "groups", "scores", "ties", "ids"],
            )
            seq += 1

    return run


def _merge(n: int, number: pa.DataType):
    """Over rows sorted by (bucket, run, seq): put each run together again and merge bucket by bucket."""

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = (pa.string(), pa.int32(), pa.int64(), number, pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["g", "rank", "id", "score", "tie"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, runs, last = None, [], None
        for batch in batches:
            for b, r, _, *lists in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != bucket:
                    if runs and (rows := list(merge_runs(runs, n))):
                        yield out(rows)
                    bucket, runs, last = b, [], None
                if r == last:
                    run = runs[-1]
                    for have, more in zip((run.groups, run.scores, run.ties, run.ids), lists, strict=True):
                        have.extend(more)
                else:
                    runs.append(Run(*lists))
                    last = r
        if runs and (rows := list(merge_runs(runs, n))):
            yield out(rows)

    return merge


def top_n_per_group(df: DataFrame, group: str, score: str, tie: str, key: str, n: int = 5, buckets: int | None = None) -> DataFrame:
    """The first ``n`` ids of each group by score descending, ``tie`` ascending in code-point order with null last, id ascending.

    ``group`` and ``tie`` are strings, ``score`` a number of any kind, which it stays, and ``key`` a whole number. Result: (``group``, rank, ``key``,
    score, tie). Rows whose group, score or key is null, or whose score is no number (NaN), take no part. Several rows of one key in a group count
    once, at their best place. Groups with fewer than ``n`` ids give all of them; an empty table gives no rows. Other columns of ``df``, whatever their
    names, are not read. Buckets are merged one after another, so a merge task holds the runs of one bucket: all that the splits
    kept (at most n rows a group and split) divided by ``buckets`` (default: 16 x shuffle partitions).
    """
    if n < 1:
        raise ValueError("n must be positive")
    spark = df.sparkSession
    buckets = buckets or 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = df.schema[score].dataType
    kind = K.DoubleType() if isinstance(kind, (K.DoubleType, K.FloatType)) else kind if isinstance(kind, K.DecimalType) else K.LongType()
    points = F.col(score).cast(kind)
    rows = df.where(F.col(group).isNotNull() & points.isNotNull() & ~F.isnan(points.cast("double")) & F.col(key).isNotNull()).select(
        F.pmod(F.xxhash64(F.col(group)), F.lit(buckets)).cast("int").alias("b"), F.col(group).alias("g"), points.alias("s"), F.col(tie).cast("string").alias("t"), F.col(key).cast("long").alias("i")
    )
    name = kind.simpleString()
    ordered = rows.sortWithinPartitions("b", "g", F.col("s").desc(), F.col("t").asc_nulls_last(), "i")
    runs = ordered.mapInArrow(_first_n(n), f"bucket int, run int, seq int, groups array<string>, scores array<{name}>, ties array<string>, ids array<long>")
    merged = runs.repartition("bucket").sortWithinPartitions("bucket", "run", "seq").mapInArrow(_merge(n, to_arrow_type(kind)), f"g string, rank int, id long, score {name}, tie string")
    return merged.select(F.col("g").alias(group), "rank", F.col("id").alias(key), F.col("score").alias(score), F.col("tie").alias(tie))
