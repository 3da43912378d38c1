"""Percentiles per group from mergeable summaries: randomized compactor hierarchies (KLL).

A summary holds levels of values; a value on level h stands for 2**h rows. When a level outgrows its capacity it
is sorted and every other value, from a coin-flipped offset, moves up a level. Capacities shrink by 2/3 per level
below the top (never under 8), so a summary keeps about 3k values however many rows it has seen. Two summaries
merge level by level. With n rows the rank of an answer is off by more than ``rank_error(k)`` * n with
probability under 1 % (constant as published for this scheme); while nothing was compacted, answers are exact.

Summaries per (group, day) are rows of a table: they can be kept and combined with those of any other day or split.
The coins come from a seeded hash of what is compacted, so equal input in equal splits gives equal summaries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

K = 400
LEAST = 8
SHRINK = 2 / 3


def rank_error(k: int = K) -> float:
    """Bound of the two-sided normalized rank error at 99 % confidence."""
    return 2.446 / k**0.9433


class Compactors:
    """A hierarchy of compactors over whole numbers (or floats)."""

    def __init__(self, k: int = K, levels: list[np.ndarray] | None = None, n: int = 0) -> None:
        self.k, self.n = k, n
        self.levels = levels or [np.empty(0, np.int64)]  # a float level makes all floats

    def capacity(self, h: int) -> int:
        return max(LEAST, int(np.ceil(self.k * SHRINK ** (len(self.levels) - 1 - h))))

    def _compress(self) -> None:
        h = 0
        while h < len(self.levels):
            if len(self.levels[h]) > self.capacity(h):
                if h + 1 == len(self.levels):
                    self.levels.append(np.empty(0, self.levels[h].dtype))
                level = np.sort(self.levels[h])
                rest = level[:0]
                if len(level) % 2:  # an odd value stays, so that weights add up to n
                    rest, level = level[-1:], level[:-1]
                coin = xxhash.xxh3_64_intdigest(level.tobytes(), h) & 1
                self.levels[h] = rest
                self.levels[h + 1] = np.concatenate([self.levels[h + 1], level[coin::2]])
            h += 1

    def extend(self, values: np.ndarray) -> None:
        self.levels[0] = np.concatenate([self.levels[0], values])
        self.n += len(values)
        self._compress()

    def merge(self, other: Compactors) -> None:
        while len(self.levels) < len(other.levels):
            self.levels.append(np.empty(0, np.int64))
        for h, level in enumerate(other.levels):
            self.levels[h] = np.concatenate([self.levels[h], level])
        self.n += other.n
        self._compress()

    def quantiles(self, fractions: list[float]) -> list:
        """For each fraction q the least kept value whose estimated rank is at least q * n."""
        values = np.concatenate(self.levels)
        if not len(values):
            return [None] * len(fractions)
        weights = np.concatenate([np.full(len(v), 1 << h, np.int64) for h, v in enumerate(self.levels)])
        order = np.argsort(values, kind="stable")
        ranks = np.cumsum(weights[order])
        at = np.searchsorted(ranks, np.ceil(np.array(fractions) * ranks[-1] - 1e-9), side="left")
        return [values[order[min(i, len(order) - 1)]].item() for i in at]


def _state(fractions: bool) -> str:
    return f"grp string, day date, part int, n long, levels array<array<{'double' if fractions else 'long'}>>"


def _number(fractions: bool) -> pa.DataType:
    return pa.float64() if fractions else pa.int64()


def _out(rows: list[tuple], fractions: bool) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 5
    kinds = (pa.string(), pa.date32(), pa.int32(), pa.int64(), pa.list_(pa.list_(_number(fractions))))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["grp", "day", "part", "n", "levels"])


def _restored(k: int, n: int, levels: list, fractions: bool) -> Compactors:
    return Compactors(k, [np.array(v, np.float64 if fractions else np.int64) for v in levels], n)


def _partial(k: int, fractions: bool):
    """Map-side summaries: one per (group, day) met in a split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, have = TaskContext.get().partitionId(), {}
        for batch in batches:
            if not batch.num_rows:
                continue
            groups, days = batch.column(0).dictionary_encode(), batch.column(1).dictionary_encode()
            code = groups.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(days.dictionary) + days.indices.to_numpy(zero_copy_only=False)
            values = batch.column(2).to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            code, values = code[order], values[order]
            names, dates = groups.dictionary.to_pylist(), days.dictionary.to_pylist()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(code)) + 1, [len(code)]])
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                key = (names[code[begin] // len(dates)], dates[code[begin] % len(dates)])
                if (one := have.get(key)) is None:
                    one = have[key] = Compactors(k)
                one.extend(values[begin:end])
            if len(have) > 20_000:  # bounds the memory of a task; parts of one key are merged later anyway
                yield _out([(g, d, part, s.n, [v.tolist() for v in s.levels]) for (g, d), s in have.items()], fractions)
                have = {}
        yield _out([(g, d, part, s.n, [v.tolist() for v in s.levels]) for (g, d), s in have.items()], fractions)

    return run


def _merge_states(k: int, keep_day: bool, fractions: bool):
    def merge(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["day"].to_pylist(), table["part"].to_pylist(), table["n"].to_pylist(), table["levels"].to_pylist(), strict=True), key=lambda r: (str(r[0]), r[1], r[2]))
        all_of = Compactors(k)
        for _, _, n, levels in rows:
            all_of.merge(_restored(k, n, levels, fractions))
        return pa.Table.from_batches([_out([(table["grp"][0].as_py(), rows[0][0] if keep_day else None, rows[0][1], all_of.n, [v.tolist() for v in all_of.levels])], fractions)])

    return merge


def _has_fractions(df: DataFrame, column: str) -> bool:
    kind = df.schema[column].dataType
    return isinstance(kind, (T.DoubleType, T.FloatType)) or (isinstance(kind, T.DecimalType) and kind.scale > 0)


def daily_summaries(df: DataFrame, group: str, value: str, time: str, key: str, k: int = K, fan_in: int = 64) -> DataFrame:
    """One mergeable summary per (group, day): (grp, day, part, n, levels).

    Values are whole numbers or, where the column has fractions, doubles. Each ``key`` counts once: repeated deliveries carry equal values, and the
    one with the least value, group and time would count if they did not. Rows whose group, value, time or key is null, or whose value is
    no number (NaN), take no part; an empty table gives none. Group names are compared without letter case. Splits are summarised before the
    shuffle; the summaries of one (group, day) are then merged level by level, those of ``fan_in`` splits at a time, so a task
    sees about that many of one key at once, however many splits there are.
    """
    fractions = _has_fractions(df, value)
    number = F.col(value).cast("double" if fractions else "long")
    once = (
        df.where(F.col(group).isNotNull() & number.isNotNull() & ~F.isnan(number.cast("double")) & F.col(time).isNotNull() & F.col(key).isNotNull())
        .groupBy(F.col(key).alias("key"))
        .agg(F.min(F.struct(F.lower(F.col(group)).alias("grp"), F.to_date(F.col(time)).alias("day"), number.alias("value"))).alias("s"))
        .select("s.grp", "s.day", "s.value")
    )
    out = once.mapInArrow(_partial(k, fractions), _state(fractions))
    splits = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # what the grouping by key leaves
    width = fan_in
    while width < splits:
        out = out.groupBy("grp", "day", F.floor(F.col("part") / width)).applyInArrow(_merge_states(k, True, fractions), _state(fractions))
        width *= fan_in
    return out.groupBy("grp", "day").applyInArrow(_merge_states(k, True, fractions), _state(fractions))


def combine(summaries: DataFrame, k: int = K, fan_in: int = 64) -> DataFrame:
    """One summary per group from summaries of its days, or of splits, or of whatever else was kept.

    They are dealt out to ``fan_in`` squared heaps a group, whose summaries go together to ``fan_in`` heaps, and these to one; so a task sees about ``fan_in``
    at once up to ``fan_in`` cubed summaries a group.
    """
    fractions = "double" in summaries.schema["levels"].dataType.simpleString()
    heap = F.pmod(F.xxhash64("day", "part"), F.lit(fan_in * fan_in))
    dealt = summaries.withColumn("part", heap.cast("int"))
    merged = dealt.groupBy("grp", "part").applyInArrow(_merge_states(k, False, fractions), _state(fractions))
    merged = merged.groupBy("grp", F.floor(F.col("part") / fan_in)).applyInArrow(_merge_states(k, False, fractions), _state(fractions))
    return merged.groupBy("grp").applyInArrow(_merge_states(k, False, fractions), _state(fractions))


def percentiles(summaries: DataFrame, fractions: dict[str, float], k: int = K) -> DataFrame:
    """(grp, day, n, one column per fraction, rank_error) of summaries; an empty summary gives nulls. Whole numbers stay whole."""
    names, doubles = list(fractions), "double" in summaries.schema["levels"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers = [_restored(k, n, levels, doubles).quantiles(list(fractions.values())) for n, levels in zip(batch["n"].to_pylist(), batch["levels"].to_pylist(), strict=True)]
            exact = [len(levels) == 1 for levels in batch["levels"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["grp"], batch["day"], batch["n"], *(pa.array([a[i] for a in answers], _number(doubles)) for i in range(len(names))), pa.array([0.0 if e else rank_error(k) for e in exact], pa.float64())],
                names=["grp", "day", "n", *names, "rank_error"],
            )

    return summaries.mapInArrow(read, "grp string, day date, n long, " + ", ".join(f"{x} {'double' if doubles else 'long'}" for x in names) + ", rank_error double")
