"""Texts packed into containers of fixed capacity: non-negative least squares over shallow length combinations.

1. One streaming pass sizes the texts in tokens. A text longer than a container gives whole containers and a rest;
   nothing else is split. Each piece gets its rank among the equal pieces of its split.
2. The histogram of piece sizes, at most ``capacity`` numbers per window, goes to the driver, whatever the data's size.
3. The planner enumerates shallow combinations (few distinct lengths) that fill a container exactly, round by round those that the
   histogram still wants most, solves for repeat counts x >= 0 with least squared error against the histogram, rounds down, and packs what is left
   greedily, largest first, again by repeated combinations. The plan uses up the histogram exactly.
4. A piece's global rank among equal pieces (split offset + rank in its split) picks its slot in the plan. No group of
   equal pieces is ever collected, so a size that a third of the texts share is no hot spot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineweave.session import checkpointed

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
STEPS, LAST_STEPS = 120, 300  # of projected gradient a round, and at the end
SEEDS, EACH, ROUNDS = 256, 4, 4
WORK = 1 << 22  # lengths times capacity that a round looks at, if that is more than SEEDS lengths
LEFT_OVER = 0.002  # of all tokens: less is left to the greedy step
LARGEST_TOKENIZER = 64 << 20  # bytes of a vocabulary file that is broadcast


# -- planning (driver, on a histogram) -----------------------------------------------------------------------------


def combinations(counts: np.ndarray, wish: np.ndarray | None = None, seeds: int | None = None, each: int = EACH) -> tuple[np.ndarray, np.ndarray]:
    """Exact fillings of a container from at most three distinct lengths: (lengths, multiplicities), both (n, 3).

    ``counts[s]`` pieces have length s; the capacity is ``len(counts) - 1``. ``wish[s]`` says how much length s is wanted (its count, if not
    given). For the ``seeds`` most wanted lengths (default: as many as a round's work allows), once, twice, three times, and as often as they fit, the ``each`` most wanted pairs of
    lengths that fill the rest. Work and memory grow with the capacity, not with its square.
    """
    capacity = len(counts) - 1
    seeds = seeds or max(SEEDS, WORK // capacity)
    wish = counts.astype(float) if wish is None else wish
    value = np.where(counts > 0, wish, -np.inf)
    value[0] = -np.inf
    have = np.flatnonzero(counts[:capacity] > 0)
    have = have[have > 0]
    first = have[np.argsort(-(np.maximum(wish[have], 0) * have), kind="stable")][:seeds]
    found: list[tuple[int, ...]] = []
    for a in first.tolist():
        most = capacity // a
        for i in sorted({1, 2, 3, most - 1, most} & set(range(1, most + 1))):
            rest = capacity - i * a
            if rest == 0:
                found.append((a, i, 0, 0, 0, 0))
                continue
            if counts[rest] > 0:
                found.append((a, i, rest, 1, 0, 0))
            low = (rest + 1) // 2
            both = value[low:rest] + value[1 : rest - low + 1][::-1]  # b from low up, c = rest - b
            if not len(both):
                continue
            top = np.argpartition(-both, each - 1)[:each] if len(both) > each else np.arange(len(both))
            found += [(a, i, low + int(t), 1, rest - low - int(t), 1) for t in top if both[t] > -np.inf]
    if not found:
        return np.empty((0, 3), np.int64), np.empty((0, 3), np.int64)
    rows = np.array(found, np.int64)
    lengths, times = rows[:, ::2].copy(), rows[:, 1::2].copy()
    for x, y in ((0, 1), (1, 2), (0, 2)):  # equal lengths become one with a multiplicity
        same = (lengths[:, x] == lengths[:, y]) & (times[:, y] > 0)
        times[same, x] += times[same, y]
        times[same, y], lengths[same, y] = 0, 0
    return lengths, times


def generated(counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lengths, multiplicities, repeat counts) by column generation: combinations are made for what the last solution leaves over.

    Each round solves the non-negative least squares over the combinations so far and asks for those that its residual wants most; it
    ends when hardly anything is left over or nothing new is found. No combination is ever left out for being one too many.
    """
    lengths, times, x = np.empty((0, 3), np.int64), np.empty((0, 3), np.int64), np.empty(0)
    left, sizes = counts.astype(float), np.arange(len(counts))
    left[0] = 0
    total = float(left @ sizes)
    for _ in range(rounds):
        more, more_times = combinations(counts, left)
        every = np.concatenate([np.concatenate([lengths, more]), np.concatenate([times, more_times])], axis=1)
        order = np.argsort(-every[:, :3], axis=1, kind="stable")
        _, first = np.unique(np.take_along_axis(every, np.concatenate([order, order + 3], axis=1), 1), axis=0, return_index=True)
        new = np.sort(first[first >= len(lengths)]) - len(lengths)
        if not len(new):
            break
        lengths, times = np.concatenate([lengths, more[new]]), np.concatenate([times, more_times[new]])
        x = repeats(lengths, times, counts, start=np.concatenate([x, np.zeros(len(new))]))
        used = x > 0  # what is not used now can be asked for again
        lengths, times, x = lengths[used], times[used], x[used]
        left = counts - np.bincount(lengths.ravel(), weights=(times * x[:, None]).ravel(), minlength=len(counts))
        left[0] = 0
        if float(np.maximum(left, 0) @ sizes) < LEFT_OVER * total:
            break
    return lengths, times, x


def repeats(lengths: np.ndarray, times: np.ndarray, counts: np.ndarray, steps: int = STEPS, start: np.ndarray | None = None) -> np.ndarray:
    """x >= 0 that minimises |A x - counts|, A holding a combination's multiplicities; accelerated projected gradient."""
    if not len(lengths):
        return np.empty(0)
    target = counts.astype(float).copy()
    target[0] = 0
    times = times.astype(float)
    flat = lengths.ravel()

    def apply(x: np.ndarray) -> np.ndarray:
        out = np.bincount(flat, weights=(times * x[:, None]).ravel(), minlength=len(counts))
        out[0] = 0
        return out

    def adjoint(r: np.ndarray) -> np.ndarray:
        return (r[lengths] * times).sum(axis=1)

    v = np.ones(len(lengths))
    norm = 1.0
    for _ in range(15):  # largest eigenvalue of A'A by power iteration
        v = adjoint(apply(v))
        norm = float(np.linalg.norm(v)) or 1.0
        v /= norm
    step = 1 / (1.05 * norm)
    x = y = np.zeros(len(lengths)) if start is None else start
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - step * adjoint(apply(y) - target))
        if float((y - new) @ (new - x)) > 0:
            t = 1.0
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / later * (new - x)
        x, t = new, later
    return x


def plan(counts: np.ndarray) -> list[tuple[list[tuple[int, int]], int]]:
    """[(length, times), ...] and how often each is used; together they use up ``counts`` exactly."""
    left, made = counts.astype(np.int64).copy(), []
    left[0] = 0
    capacity = len(counts) - 1
    if left[capacity]:
        made.append(([(capacity, 1)], int(left[capacity])))
        left[capacity] = 0
    lengths, times, x = generated(left)
    x = repeats(lengths, times, left, LAST_STEPS, x)
    for at in np.argsort(-x, kind="stable").tolist():
        combo = [(int(s), int(m)) for s, m in zip(lengths[at], times[at], strict=True) if m]
        whole = min([int(x[at]), *(int(left[s]) // m for s, m in combo)])
        if whole:
            for s, m in combo:
                left[s] -= whole * m
            made.append((combo, whole))
    return made + greedy(left)


def greedy(counts: np.ndarray) -> list[tuple[list[tuple[int, int]], int]]:
    """Largest first: fill a container with the largest pieces that fit, then repeat that filling while pieces last."""
    left, made = counts.copy(), []
    capacity = len(left) - 1
    have = np.flatnonzero(left)
    while len(have):
        gap, combo, top = capacity, [], len(have) - 1
        while gap and top >= 0:
            top = min(top, int(np.searchsorted(have, gap, "right")) - 1)
            if top < 0:
                break
            s = int(have[top])
            m = min(int(left[s]), gap // s)
            combo.append((s, m))
            gap -= m * s
            top -= 1
        whole = min(int(left[s]) // m for s, m in combo)
        for s, m in combo:
            left[s] -= whole * m
        made.append((combo, whole))
        have = have[left[have] > 0]
    return made


class Slots:
    """A plan turned round: from a piece's length and rank among equal pieces to its container and place."""

    def __init__(self, made: list[tuple[list[tuple[int, int]], int]]) -> None:
        by_length: dict[int, list[tuple[int, int, int, int]]] = {}
        used: dict[int, int] = {}
        container = 0
        for combo, whole in made:
            place = 0
            for s, m in combo:
                by_length.setdefault(s, []).append((used.get(s, 0), container, m, place))
                used[s] = used.get(s, 0) + whole * m
                place += s * m
            container += whole
        self.containers = container
        self.by_length = {s: np.array(rows, np.int64).T for s, rows in by_length.items()}

    def find(self, length: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, container, times, place = self.by_length[length]
        at = np.searchsorted(first, ranks, "right") - 1
        offset = ranks - first[at]
        return container[at] + offset // times[at], place[at] + (offset % times[at]) * length


# -- Spark ---------------------------------------------------------------------------------------------------------


def token_counter(source: str | bytes):
    """A function text -> number of tokens, for a file of byte-pair ranks or its content."""
    import base64

    import tiktoken

    if isinstance(source, str):
        with open(source, "rb") as f:
            source = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, source.splitlines())}
    encode = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda text: len(encode(text))


_SIZED = "window_id long, part int, id long, tokens long, size int, rank long, whole long, whole_rank long"


def _size(capacities: list[tuple[int, int]], vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, count = TaskContext.get().partitionId(), token_counter(vocabulary.value)
        seen: dict[tuple[int, int], int] = {}
        whole_seen = dict.fromkeys([w for w, _ in capacities], 0)
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = count(text)
                if not tokens:
                    continue
                for w, capacity in capacities:
                    whole, rest = divmod(tokens, capacity)
                    rank = seen.get((w, rest), 0)
                    seen[w, rest] = rank + 1
                    rows.append((w, part, key, tokens, rest, rank, whole, whole_seen[w]))
                    whole_seen[w] += whole
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["window_id", "part", "id", "tokens", "size", "rank", "whole", "whole_rank"])

    return run


def _place(slots, capacities: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans = slots.value
        for batch in batches:
            if not batch.num_rows:
                continue
            window, key, tokens, size, rank, whole, first = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            out = []
            for w in np.unique(window):
                capacity = capacities[int(w)]
                mine = np.flatnonzero(window == w)
                many = mine[whole[mine] > 0]
                if len(many):
                    row = np.repeat(many, whole[many])
                    piece = np.arange(len(row)) - np.repeat(np.cumsum(whole[many]) - whole[many], whole[many])
                    container, place = plans[int(w)].find(capacity, first[row] + piece)
                    out.append((np.full(len(row), w), container, key[row], piece, np.full(len(row), capacity), place))
                rest = mine[size[mine] > 0]
                for s in np.unique(size[rest]):
                    row = rest[size[rest] == s]
                    container, place = plans[int(w)].find(int(s), rank[row])
                    out.append((window[row], container, key[row], whole[row], np.full(len(row), s), place))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], names=["window_id", "container_id", "id", "piece", "tokens", "place"])

    return run


def pack(texts: DataFrame, windows: DataFrame, key: str = "doc_id", text: str = "text", window: str = "window_id", capacity: str = "capacity_tokens", tokenizer: str = TOKENIZER, most_windows: int = 1000) -> DataFrame:
    """(window_id, container_id, ``key``, piece, tokens, place): each piece of each text in a container of each window.

    ``piece`` numbers the parts of a text from 0 (only texts longer than a container have more than one), ``place`` is
    its first token's place in the container. Containers are numbered from 0 in each window. Null and empty texts have
    no tokens and no row; rows with a null key and windows without a positive capacity take no part; rows that repeat
    a key are packed each. An empty table gives no rows. ``windows`` is a parameter table, refused beyond ``most_windows``.
    The vocabulary file ``tokenizer`` is read on the driver and sent to the executors.
    """
    spark = texts.sparkSession
    capacities = {r[0]: r[1] for r in windows.where(F.col(window).isNotNull() & (F.col(capacity) > 0)).select(F.col(window).cast("long"), F.col(capacity).cast("int")).limit(most_windows + 1).collect()}
    if len(capacities) > most_windows:
        raise ValueError(f"more than {most_windows} windows")
    rows = texts.where(F.col(key).isNotNull() & (F.length(text) > 0)).select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"))
    with open(tokenizer, "rb") as f:
        content = f.read(LARGEST_TOKENIZER + 1)
    if len(content) > LARGEST_TOKENIZER:
        raise ValueError("no vocabulary file")
    vocabulary = spark.sparkContext.broadcast(content)
    # the splits fix the ranks, so what was sized is written once and never sized again
    sized = checkpointed(rows.mapInArrow(_size(sorted(capacities.items()), vocabulary), _SIZED))
    by_part = sized.groupBy("window_id", "part", "size").agg(F.count("*").alias("n")).where("size > 0")
    whole = sized.groupBy("window_id", "part").agg(F.sum("whole").alias("n"))
    histograms = {w: np.zeros(c + 1, np.int64) for w, c in capacities.items()}
    for w, s, n in by_part.groupBy("window_id", "size").agg(F.sum("n")).collect():
        histograms[w][s] += n
    for w, n in whole.groupBy("window_id").agg(F.sum("n")).collect():
        histograms[w][capacities[w]] += n
    slots = spark.sparkContext.broadcast({w: Slots(plan(h)) for w, h in histograms.items()})
    earlier = (Window.unboundedPreceding, -1)
    offsets = by_part.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("window_id", "size").orderBy("part").rowsBetween(*earlier)), F.lit(0)))
    whole_offsets = whole.withColumn("whole_before", F.coalesce(F.sum("n").over(Window.partitionBy("window_id").orderBy("part").rowsBetween(*earlier)), F.lit(0)))
    placed = (
        sized.join(offsets.drop("n"), ["window_id", "part", "size"], "left")
        .join(whole_offsets.drop("n"), ["window_id", "part"], "left")
        .select("window_id", "id", "tokens", "size", (F.col("rank") + F.coalesce("before", F.lit(0))).alias("rank"), "whole", (F.col("whole_rank") + F.col("whole_before")).alias("first"))
    )
    out = placed.mapInArrow(_place(slots, capacities), "window_id long, container_id long, id long, piece long, tokens long, place long")
    return out.withColumnRenamed("id", key)
