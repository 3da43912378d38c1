"""Packing: plans use up their histogram, containers hold what they may, every token has one place."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lineweave.llm import packing


@settings(max_examples=80, deadline=None)
@given(st.integers(4, 40), st.lists(st.tuples(st.integers(1, 40), st.integers(1, 30)), max_size=12))
def test_plan(capacity, pieces):
    counts = np.zeros(capacity + 1, np.int64)
    for s, n in pieces:
        if s <= capacity:
            counts[s] += n
    made = packing.plan(counts)
    used = np.zeros_like(counts)
    for combo, times in made:
        assert sum(s * m for s, m in combo) <= capacity and times > 0
        for s, m in combo:
            used[s] += m * times
    assert (used == counts).all()
    slots = packing.Slots(made)
    filled = {}
    for s in np.flatnonzero(counts):
        containers, places = slots.find(int(s), np.arange(counts[s]))
        for c, p in zip(containers.tolist(), places.tolist(), strict=True):
            filled.setdefault(c, []).append((p, p + int(s)))
    assert set(filled) == set(range(slots.containers))
    for spans in filled.values():
        spans.sort()
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False)) and spans[0][0] == 0 and spans[-1][1] <= capacity


def test_combinations_fill_exactly():
    counts = np.ones(33, np.int64)
    lengths, times = packing.combinations(counts)
    assert len(lengths) and ((lengths * times).sum(axis=1) == 32).all()


def test_little_is_left_unused():
    rng = np.random.default_rng(5)
    counts = np.bincount(rng.integers(1, 513, 20_000), minlength=513)
    containers = sum(n for _, n in packing.plan(counts))
    least = -(-int((counts * np.arange(513)).sum()) // 512)
    assert containers <= 1.01 * least


def test_large_capacity():
    """A plan for containers of 131,072 tokens with texts of every length: bounded memory, hardly any space unused."""
    import tracemalloc

    rng = np.random.default_rng(1)
    counts = np.bincount(rng.integers(1, 131_073, 60_000), minlength=131_073)
    tracemalloc.start()
    containers = sum(n for _, n in packing.plan(counts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6 and containers <= 1.01 * -(-int(counts @ np.arange(131_073)) // 131_072)


def test_pack(spark):
    texts = [(i, "word " * (1 + i % 37), 1) for i in range(400)] + [(900, None, 1), (901, "", 1), (None, "x", 1), (902, "many words here " * 900, 1), (0, "word", 1)]
    df = spark.createDataFrame(texts, "doc_id long, text string, tokens int").repartition(5, "doc_id")
    windows = spark.createDataFrame([(1, 16, "a"), (2, 100, "b"), (3, None, "c"), (4, 0, "d")], "window_id long, capacity_tokens int, id string")
    out = packing.pack(df, windows).cache()
    count = packing.token_counter(packing.TOKENIZER)
    sizes = {1: 16, 2: 100}
    assert {r.window_id for r in out.select("window_id").distinct().collect()} == {1, 2}
    total = sum(count(t) for i, t, _ in texts if t and i is not None)
    for r in out.groupBy("window_id").agg(F.sum("tokens").alias("n")).collect():
        assert r.n == total
    for r in out.groupBy("window_id", "container_id").agg(F.sum("tokens").alias("n"), F.max(F.col("place") + F.col("tokens")).alias("end")).collect():
        assert r.n <= sizes[r.window_id] and r.end <= sizes[r.window_id]
    split = {r.doc_id for r in out.where("window_id = 2").groupBy("doc_id").agg(F.max("piece").alias("p")).where("p > 0").collect()}
    assert split <= {902}
    assert out.groupBy("window_id", "container_id", "place").count().where("count > 1").count() == 0
    assert packing.pack(df.limit(0), windows).count() == 0
