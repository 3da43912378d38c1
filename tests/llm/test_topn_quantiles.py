"""Top N against brute force, percentiles against exact ranks."""

import datetime
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lineweave.llm import quantiles, topn


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 3), st.sampled_from(["x", "y", None, ""]), st.integers(0, 9)), max_size=12), max_size=5), st.integers(1, 4))
def test_loser_tree(parts, n):
    order = lambda r: (r[0], -r[1], r[2] is None, r[2] or "", r[3])
    runs = [topn.Run(*(list(c) for c in (zip(*sorted(p, key=order), strict=True) if p else [(), (), (), ()]))) for p in parts]
    got = [(g, i) for g, _, i, _, _ in topn.merge_runs(runs, n)]
    want, seen = [], {}
    for r in sorted((r for p in parts for r in p), key=order):
        ids = seen.setdefault(r[0], [])
        if r[3] not in ids and len(ids) < n:
            ids.append(r[3])
            want.append((r[0], r[3]))
    assert got == want


def test_top_n(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.4 else rng.choice("abcde"), rng.randint(0, 5), rng.choice(["é", "z", "Z", None, ""]), i, "extra", 1) for i in range(3000)]
    rows += rows[:400] + [(None, 1, "x", 9001, "", 1), ("a", None, "x", 9002, "", 1), ("a", 9, "x", None, "", 1)]
    df = spark.createDataFrame(rows, "file_name string, score int, name string, rid long, bucket string, rank int").repartition(7)
    got = {(r.file_name, r["rank"], r.rid) for r in topn.top_n_per_group(df, "file_name", "score", "name", "rid", 5, buckets=3).collect()}
    want = set()
    for g in "abcde", "hot":
        for name in g if g != "hot" else ["hot"]:
            best = sorted({r[:4] for r in rows if r[0] == name and r[1] is not None and r[3] is not None}, key=lambda r: (-r[1], r[2] is None, r[2] or "", r[3]))[:5]
            want |= {(name, i, r[3]) for i, r in enumerate(best, 1)}
    assert got == want
    assert topn.top_n_per_group(df.limit(0), "file_name", "score", "name", "rid").count() == 0


def test_compactors_stay_within_their_bound():
    rng = np.random.default_rng(3)
    for kind in ("skewed", "ties", "sorted"):
        values = {"skewed": (rng.pareto(1.2, 60_000) * 50).astype(np.int64), "ties": rng.integers(0, 9, 60_000), "sorted": np.arange(60_000)}[kind]
        parts = np.array_split(values, 23)
        whole = quantiles.Compactors()
        for p in parts:
            one = quantiles.Compactors()
            one.extend(p)
            whole.merge(one)
        assert whole.n == len(values) == sum(len(v) << h for h, v in enumerate(whole.levels))
        assert sum(map(len, whole.levels)) < 4 * quantiles.K
        exact = np.sort(values)
        for q, v in zip((0.5, 0.9, 0.95, 0.99), whole.quantiles([0.5, 0.9, 0.95, 0.99]), strict=True):
            low, high = np.searchsorted(exact, v, "left") / len(exact), np.searchsorted(exact, v, "right") / len(exact)
            assert low - 2 * quantiles.rank_error() <= q <= high + 2 * quantiles.rank_error()


def test_percentiles(spark):
    rng = random.Random(2)
    day = lambda i: datetime.datetime(2023, 1, 1 + i % 5)
    rows = [(i, rng.choice([".C", ".c", ".py"]), rng.randint(0, 10_000), day(i), "x") for i in range(4000)]
    rows += rows[:500] + [(90_000, None, 5, day(0), ""), (90_001, ".c", None, day(0), ""), (90_002, ".one", 7, day(1), "")]
    df = spark.createDataFrame(rows, "fid long, type string, v long, at timestamp, grp string").repartition(5)
    days = quantiles.daily_summaries(df, "type", "v", "at", "fid", fan_in=2)
    assert {(r.grp, r.day.day) for r in days.collect()} == {(g, d) for g in (".c", ".py") for d in range(1, 6)} | {(".one", 2)}
    got = {r.grp: r for r in quantiles.percentiles(quantiles.combine(days), {"p50": 0.5, "p99": 0.99}).collect()}
    for g in (".c", ".py", ".one"):
        exact = np.sort([r[2] for r in {r[0]: r for r in rows if r[1] and r[1].lower() == g and r[2] is not None}.values()])
        assert got[g].n == len(exact)
        for q, v in ((0.5, got[g].p50), (0.99, got[g].p99)):
            assert np.searchsorted(exact, v, "left") / len(exact) - got[g].rank_error <= q <= np.searchsorted(exact, v, "right") / len(exact) + got[g].rank_error
    assert quantiles.combine(quantiles.daily_summaries(df.limit(0), "type", "v", "at", "fid")).count() == 0


def test_fractions_stay(spark):
    """Scores and values with fractions are compared as they are; what is no number takes no part."""
    import decimal

    rows = [("a", 1.25, "x", 1), ("a", 1.5, "x", 2), ("a", 1.75, "x", 3), ("a", float("nan"), "x", 4), ("b", -0.5, None, 5)]
    df = spark.createDataFrame(rows, "g string, s double, t string, i long")
    assert [(r.g, r.i, r.s) for r in topn.top_n_per_group(df, "g", "s", "t", "i", 2).orderBy("g", "rank").collect()] == [("a", 3, 1.75), ("a", 2, 1.5), ("b", 5, -0.5)]
    exact = df.where("not isnan(s)").selectExpr("g", "cast(s as decimal(10,2)) s", "t", "i")
    assert topn.top_n_per_group(exact, "g", "s", "t", "i", 1).where("g = 'a'").first().s == decimal.Decimal("1.75")
    at = datetime.datetime(2023, 1, 1)
    df = spark.createDataFrame([(i, "t", i + 0.5, at) for i in range(9)] + [(99, "t", float("nan"), at)], "k long, g string, v double, at timestamp")
    r = quantiles.percentiles(quantiles.combine(quantiles.daily_summaries(df, "g", "v", "at", "k")), {"p50": 0.5}).first()
    assert (r.p50, r.n, r.rank_error) == (4.5, 9, 0.0)


def test_bound_over_many_values():
    """A hundred thousand values in 200 summaries, merged level by level, twenty times over: the bound holds at 99 %, with room."""
    rng = np.random.default_rng(7)
    worst = []
    for trial in range(20):
        values = rng.lognormal(3, 2, 100_000) if trial % 2 else rng.integers(0, 1000, 100_000)
        heaps = []
        for p in np.array_split(values, 200):
            one = quantiles.Compactors()
            one.extend(p)
            heaps.append(one)
        while len(heaps) > 1:
            merged = []
            for i in range(0, len(heaps), 8):
                whole = quantiles.Compactors()
                for one in heaps[i : i + 8]:
                    whole.merge(one)
                merged.append(whole)
            heaps = merged
        exact, fractions = np.sort(values), [i / 100 for i in range(1, 100)]
        got = np.array(heaps[0].quantiles(fractions))
        low, high = np.searchsorted(exact, got, "left") / len(exact), np.searchsorted(exact, got, "right") / len(exact)
        worst.append(max(np.maximum(low - fractions, fractions - high)))
    assert sum(w > quantiles.rank_error() for w in worst) <= 1 and np.median(worst) < quantiles.rank_error()
