"""Greedy packing in halving rounds against the fold that it stands for."""

import random

import pytest

from codeloom.operators import packing, running, selection


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def greedy(items, budget):
    used, out = {}, []
    for k, o, c in sorted(items, key=lambda x: (x[1], x[0] or "")):
        fits = used.get(k, 0) + c <= budget
        used[k] = used.get(k, 0) + c * fits
        out.append((k, o, fits))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 3])
def test_rounds_equal_the_fold(spark, seed):
    rng = random.Random(seed)
    budget = {1: 100, 3: 7}[seed]
    items = []
    for k in ("hot", "b", None, "c"):
        for o in range(200 if k == "hot" else rng.randrange(1, 30)):
            items.append((k, o, rng.choice([0, 1, 2, budget // 2, budget // 2 + 1, budget, budget + 1, rng.randrange(budget + 2), rng.randrange(1 + budget // 9)])))
    df = spark.createDataFrame(items, "k string, ord int, cost long")
    want = greedy(items, budget)
    assert rows(packing.greedy_packed(df, budget, "cost", ["ord"], "k", few=0), "k", "ord", "placed") == want
    assert rows(packing.greedy_packed(df, budget, "cost", ["ord"], "k"), "k", "ord", "placed") == want


def test_alternating_large_and_tiny_items_take_logarithmic_rounds(spark, monkeypatch):
    made = []
    monkeypatch.setattr(packing, "in_ranges", lambda *a: made.append(1) or running.in_ranges(*a))
    items = [("k", o, 1 if o % 2 == 0 else 60 - o // 2) for o in range(100)]
    df = spark.createDataFrame(items, "k string, ord int, cost long")
    assert rows(packing.greedy_packed(df, 60, "cost", ["ord"], "k", few=0), "k", "ord", "placed") == greedy(items, 60)
    assert len(made) <= 7


def test_empty_and_quota(spark):
    none = spark.createDataFrame([], "k string, ord int, cost long, size long")
    assert packing.greedy_packed(none, 5, "cost", ["ord"], "k", few=0).count() == 0 and selection.quota(none, 2, 5, "k").count() == 0
    df = spark.createDataFrame([("k", o, s) for o, s in enumerate([3, 9, 4, 1, 1, 1])], "k string, ord int, size long")
    for few in (0, 100):
        assert rows(selection.quota(df, 3, 9, "k", few=few), "ord", "taken") == [(0, True), (1, False), (2, True), (3, True), (4, False), (5, False)]


def test_sum_before_over_ranges(spark):
    data = [(k, o, o + 1) for k in ("a", None) for o in range(50)]
    df = running.in_ranges(spark.createDataFrame(data, "k string, o int, v long"), ["k"], ["o"])
    assert df.select("bucket").distinct().count() > 2
    assert rows(running.sum_before(df, ["k"], ["o"], "v", "s"), "k", "o", "s") == sorted([(k, o, o * (o + 1) // 2) for k, o, _ in data], key=repr)
