"""Pairs of items of one basket: their partitions grow with the rows."""

from __future__ import annotations

from collections import Counter
from itertools import combinations

from spindrift.operators import graph


def test_partitions_grow_with_the_rows(spark, monkeypatch):
    baskets = {b: {(b * 7 + i * i) % 23 for i in range(b % 9)} for b in range(120)}
    rows = [(b, x) for b, xs in baskets.items() for x in xs]
    want = Counter(p for xs in baskets.values() for p in combinations(sorted(xs), 2))
    items = spark.createDataFrame([*rows, *rows[:50]], "b long, x long")
    monkeypatch.setattr(graph, "ROWS", 50, raising=False)
    got = graph.coactivation(items, "b", "x")
    assert {(r.src, r.dst): r.weight for r in got.collect()} == dict(want)
    assert got.rdd.getNumPartitions() >= len(rows) // 50 > 4
