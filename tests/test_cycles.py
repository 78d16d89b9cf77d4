"""Cycles of any length against Tarjan's algorithm on random graphs."""

from __future__ import annotations

import random

from spindrift.operators import cycles


def tarjan(edges):
    after, index, low, stack, out = {}, {}, {}, [], []
    for a, b in edges:
        after.setdefault(a, set()).add(b)
        after.setdefault(b, set())

    def visit(v):
        index[v] = low[v] = len(index)
        stack.append(v)
        for w in after[v]:
            if w not in index:
                visit(w)
            if w in stack:
                low[v] = min(low[v], low[w])
        if low[v] == index[v]:
            at = stack.index(v)
            out.append(stack[at:])
            del stack[at:]

    for v in after:
        if v not in index:
            visit(v)
    return {(v, min(c), len(c)) for c in out for v in c if len(c) > 1 or v in after[v]}


def test_components_of_random_graphs(spark):
    rng, edges = random.Random(4), []
    for g in range(8):  # disjoint graphs of different density, in one table
        n = rng.randint(3, 16)
        edges += [(100 * g + rng.randrange(n), 100 * g + rng.randrange(n)) for _ in range(int(n * (0.6 + 0.2 * g)))]
    edges += [(5000 + i, 5001 + i) for i in range(30)] + [(6000 + i, 6000 + (i + 1) % 12) for i in range(12)] + [(7000, 7000), (7001, 7000), (6005, 5003)]
    table = spark.createDataFrame([*edges, *edges[:9], (None, 3), (3, None)], "src long, dst long").repartition(4)
    got = {tuple(r) for r in cycles.components(table).collect()}
    assert got == tarjan(edges) and (6007, 6000, 12) in got and (7000, 7000, 1) in got and not any(5000 <= v < 6000 for v, _, _ in got)
    inside = {(r.src, r.dst) for r in cycles.cycle_edges(table, cycles.components(table)).collect()}
    own = {v: c for v, c, _ in got}
    assert inside == {(a, b) for a, b in edges if a in own and own.get(a) == own.get(b)}


def test_no_cycles(spark):
    table = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(3, 50)], "src long, dst long")
    assert cycles.components(table).isEmpty() and cycles.components(table.limit(0)).isEmpty()
