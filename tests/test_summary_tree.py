"""Trees of summaries and their views against a plain tree, on sessions of odd lengths."""

from __future__ import annotations

import re

import pytest

from spindrift.operators import summary_tree as st

SCHEMA = "s string, k long, t long, x string, depth int, node string"


def session_rows():
    lengths = {"a": 1, "b": 2, "c": 3, "d": 7, "e": 64, "f": 65, "g": 131, "h": 200}
    rows = []
    for s, n in lengths.items():
        for i in range(n):
            t = None if i % 17 == 3 else (i * 7) % n // 2
            x = None if i % 13 == 5 else " \n" if i % 29 == 7 else f"Record {i} of {s}. " + "More words\tfollow here " * (i * 5 % 23) + ("No end " * 60 if i % 31 == 2 else "")
            rows.append((s, i, t, x, 9, "clash"))
    return [*rows, ("d", 3, 100, "the later one counts", 9, None), ("d", 3, None, "not this", 9, None), (None, 1, 1, "no session", 9, None), ("d", None, 1, "no key", 9, None)]


def plain(rows):
    best = {}
    for s, k, t, x, *_ in rows:
        if s is not None and k is not None:
            best[s, k] = max(best.get((s, k), ((-1, 0), "")), ((0, 0) if t is None else (1, t), x or ""))
    out = {}
    for s in {s for s, _ in best}:
        own = sorted((t, k, x) for (s2, k), (t, x) in best.items() if s2 == s)

        def build(lo, hi, depth):
            if hi - lo == 1:
                t, k, x = own[lo]
                flat = re.sub(r"\s+", " ", x).strip()
                m = re.match(r".{1,240}?(?:[.!?](?: |$)|$)", flat)
                return {"lo": lo, "hi": hi, "depth": depth, "key": k, "text": x, "preview": (m.group() if m and m.group() else flat)[:96], "start": t, "end": t}
            mid = lo + (hi - lo) // 2
            a, b = build(lo, mid, depth + 1), build(mid, hi, depth + 1)
            return {"lo": lo, "hi": hi, "depth": depth, "key": None, "text": "", "preview": f"{a['preview']} | {b['preview']}"[:96], "start": a["start"], "end": b["end"], "parts": (a, b)}

        out[s] = build(0, len(own), 0)
    return out


def walk(node):
    yield node
    for part in node.get("parts", ()):
        yield from walk(part)


def plain_view(root, budget):
    cost = lambda n: st.NODE_TOKENS + -(-len(n["preview"]) // 4)
    tokens = lambda n: -(-len(n["text"]) // 4)
    left = budget - st.VIEW_TOKENS - cost(root)
    if "parts" not in root:
        return [(root["lo"], root["hi"], max(0, tokens(root) - max(0, left)))]
    todo, out = [root], []
    while todo:
        todo.sort(key=lambda n: n["hi"])
        node = todo.pop()
        leaves = [p for p in node["parts"] if "parts" not in p]
        need = sum(map(cost, node["parts"])) - cost(node) + sum(map(tokens, leaves))
        if need - (tokens(leaves[0]) if leaves else 0) > left:
            out.append((node["lo"], node["hi"], 0))
            continue
        cut = max(0, need - left)
        left -= need - cut
        out += [(p["lo"], p["hi"], cut if p is leaves[0] else 0) for p in leaves]
        todo += [p for p in node["parts"] if "parts" in p]
    return out


@pytest.fixture(scope="module")
def built(spark):
    rows = spark.createDataFrame(session_rows(), SCHEMA).repartition(3)
    return rows, st.stored(st.tree(rows, "s", "k", "t", "x")), plain(session_rows())


def test_tree_equals_a_plain_tree(built):
    _, nodes, want = built
    got = nodes.collect()
    time = lambda t: None if t is None or t[0] == 0 else t[1]
    assert sorted((r.session, r.lo, r.hi, r.depth, str(r.key), r.preview, str(r.start_at), str(r.end_at)) for r in got) == sorted((s, n["lo"], n["hi"], n["depth"], str(n["key"]), n["preview"], str(time(n["start"])), str(time(n["end"]))) for s, root in want.items() for n in walk(root))
    assert len({r.node for r in got}) == len(got)


@pytest.mark.parametrize("budget", [0, 128, 300, 1000, 20000])
def test_view_equals_a_plain_pass(built, budget):
    rows, nodes, want = built
    got = {}
    for r in st.view(nodes, budget).collect():
        got.setdefault(r.session, []).append((r.lo, r.hi, r.cut))
    assert {s: sorted(v) for s, v in got.items()} == {s: sorted(plain_view(root, budget)) for s, root in want.items()}
    for s, v in got.items():
        assert [lo for lo, _, _ in sorted(v)] == [0, *[hi for _, hi, _ in sorted(v)][:-1]]  # every record is covered once


def test_a_view_of_one_node_and_its_texts(built):
    rows, nodes, want = built
    a, b = want["h"]["parts"][0]["parts"]
    root = nodes.filter(f"session = 'h' AND lo = {b['lo']} AND hi = {b['hi']}")
    got = st.shown(nodes, rows, "s", "k", "t", "x", 600, root).collect()
    assert sorted((r.lo, r.hi) for r in got) == sorted(v[:2] for v in plain_view(b, 600))
    texts = {n["lo"]: n["text"] for n in walk(b) if "parts" not in n}
    assert all(r.text is None if r.sources > 1 else texts[r.lo].startswith(r.text) and (r.truncated or r.text == texts[r.lo]) for r in got) and any(r.sources == 1 for r in got)


def test_trees_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    nodes = st.tree(none, "s", "k", "t", "x")
    assert nodes.isEmpty() and st.view(nodes, 500).isEmpty()


def test_places_of_a_hot_group_are_dealt_by_range(spark):
    rows = spark.range(3000).selectExpr("CASE WHEN id % 3 > 0 THEN 'hot' ELSE concat('g', id % 50) END AS g", "id * 7919 % 3001 AS o").repartition(7)
    got = st.placed(rows, "g", "o")
    assert got.rdd.getNumPartitions() > 0
    want = {}
    for g, o in sorted((r.g, r.o) for r in rows.collect()):
        want[g, o] = sum(1 for k in want if k[0] == g)
    assert {(r.g, r.o): r.place for r in got.collect()} == want
