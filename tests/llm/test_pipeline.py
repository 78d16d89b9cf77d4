from __future__ import annotations

from collections import Counter, defaultdict

import pytest
from oracle import assert_same, connect
from test_llm import brute_components

import corpus_pipeline
from spindrift.llm import queries
from spindrift.llm.tables import written


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, sf_dir, name):
    assert_same(spark, connect(sf_dir), sf_dir, queries.queries()[name], queries.oracle_sql()[name])


def test_stages(spark, docs, nothing):
    for start in (docs, nothing):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            before, now = now, written(stage(spark, now, ""))
            if name == "pack":
                assert now.columns[:3] == ["doc_id", "start", "length"]
                assert (now.count() > 0) == (before.count() > 0)
                continue
            assert now.columns == start.columns
            if name in ("lines", "passages"):
                assert now.count() == before.count()
            if name == "near_duplicates" and start is docs:
                assert 0 < now.count() < before.count()
            if name == "language" and start is docs:
                assert {r.doc_id for r in before.collect()} - {r.doc_id for r in now.collect()}


def plain_language(rows):
    return [(i, t, s) for i, t, s in rows if any(c.isalpha() for c in t or "")]


def plain_lines(rows):
    pages, held = Counter(s for _, _, s in rows), Counter()
    for _, t, s in rows:
        held.update({(s, x.strip(" ")) for x in (t or "").split("\n") if x.strip(" ")} if t is not None else ())
    gone = {k for k, n in held.items() if n >= 5 and n > 0.08 * pages[k[0]]}
    return [(i, None if t is None else "\n".join(x for x in t.split("\n") if (s, x.strip(" ")) not in gone), s) for i, t, s in rows]


def plain_near_duplicates(rows):
    gone = {i for i, _, c in brute_components([(i, t) for i, t, _ in rows]) if i != c}
    return [r for r in rows if r[0] not in gone]


def plain_passages(rows):
    first: dict = {}
    for i, t, _ in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49) if i is not None else ():
            first[b[k : k + 50]] = min(first.get(b[k : k + 50], i), i)
    out = []
    for i, t, s in rows:
        b, gone = (t or "").encode(), set()
        for k in range(len(b) - 49) if i is not None else ():
            if first[b[k : k + 50]] < i:
                gone.update(range(k, k + 50))
        out.append((i, None if t is None else bytes(c for k, c in enumerate(b) if k not in gone).decode(errors="ignore"), s))
    return out


def test_stages_as_plain_versions(spark, docs):
    """Every stage on what its predecessor kept, against loops; the pieces of the last one hold each kept text's ids once."""
    plain = {"language": plain_language, "lines": plain_lines, "near_duplicates": plain_near_duplicates, "passages": plain_passages}
    now, rows = docs, [(r.doc_id, r.text, r.source) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now, before = written(stage(spark, now, "")), rows
        rows = plain[name](rows)
        assert Counter((r.doc_id, r.text, r.source) for r in now.collect()) == Counter(rows), name
        assert name == "lines" or rows != before
    assert all(r.n_chars is None or r.text is None or r.n_chars == len(r.text) for r in now.collect())
    pieces = defaultdict(list)
    for r in corpus_pipeline.STAGES[-1][1](spark, now, "").collect():
        pieces[r.doc_id].append((r.start, r.length, r.doc_tokens))
    assert set(pieces) == {i for i, _, _ in rows}
    for i, n in Counter(i for i, _, _ in rows).items():
        if n == 1:
            ends = [(a + b) for a, b, _ in sorted(pieces[i])]
            assert [a for a, _, _ in sorted(pieces[i])] == [0, *ends[:-1]] and ends[-1] == pieces[i][0][2]


def test_registered(spark):
    import __spark_entry__ as e

    names = e.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
