"""Operators that SQL can't express, held against plain loops, and properties of the others."""

from __future__ import annotations

import itertools
import os
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindrift.functions import entities, scoring, text, vectors
from spindrift.functions.embedding import decode, embed, encode, slot
from spindrift.operators import cluster, context, dedup, facts, graph, search, temporal
from spindrift.plans import search as search_plans
from spindrift.plans import structure
from spindrift.sources import tables
from spindrift.streaming import streams


@pytest.fixture(scope="module")
def vecs(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return spark.createDataFrame([(i, i % 3, v[i].tolist(), float((i * 7) % 11) / 11) for i in range(60)], "id long, grp int, v array<double>, score double"), v


def test_mmr_is_greedy(spark, vecs):
    df, v = vecs
    got = {(r.grp, r.place): r.id for r in search.mmr(df, "grp", "id", "v", "score", 4, pool=15).collect()}
    for g in range(3):
        pool = sorted((i for i in range(60) if i % 3 == g), key=lambda i: (-((i * 7) % 11), i))[:15]
        chosen = []
        for place in range(1, 5):
            best = max((i for i in pool if i not in chosen), key=lambda i: (round(0.7 * ((i * 7) % 11) / 11 - 0.3 * (max(v[i] @ v[j] for j in chosen) if chosen else 0), 12), -pool.index(i)))
            chosen.append(best)
            assert got[g, place] == best


def test_leaders_follow_the_order(spark, vecs):
    df, v = vecs
    got = {r.id: r.cluster for r in cluster.leaders(df, "grp", "id", "v", 0.3).collect()}
    for g in range(3):
        sums = []
        for i in range(g, 60, 3):
            s = [m @ v[i] / np.linalg.norm(m) for m in sums]
            if s and max(s) >= 0.3:
                k = int(np.argmax(s))
                sums[k] = sums[k] + v[i]
            else:
                k = len(sums)
                sums.append(v[i])
            assert got[i] == k


def test_spread_identity_and_geometry(spark, vecs):
    df, v = vecs
    got = {r.grp: r.spread for r in cluster.spread(df, "grp", "v").collect()}
    geometry = {r.grp: r for r in cluster.geometry(df, "grp", "v").collect()}
    for g in range(3):
        own = v[g::3]
        pairs = [1 - a @ b for a, b in itertools.combinations(own, 2)]
        assert got[g] == pytest.approx(np.mean(pairs))
        values = np.linalg.eigvalsh(np.cov(own.T, bias=True))
        assert geometry[g].dimension == pytest.approx(values.sum() ** 2 / (values**2).sum())
        assert geometry[g].spread == pytest.approx(np.mean(pairs))


def test_hash_blocking_loses_nothing(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    texts = [" ".join(words[(i * j) % 10] for j in range(1, 9)) + (" x" if i % 4 == 0 else "") for i in range(40)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    signed = dedup.hashes(rows, "id", "t")
    got = {(r.a, r.b) for r in dedup.hash_candidates(signed, "id").collect()}
    s = {}
    for r in signed.collect():
        s.setdefault((r.simhash, tuple(r.minhash)), r.id)
    want = set()
    for (h, m), (k, n) in itertools.combinations(s, 2):
        if bin(h ^ k).count("1") <= 4 or np.mean(np.array(m) == np.array(n)) >= 0.7:
            want.add(tuple(sorted((s[h, m], s[k, n]))))
    assert got == want


def plain_word_code(word):
    """Letter by letter, with the low 32 bits of a product rounded to a double."""
    signed = lambda x: (x & 0xFFFFFFFF) - ((x & 0x80000000) << 1)
    h = 2166136261
    for c in word.encode():
        h = signed(int(float(signed(h) ^ c) * 16777619.0))
    h &= 0xFFFFFFFF
    return ((h >> 16) * 65599 + (h & 0xFFFF)) & 0xFFFFFFFF


def plain_minhash(text):
    units = [int.from_bytes(x, "little") for x in itertools.batched(f"  {text.lower()}  ".encode("utf-16-le"), 2)]
    out = []
    for seed in range(128):
        start = (2166136261 ^ ((seed + 1) * 0x9E3779B9 & 0xFFFFFFFF)) & 0xFFFFFFFF
        values = []
        for gram in zip(units, units[1:], units[2:]):
            h = start
            for c in gram:
                h = (h ^ c) * 16777619 & 0xFFFFFFFF
            values.append(h)
        out.append(min(values))
    return out


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aB z_9é🙂\n-"), max_size=30), min_size=1, max_size=5))
def test_hashes_as_a_plain_version(texts):
    got = dedup.simhashes(texts)
    for t, h in zip(texts, got):
        votes = [0] * 32
        for w in re.findall("[a-z0-9_]+", t.lower()):
            code = plain_word_code(w)
            votes = [v + (1 if code >> i & 1 else -1) for i, v in enumerate(votes)]
        assert h == sum((v > 0) << i for i, v in enumerate(votes))
        assert dedup.minhash(t).tolist() == (plain_minhash(t) if t.strip() else [0] * 128)


@pytest.mark.parametrize("least", [0.3, 0.5, 0.75])
def test_word_jaccard_finds_all(spark, least):
    rng = random.Random(3)
    texts = [" ".join(rng.choices("abcdefghij", [9, 8, 7, 6, 5, 4, 3, 2, 1, 1], k=rng.randint(1, 9))) for _ in range(60)]
    texts += ["a b c d", "b c d e", "a b c d e", "x y", "x y z", "", "D c b A", "the the a b"]
    got = {(r.a, r.b): r.jaccard for r in dedup.word_jaccard(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", "t", least).collect()}
    sets = [frozenset(t.lower().split()) for t in texts]
    firsts = {s: i for i, s in reversed(list(enumerate(sets)))}
    want = {(i, j): len(a & b) / len(a | b) for (a, i), (b, j) in itertools.combinations(sorted(firsts.items(), key=lambda x: x[1]), 2) if a and b and len(a & b) / len(a | b) >= least}
    assert got == pytest.approx(want)


def _conversations(spark, path):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    texts = ["a b c d", "D c b A", "a b c d", "x y z w", "w z y x", "lonely pair here", "here lonely pair", "", ""] + [" ".join(words[(i * j) % 10] for j in range(1, 9)) for i in range(20)] * 2
    rows = [(i // 100 + 1, i % 100, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{path}/conversations.parquet")
    spark.createDataFrame([(c * 100 + i, t) for c, i, t in rows], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return {c * 100 + i: t for c, i, t in rows}


def _stars(same):
    """Every row's class representative; `same` maps a row to what is equal within a class."""
    first = {}
    return {i: first.setdefault(x, i) for i, x in sorted(same.items())}


def test_dup_jaccard_links_all_rows(spark, tmp_path):
    sets = {i: frozenset(t.lower().split()) for i, t in _conversations(spark, tmp_path).items() if t}
    got = {(r.a, r.b): r.jaccard for r in structure.dup_jaccard(spark, str(tmp_path)).collect()}
    rep = _stars(sets)
    for (i, a), (j, b) in itertools.combinations(sets.items(), 2):
        link = len(a & b) / len(a | b)
        if rep[i] != rep[j]:
            assert got.get(tuple(sorted((rep[i], rep[j]))), 0) == pytest.approx(link if link >= 0.8 else 0, abs=1e-6)
    assert {p for p, s in got.items() if s == 1} == {(r, i) for i, r in rep.items() if i != r}


def test_dup_hashes_links_all_rows(spark, tmp_path):
    texts = _conversations(spark, tmp_path)
    got = [tuple(r) for r in structure.dup_hashes(spark, str(tmp_path)).select("a", "b", "hamming", "minhash", "stage").collect()]
    signed = {r.id: (r.simhash, tuple(r.minhash)) for r in dedup.hashes(spark.createDataFrame(list(texts.items()), "id long, t string"), "id", "t").collect()}
    rep = _stars(signed)
    want = set()
    for i, j in itertools.combinations(sorted(texts), 2):
        bits, same = bin(signed[i][0] ^ signed[j][0]).count("1"), float(np.mean(np.array(signed[i][1]) == np.array(signed[j][1])))
        if bits <= 4 or same >= 0.7:
            stage = "both" if bits <= 4 and same >= 0.7 else "simhash" if bits <= 4 else "minhash"
            if rep[i] == rep[j]:
                want.add((rep[i], j, 0, 1.0, "both"))
            else:
                a, b = sorted((rep[i], rep[j]))
                want.add((a, b, bits, same, stage))
    assert len(got) == len(set(got)) and set(got) == want


def test_lookup_at_least_has_no_cap(spark, tmp_path):
    rows = [(i, [1.0, i / 1000]) for i in range(150)] + [(500, [0.0, 1.0]), (None, [1.0, 0.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.a, r.b) for r in search_plans.near_duplicate_lookup(spark, str(tmp_path)).collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if i is not None}
    assert got == {(a, b) for a in unit for b in unit if a % 100 == 0 and a != b and unit[a] @ unit[b] >= 0.4} and len(got) > 290


def test_entity_matches_against_all_pairs(spark):
    names = ["sprocket", "sprockets", "Big sprocket", "big  sprocket", "шестерня", "Шестерня", "шестерня м", "歯", "歯車", "歯車箱", "", "", "ab", "abab", "b", "a b", "red green blue", "blue green red", "x y z w v", "x y z w", "тест", None, "!!", "!!"]
    got = {(r.a, r.b): r.score for r in dedup.entity_matches(spark.createDataFrame(list(enumerate(names)), "id long, n string"), "id", "n").collect()}
    first: dict = {}
    low = [(i, n.lower()) for i, n in enumerate(names) if n is not None]
    want = {(first[n], i): 1.0 for i, n in low if first.setdefault(n, i) != i}
    for (x, i), (y, j) in itertools.combinations(first.items(), 2):
        v, w = ({t for t in re.split("[^a-z0-9_]+", s) if t} for s in (x, y))
        jaccard = len(v & w) / max(1, len(v | w))
        if jaccard >= 0.8:
            want[i, j] = jaccard
        elif x and y and (x in y or y in x) and min(len(x), len(y)) / max(len(x), len(y)) >= 0.5:
            want[i, j] = 0.85
    assert got == pytest.approx(want)


def test_merge_all_sentences_keeps_long_documents(spark, tmp_path):
    long = ". ".join(f"sentence {i} of a long document" for i in range(40))
    columns = ", ".join(f"{c} {t}" for c, t in (("doc_id", "long"), ("text", "string"), ("lang", "string"), ("source", "string")))
    spark.createDataFrame([(1, long + ".", "en", "s"), (51, "short. sentence 3 of a long document!", "en", "s")], columns).write.parquet(f"{tmp_path}/documents.parquet")
    (r,) = structure.merge_all_sentences(spark, str(tmp_path)).collect()
    assert (r.grp, r.sources) == (1, 2) and r.merged == ". ".join(sorted({*long.split(". "), "short"}))


def test_capped_pairs_are_greedy(spark):
    tables.shared_folder(spark)
    rng = np.random.default_rng(1)
    pairs = sorted({tuple(sorted(map(int, rng.choice(12, 2, False)))) for _ in range(40)})
    rows = [(a, b, float((a * 5 + b * 3) % 7)) for a, b in pairs]
    got = {(r.a, r.b) for r in graph.capped_pairs(spark.createDataFrame(rows, "a int, b int, score double"), [F.desc("score"), "a", "b"], 2).collect()}
    used, want = {}, set()
    for a, b, _ in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if used.get(a, 0) < 2 and used.get(b, 0) < 2:
            want.add((a, b))
            used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
    assert got == want


def test_budget_skips_and_goes_on(spark):
    rows = [("g", i, s, float(o), p) for i, (s, o, p) in enumerate([(50, 1, True), (60, 9, False), (30, 8, False), (200, 7, False), (10, 6, False), (5, 5, False)])]
    got = [r.id for r in context.fit_budget(spark.createDataFrame(rows, "grp string, id int, n int, o double, p boolean"), "grp", "id", "n", "o", "p", 100).orderBy("place").collect()]
    used, want = 0, []
    for _, i, n, o, p in sorted(rows, key=lambda r: (not r[4], -r[3])):
        if p or used + n <= 100:
            used, want = used + n, [*want, i]
    assert got == want


def test_folds_are_ordered(spark):
    events = [(1, i * 4000, "contradict" if i % 3 == 2 else "support") for i in range(6)] + [(2, 10, "support"), (2, 20, "support")]
    got = {r.k: (r.confidence, r.stability) for r in temporal.reinforce(spark.createDataFrame(events, "k int, t long, what string"), "k", "t", "what").collect()}
    assert got[2] == (pytest.approx(0.6), pytest.approx(0.05))  # the second is within the cooldown
    confidence, gained, n, last = 0.5, 0.0, 0, None
    for _, t, what in events[:6]:
        if what == "contradict":
            confidence = max(0.0, confidence - 0.3)
        elif last is None or t - last >= 3600:
            step = min(0.1 * 0.85**n, 0.15 - gained)
            confidence, gained, n, last = confidence + step, gained + step, n + 1, t
    assert got[1][0] == pytest.approx(confidence)


def test_stream_salience_is_the_batch_fold(spark, tmp_path):
    rows = [(i % 2, "abc"[i % 3], f"2024-01-01 00:{i:02d}:00") for i in range(30)]
    spark.createDataFrame(rows, "k int, e string, t string").withColumn("t", F.col("t").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, e string, t timestamp").parquet(str(tmp_path / "in"))
    got = {(r.k, r.e): r.salience for r in streams.run_available(streams.salience(stream, "k", "e", "t"), "update").collect()}
    for k in (0, 1):
        for e, s in streams.fold_salience([e for j, e, _ in rows if j == k], {}).items():
            assert got[k, e] == pytest.approx(s)


def test_score_identity(spark, vecs):
    df = search.boosted(vecs[0], "score", {"a": F.col("grp") * 0.4, "b": F.lit(-0.3)})
    for r in df.collect():
        assert r.final == pytest.approx(min(1, max(0, r.score + sum(r.boosts.values()))))


def test_order_does_not_depend_on_partitions(spark, vecs):
    df, v = vecs
    one = [r.id for r in search.vector_top_k(df, "v", v[0].tolist(), 9, "id").collect()]
    assert one == [r.id for r in search.vector_top_k(df.repartition(7).orderBy(F.desc("id")), "v", v[0].tolist(), 9, "id").collect()]
    assert one[0] == 0


def test_components_of_paths(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 1, 1.0), (3, 4, 5.0)], "src int, dst int, weight double")
    got = [(r.path, r.total) for r in graph.simple_paths(edges, 1, 4, 3, 5).collect()]
    assert got == [([1, 2, 3, 4], 7.0)]
    assert {(r.vertex, r.hops) for r in graph.bfs(edges, spark.createDataFrame([(1,)], "vertex int"), 2).collect()} == {(1, 0), (2, 1), (3, 2)}
    chain = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11), (11, 12), (12, 11), (20, 20), *((i, i + 1) for i in range(100, 140))], "id int, nxt int")
    want = {(1, 4, 3), (2, 4, 2), (3, 4, 1)} | {(i, 140, 140 - i) for i in range(100, 140)}
    assert {(r.src, r.dst, r.links) for r in graph.chain_ends(chain, "id", "nxt").collect()} == want
    assert graph.chain_ends(chain.limit(0), "id", "nxt").collect() == []


def test_cycles_in_time(spark):
    edges = spark.createDataFrame([(1, 2, 0, 10), (2, 3, 5, None), (3, 1, 8, 9), (3, 4, 0, 3), (4, 2, 0, 20), (7, 7, 0, 1)], "src int, dst int, low int, high int")
    assert {(r.vertex, r.hops) for r in graph.temporal_cycles(edges, 4).collect()} == {(1, 3), (2, 3), (3, 3), (7, 1)}


def test_geometry_of_nothing(spark):
    none = spark.createDataFrame([], "grp int, v array<double>")
    assert cluster.geometry(none, "grp", "v").collect() == [] and search.vector_top_k(none, "v", [], 3, "grp").collect() == []


def test_merge_safety_and_dates(spark):
    rows = spark.createDataFrame([(1, "fact", "active", False, True, "u", False, False, 0.9), (1, "note", None, False, True, "u", False, False, None), (2, "fact", "archived", True, False, "a", True, True, 0.1), (2, "fact", "active", None, True, "b", False, False, 0.8)], "g int, kind string, status string, merged boolean, mergeable boolean, owner string, private boolean, secrets boolean, similarity double")
    got = {r.g: (r.members, r.blockers, r.warnings) for r in facts.safety(rows, "g").collect()}
    assert got == {1: (2, ["type_consistency"], []), 2: (2, ["immutability", "already_merged", "min_similarity", "active_status"], ["multi_user", "privacy", "secrets"])}
    notes = {"on 2024-03-05": "2024-03-05", "3 weeks ago": "2024-01-11", "yesterday": "2024-01-31", "In May 2021": "2021-05-15", "by 1999": "1999-07-02", "never": None, None: None, "2024-99-99 tomorrow": "2024-02-02"}
    df = spark.createDataFrame([(n,) for n in notes], "n string").select("n", facts.date_in(F.col("n"), F.lit("2024-02-01").cast("date")).cast("string").alias("d"))
    assert {r.n: r.d for r in df.collect()} == notes


def test_contradictions_of_null_statements(spark):
    new = spark.createDataFrame([(1, "s", None, "k", 5), (2, "s", "the lamp is not good", "k", 5)], "new_id int, subject string, content string, kind string, at int")
    old = spark.createDataFrame([(2, "s", "the lamp is not good", "k", None, None, None), (3, "s", None, None, 1, 2, False), (4, "s", "the lamp is not good", "k", 1, 2, True), (5, "s", "the lamp is good", "k", 1, 2, None)], "old_id int, subject string, content string, kind string, valid_from int, valid_to int, protected boolean")
    got = {(r.new_id, r.old_id, r.rule): r.confidence for r in facts.contradictions(new, old, "subject").collect()}
    assert got == {(2, 5, "negation"): pytest.approx(0.75 * 0.9 * 1.2)}


def test_streams_of_several_batches(spark, tmp_path):
    schema = "user long, kind string, ts timestamp"
    for i, rows in enumerate([[(1, "a", 0), (1, "b", 1)], [(1, "a", 60), (2, "a", 61)], [(1, "b", 120)]]):
        spark.createDataFrame(rows, "user long, kind string, s long").selectExpr("user", "kind", "timestamp_seconds(s) AS ts").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    for i in range(3):
        os.utime(f"{tmp_path}/in/{i}", (i, i))
    read = lambda path: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)
    got = streams.run_available(streams.salience(read(f"{tmp_path}/in"), "user", "kind", "ts"), "update", ("user", "kind"))
    found = {(r.user, r.kind): r.salience for r in got.collect()}
    assert set(found) == {(1, "a"), (1, "b"), (2, "a")} and got.count() == 3
    (tmp_path / "empty").mkdir()
    for mode, keys in (("update", ("user", "kind")), ("append", ())):
        stream = streams.salience(read(f"{tmp_path}/empty"), "user", "kind", "ts") if keys else read(f"{tmp_path}/empty")
        assert streams.run_available(stream, mode, keys).collect() == []


def test_vectors_and_text(spark):
    r = spark.range(1).select(
        vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("zero"), vectors.euclidean(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))).alias("far"),
        text.truncate(F.lit("x" * 100), 10).alias("cut"), scoring.tiered_decay(F.lit(0), F.lit(10.0), F.lit("fact"), F.lit("sturdy")).alias("kept"),
    ).first()
    assert (r.zero, r.far, len(r.cut), r.kept) == (0.0, float("inf"), 40, 100.0)
    assert text.parse_query('Find "big cat" -Dog find') == (["find"], ["big cat"], ["dog"])
    assert text.query_terms("The quick AND the fox, a quick") == ["quick", "fox"]


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=60))
def test_embedding_has_unit_length(content):
    v = np.array(embed(content))
    assert np.linalg.norm(v) == pytest.approx(1.0) or not v.any()
    if v.any():
        assert np.allclose(decode(encode(v.tolist())), v, atol=1e-6)
    assert 0 <= slot(content) < 768


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"type":"user","uuid":"1","timestamp":"1706745600000","message":{"role":"user","content":"hi"}}\nbroken\n{"type":"x","uuid":"2","timestamp":"2024-02-01T00:00:00Z","message":{"role":"assistant","content":"[{\\"type\\":\\"text\\",\\"text\\":\\"a\\"},{\\"type\\":\\"tool\\"},{\\"type\\":\\"text\\",\\"text\\":\\"b\\"}]"}}\n')
    got = {r.uuid: (r.role, r.content, r.at.isoformat()) for r in tables.transcripts(spark, str(tmp_path / "*.jsonl")).collect()}
    assert got == {"1": ("user", "hi", "2024-02-01T00:00:00"), "2": ("assistant", "a\nb", "2024-02-01T00:00:00")}
    a, b = spark.createDataFrame([("x", 1, "old")], "c string, t int, s string"), spark.createDataFrame([("x", 2), ("y", 1)], "c string, t int")
    assert sorted((r.c, r.t, r.s) for r in tables.merge_stores([a, b], "c", "t").collect()) == [("x", 2, None), ("y", 1, None)]
    tables.backup(a, str(tmp_path / "bk"))
    assert tables.restore(spark, str(tmp_path / "bk"), a.schema).collect() == a.collect()


def test_fold_clamped_of_a_hot_key_equals_a_loop(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"k{i % 7}", rng.randint(0, 400) if i % 50 else None, i, rng.choice([-3.0, -1.0, 0.5, 2.0, None])) for i in range(900)] + [(None, 1, 1, 1.0)]
    events = spark.createDataFrame(rows, "k string, t long, i long, d double").repartition(4)
    got = {r.k: (round(r.value, 9), r.events) for r in temporal.fold_clamped(events, "k", ["t", "i"], "d", 1.0, 0.0, 5.0).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        value, own = 1.0, sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        for r in own:
            value = min(max(value + (r[3] or 0.0), 0.0), 5.0)
        want[k] = (round(value, 9), len(own))
    assert got == want and temporal.fold_clamped(events.limit(0), "k", ["t", "i"], "d", 1.0, 0.0, 5.0).isEmpty()


def test_long_runs_of_names_and_folders_end_no_task(spark):
    rng = np.random.default_rng(4)
    parts = ["Linear", "Model", "Models", "System", "and", "Big", "Process.", "A", "/ab", "/c-", "//d", "./", " ", "\n", "x"]
    texts = ["".join(parts[i] + " " * int(rng.integers(0, 2)) for i in rng.integers(0, len(parts), 14)) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate([*texts, "Aabb Ccdd " * 10000, "Aabb " * 10000 + "Model", "x " + "/ab" * 20000])), "i int, t string")
    got = {r.i: {(e.kind, e.name) for e in r.e} for r in rows.select("i", entities.entities(F.col("t")).alias("e")).collect()}
    for kind, _, pattern, group in (p for p in entities.PATTERNS if p[0] in ("file", "concept")):
        plain = [{m[group].strip(" \t\n\r\f\v") for m in re.finditer(pattern.replace(r"\/", "/"), t, re.ASCII)} for t in texts]
        assert all((kind, n) in got[i] for i, names in enumerate(plain) for n in names) and sum(map(len, plain)) > 100 or group == 1
        assert kind == "concept" or all({n for k, n in got[i] if k == kind} == names for i, names in enumerate(plain))
    assert got[400] == set() and len(got[401]) == 1 and got[402] == {("file", "/ab" * 20000)}
