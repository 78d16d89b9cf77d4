"""Every operator on a small table of odd cases, against a plain version of itself, and on an empty table."""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindrift.llm import bpe, components, exact_dedup, fingerprint, jaccard, langid, line_dedup, packing, quality, repeats, samples, shingles, tables, toxicity
from spindrift.llm.tables import held_out, tokenizer_path


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(words))


def table(df):
    return [r.asDict() for r in df.collect()]


# 1. quality


def test_factorisation_machine_identity():
    m = quality.Machine(3)
    m.w[:] = np.random.default_rng(1).normal(size=len(m.w))
    rows = [quality.features(t) for t in ("A b c b.", None, "x" * 50, "| a | b |\n| a | b |")]
    got = m.score(rows)
    for (i, x), s in zip(rows, got):
        pairs = sum(float(m.v[i[a]] @ m.v[i[b]]) * x[a] * x[b] for a in range(len(i)) for b in range(a))
        assert s == pytest.approx(1 / (1 + np.exp(-(m.w0 + float((m.w[i] * x).sum()) + pairs))), rel=1e-4)


def test_quality_learns_and_handles_odd_rows(spark, docs, nothing):
    good = [(i, " ".join(f"w{(i * j) % 97}" for j in range(30)) + ".", 1) for i in range(200)]
    bad = [(1000 + i, " ".join(f"W{(i * j) % 97}!!" for j in range(30)), 0) for i in range(100)]
    all_ = spark.createDataFrame([*good, *bad, (None, "t", None)], "doc_id long, text string, quality int")
    got = table(quality.quality(all_.select("doc_id", "text"), all_.select("doc_id", "quality")))
    assert len(got) == 301 and all(0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["predicted"] == int(r["doc_id"] < 1000) for r in got if r["doc_id"] is not None]) > 0.97
    empty = spark.createDataFrame([], "doc_id long, quality int, score double")
    assert {r["score"] for r in table(quality.quality(docs, empty))} and table(quality.quality(nothing, empty)) == []


def test_a_sample_has_a_row_for_each_document(spark):
    texts = spark.createDataFrame([(i % 50, f"t {i % 50} {i % 3}") for i in range(5000)] + [(7, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    got = samples.labelled_sample(texts, labels, "quality", 10).collect()
    assert len(got) == len({r.doc_id for r in got}) == 10 and all(r.text in (f"t {r.doc_id} 0", "") for r in got)


# 2. exact deduplication


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300), st.integers(0, 300))
def test_fingerprints_compose(data, cut):
    a, b = data[:cut], data[cut:]
    assert exact_dedup.combine(exact_dedup.fingerprint(a), exact_dedup.fingerprint(b)) == exact_dedup.fingerprint(data)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300), st.integers(1, 60))
def test_shifted_parts_add_up(data, size):
    parts = [data[i : i + size] for i in range(0, len(data), size)]
    shares = [exact_dedup.shifted(p, len(data) - min(len(data), (i + 1) * size)) for i, p in enumerate(parts)]
    assert tuple(sum(x[k] for x in shares) % exact_dedup.PRIMES[k] for k in (0, 1)) == exact_dedup.fingerprint(data)[:2]


def test_exact_duplicates_of_repeated_rows(spark):
    rows = [(1, "a"), (1, "a"), (2, "b"), (3, "x" * 200_000), (4, "x" * 200_000), (4, "x" * 200_000), (5, "x" * 199_999 + "y")]
    got = table(exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    want = [(1, 1, 2), (1, 1, 2), (2, 2, 1), (3, 4, 3), (4, 4, 3), (4, 4, 3), (5, 5, 1)]
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == want


@pytest.mark.parametrize("modulus", [None, 2])
def test_exact_duplicates(docs, nothing, modulus):
    got = table(exact_dedup.exact_duplicates(docs, modulus))
    groups = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        groups[r.text or ""].append(r.doc_id)
    want: Counter = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want.update((i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got) == want
    assert table(exact_dedup.exact_duplicates(nothing, modulus)) == []


# 3. toxicity


def test_folding_and_exceptions():
    assert toxicity.fold("Ｉd1οt, с10wn!") == toxicity.fold("idiot clown") == " idiot ciown "
    assert toxicity.fold(None) == " " and toxicity.fold("É​t́e 12") == " ete "
    lexicon = toxicity.Lexicon({toxicity.fold("clown"): (0.01, 0.00002), " vequ": (0.02, 0.0002)}, {toxicity.fold("clown fish")})
    assert lexicon.score("a CLOWN") > 0.5 > lexicon.score("a clown fish") and lexicon.score("vequmo x") > 0.5 > lexicon.score("")
    assert lexicon.score("a clown " + "word " * 900) < 0.5 < lexicon.score("a clown " * 9 + "word " * 900)


def plain_score(lexicon, text):
    """Scans for every term at every place, and takes each exception phrase out."""
    folded = toxicity.fold(text)
    spared = {i for e in lexicon.exceptions for s in range(len(folded)) if folded.startswith(e, s) for i in range(s, s + len(e) - 1)}
    hits: Counter = Counter()
    for s in set(range(len(folded))) - spared:
        if here := [t for t in lexicon.terms if folded.startswith(t, s)]:
            hits[max(here, key=lambda t: (np.log(lexicon.terms[t][0] / lexicon.terms[t][1]), t))] += 1
    n, total = len(folded.split()), 0.0
    for t, k in hits.items():
        q, b = lexicon.terms[t]
        total += max(0.0, k * np.log(q / b) - n * (q - b))
    return 1 / (1 + np.exp(-(min(30.0, total + lexicon.bias))))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["clown", "cl0wns", "fish", "vequ", "vequmo", "ve", "the", "Clown,", "x"]), max_size=25))
def test_matching_as_a_plain_scan(words):
    terms = {toxicity.fold("clown"): (0.05, 0.001), toxicity.fold("vequ")[:-1]: (0.1, 0.01), toxicity.fold("vequmo"): (0.02, 0.001), toxicity.fold("ve"): (0.03, 0.02)}
    lexicon = toxicity.Lexicon(terms, {toxicity.fold("clown fish"), toxicity.fold("the vequmo")})
    assert lexicon.score(" ".join(words)) == pytest.approx(plain_score(lexicon, " ".join(words)))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["clown", "fish", "vequmo", "the", "a"]), max_size=40))
def test_hits_outside_exceptions_as_a_plain_scan(words):
    lexicon = toxicity.Lexicon({toxicity.fold("clown"): (0.01, 0.00002), " vequ": (0.02, 0.0002)}, {toxicity.fold("clown fish"), toxicity.fold("fish clown"), toxicity.fold("the vequmo")})
    folded = toxicity.fold(" ".join(words))
    spared = [(i, i + len(e) - 1) for e in lexicon.exceptions for i in range(len(folded)) if folded.startswith(e, i)]
    plain = Counter(t for t in lexicon.terms for i in range(len(folded)) if folded.startswith(t, i) and not any(a <= i < b for a, b in spared))
    assert lexicon.hits(folded) == plain


def test_a_million_words_with_exceptions():
    lexicon = toxicity.Lexicon({toxicity.fold("clown"): (0.01, 0.00002)}, {toxicity.fold("clown fish")})
    began = time.perf_counter()
    assert lexicon.hits(toxicity.fold("clown fish clown " * 333_333))[toxicity.fold("clown")] == 333_333 and time.perf_counter() - began < 30


def test_toxicity_learns_words_stems_and_leaves_others(spark, docs, nothing):
    rng = random.Random(5)
    words = [f"{a}{b}{c}" for a in "brt" for b in "aeiou" for c in ("n", "ks", "mp")]
    rows = []
    for i in range(600):
        w = [rng.choice(words) for _ in range(25)]
        if toxic := i % 8 == 0:
            w.insert(rng.randint(0, 25), rng.choice(["snarf", "zorgan", "zorgix", "zorgul"]))
        rows.append((i, " ".join(w), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = table(toxicity.toxicity(df.select("doc_id", "text"), df.select("doc_id", "toxic")))
    assert all(r["predicted"] == int(r["doc_id"] % 8 == 0) for r in got)
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert len(table(toxicity.toxicity(docs, empty))) == docs.count() and table(toxicity.toxicity(nothing, empty)) == []


# 4. Jaccard join


def brute_sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [brute_sets(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        return x if up[x] == x else root(up[x])

    for x in range(len(rows)):
        for y in range(x):
            if None not in (rows[x][0], rows[y][0]) and sets[x] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                up[root(x)] = root(y)
    least = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[root(x)] = min(least.get(root(x), i), i)
    return Counter((i, len(sets[x]), least.get(root(x))) for x, (i, _) in enumerate(rows))


def near_family(seed=4, n=60):
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"v{rng.randint(0, 10**6)}"
        out.append((10_000 + i, " ".join(w[: rng.randint(95, 120)])))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_near_duplicates(spark, docs, nothing, small, monkeypatch):
    if small:  # chains, blocks of groups and hot tokens at once, and no families; read on the driver only, so workers keep their own
        monkeypatch.setattr(jaccard, "LIST", 3)
        monkeypatch.setattr(jaccard, "GROUP", 7)
        monkeypatch.setattr(jaccard, "HOT", 3)
        monkeypatch.setattr(jaccard, "GROUP_TOKENS", 600)
        monkeypatch.setattr(jaccard, "_stars", lambda docs, vertices, partitions: spark.createDataFrame([], "a long, b long"))
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(near_family(), "doc_id long, text string"))
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect())
    assert got == brute_components([(r.doc_id, r.text) for r in df.collect()])
    assert table(jaccard.near_duplicates(nothing)) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), min_size=1, max_size=12), min_size=2, max_size=12), st.integers(1, 5))
def test_divide_skip(lists, least):
    lists = [np.array(sorted(x)) for x in lists]
    least = min(least, len(lists))
    count = Counter(int(v) for x in lists for v in x)
    member, n = jaccard.divide_skip(lists, least)
    assert dict(zip(member.tolist(), n.tolist())) == {k: v for k, v in count.items() if v >= least}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="aB \t\n\x0b é.", max_size=40), min_size=1, max_size=6))
def test_shingle_sets(texts):
    values, bounds = shingles.shingle_sets([t.encode() for t in texts])
    assert [int(b - a) for a, b in zip(bounds, bounds[1:])] == [len(brute_sets(t)) for t in texts]


def test_shingles_of_swapped_words_differ():
    runs = [" ".join(x) for x in itertools.product("abx", repeat=5)]
    values, bounds = shingles.shingle_sets([t.encode() for t in runs])
    assert (np.diff(bounds) == 1).all() and len(set(values.tolist())) == len(runs)
    few = [" ".join(x) for n in (1, 2, 3, 4) for x in itertools.product(("yes", "no"), repeat=n)]
    values, bounds = shingles.shingle_sets([t.encode() for t in few])
    assert (np.diff(bounds) == 1).all() and len(set(values.tolist())) == len(few)
    both = [x + " " + y for x, y in (("a b b a x", "b a a b x"), ("a b x b a", "b a x a b"), ("a b b b a", "b a b a b"))]
    values, bounds = shingles.shingle_sets([t.encode() for t in both])
    assert np.diff(bounds).tolist() == [len(brute_sets(t)) for t in both]


def test_swapped_words_are_not_near_duplicates(spark):
    rows = [(1, "yes no no yes"), (2, "no yes yes no"), (3, "a b b a x"), (4, "b a a b x"), (5, "yes no no yes")]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_components(rows)


def test_prefix_bound():
    for m in range(1, 300):
        for n in range(m, 400):
            if 4 * m >= 3 * n:
                assert jaccard.shared_within_prefix(m, n) >= max(jaccard.shared_with_any(m), jaccard.shared_with_any(n)) >= 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(0, 14), min_size=1, max_size=12), st.integers(0, 5)), min_size=2, max_size=14))
def test_links_between_families(rows):
    sets = [np.array(sorted(s), np.uint64) for s, _ in rows]
    names = np.array([f for _, f in rows])
    up = {f: f for f in names.tolist()}

    def root(x):
        return x if up[x] == x else root(up[x])

    for x, y in itertools.combinations(range(len(rows)), 2):
        a, b = rows[x][0], rows[y][0]
        if 100 * len(a & b) >= 75 * len(a | b):
            up[root(names[x].item())] = root(names[y].item())
    forest = jaccard.Forest(6)
    for x, y in jaccard.links(sets, names):
        assert 100 * len(rows[x][0] & rows[y][0]) >= 75 * len(rows[x][0] | rows[y][0])
        forest.join(int(names[x]), int(names[y]))
    assert {(a, b) for a in up for b in up if root(a) == root(b)} == {(a, b) for a in up for b in up if forest.root(a) == forest.root(b)}


def test_a_family_makes_no_pairs(spark):
    """700 near copies, and another family that shares a passage with them."""
    rows = near_family(seed=6, n=700)
    other = [(90_000 + i, t.replace("w", "q") + " " + " ".join(rows[0][1].split()[:20])) for i, (_, t) in enumerate(rows[:40])]
    df = spark.createDataFrame([*rows, *other], "doc_id long, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect())
    assert got == brute_components([*rows, *other])
    token = np.repeat(np.arange(500, dtype=np.uint64), 2000)
    family = np.full(len(token), 7, np.int64)
    assert not len(jaccard._pairs_of(token[::2000], family[::2000], np.full(500, 300, np.int64), np.zeros(0, np.uint64), 256)[0])


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (7, 7), (11, 10), (10, 12), (2, 1)]
    got = {(r.vertex, r.component) for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(v, 1) for v in range(1, 6)} | {(8, 8), (9, 8), (10, 10), (11, 10), (12, 10)}


def test_components_of_few_edges_need_no_shuffle(spark, monkeypatch):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(-200, 200, (260, 2))] + [(i, i + 1) for i in range(1000, 1100)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("few", "few")
    got = {(r.vertex, r.component) for r in components.components(df).collect()}
    jobs = len(tracker.getJobIdsForGroup("few"))
    monkeypatch.setattr(components, "FEW", 0)
    spark.sparkContext.setJobGroup("many", "many")
    assert got == {(r.vertex, r.component) for r in components.components(df).collect()} and len(got) > 300
    assert jobs < 10 < len(tracker.getJobIdsForGroup("many"))
    spark.sparkContext.setJobGroup("rest", "rest")
    assert components.components(df.limit(0)).collect() == []


def test_filter_of_keys(spark, monkeypatch):
    rows = spark.createDataFrame([(i, str(i)) for i in [*range(-300, 300), None]], "doc_id long, `a b` string")
    keys = spark.createDataFrame([(i,) for i in [*range(0, 90, 3), 10**12, None]], "doc_id long")
    want = set(range(0, 90, 3))
    got = [r.doc_id for r in tables.likely_in(rows, keys, "doc_id").collect()]
    assert want <= set(got) and len(got) < 45
    monkeypatch.setattr(tables, "FILTER_BITS", 64)
    assert want <= {r.doc_id for r in tables.likely_in(rows, keys, "doc_id").collect()}
    assert tables.likely_in(rows, keys.limit(0), "doc_id").collect() == []


# 5. repeated passages


def brute_repeats(rows, length=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for s in range(len(b) - length + 1):
                w = b[s : s + length]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        if i is not None:
            for s in range(len(b) - length + 1):
                if first[b[s : s + length]] < i:
                    gone[s : s + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_repeats(docs, nothing):
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(docs).collect())
    assert got == brute_repeats([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert sum(n * k[2] for k, n in got.items()) > 1000
    assert table(repeats.remove_repeats(nothing)) == []


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=1, max_size=200).map(lambda b: bytes(c % 3 + 97 for c in b)), st.integers(1, 12))
def test_interval_expansion(data, length):
    data += b"\xff"  # as after every context; strings with it are never asked for
    x = np.frombuffer(data, np.uint8)
    order, _ = repeats.suffix_array(x)
    border = repeats.expand_intervals(x, order, length)
    for j in range(1, len(x)):
        a, b = data[order[j - 1] : order[j - 1] + length], data[order[j] : order[j] + length]
        if len(a) == len(b) == length and b"\xff" not in a + b:
            assert border[j] == (a != b)


# 6. packing


def test_documents_are_packed_whole(docs, nothing):
    got = table(packing.pack_documents(docs, 64))
    encode, by, sequences = packing.encoder(), defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append(r)
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64 and at & (at - 1) == 0  # no padding at all
    texts = Counter((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    for r in got:
        by[r["doc_id"]].append(r)
    for (i, t), n in texts.items():
        if i is not None and n == 1:
            ids, at = np.append(encode(t or ""), 0).astype("<u4"), 0
            for r in sorted(by[i], key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
                at += r["length"]
            assert at == len(ids)
    assert table(packing.pack_documents(nothing)) == []


def test_same_ids_as_the_tokenizers_library(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    for r in docs.select("text").collect():
        assert packing.encoder()(r.text or "").tolist() == t.encode(r.text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("run", [" ", "\n", " \t\n"])
def test_a_long_run_of_white_space(spark, run):
    text = "some words" + run * (1_200_000 // len(run)) + "x end"
    ids = packing.plain_encoder(packing.VOCABULARY).encode(text, add_special_tokens=False).ids
    assert packing.encoder()(text).tolist() == ids
    got = table(packing.pack_documents(spark.createDataFrame([(1, text), (2, "after")], "doc_id long, text string")))
    assert sum(r["length"] for r in got if r["doc_id"] == 1) == len(ids) + 1 == max(r["doc_tokens"] for r in got)


def test_added_tokens_as_the_tokenizers_library(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    marker = "<|endoftext|>"
    odd = [f"one {marker} two", marker, marker * 3, f"  {marker}\n\n {marker}  x", f"a{marker}b", "<|endoftext|", f"<|endof{marker}text|>", f"日本 {marker}語 \n"]
    for text in [*odd, *(r.text or "" for r in docs.select("text").collect())]:
        assert packing.encoder()(text).tolist() == t.encode(text, add_special_tokens=False).ids
    assert packing.encoder()(odd[0]).tolist() == [505, 220, 50256, 734]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 90), max_size=60), st.integers(1, 6), st.integers(1, 12))
def test_cut_examples_keep_to_all_limits(sizes, segments, pool):
    packer = packing.Packer((32, segments, 32), cut=True, pool=pool)
    placed, gone, used = [], defaultdict(int), defaultdict(list)
    for i, n in enumerate(sizes):
        whole = n // 32 * 32
        for start, tokens, loss in ((0, whole, whole), (whole, n - whole, n - whole - 1)):
            if tokens:
                placed += list(packer.add((i, start), tokens, 1, loss))
    placed += list(packer.end())
    for (i, base), start, size, number, offset in sorted(placed, key=lambda p: (p[0], p[1])):
        assert base + start == gone[i] and size > 0
        gone[i] += size
        used[number].append((offset, size))
    assert [gone[i] for i in range(len(sizes))] == sizes
    for pieces in used.values():
        assert len(pieces) <= segments and sum(s for _, s in pieces) <= 32
        assert all(a + s == b for (a, s), (b, _) in zip(sorted(pieces), sorted(pieces)[1:]))


def test_segments_bind(spark):
    """Many short documents and few long ones: sequences of as many segments as allowed, still filled to the end."""
    rows = [(i, "word") for i in range(600)] + [(1000 + i, prose(i, 300)) for i in range(30)]
    got = table(packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(1), 256, segments=8))
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append(r["length"])
    assert max(map(len, sequences.values())) == 8
    waste = sum(256 - sum(s) for s in sequences.values() if sum(s) & (sum(s) - 1))
    assert waste < 0.05 * sum(map(sum, sequences.values()))


def test_examples_keep_to_all_limits(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(1, 90), rng.randint(1, 4), rng.randint(0, 60)) for i in range(300)] + [(999, 500, 1, 1), (1000, None, None, None)]
    got = {r.example_id: r for r in packing.pack_examples(spark.createDataFrame(rows, "example_id long, tokens long, segments long, loss_tokens long"), (100, 6, 70)).collect()}
    assert len(got) == len(rows)
    sums = defaultdict(lambda: np.zeros(3))
    for i, *d in rows:
        sums[got[i].sequence_id] += [x or 0 for x in d]
    assert all((s <= (100, 6, 70)).all() for q, s in sums.items() if q != got[999].sequence_id)
    assert len(sums) < 1.35 * max(sum(r[k] or 0 for r in rows) / m for k, m in ((1, 100), (2, 6), (3, 70)))


# 7. fingerprints


def plain_bin(window: bytes) -> int:
    total = sum(round(n * np.log2(n) * 65536) for n in Counter(window).values())
    return 1023 - total * 1023 // round(64 * 6 * 65536)


def plain_digest(text: bytes, rank: dict[int, int]) -> list[set[int]]:
    """Window by window and run by run."""
    mask, words = (1 << 64) - 1, [int(w) for w in fingerprint._WORD]
    windows = [text[i : i + 64] for i in range(len(text) - 63)]
    key = [(rank[plain_bin(w)], i) for i, w in enumerate(windows)]
    points = Counter(min(key[i : i + 64])[1] for i in range(len(key) - 63))
    chosen = sorted({i for i, n in points.items() if n >= 16} | ({min(key)[1]} if key else set()))
    features = [windows[i] for i in chosen] or ([text.ljust(64, b"\0")] if text else [])
    chain: list[set[int]] = []
    for n, f in enumerate(features):
        if n % 160 == 0:
            chain.append(set())
        h = 0
        for k in range(8):
            x = int.from_bytes(f[8 * k : 8 * k + 8], "little") * words[k] & mask
            h += (x ^ x >> 29) * words[7 - k]
        h &= mask
        h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 & mask
        h ^= h >> 31
        chain[-1] |= {h >> 11 * j & 2047 for j in range(5)}
    return chain


def plain_likeness(a: list[set[int]], b: list[set[int]]) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    if (len(a), sum(map(len, a))) > (len(b), sum(map(len, b))):
        a, b = b, a

    def share(x, y):
        chance, most = len(x) * len(y) / 2048, min(len(x), len(y))
        return min(1.0, max(0.0, (len(x & y) - chance) / max(most - chance, 1e-9)))

    return sum(len(x) * max(share(x, y) for y in b) for x in a) / sum(map(len, a))


def in_order(docs) -> list[tuple]:
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    return [(r.doc_id, r.t) for r in sorted(rows, key=lambda r: (-(1 << 63) if r.doc_id is None else r.doc_id, r.h, r.t))]


def test_fingerprints_as_a_plain_version(docs, nothing):
    rows = in_order(docs)
    counts = Counter(plain_bin(t[i : i + 64]) for t in (t.encode() for _, t in rows) for i in range(len(t) - 63))
    rank = {b: i for i, b in enumerate(sorted(range(1024), key=lambda b: (b < 100, counts[b], b)))}
    digest = functools.cache(lambda t: plain_digest(t.encode(), rank))
    text = lambda chain: base64.b64encode(b"".join(np.packbits(np.isin(np.arange(2048), list(f))).tobytes() for f in chain)).decode()
    want: Counter = Counter()
    for (i, t), (_, f) in zip(rows, [*rows[1:], rows[0]]):
        half = len(t) // 2
        e = t[: len(t) - half] + f[:half]
        near = [round(plain_likeness(digest(t), digest(x)), 5) for x in (e, f)]
        want[i, len(t), hashlib.sha256(e.encode()).hexdigest(), text(digest(t)), text(digest(e)), *near] += 1
    got = table(fingerprint.near_next(docs))
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint")
    assert Counter((*(r[c] for c in names), round(r["near_edited"], 5), round(r["near_next"], 5)) for r in got) == want
    assert table(fingerprint.near_next(nothing)) == []


def test_followers_of_any_doc_id(spark):
    """Hashes as ids, an id of many texts, and nulls."""
    rng = random.Random(3)
    rows = [(rng.randint(-(1 << 63) + 1, (1 << 63) - 1), prose(i, 8)) for i in range(300)]
    rows += [(77, prose(1000 + i, 5)) for i in range(300)] + [(None, "x"), (None, None), (77, prose(1000, 5)), ((1 << 63) - 1, "end")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    ordered = in_order(df)
    want = Counter((i, hashlib.sha256(fingerprint.edited(t, f).encode()).hexdigest()) for (i, t), (_, f) in zip(ordered, [*ordered[1:], ordered[0]]))
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in table(fingerprint.near_next(df))) == want
    parts = fingerprint._ranges(df).groupBy("part").count().collect()
    assert len(parts) > 12 and max(r["count"] for r in parts) < 150


def test_entropy_bins():
    x = np.frombuffer(("the quick brown fox " * 9 + "z" * 90 + "0123456789" * 9).encode(), np.uint8)
    for s, b in enumerate(fingerprint.entropy_bins(x)):
        p = np.bincount(x[s : s + 64])
        p = p[p > 0] / 64
        assert abs(b - -(p * np.log2(p)).sum() / 6 * 1023) < 1.5


# 8. language


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_cross_parsing_counts_phrases(few, monkeypatch):
    """Longest matches from left to right over whole texts, short and long, read together or one by one."""
    monkeypatch.setattr(langid, "FEW", few)
    rng = random.Random(8)
    samples = {"a": "abab cdc dcd" + "".join(rng.choices("abcd ", k=200)), "b": "bbaa ddcc bdbd" + "".join(rng.choices("abcd ", k=90))}
    samples = {k: " ".join(v.split()) for k, v in samples.items()}
    m = langid.Model(samples)
    texts = ["abab", "", "ddcc bdbd aabb", "a", *(" ".join("".join(rng.choices("abcd ", k=n)).split()) for n in (3000, 700, 20))]
    got = m.phrases(*m.symbols(texts))
    for t, row in zip(texts, got.tolist()):
        want = []
        for lang in m.languages:
            n, i = 0, 0
            while i < len(t):
                j = i + 1
                while j < len(t) and t[i : j + 1] in samples[lang]:
                    j += 1
                i, n = j, n + 1
            want.append(n)
        assert row == want


def scripts() -> dict[str, list[str]]:
    """Letters of each language; two languages share one large script and differ in the words that they make of it."""
    letters = {"en": range(97, 123), "ru": range(0x430, 0x450), "el": range(0x3B1, 0x3C2), "hy": range(0x561, 0x587), "ka": range(0x10D0, 0x10F1), "ja": range(0x4E00, 0x5400), "zh": range(0x4E00, 0x5400)}
    out = {}
    for k, (lang, codes) in enumerate(sorted(letters.items())):
        rng = random.Random(k)
        out[lang] = ["".join(rng.choices([chr(c) for c in codes], k=3)) for _ in range(600)]
    return out


def test_languages_of_many_scripts():
    rng, words = random.Random(5), scripts()
    model = langid.Model({lang: " ".join(rng.choices(w, k=3000)) for lang, w in words.items()})
    texts, want = zip(*((" ".join(rng.choices(w, k=25)), lang) for lang, w in words.items() for _ in range(20)))
    got = model.predict([*texts, "", "ⴰⴱ ⴳ", None])[0]
    assert got[: len(texts)] == list(want) and got[-3] == got[-1] == "und"
    one = [model.phrases(*model.symbols([t, "x"]))[0].tolist() for t in texts]
    assert model.phrases(*model.symbols([*texts, "x"]))[:-1].tolist() == one
    codes = [tuple(x[:n]) for x, n in zip(model.spelled.tolist(), model.lengths)]
    assert len(set(codes)) == len(codes) and not any(a != b and b[: len(a)] == a for a in codes[:200] for b in codes)


def test_language_sample_holds_distinct_texts(spark):
    texts = ["abc abc", "def def", "ghi ghi"]
    model = langid.train(spark.createDataFrame([("x", t) for t in texts * 5], "lang string, text string"), rows=3)
    assert {chr(c) for c in model.codes} == set("abcdefghi")


def test_language(spark, docs, nothing):
    rows = [(i, " ".join(random.Random(i).choices(["le", "la", "chat", "et", "rouge", "maison"] if i % 2 else ["the", "cat", "and", "house", "with"], k=30)), "fr" if i % 2 else "en") for i in range(60)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = table(langid.identify(spark.createDataFrame([(1, "la maison rouge"), (2, "the house and the cat"), (3, None), (4, "123 !"), (5, "")], "doc_id long, text string"), model, "doc_id"))
    assert [r["lang_pred"] for r in got] == ["fr", "en", "und", "und", "und"] and got[2]["score"] == 0
    assert {r["lang_pred"] for r in table(langid.identify(docs, langid.train(nothing), "doc_id"))} == {"und"}
    assert len(table(langid.identify(docs, langid.train(docs.filter(~held_out())), "doc_id"))) == docs.count() and table(langid.identify(nothing, model, "doc_id")) == []


# 9. BPE


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sabé1!漢🙂  \x1c"), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_bpe_as_tiktoken(text):
    import tiktoken

    c = bpe.codec(bpe.VOCABULARY)
    if not hasattr(test_bpe_as_tiktoken, "other"):
        with open(tokenizer_path(bpe.VOCABULARY), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        test_bpe_as_tiktoken.other = tiktoken.Encoding("t", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = c.encode([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == test_bpe_as_tiktoken.other.encode_ordinary(text)
    assert c.decode(ids) == text.encode()


def test_bpe_rows(docs, nothing):
    import tiktoken

    with open(tokenizer_path(bpe.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("t", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want: Counter = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = np.array(plain.encode_ordinary(r.text or ""), "<u4")
        want[r.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in table(bpe.round_trip(docs))) == want
    assert table(bpe.round_trip(nothing)) == []


def test_long_pieces_merge_alike():
    c, rng = bpe.codec(bpe.VOCABULARY), random.Random(9)
    assert 0 < c.safe.mean() < 1
    odd = [b"abcabc" * 60, bytes(range(97, 123)) * 12, b"a" * 301, b"ab" * 200 + b"a", "ü".encode() * 150, bytes(rng.choices(b"abeinrst", k=700)), bytes(rng.choices(range(256), k=400))]
    for p in odd:
        assert c._merge_row(p) == c._merge_matrix([p])[0]
    for safe in (True, False):
        tiny = bpe.Codec({**{bytes([b]): b for b in range(256)}, b"th": 300, b"the": 301, b"he": 350, b"theh": 310, b"aa": 320, b"aaa": 321, b"aaaa": 315})
        tiny.safe[:] &= safe
        for p in (b"xthehe" * 9, b"a" * 57, b"heheththe" * 7, b"tthhee" * 11):
            assert tiny._merge_row(p) == tiny._merge_matrix([p])[0]
    assert len(c._merge_row(b"x" * 100_000)) > 0


# 10. lines


def test_boilerplate_lines(spark, docs, nothing):
    rows = [(i, "a" if i < 20 else None, "\n".join(["NAV", f"own {i}", " NAV2 " if i % 2 else "x" + str(i), "", "own"] if i % 4 else ["only"])) for i in range(25)] + [(99, "a", None)]
    got = {r["doc_id"]: r for r in table(line_dedup.drop_boilerplate(spark.createDataFrame(rows, "doc_id int, source string, text string"), ratio=0.4, min_pages=3))}
    assert got[1]["text"] == "own 1\n" and got[1]["n_dropped"] == 3 and got[99]["text"] is None and got[99]["n_lines"] == 0
    assert got[4]["text"] == "only" and got[21]["n_dropped"] == 2  # a null site is a site: 4 of its 5 pages have NAV, 3 are under the count
    urls = spark.createDataFrame([("http://WWW.a.example/x",), ("https://b.example:8080/?q",), ("not a url",), (None,)], "url string")
    assert [r[0] for r in urls.select(line_dedup.host(F.col("url"))).collect()] == ["www.a.example", "b.example", "not a url", None]
    out = line_dedup.drop_boilerplate(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"] and out.count() == docs.count()
    assert table(line_dedup.drop_boilerplate(nothing)) == []
