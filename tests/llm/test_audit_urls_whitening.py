"""Operators 11 to 13 against plain versions, on odd cases and empty tables."""

from __future__ import annotations

import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import audit, urls, whitening


def table(df):
    return [r.asDict() for r in df.collect()]


# 11. filter interaction audit

TEXTS = [
    "word " * 250, " ".join(f"w{i}" for i in range(250)), "Shouting " * 3, "a | b", "", None, " ".join(f"x{i % 120}" for i in range(201)), "ÄÖ" * 90, "A" + "b" * 49, "AB" + "c" * 98, "one\x0btwo\x1cthree",
]


def audit_rows():
    rows = [(i * 2 + 1, t, f"s{i % 3}" if i % 4 else None, "clash", i) for i, t in enumerate(TEXTS * 3)]
    rows += [rows[3], rows[3], (rows[3][0], rows[3][1], "other", None, None), (None, TEXTS[0], "s1", None, None), (None, None, "", None, None), (0, TEXTS[1], "s0", None, None)]
    return rows


def plain_masks(rows):
    out = []
    for doc_id, text, *_ in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), any(c in "#$%&*|" for c in t)]
        fails.append(doc_id is not None and any(o[0] is not None and o[0] < doc_id and (o[1] or "") == t for o in rows))
        out.append({f for f, x in zip("ABCDE", fails) if x})
    return out


def plain_audit(rows, labels):
    good, bad = ({d for d, *x in labels if d is not None and x[k] == 1} for k in (0, 1))
    out = {}
    masks = plain_masks(rows)
    for part in {r[2] or "" for r in rows}:
        own = [(r[0], m) for r, m in zip(rows, masks) if (r[2] or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = list(own)
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                total[f] += len(gone)
                fails = sum(f in m for _, m in own)
                out[part, order, step] = [len(left), len(gone), fails - len(gone), sum(m == {f} for _, m in own), sum(d in good for d, _ in gone), sum(d in bad for d, _ in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return out


AUDIT = "doc_id long, text string, source string, part string, mask int"


def test_audit_equals_a_replay_of_every_order(spark):
    rows = audit_rows()
    labels = [(1, 1, 0), (3, 0, 1), (3, 1, 0), (7, 1, 1), (9, None, None), (None, 1, 1), (23, 1, 0), (4001, 1, 1)]
    got = table(audit.interactions(spark.createDataFrame(rows, AUDIT).repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    want = plain_audit(rows, labels)
    assert len(got) == len(want) == 600 * len({r[2] or "" for r in rows})
    assert {(r["part"], r["filter_order"], r["step"]): [r[c] for c in audit.COUNTS] for r in got} == want


@pytest.mark.parametrize(("bits", "held"), [(64, 1 << 25), (1, 1 << 25), (1, 0), (64, 900)])
def test_chains_keep_texts_of_equal_fingerprint_apart(spark, bits, held):
    rows = audit_rows()
    got = [r for r in table(audit.masks(spark.createDataFrame(rows, AUDIT).repartition(4), bits, held)) for _ in range(r["copies"])]
    want = [(r[0], r[2] or "", sum(1 << "ABCDE".index(f) for f in m)) for r, m in zip(rows, plain_masks(rows))]
    assert sorted(((r["doc_id"], r["part"], r["mask"]) for r in got), key=str) == sorted(want, key=str)


def test_a_hot_text_leaves_a_task_as_one_row():
    first = list(audit._first(1 << 20)((7, i, "hot", "p", 0) for i in range(1000)))
    assert sum(text is not None for _, (_, text, _) in first) == 1 and len(first) == 1000
    out = list(audit._settled(first))
    assert sorted(d for d, _, mask, _ in out if not mask & audit.SAME) == [0]


def test_audit_of_nothing(spark, docs, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert table(audit.interactions(nothing, labels)) == []
    got = table(audit.interactions(docs, labels))
    assert len(got) == 600 * 4 and sum(r["kept"] + r["removed"] + r["redundant"] for r in got if r["step"] == 1) == 120 * docs.count()


# 12. URL filters

URLS = [
    "https://www.example.com/en/1", "http://example.com/en/", "http://EXAMPLE.com/en/x?y#z", "http://example.com/EN/", "http://a.b.example.com/en/q", "http://badexample.com/en/", "https://m.x.net/es/7", "net://net/es/", "x://y.net/fr", "x://y.net/fr/?q",
    "http://y.net:80/fr/9", "http://u:p@y.net:443//fr//9/?utm_source=a", "http://y.net/fr/9", "http://y.net./fr/9#top", "http://y.net:8080/fr/9", "nothing", "", None, "://", "http://", "http://?a=1", "a://b://c.net/es/", "http://x.org/en/1?b=2&a=1", "http://x.org/en/1?a=1&b=2&ref=z",
    "http://com", "http://com/", "http://www.example.com?en/", "http://ÄB.net/es/", "http://x.org/\nes/", "HTTP://WWW.EXAMPLE.COM/en/",
]


def plain_url(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    name = re.sub(":(80|443)?$", "", host.rsplit("@", 1)[-1]).rstrip(".")
    query = rest.split("#")[0].partition("?")[2]
    keep = sorted(p for p in query.split("&") if p and not re.match(urls.TRACKING, p))
    return host, path, (name + re.sub("/$", "", re.sub("/+", "/", path)) + ("?" + "&".join(keep) if keep else "")) if name else None


def plain_verdicts(rows, rules, listed=None):
    out = []
    for key, url in rows:
        host, path, canonical = plain_url(url)
        fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        out.append([key, host, path, max(fits)[2] if fits else None, max(fits)[3] if fits else None, canonical])
    if listed is None:
        listed = {r[5] for r in out if r[4] == "block"}
    return [(*r[:4], r[4] or ("block" if r[5] is not None and r[5] in listed else "allow")) for r in out]


def verdicts(df):
    return sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in table(df)), key=str)


@pytest.mark.parametrize("blocks", [None, 1])
def test_urls_are_judged_as_by_a_plain_reading(spark, blocks):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(3, URLS[0]), (3, URLS[0]), (None, URLS[10]), (None, None)]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, verdict string, _block string")
    want = plain_verdicts(rows, urls.RULES)
    assert verdicts(urls.judge(pages, blocks=blocks)) == sorted(want, key=str)
    assert {w[4] for w in want if w[0] in (10, 11, 13)} == {"block"} and {w[4] for w in want if w[0] in (14, 15, 24)} == {"allow"}


def test_a_long_list_and_a_hot_url(spark):
    rows = [(i, f"http://h{i % 900}.org/p{i}") for i in range(3000)] + [(5000 + i, "http://hot.org/a/") for i in range(2500)] + [(9000 + i, "http://warm.org/") for i in range(2000)]
    listed = {plain_url(u)[2] for _, u in rows[::3]} | {"hot.org/a"} | {f"none.org/{i}" for i in range(2000)}
    given = spark.createDataFrame([(u,) for u in sorted(listed)] * 2 + [(None,)], "url string")
    pages = spark.createDataFrame(rows, "page_id long, url string").repartition(4)
    got = verdicts(urls.judge(pages, (), given))
    assert got == sorted(plain_verdicts(rows, (), listed), key=str) and sum(g[4] == "block" for g in got) > 3400
    assert {g[4] for g in verdicts(urls.judge(pages, (), given.limit(0)))} == {"allow"}


def test_the_filter_misses_nothing_and_passes_little(spark):
    keys = spark.range(20000).select(F.concat(F.lit("h.org/"), "id").alias("url"))
    blocks = urls.blocks_for(20000)
    passed = urls.possible(spark.range(40000).select(F.concat(F.lit("h.org/"), "id").alias("url")), urls.bloom(keys, blocks), blocks, "url").filter("_possible")
    got = {int(r.url[6:]) for r in passed.collect()}
    assert got >= set(range(20000)) and len(got) < 20000 + 400 and blocks & blocks - 1 == 0 and urls.blocks_for(10**12) == urls.MAX_BLOCKS


def test_url_filter_stays_in_spark(spark):
    pages = spark.createDataFrame([(1, URLS[0])], "page_id long, url string")
    plan = urls.judge(pages)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert table(urls.judge(pages.limit(0))) == []


# 13. embedding whitening


def plain_whitening(rows, k=8):
    """By a whole eigendecomposition; vectors are given up to sign."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max((len(v) for _, v in kept), default=0)
    x = np.array([[math.floor(1024 * c) + 100000 for c in [*v, *[0.0] * (d - len(v))]] for _, v in kept], object).reshape(len(kept), d)
    sums = x.sum(axis=0)
    centred = (x - sums / len(x)).astype(float)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(x))
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(k, int((values > d * 2.3e-16 * values[0]).sum()))
    w = centred @ vectors[:, :k] / np.sqrt(values[:k])
    return [i for i, _ in kept], [int(v) for v in ((len(x) * x - sums) ** 2).sum(axis=1)], w, values[:k] / values.sum()


def check_whitening(spark, rows, passes=whitening.POWER_PASSES, kind="float", tolerance=1e-8):
    df = spark.createDataFrame([(i, v, 3) for i, v in rows], f"vec_id long, embedding array<{kind}>, component int").repartition(3)
    got = table(whitening.whiten(df, passes=passes))
    ids, deviation, w, explained = plain_whitening([(r.vec_id, r.embedding) for r in df.collect()])
    k = w.shape[1]
    assert len(got) == len(ids) * k and {r["n"] for r in got} == {len(ids)} and max(r["identity_error"] for r in got) < 1e-9
    by = lambda value: {c: sorted((r["vec_id"], value(r)) for r in got if r["component"] == c) for c in range(1, k + 1)}
    for c, own in by(lambda r: r["whitened"]).items():
        want = sorted(zip(ids, w[:, c - 1]))
        a, b = np.array([x[1] for x in own]), np.array([x[1] for x in want])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < tolerance
        assert [r["explained"] for r in got if r["component"] == c] == pytest.approx([explained[c - 1]] * len(ids), rel=1e-9)
    assert by(lambda r: r["deviation"])[1] == sorted(zip(ids, deviation))
    return got


def test_whitening_equals_a_whole_decomposition(spark):
    rng = np.random.default_rng(5)
    steep = (rng.normal(size=(300, 24)) * 0.5 ** np.arange(24)).tolist()
    flat = rng.normal(size=(400, 24)).tolist()
    check_whitening(spark, list(enumerate(steep)))
    check_whitening(spark, list(enumerate(flat)), kind="double")
    odd = [*enumerate(flat[:40]), (40, None), (41, [1.0, None]), (42, [float("nan")]), (43, [float("inf")] * 24), (44, []), (45, [1.0] * 3), (7, flat[7]), (7, flat[7])]
    check_whitening(spark, odd, kind="double")


def test_the_basis_is_expanded_only_where_residuals_fail(spark):
    rng = np.random.default_rng(6)
    low = rng.normal(size=(500, 5)) @ rng.normal(size=(5, 40))
    df = lambda x: spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    steep = rng.normal(size=(500, 40)) * np.array([*range(200, 192, -1), *[1e-3] * 32]) * 1000
    fits = whitening.fit(df(steep), passes=12), whitening.fit(df(rng.normal(size=(500, 40))))
    assert [f.expanded for f in fits] == [False, True]
    got = table(whitening.whiten(df(low)))
    assert max(r["component"] for r in got) == 8  # rounding to integers gives the other dimensions their own noise


def test_whitening_of_nothing_and_of_equal_vectors(spark):
    df = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert table(whitening.whiten(df([]))) == table(whitening.whiten(df([(1, None), (2, [None])]))) == []
    assert table(whitening.whiten(df([(1, [0.5, 0.25])] * 9))) == table(whitening.whiten(df([(1, [])] * 2))) == []
    two = table(whitening.whiten(df([(1, [0.0, 0.0]), (2, [0.5, 0.25])])))
    assert [r["component"] for r in two] == [1, 1] and sorted(round(r["whitened"], 9) for r in two) == [-1, 1] and {r["deviation"] for r in two} == {512**2 + 256**2}


def test_deviations_are_exact_or_null():
    model = whitening.Fit(1 << 22, np.array([5, 7], object), np.eye(2), np.ones(2), 2.0, True)
    x = np.array([[3, 4], [1 << 12, 0], [1 << 40, 1]], np.int64)
    want = [sum((model.n * int(c) - s) ** 2 for c, s in zip(r, (5, 7))) for r in x]
    assert whitening.deviations(x, model) == [v if v < 1 << 63 else None for v in want] and want[2] > 1 << 63
