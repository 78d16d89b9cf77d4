"""Queries over the vector, lexical, fusion, boost and confidence operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spindrift.functions import predicates as P
from spindrift.functions import scoring, text, vectors
from spindrift.operators import search
from spindrift.plans.registry import AS_OF, M, memories, query, table

TERMS = ["tion", "eres", "ment", "keit"]
TERM_SUM = " + ".join(f"CASE WHEN contains(lower(content), '{t}') THEN 1 ELSE 0 END" for t in TERMS)
BUCKET = "floor({} * 1e6 + 0.5)"


def _query_vector(spark, sf_dir, key=0):
    """One vector, by id; an empty one if there is none, which matches nothing."""
    found = table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == key).select("embedding").first()
    return [float(x) for x in found[0]] if found else []


SIM = "list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))"


@query(f"SELECT vec_id, label, round(s, 6) AS similarity FROM (SELECT vec_id, label, {SIM} AS s FROM embeddings) ORDER BY {BUCKET.format('s')} DESC, vec_id LIMIT 10")
def vec_topk(spark, sf_dir):
    top = search.vector_top_k(table(spark, sf_dir, "embeddings"), "embedding", _query_vector(spark, sf_dir), 10, "vec_id")
    return top.select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


@query(f"""
    WITH w AS ((SELECT * FROM embeddings WHERE label = 3 ORDER BY vec_id DESC LIMIT 40) UNION ALL
               (SELECT * FROM embeddings WHERE label <> 3 ORDER BY vec_id DESC LIMIT 10))
    SELECT vec_id, label, round(s, 6) AS similarity FROM (SELECT vec_id, label, {SIM} AS s FROM w) ORDER BY {BUCKET.format('s')} DESC, vec_id LIMIT 20""")
def vec_topk_partition_budget(spark, sf_dir):
    window = search.budgeted_window(table(spark, sf_dir, "embeddings"), F.col("label") == 3, [F.desc("vec_id")], 40)
    top = search.vector_top_k(window, "embedding", _query_vector(spark, sf_dir), 20, "vec_id")
    return top.select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


@query("""
    WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0),
    s AS (SELECT query, vec_id AS key, list_cosine_similarity(embedding::DOUBLE[], e) AS s FROM embeddings, q WHERE vec_id <> query),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY floor(s * 1e6 + 0.5) DESC, key) AS rank FROM s)
    SELECT query, key, rank, round(s, 6) AS similarity FROM r WHERE rank <= 5""")
def vec_topk_batch(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    queries = [(r.vec_id, [float(x) for x in r.embedding]) for r in rows.filter("vec_id % 100 = 0").select("vec_id", "embedding").toLocalIterator()]
    return search.batch_top_k(rows, "vec_id", "embedding", queries, 5).select("query", "key", F.col("rank").cast("long").alias("rank"), F.round("similarity", 6).alias("similarity"))


@query(f"""WITH w AS (SELECT * FROM embeddings ORDER BY vec_id DESC LIMIT 200) SELECT vec_id, round(s, 6) AS similarity FROM (SELECT vec_id, {SIM} AS s FROM w)
        ORDER BY {BUCKET.format('s')} DESC, vec_id LIMIT 10""")
def vec_recency_window(spark, sf_dir):
    window = search.newest(table(spark, sf_dir, "embeddings"), 200, F.desc("vec_id"))
    return search.vector_top_k(window, "embedding", _query_vector(spark, sf_dir), 10, "vec_id").select("vec_id", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {M} SELECT id, CAST(0 AS DOUBLE) AS similarity FROM m WHERE status IS NULL OR status NOT IN ('expired', 'archived') ORDER BY created_s DESC, id LIMIT 20")
def recency_listing(spark, sf_dir):
    rows = memories(spark, sf_dir, "id", "created_s", "status").filter(P.live(F.col("status")))
    return search.newest(rows, 20, F.desc("created_s"), F.asc("id")).select("id", F.lit(0.0).alias("similarity"))


@query("""
    SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm,
           round(list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS distance,
           len(embedding) AS dims FROM embeddings""")
def vector_geometry(spark, sf_dir):
    q = F.array(*(F.lit(x) for x in _query_vector(spark, sf_dir)))
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.magnitude(e), 6).alias("norm"), F.round(vectors.euclidean(e, q), 6).alias("distance"), F.size(e).cast("long").alias("dims"))


@query("""SELECT label, pos, round(avg(x), 6) AS mean FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS pos
        FROM embeddings) GROUP BY label, pos""")
def vector_mean(spark, sf_dir):
    parts = table(spark, sf_dir, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "x"))
    return parts.groupBy("label", "pos").agg(F.round(F.avg("x"), 6).alias("mean"))


@query("""SELECT vec_id, list_filter(embedding, lambda x, i: (i - 1) % 2 = 0) [1:4]::DOUBLE[] AS head, len(list_filter(embedding, lambda x,
        i: (i - 1) % 2 = 0)) AS dims FROM embeddings""")
def vector_strided(spark, sf_dir):
    kept = vectors.every(F.col("embedding"), 0.5)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.slice(kept, 1, 4).cast("array<double>").alias("head"), F.size(kept).cast("long").alias("dims"))


@query(f"WITH {M} SELECT id, CAST({TERM_SUM} AS DOUBLE) / 4 AS score FROM m WHERE {TERM_SUM} > 0 ORDER BY 2 DESC, content, id LIMIT 20")
def lex_score_topk(spark, sf_dir):
    return search.lexical_top_k(memories(spark, sf_dir, "id", "content"), "content", TERMS, 20, "content", "id").select("id", "score")


@query(f"""WITH {M} SELECT id, CAST({TERM_SUM} AS DOUBLE) / 4 AS score FROM m WHERE {TERM_SUM} > 0 AND NOT contains(lower(content), 'the') ORDER BY 2 DESC,
        content, id LIMIT 20""")
def lex_exclusion(spark, sf_dir):
    return search.lexical_top_k(memories(spark, sf_dir, "id", "content"), "content", TERMS, 20, "content", "id", exclude=("the",)).select("id", "score")


@query("""
    WITH w AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9_]+', ' ', 'g'), ' '), lambda x: x <> '') AS ws FROM documents),
    t AS (SELECT doc_id, len(ws) AS n, len(list_filter(ws, lambda x: x = 'this')) AS a, len(list_filter(ws, lambda x: x = 'from')) AS b FROM w),
    s AS (SELECT count(*) AS c, avg(n) AS mean, sum(CASE WHEN a > 0 THEN 1 ELSE 0 END) AS da, sum(CASE WHEN b > 0 THEN 1 ELSE 0 END) AS db FROM t),
    r AS (SELECT doc_id, ln(1 + (c - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean))
                       + ln(1 + (c - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean)) AS s FROM t, s WHERE a > 0 OR b > 0)
    SELECT doc_id, round(s, 6) AS bm25 FROM r ORDER BY floor(s * 1e6 + 0.5) DESC, doc_id LIMIT 25""")
def bm25_topk(spark, sf_dir):
    scored = search.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", ["this", "from"])
    return scored.orderBy(F.desc(vectors.bucket(F.col("bm25"))), "doc_id").limit(25).select("doc_id", F.round("bm25", 6).alias("bm25"))


@query("""
    WITH s AS (SELECT item_id, unnest(regexp_split_to_array(text, '[.!?]\\s+|\\n+')) AS s, generate_subscripts(regexp_split_to_array(text,
        '[.!?]\\s+|\\n+'), 1) AS pos FROM benchmark),
    h AS (SELECT *, CAST(contains(lower(s), 'tion') AS INT) + CAST(contains(lower(s), 'eres') AS INT) AS n FROM s),
    b AS (SELECT item_id, s, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, pos) AS r FROM h),
    p AS (SELECT item_id, s, strpos(lower(s), 'tion') AS p, strpos(lower(s), 'eres') AS q FROM b WHERE r = 1),
    f AS (SELECT *, CASE WHEN p > 0 AND q > 0 THEN least(p, q) WHEN p > 0 THEN p WHEN q > 0 THEN q ELSE 1 END AS f FROM p)
    SELECT item_id, CASE WHEN length(s) <= 300 THEN s ELSE substring(s, greatest(1, f - 40), 300) END AS snippet FROM f""")
def result_snippet(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", text.snippet(F.col("text"), ["tion", "eres"]).alias("snippet"))


@query("SELECT conv_id, max(turn) AS last_turn FROM conversations WHERE contains(lower(text), 'the') GROUP BY conv_id ORDER BY last_turn DESC, conv_id LIMIT 50")
def conversation_distinct(spark, sf_dir):
    return table(spark, sf_dir, "conversations").filter(F.lower("text").contains("the")).groupBy("conv_id").agg(F.max("turn").alias("last_turn")).orderBy(F.desc("last_turn"), "conv_id").limit(50)


@query("""SELECT conv_id, sum(s) + count(DISTINCT role) - 1 AS score FROM (SELECT conv_id, role, CAST(contains(lower(text),
        'tion') AS INT) + CAST(contains(lower(text), 'eres') AS INT) AS s FROM conversations) WHERE s > 0 GROUP BY conv_id""")
def related_sessions(spark, sf_dir):
    hits = table(spark, sf_dir, "conversations").withColumn("s", F.lower("text").contains("tion").cast("int") + F.lower("text").contains("eres").cast("int")).filter("s > 0")
    return hits.groupBy("conv_id").agg((F.sum("s") + F.countDistinct("role") - 1).alias("score"))


def _legs(spark, sf_dir):
    """Vector leg (a record's vector is the one of its id), lexical leg and recency leg, each with ranks."""
    v = search.vector_top_k(table(spark, sf_dir, "embeddings"), "embedding", _query_vector(spark, sf_dir), 40, "vec_id")
    v = search.ranked(v.select(F.col("vec_id").alias("id"), "similarity"), 40, F.desc(vectors.bucket(F.col("similarity"))), "id")
    rows = memories(spark, sf_dir, "id", "content", "created_s")
    x = search.ranked(search.lexical_top_k(rows, "content", TERMS, 40, "content", "id"), 40, F.desc("score"), "content", "id")
    return v, x, search.ranked(rows.select("id", "created_s"), 40, F.desc("created_s"), F.asc("id"))


LEGS = f"""{M},
    v AS (SELECT id, row_number() OVER (ORDER BY b DESC, id) AS rank FROM (SELECT vec_id AS id, {BUCKET.format(SIM)} AS b FROM embeddings) QUALIFY rank <= 40),
    x AS (SELECT id, row_number() OVER (ORDER BY {TERM_SUM} DESC, content, id) AS rank FROM m WHERE {TERM_SUM} > 0 QUALIFY rank <= 40),
    n AS (SELECT id, row_number() OVER (ORDER BY created_s DESC, id) AS rank FROM m QUALIFY rank <= 40)"""
FUSED = """f AS (SELECT id, sum(1.0::DOUBLE / (60 + rank)) AS s FROM u GROUP BY id), g AS (SELECT * FROM f ORDER BY floor(s * 1e6 + 0.5) DESC, id LIMIT 30)
        SELECT id, round(s, 9) AS rrf, round(s / (SELECT max(s) FROM g), 6) AS fused FROM g"""


@query(f"WITH {LEGS}, u AS (SELECT * FROM v UNION ALL SELECT * FROM x), {FUSED}")
def rrf_two_leg(spark, sf_dir):
    v, x, _ = _legs(spark, sf_dir)
    return search.fuse([v, x], "id", 30).select("id", F.round("rrf", 9).alias("rrf"), F.round("fused", 6).alias("fused"))


@query(f"WITH {LEGS}, u AS (SELECT * FROM v UNION ALL SELECT * FROM x UNION ALL SELECT * FROM n), {FUSED}")
def rrf_three_leg(spark, sf_dir):
    return search.fuse(list(_legs(spark, sf_dir)), "id", 30).select("id", F.round("rrf", 9).alias("rrf"), F.round("fused", 6).alias("fused"))


def _tags():
    return F.array("lang", "source")


@query(f"WITH {M} SELECT id, least(0.1::DOUBLE * len(list_intersect([lang, source], ['en', 'src3', 'src5'])), 0.3::DOUBLE) AS boost FROM m")
def score_tag_overlap(spark, sf_dir):
    wanted = F.array(F.lit("en"), F.lit("src3"), F.lit("src5"))
    return memories(spark, sf_dir, "id", "lang", "source").select("id", scoring.capped(0.1, F.size(F.array_intersect(_tags(), wanted)), 0.3).alias("boost"))


@query(f"WITH {M} SELECT id, round(0.1 * exp(-CAST(1706745600 - created_s AS DOUBLE) / 3600 / 720), 6) AS boost FROM m")
def score_recency(spark, sf_dir):
    return memories(spark, sf_dir, "id", "created_s").select("id", F.round(scoring.recency_boost((AS_OF - F.col("created_s")) / 3600), 6).alias("boost"))


@query(f"""WITH {M} SELECT id, least(0.05::DOUBLE * len(list_filter(['Apache', 'MIT', 'Creative', 'GNU', 'License'], lambda e: contains(content, e))),
        0.3::DOUBLE) AS boost,
    CASE WHEN regexp_matches(content, '\\b(19|20)[0-9]{{2}}\\b|\\b[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2,4}}\\b') THEN 0.25::DOUBLE
        ELSE 0::DOUBLE END AS dated FROM m""")
def score_entity(spark, sf_dir):
    names = F.array(*map(F.lit, ("Apache", "MIT", "Creative", "GNU", "License")))
    dated = F.col("content").rlike(text.ascii_bounds(r"\b(19|20)[0-9]{2}\b|\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}\b"))
    found = F.size(F.filter(names, lambda e: F.col("content").contains(e)))
    return memories(spark, sf_dir, "id", "content").select("id", scoring.capped(0.05, found, 0.3).alias("boost"), F.when(dated, 0.25).otherwise(0.0).alias("dated"))


FINAL = f"""{M}, b AS (SELECT id, content, conflict, semantic,
    least(0.1::DOUBLE * len(list_intersect([lang, source], ['en', 'src3'])), 0.3::DOUBLE) AS tags,
    0.1 * exp(-CAST(1706745600 - created_s AS DOUBLE) / 3600 / 720) AS recency, CASE WHEN source = 'src3' THEN 0.1::DOUBLE ELSE 0::DOUBLE END AS session,
    CASE WHEN superseded_by IS NOT NULL THEN -0.5::DOUBLE ELSE 0::DOUBLE END AS superseded FROM m),
    f AS (SELECT *, semantic + tags + recency + session + superseded AS composite FROM b), z AS (SELECT *, greatest(0::DOUBLE, least(1::DOUBLE,
        composite)) AS final FROM f)"""


def _boosted(spark, sf_dir):
    rows = memories(spark, sf_dir, "id", "content", "lang", "source", "created_s", "superseded_by", "semantic")
    return search.boosted(rows, "semantic", {
        "tags": scoring.capped(0.1, F.size(F.array_intersect(_tags(), F.array(F.lit("en"), F.lit("src3")))), 0.3),
        "recency": scoring.recency_boost((AS_OF - F.col("created_s")) / 3600),
        "session": F.when(F.col("source") == "src3", 0.1).otherwise(0.0),
        "superseded": F.when(F.col("superseded_by").isNotNull(), -0.5).otherwise(0.0),
    })


@query(f"""WITH {FINAL} SELECT id, round(semantic, 6) AS semantic, round(composite, 6) AS composite, round(final, 6) AS final FROM z
        ORDER BY floor(final * 1e6 + 0.5) DESC, floor(composite * 1e6 + 0.5) DESC, content, id LIMIT 50""")
def final_rank(spark, sf_dir):
    top = _boosted(spark, sf_dir).orderBy(*search.final_order()).limit(50)
    return top.select("id", *(F.round(c, 6).alias(c) for c in ("semantic", "composite", "final")))


@query(f"""WITH {FINAL}, q AS (SELECT *, id % 40 AS query FROM z), g AS (SELECT *, max(semantic) OVER (PARTITION BY query) AS best FROM q) SELECT query, id,
        round(final, 6) AS final FROM g WHERE best >= 0.98""")
def confidence_gate(spark, sf_dir):
    """Queries whose best result isn't good enough give no rows at all."""
    rows = _boosted(spark, sf_dir).withColumn("query", F.col("id") % 40)
    best = F.max("semantic").over(Window.partitionBy("query"))
    return rows.withColumn("best", best).filter("best >= 0.98").select("query", "id", F.round("final", 6).alias("final"))


CONF = f"""{M}, s AS (SELECT *, id % 40 AS query, row_number() OVER (PARTITION BY id % 40 ORDER BY semantic DESC, id) AS r FROM m),
    a AS (SELECT query, count(*) AS n, max(semantic) AS best, max(semantic) - max(CASE WHEN r = 2 THEN semantic END) AS gap FROM s GROUP BY query),
    c AS (SELECT s.id, s.query, s.conflict, least(1::DOUBLE, 1 / (1 + exp(-8 * (semantic - 0.5)))
        + least(CASE WHEN lexical_rank <= 3 THEN 0.08::DOUBLE WHEN lexical >= 0.5 THEN 0.04::DOUBLE ELSE 0::DOUBLE END + CASE
        WHEN graph > 0 THEN 0.05::DOUBLE ELSE 0::DOUBLE END, 0.13::DOUBLE))
        * CASE WHEN n < 2 THEN 1::DOUBLE WHEN gap >= 0.25 THEN 1.05::DOUBLE WHEN gap <= 0.05 THEN 0.9::DOUBLE ELSE 1::DOUBLE END
        * (0.7::DOUBLE + 0.3::DOUBLE * pow(2::DOUBLE, -CAST(1706745600 - created_s AS DOUBLE) / 86400 / 365))
        * CASE WHEN level = 'certain' THEN 1::DOUBLE WHEN level = 'outdated' THEN 0.7::DOUBLE ELSE 0.95::DOUBLE END
        * CASE WHEN n < 3 THEN 0.9::DOUBLE ELSE 1::DOUBLE END * CASE WHEN best < 0.35 THEN 0.8::DOUBLE ELSE 1::DOUBLE END AS v FROM s JOIN a USING (query)),
    k AS (SELECT id, query, greatest(0::DOUBLE, least(1::DOUBLE, CASE WHEN conflict THEN least(v, 0.55::DOUBLE) * 0.85 ELSE v END)) AS confidence FROM c)"""


def _confidence(spark, sf_dir):
    rows = memories(spark, sf_dir, "id", "semantic", "lexical_rank", "lexical", "graph", "level", "conflict", "created_s").withColumn("query", F.col("id") % 40)
    order = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("semantic"), "id"))
    stats = rows.select("query", "id", "semantic").withColumn("r", order).groupBy("query").agg(F.count("*").alias("n"), F.max("semantic").alias("best"), (F.max("semantic") - F.max(F.when(F.col("r") == 2, F.col("semantic")))).alias("gap"))
    c = {x: F.col(x) for x in ("semantic", "lexical_rank", "lexical", "graph", "gap", "n", "best", "level", "conflict")}
    fresh = F.pow(F.lit(2.0), -((AS_OF - F.col("created_s")) / 86400) / 365)
    return rows.join(stats, "query").withColumn("confidence", scoring.recall_confidence(c["semantic"], c["lexical_rank"], c["lexical"], c["graph"], c["gap"], c["n"], c["best"], fresh, c["level"], c["conflict"]))


@query(f"""WITH {CONF} SELECT id, round(confidence, 6) AS confidence, CASE WHEN confidence >= 0.9 THEN 'high' WHEN confidence >= 0.6 THEN 'qualified'
        ELSE 'low' END AS tier FROM k""")
def calibrated_confidence(spark, sf_dir):
    return _confidence(spark, sf_dir).select("id", F.round("confidence", 6).alias("confidence"), scoring.confidence_tier(F.col("confidence")).alias("tier"))


@query(f"""WITH {CONF}, b AS (SELECT query, max(confidence) AS c FROM k GROUP BY query) SELECT query, round(c, 6) AS confidence, CASE WHEN c < 0.6 THEN 'none'
        WHEN c >= 0.9 THEN 'confident' ELSE 'qualified' END AS verdict FROM b""")
def assess_verdict(spark, sf_dir):
    best = _confidence(spark, sf_dir).groupBy("query").agg(F.max("confidence").alias("c"))
    return best.select("query", F.round("c", 6).alias("confidence"), F.when(F.col("c") < 0.6, "none").when(F.col("c") >= 0.9, "confident").otherwise("qualified").alias("verdict"))


@query(f"""WITH {M}, a AS (SELECT id FROM m ORDER BY semantic DESC, id LIMIT 25), b AS (SELECT id FROM m ORDER BY lexical DESC, id LIMIT 25)
    SELECT count(*) AS common, CAST(count(*) AS DOUBLE) / 25 AS share FROM a JOIN b USING (id)""")
def shadow_delta(spark, sf_dir):
    return search.shadow_overlap(memories(spark, sf_dir, "id", "semantic", "lexical"), "id", "semantic", "lexical", 25)


@query("""
    WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a,
        embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
    SELECT a, b, round(s, 6) AS similarity FROM p WHERE s >= 0.4""")
def near_duplicate_lookup(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    queries = [(r.vec_id, [float(x) for x in r.embedding]) for r in rows.filter("vec_id % 100 = 0").select("vec_id", "embedding").toLocalIterator()]
    found = search.batch_at_least(rows, "vec_id", "embedding", queries, 0.4)
    return found.select(F.col("query").alias("a"), F.col("key").alias("b"), F.round("similarity", 6).alias("similarity"))


@query()
def mmr_diverse(spark, sf_dir):
    """Sequential choice per label: no SQL; the tests hold it against a plain loop."""
    rows = table(spark, sf_dir, "embeddings").withColumn("score", vectors.cosine_constant(F.col("embedding"), _query_vector(spark, sf_dir)))
    return search.mmr(rows, "label", "vec_id", "embedding", "score", 5)


@query()
def local_embedding(spark, sf_dir):
    """Hashing embeddings of the query set: no SQL for the hash; the tests check it feature by feature."""
    from spindrift.functions.embedding import embeddings

    return embeddings(table(spark, sf_dir, "benchmark"), "item_id", "text")
