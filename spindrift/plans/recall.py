"""Queries over recall end to end, what widens it, and the other searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions import entities, scoring, text
from spindrift.operators import cycles, graph, recall, routing, search
from spindrift.plans.registry import AS_OF, M, memories, query, table

WORDS = "list_distinct(list_filter(string_split(regexp_replace(lower(coalesce({}, '')), '[^a-z0-9_]+', ' ', 'g'), ' '), lambda w: length(w) >= 3 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in sorted(text.STOPWORDS)) + "], w)))"
LEGS = f"""{M}, q AS (SELECT item_id AS query, text FROM benchmark), t AS (SELECT query, unnest({WORDS.format('text')}) AS w, len({WORDS.format('text')}) AS n
        FROM q),
    d AS (SELECT id, unnest({WORDS.format('content')}) AS w FROM m), h AS (SELECT query, id, n, count(*) AS hits FROM t JOIN d USING (w) GROUP BY 1, 2, 3),
    x AS (SELECT query, id, hits / n::DOUBLE AS lexical, row_number() OVER (PARTITION BY query ORDER BY hits DESC, id) AS rank FROM h QUALIFY rank <= 20),
    c AS (SELECT a.vec_id AS query, b.vec_id AS id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a,
        embeddings b WHERE a.vec_id IN (SELECT query FROM q) AND a.vec_id <> b.vec_id),
    v AS (SELECT query, id, s AS semantic, row_number() OVER (PARTITION BY query ORDER BY floor(s * 1e6 + 0.5) DESC, id) AS rank FROM c QUALIFY rank <= 20)"""


def _queries(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("content"))


def _vector_leg(spark, sf_dir, k=20):
    """The nearest vectors of the queries (a query's vector is the one of its id)."""
    return search.vector_leg(table(spark, sf_dir, "embeddings"), _queries(spark, sf_dir), k)


#: From the legs to the verdict; `topic` has the factor of what a query's results are about.
VERDICT = f"""u AS (SELECT query, id, rank FROM v UNION ALL SELECT query, id, rank FROM x), f0 AS (SELECT query, id,
        sum(1.0::DOUBLE / (60 + rank)) AS rrf FROM u GROUP BY 1, 2),
    f1 AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY floor(rrf * 1e6 + 0.5) DESC, id) AS place FROM f0 QUALIFY place <= 20),
    f2 AS (SELECT query, id, place, rrf / max(rrf) OVER (PARTITION BY query) AS fused FROM f1),
    j AS (SELECT f2.*, v.semantic, x.lexical, x.rank AS lexical_rank, m.created_s, m.superseded_by AS next_id, m.level, m.conflict FROM f2 LEFT
        JOIN v USING (query, id) LEFT JOIN x USING (query, id) JOIN m USING (id)),
    k AS (SELECT *, fused + 0.1 * exp(-CAST({AS_OF} - created_s AS DOUBLE) / 3600 / 720) + CASE WHEN next_id IS NOT NULL THEN -0.5::DOUBLE
        ELSE 0::DOUBLE END AS raw FROM j a WHERE NOT EXISTS (SELECT 1 FROM j b WHERE b.query = a.query AND b.id = a.next_id)),
    l AS (SELECT *, greatest(0::DOUBLE, least(1::DOUBLE, raw)) AS final FROM k), r AS (SELECT *, row_number() OVER (PARTITION BY query
        ORDER BY floor(final * 1e6 + 0.5) DESC, place) AS rank FROM l QUALIFY rank <= 10),
    s AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY semantic DESC NULLS LAST, id) AS near FROM r),
    a AS (SELECT query, count(*) AS n, max(semantic) AS best, max(semantic) - max(CASE WHEN near = 2 THEN semantic END) AS gap FROM s GROUP BY query),
    {{topic}},
    g AS (SELECT s.*, topic.aligned, topic.unstated, least(1::DOUBLE, coalesce(1 / (1 + exp(-8 * (semantic - 0.5))), 0.02::DOUBLE) + CASE WHEN lexical_rank <= 3
        THEN 0.08::DOUBLE WHEN lexical >= 0.5 THEN 0.04::DOUBLE ELSE 0::DOUBLE END)
        * CASE WHEN n < 2 THEN 1::DOUBLE WHEN gap >= 0.25 THEN 1.05::DOUBLE WHEN gap <= 0.05 THEN 0.9::DOUBLE ELSE 1::DOUBLE END
        * (0.7::DOUBLE + 0.3::DOUBLE * pow(2::DOUBLE, -CAST({AS_OF} - created_s AS DOUBLE) / 86400 / 365))
        * CASE WHEN level = 'certain' THEN 1::DOUBLE WHEN level = 'outdated' THEN 0.7::DOUBLE ELSE 0.95::DOUBLE END
        * CASE WHEN n < 3 THEN 0.9::DOUBLE ELSE 1::DOUBLE END * CASE WHEN best < 0.35 THEN 0.8::DOUBLE ELSE 1::DOUBLE END
        * CASE WHEN semantic >= 0.5 AND coalesce(lexical_rank, 99) > 10 AND coalesce(lexical, 0) < 0.5 AND query IN (SELECT query FROM x) THEN 0.8::DOUBLE ELSE 1::DOUBLE END
        * CASE WHEN aligned = 0 AND absent THEN 0.3::DOUBLE * 0.85::DOUBLE WHEN aligned = 0 THEN 0.3::DOUBLE WHEN aligned = 0.7 THEN 0.85::DOUBLE ELSE 1::DOUBLE END
        * CASE WHEN unstated THEN 0.45::DOUBLE ELSE 1::DOUBLE END AS c FROM s JOIN a USING (query) JOIN topic USING (query, id) WHERE best >= 0.1),
    y AS (SELECT query, id, rank, final, aligned, unstated, greatest(0::DOUBLE, least(1::DOUBLE, CASE WHEN conflict THEN least(c, 0.55::DOUBLE) * 0.85
        ELSE c END)) AS confidence FROM g),
    z AS (SELECT *, max(confidence) OVER (PARTITION BY query) AS sure FROM y)
    SELECT query, id, rank AS place, round(final, 6) AS final, round(confidence, 6) AS confidence, CASE WHEN confidence >= 0.9 THEN 'high'
        WHEN confidence >= 0.6 THEN 'qualified' ELSE 'low' END AS tier,
        CASE WHEN sure < 0.6 THEN 'none' WHEN sure >= 0.9 THEN 'confident' ELSE 'qualified' END AS verdict FROM z"""
NO_TOPIC = "topic AS (SELECT query, id, NULL::DOUBLE AS aligned, false AS absent, false AS unstated FROM s)"


@query(f"WITH {LEGS}, {VERDICT.format(topic=NO_TOPIC)}")
def recall_end_to_end(spark, sf_dir):
    """The whole benchmark query set through both legs, fusion, boosts, supersession, gate and verdict."""
    rows = memories(spark, sf_dir, "id", "content", "created_s", "superseded_by", "level", "conflict").withColumnRenamed("superseded_by", "next_id")
    out = recall.recall(_queries(spark, sf_dir), rows, _vector_leg(spark, sf_dir), AS_OF)
    return out.select("query", "id", F.col("place").cast("long").alias("place"), F.round("final", 6).alias("final"), F.round("confidence", 6).alias("confidence"), "tier", "verdict")


@query(f"WITH {LEGS} SELECT query, id, round(lexical, 6) AS lexical, rank FROM x")
def lexical_leg_batch(spark, sf_dir):
    out = recall.lexical_leg(_queries(spark, sf_dir), memories(spark, sf_dir, "id", "content"), 20)
    return out.select("query", "id", F.round("lexical", 6).alias("lexical"), F.col("rank").cast("long").alias("rank"))


ASKED = """CASE item_id % 6 WHEN 0 THEN 'Fix the build and test it' WHEN 1 THEN 'how to update documentation' WHEN 2 THEN 'store and fetch data'
    WHEN 3 THEN 'performance of the design' WHEN 4 THEN 'nothing to expand' ELSE 'delete delete bug' END"""
_KNOWN = ", ".join(f"('{w}', {i}, '{s}')" for w, all_ in recall.SYNONYMS.items() for i, s in enumerate(all_))


@query(f"""WITH q AS (SELECT item_id AS query, {ASKED} AS content FROM benchmark), k AS (SELECT * FROM (VALUES {_KNOWN}) AS k(w, turn, synonym)),
    p AS (SELECT query, content, string_split(lower(content), ' ') AS ws FROM q), w AS (SELECT query, content, unnest(ws) AS w,
        generate_subscripts(ws, 1) AS place FROM p),
    w1 AS (SELECT query, content, w, min(place) AS place FROM w GROUP BY 1, 2, 3),
    m AS (SELECT query, content AS own, regexp_replace(content, '(?i)\\b' || w || '\\b', synonym, 'g') AS content, turn, place FROM w1 JOIN k USING (w)),
    o AS (SELECT query, content, min((turn, place)) AS o FROM m WHERE content <> own GROUP BY 1, 2), r AS (SELECT query, content,
        row_number() OVER (PARTITION BY query ORDER BY o) AS n FROM o)
    SELECT query, 0 AS n, content FROM q UNION ALL SELECT query, n, content FROM r WHERE n <= 3""")
def query_expansion(spark, sf_dir):
    return recall.expanded(table(spark, sf_dir, "benchmark").selectExpr("item_id AS query", f"{ASKED} AS content")).select("query", F.col("n").cast("long").alias("n"), "content")


@query(f"""WITH {LEGS}, u AS (SELECT query, id, 1 / (1 + rank)::DOUBLE AS score FROM v UNION ALL SELECT query, id, lexical * 0.9 FROM x)
    SELECT query, id, round(max(score), 6) AS score FROM u GROUP BY 1, 2""")
def expansion_merge(spark, sf_dir):
    """Results of several searches of one query: each scaled by its factor, the best score of a row counts."""
    a = _vector_leg(spark, sf_dir).select("query", "id", (1 / (1 + F.col("rank"))).alias("score"))
    b = recall.lexical_leg(_queries(spark, sf_dir), memories(spark, sf_dir, "id", "content"), 20).select("query", "id", F.col("lexical").alias("score"))
    return recall.merged_hits([(a, 1.0), (b, 0.9)]).select("query", "id", F.round("score", 6).alias("score"))


EDGES = "e AS (SELECT l_orderkey % 900 AS src, l_partkey % 900 AS dst, count(*) AS weight FROM lineitem WHERE l_orderkey % 900 <> l_partkey % 900 GROUP BY 1, 2)"


def _edges(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 900).alias("src"), (F.col("l_partkey") % 900).alias("dst")).filter("src <> dst")
    return e.groupBy("src", "dst").agg(F.count("*").alias("weight"))


@query(f"""WITH {LEGS}, {EDGES}, s AS (SELECT src AS via, dst AS id, weight FROM e UNION ALL SELECT dst, src, weight FROM e),
    n AS (SELECT v.query, s.id, s.via, s.weight FROM v JOIN s ON s.via = v.id WHERE v.rank <= 3 AND NOT EXISTS (SELECT 1 FROM v o
        WHERE o.query = v.query AND o.id = s.id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY query, via ORDER BY weight DESC, id) AS n FROM n)
    SELECT query, id, max(weight) AS weight, count(*) AS paths FROM r WHERE n <= 5 GROUP BY 1, 2""")
def association_expansion(spark, sf_dir):
    """A pair may be an edge in both directions; each counts."""
    found = recall.associated(_vector_leg(spark, sf_dir), _edges(spark, sf_dir))
    return found.groupBy("query", "id").agg(F.max("weight").alias("weight"), F.count("*").alias("paths"))


KINDED = f"""{EDGES}, g AS (SELECT src, dst, weight, CASE (src * 7 + dst) % 8 WHEN 0 THEN 'supports' WHEN 1 THEN 'contradicts' WHEN 2 THEN 'updates'
        WHEN 3 THEN 'sourced_from' WHEN 4 THEN 'causes' WHEN 5 THEN 'about' WHEN 6 THEN 'extends' ELSE 'related_to' END AS kind FROM e
        WHERE weight >= 2)"""
_KINDS = ("supports", "contradicts", "updates", "sourced_from", "causes", "about", "extends", "related_to")


def _kinded(spark, sf_dir):
    kinds = F.array(*map(F.lit, _KINDS))
    return _edges(spark, sf_dir).filter("weight >= 2").withColumn("kind", F.element_at(kinds, ((F.col("src") * 7 + F.col("dst")) % 8 + 1).cast("int")))


@query(f"""WITH {LEGS}, {KINDED}, n AS (SELECT src AS id, kind FROM g UNION ALL SELECT dst, kind FROM g WHERE src <> dst),
    k AS (SELECT id, count(*) FILTER (kind = 'supports') AS supports, count(*) FILTER (kind = 'contradicts') AS conflicts FROM n GROUP BY id)
    SELECT v.query, v.id, m.level, coalesce(supports, 0) AS supports, coalesce(conflicts, 0) AS conflicts,
        round(greatest(0::DOUBLE, least(1::DOUBLE, pow(1 + greatest(({AS_OF} - created_s) / 86400::DOUBLE, 0), -CASE m.kind
        WHEN 'observation' THEN 0.1::DOUBLE WHEN 'context' THEN 0.05::DOUBLE WHEN 'fact' THEN 0.02::DOUBLE WHEN 'decision' THEN 0.02::DOUBLE
        WHEN 'preference' THEN 0.01::DOUBLE ELSE 0.05::DOUBLE END))), 6) AS retention
    FROM v JOIN m USING (id) LEFT JOIN k USING (id)""")
def evidence_join(spark, sf_dir):
    rows = memories(spark, sf_dir, "id", "level", "kind", "created_s")
    out = recall.evidence(_vector_leg(spark, sf_dir).select("query", "id"), rows, _kinded(spark, sf_dir), (AS_OF - F.col("created_s")) / 86400.0)
    return out.withColumn("retention", F.round("retention", 6))


@query(f"""WITH {M} SELECT id, round(coalesce(semantic, 0) * (4.5::DOUBLE / 3 - 1) + 0.1 * exp(-CAST({AS_OF} - created_s AS DOUBLE) / 3600 / 720) * (0.25::DOUBLE
        / 0.5 - 1) + importance / 100::DOUBLE * 0.2, 6) AS delta FROM m""")
def serving_weights(spark, sf_dir):
    rows = memories(spark, sf_dir, "id", "semantic", "created_s", "importance")
    return rows.select("id", F.round(recall.serving(F.col("semantic"), F.col("importance") / 100, scoring.recency_boost((AS_OF - F.col("created_s")) / 3600), 4.5, 0.25, 0.2), 6).alias("delta"))


@query(f"""WITH {LEGS}, b AS (SELECT query, id, greatest(0, least(1, s)) * (0.5::DOUBLE + 0.5::DOUBLE * greatest(0::DOUBLE, least(1::DOUBLE,
        importance / 80::DOUBLE))) AS score FROM c JOIN m USING (id) WHERE id % 3 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY floor(score * 1e6 + 0.5) DESC, id) AS rank FROM b) SELECT query, id, rank,
        round(score, 6) AS score FROM r WHERE rank <= 5""")
def belief_search(spark, sf_dir):
    """Beliefs are every third record; all of them are scored, not a newest few."""
    vectors = table(spark, sf_dir, "embeddings")
    known = memories(spark, sf_dir, "id", "importance").select(F.col("id").alias("vec_id"), (F.col("importance") / 80).alias("confidence"))
    found = recall.beliefs(vectors.filter("vec_id % 3 = 0").join(known, "vec_id"), vectors, _queries(spark, sf_dir), 5, "vec_id", "embedding")
    return found.select("query", "id", "rank", F.round("score", 6).alias("score"))


@query(f"WITH {M} SELECT id, kind FROM m WHERE (contains(lower(content), 'license') OR contains(lower(source), 'license')) AND kind IN ('fact', 'decision')")
def knowledge_search(spark, sf_dir):
    rows = memories(spark, sf_dir, "id", "kind", "content", "source").filter("kind IN ('fact', 'decision')")
    return recall.contains_search(rows, "License", "content", "source").select("id", "kind")


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring')")
def skill_search(spark, sf_dir):
    return recall.contains_search(table(spark, sf_dir, "part"), "ring", "p_name", "p_type").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))


@query(f"""WITH {M}, i AS (SELECT id, substring(content, 1, 80) AS preview, [lang, source, kind] AS keys, importance FROM m)
    SELECT id, importance + CASE WHEN contains(lower(preview), 'the') THEN 10 ELSE 0 END + CASE WHEN contains(lower(preview), 'tion') THEN 10 ELSE 0 END
        + CASE WHEN len(list_filter(keys, lambda t: contains(lower(t), 'the'))) > 0 THEN 15 ELSE 0 END + CASE WHEN len(list_filter(keys,
        lambda t: contains(lower(t), 'tion'))) > 0 THEN 15 ELSE 0 END AS score
    FROM i ORDER BY score DESC, id LIMIT 30""")
def index_search(spark, sf_dir):
    rows = memories(spark, sf_dir, "id", "content", "lang", "source", "kind", "importance")
    rows = rows.select("id", F.substring("content", 1, 80).alias("preview"), F.array("lang", "source", "kind").alias("key_terms"), "importance")
    return recall.index_search(rows, ["the", "tion"], 30).select("id", "score")


@query("""WITH a AS (SELECT 'conversation' AS origin, conv_id * 100 + turn AS id, (CAST(contains(lower(text), 'tion') AS INT) + CAST(contains(lower(text),
        'ment') AS INT)) / 2::DOUBLE AS score FROM conversations
    UNION ALL SELECT 'page', page_id, (CAST(contains(lower(html), 'tion') AS INT) + CAST(contains(lower(html), 'ment') AS INT)) / 2::DOUBLE FROM pages)
    SELECT origin, id, score FROM a WHERE score > 0 ORDER BY score DESC, origin, id LIMIT 40""")
def transcript_search(spark, sf_dir):
    """Two sources under one score; no source has a budget of its own."""
    a = table(spark, sf_dir, "conversations").select(F.lit("conversation").alias("origin"), (F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")
    b = table(spark, sf_dir, "pages").select(F.lit("page").alias("origin"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    return search.lexical_top_k(a.unionByName(b), "text", ["tion", "ment"], 40, "origin", "id").select("origin", "id", "score")


@query(f"""WITH {LEGS}, f AS (SELECT query, id FROM x WHERE lexical >= 0.6), n AS (SELECT id FROM m ORDER BY created_s DESC, id LIMIT 3)
    SELECT query, id, false AS fallback FROM f UNION ALL SELECT q.query, n.id, true FROM q, n WHERE q.query NOT IN (SELECT query FROM f)""")
def recency_fallback(spark, sf_dir):
    rows = memories(spark, sf_dir, "id", "content", "created_s")
    found = recall.lexical_leg(_queries(spark, sf_dir), rows, 20).filter("lexical >= 0.6")
    return recall.with_fallback(_queries(spark, sf_dir), found, rows, 3, F.desc("created_s"), F.asc("id"))


@query(f"""WITH {M}, p AS (SELECT id, '[' || kind || '] from ' || coalesce(project, 'unknown') || ' about ' || CASE WHEN id % 4 = 0 THEN 'general'
        ELSE array_to_string([lang, source, kind][1:id % 4], ', ') END AS prefix FROM m)
    SELECT id, CASE WHEN length(prefix) > 30 THEN substring(prefix, 1, 27) || '...' ELSE prefix END AS prefix FROM p WHERE prefix IS NOT NULL""")
def context_prefix(spark, sf_dir):
    rows = memories(spark, sf_dir, "id", "kind", "project", "lang", "source")
    topics = F.slice(F.array("lang", "source", "kind"), 1, (F.col("id") % 4).cast("int"))
    return rows.select("id", recall.context_prefix(F.col("kind"), F.col("project"), topics, 30).alias("prefix"))


@query(f"""WITH {M} SELECT id % 10 AS category, round(avg(CASE WHEN id % 2 = 0 THEN 1::DOUBLE ELSE 0 END + CASE WHEN id % 3 = 0 THEN 0.5::DOUBLE ELSE 0 END -
        CASE WHEN id % 5 = 0 THEN 2::DOUBLE ELSE 0 END
    + CASE WHEN id % 7 = 0 THEN CASE WHEN id % 2 = 0 THEN -0.5::DOUBLE ELSE 0.5::DOUBLE END ELSE 0 END), 6) AS useful, count(*) FILTER (id % 7 = 0
        AND id % 2 <> 0) AS abstained FROM m GROUP BY 1""")
def rag_scores(spark, sf_dir):
    rows = memories(spark, sf_dir, "id")
    score = recall.useful_score(F.col("id") % 2 == 0, F.col("id") % 3 == 0, F.col("id") % 5 == 0, F.col("id") % 7 == 0)
    return rows.groupBy((F.col("id") % 10).alias("category")).agg(F.round(F.avg(score), 6).alias("useful"), F.count_if((F.col("id") % 7 == 0) & (F.col("id") % 2 != 0)).alias("abstained"))


NATIONS = """e AS (SELECT DISTINCT s_nationkey AS src, c_nationkey AS dst FROM supplier JOIN customer ON s_suppkey % 10 = c_custkey % 10
        WHERE s_nationkey <> c_nationkey AND (s_nationkey * 3 + c_nationkey) % 7 = 1),
    p AS (SELECT src, dst, (src * 5 + dst * 3) % 20 AS low, CASE WHEN (src + dst) % 4 <> 0 THEN (src * 5 + dst * 3) % 20 + 6 + src % 5 END AS high FROM e)"""


@query(f"""WITH RECURSIVE {NATIONS}, w AS (SELECT src AS vertex, dst AS here, low, high, 1 AS hops FROM p UNION
    SELECT w.vertex, p.dst, greatest(w.low, p.low), CASE WHEN w.high IS NULL THEN p.high WHEN p.high IS NULL THEN w.high ELSE least(w.high,
        p.high) END, hops + 1
    FROM w JOIN p ON w.here = p.src WHERE w.hops < 4 AND w.here <> w.vertex AND (w.high IS NULL OR p.low < w.high) AND (p.high IS NULL OR p.high > w.low))
    SELECT vertex, min(hops) AS hops FROM w WHERE here = vertex GROUP BY vertex""")
def temporal_cycles(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("src"), (F.col("s_suppkey") % 10).alias("k")).distinct()
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("dst"), (F.col("c_custkey") % 10).alias("k")).distinct()
    e = s.join(c, "k").filter("src <> dst AND (src * 3 + dst) % 7 = 1").select("src", "dst").distinct()
    low = (F.col("src") * 5 + F.col("dst") * 3) % 20
    return graph.temporal_cycles(e.select("src", "dst", low.alias("low"), F.when((F.col("src") + F.col("dst")) % 4 != 0, low + 6 + F.col("src") % 5).alias("high")), 4)


# Kinds of edges, depth and least weight of the views of the graph.
VIEWS = {
    "semantic": (("related_to", "supports", "extends", "informed_by", "contradicts", "rejects"), 3, 0.2),
    "temporal": (("updates", "supersedes", "informed_by", "sourced_from"), 5, 0.0),
    "causal": (("causes", "informed_by", "sourced_from"), 4, 0.1),
    "entity": (("references", "about", "describes", "created_by", "affects"), 2, 0.2),
}
PROVENANCE = ("sourced_from", "informed_by", "extends")


def _walk(kinds, depth: int, both: bool) -> str:
    """Vertices within `depth` steps of vertex 1, in SQL."""
    listed = ", ".join(f"'{k}'" for k in kinds)
    steps = f"u AS (SELECT DISTINCT src, dst FROM g WHERE kind IN ({listed})" + (f" UNION SELECT dst, src FROM g WHERE kind IN ({listed}))" if both else ")")
    return f"{steps}, w AS (SELECT 1::BIGINT AS vertex, 0 AS hops UNION SELECT dst, hops + 1 FROM w JOIN u ON u.src = w.vertex WHERE hops < {depth})"


def _views(name: str) -> str:
    kinds, depth, _ = VIEWS[name]
    return f"WITH RECURSIVE {KINDED}, {_walk(kinds, depth, True)} SELECT '{name}' AS view, vertex, min(hops) AS hops FROM w GROUP BY vertex"


@query(" UNION ALL ".join(f"SELECT * FROM ({_views(n)})" for n in VIEWS))
def graph_views(spark, sf_dir):
    start, edges, out = spark.range(1, 2).select(F.col("id").alias("vertex")), _kinded(spark, sf_dir), None
    for name, (kinds, depth, least) in VIEWS.items():
        one = graph.view(edges, start, kinds, depth, least).select(F.lit(name).alias("view"), "vertex", "hops")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH RECURSIVE {KINDED}, {_walk(PROVENANCE, 4, False)} SELECT vertex, min(hops) AS hops FROM w GROUP BY vertex")
def provenance_chain(spark, sf_dir):
    return graph.provenance(_kinded(spark, sf_dir), spark.range(1, 2).select(F.col("id").alias("vertex")), PROVENANCE, 4)


@query(f"""WITH RECURSIVE {KINDED}, s AS (SELECT src, dst, weight FROM g UNION ALL SELECT dst, src, weight FROM g), w AS (SELECT vertex, 0 AS hops
        FROM (VALUES (1::BIGINT), (7)) AS a(vertex) UNION SELECT dst, hops + 1 FROM w JOIN s ON s.src = w.vertex WHERE hops < 2),
    d AS (SELECT vertex, min(hops) AS hops FROM w GROUP BY vertex)
    SELECT b.vertex, b.hops, round(1.0::DOUBLE / (1 + b.hops) / (1 + 0.1::DOUBLE * min(s.weight)), 6) AS score FROM s JOIN d a ON a.vertex = s.src
        JOIN d b ON b.vertex = s.dst WHERE b.hops > 0 AND a.hops + 1 = b.hops GROUP BY 1, 2""")
def multi_hop_search(spark, sf_dir):
    anchors = spark.createDataFrame([(1,), (7,)], "vertex long")
    return graph.multi_hop(_kinded(spark, sf_dir), anchors, 2).select("vertex", "hops", F.round("score", 6).alias("score"))


@query(f"""WITH {KINDED}, n AS (SELECT range AS vertex FROM range(1000)), d AS (SELECT n.vertex, count(g.src) AS degree FROM n LEFT JOIN g ON g.src = n.vertex
        GROUP BY 1), a AS (SELECT avg(degree) AS mean FROM d)
    SELECT count(*) AS vertices, sum(degree)::BIGINT AS edges, round(any_value(mean), 6) AS mean,
        round(2 * sum(degree) / (count(*) * (count(*) - 1))::DOUBLE, 9) AS density,
        count(*) FILTER (degree > 1.5 * mean) AS tight, count(*) FILTER (degree < 0.5 * mean) AS loose FROM d, a""")
def network_connectivity(spark, sf_dir):
    out = graph.connectivity(spark.range(1000).withColumnRenamed("id", "vertex"), _kinded(spark, sf_dir))
    return out.select("vertices", "edges", F.round("mean", 6).alias("mean"), F.round("density", 9).alias("density"), "tight", "loose")


PROMPT = """CASE (conv_id + turn) % 9 WHEN 0 THEN 'Thanks!' WHEN 1 THEN 'please ignore memory and go' WHEN 2 THEN 'x' WHEN 3 THEN 'fix it' WHEN 4 THEN 'and then?'
        WHEN 5 THEN 'ok okay'
    WHEN 6 THEN 'good morning.' ELSE text END"""


def _rlike(x: str, p: str) -> str:
    return f"regexp_matches(lower({x}), '{p.replace(chr(39), chr(39) * 2)}')"


@query(f"""WITH p AS (SELECT conv_id, turn, {PROMPT} AS x FROM conversations)
    SELECT conv_id, turn, CASE WHEN {_rlike('x', '|'.join(routing.OPT_OUTS))} THEN 'opt_out' WHEN length(trim(x)) < 2 THEN 'trivial'
        WHEN {_rlike('trim(x)', routing.GREETING)} THEN 'greeting'
        WHEN {_rlike('trim(x)', routing.TASK_CUE)} OR length(trim(x)) >= 40 THEN 'task' ELSE 'open' END AS gate FROM p""")
def prompt_gate(spark, sf_dir):
    return table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{PROMPT} AS x").select("conv_id", "turn", routing.prompt_gate(F.col("x")).alias("gate"))


CAPTURED = """concat(text, CASE turn % 4 WHEN 0 THEN '\\nTraceback of the test\\nresolved 3 packages' WHEN 1 THEN '\\nprogress 10 %\\nfix: edited one file'
        WHEN 2 THEN '\\ndownloaded, passing error' ELSE '' END)"""


@query(f"""WITH c AS (SELECT conv_id, turn, {CAPTURED.replace(chr(92) + 'n', "' || chr(10) || '")} AS x FROM conversations),
    l AS (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(x, '\\r?\\n'), lambda s: trim(s)), lambda s: s <> '') AS l FROM c),
    i AS (SELECT *, list_filter(l, lambda s: {_rlike('s', routing.IMPORTANT_LINE)}) AS i FROM l),
    k AS (SELECT *, list_filter(CASE WHEN len(i) > 0 THEN i ELSE l[1:4] END, lambda s: NOT {_rlike('s', routing.NOISE_LINE)}) AS k FROM i),
    e AS (SELECT *, CASE WHEN len(list_filter(k, lambda s: {_rlike('s', routing.CRASH_LINE)})) > 0 THEN k ELSE list_concat(k, list_filter(l,
        lambda s: {_rlike('s', routing.CRASH_LINE)})[1:1]) END AS d FROM k)
    SELECT conv_id, turn, array_to_string(d[1:6], chr(10)) AS distilled FROM e""")
def signal_distill(spark, sf_dir):
    return table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{CAPTURED} AS x").select("conv_id", "turn", routing.distilled(F.col("x")).alias("distilled"))


@query(f"""WITH {M} SELECT id, importance, accesses FROM m WHERE importance >= 70 AND accesses >= 5 AND status = 'active' AND active AND NOT list_has_any([lang,
        source, kind], ['de', 'src3', 'context']) ORDER BY importance DESC, accesses DESC, id LIMIT 20""")
def team_compile(spark, sf_dir):
    """Durable records without any denied tag, the most important first."""
    rows = memories(spark, sf_dir, "id", "importance", "accesses", "status", "active", "lang", "source", "kind")
    denied = F.arrays_overlap(F.array("lang", "source", "kind"), F.array(F.lit("de"), F.lit("src3"), F.lit("context")))
    kept = rows.filter((F.col("importance") >= 70) & (F.col("accesses") >= 5) & (F.col("status") == "active") & F.col("active")).filter(~F.coalesce(denied, F.lit(False)))
    return kept.orderBy(F.desc("importance"), F.desc("accesses"), "id").limit(20).select("id", "importance", "accesses")


@query("""SELECT 'only' AS part, n FROM (SELECT c_nationkey AS n FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL
    SELECT 'both', n FROM (SELECT c_nationkey AS n FROM customer INTERSECT SELECT s_nationkey FROM supplier)""")
def except_intersect(spark, sf_dir):
    a, b = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n"))
    return a.subtract(b).select(F.lit("only").alias("part"), "n").unionByName(a.intersect(b).select(F.lit("both").alias("part"), "n"))


CODED = """concat(text, CASE doc_id % 9 WHEN 0 THEN ' see run_all(x) in main.py' WHEN 1 THEN ' class Engine extends Base on 2024-01-05'
        WHEN 2 THEN ' Redis and Docker, Redis, Nodejs' WHEN 3 THEN ' src/main.py and (data.csv) go (x)' WHEN 4 THEN ' the abstract factory pattern, Observer Pattern with lazy  loading'
        WHEN 5 THEN ' a "Linear Model" and Linear Model, Event Queue System' WHEN 6 THEN ' ./a/b.c/d new Thing(1) at 2024-01-05T10:00:00' ELSE '' END)"""


def _names(x: str) -> str:
    """id, kind, name, confidence of entities in SQL; x: the texts (id, x)."""
    quoted = lambda p: p.replace("'", "''")
    trimmed = lambda n: f"trim({n}, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))"
    all_ = [f"SELECT DISTINCT id, '{k}' AS kind, {trimmed('n') if k == 'file' else 'n'} AS name, {c}::DOUBLE AS confidence FROM (SELECT id, unnest(regexp_extract_all(x, '{quoted(p)}', {g})) AS n FROM {x}) WHERE '{k}' <> 'function' OR length(n) >= {entities.LEAST}" for k, c, p, g in entities.PATTERNS]
    return f"SELECT id, kind, name, max(confidence) AS confidence FROM ({' UNION ALL '.join(all_)}) GROUP BY 1, 2, 3"


def _entities(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id AS id", f"{CODED} AS x")
    return rows.select("id", F.explode(entities.entities(F.col("x"))).alias("e")).select("id", "e.kind", "e.name", "e.confidence")


@query(f"WITH d AS (SELECT doc_id AS id, {CODED} AS x FROM documents) {_names('d')}")
def entity_extraction(spark, sf_dir):
    """Entities of every document by kind, each name once."""
    return _entities(spark, sf_dir)


@query(f"""WITH d AS (SELECT doc_id AS id, {CODED} AS x FROM documents), e AS (SELECT DISTINCT id, name FROM ({_names('d')})),
    n AS (SELECT name, min(id) AS hub FROM e GROUP BY name) SELECT hub AS src, id AS dst, count(*) AS weight FROM e JOIN n USING (name) WHERE id <> hub GROUP BY 1, 2""")
def entity_graph(spark, sf_dir):
    """Records are linked to the first record that names one of their entities: a star for each entity, not all pairs."""
    names = _entities(spark, sf_dir).select("id", "name").distinct()
    hubs = names.groupBy("name").agg(F.min("id").alias("src"))
    return names.join(hubs, "name").filter("id <> src").groupBy("src", F.col("id").alias("dst")).agg(F.count("*").alias("weight"))


CHANGES = ("updates", "extends", "causes")
_CHANGE = ", ".join(f"'{k}'" for k in CHANGES)


@query(f"""WITH RECURSIVE {KINDED}, s AS (SELECT DISTINCT src, dst FROM g WHERE kind IN ({_CHANGE}) UNION SELECT l_suppkey, l_suppkey FROM lineitem WHERE l_suppkey % 37 = 5),
    r AS (SELECT src, dst FROM s UNION SELECT r.src, s.dst FROM r JOIN s ON r.dst = s.src), c AS (SELECT a.src AS vertex, a.dst AS other FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src)
    SELECT vertex, min(other) AS component, count(*) AS size FROM c GROUP BY vertex""")
def supersession_cycles(spark, sf_dir):
    """Records on cycles of any length of what updates, extends or causes what."""
    loops = table(spark, sf_dir, "lineitem").filter("l_suppkey % 37 = 5").select(F.col("l_suppkey").alias("src"), F.col("l_suppkey").alias("dst"))
    edges = _kinded(spark, sf_dir).filter(F.col("kind").isin(*CHANGES)).select("src", "dst")
    return cycles.components(edges.unionByName(loops))
