"""Queries over the graph, deduplication and cluster operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spindrift.functions import vectors
from spindrift.operators import cluster, dedup, graph, search
from spindrift.plans.registry import M, memories, query, table
from spindrift.sources.tables import stored

ITEM = "i AS (SELECT DISTINCT l_orderkey AS basket, l_partkey AS item FROM lineitem)"
PAIR = f"{ITEM}, e AS (SELECT a.item AS src, b.item AS dst, count(*) AS weight FROM i a JOIN i b ON a.basket = b.basket AND a.item < b.item GROUP BY 1, 2)"


def _pairs(spark, sf_dir, least=1):
    return graph.coactivation(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", least)


@query(f"WITH {PAIR} SELECT src, dst, weight FROM e WHERE weight >= 2")
def coactivation_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir, 2)


@query(f"""WITH {PAIR}, w AS (SELECT src, dst FROM e WHERE weight >= 2 UNION ALL SELECT dst, src FROM e WHERE weight >= 2), a AS (SELECT DISTINCT dst AS vertex
        FROM w WHERE src = 1 AND dst <> 1), b AS (SELECT DISTINCT dst AS vertex FROM w JOIN a ON w.src = a.vertex WHERE dst <> 1
        AND dst NOT IN (SELECT vertex FROM a)) SELECT 1 AS vertex, 0 AS hops UNION ALL SELECT vertex, 1 FROM a UNION ALL SELECT vertex, 2 FROM b""")
def bfs_depth2(spark, sf_dir):
    starts = spark.range(1, 2).select(F.col("id").alias("vertex"))
    return graph.bfs(graph.both_ways(stored(_pairs(spark, sf_dir, 2))), starts, 2)


@query(f"""WITH {PAIR}, w AS MATERIALIZED (SELECT src, dst, weight FROM e WHERE weight >= 2), u AS MATERIALIZED (SELECT src, dst FROM w UNION ALL SELECT dst, src
        FROM w),
    o AS MATERIALIZED (SELECT 1 AS vertex UNION SELECT dst FROM u WHERE src = 1), v AS MATERIALIZED (SELECT vertex FROM o UNION SELECT dst FROM u SEMI
        JOIN o ON u.src = o.vertex)
    SELECT src, dst, weight FROM w SEMI JOIN v a ON w.src = a.vertex SEMI JOIN v b ON w.dst = b.vertex""")
def neighborhood(spark, sf_dir):
    return graph.neighborhood(stored(_pairs(spark, sf_dir, 2)), spark.range(1, 2).select(F.col("id").alias("vertex"))).select("src", "dst", "weight")


NATION = """e AS (SELECT DISTINCT s_nationkey AS src, c_nationkey AS dst, (s_nationkey * 7 + c_nationkey * 3) % 11 + 1 AS weight FROM supplier
        JOIN customer ON s_suppkey % 10 = c_custkey % 10 WHERE s_nationkey <> c_nationkey AND (s_nationkey + c_nationkey) % 6 = 1)"""


def _nations(spark, sf_dir):
    s, c = table(spark, sf_dir, "supplier").select("s_nationkey", (F.col("s_suppkey") % 10).alias("k")).distinct(), table(spark, sf_dir, "customer").select("c_nationkey", (F.col("c_custkey") % 10).alias("k")).distinct()
    e = s.join(c, "k").filter("s_nationkey <> c_nationkey AND (s_nationkey + c_nationkey) % 6 = 1")
    return e.select(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst"), ((F.col("s_nationkey") * 7 + F.col("c_nationkey") * 3) % 11 + 1).alias("weight")).distinct()


@query(f"""WITH RECURSIVE {NATION}, p AS (SELECT [src, dst] AS path, weight::DOUBLE AS total, dst AS last FROM e WHERE src = 1 UNION ALL SELECT list_append(path,
        e.dst), total + weight, e.dst FROM p JOIN e ON p.last = e.src WHERE p.last <> 7 AND len(path) < 4 AND NOT list_contains(path, e.dst))
    SELECT array_to_string(path, '-') AS path, total FROM p WHERE last = 7 ORDER BY total, len(path), p.path LIMIT 5""")
def paths_k(spark, sf_dir):
    found = graph.simple_paths(_nations(spark, sf_dir), 1, 7, 3, 5)
    return found.select(F.array_join(F.transform("path", lambda x: x.cast("string")), "-").alias("path"), "total")


@query(f"""WITH {PAIR}, w AS (SELECT src, dst, weight / 3.0::DOUBLE AS weight, weight AS n, CASE WHEN (src + dst) % 3 = 0 THEN 1.5::DOUBLE
        ELSE 1::DOUBLE END AS recency FROM e WHERE weight >= 2),
    u AS (SELECT src, dst, weight, n, recency FROM w UNION ALL SELECT dst, src, weight, n, recency FROM w), s AS (SELECT DISTINCT src AS vertex FROM u
        WHERE src % 500 = 1),
    one AS (SELECT u.* FROM u WHERE src IN (SELECT vertex FROM s) AND dst NOT IN (SELECT vertex FROM s)), f AS (SELECT DISTINCT dst AS vertex FROM one),
    two AS (SELECT u.* FROM u WHERE src IN (SELECT vertex FROM f) AND dst NOT IN (SELECT vertex FROM f) AND dst NOT IN (SELECT vertex FROM s)),
    r AS (SELECT dst AS vertex, weight * ln(1 + n) * recency / 2 AS raw FROM one UNION ALL SELECT dst, weight * ln(1 + n) * recency / 3 FROM two),
        t AS (SELECT vertex, sum(raw) AS raw FROM r GROUP BY vertex)
    SELECT vertex, round(raw, 6) AS raw, round(CASE WHEN max(raw) OVER () = min(raw) OVER () THEN 0.1::DOUBLE
        ELSE 0.1 * (raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER ()) END, 6) AS boost FROM t""")
def graph_boost(spark, sf_dir):
    e = stored(_pairs(spark, sf_dir, 2)).select("src", "dst", (F.col("weight") / 3).alias("weight"), F.col("weight").alias("count"), F.when((F.col("src") + F.col("dst")) % 3 == 0, 1.5).otherwise(1.0).alias("recency"))
    seeds = graph.both_ways(e.select("src", "dst")).filter("src % 500 = 1").select(F.col("src").alias("vertex")).distinct()
    return graph.boost(e, seeds).select("vertex", F.round("raw", 6).alias("raw"), F.round("boost", 6).alias("boost"))


@query(f"""WITH {NATION}, k AS (SELECT src, dst, CASE weight % 3 WHEN 0 THEN 'uses' WHEN 1 THEN 'part_of' ELSE 'causes' END AS kind FROM e), r AS (SELECT *
        FROM (VALUES ('uses', 'part_of', 'depends_on', 0.8::DOUBLE), ('causes', 'causes', 'causes', 0.7::DOUBLE), ('part_of', 'part_of', 'part_of',
        0.9::DOUBLE)) AS t(first, second, kind, confidence))
    SELECT a.src, b.dst, r.kind, max(r.confidence) AS confidence, count(*) AS paths FROM k a JOIN k b ON a.dst = b.src AND a.src <> b.dst
        JOIN r ON r.first = a.kind AND r.second = b.kind GROUP BY 1, 2, 3""")
def two_hop_derivation(spark, sf_dir):
    e = _nations(spark, sf_dir).withColumn("kind", F.when(F.col("weight") % 3 == 0, "uses").when(F.col("weight") % 3 == 1, "part_of").otherwise("causes"))
    rules = spark.createDataFrame([("uses", "part_of", "depends_on", 0.8), ("causes", "causes", "causes", 0.7), ("part_of", "part_of", "part_of", 0.9)], "first string, second string, kind string, confidence double")
    return graph.derive(e, rules)


@query(f"WITH {NATION} SELECT a.src, a.dst FROM e a JOIN e b ON a.src = b.dst AND a.dst = b.src WHERE a.src <= a.dst")
def cycle_pairs(spark, sf_dir):
    return graph.mutual(_nations(spark, sf_dir))


@query(f"""WITH RECURSIVE {M}, l AS (SELECT id AS src, coalesce(superseded_by, merged_into) AS dst FROM m WHERE superseded_by IS NOT NULL
        OR merged_into IS NOT NULL), w AS (SELECT src, dst, 1 AS links FROM l UNION ALL SELECT w.src, l.dst, links + 1 FROM w JOIN l ON w.dst = l.src)
        SELECT src, arg_max(dst, links) AS dst, max(links)::BIGINT AS links FROM w GROUP BY src""")
def chain_walk(spark, sf_dir):
    rows = memories(spark, sf_dir, "id", "superseded_by", "merged_into").select("id", F.coalesce("superseded_by", "merged_into").alias("next")).filter("next IS NOT NULL")
    return graph.chain_ends(rows, "id", "next")


@query(f"WITH {NATION} SELECT a.src AS a, b.src AS b, count(*) AS shared FROM e a JOIN e b ON a.dst = b.dst AND a.src < b.src GROUP BY 1, 2 HAVING count(*) >= 2")
def shared_neighbours(spark, sf_dir):
    return graph.shared_neighbours(_nations(spark, sf_dir))


@query(f"""WITH {NATION} SELECT a.dst AS vertex, count(*) AS paths, sum(a.weight + b.weight)::BIGINT AS weight FROM e a JOIN e b ON a.dst = b.src
        AND a.src <> b.dst WHERE NOT EXISTS (SELECT 1 FROM e d WHERE d.src = a.src AND d.dst = b.dst) GROUP BY 1""")
def bridge_score(spark, sf_dir):
    return graph.bridges(_nations(spark, sf_dir)).select("vertex", "paths", F.col("weight").cast("long").alias("weight"))


@query(f"WITH {NATION} SELECT src, dst, weight FROM e WHERE NOT (weight <= 2 OR weight <= 5 AND (src + dst) % 2 = 1)")
def prune_associations(spark, sf_dir):
    return _nations(spark, sf_dir).filter(~((F.col("weight") <= 2) | ((F.col("weight") <= 5) & ((F.col("src") + F.col("dst")) % 2 == 1))))


@query(f"""WITH {NATION}, p AS (SELECT 1 AS a, 6 AS b UNION ALL SELECT 1, 12 UNION ALL SELECT 6, 12) SELECT src, dst, greatest(1, weight + CASE
        WHEN EXISTS (SELECT 1 FROM p WHERE a = src AND b = dst) THEN 3 ELSE 0 END) AS weight FROM e""")
def path_strengthen(spark, sf_dir):
    paths = spark.createDataFrame([([1, 6, 12],)], "path array<int>")
    return graph.strengthen(_nations(spark, sf_dir), paths, 3)


@query("""WITH s AS (SELECT conv_id, turn, list_distinct(list_filter(['tion', 'eres', 'this', 'keit', 'ment'], lambda e: contains(lower(text), e))) AS es
        FROM conversations), x AS (SELECT conv_id, turn, unnest(es) AS e FROM s)
    SELECT a.e AS src, b.e AS dst, max(CASE WHEN a.turn = b.turn THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END) AS strength, count(*) AS n FROM x a
        JOIN x b ON a.conv_id = b.conv_id AND a.turn <= b.turn AND a.e <> b.e GROUP BY 1, 2""")
def entity_cooccurrence(spark, sf_dir):
    names = F.array(*map(F.lit, ("tion", "eres", "this", "keit", "ment")))
    mentions = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.filter(names, lambda e: F.lower("text").contains(e))).alias("e"))
    return graph.cooccurrence(mentions, "conv_id", "turn", "e")


@query("SELECT min_id AS rep, doc_id AS member FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS min_id FROM documents) WHERE doc_id <> min_id")
def dup_exact(spark, sf_dir):
    return dedup.exact_pairs(table(spark, sf_dir, "documents"), "doc_id", "text")


WORDS = "list_sort(list_distinct(list_filter(string_split(regexp_replace(lower({}), '[^a-z0-9_]+', ' ', 'g'), ' '), lambda x: x <> '')))"


@query(f"""WITH s AS (SELECT doc_id AS id, {WORDS.format('text')} AS w FROM documents), c AS (SELECT min(id) AS id, w FROM s WHERE len(w) > 0 GROUP BY w),
    e AS (SELECT id, unnest(w) AS t FROM c), n AS (SELECT id, len(w) AS n FROM c), p AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM e a
        JOIN e b ON a.t = b.t AND a.id < b.id GROUP BY 1, 2)
    SELECT a, b, round(k / (x.n + y.n - k)::DOUBLE, 6) AS jaccard FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE k / (x.n + y.n - k)::DOUBLE >= 0.8
    UNION ALL SELECT c.id, s.id, 1 FROM s JOIN c ON s.w = c.w WHERE s.id <> c.id""")
def dup_jaccard(spark, sf_dir):
    """Pairs of the least ids of classes of equal word sets, and each class as a star around its least id."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    sets = dedup.named_sets(rows, "id", "text")
    same = dedup.class_members(sets.select("id", "_h"), "id", "_h")
    pairs = dedup.similar_classes(sets, 0.8).select("a", "b", F.round("jaccard", 6).alias("jaccard"))
    return pairs.unionByName(same.select(F.col("rep").alias("a"), F.col("member").alias("b"), F.lit(1.0).alias("jaccard")))


@query()
def dup_hashes(spark, sf_dir):
    """SimHash and MinHash candidates, none lost: hash values have no SQL; the tests hold the pairs against all pairs."""
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")
    signed = stored(dedup.hashes(rows, "id", "text"))
    pairs = dedup.hash_candidates(signed, "id")
    same = dedup.class_members(signed, "id", "simhash", "minhash").select(F.col("rep").alias("a"), F.col("member").alias("b"), F.lit(0).alias("hamming"), F.lit(1.0).alias("minhash"), F.lit("both").alias("stage"))
    return pairs.unionByName(same)


SCORED = """c AS (SELECT least(a.vec_id, b.vec_id) AS a, greatest(a.vec_id, b.vec_id) AS b, a.label = b.label AS same,
        list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s
    FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id), p AS (SELECT a, b, same, max(s) AS s FROM c WHERE s >= 0.25
        GROUP BY 1, 2, 3)"""


def _scored(spark, sf_dir):
    """Every pair of a stated vector (every hundredth) and another with a cosine of at least 0.25."""
    rows = table(spark, sf_dir, "embeddings")
    queries = [(r.vec_id, [float(x) for x in r.embedding]) for r in rows.filter("vec_id % 100 = 0").select("vec_id", "embedding").toLocalIterator()]
    found = search.batch_at_least(rows, "vec_id", "embedding", queries, 0.25)
    pairs = found.groupBy(F.least("query", "key").alias("a"), F.greatest("query", "key").alias("b")).agg(F.max("similarity").alias("s"))
    label = lambda c: rows.select(F.col("vec_id").alias(c), F.col("label").alias(f"l{c}"))
    return pairs.join(label("a"), "a").join(label("b"), "b").select("a", "b", (F.col("la") == F.col("lb")).alias("same"), "s")


@query(f"""WITH {SCORED} SELECT a, b, CASE WHEN s >= 0.9 THEN CASE WHEN same THEN 'high' ELSE 'medium' END WHEN s >= 0.8 THEN 'medium'
        ELSE 'low' END AS confidence, round(s, 6) AS similarity FROM p""")
def pair_confidence(spark, sf_dir):
    return _scored(spark, sf_dir).select("a", "b", dedup.pair_confidence(F.col("s"), F.col("same"), F.lit(0.0)).alias("confidence"), F.round("s", 6).alias("similarity"))


@query()
def greedy_pair_cap(spark, sf_dir):
    """Order-dependent: no SQL; the tests hold it against a plain loop."""
    pairs = _scored(spark, sf_dir).select("a", "b", F.col("s").alias("score"))
    return graph.capped_pairs(pairs, [F.desc("score"), "a", "b"], 2)


@query(f"""WITH {M}, s AS (SELECT DISTINCT id % 50 AS grp, regexp_replace(trim(unnest(regexp_split_to_array(content, '[.!?]\\s+|\\n+'))), '[.!?]+$', '') AS s
        FROM m),
    c AS (SELECT id % 50 AS grp, count(*) AS sources FROM m GROUP BY 1) SELECT s.grp, string_agg(s, '. ' ORDER BY s) AS merged,
        any_value(sources) AS sources FROM s JOIN c ON s.grp = c.grp WHERE s <> '' GROUP BY s.grp""")
def merge_all_sentences(spark, sf_dir):
    """The sorted distinct sentences of each group, over documents of every length."""
    rows = memories(spark, sf_dir, "id", "content").select((F.col("id") % 50).alias("grp"), "content")
    return dedup.merged_sentences(rows, "grp", "content")


@query("""WITH n AS (SELECT lower(p_name) AS x, min(p_partkey) AS id FROM part WHERE p_name IS NOT NULL GROUP BY 1),
    s AS (SELECT id, x, list_distinct(list_filter(string_split(regexp_replace(x, '[^a-z0-9_]+', ' ', 'g'), ' '), lambda x: x <> '')) AS w FROM n),
    p AS (SELECT a.id AS a, b.id AS b, a.x, b.x AS y, len(list_intersect(a.w, b.w)) AS k, len(a.w) AS m, len(b.w) AS n FROM s a JOIN s b ON a.id < b.id),
    q AS (SELECT a, b, CASE WHEN k / nullif(m + n - k, 0)::DOUBLE >= 0.8 THEN k / (m + n - k)::DOUBLE
        WHEN x <> '' AND y <> '' AND (contains(x, y) OR contains(y, x)) AND least(length(x), length(y)) / greatest(length(x),
        length(y))::DOUBLE >= 0.5 THEN 0.85::DOUBLE END AS score FROM p)
    SELECT a, b, round(score, 6) AS score FROM q WHERE score IS NOT NULL UNION ALL SELECT n.id, p_partkey, 1 FROM part JOIN n ON lower(p_name) = n.x
        WHERE p_partkey <> n.id""")
def entity_dedup(spark, sf_dir):
    return dedup.entity_matches(table(spark, sf_dir, "part"), "p_partkey", "p_name").select("a", "b", F.round("score", 6).alias("score"))


@query("""WITH p AS (SELECT a.label, 1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a
        JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id), c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
    SELECT c.label, any_value(c.n) AS n, round(avg(d), 5) AS spread FROM p JOIN c ON p.label = c.label GROUP BY c.label""")
def cluster_spread(spark, sf_dir):
    return cluster.spread(table(spark, sf_dir, "embeddings"), "label", "embedding").select("label", "n", F.round("spread", 5).alias("spread"))


@query("""WITH x AS (SELECT label, vec_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), c AS (SELECT label, pos,
        avg(x) AS m FROM x GROUP BY 1, 2),
    s AS (SELECT x.label, vec_id, sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))) AS s FROM x JOIN c ON x.label = c.label AND x.pos = c.pos
        GROUP BY 1, 2) SELECT label, arg_min(vec_id, (-floor(s * 1e6 + 0.5), vec_id)) AS vec_id FROM s GROUP BY label""")
def cluster_medoid(spark, sf_dir):
    return cluster.medoid(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")


@query()
def cluster_geometry(spark, sf_dir):
    """Eigenvalues have no SQL; the tests hold them against numpy over each whole group."""
    return cluster.geometry(table(spark, sf_dir, "embeddings"), "label", "embedding")


@query()
def leader_cluster(spark, sf_dir):
    """Order-dependent: no SQL; the tests hold it against a plain loop."""
    return cluster.leaders(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 0.5)


@query(f"""WITH {M}, r AS (SELECT *, row_number() OVER (PARTITION BY source, kind ORDER BY id) AS r FROM m), h AS (SELECT source, kind,
        string_agg(substring(regexp_replace(content, '\\s+', ' ', 'g'), 1, 80), '; ' ORDER BY r) AS l FROM r WHERE r <= 3 GROUP BY 1, 2)
    SELECT source, string_agg(kind || ': ' || l, chr(10) ORDER BY kind) AS summary FROM h GROUP BY source""")
def cluster_summary(spark, sf_dir):
    return cluster.summary(memories(spark, sf_dir, "id", "source", "kind", "content"), "source", "kind", "content", "id")
