"""Queries over statements: contradictions, dates, staleness, merge safety and strategies, deduplication on writing."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions import vectors
from spindrift.operators import dedup, facts, search
from spindrift.plans.registry import AS_OF, M, memories, query, table

#: A statement about a part: plain expressions that Spark and DuckDB read alike.
STATEMENT = """concat('The ', p_name, ' from ', p_brand, CASE p_partkey % 7
    WHEN 0 THEN ' is not on sale' WHEN 1 THEN ' is now on sale. It was changed to a new price' WHEN 2 THEN ' is on sale'
    WHEN 3 THEN ' is always good' WHEN 4 THEN ' is never good. Price: low' WHEN 5 THEN ' is on sale, price: high, Shop Window Display'
    ELSE ' was replaced, price: high, Shop Window Display' END)"""
FACT = {
    "id": "p_partkey",
    "subject": "p_name",
    "content": STATEMENT,
    "kind": "p_partkey % 2",
    "valid_from": f"CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE {AS_OF} - (p_partkey % 900) * 86400 END",
    "valid_to": f"CASE WHEN p_partkey % 3 = 0 THEN {AS_OF} - (p_partkey % 500) * 86400 END",
    "told": f"{AS_OF} - (p_partkey % 300) * 86400",
    "protected": "p_partkey % 31 = 3",
}
FACTS = "f AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in FACT.items()) + " FROM part)"


def _facts(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr(*(f"{v} AS `{k}`" for k, v in FACT.items()))


def _any(text: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches(lower({text}), '{p.replace(chr(39), chr(39) * 2)}')" for p in patterns) + ")"


def _words(x: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({x}), '\\s+'), lambda w: length(w) > 2))"


def _like(a: str, b: str) -> str:
    common = f"len(list_intersect({a}, {b}))"
    return f"coalesce({common}::DOUBLE / nullif(len({a}) + len({b}) - {common}, 0), 0)"


def _subject(x: str) -> str:
    return f"lower(substring(trim(regexp_split_to_array({x}, '[.!?\\n]')[1]), 1, 100))"


def _entities(x: str) -> str:
    return f"list_distinct(list_concat(regexp_extract_all({x}, '\\b([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+)\\b', 1), regexp_extract_all({x}, '(\\w+\\s*[=:]\\s*\\S+)', 1)))"


_OPPOSES = " OR ".join(
    f"(regexp_matches(lower(new), '\\b{x}\\b') AND regexp_matches(lower(old), '\\b{y}\\b') OR regexp_matches(lower(new), '\\b{y}\\b') AND regexp_matches(lower(old), '\\b{x}\\b'))"
    for x, y in facts.OPPOSITES
)
_FACTOR = "CASE WHEN rel = 'newer' THEN {}::DOUBLE WHEN rel = 'older' THEN {}::DOUBLE ELSE 1::DOUBLE END"


@query(f"""WITH {FACTS},
    p AS (SELECT n.id AS new_id, o.id AS old_id, n.content AS new, o.content AS old, n.kind = o.kind AS same, o.valid_from, o.valid_to, n.told
          FROM f n JOIN f o ON n.subject = o.subject AND n.id % 10 = 0 AND n.id <> o.id WHERE NOT o.protected),
    w AS (SELECT *, {_words('new')} AS nw, {_words('old')} AS ow, {_words(_subject('new'))} AS ns, {_words(_subject('old'))} AS os,
        {_entities('new')} AS ne, {_entities('old')} AS oe FROM p),
    s AS (SELECT *, {_like('nw', 'ow')} AS alike, {_like('ns', 'os')} AS near,
          len(list_filter(ne, lambda e: len(list_filter(oe, lambda o: contains(lower(o), lower(e)) OR contains(lower(e), lower(o)))) > 0)) AS shared,
          CASE WHEN valid_from IS NULL AND valid_to IS NULL THEN 'unknown' WHEN valid_from > told THEN 'newer' WHEN valid_to <= told THEN 'older'
          ELSE 'overlapping' END AS rel,
          {_any('new', facts.NEGATIONS)} AS denies, {_any('old', facts.NEGATIONS)} AS denied, {_any('new', facts.UPDATES)} AS updates,
          {_any('new', facts.CORRECTIONS)} AS corrects,
          ({_OPPOSES}) AS opposes FROM w),
    r AS (SELECT *, CASE WHEN alike > 0.5 AND denies AND near > 0.4 THEN 1 WHEN updates AND near > 0.5 THEN 2 WHEN same AND near > 0.6
        AND denies <> denied THEN 3
          WHEN shared >= 2 AND alike > 0.3 AND corrects THEN 4 WHEN alike > 0.85 THEN 5 WHEN near > 0.7 AND alike > 0.4 AND valid_from IS NOT NULL
          AND valid_to IS NOT NULL AND valid_to <= told THEN 6
          WHEN alike > 0.35 AND opposes THEN 7 END AS n FROM s)
    SELECT new_id, old_id, ['negation', 'update', 'opposite claim', 'correction', 'near duplicate', 'period', 'opposite words'][n] AS rule,
        round(CASE n WHEN 1 THEN alike * 0.9 * {_FACTOR.format(0.7, 1.2)} WHEN 2 THEN near * 0.85 * {_FACTOR.format(1.0, 1.3)}
        WHEN 3 THEN near * 0.8 * {_FACTOR.format(0.8, 1.1)}
            WHEN 4 THEN 0.75 * {_FACTOR.format(1.0, 1.2)} WHEN 5 THEN alike * {_FACTOR.format(0.9, 1.1)} WHEN 6 THEN 0.8
            ELSE 0.7 * {_FACTOR.format(0.7, 1.2)} END, 6) AS confidence,
        CASE WHEN n IN (2, 4) THEN 'updates' ELSE 'supersedes' END AS link FROM r WHERE n IS NOT NULL""")
def contradictions(spark, sf_dir):
    """New statements (every tenth) against all others about the same subject."""
    rows = _facts(spark, sf_dir)
    new = rows.filter("id % 10 = 0").selectExpr("id AS new_id", "subject", "content", "kind", "told AS at")
    old = rows.selectExpr("id AS old_id", "subject", "content", "kind", "valid_from", "valid_to", "protected")
    return facts.contradictions(new, old, "subject").select("new_id", "old_id", "rule", F.round("confidence", 6).alias("confidence"), "link")


@query(f"WITH {FACTS} SELECT id, valid_from IS NOT NULL AND valid_to IS NOT NULL AND (valid_from >= told + 86400 OR valid_to <= told) AS conflict FROM f")
def period_conflict(spark, sf_dir):
    got = facts.period_conflict(F.col("valid_from"), F.col("valid_to"), F.col("told"), F.col("told") + 86400)
    return _facts(spark, sf_dir).select("id", got.alias("conflict"))


@query(f"WITH {FACTS} SELECT id, CASE WHEN protected THEN 'kept' WHEN valid_to <= {AS_OF} THEN 'expired' ELSE 'active' END AS status FROM f")
def expire_facts(spark, sf_dir):
    rows = _facts(spark, sf_dir)
    return rows.select("id", F.when(F.col("protected"), "kept").when(F.col("valid_to") <= AS_OF, "expired").otherwise("active").alias("status"))


NOTE = """CASE id % 8 WHEN 0 THEN concat('Release on 2023-0', CAST(1 + id % 9 AS STRING), '-1', CAST(id % 10 AS STRING)) WHEN 1 THEN concat('We met ',
        CAST(1 + id % 20 AS STRING), ' days ago')
    WHEN 2 THEN 'Deployed yesterday, see v1.2' WHEN 3 THEN concat('Planned for March 20', CAST(18 + id % 7 AS STRING))
        WHEN 4 THEN concat('The roadmap of 20', CAST(15 + id % 10 AS STRING))
    WHEN 5 THEN 'version 1.1 is due tomorrow' WHEN 6 THEN concat(CAST(2 + id % 3 AS STRING), ' weeks ago we said 2024-13-45') ELSE 'Nothing about time' END"""
_MONTHS = ", ".join(f"'{m}'" for m in facts.MONTHS)
_ALT = "|".join(facts.MONTHS)


@query(f"""WITH {M}, t AS (SELECT id, lower({NOTE.replace('STRING', 'VARCHAR')}) AS x, DATE '2024-02-01' AS today FROM m),
    g AS (SELECT id, today, x, try_cast(nullif(regexp_extract(x, '\\b(\\d{{4}}-\\d{{2}}-\\d{{2}})\\b', 1), '') AS DATE) AS iso,
        try_cast(nullif(regexp_extract(x, '\\b(\\d{{1,3}}) (day|week|month|year)s? ago\\b', 1), '') AS INT) AS n, regexp_extract(x,
        '\\b(\\d{{1,3}}) (day|week|month|year)s? ago\\b', 2) AS unit,
        list_position([{_MONTHS}], regexp_extract(x, '\\b({_ALT}) (\\d{{4}})\\b', 1)) AS mon, try_cast(nullif(regexp_extract(x,
        '\\b({_ALT}) (\\d{{4}})\\b', 2), '') AS INT) AS monyear,
        try_cast(nullif(regexp_extract(x, '\\b((?:19|20)\\d{{2}})\\b', 1), '') AS INT) AS year FROM t)
    SELECT id, CAST(coalesce(iso, today - CAST(n * CASE unit WHEN 'day' THEN 1 WHEN 'week' THEN 7 WHEN 'month' THEN 30 ELSE 365 END AS INT),
        CASE WHEN regexp_matches(x, '\\byesterday\\b') THEN today - 1 WHEN regexp_matches(x, '\\btomorrow\\b') THEN today + 1 END,
        make_date(monyear, mon, 15), make_date(year, 7, 2)) AS VARCHAR) AS day FROM g""")
def date_in_text(spark, sf_dir):
    rows = memories(spark, sf_dir, "id").selectExpr("id", f"{NOTE} AS note")
    return rows.select("id", facts.date_in(F.col("note"), F.lit("2024-02-01").cast("date")).cast("string").alias("day"))


@query(f"""WITH {M}, t AS (SELECT id, lower({NOTE.replace('STRING', 'VARCHAR')}) AS x, (1706745600 - created_s) / 86400 AS age,
        (1706745600 - read_s) / 86400 AS idle FROM m),
    g AS (SELECT *, list_transform(regexp_extract_all(x, '\\b(20\\d{{2}})\\b', 1), lambda y: CAST(y AS INT)) AS years, regexp_matches(x,
        '\\b(?:version |v)(\\d+)\\.(\\d+)') AS versioned,
        try_cast(nullif(regexp_extract(x, '\\b(?:version |v)(\\d+)\\.(\\d+)', 1), '') AS INT) AS a, try_cast(nullif(regexp_extract(x,
        '\\b(?:version |v)(\\d+)\\.(\\d+)', 2), '') AS INT) AS b FROM t)
    SELECT id, (len(years) > 0 OR versioned) AND (len(list_filter(years, lambda y: 2024 - y > 2)) > 0 OR coalesce(a <= 1 AND b <= 2, false)
        OR age > 180 AND NOT coalesce(idle < 30, false)) AS stale FROM g""")
def stale_heuristic(spark, sf_dir):
    rows = memories(spark, sf_dir, "id", "created_s", "read_s").selectExpr("id", f"{NOTE} AS note", "(1706745600 - created_s) / 86400 AS age", "(1706745600 - read_s) / 86400 AS idle")
    return rows.select("id", facts.likely_stale(F.col("note"), F.col("age"), F.col("idle"), 2024).alias("stale"))


GROUPED = f"""{M}, g AS (SELECT id, id // 3 AS grp, kind, status, id % 41 = 7 AS merged, id % 53 <> 5 AS mergeable, source AS owner, id % 37 = 1 AS private,
    id % 43 = 2 AS secrets, 0.6::DOUBLE + (id % 40) / 100::DOUBLE AS similarity FROM m)"""


def _listed(pairs) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in pairs) + "], lambda x: x IS NOT NULL)"


@query(f"""WITH {GROUPED}, a AS (SELECT grp, count(*) AS members, bool_or(NOT mergeable) AS fixed, count(DISTINCT kind) > 1 AS kinds, bool_or(merged) AS merged,
        min(similarity) < 0.7 AS apart,
    bool_or(coalesce(status <> 'active', false)) AS inactive, count(DISTINCT owner) > 1 AS owners, count(DISTINCT private) > 1 AS mixed,
        bool_or(secrets) AS secrets FROM g GROUP BY grp)
    SELECT grp, members, array_to_string({_listed([('fixed', 'immutability'), ('kinds', 'type_consistency'), ('merged', 'already_merged'), ('apart', 'min_similarity'), ('inactive', 'active_status')])}, ',') AS blockers,
        array_to_string({_listed([('owners', 'multi_user'), ('mixed', 'privacy'), ('secrets', 'secrets')])}, ',') AS warnings FROM a""")
def merge_safety(spark, sf_dir):
    rows = memories(spark, sf_dir, "id", "kind", "status", "source").selectExpr(
        "id", "id div 3 AS grp", "kind", "status", "id % 41 = 7 AS merged", "id % 53 <> 5 AS mergeable", "source AS owner", "id % 37 = 1 AS private", "id % 43 = 2 AS secrets",
        "CAST(0.6 AS DOUBLE) + (id % 40) / CAST(100 AS DOUBLE) AS similarity",
    )
    out = facts.safety(rows, "grp")
    return out.select("grp", "members", F.array_join("blockers", ",").alias("blockers"), F.array_join("warnings", ",").alias("warnings"))


@query(f"""WITH {M}, g AS (SELECT id, id % 20 AS grp, kind, content, created_s, importance FROM m),
    n AS (SELECT grp, kind, CASE WHEN kind = 'decision' THEN arg_max(content, (importance, created_s, id)) ELSE arg_max(content, (created_s,
        id)) END AS merged, count(*) AS sources
          FROM g WHERE kind IN ('preference', 'context', 'decision') GROUP BY grp, kind),
    o AS (SELECT grp, content, min(created_s) AS first, count(*) AS n FROM g WHERE kind = 'observation' GROUP BY grp, content)
    SELECT grp, kind, merged, sources FROM n UNION ALL SELECT grp, 'observation', string_agg(content, chr(10) ORDER BY first, content), sum(n)::BIGINT
        FROM o GROUP BY grp""")
def merge_strategies(spark, sf_dir):
    rows = memories(spark, sf_dir, "id", "kind", "content", "created_s", "importance")
    rows = rows.withColumn("grp", F.col("id") % 20)
    return facts.merged(rows, "grp").select("grp", "kind", "merged", "sources")


def _near(spark, sf_dir, least):
    """Cosine of the stated new vectors (every hundredth) and all others."""
    rows = table(spark, sf_dir, "embeddings")
    queries = [(r.vec_id, [float(x) for x in r.embedding]) for r in rows.filter("vec_id % 100 = 0").select("vec_id", "embedding").toLocalIterator()]
    return search.batch_at_least(rows, "vec_id", "embedding", queries, least)


NEAR = """p AS (SELECT a.vec_id AS new, b.vec_id AS old, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s, a.label % 2 AS scope,
        b.label % 2 AS old_scope
    FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)"""


@query(f"""WITH {NEAR}, r AS (SELECT *, row_number() OVER (PARTITION BY new ORDER BY floor(s * 1e6 + 0.5) DESC, old) AS r FROM p WHERE s >= 0.2),
    k AS (SELECT * FROM r WHERE r <= 5 AND scope = old_scope)
    SELECT new, string_agg(old, ',' ORDER BY r) AS partners, round(max(s), 6) AS best, CASE WHEN bool_or(old % 4 = 0) THEN 'link'
        ELSE 'merge' END AS outcome FROM k GROUP BY new""")
def write_dedup(spark, sf_dir):
    found = _near(spark, sf_dir, 0.2).select(F.col("query").alias("new"), F.col("key").alias("old"), (vectors.bucket(F.col("similarity")) / 1e6).alias("similarity"))
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("old"), (F.col("label") % 2).alias("scope"))
    new = labels.withColumnRenamed("old", "new").filter("new % 100 = 0")
    got = facts.write_dedup(new, found.join(labels, "old"), 5, 0.2)
    blocked = got.select("new", F.explode("partners").alias("old")).filter("old % 4 = 0").select("new").distinct()
    got = facts.write_dedup(new, found.join(labels, "old"), 5, 0.2, blocked)
    return got.select("new", F.array_join(F.transform("partners", lambda x: x.cast("string")), ",").alias("partners"), F.round("best", 6).alias("best"), "outcome")


@query("""WITH d AS (SELECT doc_id AS id, text FROM documents), e AS (SELECT min(id) OVER (PARTITION BY text) AS a, id AS b FROM d),
    x AS (SELECT a, b, 'exact' AS stage, 1::DOUBLE AS score FROM e WHERE a <> b),
    p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a,
        embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    r AS (SELECT least(a, b) AS a, greatest(a, b) AS b, 'ranked' AS stage, max(s) AS score FROM p WHERE s >= 0.4 GROUP BY 1, 2),
    u AS (SELECT * FROM x UNION ALL SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.a = r.a AND x.b = r.b))
    SELECT a, b, stage, round(score, 6) AS score, CASE WHEN score >= 0.9 THEN CASE WHEN (a % 5) = (b % 5) THEN 'high' ELSE 'medium' END
        WHEN score >= 0.8 THEN 'medium' ELSE 'low' END AS confidence FROM u""")
def detect_duplicates(spark, sf_dir):
    """Exact copies first, then pairs ranked by the cosine of their vectors (of the stated queries); a pair counts once."""
    exact = dedup.exact_pairs(table(spark, sf_dir, "documents"), "doc_id", "text").select(F.col("rep").alias("a"), F.col("member").alias("b"), F.lit("exact").alias("stage"), F.lit(1.0).alias("score"))
    ranked = _near(spark, sf_dir, 0.4).select(F.least("query", "key").alias("a"), F.greatest("query", "key").alias("b"), "similarity")
    ranked = ranked.groupBy("a", "b").agg(F.lit("ranked").alias("stage"), F.max("similarity").alias("score")).join(exact.select("a", "b"), ["a", "b"], "left_anti")
    out = exact.unionByName(ranked)
    return out.select("a", "b", "stage", F.round("score", 6).alias("score"), dedup.pair_confidence(F.col("score"), F.col("a") % 5 == F.col("b") % 5, F.lit(0.0)).alias("confidence"))
