"""Queries over routing, context and text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions import text
from spindrift.operators import context, routing
from spindrift.plans.registry import M, memories, query, table


def _case(column: str, rules, default: str) -> str:
    """The same ordered rules as SQL: patterns are data shared with the operator, the CASE is the oracle's own."""
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({column}), '{p}') THEN '{n}'" for n, p in rules) + f" ELSE '{default}' END"


PROMPT = """CASE turn % 6 WHEN 0 THEN 'What happened yesterday: ' WHEN 1 THEN 'When did it fail? ' WHEN 2 THEN 'Should we prefer this: '
        WHEN 3 THEN 'current hypothesis: ' WHEN 4 THEN 'npm install then test ' ELSE '' END || text"""


def _prompts(spark, sf_dir):
    return table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "role", f"{PROMPT} AS text")


@query(f"SELECT conv_id, turn, {_case(f'({PROMPT})', routing.QUESTIONS, 'global')} AS question FROM conversations")
def question_router(spark, sf_dir):
    return _prompts(spark, sf_dir).select("conv_id", "turn", routing.first_match(F.col("text"), routing.QUESTIONS, "global").alias("question"))


@query(f"SELECT conv_id, turn, {_case(f'({PROMPT})', routing.SIGNALS, 'durable')} AS signal FROM conversations")
def signal_classify(spark, sf_dir):
    return _prompts(spark, sf_dir).select("conv_id", "turn", routing.first_match(F.col("text"), routing.SIGNALS, "durable").alias("signal"))


def _intents() -> str:
    """s0 .. s5, the score of each intent, in SQL."""
    out = []
    for i, (patterns, base, step, cap) in enumerate(routing.INTENTS.values()):
        hits = " + ".join("CAST(regexp_matches(lower(trim(q)), '" + p.replace("'", "''") + "') AS INT)" for p in patterns)
        out.append(f"CASE WHEN {hits} > 0 THEN least({base}::DOUBLE + {step}::DOUBLE * ({hits}), {cap}::DOUBLE) ELSE 0::DOUBLE END AS s{i}")
    named = f"len(regexp_extract_all(q, '{routing.CAPITALS}', 1))"
    return ", ".join(out) + f", CASE WHEN {named} >= 2 THEN least(0.45::DOUBLE + 0.1::DOUBLE * {named}, 0.9::DOUBLE) ELSE 0::DOUBLE END AS s5"


#: Questions of several intents, beside the turns' own texts.
QUERY = """CASE (conv_id + turn) % 9 WHEN 0 THEN 'When did the build fail last week, before 2024-01-05?' WHEN 1 THEN 'What depends on it and who owns the link between them'
    WHEN 2 THEN 'What is the right approach, should we prefer a guide' WHEN 3 THEN 'explain what does it mean' WHEN 4 THEN 'show me similar ones, what else'
    WHEN 5 THEN 'Ask Red Fox and Blue Whale about Green Tea' WHEN 6 THEN '' WHEN 7 THEN 'tell me about March 2021' ELSE text END"""
_NAMES = ", ".join(f"'{n}'" for n in (*routing.INTENTS, "entity_heavy"))


@query(f"""WITH p AS (SELECT conv_id, turn, {QUERY} AS q FROM conversations), s AS (SELECT conv_id, turn, {_intents()} FROM p),
    b AS (SELECT *, greatest(s0, s1, s2, s3, s4, s5) AS best FROM s)
    SELECT conv_id, turn, CASE WHEN best = 0 THEN 'default' ELSE [{_NAMES}][list_position([s0, s1, s2, s3, s4, s5], best)] END AS intent,
        round(CASE WHEN best = 0 THEN 0.3 ELSE best END, 6) AS score FROM b""")
def classify_query(spark, sf_dir):
    got = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{QUERY} AS q").withColumn("x", routing.classify(F.col("q")))
    return got.select("conv_id", "turn", "x.intent", F.round("x.score", 6).alias("score"))


@query(f"""WITH {M} SELECT id, CASE WHEN kind IN ('insight', 'reflection', 'learning') THEN 'reflective' WHEN regexp_matches(lower(content),
        '{routing.PROCEDURAL}') OR len(list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x,
        '^\\s*[0-9]+[.)]\\s+\\w+'))) >= 2 THEN 'procedural' WHEN kind IN ('fact', 'decision', 'preference', 'note') THEN 'semantic'
        ELSE 'episodic' END AS sector FROM m""")
def sector_route(spark, sf_dir):
    return memories(spark, sf_dir, "id", "kind", "content").select("id", routing.sector(F.col("kind"), F.col("content")).alias("sector"))


@query(f"""WITH {M}, w AS (SELECT id, content, length(content) AS n, regexp_split_to_array(lower(content), '[ \\t\\n\\r\\f\\x0B]+') AS ws,
        len(list_filter(regexp_split_to_array(content, '[.!?]+'), lambda s: trim(s) <> '')) AS sentences FROM m)
    SELECT id, length(trim(content)) BETWEEN 5 AND 50000 AS ok, least(100, greatest(0, 100 - CASE WHEN n < 20 THEN 30 WHEN n < 50 THEN 15 ELSE 0 END -
        CASE WHEN len(list_distinct(list_filter(ws, lambda w: length(w) > 3))) / greatest(1, len(ws))::DOUBLE < 0.3 THEN 20 ELSE 0 END
        + CASE WHEN sentences > 1 THEN 10 ELSE 0 END + CASE WHEN n BETWEEN 50 AND 2000 THEN 5 ELSE 0 END)) AS quality FROM w""")
def write_gate(spark, sf_dir):
    return memories(spark, sf_dir, "id", "content").select("id", routing.writable(F.col("content")).alias("ok"), routing.quality(F.col("content")).alias("quality"))


RULES = [("work", "project", 90, "fact", "en"), ("notes", "project", 60, None, "src3"), ("archive", "area", 40, "context", None)]


@query(f"""WITH {M}, r AS (SELECT * FROM (VALUES ('work', 'project', 90, 'fact', 'en'), ('notes', 'project', 60, NULL, 'src3'), ('archive', 'area', 40,
        'context', NULL)) t(place, type, priority, kind, tag)),
    h AS (SELECT m.id, r.*, row_number() OVER (PARTITION BY m.id, r.type ORDER BY r.priority DESC, r.place) AS n FROM m LEFT JOIN r ON (r.kind IS NULL
        OR r.kind = m.kind) AND (r.tag IS NULL OR r.tag = m.lang OR r.tag = m.source))
    SELECT id, coalesce(place, 'inbox') AS place, coalesce(least(1, priority / 100::DOUBLE), 0.5) AS weight FROM h WHERE n = 1""")
def place_rules(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "place string, type string, priority int, kind string, tag string")
    return routing.place_by_rules(memories(spark, sf_dir, "id", "kind", "lang", "source").withColumn("tags", F.array("lang", "source")), rules, "id")


TAGS = "['  Big  ' || source, '--' || lang || '--x', 'misc', upper(source) || '  ' || lang, source]"


@query(f"""WITH {M}, t AS (SELECT id, unnest({TAGS}) AS t FROM m), n AS (SELECT DISTINCT id,
        regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(lower(t)), '\\s+', '-', 'g'), '^-+', ''), '-+$', ''), '-{{2,}}', '-',
        'g') AS t FROM t)
    SELECT id, string_agg(t, ',' ORDER BY t) AS tags FROM n WHERE length(t) >= 2 AND t NOT IN ('misc', 'other', 'none') GROUP BY id""")
def tag_normalize(spark, sf_dir):
    rows = memories(spark, sf_dir, "id", "lang", "source")
    tags = F.array(F.concat(F.lit("  Big  "), "source"), F.concat(F.lit("--"), "lang", F.lit("--x")), F.lit("misc"), F.concat(F.upper("source"), F.lit("  "), "lang"), F.col("source"))
    return rows.select("id", F.array_join(text.normalize_tags(tags), ",").alias("tags"))


@query(f"""WITH {M} SELECT id, regexp_replace('a <private>' || lang || '</private> b ' || source, '(?s)<private>.*?</private>', '', 'g') AS clean,
        ceil(length(content) / 4.0)::BIGINT AS prose, ceil(length(content) / 3.0)::BIGINT AS wire FROM m""")
def privacy_and_tokens(spark, sf_dir):
    rows = memories(spark, sf_dir, "id", "content", "lang", "source")
    secret = F.concat(F.lit("a <private>"), "lang", F.lit("</private> b "), "source")
    return rows.select("id", text.strip_private(secret).alias("clean"), text.tokens(F.col("content")).alias("prose"), text.tokens(F.col("content"), 3).alias("wire"))


HEADS = "array_to_string(list_transform(string_split(content, chr(10)), lambda x: substring(x, 1, {})), chr(10))"


@query(f"""WITH {M} SELECT id, md5(CASE WHEN length(content) <= 100 THEN content WHEN length(content) <= 500 THEN substring({HEADS.format(80)}, 1, 300)
        WHEN length(content) <= 2000 THEN substring({HEADS.format(60)}, 1, 300) ELSE substring({HEADS.format(40)}, 1, 150) END) AS compressed,
    md5(CASE WHEN ceil(length(content) / 4.0) <= 50 THEN content ELSE substring(content, 1, 197) || '...' END) AS truncated FROM m""")
def compression_tiers(spark, sf_dir):
    rows = memories(spark, sf_dir, "id", "content")
    return rows.select("id", F.md5(context.compress(F.col("content")).cast("binary")).alias("compressed"), F.md5(text.truncate(F.col("content"), 50).cast("binary")).alias("truncated"))


@query("""WITH c AS (SELECT *, CASE role WHEN 'system' THEN 'setup' WHEN 'user' THEN 'request' ELSE 'answer' END AS chunk FROM conversations), n AS (SELECT *,
        row_number() OVER (PARTITION BY conv_id, chunk ORDER BY turn) AS nth FROM c)
    SELECT conv_id, turn, chunk, nth, md5(substring(text, 1, 500)) AS head FROM n WHERE nth <= CASE chunk WHEN 'setup' THEN 1 WHEN 'request' THEN 2
        ELSE 3 END""")
def chunk_caps(spark, sf_dir):
    kind = F.when(F.col("role") == "system", "setup").when(F.col("role") == "user", "request").otherwise("answer")
    got = context.chunks(table(spark, sf_dir, "conversations"), "conv_id", kind, ["turn"], {"setup": 1, "request": 2, "answer": 3}, "text")
    return got.select("conv_id", "turn", "chunk", "nth", F.md5(F.col("head").cast("binary")).alias("head"))


@query("""SELECT conv_id, turn, md5(string_agg(substring(text, 1, 60), ' | ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING
        AND CURRENT ROW)) AS summary FROM conversations""")
def rolling_summary(spark, sf_dir):
    got = context.rolling(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 3)
    return got.select("conv_id", "turn", F.md5(F.col("summary").cast("binary")).alias("summary"))


@query("""WITH n AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS chunk FROM conversations) SELECT conv_id, chunk,
        md5(string_agg(substring(text, 1, 60), ' | ' ORDER BY turn)) AS summary FROM n GROUP BY 1, 2""")
def incremental_summary(spark, sf_dir):
    got = context.fixed_chunks(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 3)
    return got.select("conv_id", "chunk", F.md5(F.col("summary").cast("binary")).alias("summary"))


@query("""WITH p AS (SELECT a.doc_id, string_split(a.text, chr(10)) AS x, string_split(b.text, chr(10)) AS y FROM documents a
        JOIN documents b ON b.doc_id = a.doc_id + 1)
    SELECT doc_id, len(list_filter(y, lambda l: NOT list_contains(x, l))) AS added, len(list_filter(x, lambda l: NOT list_contains(y, l))) AS removed FROM p""")
def snapshot_line_diff(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    added, removed = context.line_difference(F.col("text"), F.col("after"))
    both = d.join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("after")), "doc_id")
    return both.select("doc_id", F.size(added).cast("long").alias("added"), F.size(removed).cast("long").alias("removed"))


@query(f"""WITH {M}, s AS (SELECT id, kind, ceil(length(content) / 4.0) AS n FROM m), u AS (SELECT *, sum(n) OVER (PARTITION BY kind
        ORDER BY id ROWS UNBOUNDED PRECEDING) AS used FROM s)
    SELECT id, kind, used::BIGINT AS used FROM u WHERE used <= 20000 * CASE kind WHEN 'fact' THEN 0.3 WHEN 'preference' THEN 0.25
        WHEN 'decision' THEN 0.2 WHEN 'observation' THEN 0.15 ELSE 0.1 END""")
def section_budgets(spark, sf_dir):
    rows = memories(spark, sf_dir, "id", "kind", "content").select("id", "kind", text.tokens(F.col("content")).alias("n"))
    got = context.section_windows(rows, "kind", "n", [F.asc("id")], {"fact": 0.3, "preference": 0.25, "decision": 0.2, "observation": 0.15, "context": 0.1}, 20000)
    return got.select("id", "kind", "used")


@query(f"""WITH RECURSIVE {M}, o AS (SELECT source, id, pinned, CAST(ceil(length(content) / 4.0) AS BIGINT) AS n, row_number() OVER (PARTITION BY source
        ORDER BY NOT pinned, importance DESC, id) AS r FROM m),
    f AS (SELECT source, id, r, CASE WHEN pinned OR n <= 2000 THEN n ELSE 0 END AS used, pinned OR n <= 2000 AS taken FROM o WHERE r = 1
        UNION ALL SELECT o.source, o.id, o.r, f.used + CASE WHEN o.pinned OR f.used + o.n <= 2000 THEN o.n ELSE 0 END, o.pinned
        OR f.used + o.n <= 2000 FROM f JOIN o ON o.source = f.source AND o.r = f.r + 1)
    SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY r) AS place FROM f WHERE taken""")
def context_budget(spark, sf_dir):
    """Skip-and-continue, row by row in the SQL."""
    rows = memories(spark, sf_dir, "id", "source", "content", "importance", "pinned").withColumn("n", text.tokens(F.col("content")))
    return context.fit_budget(rows, "source", "id", "n", "importance", "pinned", 2000)


@query(f"""WITH {M}, s AS (SELECT id, id % 40 AS query, content, semantic, ceil(length(content) / 3.0) AS n FROM m), k AS (SELECT *,
        coalesce(sum(n) OVER (PARTITION BY query ORDER BY semantic DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM s
        WHERE semantic >= 0.5),
    t AS (SELECT query, sum(CASE WHEN semantic >= 0.5 THEN n END) AS total FROM s GROUP BY query)
    SELECT t.query, coalesce(k.id, -1) AS id, CASE WHEN total IS NULL THEN 'none' WHEN total > 1500 THEN 'partial' ELSE 'ok' END AS status,
        md5(coalesce(CASE WHEN n > 1500 - used THEN regexp_replace(substring(content, 1, CAST((1500 - used) * 3 AS INT)), '\\s+\\S*$', '')
        ELSE content END, '')) AS body
    FROM t LEFT JOIN k ON t.query = k.query AND used < 1500""")
def response_pack(spark, sf_dir):
    rows = memories(spark, sf_dir, "id", "content", "semantic").withColumn("query", F.col("id") % 40)
    got = context.pack_response(rows, "query", "id", "content", "semantic", 0.5, 1500)
    return got.select("query", F.coalesce("id", F.lit(-1)).alias("id"), "status", F.md5(F.coalesce("content", F.lit("")).cast("binary")).alias("body"))


_STRATEGY = "CASE intent " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in routing.STRATEGIES.items()) + " END"
#: Known names: the first word of every document, and a few of two words.
KNOWN = "SELECT regexp_extract(coalesce(text, ''), '([A-Z][a-z]{3,})', 1) AS name FROM documents UNION ALL SELECT n FROM (VALUES ('Red Fox'), ('blue whale'), ('March 2021'), ('GUIDE')) v(n)"


@query(f"""WITH p AS (SELECT conv_id * 100 + turn AS query, {QUERY} AS q FROM conversations), s AS (SELECT query, q, {_intents()} FROM p),
    b AS (SELECT *, greatest(s0, s1, s2, s3, s4, s5) AS best FROM s),
    c AS (SELECT query, q, CASE WHEN best = 0 THEN 'default' ELSE [{_NAMES}][list_position([s0, s1, s2, s3, s4, s5], best)] END AS intent, CASE WHEN best = 0 THEN 0.3 ELSE best END AS score FROM b),
    k AS (SELECT DISTINCT name FROM ({KNOWN}) WHERE name <> ''), h AS (SELECT query, list(DISTINCT name ORDER BY name) AS names FROM p JOIN k ON contains(lower(q), lower(name)) GROUP BY query),
    r AS (SELECT query, coalesce(len(names), 0) >= 2 AND intent <> 'entity_heavy' AS other, intent AS own, score AS own_score, names FROM c LEFT JOIN h USING (query)),
    o AS (SELECT query, CASE WHEN other THEN 'entity_heavy' ELSE own END AS intent, CASE WHEN other THEN least(0.5::DOUBLE + 0.1::DOUBLE * len(names), 0.9::DOUBLE) ELSE own_score END AS score,
        CASE WHEN other THEN array_to_string(names, ',') ELSE '' END AS entities FROM r)
    SELECT query, intent, round(score, 6) AS score, {_STRATEGY} AS strategy, CASE WHEN {_STRATEGY} = 'hybrid_search' THEN 'contextual' ELSE 'hybrid_search' END AS fallback, entities FROM o""")
def auto_route(spark, sf_dir):
    """Every turn's route: its intent, unless it names known entities, and how it is searched for."""
    queries = table(spark, sf_dir, "conversations").selectExpr("conv_id * 100 + turn AS query", f"{QUERY} AS content")
    names = table(spark, sf_dir, "documents").selectExpr("regexp_extract(coalesce(text, ''), '([A-Z][a-z]{3,})', 1) AS name")
    names = names.unionByName(spark.createDataFrame([(n,) for n in ("Red Fox", "blue whale", "March 2021", "GUIDE")], "name string"))
    got = routing.routed(queries, names)
    return got.select("query", "intent", F.round("score", 6).alias("score"), "strategy", "fallback", F.array_join("entities", ",").alias("entities"))
