"""Queries over predicates, temporal operators, decay, importance, tiers, aggregates and metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spindrift.functions import predicates as P
from spindrift.functions import scoring
from spindrift.operators import metrics, temporal
from spindrift.plans.registry import AS_OF, M, memories, query, table

LIVE = "(status IS NULL OR status NOT IN ('expired', 'archived'))"


@query(f"WITH {M} SELECT id, kind FROM m WHERE {LIVE} AND coalesce(active, true) AND NOT encrypted AND (valid_to_s IS NULL OR valid_to_s > {AS_OF})")
def live_filter(spark, sf_dir):
    rows = memories(spark, sf_dir, "id", "kind", "status", "active", "encrypted", "valid_to_s")
    keep = P.both(P.live(F.col("status")), P.flag(F.col("active"), True), ~F.col("encrypted"), P.not_after(F.col("valid_to_s"), AS_OF))
    return rows.filter(keep).select("id", "kind")


@query(f"""WITH {M} SELECT 'vector' AS leg, count(*) AS n FROM m WHERE {LIVE} AND NOT encrypted UNION ALL
    SELECT 'keyword', count(*) FROM m WHERE {LIVE} AND (valid_from_s IS NULL OR valid_from_s <= {AS_OF}) AND (valid_to_s IS NULL OR valid_to_s > {AS_OF})""")
def leg_asymmetry(spark, sf_dir):
    """The vector leg checks encryption but no validity, the keyword leg validity but no encryption."""
    rows = memories(spark, sf_dir, "status", "encrypted", "valid_from_s", "valid_to_s").filter(P.live(F.col("status")))
    valid = P.not_before(F.col("valid_from_s"), AS_OF) & P.not_after(F.col("valid_to_s"), AS_OF)
    legs = F.array(F.struct(F.lit("vector").alias("leg"), (~F.col("encrypted")).alias("ok")), F.struct(F.lit("keyword").alias("leg"), valid.alias("ok")))
    return rows.select(F.inline(legs)).groupBy("leg").agg(F.sum(F.col("ok").cast("long")).alias("n"))


@query(f"""WITH {M} SELECT id, project, team FROM m WHERE (project IS NULL OR project = 'src3') AND (team IS NULL OR team = 1) AND kind IN ('fact', 'decision')
        AND len(list_intersect([lang, source], ['en', 'src3'])) > 0""")
def scope_filter(spark, sf_dir):
    rows = memories(spark, sf_dir, "id", "project", "team", "kind", "lang", "source")
    tags = F.arrays_overlap(F.array("lang", "source"), F.array(F.lit("en"), F.lit("src3")))
    return rows.filter(P.both(P.in_scope(F.col("project"), "src3"), P.in_scope(F.col("team"), 1), F.col("kind").isin("fact", "decision"), tags)).select("id", "project", "team")


@query(f"""WITH {M} SELECT id FROM m WHERE coalesce(valid_from_s, created_s) <= {AS_OF} AND (valid_to_s IS NULL OR valid_to_s > {AS_OF})
        AND (superseded_s IS NULL OR superseded_s > {AS_OF})""")
def asof_valid(spark, sf_dir):
    rows = memories(spark, sf_dir, "id", "valid_from_s", "created_s", "valid_to_s", "superseded_s")
    return rows.filter(P.valid_at(*(F.col(c) for c in ("valid_from_s", "created_s", "valid_to_s", "superseded_s")), AS_OF)).select("id")


@query(f"""WITH {M} SELECT id FROM m WHERE (valid_from_s IS NULL OR valid_to_s IS NULL OR valid_from_s < valid_to_s)
    AND (valid_from_s IS NULL OR valid_from_s < {AS_OF} - 86400 * 30) AND (valid_to_s IS NULL OR valid_to_s > {AS_OF} - 86400 * 60)""")
def interval_overlap(spark, sf_dir):
    rows = memories(spark, sf_dir, "id", "valid_from_s", "valid_to_s")
    return rows.filter(P.overlaps(F.col("valid_from_s"), F.col("valid_to_s"), AS_OF - 86400 * 60, AS_OF - 86400 * 30)).select("id")


@query(f"""WITH {M} SELECT a.id, coalesce(a.superseded_by, a.merged_into, -1) AS successor, coalesce(s.created_s, -1) AS ended_s FROM m a LEFT
        JOIN m s ON s.id = coalesce(a.superseded_by, a.merged_into)""")
def successor_invalidation(spark, sf_dir):
    return temporal.effective_end(memories(spark, sf_dir, "id", "created_s", "superseded_by", "merged_into")).select("id", F.coalesce("successor", F.lit(-1)).alias("successor"), F.coalesce("ended_s", F.lit(-1)).alias("ended_s"))


@query(f"WITH {M} SELECT id FROM m WHERE id NOT IN (SELECT a.id FROM m a JOIN m b ON a.superseded_by = b.id)")
def supersession_antijoin(spark, sf_dir):
    rows = memories(spark, sf_dir, "id", "superseded_by")
    edges = rows.filter("superseded_by IS NOT NULL").select(F.col("id").alias("old"), F.col("superseded_by").alias("new"))
    return temporal.without_superseded(rows.select("id"), edges)


@query(f"""WITH {M}, r AS (SELECT *, (owner = 3 OR team = 1 OR (id % 5 = 0 AND id % 3 = 2) OR (id % 14 = 0)) AND NOT (id % 21 = 1) AS ok FROM m) SELECT id, owner
        FROM r WHERE ok""")
def acl_semijoin(spark, sf_dir):
    rows = memories(spark, sf_dir, "id", "owner", "team")
    shares = rows.filter("id % 5 = 0").select("id", F.when(F.col("id") % 3 == 2, 1).otherwise(2).alias("team"))
    rules = rows.filter("id % 14 = 0 OR id % 21 = 1").select("id", F.lit(3).alias("subject"), F.when(F.col("id") % 21 == 1, "none").otherwise("read").alias("permission"))
    return temporal.readable(rows, 3, 1, shares, rules).select("id", "owner")


@query(f"""WITH {M} SELECT id, CASE WHEN id % 4 = 0 THEN CASE WHEN id % 6 = 0 THEN 'none' ELSE 'read' END WHEN id % 6 = 0 THEN 'none'
        ELSE 'private' END AS permission FROM m""")
def acl_first_rule(spark, sf_dir):
    rows = memories(spark, sf_dir, "id")
    rules = rows.filter("id % 4 = 0").select("id", F.lit(2).alias("priority"), F.lit("read").alias("permission")).unionByName(rows.filter("id % 6 = 0").select("id", F.lit(1).alias("priority"), F.lit("none").alias("permission")))
    return temporal.first_rule(rows, rules)


@query(f"""WITH {M} SELECT id FROM m b WHERE id % 2 = 0 AND (superseded_by IS NULL OR EXISTS (SELECT 1 FROM m s WHERE s.id = b.superseded_by
        AND s.status = 'active' AND (s.valid_to_s IS NULL OR s.valid_to_s > {AS_OF})))""")
def belief_source_alive(spark, sf_dir):
    """Beliefs without a source, or with one that is active and valid: two branches, no OR join."""
    rows = memories(spark, sf_dir, "id", "superseded_by", "status", "valid_to_s")
    beliefs = rows.filter("id % 2 = 0")
    alive = rows.filter((F.col("status") == "active") & P.not_after(F.col("valid_to_s"), AS_OF)).select(F.col("id").alias("superseded_by"))
    return beliefs.filter("superseded_by IS NULL").select("id").unionByName(beliefs.join(alive, "superseded_by", "left_semi").select("id"))


EDGE = """e AS (SELECT o_custkey AS a, o_orderkey AS b, o_orderdate AS valid_from, o_orderdate + INTERVAL 90 DAY AS valid_to,
        o_orderdate + INTERVAL 5 DAY AS recorded_from FROM orders)"""


@query(f"""WITH {EDGE} SELECT a, count(*) AS n, min(b) AS first FROM e WHERE valid_from <= TIMESTAMP '1996-06-01' AND valid_to > TIMESTAMP '1996-06-01'
        AND recorded_from <= TIMESTAMP '1996-06-03' GROUP BY a""")
def bitemporal_asof(spark, sf_dir):
    e = table(spark, sf_dir, "orders").selectExpr("o_custkey AS a", "o_orderkey AS b", "CAST(o_orderdate AS TIMESTAMP) AS valid_from", "CAST(o_orderdate AS TIMESTAMP) + INTERVAL 90 DAY AS valid_to", "CAST(o_orderdate AS TIMESTAMP) + INTERVAL 5 DAY AS recorded_from")
    keep = P.known_at(F.col("valid_from"), F.col("valid_to"), F.col("recorded_from"), F.lit(None).cast("timestamp"), F.lit("1996-06-01").cast("timestamp"), F.lit("1996-06-03").cast("timestamp"))
    return e.filter(keep).groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("first"))


@query("""SELECT user_id, event_id, row_number() OVER w AS version, coalesce(epoch(date_trunc('second', lead(ts) OVER w))::BIGINT, -1) AS recorded_to_s
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def edge_versions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.struct(F.col("ts").cast("timestamp").alias("t"), "event_id").alias("at"))
    v = temporal.versions(e, ["user_id"], "at")
    return v.select("user_id", "event_id", F.col("version").cast("long").alias("version"), F.coalesce(F.unix_seconds("recorded_to.t"), F.lit(-1)).alias("recorded_to_s"))


@query("""
    WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_id % 10 = 0), q AS (SELECT user_id, ts, event_id AS seen FROM events
        WHERE event_id % 10 <> 0)
    SELECT p.event_id, p.user_id, coalesce((SELECT arg_max(seen, ts) FROM q WHERE q.user_id = p.user_id AND q.ts <= p.ts), -1) AS seen FROM p""")
def latest_before(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    out = temporal.as_of_each(e.filter("event_id % 10 = 0"), e.filter("event_id % 10 <> 0").select("user_id", F.col("ts").alias("since"), F.col("event_id").alias("seen")), "user_id", "ts", "since", "seen")
    return out.select("event_id", "user_id", F.coalesce("seen", F.lit(-1)).alias("seen"))


@query("""
    WITH i AS (SELECT o_orderkey AS id, o_custkey AS subject, epoch(o_orderdate)::BIGINT AS s,
        epoch(o_orderdate)::BIGINT + 86400 * (20 + o_orderkey % 30) AS e FROM orders)
    SELECT a.subject, a.id AS a, b.id AS b FROM i a JOIN i b ON a.subject = b.subject AND (a.s < b.s OR a.s = b.s AND a.id < b.id) AND a.e > b.s""")
def fact_conflicts(spark, sf_dir):
    i = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_custkey AS subject", "unix_seconds(CAST(o_orderdate AS TIMESTAMP)) AS s").withColumn("e", F.col("s") + 86400 * (20 + F.col("id") % 30))
    return temporal.interval_conflicts(i, "id", "subject", "s", "e")


AGE = "greatest(0::DOUBLE, CAST(1706745600 - created_s AS DOUBLE) / 86400)"
BETA = """CASE kind WHEN 'observation' THEN 0.1::DOUBLE WHEN 'context' THEN 0.05::DOUBLE WHEN 'fact' THEN 0.02::DOUBLE WHEN 'decision' THEN 0.02::DOUBLE
        WHEN 'preference' THEN 0.01::DOUBLE ELSE 0.05::DOUBLE END"""


def _age():
    return F.greatest(F.lit(0.0), (AS_OF - F.col("created_s")) / 86400)


@query(f"WITH {M} SELECT id, round(pow(1 + {AGE}, -({BETA})), 6) AS retention FROM m")
def decay_retention(spark, sf_dir):
    return memories(spark, sf_dir, "id", "kind", "created_s").select("id", F.round(scoring.retention(_age(), F.col("kind")), 6).alias("retention"))


@query(f"""WITH {M}, b AS (SELECT *, CASE WHEN importance = 0 THEN 100::DOUBLE ELSE importance::DOUBLE END AS base, CASE tier WHEN 'long-term' THEN 0.5::DOUBLE
        WHEN 'fleeting' THEN 2::DOUBLE ELSE 1::DOUBLE END AS mul FROM m)
    SELECT id, round(CASE WHEN tier = 'sturdy' THEN base ELSE least(100, greatest(0, base * pow(1 + {AGE} * least(mul, 1), -({BETA})) / greatest(mul,
        1))) END, 6) AS score FROM b""")
def tiered_decay(spark, sf_dir):
    rows = memories(spark, sf_dir, "id", "kind", "created_s", "importance", "tier")
    return rows.select("id", F.round(scoring.tiered_decay(F.col("importance"), _age(), F.col("kind"), F.col("tier")), 6).alias("score"))


@query(f"""WITH {M}, h AS (SELECT id, pow(0.5::DOUBLE, {AGE} / CASE kind WHEN 'fact' THEN 30 WHEN 'decision' THEN 60 ELSE 45 END) AS s, accesses, {AGE} AS age
        FROM m) SELECT id, round(s, 6) AS strength, s < 0.1 AND accesses = 0 AND age > 90 AS deprecated FROM h""")
def knowledge_half_life(spark, sf_dir):
    rows = memories(spark, sf_dir, "id", "kind", "created_s", "accesses")
    s = scoring.half_life(F.lit(1.0), _age(), F.when(F.col("kind") == "fact", 30).when(F.col("kind") == "decision", 60).otherwise(45))
    return rows.select("id", F.round(s, 6).alias("strength"), ((s < 0.1) & (F.col("accesses") == 0) & (_age() > 90)).alias("deprecated"))


@query(f"""WITH {M} SELECT id, round(least(100, greatest(0, 50 + 30 * pow(0.5::DOUBLE, {AGE} / 30) + least(15::DOUBLE, 15 * log10(accesses + 1))
    + CASE kind WHEN 'decision' THEN 15 WHEN 'fact' THEN 10 WHEN 'preference' THEN 8 WHEN 'context' THEN 5 ELSE 0 END + CASE WHEN pinned THEN 20
        ELSE 0 END)), 6) AS importance FROM m""")
def importance_v1(spark, sf_dir):
    rows = memories(spark, sf_dir, "id", "kind", "created_s", "accesses", "pinned")
    return rows.select("id", F.round(scoring.importance(_age(), F.col("accesses"), F.col("kind"), F.when(F.col("pinned"), 20).otherwise(0)), 6).alias("importance"))


@query(f"""WITH {M} SELECT id, round(0.5 * importance / 100::DOUBLE + 0.3 * least(1::DOUBLE, (id % 5)::DOUBLE / 3) + 0.2 * (0.5 * CAST(contains(lower(content),
        'tion') AS INT) + 0.3 * CAST(contains(lower(content), 'eres') AS INT)), 6) AS importance FROM m""")
def importance_v2(spark, sf_dir):
    rows = memories(spark, sf_dir, "id", "content", "importance")
    low = F.lower("content")
    return rows.select("id", F.round(scoring.blended_importance(F.col("importance") / 100, F.col("id") % 5, low.contains("tion"), low.contains("eres")), 6).alias("importance"))


TIER = f"""CASE WHEN pinned OR (accesses >= 5 AND coalesce((1706745600 - read_s)::DOUBLE / 86400 <= 30, false)) THEN 'sturdy'
    WHEN importance < 30 AND {AGE} > 30 AND NOT coalesce((1706745600 - read_s)::DOUBLE / 86400 <= 30, false) THEN 'fleeting'
    WHEN {AGE} > 90 AND coalesce((1706745600 - read_s)::DOUBLE / 86400 <= 30, false) AND importance >= 70 THEN 'long-term' ELSE 'working' END"""


def _tiers(spark, sf_dir):
    rows = memories(spark, sf_dir, "id", "pinned", "importance", "accesses", "created_s", "read_s")
    return rows.withColumn("class", scoring.tier(F.col("pinned"), F.col("importance"), F.col("accesses"), _age(), (AS_OF - F.col("read_s")) / 86400))


@query(f"WITH {M} SELECT id, {TIER} AS class FROM m")
def tier_classify(spark, sf_dir):
    return _tiers(spark, sf_dir).select("id", "class")


@query(f"WITH {M} SELECT {TIER} AS class, count(*) AS n, round(avg(importance), 6) AS mean, max(accesses) AS most FROM m GROUP BY 1")
def tier_stats(spark, sf_dir):
    return _tiers(spark, sf_dir).groupBy("class").agg(F.count("*").alias("n"), F.round(F.avg("importance"), 6).alias("mean"), F.max("accesses").alias("most"))


@query(f"WITH {M} SELECT id FROM m WHERE {AGE} > 30 AND level IN ('outdated', 'speculative') AND importance <= 40 AND NOT pinned")
def auto_clean(spark, sf_dir):
    rows = memories(spark, sf_dir, "id", "created_s", "level", "importance", "pinned")
    return rows.filter((_age() > 30) & F.col("level").isin("outdated", "speculative") & (F.col("importance") <= 40) & ~F.col("pinned")).select("id")


@query("""SELECT user_id, list_reduce(list_prepend(50::DOUBLE, list(d ORDER BY ts, event_id)), lambda s, d: greatest(0::DOUBLE, least(100::DOUBLE,
        s + d))) AS value, count(*) AS events
    FROM (SELECT *, CASE event_id % 3 WHEN 0 THEN 5::DOUBLE WHEN 1 THEN 1::DOUBLE ELSE -10::DOUBLE END AS d FROM events) GROUP BY user_id""")
def feedback_fold(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.when(F.col("event_id") % 3 == 0, 5.0).when(F.col("event_id") % 3 == 1, 1.0).otherwise(-10.0).alias("d"))
    return temporal.fold_clamped(e, "user_id", ["ts", "event_id"], "d", 50, 0, 100)


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, event_id % 7 = 0 AS no, row_number() OVER (PARTITION BY user_id ORDER BY ts, CASE
        WHEN event_id % 7 = 0 THEN 0 ELSE 1 END) AS r FROM events),
    f AS (SELECT user_id, 0::BIGINT AS r, 0.5::DOUBLE AS confidence, 0::DOUBLE AS gained, 0 AS n, 0::DOUBLE AS stability, NULL::DOUBLE AS last FROM e
        WHERE r = 1
        UNION ALL SELECT e.user_id, e.r, CASE WHEN no THEN greatest(0::DOUBLE, confidence - 0.3) WHEN last IS NULL
        OR t - last >= 3600 THEN least(1::DOUBLE, confidence + least(0.1 * pow(0.85::DOUBLE, n), 0.15 - gained)) ELSE confidence END,
            CASE WHEN NOT no AND (last IS NULL OR t - last >= 3600) THEN gained + least(0.1 * pow(0.85::DOUBLE, n), 0.15 - gained) ELSE gained END,
            CASE WHEN NOT no AND (last IS NULL OR t - last >= 3600) THEN n + 1 ELSE n END,
            CASE WHEN NOT no AND (last IS NULL OR t - last >= 3600) THEN least(1::DOUBLE, stability + 0.05) ELSE stability END, CASE WHEN NOT no
            AND (last IS NULL OR t - last >= 3600) THEN t ELSE last END
        FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1)
    SELECT user_id, round(arg_max(confidence, r), 6) AS confidence, round(arg_max(stability, r), 6) AS stability FROM f GROUP BY user_id""")
def reinforcement_fold(spark, sf_dir):
    """Cooldowns make this a stateful fold, row by row in the SQL."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", F.when(F.col("event_id") % 7 == 0, "contradict").otherwise("support").alias("what"))
    return temporal.reinforce(e, "user_id", "ts", "what").select("user_id", F.round("confidence", 6).alias("confidence"), F.round("stability", 6).alias("stability"))


@query(f"""WITH {M} SELECT coalesce(kind, 'all') AS kind, coalesce(lang, 'all') AS lang, count(*) AS n, min(created_s) AS oldest, max(created_s) AS newest,
        sum(CAST(pinned AS INT)) AS pinned FROM m GROUP BY GROUPING SETS ((kind, lang), (kind), ())""")
def memory_stats(spark, sf_dir):
    rows = memories(spark, sf_dir, "kind", "lang", "created_s", "pinned")
    sets = rows.groupingSets([[F.col("kind"), F.col("lang")], [F.col("kind")], []], F.col("kind"), F.col("lang"))
    out = sets.agg(F.count("*").alias("n"), F.min("created_s").alias("oldest"), F.max("created_s").alias("newest"), F.sum(F.col("pinned").cast("int")).alias("pinned"))
    return out.select(F.coalesce("kind", F.lit("all")).alias("kind"), F.coalesce("lang", F.lit("all")).alias("lang"), "n", "oldest", "newest", "pinned")


@query("""WITH t AS (SELECT user_id, count(*) AS retrievals, sum(CASE WHEN event_id % 3 <> 0 THEN 1 ELSE 0 END) AS echo, sum(CASE WHEN event_id % 3 = 0 THEN 1
        ELSE 0 END) AS fizzle FROM events GROUP BY user_id), r AS (SELECT *, echo / (echo + fizzle)::DOUBLE AS rate FROM t)
    SELECT user_id, round(rate, 6) AS rate, CASE WHEN retrievals < 3 THEN 1::DOUBLE WHEN rate >= 0.8 THEN 1.5::DOUBLE
        WHEN rate >= 0.6 THEN 1.2::DOUBLE WHEN rate >= 0.4 THEN 1::DOUBLE WHEN rate >= 0.2 THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END AS boost,
    CASE WHEN echo >= 3 AND rate >= 0.8 THEN 'top' WHEN fizzle >= 5 AND 1 - rate >= 0.7 THEN 'under' ELSE 'even' END AS standing FROM r""")
def telemetry_rates(spark, sf_dir):
    t = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("retrievals"), F.sum((F.col("event_id") % 3 != 0).cast("int")).alias("echo"), F.sum((F.col("event_id") % 3 == 0).cast("int")).alias("fizzle"))
    rate = F.col("echo") / (F.col("echo") + F.col("fizzle"))
    standing = F.when((F.col("echo") >= 3) & (rate >= 0.8), "top").when((F.col("fizzle") >= 5) & (1 - rate >= 0.7), "under").otherwise("even")
    return t.select("user_id", F.round(rate, 6).alias("rate"), scoring.telemetry_boost(F.col("retrievals"), rate).alias("boost"), standing.alias("standing"))


@query(f"""WITH {M}, s AS (SELECT coalesce(project, source, 'unattributed') AS grp, id, created_s FROM m WHERE created_s < {AS_OF} - 86400 * 200
        AND importance >= 40)
    SELECT grp, count(*) AS n, array_to_string((list(id ORDER BY created_s, id))[1:3], ',') AS oldest FROM s GROUP BY grp""")
def staleness_groups(spark, sf_dir):
    rows = memories(spark, sf_dir, "id", "project", "source", "created_s", "importance").filter((F.col("created_s") < AS_OF - 86400 * 200) & (F.col("importance") >= 40))
    rows = rows.withColumn("grp", F.coalesce("project", "source", F.lit("unattributed")))
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("grp").orderBy("created_s", "id"))).filter("r <= 3").groupBy("grp").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda x: x["id"].cast("string")), ",").alias("oldest"))
    return rows.groupBy("grp").agg(F.count("*").alias("n")).join(first, "grp").select("grp", "n", "oldest")


@query("""SELECT event_id, CASE WHEN abs(x) >= 100000000000 THEN x / 1000::DOUBLE ELSE x::DOUBLE END AS two, CASE
        WHEN abs(x) >= 100000000000000 THEN x / 1000000::DOUBLE WHEN abs(x) >= 100000000000 THEN x / 1000::DOUBLE ELSE x::DOUBLE END AS ladder
        FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 1706745600 + event_id WHEN 1 THEN 1706745600000 + event_id
        ELSE 1706745600000000 + event_id END AS x FROM events)""")
def epoch_normalize(spark, sf_dir):
    x = table(spark, sf_dir, "events").selectExpr("event_id", "CASE event_id % 3 WHEN 0 THEN 1706745600 + event_id WHEN 1 THEN 1706745600000 + event_id ELSE 1706745600000000 + event_id END AS x")
    return x.select("event_id", scoring.epoch_seconds(F.col("x")).alias("two"), scoring.epoch_ladder(F.col("x")).alias("ladder"))


# Metrics: each document is a query graded by its label; its rank and confidence are derived from its id.
GRADED = """g AS (SELECT doc_id AS id, doc_id % 25 AS query, quality AS relevant, 1 + (doc_id * 31) % 20 AS rank,
        CAST((doc_id * 7919) % 1000 AS DOUBLE) / 1000 AS confidence FROM labels)"""


def _graded(spark, sf_dir):
    return table(spark, sf_dir, "labels").selectExpr("doc_id AS id", "doc_id % 25 AS query", "quality AS relevant", "1 + (doc_id * 31) % 20 AS rank", "CAST((doc_id * 7919) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS confidence")


@query(f"""WITH {GRADED}, q AS (SELECT query, max(CASE WHEN relevant = 1 AND rank <= 5 THEN 1 ELSE 0 END) AS hit, sum(CASE WHEN relevant = 1 AND rank <= 5 THEN 1
        ELSE 0 END)::DOUBLE / greatest(1, sum(relevant)) AS recall,
    coalesce(1::DOUBLE / min(CASE WHEN relevant = 1 THEN rank END), 0) AS rr, max(CASE WHEN relevant = 1 AND rank = 1 THEN 1 ELSE 0 END) AS first
        FROM g GROUP BY query)
    SELECT count(*) AS queries, round(avg(recall), 6) AS recall5, round(avg(rr), 6) AS mrr, round(avg(first), 6) AS hit1, round(avg(hit), 6) AS any5 FROM q""")
def metric_recall_mrr_hit(spark, sf_dir):
    return metrics.retrieval(_graded(spark, sf_dir), "query", "relevant", "rank")


@query(f"""WITH {GRADED}, o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank, id) AS r, row_number() OVER (PARTITION BY query
        ORDER BY relevant DESC, id) AS i FROM g),
    q AS (SELECT query, sum(CASE WHEN r <= 10 THEN relevant / log2(r + 1) ELSE 0 END) AS dcg, sum(CASE WHEN i <= 10 THEN relevant / log2(i + 1)
        ELSE 0 END) AS ideal FROM o GROUP BY query)
    SELECT query, round(CASE WHEN ideal = 0 THEN 0 ELSE dcg / ideal END, 6) AS ndcg FROM q""")
def metric_ndcg(spark, sf_dir):
    return metrics.ndcg(_graded(spark, sf_dir), "query", "relevant", ["rank", "id"], "id", 10)


@query(f"""WITH {GRADED}, b AS (SELECT least(9, floor(10 * confidence)) AS band, count(*) AS n, avg(confidence) AS c, avg(relevant) AS a,
        sum(pow(confidence - relevant, 2)) AS e FROM g GROUP BY 1)
    SELECT sum(n)::BIGINT AS n, round(sum(n * abs(c - a)) / sum(n), 6) AS ece, round(sum(e) / sum(n), 6) AS brier FROM b""")
def metric_ece_brier(spark, sf_dir):
    return metrics.calibration(_graded(spark, sf_dir), "confidence", "relevant")


@query(f"""WITH {GRADED}, t AS (SELECT unnest([0.0, 0.3, 0.6, 0.9])::DOUBLE AS threshold)
    SELECT threshold, round(avg(CASE WHEN confidence >= threshold THEN 1 ELSE 0 END), 6) AS coverage, round(sum(CASE WHEN confidence >= threshold
        AND relevant = 0 THEN 1 ELSE 0 END)::DOUBLE / greatest(1, sum(CASE WHEN confidence >= threshold THEN 1 ELSE 0 END)), 6) AS wrong_given,
        round(avg(CASE WHEN confidence >= threshold AND relevant = 0 THEN 1 ELSE 0 END), 6) AS cwr FROM g, t GROUP BY threshold""")
def selective_curve(spark, sf_dir):
    return metrics.selective(_graded(spark, sf_dir), "confidence", "relevant", [0.0, 0.3, 0.6, 0.9])
