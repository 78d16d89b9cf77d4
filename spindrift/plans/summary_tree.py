"""Queries over trees of summaries: conversations by turn, and documents by source and time."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.operators import summary_tree as st
from spindrift.plans.registry import MEMORY, memories, query, table

BUDGET = 3000
#: rec (session, key, tm, content) to x (session, n, depth, lo, hi, preview, start_at, end_at, key, text, shown, delta), from the root down.
NODES = f"""o AS (SELECT session, key, tm, content, row_number() OVER (PARTITION BY session ORDER BY tm NULLS FIRST, key) - 1 AS place, count(*) OVER (PARTITION BY session) AS n,
        trim(regexp_replace(content, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) AS flat FROM rec),
    o1 AS (SELECT *, left(coalesce(nullif(regexp_extract(flat, '^.{{1,240}}?(?:[.!?](?: |$)|$)'), ''), flat), {st.PREVIEW}) AS own FROM o),
    i AS (SELECT DISTINCT session, n, 0 AS depth, 0::BIGINT AS lo, n AS hi FROM o1 UNION ALL
        SELECT session, n, depth + 1, CASE side WHEN 0 THEN lo ELSE lo + (hi - lo) // 2 END, CASE side WHEN 0 THEN lo + (hi - lo) // 2 ELSE hi END
        FROM i, (VALUES (0), (1)) s(side) WHERE hi - lo > 1),
    p AS (SELECT i.session, i.n, depth, lo, hi, left(string_agg(own, ' | ' ORDER BY place), {st.PREVIEW}) AS preview, arg_min(tm, place) AS start_at,
        arg_max(tm, place) AS end_at, CASE WHEN hi - lo = 1 THEN min(key) END AS key, CASE WHEN hi - lo = 1 THEN min(content) END AS text
        FROM i JOIN o1 ON i.session = o1.session AND place >= lo AND place < hi GROUP BY i.session, i.n, depth, lo, hi),
    y AS (SELECT *, {st.NODE_TOKENS} + CAST(ceil(length(preview) / 4) AS BIGINT) AS shown, CAST(ceil(length(coalesce(text, '')) / 4) AS BIGINT) AS tokens FROM p)"""


def _conversations(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("turn").alias("at"), "text")


@query(f"""WITH RECURSIVE rec AS (SELECT conv_id AS session, turn AS key, turn AS tm, text AS content FROM conversations), {NODES}
    SELECT y.session, y.n, y.depth, y.lo, y.hi, y.key, y.preview, y.start_at, y.end_at, y.tokens AS text_tokens, y.shown, a.shown + b.shown - y.shown AS delta FROM y
    LEFT JOIN y a ON a.session = y.session AND a.lo = y.lo AND a.hi = y.lo + (y.hi - y.lo) // 2 AND y.hi - y.lo > 1
    LEFT JOIN y b ON b.session = y.session AND b.lo = y.lo + (y.hi - y.lo) // 2 AND b.hi = y.hi AND y.hi - y.lo > 1""")
def summary_tree(spark, sf_dir):
    """The tree of every conversation, by turn."""
    return st.tree(_conversations(spark, sf_dir), "conv_id", "turn", "at", "text").drop("node")


@query(f"""WITH RECURSIVE rec AS (SELECT {MEMORY['source']} AS session, doc_id AS key, {MEMORY['created_s']} AS tm, text AS content FROM documents), {NODES},
    w AS (SELECT session, {BUDGET - st.VIEW_TOKENS} - shown AS r, CASE WHEN n = 1 THEN []::STRUCT(a BIGINT, b BIGINT)[] ELSE [{{'a': lo, 'b': hi}}] END AS todo, CASE WHEN n = 1 THEN
            [{{'a': lo, 'b': hi, 'c': greatest(0, tokens - greatest(0, {BUDGET - st.VIEW_TOKENS} - shown))}}] ELSE []::STRUCT(a BIGINT, b BIGINT, c BIGINT)[] END AS cover FROM y WHERE depth = 0
        UNION ALL
        SELECT session, CASE WHEN fits THEN r - used ELSE r END, CASE WHEN fits THEN list_concat(rest, list_filter([{{'a': lo, 'b': mid}}, {{'a': mid, 'b': hi}}], lambda q: q.b - q.a > 1)) ELSE rest END,
            CASE WHEN fits THEN list_concat(cover, list_filter([{{'a': lo, 'b': mid, 'c': CASE WHEN mid - lo = 1 THEN cut ELSE 0 END}}, {{'a': mid, 'b': hi, 'c': CASE WHEN mid - lo > 1 THEN cut ELSE 0 END}}], lambda q: q.b - q.a = 1))
                ELSE list_append(cover, {{'a': lo, 'b': hi, 'c': 0::BIGINT}}) END
        FROM (SELECT *, need - spare <= r AS fits, greatest(0, need - r) AS cut, need - greatest(0, need - r) AS used
            FROM (SELECT t.*, a.shown + b.shown - y.shown + a.tokens + b.tokens AS need, CASE WHEN t.mid - t.lo = 1 THEN a.tokens ELSE b.tokens END AS spare
                FROM (SELECT *, todo[-1].a AS lo, todo[-1].b AS hi, todo[-1].a + (todo[-1].b - todo[-1].a) // 2 AS mid, todo[:-2] AS rest FROM w WHERE len(todo) > 0) t
                JOIN y ON y.session = t.session AND y.lo = t.lo AND y.hi = t.hi
                JOIN y a ON a.session = t.session AND a.lo = t.lo AND a.hi = t.mid JOIN y b ON b.session = t.session AND b.lo = t.mid AND b.hi = t.hi))),
    c AS (SELECT session, unnest(cover) AS q FROM w WHERE len(todo) = 0)
    SELECT c.session, q.a AS lo, q.b AS hi, q.b - q.a AS sources, preview, start_at, end_at, key, CASE WHEN q.c > 0 THEN left(text, (tokens - q.c) * 4) ELSE text END AS text, q.c > 0 AS truncated
    FROM c JOIN y ON y.session = c.session AND y.lo = q.a AND y.hi = q.b""")
def summary_view(spark, sf_dir):
    """What of every source's documents is shown within the budget, the newest in full."""
    rows = memories(spark, sf_dir, "id", "source", "created_s", "content")
    return st.shown(st.tree(rows, "source", "id", "created_s", "content"), rows, "source", "id", "created_s", "content", BUDGET)
