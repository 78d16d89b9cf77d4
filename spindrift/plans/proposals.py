"""Queries over merge proposals: every event of a user is a step of a proposal, documents are the sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.operators import proposals
from spindrift.plans.registry import query, table

#: Actions of steps and sources of proposals by the numbers of their rows; steps at the same second are frequent.
ACTION = "CASE event_id % 9 WHEN 0 THEN 'propose' WHEN 1 THEN 'propose' WHEN 2 THEN 'approve' WHEN 3 THEN 'approve' WHEN 4 THEN 'reject' WHEN 5 THEN 'reverse' WHEN 6 THEN 'reverse' WHEN 7 THEN 'approve' ELSE 'bogus' END"
PROPOSAL = "user_id * 41 + event_id % 41"
#: t (proposal, ts, event_id, action, state, outcome): the replay of one step after another.
REPLAY = f"""l AS (SELECT {PROPOSAL} AS proposal, epoch_ms(ts) // 3600000 AS hour, event_id, {ACTION} AS action FROM events),
    n AS (SELECT *, row_number() OVER (PARTITION BY proposal ORDER BY hour, event_id) AS i FROM l),
    t AS (SELECT DISTINCT proposal, 0::BIGINT AS i, NULL::BIGINT AS event_id, ''::VARCHAR AS action, 'none' AS state, ''::VARCHAR AS outcome, 0::BIGINT AS hour FROM l
        UNION ALL
        SELECT proposal, i, event_id, action, CASE WHEN outcome <> 'applied' THEN state WHEN action = 'propose' THEN 'pending' WHEN action = 'approve' THEN 'approved' WHEN action = 'reject' THEN 'rejected' ELSE 'reversed' END,
            outcome, hour FROM (SELECT n.proposal, n.i, n.event_id, n.action, n.hour, t.state, CASE WHEN n.action = 'bogus' THEN 'unknown' WHEN n.action = 'propose' THEN CASE state WHEN 'none' THEN 'applied' ELSE 'open' END
                WHEN state = 'none' THEN 'missing' WHEN n.action = 'reverse' THEN CASE state WHEN 'approved' THEN 'applied' WHEN 'reversed' THEN 'reversed' ELSE 'not approved' END
                WHEN state = 'pending' THEN 'applied' ELSE 'decided' END AS outcome FROM t JOIN n ON n.proposal = t.proposal AND n.i = t.i + 1))"""
SOURCES = ("doc_id % 6150", "(doc_id * 7) % 6150", "(doc_id * 31 + 5) % 6150", "(doc_id * 113 + 77) % 6150")


def _log(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    hour = "CAST(datediff(CAST(ts AS DATE), DATE'1970-01-01') AS BIGINT) * 24 + hour(ts)"
    return events.selectExpr(f"{PROPOSAL} AS proposal", f"{hour} AS at", "event_id AS seq", f"{ACTION} AS action")


@query(f"WITH RECURSIVE {REPLAY} SELECT proposal, event_id, action, outcome FROM t WHERE i > 0")
def proposal_outcomes(spark, sf_dir):
    """What became of every step."""
    return proposals.outcomes(_log(spark, sf_dir)).select("proposal", F.col("seq").alias("event_id"), "action", "outcome")


@query(f"WITH RECURSIVE {REPLAY} SELECT proposal, state FROM t WHERE state <> 'none' QUALIFY row_number() OVER (PARTITION BY proposal ORDER BY i DESC) = 1")
def proposal_states(spark, sf_dir):
    """Where every proposal stands."""
    return proposals.states(_log(spark, sf_dir)).select("proposal", "state")


@query(f"""WITH RECURSIVE {REPLAY}, z AS (SELECT proposal, bool_or(state = 'reversed') AS back, min(hour) FILTER (action = 'approve' AND outcome = 'applied') AS hour, min(event_id) FILTER (action = 'approve' AND outcome = 'applied') AS event_id FROM t GROUP BY proposal),
    s AS (SELECT DISTINCT doc_id AS id, proposal FROM (SELECT doc_id, unnest([{", ".join(SOURCES)}]) AS proposal FROM documents))
    SELECT id, proposal FROM (SELECT s.id, s.proposal, back FROM s JOIN z USING (proposal) WHERE hour IS NOT NULL QUALIFY row_number() OVER (PARTITION BY s.id ORDER BY hour DESC, event_id DESC) = 1) WHERE NOT back""")
def proposal_merges(spark, sf_dir):
    """Documents that are merged now, by the proposal that holds them."""
    ids = table(spark, sf_dir, "documents").selectExpr("doc_id AS id", f"explode(array({', '.join(SOURCES)})) AS proposal")
    return proposals.merged_into(_log(spark, sf_dir), ids)
