"""Queries over topics: what questions ask, what records state, and recall that heeds whether they agree.

Questions are put about a word of the given texts, in forms whose reading is known, so the SQL states that reading instead of
parsing; records are the documents, most of them after a sentence about their first word. The SQL reads records by lists of
words, without the patterns that the functions use."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions import topics
from spindrift.operators import recall, search
from spindrift.plans.recall import LEGS, VERDICT
from spindrift.plans.registry import AS_OF, MEMORY, query, table

#: Forms of questions about the name @, with the entity (of the lower-case name), attribute and role that they ask for.
FORMS = (
    ("What phone does @ use?", "@", "phone", None), ("Where does @ live now?", "@", "location", None), ("Where was @ born?", "@", "birthplace", None),
    ("What did @ study?", "@", "school", None), ("Who mentors @?", "@", "mentorship", "object"), ("How many siblings does @ have?", "@", "family", None),
    ("In which city does @ work?", "@", "location", None), ("What is the salary of @?", "@", "salary", None), ("Who is @?", "@", "person", None),
    ("Which app helps @ today?", "@", "phone", "object"), ("When does the lease of @ expire?", None, "expiration", None), ("is @ here", None, None, None),
    ("What food allergy does @ have", "@", "allergy", None), ("What does @ do all day?", "@", "do all day", None), ("What breed is the dog of @?", "@", "breed", None),
    ("What do they say?", None, None, None), ("Where does @ work?", "@", "employer", None), ("Who knows?", None, "person", None),
)
#: Sentences about a record's first word, put before its text.
SENTENCES = ("@ lives in a town. ", "@ uses a phone! ", "@ was born here;", "My @ works. ", "@ mentors a team. ", "@ plays the flute. ", "", "")
WORD = "regexp_extract(coalesce({}, ''), '([A-Z][a-z]{{3,}})', 1)"


def _case(key: str, values: tuple, put: str) -> str:
    """CASE over key, with the value's @ replaced by `put`; the same in Spark and DuckDB."""
    shown = lambda v: "NULL" if v is None else f"replace('{v}', '@', {put})"
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {shown(v)}" for i, v in enumerate(values)) + " END"


def _question(key: str, text: str) -> str:
    name = f"coalesce(nullif({WORD.format(text)}, ''), 'Kim')"
    return _case(key, tuple(f[0] for f in FORMS), name)


def _reading(key: str, text: str) -> str:
    """The entity, attribute and role of _question in SQL."""
    name = f"lower(coalesce(nullif({WORD.format(text)}, ''), 'Kim'))"
    breed = f"CASE WHEN {key} % {len(FORMS)} = {next(i for i, f in enumerate(FORMS) if 'breed' in f[0])} THEN NULL ELSE"
    return f"{breed} {_case(key, tuple(f[1] for f in FORMS), name)} END AS entity, {_case(key, tuple(f[2] for f in FORMS), name)} AS attribute, {_case(key, tuple(f[3] for f in FORMS), name)} AS role"


CONTENT = f"concat({_case('doc_id', SENTENCES, WORD.format('text'))}, text)"


def _map(values: dict[str, str]) -> str:
    return "map {" + ", ".join(f"'{k}': '{v}'" for k, v in values.items()) + "}"


def _list(words: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words.split()) + "]"


def _word_list(text: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({text}, '\\s+'), lambda w: regexp_replace(w, '^[^A-Za-z0-9]+|[^A-Za-z0-9'']+$', '', 'g')), lambda w: w <> '')"


_ABBREVIATIONS = "|".join(topics.ABBREVIATIONS.split())
#: said (id, content) to p (id, content, entity, attribute, first_person).
STATED = f"""d1 AS (SELECT *, regexp_replace(coalesce(content, ''), '^\\s+|\\s+$', '', 'g') AS whole FROM said),
    d2 AS (SELECT *, {_word_list(f"regexp_extract(regexp_replace(whole, '(\\b(?:{_ABBREVIATIONS}))\\.(\\s)', '\\1\\2', 'g'), '^[^.!?\\n;]*')")} AS ws FROM d1),
    d3 AS (SELECT *, list_transform(ws, lambda w: lower(w)) AS ls, list_transform(ws, lambda w: regexp_matches(w, '^[A-Z]') AND NOT regexp_matches(w, '[0-9]')
        AND NOT (NOT regexp_matches(w, '[a-z]') AND len(regexp_extract_all(w, '[A-Z]')) >= 2)) AS named,
        list_transform(ws, lambda w: list_contains({_list(topics.CALENDAR)}, lower(w))) AS dated FROM d2),
    d4 AS (SELECT *, list_filter(range(1, len(ws) + 1), lambda i: named[i] AND NOT (dated[i] AND (i = len(ws) OR regexp_matches(ws[i + 1], '^(19|20)[0-9]{{2}}s?$')))
        AND NOT (i = 1 AND (list_contains({_list(topics.OPENERS)}, ls[1]) OR (ends_with(ls[1], 'ing') AND len(ws) > 1 AND NOT regexp_matches(ws[2], '^[A-Z]')
            AND list_contains({_list(topics.AFTER_GERUND)}, ls[2])))))[1] AS i FROM d3),
    d5 AS (SELECT *, coalesce(list_filter(range(i + 1, len(ws) + 1), lambda j: NOT named[j] OR dated[j])[1], len(ws) + 1) AS e FROM d4),
    d6 AS (SELECT *, list_filter(list_transform(range(1, len(ls)), lambda j: {_map(topics.PHRASES)}[ls[j] || ' ' || ls[j + 1]]), lambda a: a IS NOT NULL)[1] AS phrase,
        list_filter(range(1, len(ls) + 1), lambda j: {_map(topics.FORMS)}[ls[j]] IS NOT NULL)[1] AS k FROM d5),
    p AS (SELECT id, content, CASE WHEN i IS NOT NULL THEN lower(regexp_replace(array_to_string(list_slice(ws, i, e - 1), ' '), '''s$', '')) END AS entity,
        coalesce(phrase, CASE WHEN ls[k] IN ('play', 'plays') AND ls[k + 1] IN ('the', 'a', 'an') THEN 'instrument' ELSE {_map(topics.FORMS)}[ls[k]] END) AS attribute,
        regexp_matches(whole, '^(?i)(my|our|i|we)\\s') AND len(ws) > 0 AS first_person FROM d6)"""


def _statements(spark, sf_dir):
    return table(spark, sf_dir, "documents").selectExpr("doc_id AS id", f"{CONTENT} AS content")


@query(f"WITH said AS (SELECT doc_id AS id, {CONTENT} AS content FROM documents), {STATED} SELECT id, entity, attribute, first_person FROM p")
def topic_statements(spark, sf_dir):
    """Whom and what every record is about."""
    return _statements(spark, sf_dir).select("id", topics.stated(F.col("content")).alias("m")).select("id", "m.entity", "m.attribute", "m.first_person")


@query(f"SELECT conv_id, turn, {_reading('(conv_id + turn)', 'text')} FROM conversations")
def topic_questions(spark, sf_dir):
    """What every turn's question asks about whom."""
    rows = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{_question('(conv_id + turn)', 'text')} AS question")
    return rows.select("conv_id", "turn", topics.asked(F.col("question")).alias("q")).select("conv_id", "turn", "q.entity", "q.attribute", "q.role")


def _queries(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").selectExpr("item_id AS query", f"{_question('item_id', 'text')} AS content")


_ASKED = f"b AS (SELECT item_id AS query, {_reading('item_id', 'text')} FROM benchmark)"
#: s (query, id) with the verdict on each result's topic.
TOPIC = f"""{_ASKED}, said AS (SELECT DISTINCT id, m.content FROM s JOIN m USING (id)), {STATED},
    w AS (SELECT id, list_transform({_word_list("coalesce(content, '')")}, lambda w: lower(w)) AS ls FROM said),
    t0 AS (SELECT s.query, s.id, b.attribute AS qa, b.role, b.entity AS qe, p.entity AS me, p.attribute AS ma, first_person, content,
        qe = me OR (length(me) >= 3 AND contains(qe, me)) OR (length(qe) >= 3 AND contains(me, qe)) AS same,
        list_contains(list_transform(ls, lambda w: {_map(topics.FORMS)}[w]), qa)
            OR list_contains(list_transform(range(1, len(ls)), lambda j: {_map(topics.PHRASES)}[ls[j] || ' ' || ls[j + 1]]), qa) AS states
        FROM s LEFT JOIN b USING (query) JOIN p USING (id) JOIN w USING (id)),
    t1 AS (SELECT *, coalesce(CASE WHEN qa NOT IN ({", ".join(f"'{a}'" for a in topics.ATTRIBUTES)}) THEN false WHEN qe IS NULL THEN qa IS NOT NULL AND trim(content) <> '' ELSE same END, false) AS about,
        CASE WHEN first_person AND qe IS NOT NULL THEN 0::DOUBLE WHEN role IS NULL AND qa IS NOT NULL AND NOT same
            THEN CASE WHEN regexp_matches(content, '(?i)\\b' || qe || '\\b') THEN 0.7::DOUBLE ELSE 0::DOUBLE END
            WHEN qe IS NULL OR me IS NULL OR qa IS NULL OR ma IS NULL THEN NULL WHEN NOT same THEN 0::DOUBLE WHEN qa = ma THEN 1::DOUBLE
            WHEN contains(qa, ma) OR contains(ma, qa) THEN 0.7::DOUBLE ELSE 0::DOUBLE END AS aligned FROM t0),
    topic AS (SELECT query, id, aligned, coalesce(max(aligned) OVER (PARTITION BY query) = 0, false) AS absent,
        about AND NOT coalesce(bool_or(about AND states) OVER (PARTITION BY query), false) AS unstated FROM t1)"""
_LEGS = LEGS.replace("q AS (SELECT item_id AS query, text FROM benchmark)", f"q AS (SELECT item_id AS query, {_question('item_id', 'text')} AS text FROM benchmark)").replace("text AS content,", f"{CONTENT} AS content,", 1)


@query(f"WITH {_LEGS}, {VERDICT.format(topic=TOPIC)}".replace("AS verdict FROM z", "AS verdict, aligned, unstated FROM z"))
def recall_topical(spark, sf_dir):
    """Questions through recall: legs, fusion, boosts, gate, and a confidence that heeds what question and record are about."""
    own = MEMORY | {"content": CONTENT, "next_id": MEMORY["superseded_by"]}
    rows = table(spark, sf_dir, "documents").selectExpr(*(f"{own[c]} AS {c}" for c in ("id", "content", "created_s", "next_id", "level", "conflict")))
    out = recall.recall(_queries(spark, sf_dir), rows, search.vector_leg(table(spark, sf_dir, "embeddings"), _queries(spark, sf_dir)), AS_OF)
    return out.select("query", "id", F.col("place").cast("long").alias("place"), F.round("final", 6).alias("final"), F.round("confidence", 6).alias("confidence"), "tier", "verdict", "aligned", "unstated")
