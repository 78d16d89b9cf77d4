"""Topics of questions and statements, and recall's use of them, case by case."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from spindrift.functions import scoring, topics
from spindrift.operators import recall, search

QUESTIONS = [
    ("What phone does Kenji use?", "kenji", "phone", None), ("What does Mireia do on weekends?", "mireia", "do on weekends", None), ("What did June study?", "june", "school", None),
    ("Where was Kenji born?", "kenji", "birthplace", None), ("Where did Lars Holm grow up?", "lars holm", "birthplace", None), ("where does Olga live now", "olga", "location", None), ("Where does Olga work?", "olga", "employer", None),
    ("In which city does Tomas live?", "tomas", "location", None), ("In what town was Tomas born?", "tomas", "birthplace", None), ("How many siblings does Priya have?", "priya", "family", None),
    ("What is the salary of Ivan Petrov?", "ivan petrov", "salary", None), ("Who is Renata?", "renata", "person", None), ("Who mentors Fatima?", "fatima", "mentorship", "object"), ("Who leads Project Aurora?", "project aurora", "person", "object"),
    ("Who leads it?", None, "person", None), ("What is Priyas shoe size?", "priya", "shoe size", None), ("What is Priya's salary?", "priya", "salary", None), ("What is PaperTrail?", "papertrail", None, None), ("What is it?", None, None, None),
    ("Which airline flies Qing to work?", "qing", "airline flies", "object"), ("What color is Kenji's car?", None, None, None), ("What breed is Hana's dog?", "hana", "breed", None), ("What breed is the dog?", None, "breed", None),
    ("When does the extinguisher inspection expire?", None, "expiration", None), ("When was it?", None, None, None), ("What brand does the office use?", None, "brand", None), ("What plan does the office use?", None, None, None), ("What do we use?", None, None, None),
    ("What food allergy does Ana have?", "ana", "allergy", None), ("What sport does NASA play?", None, "sport", None), ("Which app does X9 use?", None, "phone", None), ("When does the lease of Beer expire?", None, "expiration", None), ("When does Beer arrive?", None, "drink", None), ("Where does Beer live now?", "beer", "location", None), ("Where does Film work?", "film", "employer", None),
    ("In which city does Born work?", "born", "location", None), ("Which app helps Does today?", "does", "phone", "object"), ("Which app helps Were today?", "were", "phone", "object"), ("hello", None, None, None), ("", None, None, None), (None, None, None, None), ("???", None, None, None),
]
STATEMENTS = [
    ("Kenji was born in Tokyo.", "kenji", "birthplace", False), ("My phone is old.", None, "phone", True), ("Growing up in Kyoto was fun.", "kyoto", "birthplace", False), ("Qing runs", "qing", None, False), ("Olga plays the erhu", "olga", "instrument", False),
    ("Olga plays badminton", "olga", "sport", False), ("Dr. Lund studied at Uppsala. He lives there.", "dr lund", "school", False), ("April 2026 was warm for Renata", "renata", None, False), ("In May we saw Lin", "may", None, False), ("NASA and Kim own a dog", "kim", "pet", False),
    ("Fatima's coach is Lee", "fatima", "mentorship", False), ("Tomas reports to the Lisbon office", "tomas", "mentorship", False), ("  We live here", None, "location", True), ("I'm here", "i'm", None, False), ("Anna Maria Sands works at ACME Labs", "anna maria sands", "employer", False),
    ("nothing here", None, None, False), ("The app; Kim", None, "phone", False), ("", None, None, False), (" \n", None, None, False), (None, None, None, False), ("x" * 100000 + " Kim", "kim", None, False),
]


def test_questions_are_read(spark):
    rows = spark.createDataFrame([(i, q[0]) for i, q in enumerate(QUESTIONS)], "i int, q string")
    got = {r.i: (r.a.entity, r.a.attribute, r.a.role) for r in rows.select("i", topics.asked(F.col("q")).alias("a")).collect()}
    assert [(q, *got[i]) for i, (q, *_) in enumerate(QUESTIONS)] == QUESTIONS


def test_statements_are_read(spark):
    rows = spark.createDataFrame([(i, s[0]) for i, s in enumerate(STATEMENTS)], "i int, s string")
    got = {r.i: (r.m.entity, r.m.attribute, r.m.first_person) for r in rows.select("i", topics.stated(F.col("s")).alias("m")).collect()}
    assert [(s, *got[i]) for i, (s, *_) in enumerate(STATEMENTS)] == STATEMENTS


@pytest.mark.parametrize(
    ("form", "attribute"),
    [("phones", "phone"), ("lives", "location"), ("lived", "location"), ("studied", "school"), ("studies", "school"), ("graduated", "school"), ("swimming", "sport"), ("coaches", "mentorship"), ("used", "phone"), ("allergies", "allergy"), ("jogged", None), ("this", None), ("us", None), ("livee", None)],
)
def test_inflections(form, attribute):
    assert topics.FORMS.get(form) == attribute


PAIRS = [
    ("What phone does Kenji use?", "Kenji uses an old device.", 1.0), ("What phone does Kenji use?", "Kenji was born in Tokyo.", 0.0), ("What phone does Kenji use?", "Olga lives here.", 0.0), ("What phone does Kenji use?", "Olga gave Kenji a lift.", 0.7),
    ("What phone does Kenji use?", "My phone is red.", 0.0), ("what is my phone", "My phone is red.", None), ("What phone does Kenji use?", "Kenji is here.", None), ("Who is Kenji?", "Olga is here.", 0.0), ("What is Kenji?", "Olga uses a phone.", None),
    ("Who mentors Fatima?", "Lee is a person.", None), ("Who mentors Fatima?", "Lee mentors people.", 0.0), ("Who mentors Fatima?", "Fatima has a coach.", 1.0), ("What is Kenjis car color?", "Kenji drives a car.", 1.0), ("Where does Kenji Ito live?", "Kenji lives there.", 1.0),
    ("Which phone shop helps Kenji?", "Kenji has a phone.", 1.0), ("What does Kenji do daily?", "Kenji reads a book.", 0.0), ("hello", "Kenji reads a book.", None), (None, None, None), ("What phone does Jo use?", "Joan uses a phone.", 0.0),
]


def test_alignment(spark):
    rows = spark.createDataFrame([(i, *p[:2]) for i, p in enumerate(PAIRS)], "i int, q string, m string")
    got = {r.i: r.a for r in rows.select("i", topics.alignment(topics.asked(F.col("q")), topics.stated(F.col("m")), F.col("m")).alias("a")).collect()}
    assert [(*p[:2], got[i]) for i, p in enumerate(PAIRS)] == PAIRS


def test_carries_looks_at_the_whole_text(spark):
    cases = [("One. Two. He lives there", "location", True), ("One. Two. He left there", "location", False), ("her personal best", "pace", True), ("PHONES!", "phone", True), (None, "phone", False), ("phone", None, False), ("phonetic", "phone", False)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t string, a string, want boolean")
    assert all(r.got == r.want for r in rows.select("want", topics.carries(F.col("t"), F.col("a")).alias("got")).collect())


def test_topical_flags_see_all_results_of_a_query(spark):
    queries = spark.createDataFrame([(1, "What phone does Kenji use?"), (2, "Where does Olga live?"), (3, "When does it expire?"), (4, "nothing to read"), (5, None)], "query long, content string")
    texts = ["Kenji was born here.", "Kenji reads.", "Olga moved. She lives in Oslo.", "Olga reads.", "the lease is long", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    found = spark.createDataFrame([(1, 0), (1, 1), (2, 2), (2, 3), (3, 4), (3, 5), (3, 6), (4, 0), (5, 0)], "query long, id long")
    got = {(r["query"], r.id): (r.aligned, r.absent, r.unstated) for r in recall.topical(queries, found, rows).collect()}
    assert got == {
        (1, 0): (0.0, True, True), (1, 1): (0.0, True, True), (2, 2): (None, True, False), (2, 3): (0.0, True, False), (3, 4): (None, False, True), (3, 5): (None, False, False),
        (3, 6): (None, False, False), (4, 0): (None, False, False), (5, 0): (None, False, False),
    }
    assert recall.topical(queries.limit(0), found, rows).filter("aligned IS NOT NULL OR unstated").isEmpty()


def test_topical_factor_and_doubt(spark):
    row = spark.createDataFrame([(0.9,)], "s double")
    yes, no = F.lit(True), F.lit(False)
    factors = [scoring.topical_factor(F.lit(a).cast("double"), absent, unstated) for a, absent, unstated in ((0.0, no, no), (0.0, yes, no), (0.7, no, no), (1.0, no, yes), (None, yes, no), (0.0, yes, yes))]
    assert row.select(*factors).first() == pytest.approx((0.3, 0.255, 0.85, 0.45, 1.0, 0.255 * 0.45))
    known = lambda rank, lexical, graph, multi: scoring.recall_confidence(F.col("s"), F.lit(rank).cast("long"), F.lit(lexical).cast("double"), F.lit(graph), F.lit(0.1), F.lit(5), F.col("s"), F.lit(1.0), F.lit("certain"), no, F.lit(multi))
    doubted, backed = row.select(known(None, None, 0.0, True), known(None, 0.6, 0.0, True)).first()
    assert doubted == pytest.approx(0.8 * row.select(known(None, None, 0.0, False)).first()[0]) and backed > doubted


def test_vector_leg_in_blocks_is_the_same(spark):
    rows = spark.createDataFrame([(i, [float((i * k) % 11) - 5 for k in range(1, 7)]) for i in range(120)], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(i,) for i in range(0, 150, 3)] + [(3,), (None,)], "query long")
    plain = sorted(map(tuple, search.vector_leg(rows, queries, 4).collect()))
    assert plain == sorted(map(tuple, search.vector_leg(rows, queries, 4, block=7).collect())) and len(plain) == 40 * 4


def test_topical_recall_reads_its_rows_without_a_join(spark, sf_dir, monkeypatch):
    from spindrift.plans import topics as plans

    class Seen(Exception):
        pass

    def recall(queries, rows, *rest):
        raise Seen(rows)

    monkeypatch.setattr(plans.recall, "recall", recall)
    try:
        plans.recall_topical(spark, sf_dir)
    except Seen as seen:
        rows = seen.args[0]
    assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()
    said = plans._statements(spark, sf_dir)
    assert rows.select("id", "content").exceptAll(said).isEmpty() and rows.count() == said.count() > 0
