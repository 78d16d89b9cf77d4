"""Expressions of time, case by case: ranges, offsets, zones and changes of clocks."""

from __future__ import annotations

import datetime as dt
import random
import zoneinfo

import pytest
from pyspark.sql import functions as F

from spindrift.functions import time_expressions as te

LA, APIA, LORD = "America/Los_Angeles", "Pacific/Apia", "Australia/Lord_Howe"


def ms(iso):
    return None if iso is None else round(dt.datetime.fromisoformat(iso.replace("Z", "+00:00")).timestamp() * 1000)


# text, as of, zone, [(value, start, end, precision)]
CASES = [
    ("The review is in 2 weeks.", "2024-01-31T15:45:22.123Z", "UTC", [("in 2 weeks", "2024-02-14T15:45:22.123Z", None, "day")]),
    ("Renew 1 month from now.", "2024-01-31T15:45:22.123Z", "UTC", [("1 month from now", "2024-02-29T15:45:22.123Z", None, "day")]),
    ("1 month ago", "2024-01-31T15:45:22.123Z", "UTC", [("1 month ago", "2023-12-31T15:45:22.123Z", None, "day")]),
    ("1 year from now", "2024-02-29T01:02:03Z", "UTC", [("1 year from now", "2025-02-28T01:02:03Z", None, "day")]),
    ("next month", "2024-01-31T15:45:22.123Z", "UTC", [("next month", "2024-02-01T00:00:00Z", "2024-03-01T00:00:00Z", "month")]),
    ("LAST  YEAR", "2024-02-29T15:45:22.123Z", "UTC", [("LAST  YEAR", "2023-01-01T00:00:00Z", "2024-01-01T00:00:00Z", "year")]),
    ("in 2 days", "2024-12-31T23:30:00.456Z", "UTC", [("in 2 days", "2025-01-02T23:30:00.456Z", None, "day")]),
    ("2024-02-30 and 2024-02-30T10:30:00Z and 2024-06-15T25:00:00Z", "2024-01-01T00:00:00Z", "UTC", []),
    ("on 2024-06-15.", "2024-01-01T00:00:00Z", "UTC", [("2024-06-15", "2024-06-15T00:00:00Z", "2024-06-16T00:00:00Z", "day")]),
    ("June 2025, 2026, 2024-11", "2024-01-01T00:00:00Z", "UTC", [("2024-11", "2024-11-01T00:00:00Z", "2024-12-01T00:00:00Z", "month"), ("June 2025", "2025-06-01T00:00:00Z", "2025-07-01T00:00:00Z", "month"), ("2026", "2026-01-01T00:00:00Z", "2027-01-01T00:00:00Z", "year")]),
    ("January 5, 2024; Jan 7; Feb 30", "2025-01-01T00:00:00Z", "UTC", [("January 5, 2024", "2024-01-05T00:00:00Z", "2024-01-06T00:00:00Z", "day"), ("Jan 7", "2025-01-07T00:00:00Z", "2025-01-08T00:00:00Z", "day")]),
    ("last week", "2024-06-15T10:30:00Z", "UTC", [("last week", "2024-06-03T00:00:00Z", "2024-06-10T00:00:00Z", "week")]),
    ("next hour", "2024-06-15T10:30:00Z", "UTC", [("next hour", "2024-06-15T10:30:00Z", "2024-06-15T11:30:00Z", "hour")]),
    ("3 hours ago", "2024-06-15T10:30:00Z", "UTC", [("3 hours ago", "2024-06-15T07:00:00Z", "2024-06-15T08:00:00Z", "hour")]),
    ("in 90 seconds", "2024-06-15T10:30:00.700Z", "UTC", [("in 90 seconds", "2024-06-15T10:31:30Z", "2024-06-15T10:31:31Z", "second")]),
    ("0 days ago, 99999999999999999999 days ago, 9999999999 years ago", "2024-06-15T10:30:00Z", "UTC", []),
    ("today", "2024-03-10T08:30:00Z", LA, [("today", "2024-03-10T08:00:00Z", "2024-03-11T07:00:00Z", "day")]),
    ("last week", "2024-03-11T08:30:00Z", LA, [("last week", "2024-03-04T08:00:00Z", "2024-03-11T07:00:00Z", "week")]),
    ("next month", "2024-03-11T08:30:00Z", LA, [("next month", "2024-04-01T07:00:00Z", "2024-05-01T07:00:00Z", "month")]),
    ("2024-11-03T01:30:00.", "2024-11-03T12:00:00Z", LA, [("2024-11-03T01:30:00", "2024-11-03T08:30:00Z", None, "instant")]),
    ("2024-03-10T02:30:00.", "2024-03-10T12:00:00Z", LA, [("2024-03-10T02:30:00", "2024-03-10T10:00:00Z", None, "instant")]),
    ("2024-06-15T10:30:00.5-05:00.", "2024-06-15T12:00:00Z", LA, [("2024-06-15T10:30:00.5-05:00", "2024-06-15T15:30:00.500Z", None, "instant")]),
    ("in 1 day", "2024-03-10T08:30:00Z", LA, [("in 1 day", "2024-03-11T07:30:00Z", None, "day")]),
    ("2024-10-06T02:15:00", "2024-10-01T00:00:00Z", LORD, [("2024-10-06T02:15:00", "2024-10-05T15:30:00Z", None, "instant")]),
]


def read(spark, text, at, zone="UTC"):
    rows = spark.createDataFrame([(text, ms(at))], "t string, at long")
    return rows.select(te.expressions(F.col("t"), F.col("at"), zone).alias("e")).first().e


@pytest.mark.parametrize("zone", sorted({c[2] for c in CASES}))
def test_cases(spark, zone):
    own = [c for c in CASES if c[2] == zone]
    rows = spark.createDataFrame([(i, c[0], ms(c[1])) for i, c in enumerate(own)], "i int, t string, at long")
    got = {r.i: [(e.value, e.start, e.end, e.precision) for e in r.e] for r in rows.select("i", te.expressions(F.col("t"), F.col("at"), zone).alias("e")).collect()}
    for i, (_, _, _, want) in enumerate(own):
        assert got[i] == [(v, ms(a), ms(b or a), p) for v, a, b, p in want]


def test_the_session_zone_does_not_matter(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert [(e.start, e.end) for e in read(spark, "today", "2024-03-10T08:30:00Z", LA)] == [(ms("2024-03-10T08:00:00Z"), ms("2024-03-11T07:00:00Z"))]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_durations_and_frequencies(spark):
    got = [(e.kind, e.value, e.duration, e.frequency, e.confidence) for e in read(spark, "for 2 hours, over 3 weeks, Daily, once a month, during 1 year", "2024-06-15T10:30:00Z")]
    assert got == [("duration", "for 2 hours", 7_200_000, None, 0.8), ("duration", "over 3 weeks", 3 * 7 * te.DAY, None, 0.8), ("duration", "during 1 year", 365 * te.DAY, None, 0.8), ("frequency", "Daily", None, "daily", 0.85), ("frequency", "once a month", None, "once a month", 0.85)]
    assert read(spark, None, "2024-06-15T10:30:00Z") == [] == read(spark, "", "2024-06-15T10:30:00Z")


def test_an_unknown_zone_is_an_error(spark):
    with pytest.raises((ValueError, KeyError)):
        te.expressions(F.col("t"), F.col("at"), "Mars/Olympus")


@pytest.mark.parametrize("zone", [LA, LORD, APIA, "Europe/Berlin"])
def test_clocks_go_to_instants_and_back(spark, zone):
    first = {LA: "2024-03-09", LORD: "2024-10-05", APIA: "2011-12-28", "Europe/Berlin": "2024-10-26"}[zone]
    start = ms(first + "T00:00:00Z")
    rows = spark.range(0, 96).select((F.lit(start) + F.col("id") * 30 * te.MINUTE).alias("c"))
    for r in rows.select("c", te.instant(F.col("c"), zone).alias("i"), te.local(F.col("c"), zone).alias("l")).collect():
        at = lambda m: dt.datetime.fromtimestamp(m / 1000, zoneinfo.ZoneInfo(zone)).replace(tzinfo=dt.timezone.utc).timestamp() * 1000
        assert r.l == at(r.c)
        same = [i for i in range(r.c - 16 * te.HOUR, r.c + 16 * te.HOUR, 30 * te.MINUTE) if at(i) == r.c]
        if same:
            assert r.i == min(same)
        elif r.i is not None:  # a day that Apia left out is more than what is looked ahead
            assert at(r.i) > r.c > at(r.i - te.MINUTE)
        else:
            assert zone == APIA


def test_patterns_that_give_up_early_find_the_same(spark):
    """Of times and of entities, on texts that are cut together from their pieces."""
    from spindrift.functions import entities
    from spindrift.functions.text import ascii_bounds, word_bounds

    rng = random.Random(3)
    pieces = (
        "2024-01-05 2024-02 T10:00:00 Z +02:00 January may 5 , 1999 2101 last next week YEAR today yesterday in 3 days ago from now during for 2 hours daily every month once a _ é . - $ ( class new Engine$ "
        "extends React Nodejs Node.js abstract factory pattern METHOD lazy loading caching Event Queue System run_all $x a1 /src/main.py \" '"
    ).split(" ")
    texts = ["x for 2 hours", *("".join(p + rng.choice(("", " ", "  ", "\n", ".", "é")) for p in rng.choices(pieces, k=rng.randint(1, 14))) for _ in range(1500))]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4).cache()
    pairs = [(te.FAST[k], ascii_bounds(p), 0) for k, p in te.PATTERNS.items()] + [(entities._fast(k, p), ascii_bounds(p), g) for k, _, p, g in entities.PATTERNS]
    all_ = lambda p, g: F.regexp_extract_all("t", F.lit(p), F.lit(g))
    bad = df.select(*(F.count_if(all_(a, g) != all_(b, g)).alias(f"bad{i}") for i, (a, b, g) in enumerate(pairs)), *(F.sum(F.size(all_(a, g))).alias(f"n{i}") for i, (a, b, g) in enumerate(pairs))).first()
    df.unpersist()
    assert all(bad[f"bad{i}"] == 0 and bad[f"n{i}"] > 0 for i in range(len(pairs))), bad
    assert sum(a != b for a, b, _ in pairs) == 16
    assert word_bounds(r"(?i)\ba\b", "Aa") == r"(?i)(?=[Aa])(?<!\w)a(?!\w)"
