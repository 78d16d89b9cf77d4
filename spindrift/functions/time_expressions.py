"""Expressions of time in a text: ranges, instants, offsets, durations and frequencies, in any IANA zone.

A text's expressions are found by patterns and read by column expressions. Times are milliseconds. A zone's calendar is reached by shifting
an instant to its local clock, where days, months and years are added, and back; a local time that occurs twice is
the earlier one, and one that a change of clocks leaves out becomes the first minute after it, if that is within three hours;
else it is null.

Defined results: a null text has no expressions; dates that don't exist are none; repeated expressions count each; an unknown
zone is an error. A year within another date isn't an expression of its own.
"""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions.text import ascii_bounds, word_bounds

# The patterns of each kind of expression, in the order in which kinds are listed; confidence of each.
_LONG = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
_UNITS = "days?|weeks?|months?|years?|hours?|minutes?|seconds?"
PATTERNS = {
    "iso_date": r"\b(\d{4}-\d{2}-\d{2})(?:T\d{2}:\d{2}:\d{2}(?:\.\d{1,3})?(?:Z|[+-]\d{2}:?\d{2})?)?\b",
    "iso_month": r"\b(\d{4})-(0[1-9]|1[0-2])\b(?!-\d{2})",
    "month": rf"(?i)\b({_LONG})\s+(\d{{4}})\b",
    "year": r"\b(?:19\d{2}|20\d{2}|21\d{2})\b",
    "date": rf"(?i)\b(?:{_LONG})\s+\d{{1,2}}(?:,?\s+\d{{4}})?\b",
    "relative": r"(?i)\b(?:yesterday|today|tomorrow|last\s+(?:week|month|year|day|hour)|next\s+(?:week|month|year|day|hour))\b",
    "offset": rf"(?i)\b(?:(in)\s+(\d+)\s+({_UNITS})|(\d+)\s+({_UNITS})\s+(?:ago|from now|in the past|in the future))\b",
    "duration": rf"(?i)\b(?:for|during|over)\s+(\d+)\s+(?:{_UNITS})\b",
    "frequency": r"(?i)\b(?:daily|weekly|monthly|yearly|hourly|every\s+(?:day|week|month|year)|once\s+a\s+(?:day|week|month|year))\b",
}
CONFIDENCE = {"iso_date": 0.95, "iso_month": 0.95, "month": 0.9, "year": 0.85, "date": 0.85, "relative": 0.9, "offset": 0.85, "duration": 0.8, "frequency": 0.85}
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec"
# End of the fixed values.
#: Characters that expressions of each kind start with; all end with a word character.
STARTS = {
    "iso_date": "0-9", "iso_month": "0-9", "month": "JFMASONDjfmasond", "year": "12", "date": "JFMASONDjfmasond", "relative": "YTLNytln",
    "offset": "0-9Ii", "duration": "FDOfdo", "frequency": "DWMYHEOdwmyheo",
}
FAST = {k: word_bounds(p, STARTS[k]) for k, p in PATTERNS.items()}

SECOND, MINUTE, HOUR, DAY = 1000, 60_000, 3_600_000, 86_400_000
UNIT_MS = {"second": SECOND, "minute": MINUTE, "hour": HOUR, "day": DAY, "week": 7 * DAY, "month": 30 * DAY, "year": 365 * DAY}
#: The most days that an offset may span.
FAR = 50_000_000
STRUCT = "struct<kind: string, value: string, start: bigint, end: bigint, precision: string, duration: bigint, frequency: string, confidence: double>"


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def local(ms: Column, zone: str) -> Column:
    """The clock of the zone at an instant, as milliseconds."""
    return F.unix_millis(F.from_utc_timestamp(F.timestamp_millis(ms), zone))


def instant(clock: Column, zone: str) -> Column:
    """The instant at which the zone's clock shows a time; see above for times that occur twice or not at all."""
    back = lambda c: F.unix_millis(F.to_utc_timestamp(F.timestamp_millis(c), zone))
    tries = F.transform(F.sequence(F.lit(1), F.lit(180)), lambda m: clock + m * MINUTE)
    first = F.array_min(F.transform(F.filter(tries, lambda c: local(back(c), zone) == c), back))
    return F.when(local(back(clock), zone) == clock, back(clock)).otherwise(first)


def _ms(date: Column) -> Column:
    return F.unix_date(date).cast("long") * DAY


def _date(clock: Column) -> Column:
    return F.date_from_unix_date(F.floor(clock / DAY).cast("int"))


def _month_number(name: Column) -> Column:
    return F.array_position(F.split(F.lit(MONTHS), " "), F.lower(F.substring(name, 1, 3)))


def _made(kind: str, value: Column, start=None, end=None, precision=None, duration=None, frequency=None) -> Column:
    none = lambda c, t: F.lit(None).cast(t) if c is None else c.cast(t)
    said = F.lit(precision) if isinstance(precision, str) else precision
    parts = {"start": none(start, "long"), "end": none(end, "long"), "precision": none(said, "string"), "duration": none(duration, "long"), "frequency": none(frequency, "string")}
    return F.struct(F.lit({"duration": "duration", "frequency": "frequency", "relative": "relative", "offset": "relative"}.get(kind, "absolute")).alias("kind"), value.alias("value"), *(c.alias(k) for k, c in parts.items()), F.lit(CONFIDENCE[kind]).alias("confidence"))


def expressions(text: Column, at_ms: Column, zone: str = "UTC") -> Column:
    """array of STRUCT: the text's expressions by kind and place; end is exclusive, and equals start of an instant or an
    offset in days or more. at_ms: what relative ones refer to."""
    zoneinfo.ZoneInfo(zone)
    got = lambda v, p, i: F.nullif(F.regexp_extract(v, ascii_bounds(p), i), F.lit(""))
    number = lambda v, p, i: got(v, p, i).try_cast("long")
    here = lambda date: instant(_ms(date), zone)
    content = F.coalesce(text, F.lit(""))

    def span(kind, v, date, months=0, days=0, precision="day") -> Column:
        """From a date to the same, some months and days later."""
        return _let(date, lambda d: F.when(d.isNotNull(), _made(kind, v, here(d), here(F.date_add(F.add_months(d, F.lit(months)), days)), precision)))

    def iso_date(v: Column) -> Column:
        clock = r"T(\d{2}):(\d{2}):(\d{2})(?:\.(\d{1,3}))?"
        shift = r"([+-])(\d{2}):?(\d{2})$"
        of_day = number(v, clock, 1) * HOUR + number(v, clock, 2) * MINUTE + number(v, clock, 3) * SECOND + F.coalesce(F.rpad(got(v, clock, 4), 3, "0").try_cast("long"), F.lit(0))
        sound = (number(v, clock, 1) < 24) & (number(v, clock, 2) < 60) & (number(v, clock, 3) < 60)
        away = (number(v, shift, 2) * HOUR + number(v, shift, 3) * MINUTE) * F.when(got(v, shift, 1) == "-", -1).otherwise(1)
        date = F.try_to_date(F.substring(v, 1, 10), "yyyy-MM-dd")
        wall = _ms(date) + of_day
        whole = wall - F.pmod(wall, F.lit(SECOND))
        ms = F.when(v.endswith("Z"), wall).when(got(v, clock + shift, 0).isNotNull(), wall - away).otherwise(instant(whole, zone) + F.pmod(wall, F.lit(SECOND)))
        return F.when(~v.contains("T"), span("iso_date", v, date, days=1)).when(sound & date.isNotNull(), _made("iso_date", v, ms, ms, "instant"))

    def first_of(year: Column, month: Column) -> Column:
        return F.make_date(year.cast("int"), month.cast("int"), F.lit(1))

    def iso_month(v: Column) -> Column:
        return span("iso_month", v, first_of(number(v, PATTERNS["iso_month"], 1), number(v, PATTERNS["iso_month"], 2)), months=1, precision="month")

    def month(v: Column) -> Column:
        return span("month", v, first_of(number(v, PATTERNS["month"], 2), _month_number(v)), months=1, precision="month")

    def year(v: Column) -> Column:
        return span("year", v, first_of(v.cast("int"), F.lit(1)), months=12, precision="year")

    def date(v: Column) -> Column:
        day, named = number(v, r"\s(\d{1,2})\b", 1), got(v, r"(\d{4})$", 1).try_cast("int")
        return span("date", v, F.try_to_date(F.format_string("%04d-%02d-%02d", F.coalesce(named, F.year(_date(local(at_ms, zone)))), _month_number(v).cast("int"), day.cast("int")), "yyyy-MM-dd"), days=1)

    def relative(v: Column) -> Column:
        today = _date(local(at_ms, zone))
        word = F.regexp_replace(F.lower(v), r"\s+", " ")
        sign = F.when(word.startswith("last") | (word == "yesterday"), -1).when(word == "today", 0).otherwise(1)
        monday = F.date_sub(today, F.pmod(F.unix_date(today) + 3, F.lit(7)))
        months = F.when(word.endswith("month"), 1).when(word.endswith("year"), 12)
        begin = F.when(word.endswith("year"), F.trunc(today, "year")).otherwise(F.trunc(today, "month"))
        hour = F.when(sign < 0, at_ms - HOUR).otherwise(at_ms)
        return (
            F.when(word.endswith("hour"), _made("relative", v, hour, hour + HOUR, "hour"))
            .when(word.endswith("week"), span("relative", v, F.date_add(monday, sign * 7), days=7, precision="week"))
            .when(months.isNotNull(), _let(F.struct(F.add_months(begin, sign * months).alias("a"), F.add_months(begin, (sign + 1) * months).alias("b")), lambda x: _made("relative", v, here(x["a"]), here(x["b"]), F.when(months == 1, "month").otherwise("year"))))
            .otherwise(span("relative", v, F.date_add(today, sign), days=1))
        )

    def offset(v: Column) -> Column:
        word = F.lower(v)
        n, unit = number(v, r"(\d+)", 1), got(word, r"\d+\s+(day|week|month|year|hour|minute|second)", 1)
        n = n * F.when(word.contains("ago") | word.contains("past"), -1).otherwise(1)
        size = F.coalesce(*(F.when(unit == u, ms) for u, ms in UNIT_MS.items()))
        near = F.coalesce((n != 0) & (F.abs(n) <= F.floor(F.lit(FAR * DAY) / size)), F.lit(False))
        clock = local(at_ms, zone)
        whole = clock - F.pmod(clock, F.lit(SECOND))
        date = _date(whole)
        moved = F.when(unit == "day", F.date_add(date, n.cast("int"))).when(unit == "week", F.date_add(date, (n * 7).cast("int"))).when(unit == "month", F.add_months(date, n.cast("int"))).otherwise(F.add_months(date, (n * 12).cast("int")))
        there = instant(_ms(moved) + F.pmod(whole, F.lit(DAY)), zone) + F.pmod(at_ms, F.lit(SECOND))
        exact = at_ms + n * size
        begin = exact - F.pmod(exact, size)
        read = F.when(unit.isin("day", "week", "month", "year"), _made("offset", v, there, there, "day")).otherwise(_made("offset", v, begin, begin + size, unit))
        return F.when(near, read)

    def duration(v: Column) -> Column:
        n, unit = number(v, r"(\d+)", 1), got(F.lower(v), r"\d+\s+(day|week|month|year|hour|minute|second)", 1)
        size = F.coalesce(*(F.when(unit == u, ms) for u, ms in UNIT_MS.items()))
        fits = F.coalesce((n > 0) & (n <= F.floor(F.lit(1 << 53) / size)), F.lit(False))
        return F.when(fits, _made("duration", v, duration=n * size))

    def frequency(v: Column) -> Column:
        return _made("frequency", v, frequency=F.lower(v))

    plain = content
    for kind in ("iso_date", "date", "iso_month", "month"):
        plain = F.regexp_replace(plain, FAST[kind], " ")
    readers = {"iso_date": iso_date, "iso_month": iso_month, "month": month, "year": year, "date": date, "relative": relative, "offset": offset, "duration": duration, "frequency": frequency}
    found = [F.transform(F.regexp_extract_all(plain if k == "year" else content, F.lit(p), F.lit(0)), readers[k]) for k, p in FAST.items()]
    return F.filter(F.concat(*(f.cast(f"array<{STRUCT}>") for f in found)), lambda x: x.isNotNull())
