"""Query over the expressions of time in every document: its own text, and a phrase that follows it."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions import time_expressions as te
from spindrift.plans.registry import query, table

PHRASES = (
    "due in 2 weeks", "done 1 month ago.", "seen 2024-02-30", "on 2024-06-15 and 2023-02", "at 2024-06-15T10:30:00Z", "at 2024-06-15T10:30:05.5+02:00.", "from 2024-01-01T00:00:00 on", "pilot in June 2025 and 2026",
    "on January 5, 2024 or Feb 29", "yesterday", "today and tomorrow", "last week or next month", "next week, last year", "last hour", "3 hours ago", "45 minutes from now", "for 2 hours daily", "over 3 weeks, every month",
    "20 seconds in the past", "13 months ago", "once a year", "0 days ago", "in 5 years", "nothing",
)
TEXT = "concat(coalesce(text, ''), ' ', CASE doc_id % 24 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PHRASES)) + " END)"
AT = "1706745600123 + doc_id * 7919000"

_P = {k: p.replace("(?!-\\d{2})", "") for k, p in te.PATTERNS.items()}
_MS = " ".join(f"WHEN '{u}' THEN {ms}" for u, ms in te.UNIT_MS.items())
_UNIT = "regexp_extract(lower(v), '[0-9]+\\s+(day|week|month|year|hour|minute|second)', 1)"
_DAY = "epoch_ms({}::TIMESTAMP)"
_NUMBER = "list_position(['" + "','".join(te.MONTHS.split()) + "'], lower(v[1:3]))"


def _found(kind: str, text: str = "t") -> str:
    return f"(SELECT id, ms, make_timestamp(ms * 1000) AS now, unnest(regexp_extract_all({text}, '{_P[kind]}')) AS v FROM x)"


def _dates(kind: str, source: str, start: str, step: str, precision: str) -> str:
    named = "relative" if kind == "relative" else "absolute"
    return f"SELECT id, '{named}' AS kind, v AS value, {_DAY.format('d')} AS start, {_DAY.format(f'(d + {step})')} AS end_, {precision} AS precision, NULL::BIGINT AS duration, NULL AS frequency, {te.CONFIDENCE[kind]} AS confidence FROM (SELECT *, {start} AS d FROM {source}) WHERE d IS NOT NULL"


_CLOCK = "v[12:13]::BIGINT * 3600000 + v[15:16]::BIGINT * 60000 + v[18:19]::BIGINT * 1000 + coalesce(try_cast(rpad(nullif(regexp_extract(v, '\\.([0-9]{1,3})', 1), ''), 3, '0') AS BIGINT), 0)"
_AWAY = "CASE WHEN regexp_matches(v, '[+-][0-9]{2}:?[0-9]{2}$') THEN CASE WHEN regexp_extract(v, '([+-])[0-9]{2}:?[0-9]{2}$', 1) = '-' THEN -1 ELSE 1 END * (regexp_extract(v, '([0-9]{2}):?([0-9]{2})$', 1)::BIGINT * 3600000 + regexp_extract(v, '([0-9]{2}):?([0-9]{2})$', 2)::BIGINT * 60000) ELSE 0 END"
_ISO = f"(SELECT *, try_strptime(v[1:10], '%Y-%m-%d') AS d0 FROM {_found('iso_date')})"
_WORD = "regexp_replace(lower(v), '\\s+', ' ', 'g')"
_SIGN = f"CASE WHEN starts_with({_WORD}, 'last') OR {_WORD} = 'yesterday' THEN -1 WHEN {_WORD} = 'today' THEN 0 ELSE 1 END"
_REL = f"(SELECT *, {_WORD} AS w, {_SIGN} AS g FROM {_found('relative')})"
_OFF = f"(SELECT *, CASE WHEN contains(lower(v), 'ago') OR contains(lower(v), 'past') THEN -1 ELSE 1 END * regexp_extract(v, '([0-9]+)', 1)::BIGINT AS n, {_UNIT} AS unit FROM {_found('offset')})"
SQL = f"""WITH x AS (SELECT doc_id AS id, {TEXT} AS t, {AT} AS ms FROM documents),
    x2 AS (SELECT id, ms, regexp_replace(t, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}', ' ', 'g') AS t FROM x),
    x3 AS (SELECT id, ms, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '{_P['iso_date']}', ' ', 'g'), '{_P['date']}', ' ', 'g'), '{_P['iso_month']}', ' ', 'g'), '{_P['month']}', ' ', 'g') AS t FROM x),
    e AS ({_dates('iso_date', f"(SELECT * FROM {_ISO} WHERE NOT contains(v, 'T'))", 'd0', 'INTERVAL 1 DAY', "'day'")}
        UNION ALL SELECT id, 'absolute', v, i, i, 'instant', NULL, NULL, 0.95 FROM (SELECT *, epoch_ms(d0) + {_CLOCK} - {_AWAY} AS i FROM {_ISO} WHERE contains(v, 'T') AND d0 IS NOT NULL)
        UNION ALL {_dates('iso_month', _found('iso_month').replace('FROM x)', 'FROM x2)'), "make_date(v[1:4]::INT, v[6:7]::INT, 1)", 'INTERVAL 1 MONTH', "'month'")}
        UNION ALL {_dates('month', _found('month'), f"make_date(right(v, 4)::INT, {_NUMBER}, 1)", 'INTERVAL 1 MONTH', "'month'")}
        UNION ALL {_dates('year', _found('year').replace('FROM x)', 'FROM x3)'), 'make_date(v::INT, 1, 1)', 'INTERVAL 1 YEAR', "'year'")}
        UNION ALL {_dates('date', _found('date'), f"try_strptime(coalesce(nullif(regexp_extract(v, '([0-9]{{4}})$', 1), ''), year(now)::VARCHAR) || '-' || lpad(({_NUMBER})::VARCHAR, 2, '0') || '-' || lpad(regexp_extract(v, '\\s([0-9]{{1,2}})\\b', 1), 2, '0'), '%Y-%m-%d')", 'INTERVAL 1 DAY', "'day'")}
        UNION ALL {_dates('relative', f"(SELECT * FROM {_REL} WHERE w IN ('yesterday', 'today', 'tomorrow', 'last day', 'next day'))", 'now::DATE + g', 'INTERVAL 1 DAY', "'day'")}
        UNION ALL {_dates('relative', f"(SELECT * FROM {_REL} WHERE ends_with(w, 'week'))", "date_trunc('week', now)::DATE + 7 * g", 'INTERVAL 7 DAY', "'week'")}
        UNION ALL {_dates('relative', f"(SELECT * FROM {_REL} WHERE ends_with(w, 'month'))", "date_trunc('month', now) + to_months(g)", 'INTERVAL 1 MONTH', "'month'")}
        UNION ALL {_dates('relative', f"(SELECT * FROM {_REL} WHERE ends_with(w, 'year'))", "date_trunc('year', now) + to_years(g)", 'INTERVAL 1 YEAR', "'year'")}
        UNION ALL SELECT id, 'relative', v, CASE g WHEN -1 THEN ms - 3600000 ELSE ms END, CASE g WHEN -1 THEN ms ELSE ms + 3600000 END, 'hour', NULL, NULL, 0.9 FROM {_REL} WHERE ends_with(w, 'hour')
        UNION ALL SELECT id, 'relative', v, i, i, 'day', NULL, NULL, 0.85 FROM (SELECT *, epoch_ms(now + CASE unit WHEN 'day' THEN to_days(n::INT) WHEN 'week' THEN to_days(7 * n::INT) WHEN 'month' THEN to_months(n::INT) ELSE to_years(n::INT) END) AS i
            FROM {_OFF} WHERE n <> 0 AND unit IN ('day', 'week', 'month', 'year'))
        UNION ALL SELECT id, 'relative', v, i - i % size, i - i % size + size, unit, NULL, NULL, 0.85 FROM (SELECT *, CASE unit {_MS} END AS size, ms + n * CASE unit {_MS} END AS i FROM {_OFF} WHERE n <> 0 AND unit IN ('hour', 'minute', 'second'))
        UNION ALL SELECT id, 'duration', v, NULL, NULL, NULL, n * CASE unit {_MS} END, NULL, 0.8 FROM (SELECT *, regexp_extract(v, '([0-9]+)', 1)::BIGINT AS n, {_UNIT} AS unit FROM {_found('duration')}) WHERE n > 0
        UNION ALL SELECT id, 'frequency', v, NULL, NULL, NULL, NULL, lower(v), 0.85 FROM {_found('frequency')})
    SELECT id, kind, value, start, end_ AS until, precision, duration, frequency, confidence::DOUBLE AS confidence FROM e"""


@query(SQL)
def time_expressions(spark, sf_dir):
    """Every expression of time in every document, read as of a time of its own."""
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id AS id", f"{TEXT} AS t", f"{AT} AS ms")
    found = rows.select("id", F.explode(te.expressions(F.col("t"), F.col("ms"))).alias("e"))
    return found.select("id", "e.kind", "e.value", "e.start", F.col("e.end").alias("until"), "e.precision", "e.duration", "e.frequency", "e.confidence")
