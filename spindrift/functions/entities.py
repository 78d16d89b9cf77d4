"""Entities that a text names, by kind: files, functions, classes, tools, design patterns, techniques, dates and concepts.

Defined results: a null text names none; each name counts once for its kind, with the confidence of the first pattern that finds it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions.text import ascii_bounds, word_bounds

# Kind, confidence, pattern and the group that holds the name, in the order in which they are tried.
PATTERNS = (
    ("file", 0.9, r"(?m)(?:^|[^\w])(?:\.?\/[\w.-]*[\w.-]*(?:\/[\w.-]+)*|[\w.-]+\.(?:ts|tsx|js|jsx|py|rb|go|java|cpp|c|h|json|yaml|yml|env|md|txt|csv|sql|graphql))\b", 0),
    ("function", 0.85, r"\b([a-zA-Z_$][a-zA-Z0-9_$]*)\s*\(", 1),
    ("class", 0.95, r"\b(?:class|new|extends|implements)\s+([A-Z][a-zA-Z0-9_$]*)\b", 1),
    ("tool", 0.9, r"\b(?:React|Vue|Angular|Node\.?js?|Express|Django|Flask|FastAPI|PostgreSQL|MongoDB|Redis|Docker|Kubernetes)\b", 0),
    ("pattern", 0.92, r"(?i)\b(?:abstract\s+)?(?:factory|singleton|observer|decorator|strategy|adapter)\s+(?:pattern|method)\b", 0),
    ("technique", 0.88, r"(?i)\b(?:memoization|caching|lazy\s+loading|debouncing|throttling)\b", 0),
    ("date", 0.95, r"\b(\d{4}-\d{2}-\d{2})(?:T\d{2}:\d{2}:\d{2})?\b", 0),
    ("concept", 0.8, r"""(?:['"])([^'"]{3,})(?:['"])""", 1),
    ("concept", 0.75, r"\b(?:[A-Z][a-z]+\s+)+(?:System|Architecture|Pattern|Model|Algorithm|Framework|Library|Process|Concept|Method)\b", 0),
)
#: Shortest name of a function.
LEAST = 3
# End of the fixed values.
#: Characters that the matches of some kinds' patterns start with; those of classes may end with a dollar sign.
STARTS = {"class": "cnei", "tool": "RVANEDFPMK", "pattern": "AFSODafsod", "technique": "MCLDTmcldt", "date": "0-9"}


def _fast(kind: str, pattern: str) -> str:
    """The pattern as Java reads it, without tries that can't succeed. A group that gives back what it took needs a frame of the
    stack for each time, so that runs of thousands of words or folders would end the JVM; possessive ones don't."""
    if kind == "file":  # all folders, if a word ends there
        pattern = pattern.replace(r"(?:\.?\/[\w.-]*[\w.-]*(?:\/[\w.-]+)*|", r"(?:\.?\/[\w.-]*+(?:\/[\w.-]++)*+\b|\.?\/[\w.-]*(?:\/[\w.-]+)*|")
    if kind == "function":  # a shorter name is followed by a character of the name
        pattern = pattern.replace("*)\\s*", "*+)\\s*+")
    if kind == "concept" and pattern.startswith(r"\b"):
        end = pattern[pattern.rindex("(") : pattern.rindex(")") + 1] + r"(?!\w)"
        words = rf"(?:(?!{end})[A-Z][a-z]++\s++)*+{end}"  # to the next end; the last one that can be reached counts
        inside = r"(?<!(?<!\w)[A-Z][a-z]{1,40}\s{1,3})"  # a run that has no match from its first word has none from another
        return rf"(?=[A-Z])(?<!\w){inside}[A-Z][a-z]++\s++{words}(?:\s++{words})*+"
    return word_bounds(pattern, STARTS[kind], kind != "class") if kind in STARTS else ascii_bounds(pattern)




def _made(kind: str, confidence: float, names: Column) -> Column:
    return F.transform(names, lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name"), F.lit(confidence).alias("confidence")))


def entities(text: Column) -> Column:
    """array of struct kind, name, confidence."""
    content = F.coalesce(text, F.lit(""))
    out, before = [], {}
    for kind, confidence, pattern, group in PATTERNS:
        names = F.regexp_extract_all(content, F.lit(_fast(kind, pattern)), F.lit(group))
        if kind == "file":
            names = F.transform(names, lambda n: F.trim(n, F.lit(" \t\n\r\f\v")))
        if kind == "function":
            names = F.filter(names, lambda n: F.length(n) >= LEAST)
        names = F.array_except(names, before[kind]) if kind in before else F.array_distinct(names)
        before[kind] = names
        out.append(_made(kind, confidence, names))
    return F.concat(*out)
