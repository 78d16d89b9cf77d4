"""Text functions: query terms, folded words, snippets, tags, budgets. All are Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a query never searches for.
STOPWORDS = frozenset((
    "a", "an", "and", "are", "as", "at", "be", "been", "but", "by", "did", "do", "does",
    "for", "from", "had", "has", "have", "how", "i", "if", "in", "into", "is", "it", "its",
    "last", "me", "my", "of", "on", "or", "our", "so", "that", "the", "their", "then",
    "there", "this", "time", "to", "was", "we", "were", "what", "when", "where", "which",
    "who", "why", "will", "with", "you",
))
RESERVED = frozenset("and or not near match rank order column phrase".split())


def ascii_bounds(pattern: str) -> str:
    r"""A pattern whose \b stands at the ends of words of ASCII letters, digits and underscores, as RE2 reads it. Java's \b
    takes other letters into words, so that "test\u00fc" wouldn't hold the word "test"."""
    return re.sub(r"\\.", lambda m: r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))" if m[0] == r"\b" else m[0], pattern)


def word_bounds(pattern: str, starts: str, word_ends: bool = True) -> str:
    r"""ascii_bounds, made to give up at once where no match can start: for a pattern that begins with \b and whose matches begin
    with a word character of the class `starts`. word_ends: each of its other \b follows a word character."""
    flags, rest = re.fullmatch(r"((?:\(\?\w+\))?)\\b(.*)", pattern, re.S).groups()
    rest = re.sub(r"\\.", lambda m: r"(?!\w)" if m[0] == r"\b" else m[0], rest) if word_ends else ascii_bounds(rest)
    return rf"{flags}(?=[{starts}])(?<!\w){rest}"


def query_terms(query: str) -> list[str]:
    """Words of more than two characters that aren't stopwords or reserved, in order, once each."""
    words = re.sub(r"[^\w\s]", " ", query.lower()).split()
    return list(dict.fromkeys(w for w in words if len(w) > 2 and w not in STOPWORDS and w not in RESERVED))


def parse_query(query: str) -> tuple[list[str], list[str], list[str]]:
    """Bare words, "phrases" and -exclusions, each once regardless of case."""
    phrases = re.findall(r'"([^"]+)"', query)
    rest = re.sub(r'"[^"]*"', " ", query).split()
    once = lambda xs: list(dict.fromkeys(x.lower() for x in xs if x))
    return once(w for w in rest if not w.startswith("-")), once(phrases), once(w[1:] for w in rest if w.startswith("-"))


def words(text: Column) -> Column:
    """Lower-case words of letters, digits and underscores (ASCII). array_remove stays in generated code, a lambda doesn't."""
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9_]+"), "")


def matched_share(text: Column, terms: list[str]) -> Column:
    """Share of the terms that occur in the text, as substrings."""
    return sum((F.lower(text).contains(t).cast("int") for t in terms), F.lit(0)) / F.lit(max(1, len(terms))).cast("double")


def snippet(text: Column, terms: list[str], most: int = 300, lead: int = 40) -> Column:
    """The sentence with the most terms (the first of ties); a long one is cut to start `lead` characters before its first hit."""
    hits = lambda s: sum((F.lower(s).contains(t).cast("int") for t in terms), F.lit(0))
    sentences = F.split(text, r"[.!?]\s+|\n+")
    best = F.array_max(F.transform(sentences, lambda s, i: F.struct(hits(s).alias("n"), (-i).alias("at"), s.alias("s"))))["s"]
    places = [F.locate(t, F.lower(best)) for t in terms]
    first = F.array_min(F.filter(F.array(*places), lambda p: p > 0))
    start = F.greatest(F.lit(1), F.coalesce(first, F.lit(1)) - lead)
    return F.when(F.length(best) <= most, best).otherwise(F.substring(best, start, F.lit(most)))


def normalize_tag(tag: Column) -> Column:
    t = F.regexp_replace(F.trim(F.lower(tag)), r"\s+", "-")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "^-+", ""), "-+$", ""), "-{2,}", "-")


def normalize_tags(tags: Column, least: int = 2, garbage: tuple[str, ...] = ("misc", "other", "none")) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(tags, normalize_tag), lambda t: (F.length(t) >= least) & ~t.isin(*garbage))))


def tokens(text: Column, per: int = 4) -> Column:
    """Estimated tokens: a character in four for prose and JSON, one in three for payloads."""
    return F.ceil(F.length(text) / per)


def truncate(text: Column, budget: int) -> Column:
    """At most `budget` estimated tokens, an ellipsis included where the text is cut."""
    return F.when(tokens(text) <= budget, text).otherwise(F.concat(F.substring(text, 1, max(0, budget * 4 - 3)), F.lit("...")))


def strip_private(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<private>.*?</private>", "")
