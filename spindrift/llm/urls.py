"""URL filters: rules by host and path, then a list of canonical URLs behind a blocked Bloom filter, native throughout.

A rule names a host and the start of a path; it fits that host and all hosts below it. Rules are a short list that
people write, so they are one expression over host and path; the longest that fits wins (of two as long, that of the
longer host). A URL that no rule fits is looked up in the list of blocked canonical URLs, which is a table of any size:

* The list becomes a blocked Bloom filter: a key's first hash picks a block, its second one a bit in each of the block's
  four words of 64 bits. A block is one row, so the filter is a groupBy with bit_or, and a look-up reads one row.
  16 bits a key, at most MAX_BLOCKS rows of 40 bytes: that bound is what lets it be broadcast. A longer list makes the
  filter pass more, which only costs time.
* What it passes is counted by URL, so that a URL that a third of all pages have is one row, and joined exactly, by hash,
  with the list, which removes false positives. The answer returns to the pages; URLs of very many pages are broadcast
  for that (1000 at most), so no task gets a hot one.

The canonical form of a URL: no scheme, user, default port, closing dots of the host or fragment; host in lower case; no
repeated or closing slashes in the path; parameters in order, without those that only track.

Defined results: a null URL, or one without "://", has an empty host and path, fits no rule and is in no list: allowed;
repeated rows count each; an empty list blocks nothing; an empty table gives no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.tables import spread_join, written

#: Verdict, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
KEY_BITS, WORDS = 16, 4
MAX_BLOCKS = 1 << 18
#: Parameters that only say where a visitor came from.
TRACKING = "^(utm_[^=]*|ref|fbclid|gclid)(=|$)"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _rest(url: Column) -> Column:
    """What follows the first ://; null without it."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = _rest(url)
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, CAPITALS, CAPITALS.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def canonical(url: Column) -> Column:
    """The canonical form; null where there is no host."""
    host, path = host_and_path(url)
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":(80|443)?$", ""), r"\.+$", "")
    path = F.regexp_replace(F.regexp_replace(path, "/+", "/"), "/$", "")
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.when(host != "", F.concat(host, path, F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept))))


def fitting(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule that fits as a struct of rule and verdict, or null."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, of, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(of + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _place(url: str, blocks: int) -> list[Column]:
    """The block of a key and its bit in each of the block's words."""
    bits = F.xxhash64(F.lit("bits"), url)
    masks = (F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS))
    return [F.pmod(F.xxhash64(url), F.lit(blocks)).alias("_block"), *(m.alias(f"_m{i}") for i, m in enumerate(masks))]


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """_block, _w0 to _w3: the filter of the column `url` of keys."""
    return keys.select(*_place("url", blocks)).groupBy("_block").agg(*(F.bit_or(f"_m{i}").alias(f"_w{i}") for i in range(WORDS)))


def possible(rows: DataFrame, words: DataFrame, blocks: int, url: str) -> DataFrame:
    """rows with the boolean _possible: whether the filter passes the URL (never, if it is null)."""
    placed = rows.select("*", *_place(url, blocks)).join(F.broadcast(words), "_block", "left")
    hit = F.col(url).isNotNull()
    for i in range(WORDS):
        hit &= F.col(f"_w{i}").bitwiseAND(F.col(f"_m{i}")) != 0
    return placed.select(*rows.columns, F.coalesce(hit, F.lit(False)).alias("_possible"))


def blocks_for(keys: int) -> int:
    """Blocks for that many keys: a power of two, MAX_BLOCKS at most."""
    return min(MAX_BLOCKS, 1 << max(0, (keys * KEY_BITS // (64 * WORDS))).bit_length())


def ruled(pages: DataFrame, rules: Sequence[tuple[str, str, str]], key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, verdict (null where no rule fits) and the canonical URL of every page."""
    host, path = host_and_path(F.col("_url"))
    own = pages.select(F.col(key).alias(key), F.col(url).alias("_url")).select(key, "_url", host.alias("host"), path.alias("path"))
    own = own.withColumn("_fit", fitting(F.col("host"), F.col("path"), rules))
    return own.select(key, "host", "path", F.col("_fit.rule").alias("rule"), F.col("_fit.verdict").alias("verdict"), canonical(F.col("_url")).alias("canonical"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, listed: DataFrame | None = None, key: str = "page_id", blocks: int | None = None) -> DataFrame:
    """key, host, path, rule, verdict of every page.

    listed: blocked canonical URLs, in its column url; None: those of the pages that a rule blocks, so that a page whose
    address was spelled differently (a port, a user, doubled slashes) to escape its rule is blocked all the same.
    """
    rows = ruled(pages, rules, key)
    if listed is None:
        listed = rows.filter("verdict = 'block'").select(F.col("canonical").alias("url"))
    listed = written(listed.select("url").filter("url IS NOT NULL").distinct())
    blocks = blocks or blocks_for(listed.count())
    words = written(bloom(listed, blocks))
    marked = possible(rows, words, blocks, "canonical").withColumn("_possible", F.col("_possible") & F.col("rule").isNull())
    asked = marked.filter("_possible").select(key, "host", "path", "rule", "canonical")
    counted = asked.groupBy("canonical").agg(F.count("*").alias("_rows"))
    exact = listed.select(F.col("url").alias("canonical"), F.lit("block").alias("_answer")).hint("shuffle_hash")
    answers = counted.join(exact, "canonical", "left").select("canonical", "_rows", F.coalesce("_answer", F.lit("allow")).alias("verdict"))
    columns = (key, "host", "path", "rule", "verdict")
    settled = marked.filter("NOT _possible").select(key, "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))
    return settled.unionByName(spread_join(asked, answers, ["canonical"], "_rows").select(*columns))
