"""Site-relative boilerplate lines, with DataFrame operations only.

A line is boilerplate on a site if more than `ratio` of the site's pages hold it, and at least `min_pages` of
them. Lines are compared trimmed of spaces; empty lines are never dropped. Pages of a site are counted as rows.

The lists of dropped lines are joined back by site. A list has a proven bound: a site whose pages have L
different lines each on average has fewer than L / ratio lines above the ratio. Spark broadcasts the lists
only under its own measured size threshold; beyond it, the sort-merge join's skew handling splits a hot site.

Defined results: a null text stays null and has no lines; a null site is one site of its own; ties at the
ratio stay; an empty table gives an empty table; other columns are passed through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.tables import named, written

RATIO = 0.08
MIN_PAGES = 5


def _key(line: Column) -> Column:
    return F.unhex(F.md5(F.trim(line).cast("binary")))


def _site(site: str) -> Column:
    return F.struct(F.col(site).isNull().alias("none"), F.coalesce(F.col(site).cast("string"), F.lit("")).alias("name"))


def host(url: Column) -> Column:
    """The site of a page: the host of its URL in lower case, or the whole of what isn't a URL with a host."""
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), url)


def boilerplate(docs: DataFrame, site: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """_site, _drop: each site's boilerplate lines as an array of keys; sites without any are left out."""
    pages = docs.select(_site(site).alias("_site"), F.col(text).alias("_text"))
    own = F.array_distinct(F.transform(F.filter(F.split("_text", "\n", -1), lambda x: F.trim(x) != ""), _key))
    lines = pages.select("_site", F.explode(own).alias("_line")).groupBy("_site", "_line").agg(F.count("*").alias("_with"))
    totals = pages.groupBy("_site").agg(F.count("*").alias("_pages"))
    return (
        lines.filter(F.col("_with") >= min_pages)
        .join(totals, "_site")
        .filter(F.col("_with") > F.lit(ratio) * F.col("_pages"))
        .groupBy("_site")
        .agg(F.collect_set("_line").alias("_drop"))
    )


def drop_boilerplate(docs: DataFrame, site: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """docs with boilerplate lines taken out of `text`, and the columns n_lines and n_dropped added."""
    drop = written(boilerplate(docs, site, text, ratio, min_pages))  # small, and of a known size when the join is planned
    own = docs.select(F.struct(*named(*docs.columns)).alias("_row"), _site(site).alias("_site"), F.col(text).alias("_body")).join(drop, "_site", "left")
    lines = F.split("_body", "\n", -1)
    own = own.withColumn("_lines", lines).withColumn("_here", F.array_intersect(F.transform("_lines", _key), "_drop"))  # by hashing: a page holds few
    kept = F.when(F.coalesce(F.size("_here") < 1, F.lit(True)), F.col("_lines")).otherwise(F.filter("_lines", lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("_here"), _key(x))))
    own = own.select("_row", "_body", "_lines", kept.alias("_kept"), F.col("_drop").isNull().alias("_same"))
    return own.select(
        *(
            F.when(F.col("_same"), F.col("_body")).otherwise(F.array_join("_kept", "\n")).alias(text) if c == text else F.col("_row")[c].alias(c)
            for c in docs.columns if c not in ("n_lines", "n_dropped")
        ),
        F.when(F.col("_body").isNull(), F.lit(0)).otherwise(F.size("_lines")).cast("long").alias("n_lines"),
        F.when(F.col("_body").isNull(), F.lit(0)).otherwise(F.size("_lines") - F.size("_kept")).cast("long").alias("n_dropped"),
    )
