"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import audit, bpe, exact_dedup, fingerprint, jaccard, langid, line_dedup, packing, quality, repeats, toxicity, urls, whitening
from spindrift.llm.tables import documents, held_out, table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(documents(spark, sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.near_next(documents(spark, sf_dir))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    model = langid.train(docs.filter(~held_out()))
    return langid.identify(docs, model, "doc_id").select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_boilerplate(documents(spark, sf_dir, "doc_id", "source", "text"))
    return out.select("doc_id", F.col("source").alias("host"), "n_lines", "n_dropped", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(documents(spark, sf_dir, "doc_id", "text", "source"), table(spark, sf_dir, "labels"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def pages_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10 over raw web pages: the site is the URL's host, a line is a tag with the text that follows it."""
    pages = table(spark, sf_dir, "pages").select("page_id", line_dedup.host(F.col("url")).alias("host"), F.replace("html", F.lit("<"), F.lit("\n<")).alias("html"))
    out = line_dedup.drop_boilerplate(pages, "host", "html", 0.5, 3)
    return out.select("page_id", "host", "n_lines", "n_dropped", F.sha2(F.coalesce(F.col("html"), F.lit("")).cast("binary"), 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality, op2_exact_dedup, op3_toxicity, op4_jaccard, op5_repeats, op6_packing, op7_fingerprint, op8_language,
        op9_bpe, op10_line_dedup, op11_filter_audit, op12_url_filter, op13_whitening, pages_line_dedup,
    )
}


def _lines_sql(key: str, rows: str, least: int, ratio: float) -> str:
    """Site-relative boilerplate lines of `rows` (key, host, text) in SQL."""
    return f"""
        WITH page AS (SELECT row_number() OVER () AS page, * FROM ({rows})),
        split AS (SELECT page, host, string_split(text, chr(10)) AS lines FROM page WHERE text IS NOT NULL),
        line AS (SELECT page, host, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split),
        total AS (SELECT host, count(*) AS pages FROM page GROUP BY host),
        boiler AS (
            SELECT l.host, trim(l.line) AS line FROM line l JOIN total t ON l.host IS NOT DISTINCT FROM t.host
            WHERE trim(l.line) <> '' GROUP BY l.host, trim(l.line), t.pages
            HAVING count(DISTINCT l.page) >= {least} AND count(DISTINCT l.page) > {ratio} * t.pages),
        marked AS (
            SELECT l.page, l.line, l.pos, b.line IS NOT NULL AS dropped
            FROM line l LEFT JOIN boiler b ON l.host IS NOT DISTINCT FROM b.host AND trim(l.line) = b.line),
        kept AS (
            SELECT page, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
                   coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '') AS text
            FROM marked GROUP BY page)
        SELECT p.{key}, p.host, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped,
               sha256(coalesce(k.text, '')) AS kept_sha256
        FROM page p LEFT JOIN kept k USING (page)"""


CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

ORACLES = {
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op4_jaccard": f"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{CAPITALS.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM d),
        t AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS m, b.n AS n, count(*) AS k FROM t a JOIN t b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p WHERE 100 * k >= 75 * (m + n - k)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
        c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
        SELECT s.doc_id, len(s.s) AS n_shingles, c.component_id FROM s JOIN c ON c.a = s.doc_id""",
    "op5_repeats": """
        WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
        k AS (SELECT doc_id, i, b[i + 1:i + 50] AS s FROM (SELECT doc_id, b, unnest(range(0, n - 49)) AS i FROM d)),
        f AS (SELECT s, min(doc_id) AS first FROM k GROUP BY s HAVING count(*) > 1),
        g AS (SELECT k.doc_id, i FROM k JOIN f USING (s) WHERE first < k.doc_id),
        m AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM g),
        r AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM m),
        u AS (SELECT doc_id, run, min(i) AS lo, max(i) + 50 AS hi FROM r GROUP BY doc_id, run),
        v AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM u),
        x AS (
            SELECT doc_id, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans, max(hi) AS last,
                   string_agg(CASE WHEN lo > before THEN hex(b[before + 1:lo]) ELSE '' END, '' ORDER BY lo) AS head FROM v JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(coalesce(head, '') || CASE WHEN n > coalesce(last, 0) THEN hex(b[coalesce(last, 0) + 1:n]) ELSE '' END)) AS kept_sha256
        FROM d LEFT JOIN x USING (doc_id)""",
    "op10_line_dedup": _lines_sql("doc_id", "SELECT doc_id, source AS host, text FROM documents", 5, 0.08),
    "op11_filter_audit": f"""
        WITH RECURSIVE d AS (
            SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                   coalesce(doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')), false) AS again FROM documents),
        k AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS bad FROM labels GROUP BY doc_id),
        m AS (
            SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
                   CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * list_unique(w) < 50 * len(w) THEN 'B' ELSE '' END
                   || CASE WHEN 100 * (length(t) - length(translate(t, '{CAPITALS}', ''))) > 2 * length(t) THEN 'C' ELSE '' END
                   || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN again THEN 'E' ELSE '' END AS fails
            FROM d LEFT JOIN k USING (doc_id)),
        o AS (
            SELECT c AS filter_order FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) f(c)
            UNION ALL SELECT filter_order || c FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) f(c) WHERE NOT contains(filter_order, c)),
        s AS (
            SELECT filter_order, step, filter_order[step] AS f, left(filter_order, step - 1) AS before
            FROM (SELECT filter_order, unnest(range(1, 6))::INT AS step FROM o WHERE length(filter_order) = 5)),
        n AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM m GROUP BY ALL),
        x AS (
            SELECT n.*, s.filter_order, s.step, contains(fails, f) AS mine,
                   before <> '' AND regexp_matches(fails, '[' || before || '_]') AS gone, fails = f AS only_mine FROM n, s),
        r AS (
            SELECT part, filter_order, step,
                   coalesce(sum(n) FILTER (NOT gone AND NOT mine), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mine AND NOT gone), 0)::BIGINT AS removed,
                   coalesce(sum(n) FILTER (mine AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (only_mine), 0)::BIGINT AS unique_fails,
                   coalesce(sum(good) FILTER (mine AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(bad) FILTER (mine AND NOT gone), 0)::BIGINT AS toxic_lost
            FROM x GROUP BY ALL)
        SELECT r.*, sum(removed) OVER (PARTITION BY part, filter_order[step])::BIGINT AS shapley FROM r""",
    "op12_url_filter": f"""
        WITH a AS (
            SELECT row_number() OVER () AS row, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        h AS (
            SELECT row, page_id, rest, translate(regexp_extract(rest, '^[^/?#]*'), '{CAPITALS}', '{CAPITALS.lower()}') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
        f(verdict, h, p) AS (VALUES {", ".join(map(str, urls.RULES))}),
        r AS (
            SELECT row, max_by(f.h || f.p, length(f.h || f.p)) AS rule, max_by(f.verdict, length(f.h || f.p)) AS verdict
            FROM h JOIN f ON (host = f.h OR ends_with(host, '.' || f.h)) AND starts_with(path, f.p) GROUP BY row),
        c AS (
            SELECT row, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':(80|443)?$', ''), '\\.+$', '') AS ch,
                   regexp_replace(regexp_replace(path, '/+', '/', 'g'), '/$', '') AS cp,
                   array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1), '&'),
                       lambda p: p <> '' AND NOT regexp_matches(p, '{urls.TRACKING}'))), '&') AS q FROM h),
        u AS (SELECT h.*, rule, verdict, CASE WHEN ch <> '' THEN ch || cp || CASE WHEN q = '' THEN '' ELSE '?' || q END END AS canonical
              FROM h JOIN c USING (row) LEFT JOIN r USING (row)),
        b AS (SELECT DISTINCT canonical, 'block' AS listed FROM u WHERE verdict = 'block')
        SELECT page_id, host, path, rule, coalesce(verdict, listed, 'allow') AS verdict FROM u LEFT JOIN b USING (canonical)""",
    "pages_line_dedup": _lines_sql(
        "page_id",
        """SELECT page_id, coalesce(nullif(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)', 1)), ''), url) AS host,
                  replace(html, '<', chr(10) || '<') AS text FROM pages""",
        3, 0.5,
    ),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
