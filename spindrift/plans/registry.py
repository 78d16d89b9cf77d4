"""Registration of queries with their SQL oracles, and the views that queries read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The reference time of all queries: 2024-02-01 00:00:00 UTC, in seconds.
AS_OF = 1706745600

#: How the documents of the test data stand for records of the engine. Plain integer arithmetic on doc_id, valid in
#: Spark and in DuckDB, so that both sides start from the same rows.
MEMORY = {
    "id": "doc_id",
    "content": "text",
    "lang": "lang",
    "source": "source",
    "kind": "CASE doc_id % 5 WHEN 0 THEN 'fact' WHEN 1 THEN 'preference' WHEN 2 THEN 'decision' WHEN 3 THEN 'observation' ELSE 'context' END",
    "project": "CASE WHEN doc_id % 4 = 0 THEN NULL ELSE source END",
    "status": "CASE doc_id % 17 WHEN 0 THEN 'expired' WHEN 1 THEN 'archived' WHEN 2 THEN NULL WHEN 3 THEN 'superseded' ELSE 'active' END",
    "active": "CASE doc_id % 13 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END",
    "encrypted": "doc_id % 19 = 0",
    "created_s": "1706745600 - (doc_id % 400) * 86400 - doc_id",
    "valid_from_s": "CASE WHEN doc_id % 6 = 0 THEN NULL ELSE 1706745600 - (doc_id % 400) * 86400 - doc_id END",
    "valid_to_s": "CASE WHEN doc_id % 7 = 0 THEN 1706745600 - (doc_id % 50 - 10) * 86400 END",
    "superseded_s": "CASE WHEN doc_id % 11 = 0 THEN 1706745600 - (doc_id % 30 - 5) * 86400 END",
    "superseded_by": "CASE WHEN doc_id % 11 = 0 THEN doc_id + 1 END",
    "merged_into": "CASE WHEN doc_id % 23 = 0 THEN doc_id + 2 END",
    "importance": "(doc_id * 37) % 101",
    "accesses": "(doc_id * 7) % 13",
    "pinned": "doc_id % 50 = 0",
    "read_s": "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 1706745600 - (doc_id % 90) * 86400 END",
    "tier": "CASE doc_id % 4 WHEN 0 THEN 'sturdy' WHEN 1 THEN 'fleeting' WHEN 2 THEN 'long-term' ELSE 'working' END",
    "owner": "doc_id % 10",
    "team": "doc_id % 3",
    "level": "CASE doc_id % 4 WHEN 0 THEN 'certain' WHEN 1 THEN 'outdated' WHEN 2 THEN 'speculative' END",
    "semantic": "CAST((doc_id * 7919) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE)",
    "lexical": "CAST((doc_id * 104729) % 100 AS DOUBLE) / CAST(100 AS DOUBLE)",
    "lexical_rank": "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 1 + (doc_id * 31) % 20 END",
    "graph": "CAST(doc_id % 4 AS DOUBLE) / CAST(4 AS DOUBLE)",
    "conflict": "doc_id % 29 = 0",
}
#: The same as a common table expression named m.
M = "m AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in MEMORY.items()) + " FROM documents)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*(f"{MEMORY[c]} AS {c}" for c in columns or MEMORY))


def query(oracle: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with the SQL that must give the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add
