"""Merge proposals as an append-only log: what each step did, where each proposal stands, and what the records are then.

A log has proposal, at, seq and action. A proposal is opened by its first propose, decided by the first approve or reject after that, and an
approved one is taken back by the first reverse after its approval. So the state follows from three minima, each over what comes after
the last: they are combined within tasks, and a proposal with any number of steps is no single task.

An approval merges the proposal's sources into its canonical record; a source of several belongs to the one approved last, and a
reversal gives back only what still belongs to it. Records themselves are never changed by the log, so that reversing
restores every source as it was.

Defined results: steps go by at, then seq (nulls first); every other step is refused, with the reason: "missing" (before the
proposal), "open" (proposed again), "decided" (not pending any more), "not approved", "reversed" (again), "unknown" (another action,
or no proposal). Repeated rows of a step count once. An empty log leaves all records as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIONS = ("propose", "approve", "reject", "reverse")


def _when() -> Column:
    """The order of steps; comparable."""
    return F.struct(F.col("at").isNotNull().alias("known"), F.coalesce(F.col("at"), F.lit(0)).alias("at"), F.col("seq").isNotNull().alias("numbered"), F.coalesce(F.col("seq"), F.lit(0)).alias("seq"), F.col("action").alias("action"))


def _firsts(log: DataFrame) -> DataFrame:
    """proposal, opened, decision (its action), decided, reversed: the steps that counted."""
    steps = log.filter(F.col("proposal").isNotNull() & F.col("action").isin(*ACTIONS)).select("proposal", "action", _when().alias("w"))
    opened = steps.filter("action = 'propose'").groupBy("proposal").agg(F.min("w").alias("opened"))
    later = steps.filter("action IN ('approve', 'reject')").join(opened, "proposal").filter(F.col("w") > F.col("opened"))
    decided = later.groupBy("proposal").agg(F.min("w").alias("decided"))
    back = steps.filter("action = 'reverse'").join(decided.filter("decided.action = 'approve'"), "proposal").filter(F.col("w") > F.col("decided"))
    reverted = back.groupBy("proposal").agg(F.min("w").alias("reversed"))
    return opened.join(decided, "proposal", "left").join(reverted, "proposal", "left")


def states(log: DataFrame) -> DataFrame:
    """proposal, state (pending, approved, rejected, reversed), opened, decided, reversed (their steps' order)."""
    state = F.when(F.col("reversed").isNotNull(), "reversed").when(F.col("decided.action") == "approve", "approved").when(F.col("decided.action") == "reject", "rejected").otherwise("pending")
    return _firsts(log).select("proposal", state.alias("state"), "opened", "decided", "reversed")


def outcomes(log: DataFrame) -> DataFrame:
    """proposal, at, seq, action, outcome of every step: applied, or why it was refused."""
    own = log.select("proposal", "at", "seq", "action", _when().alias("w")).distinct()
    known = own.join(_firsts(log).withColumnRenamed("proposal", "_p"), F.col("proposal") == F.col("_p"), "left")
    w, opened, decided, reverted = (F.col(c) for c in ("w", "opened", "decided", "reversed"))
    counted = F.coalesce((w == opened) | (w == decided) | (w == reverted), F.lit(False))
    before = opened.isNull() | (w < opened)
    outcome = (
        F.when(F.col("proposal").isNull() | ~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False)), "unknown")
        .when(counted, "applied").when(before, "missing").when(F.col("action") == "propose", "open")
        .when(F.col("action") == "reverse", F.when(F.coalesce(w > reverted, F.lit(False)), "reversed").otherwise("not approved")).otherwise("decided")
    )
    return known.select("proposal", "at", "seq", "action", outcome.alias("outcome"))


def merged_into(log: DataFrame, sources: DataFrame) -> DataFrame:
    """id, proposal: the records (sources: proposal, id) that are merged now, each with the proposal that holds it."""
    approved = states(log).filter("state IN ('approved', 'reversed')").select("proposal", "decided", (F.col("state") == "approved").alias("stands"))
    of = sources.filter("id IS NOT NULL").select("proposal", "id").distinct().join(approved, "proposal")
    last = of.groupBy("id").agg(F.max(F.struct("decided", "proposal", "stands")).alias("x"))
    return last.filter("x.stands").select("id", "x.proposal")
