"""Scores as Column expressions: decay, importance, tiers, boosts and calibrated recall confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400
# Forgetting rate by type, decay multiplier by tier, weight of a type in importance.
BETA = {"observation": 0.10, "context": 0.05, "fact": 0.02, "decision": 0.02, "preference": 0.01}
TIER = {"long-term": 0.5, "working": 1.0, "fleeting": 2.0}
TYPE_POINTS = {"decision": 15, "fact": 10, "preference": 8, "context": 5}


def lookup(c: Column, values: dict, default) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def retention(age_days: Column, kind: Column, tau: float = 1.0) -> Column:
    """(1 + t / tau) ^ -beta."""
    return clamp(F.pow(1 + F.greatest(age_days, F.lit(0.0)) / tau, -lookup(kind, BETA, 0.05)))


def tiered_decay(score: Column, age_days: Column, kind: Column, tier: Column, tau: float = 1.0) -> Column:
    """Sturdy rows keep their score; a multiplier under 1 shrinks time, one over 1 divides the score; a score of 0 counts as 100."""
    base = F.when(F.coalesce(score, F.lit(0)) == 0, F.lit(100.0)).otherwise(score.cast("double"))
    m = lookup(tier, TIER, 1.0)
    age = F.greatest(age_days, F.lit(0.0)) * F.least(m, F.lit(1.0))
    kept = F.pow(1 + age / tau, -lookup(kind, BETA, 0.05)) / F.greatest(m, F.lit(1.0))
    return F.when(tier == "sturdy", clamp(base, 0.0, 100.0)).otherwise(clamp(base * kept, 0.0, 100.0))


def half_life(strength: Column, age_days: Column, days: Column) -> Column:
    return strength * F.pow(F.lit(0.5), age_days / days)


def importance(age_days: Column, access_count: Column, kind: Column, flag: Column) -> Column:
    """50 + recency up to 30 + use up to 15 + type + flag points, within 0 and 100."""
    return clamp(50 + 30 * F.pow(F.lit(0.5), age_days / 30) + F.least(F.lit(15.0), 15 * F.log10(access_count + 1)) + lookup(kind, TYPE_POINTS, 0) + flag, 0.0, 100.0)


def blended_importance(base: Column, contradictions: Column, urgent: Column, important: Column) -> Column:
    """Half base, three tenths surprise (contradictions / 3, 0.5 without history), two tenths emotion."""
    surprise = F.coalesce(F.least(F.lit(1.0), contradictions / 3), F.lit(0.5))
    return 0.5 * base + 0.3 * surprise + 0.2 * (0.5 * urgent.cast("int") + 0.3 * important.cast("int"))


def tier(pinned: Column, importance: Column, accesses: Column, age_days: Column, idle_days: Column) -> Column:
    """sturdy, fleeting, long-term or working, first match wins. idle_days is null for rows never read."""
    recent = F.coalesce(idle_days <= 30, F.lit(False))
    return (
        F.when(pinned | ((accesses >= 5) & recent), "sturdy")
        .when((importance < 30) & (age_days > 30) & ~recent, "fleeting")
        .when((age_days > 90) & recent & (importance >= 70), "long-term")
        .otherwise("working")
    )


def recency_boost(age_hours: Column) -> Column:
    return 0.1 * F.exp(-age_hours / 720)


def capped(step: float, n: Column, most: float) -> Column:
    return F.least(F.lit(step) * n, F.lit(most))


def telemetry_boost(retrievals: Column, rate: Column) -> Column:
    return F.when(retrievals < 3, 1.0).when(rate >= 0.8, 1.5).when(rate >= 0.6, 1.2).when(rate >= 0.4, 1.0).when(rate >= 0.2, 0.8).otherwise(0.5)


def calibrated_base(semantic: Column) -> Column:
    return F.coalesce(1 / (1 + F.exp(-8 * (semantic - 0.5))), F.lit(0.02))


def agreement_bonus(lexical_rank: Column, lexical: Column, graph: Column) -> Column:
    return F.least(F.when(lexical_rank <= 3, 0.08).when(lexical >= 0.5, 0.04).otherwise(0.0) + F.when(graph > 0, 0.05).otherwise(0.0), F.lit(0.13))


def topical_factor(aligned: Column, absent: Column, unstated: Column) -> Column:
    """What an answer keeps of its confidence: little if it is about something else (less if all candidates are), most if
    it is so in part; and less if nothing that is known of the question's subject states what is asked."""
    other = F.when(absent, 0.3 * 0.85).otherwise(0.3)
    return F.when(aligned == 0, other).when(aligned == 0.7, 0.85).otherwise(1.0) * F.when(unstated, 0.45).otherwise(1.0)


def recall_confidence(semantic, lexical_rank, lexical, graph, gap, n, best, freshness, level, conflict, multi_signal=None, topical=None) -> Column:
    """Calibrated base and agreement, times the factors for topic, margin, retention, level and coverage; conflicts are capped.

    gap: distance of the best from the second of the candidates; n, best: their number and best score; multi_signal: whether
    the lexical leg has results at all, so that a high cosine alone is doubted; topical: topical_factor."""
    margin = F.when(n < 2, 1.0).when(gap >= 0.25, 1.05).when(gap <= 0.05, 0.9).otherwise(1.0)
    cover = F.when(n < 3, 0.9).otherwise(1.0) * F.when(best < 0.35, 0.8).otherwise(1.0)
    known = F.when(level == "certain", 1.0).when(level == "outdated", 0.7).otherwise(0.95)
    backed = F.coalesce(lexical_rank <= 10, F.lit(False)) | F.coalesce(lexical >= 0.5, F.lit(False)) | F.coalesce(graph > 0, F.lit(False))
    apart = F.when(multi_signal & (semantic >= 0.5) & ~backed, 0.8).otherwise(1.0) if multi_signal is not None else F.lit(1.0)
    apart = apart * topical if topical is not None else apart
    value = F.least(F.lit(1.0), calibrated_base(semantic) + agreement_bonus(lexical_rank, lexical, graph)) * apart * margin * (0.7 + 0.3 * F.coalesce(freshness, F.lit(1.0))) * known * cover
    return clamp(F.when(conflict, F.least(value, F.lit(0.55)) * 0.85).otherwise(value))


def confidence_tier(confidence: Column) -> Column:
    return F.when(confidence >= 0.9, "high").when(confidence >= 0.6, "qualified").otherwise("low")


def epoch_seconds(x: Column) -> Column:
    """Seconds from seconds or milliseconds, told apart at 1e11."""
    return F.when(F.abs(x) >= 100_000_000_000, x / 1000).otherwise(x.cast("double"))


def epoch_ladder(x: Column) -> Column:
    """Seconds from seconds, milliseconds or microseconds."""
    return F.when(F.abs(x) >= 100_000_000_000_000, x / 1_000_000).when(F.abs(x) >= 100_000_000_000, x / 1000).otherwise(x.cast("double"))
