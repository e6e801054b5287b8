"""Scores and bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import RANK_SEVERITY, RANK_TYPE, RANKERS
from ._lift import clip, col, lookup


def actionability(ready, confidence, text) -> Column:
    """Copy-paste readiness, confidence and shortness of a suggestion; 0 without one."""
    c, t = col(confidence), col(text)
    lines = F.size(F.split(t, "\n"))
    parts = F.when(col(ready), 2.0).otherwise(0.0) + F.when(c >= 0.9, 1.5).when(c >= 0.8, 1.0).when(c >= 0.7, 0.5).otherwise(0.0) + F.when(t.isNull() | (t == ""), 0.0).when(lines <= 5, 1.0).when(lines <= 10, 0.5).otherwise(0.0)
    return F.coalesce(parts, F.lit(0.0))


def rank_score(severity, confidence, issue_type, action: Column, strategy: str = "balanced") -> Column:
    """Severity + 5 confidence + impact + actionability - penalty; a strategy doubles one term."""
    times = {"severity_first": (2, 1, 1), "confidence_first": (1, 2, 1), "impact_first": (1, 1, 2)}.get(strategy, (1, 1, 1))
    c = col(confidence)
    penalty = F.when(c < 0.5, 2.0).otherwise(0.0) + F.when(col(issue_type).isin("description_outdated", "example_invalid"), 0.5).otherwise(0.0)
    return lookup(col(severity), RANK_SEVERITY, 1.0) * times[0] + c * 5.0 * times[1] + lookup(col(issue_type), RANK_TYPE, 1.0) * times[2] + action - penalty


def passes(ranker: str, severity: Column, confidence: Column, ready: Column) -> Column:
    """Whether a ranker of the settings lets a finding through: sure enough, of a severity that
    it takes, and ready to paste where it takes only such."""
    rule = RANKERS[ranker]
    out = F.coalesce(confidence >= rule["least"], F.lit(False))
    if rule["severities"] is not None:
        out = out & F.coalesce(severity.isin(*rule["severities"]), F.lit(False))
    return out & F.coalesce(ready, F.lit(False)) if rule["ready"] == "only" else out


def weighted_score(severity: Column, confidence: Column, impact: Column, ease: Column) -> Column:
    return 0.4 * severity + 0.3 * confidence + 0.2 * impact + 0.1 * ease


def semantic_adjusted(similarity: Column, pattern: Column, name_similarity: Column, distance: Column) -> Column:
    """A pattern raises a vector similarity, unlike names and far modules lower it."""
    return clip(similarity + F.when(pattern, 0.05).when(name_similarity < 0.3, -0.1).otherwise(0.0) - F.when(distance > 2, 0.1).otherwise(0.0))


def confidence_band(similarity) -> Column:
    s = col(similarity)
    return F.when(s >= 0.85, 0.9).when(s >= 0.75, 0.75).when(s >= 0.65, 0.65).otherwise(0.5)


def complexity(n_params: Column, all_typed: Column, has_return: Column) -> Column:
    """1 to 5."""
    return F.least(1 + (n_params >= 3).cast("int") + (n_params >= 5).cast("int") + all_typed.cast("int") + has_return.cast("int"), F.lit(5))


def complexity_match(a: Column, b: Column) -> Column:
    return 1.0 / (1.0 + F.abs(a - b) * 0.5)


def recency(timestamp: Column, as_of: Column) -> Column:
    """Of accepted examples; both in epoch seconds."""
    return 1.0 / (1.0 + (as_of - timestamp) / 86400 * 0.1)


def estimate_tokens(text) -> Column:
    return F.floor(F.length(F.coalesce(col(text), F.lit(""))) / 4) + 750


def estimate_cost(tokens: Column, per_thousand: Column) -> Column:
    return F.round(tokens / 1000 * per_thousand, 6)


def acceptance_probability(base: Column, quality: Column) -> Column:
    """Three bands of quality scale a base rate."""
    return clip(base * F.when(quality < 0.3, 0.2).when(quality < 0.5, 0.6).otherwise(0.8 + 0.8 * (quality - 0.5)))


def retry_delay(attempt: Column, base: float = 1.0, cap: float = 60.0) -> Column:
    return F.least(F.lit(cap), base * F.pow(F.lit(2.0), attempt))
