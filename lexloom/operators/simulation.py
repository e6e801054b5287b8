"""Acceptance of suggestions, simulated: everything random is a hash of the suggestion's id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing, scores, stats
from ..functions._lift import lookup

# Issue types that are drawn, with their weights, and what each group accepts at best.
WEIGHTS = {"missing_params": 0.30, "missing_returns": 0.25, "missing_raises": 0.20, "description_outdated": 0.15, "parameter_type_mismatch": 0.10}
BASE = {"control": 0.6, "treatment": 0.75}


def weighted(uniform: Column, weights: dict[str, float]) -> Column:
    """The value in whose share of the unit interval the number lies."""
    out, total, names = F.lit(list(weights)[-1]), sum(weights.values()), list(weights.items())
    up_to = 0.0
    steps = []
    for name, w in names[:-1]:
        up_to += w / total
        steps.append((name, up_to))
    for name, bound in reversed(steps):
        out = F.when(uniform < bound, F.lit(name)).otherwise(out)
    return out


def drawn(ids: DataFrame, key: str, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """ids -> with issue_type, ab_group and quality, which the id decides."""
    return ids.select(key, weighted(hashing.uniform(key, ":type"), weights).alias("issue_type"), hashing.ab_group(F.col(key).cast("string")).alias("ab_group"), hashing.uniform(key, ":quality").alias("quality"))


def simulate(ids: DataFrame, key: str) -> DataFrame:
    """Each suggestion with its chance of acceptance and its events: generated, displayed, and
    accepted or rejected."""
    x = drawn(ids, key)
    chance = scores.acceptance_probability(lookup(F.col("ab_group"), BASE, 0.5), F.col("quality"))
    x = x.withColumn("chance", chance).withColumn("accepted", hashing.uniform(key, ":accept") < F.col("chance"))
    return x.withColumn("events", F.array(F.lit("generated"), F.lit("displayed"), F.when(F.col("accepted"), "accepted").otherwise("rejected")))


def results(simulated: DataFrame) -> DataFrame:
    """Totals and rates from event lists, by group and overall (group null)."""
    has = lambda e: F.count_if(F.array_contains("events", e))
    x = simulated.rollup("ab_group").agg(F.count("*").alias("total"), has("displayed").alias("shown"), has("accepted").alias("accepted"), has("rejected").alias("rejected"), F.avg("quality").alias("mean_quality"))
    return x.withColumn("rate", stats.rate(F.col("accepted"), F.col("shown")))


def accepted_examples(accepted: DataFrame, as_of: Column) -> DataFrame:
    """Accepted suggestions (function_id, name, signature, issue_type, suggested_text) as rows
    of the example corpus: quality 4, improvement 1."""
    return accepted.select(
        F.col("function_id").alias("example_id"), F.col("name").alias("function_name"), F.col("signature").alias("function_signature"), F.col("suggested_text").alias("docstring_content"), F.lit(4).alias("quality_score"), F.lit("accepted").alias("source"), as_of.alias("timestamp"),
        F.array("issue_type").alias("issue_types"), F.lit(1.0).alias("improvement_score"),
    )


def keyword_relevance(text: Column, issue_type: Column) -> Column:
    """The share of the issue's own words that the text has."""
    words = F.filter(F.split(F.regexp_replace(issue_type, "missing_|_mismatch|_outdated|_different", ""), "_"), lambda w: w != "")
    low = F.lower(text)
    stem = lambda w: F.regexp_replace(w, "s$", "")
    return F.when(F.size(words) > 0, F.size(F.filter(words, lambda w: F.contains(low, stem(w)))) / F.size(words)).otherwise(0.0)


def suggestion_quality(text: Column, issue_type: Column, confidence: Column, ready: Column, completeness: Column) -> Column:
    """The mean of five factors: some text, its completeness, keywords, confidence, readiness."""
    some = (F.length(F.trim(text)) >= 10).cast("int")
    return (some + completeness + keyword_relevance(text, issue_type) + confidence + ready.cast("int")) / 5
