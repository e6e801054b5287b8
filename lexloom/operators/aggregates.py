"""Rates, percentiles, votes and rankings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import docs, stats
from ..functions._lift import lookup
from . import selection
from .windows import top_per_key


def acceptance(df: DataFrame, group: str, shown: Column, accepted: Column) -> DataFrame:
    """Rates by group and overall (group null) in one pass, with their intervals."""
    hits, n = F.count_if(shown & accepted), F.count_if(shown)
    out = df.rollup(group).agg(n.alias("shown"), hits.alias("accepted")).withColumn("rate", stats.rate(F.col("accepted"), F.col("shown")))
    ci = stats.wilson("accepted", "shown")
    return out.withColumn("ci_low", ci["low"]).withColumn("ci_high", ci["high"])


def improvement(control: Column, treatment: Column) -> Column:
    """In per cent of the control rate; 0 if that is 0."""
    return F.when(control == 0, 0.0).otherwise((treatment - control) / control * 100)


def operation_stats(df: DataFrame, operation: str, value: str, ok: Column) -> DataFrame:
    """Count, mean, extremes, exact percentiles and success rate of each operation."""
    out = df.groupBy(operation).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(ok.cast("int")).alias("success_rate")
    )
    return _with_percentiles(out, selection.percentiles(df, [operation], value, SHARES), [operation])


#: The percentiles that figures have: p50, p95, p99.
SHARES = (0.5, 0.95, 0.99)


def _with_percentiles(figures: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """figures with p50, p95 and p99; both have one row for each combination of keys."""
    named = found.select(*(F.col(k).alias(f"_{k}") for k in keys), *(F.get("p", F.lit(i)).alias(f"p{round(100 * s)}") for i, s in enumerate(SHARES)))
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys), F.lit(True))
    return figures.join(named, on, "left").drop(*(f"_{k}" for k in keys))


def counts_by(df: DataFrame, key: str, values: Sequence[str], of: str) -> DataFrame:
    """One column for each value, zero where it doesn't occur."""
    return df.groupBy(key).agg(*(F.count_if(F.col(of) == v).alias(v) for v in values))


def style_vote(scored: DataFrame, group: str, least_share: float = 0.4, default: str = "google") -> DataFrame:
    """(group, style, score) for each text -> the group's style: the largest sum of scores,
    if that is at least least_share of all."""
    sums = scored.groupBy(group, "style").agg(F.sum("score").alias("score"))
    total = sums.groupBy(group).agg(F.sum("score").alias("total"))
    best = top_per_key(sums, [group], [F.desc("score"), F.col("style")])
    return best.join(total, group).select(group, F.when((F.col("total") > 0) & (F.col("score") >= least_share * F.col("total")), F.col("style")).otherwise(default).alias("style"), "score", "total")


def style_of_projects(texts: DataFrame, project: str, id_: str, text: str, sample: int = 50, least_share: float = 0.4) -> DataFrame:
    """project, style, n: the vote of a sample of each project's texts, those ``sample`` whose ids
    have the smallest digests. Such a sample is the same whatever the partitioning, and each task
    sends no more than it of any project. The size of the sample is the setting of this operator."""
    bottom = top_per_key(texts.where(F.col(text).isNotNull()), [project], [F.sha2(F.col(id_).cast("string"), 256), F.col(id_)], sample)
    scored = bottom.select(project, docs.best_style(text).alias("b")).select(project, "b.style", "b.score")
    n = scored.groupBy(project).agg(F.count("*").alias("n"))
    return style_vote(scored, project, least_share).join(n, project).select(project, "style", "n")


def frequent_terms(terms: DataFrame, group: str, term: str, k: int = 10, least: int = 1) -> DataFrame:
    """The k most frequent terms of each group with at least ``least`` uses, ties by term."""
    n = terms.groupBy(group, term).agg(F.count("*").alias("uses")).where(F.col("uses") >= least)
    return top_per_key(n, [group], [F.desc("uses"), F.col(term)], k, "rank")


def at_least(terms: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """The combinations that occur at least n times, with their uses."""
    return terms.groupBy(*by).agg(F.count("*").alias("uses")).where(F.col("uses") >= n)


def advice(stats_: DataFrame, slow: float = 1.0, failing: float = 0.85) -> DataFrame:
    """What the figures of operation_stats suggest."""
    return stats_.withColumn("advice", F.array_compact(F.array(F.when(F.col("p95") > slow, "cache or batch"), F.when(F.col("most") > 10 * F.col("p50"), "set a timeout"), F.when(F.col("success_rate") < failing, "retry or inspect errors"))))


def performance_score(mean_ms: Column, hit_rate: Column, error_rate: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - mean_ms / 2000) * 0.4 + hit_rate * 0.3 + F.greatest(F.lit(0.0), 1 - error_rate / 0.1) * 0.3


def bottleneck(shares: dict[str, Column]) -> Column:
    """The phase with the largest share of time, if that is over half of it."""
    top = _largest(shares)
    return F.when(top["share"] > 0.5, top["phase"]).otherwise("balanced")


def _largest(shares: dict[str, Column]) -> Column:
    return F.array_max(F.array(*(F.struct(c.alias("share"), F.lit(k).alias("phase")) for k, c in shares.items())))


def load_profile(shares: dict[str, Column], memory_mb: Column) -> Column:
    """struct: the largest phase, how much it weighs, a label of memory, and advice."""
    top = _largest(shares)
    weight = F.when(top["share"] > 0.5, "dominant").when(top["share"] > 0.4, "heavy").when(top["share"] > 0.3, "notable").when(top["share"] > 0.2, "mild").otherwise("even")
    memory = F.when(memory_mb > 1000, "high").when(memory_mb > 500, "medium").otherwise("low")
    advice_ = F.array_compact(F.array(F.when(top["share"] > 0.4, F.concat(F.lit("look at "), top["phase"])), F.when(memory_mb > 1000, "smaller batches")))
    return F.struct(top["phase"].alias("phase"), weight.alias("weight"), memory.alias("memory"), advice_.alias("advice"))



def batch_summary(found: DataFrame, owner: str, sure: float = 0.8) -> DataFrame:
    """One row over all owners: how many, their findings, means, and how many have a sure one."""
    c = F.col("confidence")
    each = found.groupBy(owner).agg(F.count("*").alias("n"), F.avg(c).alias("c"), F.count_if(c >= sure).alias("good"))
    return each.agg(F.count("*").alias("owners"), F.sum("n").alias("issues"), F.avg("n").alias("mean_issues"), F.avg("c").alias("mean_confidence"), F.count_if(F.col("good") > 0).alias("with_good"))


def suggestion_batch(found: DataFrame, by: str = "issue_type", sure: float = 0.8) -> DataFrame:
    """Count, mean and extreme confidence, and sure ones, of each type."""
    c = F.col("confidence")
    return found.groupBy(by).agg(F.count("*").alias("n"), F.avg(c).alias("mean"), F.min(c).alias("least"), F.max(c).alias("most"), F.count_if(c >= sure).alias("good"))


def best_by_owner(found: DataFrame, owner: str, score: Column, n: int) -> DataFrame:
    """The n owners with the best finding, ties by owner."""
    return found.groupBy(owner).agg(F.max(score).alias("best")).orderBy(F.desc("best"), owner).limit(n)


def trend(ops: DataFrame, key: str, order: Sequence[Column], value: str, ok: Column, n: int = 100) -> DataFrame:
    """Means over the last n operations of each key."""
    last = top_per_key(ops, [key], order, n)
    return last.groupBy(key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.avg(ok.cast("int")).alias("success_rate"))


def most_frequent(rows: DataFrame, by: str, n: int = 5) -> DataFrame:
    """The n most frequent values, ties by value."""
    return rows.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(n)


def over_threshold(ops: DataFrame, operation: str, value: str, thresholds: dict[str, float], default: float) -> DataFrame:
    """How many operations exceed their threshold."""
    limit = lookup(F.col(operation), thresholds, default)
    return ops.groupBy(operation).agg(F.count("*").alias("n"), F.count_if(F.col(value) > limit).alias("over"))


def time_to(events: DataFrame, key: str, time: Column, is_end: Column) -> DataFrame:
    """Seconds from a key's first event to its first of a kind; keys without one are left out."""
    x = events.groupBy(key).agg(F.min(time).alias("first"), F.min(F.when(is_end, time)).alias("end"))
    return x.where(F.col("end").isNotNull()).select(key, (F.col("end") - F.col("first")).alias("seconds"))


def filtered(found: DataFrame, least: float = 0.0, severities: Sequence[str] | None = None, types: Sequence[str] | None = None, without: Sequence[str] = (), ready: str | None = None, functions: Sequence[str] | None = None) -> DataFrame:
    """Findings by confidence, severity, type and function. ready: ``only`` drops those
    without a suggestion to paste, ``or none`` keeps those that have no suggestion at all."""
    ok = F.col("confidence") >= least
    if severities is not None:
        ok = ok & F.col("severity").isin(*severities)
    if types is not None:
        ok = ok & F.col("issue_type").isin(*types)
    if without:
        ok = ok & ~F.col("issue_type").isin(*without)
    if functions is not None:
        ok = ok & F.col("function_name").isin(*functions)
    if ready is not None:
        r = F.col("ready")
        ok = ok & (F.coalesce(r, F.lit(False)) if ready == "only" else r.isNull() | r)
    return found.where(ok)


def by_quality(suggested: DataFrame, quality: Column, tie: str) -> DataFrame:
    return suggested.withColumn("quality", quality).orderBy(F.desc("quality"), tie)


def model_metrics(calls: DataFrame) -> DataFrame:
    """calls (kind, ms, hit, error, tokens, cost, t) -> one row for each kind and one for all
    (kind null): percentiles, hit and error rates, tokens, cost, calls a second, and score."""
    x = calls.rollup("kind").agg(F.count("*").alias("n"), F.avg("ms").alias("mean_ms"), F.grouping("kind").alias("all"), F.avg(F.col("hit").cast("int")).alias("hit_rate"), F.avg(F.col("error").cast("int")).alias("error_rate"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"), (F.max("t") - F.min("t")).alias("span"))
    found = selection.percentiles(calls, ["kind"], "ms", SHARES).withColumn("all", F.lit(0))
    found = found.unionByName(selection.percentiles(calls, [], "ms", SHARES).withColumns({"kind": F.lit(None).cast(calls.schema["kind"].dataType), "all": F.lit(1)}))
    x = _with_percentiles(x.withColumn("all", F.col("all").cast("int")), found, ["kind", "all"]).drop("all")
    x = x.withColumn("per_second", F.when(F.col("span") > 0, F.col("n") / F.col("span")).otherwise(0.0)).drop("span")
    return x.withColumn("score", performance_score(F.col("mean_ms"), F.col("hit_rate"), F.col("error_rate")))


def quality_metrics(shown: DataFrame) -> DataFrame:
    """shown (quality, completeness, seconds) -> means; of seconds only those that are there and not 0."""
    return shown.agg(F.count("*").alias("n"), F.avg("quality").alias("quality"), F.avg("completeness").alias("completeness"), F.avg(F.when(F.col("seconds") != 0, F.col("seconds"))).alias("seconds"))
