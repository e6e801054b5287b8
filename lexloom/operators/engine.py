"""End to end: source files to ranked findings with suggestions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ISSUE_SEVERITY, EngineConfig
from ..functions import hashing, names, scores
from ..sources import shared
from . import generators, joins, matching, parse, patterns, routing, rules, validation


def opened(source: DataFrame | parse.Project) -> parse.Project:
    """(path, content) parsed once and stored; a project that is open already stays as it is."""
    return source if isinstance(source, parse.Project) else parse.Project(source)


def match_project(source: DataFrame | parse.Project, vectors: DataFrame | None = None, good: float = 0.8) -> DataFrame:
    """(path, content), or a project -> function_id, doc_function_id, match_type, confidence of all
    three stages; each function is matched once, functions that no stage matches are missing.

    vectors: (function_id, name, module, vec) for the semantic stage, which else finds nothing."""
    project = opened(source)
    found = project.functions.select(*MATCHED)
    own = matching.direct(found).select("function_id", F.col("function_id").alias("doc_function_id"), "match_type", "confidence")
    context = matching.contextual(found, own, project.imports, matching.module_docs(project.modules), good)
    kinds = F.element_at(F.array(*map(F.lit, ("imported", "moved", "cross_file"))), F.col("stage"))
    stages = [own.where(F.col("confidence") >= good), context.select("function_id", "doc_function_id", kinds.alias("match_type"), "confidence")]
    if vectors is not None:
        before = stages[0].unionByName(stages[1])
        left = joins.unmatched(found, "function_id", before).select("function_id", "name", names.module_of(F.col("file_path")).alias("module"))
        stages.append(matching.semantic(left, vectors).select("function_id", "doc_function_id", F.lit("semantic").alias("match_type"), "confidence"))
    stages.append(own)
    return joins.cascade(found.select("function_id"), "function_id", stages).drop("stage")


#: What the stages read of a function: not its source.
MATCHED = ("function_id", "file_path", "line_number", "name", "parameters", "return_type", "raw_doc", "doc")
MATCH_TYPES = ("exact", "imported", "moved", "cross_file", "semantic")


def match_statistics(functions: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: functions, matched ones, their rate, and a count for every type, zero where
    it doesn't occur."""
    x = functions.select("function_id").join(matches.select("function_id", "match_type"), "function_id", "left")
    return x.agg(F.count("*").alias("functions"), F.count("match_type").alias("matched"), *(F.count_if(F.col("match_type") == t).alias(t) for t in MATCH_TYPES)).withColumn("rate", F.when(F.col("functions") > 0, F.col("matched") / F.col("functions")).otherwise(0.0))


def analyse(pairs: DataFrame, config: EngineConfig = EngineConfig(), call: Callable[[list[str]], list[str]] | None = None, actionable: bool = False) -> DataFrame:
    """(function columns, doc, exceptions) -> findings with origin rules or model.

    Rules run on every function. Where they are unsure, or the settings ask for it, the
    model is asked; its findings join those of the rules, and replace one of the same type only
    if that is below 0.9 sure and the model at least 0.8. Without a model the rules' stand.
    actionable: of the model's findings only those that are sure enough and tell what to do."""
    found = rules.check(pairs, config).withColumn("origin", F.lit("rules"))
    if call is not None:
        sure = found.groupBy("function_id").agg(F.min("confidence").alias("least"))
        x = pairs.where("doc is not null").join(sure, "function_id", "left")
        examples = F.size("doc.examples") > 0
        x = x.where(routing.needs_model(F.col("least"), F.size("parameters"), examples, F.col("decorators"), config))
        types = routing.analysis_types(examples, F.size("doc.raises") > 0, F.col("least").isNotNull())
        # Written once: a reply costs money, and asking again may give another one.
        replies = shared.store(routing.ask(routing.prompts(x, types, routing.with_related(pairs)), call), "replies")
        found = with_model(found, routing.answers(replies, config.min_confidence if actionable else None))
    return found.where(F.col("confidence") >= config.min_confidence)


def with_model(found: DataFrame, said: DataFrame) -> DataFrame:
    """Findings of the rules and of the model as one.

    A model's finding and a rule's of the same function and type are about the same thing if
    the model's words name the rule's subject. Those that name none, and rules without a subject,
    pair in order. What has no counterpart stays."""
    own = ["function_id", "issue_type"]
    subjects = found.where("subject is not null").groupBy(*own).agg(F.array_sort(F.collect_set("subject")).alias("subjects"))
    words = F.split(F.lower(F.concat_ws(" ", "description", "suggestion")), r"[^\w*]+")
    named = F.get(F.filter("subjects", lambda x: F.arrays_overlap(F.transform(F.split(x, ","), F.lower), words)), F.lit(0))
    said = said.join(subjects, own, "left").withColumn("about", F.coalesce(named, F.lit("")))
    numbered = lambda order: F.row_number().over(Window.partitionBy(*own, "about").orderBy(*order))
    said = said.withColumn("nth", numbered([F.desc("confidence"), F.col("description")]))
    ranked = found.withColumn("about", F.coalesce("subject", F.lit(""))).withColumn("nth", numbered([F.col("ordinal")]))
    keep = [*own, "about", "nth"]
    merged = joins.replaced(ranked.select(*keep, "confidence", "suggestion"), said.select(*keep, "confidence", "suggestion"), keep)
    rest = ["rule", "severity", "description", "subject", "line_number", "file_path"]
    both = merged.join(ranked.select(*keep, *rest, "ordinal"), keep, "left").join(said.select(*keep, F.col("description").alias("said"), F.col("line_number").alias("said_line")), keep, "left")
    severity = F.coalesce("severity", *(F.when(F.col("issue_type") == k, v) for k, v in ISSUE_SEVERITY.items()), F.lit("medium"))
    model = F.col("origin") == "high"
    return both.select("function_id", "file_path", F.coalesce("line_number", "said_line").alias("line_number"), F.coalesce("ordinal", "nth").alias("ordinal"), "rule", "issue_type", severity.alias("severity"), F.when(model, F.col("said")).otherwise(F.col("description")).alias("description"), "suggestion", "confidence", "subject", F.when(model, "model").otherwise("rules").alias("origin"))


#: A boost: a finding's columns -> what it adds to the rank score.
Boost = Callable[[], Column]


def critical_mismatch() -> Column:
    """A sure and critical finding comes first."""
    return F.when((F.col("severity") == "critical") & (F.col("confidence") >= 0.9), 2.0).otherwise(0.0)


def boosted(score: Column, boosts: Sequence[Boost] = (critical_mismatch,)) -> Column:
    out = score
    for b in boosts:
        out = out + b()
    return out


def enhance(findings: DataFrame, pairs: DataFrame, config: EngineConfig = EngineConfig(), treatment: float = 1.0, style: str = "google", registry: dict | None = None, boosts: Sequence[Boost] = (), corpus: DataFrame | None = None, as_of: Column | None = None) -> DataFrame:
    """Findings with suggestions and a score to rank by.

    corpus: examples (as ``patterns.examples_for`` takes them). Of the best three for each
    function with findings the generators use what they say; as_of: the time from which the
    age of accepted ones counts, by default that of the newest.

    Functions in the control group of the experiment keep the rule's own suggestion; the
    others get a generated one, which is checked: what can't be pasted is not ready."""
    if corpus is not None:
        # All are read several times: by the search, by the patterns and by the generators.
        findings, corpus = shared.store(findings, "findings"), shared.store(corpus, "corpus")
        asked = shared.store(pairs.join(findings.select("function_id").distinct(), "function_id", "left_semi"), "functions-asked")
        newest = F.lit(corpus.agg(F.max("timestamp")).first()[0] or 0.0) if as_of is None else as_of
        found = shared.store(patterns.hints(asked, shared.store(patterns.examples_for(asked, corpus, newest), "examples-found")), "hints")
        pairs = asked.join(found, "function_id", "left")
    used = pairs.select("function_id", "examples_used") if corpus is not None else None
    made = generators.generate(findings, pairs, style, registry=registry)
    made = made.withColumn("examples_used", F.lit(0)) if used is None else made.join(used, "function_id", "left").withColumn("examples_used", F.when(F.col("rag_enhanced"), F.coalesce("examples_used", F.lit(0))).otherwise(0))
    group = hashing.ab_group("function_id", treatment)
    treated = F.col("ab_group") == "treatment"
    x = made.withColumn("ab_group", group)
    x = x.withColumn("problems", F.when(F.col("ready"), validation.problems("suggested_text", style)).otherwise(F.array().cast("array<string>")))
    ready = treated & F.col("ready") & (F.size("problems") == 0)
    x = x.select(*findings.columns, "ab_group", F.when(treated, F.col("suggested_text")).otherwise(F.col("suggestion")).alias("suggested_text"), F.when(treated, F.col("kind")).otherwise("rule").alias("kind"), F.col("suggested_confidence"), ready.alias("is_ready"), "problems", "error", "diff", "rag_enhanced", "examples_used")
    action = scores.actionability(F.col("is_ready"), "suggested_confidence", "suggested_text")
    return x.withColumn("score", boosted(scores.rank_score("severity", "confidence", "issue_type", action, config.strategy), boosts))


def enhanced_issues(source: DataFrame | parse.Project, config: EngineConfig = EngineConfig(), call: Callable[[list[str]], list[str]] | None = None, **options) -> DataFrame:
    """The whole way from (path, content), or a project, to scored findings with suggestions."""
    pairs = opened(source).functions
    return enhance(analyse(pairs, config, call), pairs, config, **options)


def run_summary(pairs: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: functions looked at, findings by severity, functions with findings, shares of
    model findings and of ready suggestions."""
    n = pairs.agg(F.count("*").alias("functions"), F.count("raw_doc").alias("documented"))
    by = findings.agg(F.count("*").alias("findings"), *(F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low")), F.count_distinct("function_id").alias("with_findings"), F.avg((F.col("origin") == "model").cast("int")).alias("model_share"), F.avg(F.col("is_ready").cast("int")).alias("ready_share"))
    return n.join(F.broadcast(by))
