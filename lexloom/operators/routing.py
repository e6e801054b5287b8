"""What goes to a language model, how it is asked, and how its answers come back.

The call itself is a function of a batch of prompts that the caller supplies; without one
there are no answers, and everything around it works the same.
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import docs, errors, json_text, scores
from ..functions._lift import lookup


def needs_model(least_rule_confidence: Column, complexity: Column, has_examples: Column, decorators: Column, config: EngineConfig) -> Column:
    special = F.exists(decorators, lambda d: d.rlike("property|cached|retry|contextmanager"))
    return F.coalesce(least_rule_confidence < config.llm_below, F.lit(False)) | F.lit("behavior" in config.analysis_types) | (complexity > config.complexity_above) | has_examples | special


def analysis_types(has_examples: Column, has_raises: Column, changed: Column) -> Column:
    found = F.array_compact(F.array(F.when(changed, "behavior"), F.when(has_examples, "examples"), F.when(has_raises, "edge_cases")))
    return F.when(F.size(found) == 0, F.array(F.lit("behavior"))).otherwise(found)


def prompts(pairs: DataFrame, types: Column, related: DataFrame | None = None, limit: int = 2000) -> DataFrame:
    """function_id, prompt, tokens: the question of each kind of analysis, the code, its
    documentation, the names of related functions (function_id, related) if they are given, and the form
    of the answer. Source is cut at ``limit`` characters of the prompt, not of any result."""
    questions = F.array_join(F.transform(types, lambda t: F.concat(F.lit("- "), prompt_for(t))), "\n")
    x = pairs.withColumn("_questions", questions)
    if related is not None:
        x = x.join(related.select("function_id", "related"), "function_id", "left")
    near = F.when(F.size("related") > 0, F.concat(F.lit("\n\nRELATED: "), F.array_join("related", ", "))) if related is not None else F.lit(None)
    text = F.concat(F.lit("Compare the function with its documentation.\n"), F.col("_questions"), F.lit("\n\nCODE:\n"), F.left("source_code", F.lit(limit)), F.lit("\n\nDOCUMENTATION:\n"), F.coalesce("raw_doc", F.lit("")), F.coalesce(near, F.lit("")), F.lit('\n\nAnswer in JSON: {"issues": [...], "confidence": 0.0}'))
    return x.select("function_id", text.alias("prompt"), scores.estimate_tokens(text).alias("tokens"))


def policy(error: str, attempt: int, base: float = 1.0, cap: float = 60.0) -> tuple[bool, float]:
    """Whether to try again after an error, and after how many seconds: exponential, at least
    what the kind of error asks for, with up to a tenth more or less that the error and the
    attempt decide. Refused keys are not tried again, unknown errors once."""
    low = error.lower()
    kind = next((k for words, *k in errors.KINDS if any(w in low for w in words)), ["unknown", "retry_once", 1])
    again = kind[1] not in ("stop", "fallback") and (kind[1] != "retry_once" or attempt == 0)
    jitter = 0.9 + 0.2 * (zlib.crc32(f"{error}:{attempt}".encode()) % 1000) / 1000
    return again, min(cap, max(base * 2**attempt, float(kind[2]) if kind[1] == "wait" else 0.0)) * jitter


def ask(requests: DataFrame, call: Callable[[list[str]], list[str]] | None = None, batch: int = 10, retries: int = 3, pause: Callable[[float], None] = time.sleep) -> DataFrame:
    """function_id, reply, error: one row per request in any case, in batches of ``batch``.
    If a batch fails, or gives another number of replies than it has prompts, these go one by one,
    with retries; an error is that row's. How many calls run at once is the number of
    partitions: ``repartition`` the requests to bound it. A result that is read twice is asked for twice: store it."""
    if call is None:
        return requests.select("function_id", F.lit(None).cast("string").alias("reply"), F.lit("offline").alias("error"))

    def one(prompt: str) -> tuple[str | None, str | None]:
        for attempt in range(retries + 1):
            try:
                return replied(call, [prompt])[0], None
            except Exception as e:  # noqa: BLE001  a service's failure is data here
                error = str(e)
                again, wait = policy(error, attempt)
                if not again or attempt == retries:
                    break
                pause(wait)
        return None, error

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), batch):
                part = b.iloc[at : at + batch]
                try:
                    made = [(r, None) for r in replied(call, part["prompt"].tolist())]
                except Exception:  # noqa: BLE001  then each prompt by itself
                    made = [one(p) for p in part["prompt"]]
                yield pd.DataFrame({"function_id": part["function_id"], "reply": [r for r, _ in made], "error": [e for _, e in made]})

    return requests.select("function_id", "prompt").mapInPandas(work, "function_id string, reply string, error string")


def replied(call: Callable[[list[str]], list], asked: list[str]) -> list:
    """What a service says to a list, if it is one answer for each."""
    out = list(call(asked))
    if len(out) != len(asked):
        raise ValueError(f"{len(out)} replies to {len(asked)} requests")
    return out


def answers(replies: DataFrame, least: float | None = None) -> DataFrame:
    """function_id, issue_type, description, suggestion, confidence, line_number of the valid
    findings; a reply that isn't JSON gives recovered ones of confidence 0.3. With ``least``,
    those that are as sure and tell what to do."""
    x = replies.where("reply is not null").withColumn("doc", json_text.extract("reply"))
    good = x.where("doc is not null").select("function_id", F.explode(json_text.findings("doc")["issues"]).alias("i")).where(json_text.valid_finding(F.col("i")))
    rows = good.select("function_id", json_text.issue_type(F.col("i.type")).alias("issue_type"), "i.description", "i.suggestion", "i.confidence", "i.line_number")
    lost = x.where("doc is null").select("function_id", F.explode(json_text.recovered("reply")).alias("i"))
    out = rows.unionByName(lost.select("function_id", F.lit("description_outdated").alias("issue_type"), "i.description", F.lit(None).cast("string").alias("suggestion"), "i.confidence", F.lit(None).cast("int").alias("line_number")))
    return out if least is None else out.where((F.col("confidence") >= least) & docs.actionable("suggestion"))


def with_fallback(stages: list[tuple[Column, float]]) -> Column:
    """The first stage that has a result, its confidence scaled."""
    return F.coalesce(*(F.when(c.isNotNull(), F.struct((c["confidence"] * f).alias("confidence"), c["suggestion"].alias("suggestion"))) for c, f in stages))


def words_overlap(a: Column, b: Column) -> Column:
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    return F.size(F.array_intersect(words(a), words(b))) / F.greatest(F.size(words(a)), F.size(words(b)), F.lit(1))


def good_examples(functions: DataFrame, issues: DataFrame) -> DataFrame:
    """Functions fit as examples: at most one finding and none critical or high."""
    bad = issues.groupBy("function_id").agg(F.count("*").alias("n"), F.count_if(F.col("severity").isin("critical", "high")).alias("heavy"))
    x = functions.join(bad, "function_id", "left").where("coalesce(n, 0) <= 1 and coalesce(heavy, 0) = 0")
    return x.select("function_id", "name", F.when(F.col("n").isNull(), 5).otherwise(4).alias("quality_score"))


# Kinds of analysis and what each asks for.
TEMPLATES = {
    "behavior": "Does the documentation tell what the code does, in every branch?",
    "examples": "Do the examples run, and give what they say?",
    "edge_cases": "Are empty, missing and extreme inputs told, and the errors they raise?",
    "version": "Does the documentation speak of parameters or behaviour that are gone?",
    "types": "Do the told types fit the code?",
    "performance": "Are costs and limits told where they matter?",
}


def prompt_for(kind: Column) -> Column:
    """The question of one kind of analysis; of an unknown one that of behaviour."""
    return F.coalesce(lookup(kind, TEMPLATES), F.lit(TEMPLATES["behavior"]))


def high_value(name: Column, n_parameters: Column, lines: Column, has_doc: Column) -> Column:
    """Public functions with parameters that are long or documented: worth asking about ahead."""
    return ~name.startswith("_") & (n_parameters >= 2) & ((lines >= 10) | has_doc)


def to_warm(functions: DataFrame, cache: DataFrame) -> DataFrame:
    """High-value functions (with ``cache_key``) that the cache doesn't have, dearest first."""
    lines = F.col("end_line_number") - F.col("line_number") + 1
    x = functions.where(high_value(F.col("name"), F.size("parameters"), lines, F.col("raw_doc").isNotNull()))
    return x.join(cache.select("cache_key"), "cache_key", "left_anti").withColumn("effort", effort(F.size("parameters"), lines, F.size("decorators"), F.col("is_async")))


def effort(n_parameters: Column, lines: Column, n_decorators: Column, is_async: Column) -> Column:
    """How much there is to look at, for scheduling."""
    return n_parameters * 2 + F.floor(lines / 10).cast("int") + n_decorators + F.when(is_async, 3).otherwise(0)


def scheduled(requests: DataFrame, parts: int) -> DataFrame:
    """Requests of one type and file side by side, the dearest first."""
    return requests.repartition(parts, "analysis_type", "file_path").sortWithinPartitions("analysis_type", F.desc("effort"), "file_path", "function_id")


def parse_statistics(replies: DataFrame, found: DataFrame) -> DataFrame:
    """One row: replies, share that parsed, mean findings of a reply, and the five most
    frequent beginnings of errors (up to the first colon)."""
    per = found.groupBy("function_id").agg(F.count("*").alias("n"))
    x = replies.join(per, "function_id", "left")
    total = x.agg(F.count("*").alias("replies"), F.avg(F.col("reply").isNotNull().cast("int")).alias("success_rate"), F.avg(F.coalesce("n", F.lit(0))).alias("mean_issues"))
    top = x.where("error is not null").groupBy(F.substring_index("error", ":", 1).alias("error")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error").limit(5)
    return total.join(F.broadcast(top.agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "error"))).alias("top")).select(F.transform("top", lambda t: t["error"]).alias("top_errors"))))


def with_related(functions: DataFrame, k: int = 3) -> DataFrame:
    """Each function with the names of up to k others of its file, the nearest by line first,
    of equally near ones the earlier. They are among the k before and the k behind it, so a window of
    2k + 1 rows of the file in line order holds them, however many functions the file has."""
    w = Window.partitionBy("file_path").orderBy("line_number", "function_id")
    one = F.struct("line_number", "function_id", "name")
    x = functions.select("function_id", "file_path", "line_number", "name")
    x = x.select("function_id", "line_number", F.collect_list(one).over(w.rowsBetween(-k, -1)).alias("up"), F.collect_list(one).over(w.rowsBetween(1, k)).alias("down"))
    near = F.array_sort(F.transform(F.concat("up", "down"), lambda o: F.struct(F.abs(o["line_number"] - F.col("line_number")).alias("d"), o["line_number"].alias("l"), o["name"].alias("name"))))
    return x.select("function_id", F.transform(F.slice(near, 1, k), lambda x: x["name"]).alias("related"))


def request_problems(types: Column, source: Column, confidence: Column) -> Column:
    """What is wrong with a request, as an array: unknown kinds, no kinds, no source, a
    threshold outside 0 to 1."""
    known = F.array(*map(F.lit, TEMPLATES))
    return F.array_compact(F.array(
        F.when(F.size(types) == 0, "no kinds"), F.when(F.size(F.array_except(types, known)) > 0, F.concat(F.lit("unknown kinds: "), F.array_join(F.array_sort(F.array_except(types, known)), ","))),
        F.when(F.trim(F.coalesce(source, F.lit(""))) == "", "no source"), F.when(~F.coalesce(confidence.between(0.0, 1.0), F.lit(False)), "threshold out of range"),
    ))


def summary(types: Column, n_issues: Column, tokens: Column, ms: Column) -> Column:
    """A request and its reply in one line."""
    return F.concat(F.array_join(types, "+"), F.lit(": "), n_issues.cast("string"), F.lit(" issues, "), tokens.cast("string"), F.lit(" tokens, "), F.round(ms).cast("int").cast("string"), F.lit(" ms"))
