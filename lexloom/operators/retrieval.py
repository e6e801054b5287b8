"""Examples for a function: seven weighted similarities and the best few."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RETRIEVAL_WEIGHT as W
from ..functions import names, relevance, scores, types
from ..functions._lift import arrow_function
from ..sources import shared
from . import index, joins, suggestions
from .windows import top_per_key

PARSED = "name string, parameters array<struct<name:string, type:string, default:string>>, return_type string"


def parse_signature(text: str | None) -> dict:
    """``def f(a: int, b=1) -> str`` -> its parts; brackets nest."""
    none = {"name": None, "parameters": None, "return_type": None}
    head, opened, rest = (text or "").strip().removeprefix("async ").lstrip().partition("(")
    if not opened or not head.startswith("def "):
        return none
    depth, word, words, end = 0, "", [], -1
    for i, c in enumerate(rest):
        if c == ")" and depth == 0:
            end = i
            break
        depth += (c in "([{") - (c in ")]}")
        if c == "," and depth == 0:
            words.append(word)
            word = ""
        else:
            word += c
    if end < 0:
        return none
    params = []
    for w in [*words, word]:
        if not w.strip():
            continue
        left, has_type, kind = w.partition(":")
        name, _, default = (left if not has_type else kind).partition("=")
        params.append({"name": (left if has_type else name).strip(), "type": name.strip() if has_type else None, "default": default.strip() or None})
    tail = rest[end + 1 :].partition("->")[2].strip().rstrip(":")
    return {"name": head[4:].strip(), "parameters": params, "return_type": tail or None}


@arrow_function(PARSED)
def signature(text):
    return pd.DataFrame([parse_signature(t) for t in text], columns=["name", "parameters", "return_type"])


def _signature_similarity(p: Column, q: Column) -> Column:
    """0.4 count + 0.3 shared names + 0.3 names in the same place; 0 without a signature."""
    a, b = F.transform(p, lambda x: x["name"]), F.transform(q, lambda x: x["name"])
    shared = F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    placed = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.size(a)
    both = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(q.isNull(), 0.0).otherwise(0.4 / (1 + F.abs(F.size(a) - F.size(b)) * 0.3) + F.when(both, 0.3 * shared + 0.3 * placed).otherwise(0.0))


def _type_compatibility(p: Column, q: Column, r: Column, s: Column) -> Column:
    """Half for the return type, half the mean over typed parameters of the same name; types
    come as features (null without a type)."""
    pairs = F.flatten(F.transform(F.filter(p, lambda x: x["type"].isNotNull()), lambda x: F.transform(F.slice(F.filter(q, lambda y: (y["name"] == x["name"]) & y["type"].isNotNull()), 1, 1), lambda y: types.compatible(x["type"], y["type"]))))
    mean = F.aggregate(pairs, F.lit(0.0), lambda a, b: a + b) / F.nullif(F.size(pairs), F.lit(0))
    return F.when(q.isNull(), 0.0).otherwise(F.when(r.isNotNull() & s.isNotNull(), 0.5 * types.compatible(r, s)).otherwise(0.0) + 0.5 * F.coalesce(mean, F.lit(0.0)))


def _prepared(name: str, signature_: str) -> Column:
    """A side's features, once for each row: name, parameters with types, return type."""
    s = F.col(signature_)
    typed = lambda t, keep_empty: F.when(t.isNotNull() if keep_empty else F.coalesce(t, F.lit("")) != "", types.features(t))
    params = F.transform(s["parameters"], lambda p: F.struct(p["name"].alias("name"), typed(p["type"], False).alias("type")))
    return F.struct(names.features(name).alias("name"), params.alias("parameters"), typed(s["return_type"], True).alias("returns"))


def _query_side(queries: DataFrame) -> DataFrame:
    q = queries.withColumn("_s", signature("signature"))
    return q.select("query_id", "name", "file_path", _prepared("name", "_s").alias("q"), scores.complexity(F.size("_s.parameters"), ~F.exists("_s.parameters", lambda p: p["type"].isNull()), F.col("_s.return_type").isNotNull()).alias("q_complexity"))


def _corpus_side(corpus: DataFrame) -> DataFrame:
    c = corpus.withColumn("_s", signature("function_signature"))
    return c.withColumn("c", _prepared("function_name", "_s")).drop("_s")


def _scored(pairs: DataFrame, as_of: Column) -> DataFrame:
    """Pairs of both sides -> query_id, example_id, similarity."""
    pairs = pairs.withColumn("ratio", suggestions.token_set_ratio("name", "function_name"))
    parts = {
        "name": names.similar(F.col("q.name"), F.col("c.name"), F.col("ratio")),
        "signature": _signature_similarity(F.col("q.parameters"), F.col("c.parameters")),
        "types": _type_compatibility(F.col("q.parameters"), F.col("c.parameters"), F.col("q.returns"), F.col("c.returns")),
        "complexity": scores.complexity_match(F.col("q_complexity"), F.col("complexity_score")),
        "module": names.module_context("file_path", "module_path"),
        "recency": F.when(F.col("source") == "accepted", scores.recency(F.col("timestamp"), as_of)).otherwise(0.0),
        "quality": F.col("quality_score") / 5.0,
    }
    total = sum((F.coalesce(v, F.lit(0.0)) * W[k_] for k_, v in parts.items()), F.lit(0.0)) * F.when(F.col("source") == "accepted", 1.2).otherwise(1.0)
    return pairs.select("query_id", "example_id", F.least(F.lit(1.0), total).alias("similarity"))


def _best(scored: DataFrame, k: int, least: float) -> DataFrame:
    return top_per_key(scored.where(F.col("similarity") >= least), ["query_id"], [F.desc("similarity"), F.col("example_id")], k, "rank")


def retrieve_by_all(queries: DataFrame, corpus: DataFrame, as_of: Column, k: int = 3, least: float = 0.3) -> DataFrame:
    """As ``retrieve``, by scoring every pair: for a stated set of queries.

    Signatures, name tokens and types are worked out once on each side, before the pairs.
    The queries meet the corpus in its own partitions; only the k best of each task and
    query are shuffled."""
    pairs = joins.against_all(fixed(_corpus_side(corpus)), fixed(_query_side(queries)), "query_id", "example_id")
    return _best(_scored(pairs, as_of), k, least)


#: Examples that a task of a search holds, and queries that it answers.
PART, BLOCK = 50_000, 1_000


def retrieve(queries: DataFrame, corpus: DataFrame, as_of: Column, k: int = 3, least: float = 0.3, part: int = PART, block: int = BLOCK) -> DataFrame:
    """queries (query_id, name, signature, file_path), corpus (example_id, function_name,
    function_signature, module_path, complexity_score, quality_score, source, timestamp)
    -> query_id, example_id, similarity, rank: the k best examples of at least ``least``, exactly.

    Few pairs are scored. Where verbs mean the same, names count by their other words only; there, examples
    that no query tells apart are one class, of which those remain that may be among the k best
    (``index.leading``). Queries that no example tells apart are one query. Bounds of the score
    (``index.Classes``, and ``index.Cells`` for other verbs) then say which examples are scored: first those
    with the highest bounds; the k-th score is what others have to reach; then those whose bounds do.
    A task holds at most ``part`` examples and ``block`` queries; nothing goes through the driver."""
    q = shared.store(_query_side(queries).select("query_id", "file_path", "q", "q_complexity", *index.query_columns()), "queries")
    c = shared.store(_corpus_side(corpus).select("example_id", *EXAMPLE, "c", *index.example_columns(as_of)), "examples")
    # Verbs of fixed groups, and one for all others.
    asked_verbs, verbs = ([r[0] for r in side.select("verb").distinct().collect()] for side in (q, c))
    met = {(a, b): names.synonyms(a, b) for a in asked_verbs for b in verbs}
    known = shared.store(q.select(F.explode("marks").alias("mark")).distinct().join(c.select(F.explode("marks").alias("mark")), "mark", "left_semi"), "marks")
    whole = F.col("verb").isin([a for a in asked_verbs if not all(met[a, b] for b in verbs)])
    told = F.to_json(F.struct("verb", F.when(whole, F.col("name")).alias("name"), "marks", "words", "q.parameters", "q.returns", "complexity", "top", "deep", F.col("file_path").isNull().alias("nowhere")))
    marked = shared.store(index.marked(q, "query_id", known).select("query_id", told.alias("class"), *index.QUERY), "queries-marked")
    first_of = shared.store(marked.groupBy("class").agg(F.min("query_id").alias("query_id")), "query-classes")
    asked = shared.store(marked.join(first_of, "query_id", "left_semi").select("query_id", *index.QUERY), "queries-asked")
    # Scores read one query of each class, and the examples that are held: not both sides whole.
    one = shared.store(q.join(first_of, "query_id", "left_semi").select("query_id", "name", "file_path", "q", "q_complexity"), "queries-scored")
    alike = index.marked(c, "example_id", known).where(F.col("verb").isin([b for b in verbs if any(met[a, b] for a in asked_verbs)]))
    told = F.to_json(F.struct("verb", "marks", "words", "c.parameters", "c.returns", "complexity", "quality_score", "boost", "top", "deep"))
    alike = shared.store(alike.select("example_id", told.alias("class"), *index.EXAMPLE), "examples-marked")
    others = c.where(F.col("verb").isin([b for b in verbs if not all(met[a, b] for a in asked_verbs)]))
    held = alike.join(index.leading(alike, k).select("example_id"), "example_id", "left_semi").select("example_id", *index.EXAMPLE, F.lit(True).alias("alike"))
    # Names of other verbs are compared by their letters: to the index they have no groups.
    others = others.select("example_id", *index.EXAMPLE, F.lit(False).alias("alike")).withColumns({"groups": F.array().cast("array<string>"), "marks": F.array().cast("array<string>")})
    held = shared.store(held.unionByName(others), "held")
    kept = shared.store(c.join(held, "example_id", "left_semi").select("example_id", *EXAMPLE, "c"), "examples-scored")
    kinds = {f.name: f.dataType.simpleString() for f in [*q.schema, *c.schema]}
    # Nothing below reads them again.
    shared.discard(alike, known, q, c)
    numbered = lambda id_, of: F.pmod(F.xxhash64(id_), F.lit(of)).cast("int")
    parts, blocks = max(1, -(-held.count() // part)), max(1, -(-first_of.count() // block))
    on = ["alike", "met", "part", "block"]
    examples = held.withColumns({"met": F.col("verb"), "part": numbered("example_id", parts), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    examples = shared.dealt(examples, *on).groupBy(*on)
    n = kept.count()
    pairs_of = [F.struct(F.lit(a).alias("verb"), F.lit(b).alias("met"), F.lit(same).alias("alike")) for (a, b), same in met.items()]
    wanted = held.sparkSession.range(1).select(F.inline(F.array(*pairs_of).cast("array<struct<verb:string, met:string, alike:boolean>>")))

    def reached(asked: DataFrame, most: int) -> DataFrame:
        """asked with ``reach`` -> query_id, example_id of the pairs whose bounds reach it."""

        def work(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame({"query_id": a["query_id"][:0], "example_id": b["example_id"][:0]})
            cells = (index.Classes if key[0] else index.Cells)(b)
            hits = [cells.search(x, most, x.reach) for x in a.itertuples(index=False)]
            return pd.DataFrame({"query_id": np.repeat(a["query_id"].to_numpy(), [len(h) for h in hits]), "example_id": cells.ids[np.concatenate(hits)]})

        x = asked.join(F.broadcast(wanted), "verb")
        x = x.withColumns({"block": numbered("query_id", blocks), "part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))})
        return shared.dealt(x, *on).groupBy(*on).cogroup(examples).applyInPandas(work, f"query_id {kinds['query_id']}, example_id {kinds['example_id']}")

    def scored(pairs: DataFrame) -> DataFrame:
        few = F.broadcast(kept) if n <= joins.FEW_QUERIES else kept
        return _scored(fixed(pairs.join(one, "query_id")).join(few, "example_id"), as_of)

    first = shared.store(scored(reached(asked.withColumn("reach", F.lit(float(least))), 2 * k)), "first-scored")
    kth = top_per_key(first.where(F.col("similarity") >= least), ["query_id"], [F.desc("similarity"), F.col("example_id")], k, "rank").where(F.col("rank") == k)
    reach = asked.join(kth.select("query_id", F.col("similarity").alias("kth")), "query_id", "left").withColumn("reach", F.coalesce("kth", F.lit(float(least)))).drop("kth")
    # The cap of the score: all that reach it tie.
    reach = reach.withColumn("reach", F.least("reach", F.lit(1.0)))
    last = shared.store(_best(scored(reached(reach, 0)), k, least), "best-of-classes")
    shared.discard(first, held, asked, one, kept)
    found = last.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "example_id", "similarity"))).alias("found"))
    found = first_of.join(found, "query_id").drop("query_id")
    return marked.select("query_id", "class").join(found, "class").select("query_id", F.inline("found")).select("query_id", "example_id", "similarity", "rank")


#: What a score reads of an example.
EXAMPLE = ("function_name", "module_path", "complexity_score", "quality_score", "source", "timestamp")


def fixed(side: DataFrame) -> DataFrame:
    """Keeps the planner from moving a side's expressions above the join, where they would be
    evaluated for every pair: rows are dealt by a hash of all they hold, which materialises them.
    Their number of parts is stated: scoring costs more than its rows' bytes say."""
    return side.repartition(int(side.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*side.columns))


def renamed_parameters(functions: DataFrame, least: float = 0.6) -> DataFrame:
    """(function_id, own, told: arrays of names) -> function_id, told_name, own_name: for each
    documented name that the function lacks, the most alike of its undocumented ones."""
    x = functions.select("function_id", F.explode(F.array_except("told", "own")).alias("told_name"), F.array_except("own", "told").alias("left"))
    x = x.select("function_id", "told_name", F.posexplode("left").alias("at", "own_name")).withColumn("ratio", suggestions.indel_ratio("told_name", "own_name")).where(F.col("ratio") > least)
    return top_per_key(x, ["function_id", "told_name"], [F.desc("ratio"), F.col("at")]).select("function_id", "told_name", "own_name", "ratio")


def parameter_patterns(wanted: DataFrame, corpus_params: DataFrame, k: int = 5, least: float = 0.3, on: Sequence[str] = ()) -> DataFrame:
    """wanted (query_id, name, type), corpus_params (example_id, p_name, p_type, description,
    similarity) -> the k best descriptions: (0.6 name + 0.4 type) above least, times the example's
    similarity. on: columns that both have and must agree in, such as the function for which the
    examples were found (which the result has too, and by which alone its rows are dealt); without any every
    parameter of the corpus is compared."""
    s = 0.6 * relevance.parameter_similarity("name", "p_name") + 0.4 * types.family_similarity("type", "p_type")
    x = wanted.join(corpus_params, list(on)) if on else joins.against_all(corpus_params, wanted, "query_id", "example_id")
    x = x.withColumn("s", s).where(F.col("s") > least).withColumn("score", F.col("s") * F.col("similarity"))
    return top_per_key(x, [*on, "query_id"], [F.desc("score"), F.col("example_id"), F.col("p_name")], k, "rank").select(*on, "query_id", "example_id", "p_name", "description", "score", "rank")
