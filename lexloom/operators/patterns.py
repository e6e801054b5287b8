"""What similar examples say, for the generators: retrieved examples -> ranked patterns.

For each function with findings the best examples of the corpus are retrieved once; their
documentation is parsed in the same pass as the corpus is read. What they say about a
parameter, an exception, the return value, and in which words, is ranked for each subject of
the function, by how alike subjects and functions are. All of it meets under the function's id: there are
a few examples for each function, so no key grows with the data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names, relevance, types
from . import docstrings, matching, retrieval, windows

HINT = "array<struct<slot:string, subject:string, rank:int, text:string>>"
#: Fixed: how a condition begins, and how a sentence that restricts a value does.
CONDITION = r"(?i)^(?:raised\s+)?(?:if|when|for|on)\s+(.+?)[.\s]*$"
LIMITS = r"(?i)^(?:must|should|may|can|cannot|only|defaults?|if|when|between|at (?:least|most))\b"


def examples_for(functions: DataFrame, corpus: DataFrame, as_of: Column, k: int = 3, least: float = 0.3) -> DataFrame:
    """functions (function_id, name, file_path, is_async, parameters, return_type), corpus (as ``retrieval.retrieve``, with
    docstring_content) -> function_id, example_id, similarity, rank, example_name, doc.

    A function is not its own example: one of the same name in the same module is passed over."""
    asked = functions.select(F.col("function_id").alias("query_id"), "name", matching.signature_text().alias("signature"), "file_path")
    hits = retrieval.retrieve(asked, corpus, as_of, k + 1, least).withColumnRenamed("query_id", "function_id")
    texts = corpus.select("example_id", F.col("function_name").alias("example_name"), F.col("module_path").alias("example_module"), docstrings.parsed("docstring_content").alias("doc"))
    own = functions.select("function_id", F.col("name").alias("_name"), names.module_of(F.col("file_path")).alias("_module"))
    x = hits.drop("rank").join(texts, "example_id").join(own, "function_id")
    x = x.where(~((F.col("example_name") == F.col("_name")) & F.col("example_module").eqNullSafe(F.col("_module")))).drop("_name", "_module", "example_module")
    return windows.top_per_key(x.where("doc.summary is not null"), ["function_id"], [F.desc("similarity"), F.col("example_id")], k, "rank")


def _named(text: Column, old: Column, new: Column) -> Column:
    """A text about one name, about another one."""
    return F.regexp_replace(text, F.concat(F.lit(r"\b"), F.regexp_replace(old, r"([^A-Za-z0-9_])", r"\\$1"), F.lit(r"\b")), new)


def for_parameters(functions: DataFrame, hits: DataFrame) -> DataFrame:
    """The best description of each own parameter, and after it the restrictions that the next
    two add: function_id, subject, rank, text."""
    own = functions.select("function_id", F.explode("parameters").alias("p")).select("function_id", F.regexp_replace("p.name", r"^\*+|/$", "").alias("name"), F.coalesce("p.type_annotation", F.lit("")).alias("type"))
    wanted = own.where("name not in ('self', 'cls')").withColumn("query_id", F.col("name"))
    told = hits.select("function_id", "example_id", "similarity", F.explode("doc.parameters").alias("d"))
    told = told.select("function_id", "example_id", "similarity", F.regexp_replace("d.name", r"^\*+", "").alias("p_name"), F.coalesce("d.type_str", F.lit("")).alias("p_type"), F.trim("d.description").alias("description")).where(F.length("description") >= 5)
    best = retrieval.parameter_patterns(wanted, told, 3, on=["function_id"])
    x = best.withColumnRenamed("query_id", "subject")
    text = _named(F.col("description"), F.col("p_name"), F.col("subject"))
    ranked = x.groupBy("function_id", "subject").agg(F.sort_array(F.collect_list(F.struct("rank", text.alias("text")))).alias("all"))
    first = F.col("all")[0]["text"]
    sentences = F.flatten(F.transform(F.slice("all", 2, 2), lambda a: F.split(a["text"], r"(?<=\.)\s+")))
    more = F.filter(F.array_distinct(sentences), lambda s: s.rlike(LIMITS) & ~F.contains(first, s))
    return ranked.select("function_id", "subject", F.lit(1).alias("rank"), F.concat_ws(" ", first, F.get(more, F.lit(0))).alias("text"))


def for_exceptions(functions: DataFrame, hits: DataFrame, sure: float = 0.8) -> DataFrame:
    """For what a function surely raises, the conditions under which examples raise the like."""
    own = functions.select("function_id", F.explode("exceptions").alias("e")).where(F.col("e.confidence") >= sure).select("function_id", F.col("e.exception_type").alias("subject"))
    told = hits.select("function_id", "similarity", F.explode("doc.raises").alias("r")).select("function_id", "similarity", F.col("r.exception_type").alias("told"), F.regexp_extract("r.description", CONDITION, 1).alias("description"))
    x = own.join(told.where("description <> ''"), "function_id").where(relevance.exceptions_match("subject", "told"))
    x = x.withColumn("like", F.col("similarity") + F.when(F.col("subject") == F.col("told"), 1.0).otherwise(0.0))
    best = windows.most_similar(x, ["function_id", "subject"], "like", 3)
    both = best.groupBy("function_id", "subject").agg(F.sort_array(F.collect_list(F.struct("rank", "description"))).alias("all"))
    text = F.concat(F.lit("If "), F.array_join(F.transform("all", lambda a: a["description"]), " or "), F.lit("."))
    return both.select("function_id", "subject", F.lit(1).alias("rank"), text.alias("text"))


def for_returns(functions: DataFrame, hits: DataFrame, least: float = 0.5) -> DataFrame:
    """How the examples with the most alike return type describe it."""
    told = hits.where("doc.returns is not null").select("function_id", "example_id", "similarity", F.coalesce("doc.returns.type_str", F.lit("")).alias("told"), F.trim("doc.returns.description").alias("text"))
    own = functions.select("function_id", F.coalesce("return_type", F.lit("")).alias("kind"))
    x = told.where(F.length("text") >= 5).join(own, "function_id").withColumn("like", types.family_similarity("kind", "told"))
    x = x.where((F.col("like") >= least) | (F.col("kind") == "")).withColumn("score", F.col("like") * F.col("similarity"))
    return windows.top_per_key(x, ["function_id"], [F.desc("score"), F.col("example_id")]).select("function_id", F.lit("").alias("subject"), F.lit(1).alias("rank"), "text")


def for_behaviour(functions: DataFrame, hits: DataFrame, k: int = 2) -> DataFrame:
    """Sentences of the examples' descriptions that speak of what the function's name does: those
    with the most of its words first, then of the most similar example."""
    sentence = F.explode(F.split(F.concat_ws(" ", "doc.description"), r"(?<=[.!?])\s+"))
    said = hits.select("function_id", "similarity", "example_id", sentence.alias("text")).where(F.length("text") >= 10)
    own = functions.select("function_id", F.filter(names.tokens("name"), lambda t: F.length(t) > 3).alias("words"))
    x = said.join(own, "function_id").withColumn("n", F.size(F.filter("words", lambda w: F.contains(F.lower(F.col("text")), w)))).where("n > 0")
    x = x.groupBy("function_id", "text").agg(F.max(F.struct("n", "similarity")).alias("m"))
    ranked = windows.top_per_key(x.select("function_id", "text", "m.n", "m.similarity"), ["function_id"], [F.desc("n"), F.desc("similarity"), F.col("text")], k, "rank")
    return ranked.select("function_id", F.lit("").alias("subject"), "rank", "text")


def for_examples(functions: DataFrame, hits: DataFrame) -> DataFrame:
    """The most similar example's call, with the function's own name."""
    told = hits.select("function_id", "rank", "example_name", F.explode("doc.examples").alias("code")).where(F.contains("code", F.concat("example_name", F.lit("("))))
    x = told.join(functions.select("function_id", "name"), "function_id").withColumn("text", _named(F.col("code"), F.col("example_name"), F.col("name")))
    return windows.top_per_key(x, ["function_id"], [F.col("rank"), F.col("text")]).select("function_id", F.lit("").alias("subject"), F.lit(1).alias("rank"), "text")


SLOTS = {"parameter": for_parameters, "raises": for_exceptions, "returns": for_returns, "behaviour": for_behaviour, "example": for_examples}


def hints(functions: DataFrame, hits: DataFrame) -> DataFrame:
    """function_id, hints (an array of HINT), examples_used: what generators read; functions
    without examples have no row."""
    found = [f(functions, hits).select("function_id", F.lit(slot).alias("slot"), "subject", F.col("rank").cast("int").alias("rank"), "text") for slot, f in SLOTS.items()]
    by = reduce(DataFrame.unionByName, found).groupBy("function_id").agg(F.sort_array(F.collect_list(F.struct("slot", "subject", "rank", "text"))).alias("hints"))
    return hits.groupBy("function_id").agg(F.count("*").cast("int").alias("examples_used")).join(by, "function_id")
