"""Functions to their documentation: direct, contextual and semantic stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names, scores
from . import docstrings, joins, nearest, parse, rules
from .windows import top_per_key


def documented(functions: DataFrame) -> DataFrame:
    """With the parsed documentation as ``doc`` (null without one) and ``exceptions``."""
    doc = F.when(F.col("raw_doc").isNotNull(), docstrings.parsed("raw_doc"))
    return functions.withColumns({"doc": doc, "exceptions": parse.exceptions("source_code")})


def direct(functions: DataFrame, least: float = 0.7) -> DataFrame:
    """A function and its own documentation, no join: 0.4 + 0.4 + 0.2 signature similarity."""
    s = rules.signature_similarity()
    out = functions.where("raw_doc is not null").select("function_id", "name", "file_path", F.lit("exact").alias("match_type"), s.alias("signature_similarity"), (0.8 + 0.2 * s).alias("confidence"))
    return out.where(F.col("confidence") >= least)


def registry(functions: DataFrame) -> DataFrame:
    """(name, module, function_id): the last function of a name in a module counts."""
    x = functions.withColumn("module", names.module_of(F.col("file_path")))
    return top_per_key(x, ["name", "module"], [F.desc("line_number")]).select("name", "module", "function_id")


def imported(functions: DataFrame, imports: DataFrame, known: DataFrame) -> DataFrame:
    """Functions whose own module imports their name from a module that defines it."""
    own = functions.select("function_id", "name", names.module_of(F.col("file_path")).alias("module"))
    asked = imports.select("module", "source", F.explode("imported_names").alias("name"))
    target = known.select("name", F.col("module").alias("source"), F.col("function_id").alias("doc_function_id"))
    hit = own.join(asked, ["module", "name"]).join(target, ["name", "source"])
    return top_per_key(hit, ["function_id"], [F.col("source")]).select("function_id", "doc_function_id", F.lit(0.9).alias("confidence"))


def moved(functions: DataFrame, known: DataFrame) -> DataFrame:
    """Functions with exactly one namesake outside their own module and what lies below it."""
    own = functions.select("function_id", "name", names.module_of(F.col("file_path")).alias("own"))
    # Namesakes are counted once for each name, and once for each package above them; so a
    # name that very many modules have (main) is never paired with itself.
    all_ = known.groupBy("name").agg(F.count("*").alias("all"), F.min("module").alias("low"), F.max("module").alias("high"), F.min_by("function_id", "module").alias("low_id"), F.max_by("function_id", "module").alias("high_id"))
    path = F.split("module", r"\.")
    above = known.select("name", F.explode(F.transform(F.sequence(F.lit(1), F.size(path)), lambda n: F.array_join(F.slice(path, 1, n), "."))).alias("own"), "module", "function_id")
    inside = above.groupBy("name", "own").agg(F.count("*").alias("within"))
    x = own.join(all_, "name").join(inside, ["name", "own"], "left").where(F.col("all") - F.coalesce("within", F.lit(0)) == 1)
    # With one left outside, and the others in one place, it is first or last by module.
    below = lambda m: (m == F.col("own")) | m.startswith(F.concat("own", F.lit(".")))
    x = x.withColumn("doc_function_id", F.when(~below(F.col("low")), F.col("low_id")).otherwise(F.col("high_id")))
    return x.select("function_id", "doc_function_id", F.lit(0.85).alias("confidence"))


def by_relevance(functions: DataFrame, hint: Column) -> DataFrame:
    """Lookup order: the hinted module, its parent or child, any other."""
    m = F.col("module")
    rank = F.when(m == hint, 0.0).when(m.startswith(F.concat(hint, F.lit("."))) | F.startswith(hint, F.concat(m, F.lit("."))), 0.5).otherwise(1.0)
    return functions.withColumn("relevance", rank).orderBy("relevance", "module")


def module_docs(modules: DataFrame) -> DataFrame:
    """``name: text`` blocks of module documentation -> (module, name, text)."""
    lines = F.split("module_doc", "\n")
    head = r"^\s*([A-Za-z_]\w*)(?:\(.*?\))?:\s+(\S.*)$"
    x = modules.where("module_doc is not null").select("module", F.posexplode(lines).alias("at", "line")).where(F.col("line").rlike(head))
    x = x.select("module", "at", F.regexp_extract("line", head, 1).alias("name"), F.regexp_extract("line", head, 2).alias("text"))
    return top_per_key(x, ["module", "name"], [F.col("at")]).select("module", "name", "text")


def cross_file(functions: DataFrame, module_texts: DataFrame) -> DataFrame:
    """Functions with a summary of at most 20 characters, described in their module's or a
    parent package's documentation; the nearest wins."""
    m = F.split(names.module_of(F.col("file_path")), r"\.")
    own = functions.where(F.length(F.coalesce("raw_doc", F.lit(""))) <= 20).select("function_id", "name", F.posexplode(F.transform(F.sequence(F.size(m), F.greatest(F.size(m) - 2, F.lit(1)), F.lit(-1)), lambda n: F.array_join(F.slice(m, 1, n), "."))).alias("distance", "module"))
    hit = own.join(module_texts, ["module", "name"])
    return top_per_key(hit, ["function_id"], [F.col("distance")]).select("function_id", F.concat("module", F.lit(":"), "name").alias("doc_function_id"), F.lit(0.7).alias("confidence"))


def contextual(functions: DataFrame, earlier: DataFrame, imports: DataFrame, module_texts: DataFrame, good: float = 0.8) -> DataFrame:
    """What earlier matches (at least good) left, by import, then move, then other files."""
    left = joins.unmatched(functions, "function_id", earlier, F.col("confidence") >= good)
    known = registry(functions.where("raw_doc is not null"))
    return joins.cascade(left, "function_id", [imported(left, imports, known), moved(left, known), cross_file(left, module_texts)])


def semantic(left: DataFrame, vectors: DataFrame, least: float = 0.65, k: int = 10) -> DataFrame:
    """(function_id, name, module) without a match, vectors (function_id, name, module, vec):
    the best adjusted neighbour of the k nearest, found exactly for all of them."""
    q = left.join(vectors.select("function_id", "vec"), "function_id").select(F.col("function_id").alias("q_id"), F.col("vec").alias("q_vec"))
    near = nearest.knn_join(q, vectors.select(F.col("function_id").alias("id"), "vec"), k)
    a = left.select(F.col("function_id").alias("q_id"), F.col("name").alias("q_name"), F.col("module").alias("q_module"))
    b = vectors.select(F.col("function_id").alias("id"), "name", "module")
    x = near.join(a, "q_id").join(b, "id")
    adjusted = scores.semantic_adjusted(F.col("similarity"), names.follows_pattern("q_name", "name"), names.character_similarity("q_name", "name"), names.module_distance("q_module", "module"))
    best = top_per_key(x.withColumn("adjusted", adjusted), ["q_id"], [F.desc("adjusted"), F.col("id")])
    return best.where(F.col("adjusted") >= least).select(F.col("q_id").alias("function_id"), F.col("id").alias("doc_function_id"), scores.confidence_band("adjusted").alias("confidence"))


def signature_text() -> Column:
    """name(a: int, b=1) -> str"""
    p = F.transform("parameters", lambda p: F.concat(p["name"], F.when(p["type_annotation"].isNotNull(), F.concat(F.lit(": "), p["type_annotation"])).otherwise(""), F.when(p["default_value"].isNotNull(), F.concat(F.lit(" = "), p["default_value"])).otherwise("")))
    return F.concat(F.when(F.col("is_async"), "async def ").otherwise("def "), "name", F.lit("("), F.array_join(p, ", "), F.lit(")"), F.when(F.col("return_type").isNotNull(), F.concat(F.lit(" -> "), "return_type")).otherwise(""))


def embedding_text(limit: int = 512) -> Column:
    """Signature | first documentation line, cut with an ellipsis."""
    t = F.concat_ws(" | ", signature_text(), F.get(F.split("raw_doc", "\n"), F.lit(0)))
    return F.when(F.length(t) > limit, F.concat(F.left(t, F.lit(limit - 3)), F.lit("..."))).otherwise(t)


def special_constructs() -> Column:
    """property, classmethod, staticmethod, overload, async, context manager, magic, generator."""
    has = lambda d: F.exists("decorators", lambda x: x.rlike(rf"(^|\.){d}(\(|$)"))
    return F.array_compact(F.array(*(F.when(has(d), d) for d in ("property", "classmethod", "staticmethod", "overload", "contextmanager")), F.when(F.col("is_async"), "async"), F.when(F.col("name").rlike("^__.*__$"), "magic"), F.when(F.col("source_code").rlike(r"(?m)^\s*yield\b"), "generator")))


def import_chain(imports: DataFrame) -> DataFrame:
    """imports -> (module, name, alias, source): what each module calls by which name and
    where it is from, one step."""
    rows = imports.where("import_type <> 'wildcard'").select("module", "source", "aliases", F.explode("imported_names").alias("name"))
    alias = F.get(F.map_keys(F.map_filter("aliases", lambda k, v: v == F.col("name"))), F.lit(0))
    return rows.select("module", F.coalesce(alias, "name").alias("called"), "name", "source")


def chain(imports: DataFrame, start: str, end: str) -> DataFrame:
    """The names by which one module reaches another directly, aliases resolved."""
    return import_chain(imports).where((F.col("module") == start) & (F.col("source") == end)).select("called", "name", F.array(F.lit(start), F.lit(end)).alias("chain"))


def module_files(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(module), (path) -> module, path: its file, or its package's, if there is one."""
    p = F.translate("module", ".", "/")
    asked = wanted.select("module", F.posexplode(F.array(F.concat(p, F.lit(".py")), F.concat(p, F.lit("/__init__.py")))).alias("order", "path"))
    return top_per_key(asked.join(files.select("path"), "path", "left_semi"), ["module"], [F.col("order")]).select("module", "path")


def functions_of_module(known: DataFrame, module: str) -> DataFrame:
    return known.where(F.col("module") == module).orderBy("name")
