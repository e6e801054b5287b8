"""The corpus of examples: what goes in, what is wrong with it, and its figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def joined(*tables: DataFrame) -> DataFrame:
    """All rows of all tables, repeated ones too; columns that one lacks are null there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def bootstrap(functions: DataFrame, quality: Column, complexity: Column, least: int = 3, most: int = 150) -> DataFrame:
    """The best documented functions as examples, the best and most complex first. The limit
    is the corpus's size, a setting."""
    x = functions.where("raw_doc is not null").withColumn("quality_score", quality).withColumn("complexity_score", complexity)
    return x.where(F.col("quality_score") >= least).orderBy(F.desc("quality_score"), F.desc("complexity_score"), "function_id").limit(most)


def distribution(examples: DataFrame, of: str) -> DataFrame:
    return examples.groupBy(of).agg(F.count("*").alias("n"))


REQUIRED = ("function_name", "module_path", "function_signature", "docstring_format", "docstring_content")


def faults(examples: DataFrame, least_text: int = 20) -> DataFrame:
    """examples -> example_id, fault: missing fields, short texts, scores out of range, and
    names that occur twice in a module."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    own = F.array_compact(F.array(
        *(F.when(blank(F.col(c)), f"no {c}") for c in REQUIRED), F.when(~blank(F.col("docstring_content")) & (F.length("docstring_content") < least_text), "short text"),
        F.when(~F.coalesce(F.col("quality_score").between(1, 5), F.lit(False)), "quality out of range"), F.when(~F.coalesce(F.col("complexity_score").between(1, 5), F.lit(False)), "complexity out of range"),
    ))
    key = ["module_path", "function_name"]
    twice = examples.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key)
    return examples.select("example_id", F.explode(own).alias("fault")).unionByName(examples.join(twice, key, "left_semi").select("example_id", F.lit("duplicate").alias("fault")))


def short_categories(examples: DataFrame, wanted: dict[str, int]) -> DataFrame:
    """category, n, wanted: categories with fewer examples than wanted, also with none."""
    spark = examples.sparkSession
    dim = spark.createDataFrame(list(wanted.items()), "category string, wanted int")
    n = examples.groupBy("category").agg(F.count("*").alias("n"))
    return F.broadcast(dim).join(n, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"), "wanted").where("n < wanted")


def text_form() -> Column:
    """An example as one text: name, signature, documentation, each on lines of its own."""
    return F.concat_ws("\n", F.concat(F.lit("Function: "), F.col("function_name")), F.concat(F.lit("Signature: "), F.col("function_signature")), F.col("docstring_content"))


def statistics(examples: DataFrame) -> DataFrame:
    """One row: examples, by source, mean quality and complexity, formats."""
    by = lambda s: F.count_if(F.col("source") == s).alias(s)
    return examples.agg(F.count("*").alias("examples"), by("bootstrap"), by("curated"), by("accepted"), F.avg("quality_score").alias("mean_quality"), F.avg("complexity_score").alias("mean_complexity"), F.count_distinct("docstring_format").alias("formats"))


def hit_counts(cache: DataFrame, reads: DataFrame, key: str = "cache_key") -> DataFrame:
    """The cache with hit_count and accessed_at brought up to date by reads (key, t)."""
    n = reads.groupBy(key).agg(F.count("*").alias("more"), F.max("t").alias("last"))
    return cache.join(n, key, "left").withColumn("hit_count", F.col("hit_count") + F.coalesce("more", F.lit(0))).withColumn("accessed_at", F.greatest("accessed_at", "last")).drop("more", "last")


def cache_statistics(cache: DataFrame, as_of: Column, ttl_days: float, top: int = 10) -> DataFrame:
    """One row: entries, valid ones, reads of them, hit share (reads over reads and entries),
    and the most read keys."""
    valid = F.col("created_at") >= as_of - F.lit(ttl_days * 86400.0)
    best = cache.orderBy(F.desc("hit_count"), "cache_key").limit(top).agg(F.sort_array(F.collect_list(F.struct((-F.col("hit_count")).alias("n"), "cache_key"))).alias("b"))
    x = cache.agg(F.count("*").alias("entries"), F.count_if(valid).alias("valid"), F.coalesce(F.sum("hit_count"), F.lit(0)).alias("reads"))
    x = x.withColumn("hit_share", F.when(F.col("reads") + F.col("entries") > 0, F.col("reads") / (F.col("reads") + F.col("entries"))).otherwise(0.0))
    return x.join(F.broadcast(best.select(F.transform("b", lambda b: b["cache_key"]).alias("most_read"))))
