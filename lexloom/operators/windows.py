"""Best per key, top k per key and last-n frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1, rank: str | None = None) -> DataFrame:
    """The first k rows of each key in the given (total) order. The planner cuts each task's
    rows to k per key before the shuffle, so a hot key costs k rows per task."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def last_n(value: Column, order: Sequence[Column], n: int, keys: Sequence[str] = (), least: int = 1, fold=F.avg) -> Column:
    """fold of the last n rows (this one included); null while there are fewer than least."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - n, 0)
    return F.when(F.count(F.lit(1)).over(w) >= least, fold(value).over(w))


def keep_most_used(df: DataFrame, keys: Sequence[str], uses: str, used_at: str, limit: int, keep: int) -> DataFrame:
    """Cache clean-up: beyond limit rows of a key only the keep most used (then latest) stay."""
    n = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(uses), F.desc(used_at), *df.columns)))
    # No rank above both numbers can stay, so a task's rows are cut to that many before the shuffle.
    ranked = ranked.where(F.col("_rank") <= max(limit, keep))
    return ranked.join(n, list(keys)).where((F.col("_n") <= limit) | (F.col("_rank") <= keep)).drop("_rank", "_n")


def most_similar(df: DataFrame, key: str | Sequence[str], similarity: str, k: int = 5) -> DataFrame:
    """The k most similar distinct descriptions of each key (one column, or several)."""
    keys = [key] if isinstance(key, str) else list(key)
    best = df.groupBy(*keys, "description").agg(F.max(similarity).alias(similarity))
    return top_per_key(best, keys, [F.desc(similarity), F.col("description")], k, "rank")
