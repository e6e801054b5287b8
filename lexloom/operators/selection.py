"""Exact percentiles of large groups: the ranks that are asked for are narrowed down, never a group sorted.

A group's values are counted in bins between approximate quantiles, which are a mergeable
sketch of bounded size. Only the bins that hold an asked rank are looked into again, until each
has few rows, or only one value. So no task holds a group, however large, and equal values cost nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import shared
from .windows import last_n

#: A range with at most so many values is sorted.
FEW = 100_000
#: Bins of one round.
BINS = 64
#: A table with at most so many rows takes the plain plan, in which a task holds a group: same rows, fewer jobs.
PLAIN = 1_000_000


def percentiles(rows: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], few: int = FEW, bins: int = BINS, plain: int = PLAIN) -> DataFrame:
    """keys and ``p``: the percentiles of the non-null values of each group, between two
    neighbours in proportion, as ``percentile`` gives them; null where a group has none.
    Groups with null keys are groups of their own."""
    if plain and rows.count() <= plain:
        p = F.percentile(F.col(value).cast("double"), F.array(*map(F.lit, map(float, shares))))
        return rows.groupBy(*keys).agg(p.alias("p"))
    # A struct is an equality key in which nulls are values.
    x = shared.store(rows.select(F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.lit(0).alias("one")).alias("key"), F.col(value).cast("double").alias("v")), "values")
    groups = shared.store(x.groupBy("key").agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")), "groups")
    at = lambda s: F.lit(float(s)) * (F.col("n") - 1)
    ranks = F.array_distinct(F.array(*(f(at(s)) for s in shares for f in (F.floor, F.ceil))))
    # Of a rank it is known that it is among the n values from low to high, with ``before`` values below them.
    asked = groups.where("n > 0").select("key", "low", "high", F.lit(0).cast("long").alias("before"), "n", F.explode(ranks).alias("rank"))
    done: list[DataFrame] = []
    while True:
        done.append(asked.where("low = high").select("key", "rank", F.col("low").alias("v")))
        small = asked.where(f"low < high and n <= {few}")
        place = F.row_number().over(Window.partitionBy("key", "low").orderBy("v")) - 1 + F.col("before")
        done.append(_within(x, small).select("key", "v", place.cast("long").alias("rank")).join(small.select("key", "rank"), ["key", "rank"]).select("key", "rank", "v"))
        large = asked.where(f"low < high and n > {few}")
        if large.isEmpty():
            break
        asked = shared.store(_narrowed(x, large, bins), "ranks")
    by = reduce(DataFrame.unionAll, done).distinct().groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("m"))

    def percentile(share: float):
        low, high = (F.try_element_at("m", f(at(share))) for f in (F.floor, F.ceil))
        return F.when(F.floor(at(share)) == F.ceil(at(share)), low).otherwise((F.ceil(at(share)) - at(share)) * low + (at(share) - F.floor(at(share))) * high)

    p = F.when(F.col("n") > 0, F.array(*map(percentile, shares)))
    return groups.join(by, "key", "left").select(*(F.col(f"key.k{i}").alias(k) for i, k in enumerate(keys)), p.alias("p"))


def _within(x: DataFrame, asked: DataFrame) -> DataFrame:
    """The values of the ranges of asked ranks: ranges of a group do not overlap, and there are
    at most two for each share, so they are joined to the values as one short array for each group."""
    ranges = asked.groupBy("key").agg(F.collect_set(F.struct("low", "high", "before", "n")).alias("ranges"))
    mine = F.get(F.filter("ranges", lambda r: (F.col("v") >= r["low"]) & (F.col("v") <= r["high"])), F.lit(0))
    return x.join(ranges, "key").withColumn("r", mine).where("r is not null").select("key", "v", "r.low", "r.high", "r.before", "r.n")


def _narrowed(x: DataFrame, asked: DataFrame, bins: int) -> DataFrame:
    """The same ranks in narrower ranges: those between two neighbouring approximate quantiles of
    the range. A quantile that is the range's own end, or very frequent, gets a bin of its own value."""
    inside = _within(x, asked)
    cuts = inside.groupBy("key", "low").agg(F.array_distinct(F.percentile_approx("v", [i / bins for i in range(1, bins)], 1000)).alias("cuts"))
    # Bin 2i is below cut i and above the one before, bin 2i + 1 is cut i itself.
    below = F.size(F.filter("cuts", lambda c: c < F.col("v")))
    bin_ = 2 * below + F.when(F.exists("cuts", lambda c: c == F.col("v")), 1).otherwise(0)
    counted = inside.join(cuts, ["key", "low"]).groupBy("key", F.col("low").alias("of"), "before", bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    w = Window.partitionBy("key", "of").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("before", F.col("before") + F.coalesce(F.sum("n").over(w), F.lit(0)))
    ranks = asked.select("key", F.col("low").alias("of"), "rank")
    hit = ranks.join(placed, ["key", "of"]).where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n")))
    return hit.select("key", "low", "high", "before", "n", "rank")


def rolling(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, id_: str, share: float, n: int, least: int = 1, parts: int | None = None, plain: int = PLAIN) -> DataFrame:
    """id, ``p``: of each row the percentile of the last n values of its group, this one
    included, in the order given; null while there are fewer than ``least`` rows.

    Rows are dealt by ranges of (keys, order), so a group is spread over as many tasks as it
    needs; each task is also sent the n - 1 rows before its first one. In a task the last n values are kept
    sorted: a row costs two searches, not a sort. id and order are without nulls and unique together."""
    spark = rows.sparkSession
    if plain and rows.count() <= plain:
        fold = lambda c: F.percentile(c, F.lit(float(share)))
        return rows.select(id_, last_n(F.col(value).cast("double"), [F.col(o) for o in order], n, keys, least, fold).alias("p"))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    x = rows.select(F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.lit(0).alias("one")).alias("key"), F.struct(*(F.col(o).alias(f"o{i}") for i, o in enumerate(order))).alias("at"), F.col(value).cast("double").alias("v"), F.col(id_).alias("id"))
    kind = x.schema["id"].dataType.simpleString()
    dealt = shared.store(x.repartitionByRange(parts, "key", "at").select("*", F.spark_partition_id().alias("part")), "rolling")
    # The last n - 1 rows of each group in each part go to the next parts in which the group goes on.
    own = dealt.groupBy("key", "part").agg(F.count("*").alias("here"))
    spread = own.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("part", "here"))).alias("all")).where(F.size("all") > 1)
    back = F.row_number().over(Window.partitionBy("key", "part").orderBy(F.desc("at")))
    tail = dealt.join(spread, "key").withColumn("back", back).where(F.col("back") < n)
    later = F.filter("all", lambda p: p["part"] > F.col("part"))
    gap = lambda p: F.aggregate(F.filter("all", lambda q: (q["part"] > F.col("part")) & (q["part"] < p["part"])), F.lit(0).cast("long"), lambda s, q: s + q["here"])
    to = F.filter(later, lambda p: gap(p) + F.col("back") < n)
    sent = tail.withColumn("to", F.explode(F.transform(to, lambda p: p["part"]))).select("key", "at", "v", "id", F.col("to").alias("part"), F.lit(False).alias("own"))
    every = dealt.select("key", "at", "v", "id", "part", F.lit(True).alias("own")).unionByName(sent)
    streams = every.repartition(parts, "part", "key").sortWithinPartitions("part", "key", "at").select(F.col("key").cast("string").alias("k"), "part", "v", "id", "own")

    def work(batches):
        import bisect
        from collections import deque

        import pandas as pd

        at, last, ordered, seen = None, deque(), [], 0
        for b in batches:
            out = []
            for k, part, v, i, mine in zip(b["k"], b["part"], b["v"], b["id"], b["own"], strict=True):
                if at != (k, part):
                    at, last, ordered, seen = (k, part), deque(), [], 0
                last.append(v)
                if v == v:
                    bisect.insort(ordered, v)
                if len(last) > n and (old := last.popleft()) == old:
                    del ordered[bisect.bisect_left(ordered, old)]
                if mine:
                    p = None
                    if len(last) >= least and ordered:
                        place = share * (len(ordered) - 1)
                        low = int(place)
                        high = min(low + 1, len(ordered) - 1)
                        p = ordered[low] if place == low else (low + 1 - place) * ordered[low] + (place - low) * ordered[high]
                    out.append((i, p))
            yield pd.DataFrame(out, columns=["id", "p"])

    return streams.mapInPandas(work, f"id {kind}, p double").withColumnRenamed("id", id_)
