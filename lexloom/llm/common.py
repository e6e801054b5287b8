"""What the operators of this subpackage share: stored intermediate tables and components."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import functools
import gc
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import shared
from ..sources.shared import discard, shared_dir  # noqa: F401  (part of what operators use)

#: Where the running operator lists what it stores; each thread has its own.
_SCOPE: contextvars.ContextVar[list[DataFrame] | None] = contextvars.ContextVar("scope", default=None)
#: Up to so many rows of a few short columns are sent to every task (``few``).
FEW = 500_000


def store(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """``shared.store``, for ``scratch`` to clear away."""
    back = shared.store(df, label, codec)
    back.kept = False
    if (scope := _SCOPE.get()) is not None:
        scope.append(back)
    return back


def keep(table: DataFrame) -> DataFrame:
    """A stored table that a result reads: it outlives the operator that stored it."""
    table.kept = True
    return table


@contextlib.contextmanager
def scratch():
    """What is stored meanwhile is deleted at the end, but for what is kept; that is left to
    whoever asked for the result, whose own ``scratch`` deletes it. As a decorator: for a call."""
    outer, mine = _SCOPE.get(), []
    token = _SCOPE.set(mine)
    try:
        yield
    except BaseException:
        for t in mine:
            t.kept = False
        raise
    finally:
        _SCOPE.reset(token)
        discard(*(t for t in mine if not t.kept))
        for t in mine:
            if t.kept and outer is not None:
                t.kept = False
                outer.append(t)


def few(df: DataFrame, limit: int = FEW) -> DataFrame:
    """A stored table of short rows, to be joined with long ones: marked for broadcast if it
    has at most ``limit`` rows, which are then not a reason to shuffle the long ones. A
    larger one is left to a shuffle join with the same result."""
    return F.broadcast(df) if df.count() <= limit else df


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Texts can be long: a bound on the bytes of an Arrow batch bounds a Python worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


#: In a worker process: what earlier tasks keep there for tasks of the same kind, and how to drop it.
_HELD: dict[str, Callable[[], None]] = {}


def hold(name: str, drop: Callable[[], None]) -> None:
    """Says that this process keeps something under a name."""
    _HELD[name] = drop


def drop_others(keeps: str | None) -> None:
    """Of this process; a function of the module, so that workers see the module's own record
    and not a copy that came with the task."""
    for name in [n for n in _HELD if n != keeps]:
        _HELD.pop(name)()


def tidy(work, keeps: str | None = None):
    """For functions that run in Python workers, which Spark keeps between stages: before a
    task what others than those of its kind (``keeps``) have left is dropped, and at its end
    memory that is no longer in use goes back to the system."""

    @functools.wraps(work)
    def run(batches):
        drop_others(keeps)
        try:
            yield from work(batches)
        finally:
            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return run


def components(edges: DataFrame, label: str) -> DataFrame:
    """(a, b) long links -> (node, root): the smallest id reachable, for every linked node.

    Alternating large-star and small-star steps on stored edge tables: every step is a
    minimum for each node (combined before the shuffle) and a join that adaptive execution
    may split where a node has many links. Edges never reach the driver; only their count
    and checksum do. Few rounds are needed, about the logarithm of the longest path.
    """
    spark = edges.sparkSession
    e = store(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{label}-edges")
    seen = None
    while True:
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == seen or not state["n"]:
            break
        seen = state
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = store(both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"{label}-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = store(hung.unionAll(low.select("u", F.col("m").alias("v"))).distinct(), f"{label}-small")
        discard(large, e)
        e = small
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
