"""Vectors of functions: made by functions that the caller passes in, one after the other
until one succeeds, or offline by hashing words.

A vector maker gets a list of texts and returns a list of vectors. What fails is a row with
an error, never a failed job.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from . import routing

Maker = Callable[[list[str]], "list[list[float]]"]

# Models by name, their vectors' length and price for a thousand tokens.
MODELS = {"small": (384, 0.00002), "large": (1536, 0.00013), "hashing": (64, 0.0)}


def hashed_words(texts: list[str], size: int = 64) -> list[list[float]]:
    """Offline: each word counts up or down in a place that its hash decides."""
    out = []
    for t in texts:
        v = [0.0] * size
        for w in t.lower().replace("_", " ").split():
            h = zlib.crc32(w.encode())
            v[h % size] += 1.0 if h & 1 << 31 else -1.0
        out.append(v)
    return out


@dataclass
class TwoState:
    """closed until ``limit`` failures in a row, then open for ``rest`` seconds, after which
    the next success closes it; can be forced either way."""

    limit: int = 5
    rest: float = 60.0
    failures: int = 0
    opened: float | None = None
    forced: str | None = None

    def allows(self, now: float) -> bool:
        if self.forced:
            return self.forced == "closed"
        return self.opened is None or now - self.opened >= self.rest

    def step(self, now: float, ok: bool) -> bool:
        """Whether a call at this time is let through; ok: what it gives if it is."""
        if not self.allows(now):
            return False
        if ok:
            self.failures, self.opened = 0, None
        else:
            self.failures += 1
            if self.failures >= self.limit:
                self.opened = now
        return True


def generate(texts: DataFrame, makers: Sequence[tuple[str, Maker]] = (("hashing", hashed_words),), batch: int = 100, limit: int = 5) -> DataFrame:
    """texts (function_id, text) -> function_id, model, cache_key, vec, error.

    Batches of ``batch`` go to the first maker; what it fails on, or answers with another number of vectors, goes one by one to it and
    then to the next. A maker that fails ``limit`` times in a row in a task is passed over
    for the rest of that task's rows."""

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        broken = {name: TwoState(limit, float("inf")) for name, _ in makers}

        def tried(text: str) -> tuple[str | None, list[float] | None, str | None]:
            error = "no maker"
            for name, f in makers:
                if not broken[name].allows(0.0):
                    continue
                try:
                    v = routing.replied(f, [text])[0]
                    broken[name].step(0.0, True)
                    return name, v, None
                except Exception as e:  # noqa: BLE001  a failing service is data here
                    error = f"{name}: {e}"
                    broken[name].step(0.0, False)
            return None, None, error

        for b in batches:
            for at in range(0, len(b), batch):
                part = b.iloc[at : at + batch]
                rows: list[tuple] = []
                name, f = makers[0]
                if broken[name].allows(0.0):
                    try:
                        rows = [(name, v, None) for v in routing.replied(f, part["text"].tolist())]
                    except Exception:  # noqa: BLE001
                        rows = []
                rows = rows or [tried(t) for t in part["text"]]
                yield pd.DataFrame({"function_id": part["function_id"].to_numpy(), "model": [r[0] for r in rows], "vec": [r[1] for r in rows], "error": [r[2] for r in rows], "text": part["text"].to_numpy()})

    made = texts.select("function_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(work, "function_id string, model string, vec array<double>, error string, text string")
    return made.select("function_id", "model", hashing.embedding_key(F.col("text"), F.coalesce("model", F.lit(""))).alias("cache_key"), "vec", "error")


def with_cache(texts: DataFrame, cache: DataFrame, **options) -> DataFrame:
    """Cached vectors (function_id, vec) of the wanted functions, and fresh ones for the rest."""
    from ..sources import stores

    make = lambda missing: generate(missing, **options).where("vec is not null").select("function_id", "vec")
    return stores.fill_misses(texts, cache.select("function_id", "vec"), "function_id", make)


def readiness(vectors: DataFrame, functions: DataFrame) -> DataFrame:
    """One row: functions, how many have a vector, the share, and whether that is at least a half."""
    x = functions.select("function_id").join(vectors.where("vec is not null").select("function_id", F.lit(1).alias("has")), "function_id", "left")
    n = x.agg(F.count("*").alias("functions"), F.count("has").alias("embedded"))
    share = F.when(F.col("functions") > 0, F.col("embedded") / F.col("functions")).otherwise(0.0)
    return n.withColumn("share", share).withColumn("ready", share >= 0.5)
