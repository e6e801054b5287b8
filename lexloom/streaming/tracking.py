"""Following operations while they run: time, memory, counters, callbacks."""

from __future__ import annotations

import resource
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass
class Tracker:
    """with Tracker("parse") as t: ... -> t.seconds, t.memory_mb (growth of the peak), t.ok.
    Callbacks get the tracker when it ends, also if the operation failed."""

    operation: str
    threshold: float = 1.0
    callbacks: list[Callable[[Tracker], None]] = field(default_factory=list)
    seconds: float = 0.0
    memory_mb: float = 0.0
    ok: bool = True

    def __enter__(self) -> Tracker:
        self._began, self._peak = time.perf_counter(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        return self

    def __exit__(self, kind, *_) -> None:
        self.seconds = time.perf_counter() - self._began
        self.memory_mb = (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - self._peak) / 1024
        self.ok = kind is None
        for f in self.callbacks:
            f(self)

    @property
    def slow(self) -> bool:
        return self.seconds > self.threshold


def observed(df: DataFrame, name: str, **counters: Column) -> tuple[DataFrame, Observation]:
    """df with counters that are known once an action over it has run: no pass of their own."""
    o = Observation(name)
    return df.observe(o, *(c.alias(k) for k, c in counters.items())), o


def on_each(stream: DataFrame, call: Callable[[list], None], most: int = 1000, **options):
    """Calls back with the rows of each micro-batch of alerts, at most ``most`` at a time."""

    def handle(batch: DataFrame, _: int) -> None:
        held = []
        for row in batch.toLocalIterator():
            held.append(row)
            if len(held) == most:
                call(held)
                held = []
        if held:
            call(held)

    writer = stream.writeStream.foreachBatch(handle)
    for k, v in options.items():
        writer = writer.option(k, v)
    return writer


def memory_used(before: Column, after: Column) -> Column:
    return F.greatest(F.lit(0.0), after - before)
