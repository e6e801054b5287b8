"""Monitors whose state depends on what they themselves let through.

Each is a plain fold over one key's events in time order. In batch a key's rows come to a
task as groups of bounded keys; on a stream the same fold runs with its state kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


@dataclass
class Cooldown:
    """An alert comes only if the last one that came is ``wait`` seconds ago."""

    threshold: float
    wait: float = 300.0
    last: float = float("-inf")

    def step(self, t: float, value: float) -> bool:
        if value > self.threshold and t - self.last >= self.wait:
            self.last = t
            return True
        return False


@dataclass
class Bucket:
    """Tokens refill with time up to ``burst`` and are whole numbers after each refill."""

    rate: float
    burst: int
    tokens: int = -1
    last: float = 0.0

    def step(self, t: float, cost: int = 1) -> bool:
        if self.tokens < 0:
            self.tokens, self.last = self.burst, t
        self.tokens = int(min(self.burst, self.tokens + (t - self.last) * self.rate))
        self.last = t
        if self.tokens >= cost:
            self.tokens -= cost
            return True
        return False


@dataclass
class Breaker:
    """closed, open after ``limit`` failures, half_open after ``rest`` seconds; a success in
    half_open closes it, otherwise successes take one failure back."""

    limit: int = 5
    rest: float = 60.0
    state: str = "closed"
    failures: int = 0
    last: float = 0.0

    def step(self, t: float, ok: bool) -> bool:
        if self.state == "open":
            if t - self.last < self.rest:
                return False
            self.state = "half_open"
        if ok:
            if self.state == "half_open":
                self.state, self.failures = "closed", 0
            else:
                self.failures = max(0, self.failures - 1)
        else:
            self.failures += 1
            self.last = t
            if self.state == "half_open" or self.failures >= self.limit:
                self.state = "open"
        return True


@dataclass
class Lifecycle:
    """generated -> displayed -> accepted, rejected or modified; later events don't undo."""

    stage: str = "generated"
    shown: bool = False
    order: dict[str, int] = field(default_factory=lambda: {"generated": 0, "displayed": 1, "modified": 2, "rejected": 3, "accepted": 3})

    def step(self, t: float, event: str) -> bool:
        self.shown |= event == "displayed"
        ahead = self.order.get(event, -1) > self.order[self.stage]
        if ahead:
            self.stage = event
        return ahead


def fold(events: DataFrame, key: str, make, arguments, passed: str = "passed") -> DataFrame:
    """(key, event_id, t, x) -> event_id, passed: make() folds over each key's events by (t, event_id).

    Rows of a key come sorted from the shuffle and are read as a stream; only the monitor's
    few numbers are held, so a hot key takes time but no memory."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, monitor = None, None
        for b in batches:
            out = []
            for k, t, x in zip(b[key], b["t"], b["x"], strict=True):
                if monitor is None or k != last:
                    last, monitor = k, make()
                out.append(monitor.step(t, arguments(x)))
            yield pd.DataFrame({"event_id": b["event_id"], passed: out})

    return events.repartition(key).sortWithinPartitions(key, "t", "event_id").mapInPandas(work, f"event_id long, {passed} boolean")


def fold_stream(events: DataFrame, key: str, make, arguments, watermark: str = "10 minutes") -> DataFrame:
    """The same on a stream (key, event_id, ts, x): state is the monitor's fields; a key
    without events for a day of event time loses it. Late events beyond the watermark are dropped."""
    names = [n for n, v in asdict(make()).items() if isinstance(v, (int, float, str))]
    kinds = {int: "long", bool: "boolean", float: "double", str: "string"}
    state_schema = ", ".join(f"{n} {kinds[type(getattr(make(), n))]}" for n in names)

    def work(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        monitor = make()
        if state.exists:
            for n, v in zip(names, state.get, strict=True):
                setattr(monitor, n, v)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = [monitor.step(t.timestamp(), arguments(x)) for t, x in zip(rows["ts"], rows["x"], strict=True)]
        state.update(tuple(getattr(monitor, n) for n in names))
        state.setTimeoutTimestamp(int(rows["ts"].max().timestamp() * 1000) + 24 * 3600 * 1000)
        yield pd.DataFrame({"event_id": rows["event_id"].to_numpy(), "passed": out})

    return events.withWatermark("ts", watermark).groupBy(key).applyInPandasWithState(work, "event_id long, passed boolean", state_schema, "append", GroupStateTimeout.EventTimeTimeout)


def windowed_stats(events: DataFrame, key: str, value: str, time: str = "ts", width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and means of event-time windows, on a stream or a table."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("most"))


def lifecycle(events: DataFrame) -> DataFrame:
    """(suggestion_id, event, t) -> the state of each suggestion, by aggregates alone."""
    at = lambda e: F.min(F.when(F.col("event") == e, F.col("t")))
    x = events.groupBy("suggestion_id").agg(at("generated").alias("generated"), at("displayed").alias("displayed"), at("accepted").alias("accepted"), at("rejected").alias("rejected"), at("modified").alias("modified"))
    return x.select("suggestion_id", F.col("displayed").isNotNull().alias("shown"), (F.col("accepted").isNotNull() & (F.col("rejected").isNull() | (F.col("accepted") <= F.col("rejected")))).alias("accepted"), F.col("modified").isNotNull().alias("modified"), (F.coalesce("accepted", "rejected") - F.col("displayed")).alias("time_to_decision"))
