"""Packing documents into sequences of bounded length.

Only the lengths matter, and there are at most ``capacity`` of them: the number of pieces
of each length is all that planning needs, however many documents there are. On these counts
the reduction of Martello and Toth first fixes sequences that dominate every other way to
fill a sequence with the longest piece left: the piece alone if nothing fits beside it, with
the longest that fits if that fills the rest or no two others fit together or none add up to
more, or with a pair that fills the rest no worse than any other. What remains goes by
best fit, longest first. Every decision is made for as many pieces at once as the counts
allow, so a plan is a few thousand intervals at any scale; pieces find their places by
their rank among those of their length.
"""

from __future__ import annotations

import bisect
import functools
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, wordcache


class _Counts:
    """How many pieces of each length are left, and the lengths in order."""

    def __init__(self, counts: dict[int, int]):
        self.n = {w: c for w, c in counts.items() if c > 0}
        self.order = sorted(self.n)

    def take(self, w: int, m: int) -> None:
        self.n[w] -= m
        if not self.n[w]:
            del self.n[w]
            self.order.pop(bisect.bisect_left(self.order, w))

    def at_most(self, w: int) -> int | None:
        i = bisect.bisect_right(self.order, w)
        return self.order[i - 1] if i else None

    def least(self, k: int) -> int | None:
        """The sum of the k shortest."""
        total = 0
        for w in self.order:
            m = min(k, self.n[w])
            total, k = total + m * w, k - m
            if not k:
                return total
        return None


def _best_pair(c: _Counts, room: int) -> tuple[int, int] | None:
    """Two pieces with the largest sum that fits, the first the longer."""
    best, lo, hi = None, 0, len(c.order) - 1
    while lo <= hi:
        a, b = c.order[hi], c.order[lo]
        if a + b > room or a == b and c.n[a] < 2:
            hi -= 1
        else:
            if best is None or a + b > sum(best):
                best = (a, b)
            lo += 1
    return best


def dominant_set(c: _Counts, j: int, room: int) -> list[int] | None:
    """What to put beside a piece of length j (already taken out of c, leaving room) such
    that no other choice can be better; None if the criteria don't tell.

    A set dominates another if the other's pieces can be dealt into groups, each no longer
    than its own piece of the first."""
    k = c.at_most(room)
    if k is None:
        return []
    if k == room:
        return [k]
    two = c.least(2)
    if two is None or two > room:
        return [k]
    three = c.least(3)
    if three is not None and three <= room:
        return None
    a, b = _best_pair(c, room)  # at most two fit
    if a + b <= k:
        return [k]
    if a == k:
        # any pair (x, y), x >= y, has x <= a; either y <= b, or both go into a's place
        longer = [w for w in c.order if w > b]
        if not longer or (longer[0] + longer[0] > room and (len(longer) < 2 or longer[0] + longer[1] > room)):
            return [a, b]
    return None


def plan(counts: dict[int, int], capacity: int) -> tuple[pd.DataFrame, int]:
    """counts: pieces of each length. -> intervals (length, rank, n, sequence, each, offset)
    and the number of sequences. The n pieces of a length from that rank on go to sequences
    from ``sequence`` on, ``each`` to a sequence, the first at ``offset``."""
    rows: list[tuple[int, int, int, int, int, int]] = []
    used: dict[int, int] = {}
    bins = 0

    def place(w: int, n: int, sequence: int, each: int, offset: int) -> None:
        rows.append((w, used.get(w, 0), n, sequence, each, offset))
        used[w] = used.get(w, 0) + n

    c = _Counts(counts)
    changed = True
    while changed:
        changed = False
        for j in sorted(c.order, reverse=True):
            while c.n.get(j):
                c.take(j, 1)
                beside = dominant_set(c, j, capacity - j)
                if beside is None:
                    c.n[j] = c.n.get(j, 0) + 1
                    if c.n[j] == 1:
                        bisect.insort(c.order, j)
                    break
                need = {w: beside.count(w) for w in beside}
                same = need.get(j, 0)
                # The same choice dominates until one of its lengths runs out.
                m = min([1 + (c.n.get(j, 0) - same) // (1 + same), *(c.n[w] // k for w, k in need.items() if w != j)])
                if same or m < 1:
                    m = max(1, m)
                at = 0
                for w in [j, *beside]:
                    place(w, m, bins, 1, at)
                    at += w
                if m > 1:
                    c.take(j, m - 1)
                for w, k in need.items():
                    c.take(w, k * m)
                bins += m
                changed = True
    rooms: dict[int, list[tuple[int, int]]] = {}
    keys: list[int] = []

    def add(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in rooms:
                bisect.insort(keys, room)
            rooms.setdefault(room, []).append((first, n))

    for w in sorted(c.order, reverse=True):
        n = c.n[w]
        while n:
            i = bisect.bisect_left(keys, w)
            if i < len(keys):
                room = keys[i]
                first, m = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                    keys.pop(i)
            else:
                room, first = capacity, bins
                m = max(1, n // (capacity // w))
                bins += m
            each = min(room // w, n)
            full = min(m, n // each)
            place(w, full * each, first, each, capacity - room)
            n -= full * each
            add(room - each * w, first, full)
            add(room, first + full, m - full)
    return pd.DataFrame(rows, columns=["length", "rank", "n", "sequence", "each", "offset"]), bins


PIECES = "id_text string, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """documents -> one row per piece. A document's ids (null text: only the end id) with
    end_id after them are one piece, or if there are more than capacity, are cut after
    every capacity-th."""
    common.small_batches(docs.sparkSession)

    @functools.partial(common.tidy, keeps="tokens")
    def encode(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = wordcache.library_cache(tokenizer_path, False)
        end = np.array([end_id], "<u4")
        for b in batches:
            out = []
            for name, got in zip(b["id_text"], cache.many(b["text"]), strict=True):
                ids = np.concatenate([wordcache.as_u32(got, cache.code), end])
                out += [(name, k, at, min(capacity, len(ids) - at), zlib.crc32(ids[at : at + capacity])) for k, at in enumerate(range(0, len(ids), capacity))]
            yield pd.DataFrame(out, columns=["id_text", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("string").alias("id_text"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(encode, PIECES)


@common.scratch()
def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """documents (doc_id, text, ...) -> doc_id, piece, start, length, ids_crc32, sequence_id,
    offset: every piece's place in a sequence; sequences are filled from 0 without gaps.

    Pieces are stored, dealt by ranges of (length, hash of id), numbered within a partition
    and stored again. To the driver go the count of each length (at most capacity) and of
    each partition. Rows that repeat a doc_id are packed each for itself; an empty table
    gives no rows."""
    made = common.store(pieces(docs, tokenizer_path, end_id, capacity), "pieces")

    @common.tidy
    def number(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        at, part = 0, TaskContext.get().partitionId()
        for b in batches:
            yield b.assign(part=part, place=range(at, at + len(b)))
            at += len(b)

    tie = F.xxhash64("id_text", "piece")
    ranged = common.keep(common.store(made.repartitionByRange("length", tie).sortWithinPartitions("length", tie, "id_text", "piece", "ids_crc32").mapInPandas(number, f"{PIECES}, part int, place long"), "pieces-ranged"))
    counts = {r["length"]: r["n"] for r in ranged.groupBy("length").agg(F.count("*").alias("n")).collect()}
    parts = {r["part"]: r["n"] for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect()}
    before, total = {}, 0
    for p in sorted(parts):
        before[p], total = total, total + parts[p]
    shorter, total = {}, 0
    for w in sorted(counts):
        shorter[w], total = total, total + counts[w]
    rules, _ = plan(counts, capacity)
    rules = rules.sort_values(["length", "rank"])
    # One search key for (length, rank): the place of the interval's first piece among all.
    firsts = (rules["length"].map(shorter).to_numpy(np.int64) if len(rules) else np.zeros(0, np.int64)) + rules["rank"].to_numpy(np.int64)
    sequence, each, offset = (rules[k].to_numpy(np.int64) for k in ("sequence", "each", "offset"))

    @common.tidy
    def assign(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            place = b["part"].map(before).to_numpy(np.int64) + b["place"].to_numpy(np.int64)
            k = np.searchsorted(firsts, place, "right") - 1
            i = place - firsts[k]
            yield pd.DataFrame({
                "doc_id": pd.array([None if x is None else int(x) for x in b["id_text"]], "Int64"), "piece": b["piece"], "start": b["start"], "length": b["length"], "ids_crc32": b["ids_crc32"],
                "sequence_id": sequence[k] + i // each[k], "offset": offset[k] + i % each[k] * b["length"].to_numpy(np.int64),
            })

    return ranged.mapInPandas(assign, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
