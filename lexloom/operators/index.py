"""An index of examples by bounds of their score.

Examples of the same shape (parameters, return type, complexity, quality, source) are cut, in
the order of their names, into cells. For a query, a cell has a bound that none of its examples
exceeds: the parts of the score that the shape decides, and the most that any name in it can add,
from the letters that it has at most and its shortest length. Cells are opened by falling
bounds, and no more once no cell left can reach what is asked for.

Where verbs mean the same, a name counts by its other words only. There examples that no query tells apart
are one class (``marked``, ``leading``), and the score without its types is worked out for all that are left (``Classes``).
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RETRIEVAL_WEIGHT as W
from ..functions import names, scores
from ..sources import shared

CELL = 32
SLACK = 1e-9
_GROUPS = tuple(names.VERBS)
QUERY = ("name", "groups", "params", "typed", "returns", "complexity", "top", "verb", "words", "deep", "marks")
EXAMPLE = (*QUERY, "boost", "fixed")


def example_columns(as_of: Column) -> list[Column]:
    p = F.col("c.parameters")
    boost = F.when(F.col("source") == "accepted", 1.2).otherwise(1.0)
    fixed = F.coalesce(F.when(F.col("source") == "accepted", scores.recency(F.col("timestamp"), as_of)), F.lit(0.0)) * W["recency"] + F.coalesce(F.col("quality_score") / 5.0, F.lit(0.0)) * W["quality"]
    m = F.coalesce("module_path", F.lit(""))
    return [F.coalesce("function_name", F.lit("")).alias("name"), F.col("c.name.groups").alias("groups"), *_shape(p, "c"), F.col("complexity_score").cast("double").alias("complexity"), *_place(m, "c", "full:", "above:"), boost.alias("boost"), fixed.alias("fixed")]


def query_columns() -> list[Column]:
    return [F.coalesce("name", F.lit("")).alias("name"), F.col("q.name.groups").alias("groups"), *_shape(F.col("q.parameters"), "q"), F.col("q_complexity").cast("double").alias("complexity"), *_place(F.coalesce(names.module_of("file_path"), F.lit("")), "q", "above:", "full:")]


def _place(module: Column, side: str, full: str, above: str) -> list[Column]:
    """What the search reads of a module and a name's words. Marks are what both sides have in common:
    words after the verb, and modules, where one is the beginning of the other if and only if
    the whole of one side is among the beginnings of the other."""
    name, path = F.col(f"{side}.name"), F.split(module, r"\.")
    words = F.array_distinct(F.coalesce(name["rest"], F.array().cast("array<string>")))
    beginnings = F.transform(F.sequence(F.lit(1), F.size(path)), lambda n: F.concat(F.lit(above), F.array_join(F.slice(path, F.lit(1), n), ".")))
    marks = F.concat(F.transform(words, lambda w: F.concat(F.lit("word:"), w)), F.array(F.concat(F.lit(full), module)), beginnings)
    return [F.split_part(module, F.lit("."), F.lit(1)).alias("top"), F.when(F.size(name["groups"]) > 0, name["first"]).otherwise("").alias("verb"), F.size(words).alias("words"), (F.size(path) >= 2).alias("deep"), marks.alias("marks")]


def marked(side: DataFrame, id_: str, known: DataFrame) -> DataFrame:
    """With only those marks that ``known`` has, sorted."""
    x = side.select(id_, F.explode("marks").alias("mark")).join(known, "mark").groupBy(id_).agg(F.sort_array(F.collect_set("mark")).alias("marks"))
    return side.drop("marks").join(x, id_, "left").withColumn("marks", F.coalesce("marks", F.array().cast("array<string>")))


def leading(examples: DataFrame, k: int) -> DataFrame:
    """(class, example_id, boost, fixed) -> those that may be among the k best of some query: in the order of
    ``fixed``, ids after it, the first k of a class. With a boost, scores may reach their cap, where
    ids decide: those stay that have fewer than k smaller ids before them."""

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, smallest = None, []
        for b in batches:
            keep = np.zeros(len(b), bool)
            for i, (class_, id_, boost) in enumerate(zip(b["class"], b["example_id"], b["boost"], strict=True)):
                if class_ != at:
                    at, smallest = class_, []
                if len(smallest) < k or boost > 1 and id_ < smallest[-1]:
                    keep[i] = True
                    insort(smallest, id_)
                    del smallest[k:]
            yield b[keep]

    x = examples.select("class", "example_id", "boost", "fixed")
    order = ["class", F.desc("fixed"), "example_id"]
    # Each task's own first, so that a class of any size is a few rows of each task.
    own = x.sortWithinPartitions(*order).mapInPandas(work, x.schema)
    return shared.dealt(own, "class").sortWithinPartitions(*order).mapInPandas(work, x.schema)


def _shape(p: Column, side: str) -> list[Column]:
    plain = lambda xs: F.transform(xs, lambda x: x["name"])
    return [plain(p).alias("params"), plain(F.filter(p, lambda x: x["type"].isNotNull())).alias("typed"), F.col(f"{side}.returns").isNotNull().alias("returns")]


def _letters(name: str) -> np.ndarray:
    """How often each of 38 kinds of letters occurs; others count as one kind."""
    out = np.zeros(38, np.int16)
    for c in name:
        k = ord(c)
        out[k - 97 if 97 <= k < 123 else 26 + k - 48 if 48 <= k < 58 else 36 if c == "_" else 37] += 1
    return out


def _mask(groups) -> int:
    return sum(1 << _GROUPS.index(g) for g in groups) if groups is not None else 0


def _list(x) -> tuple | None:
    return None if x is None or (isinstance(x, float) and x != x) else tuple(x)


def _shapes(rows: pd.DataFrame) -> tuple[list[tuple], np.ndarray]:
    """What occurs of parameters, return type, complexity and boost, and each row's number among them."""
    shapes: dict[tuple, int] = {}
    keys = [(_list(p), _list(t), bool(r), c, b) for p, t, r, c, b in zip(rows["params"], rows["typed"], rows["returns"], rows["complexity"], rows["boost"], strict=True)]
    numbers = np.array([shapes.setdefault(k, len(shapes)) for k in keys], int)
    return list(shapes), numbers


class Cells:
    """Of at most so many examples as a task may hold; their columns are ``example_columns``."""

    def __init__(self, rows: pd.DataFrame, ids: str = "example_id"):
        self.shapes, shape = _shapes(rows)
        order = np.lexsort((rows["name"].to_numpy(str), shape)) if len(rows) else np.zeros(0, int)
        shape = shape[order]
        self.ids, self.size = rows[ids].to_numpy(object)[order], rows["name"].str.len().to_numpy()[order]
        self.letters = np.stack([_letters(n) for n in rows["name"]])[order] if len(rows) else np.zeros((0, 38), np.int16)
        self.masks = np.array([_mask(g) for g in rows["groups"]], np.int64)[order]
        self.tops, at = {}, rows["top"].to_numpy(object)[order]
        self.top = np.array([self.tops.setdefault(t, len(self.tops)) for t in at], int)
        self.fixed = rows["fixed"].to_numpy(float)[order]
        first = np.flatnonzero(np.r_[True, shape[1:] != shape[:-1]]) if len(shape) else np.zeros(0, int)
        starts = [s for a, b in zip(first, np.r_[first[1:], len(shape)][: len(first)], strict=True) for s in range(a, b, CELL)]
        self.starts, self.ends = np.array(starts, int), np.array([*starts[1:], len(shape)], int)[: len(starts)]
        self.shape = shape[self.starts] if len(shape) else shape
        cut = lambda f, x: f.reduceat(x, self.starts) if len(starts) else x[:0]
        self.most, self.shortest, self.any_mask, self.most_fixed = cut(np.maximum, self.letters), cut(np.minimum, self.size), cut(np.bitwise_or, self.masks), cut(np.maximum, self.fixed)
        self.opened = self.all = 0
        self._known: dict[tuple, np.ndarray] = {}

    def by_shape(self, params, typed, returns: bool, complexity: float) -> tuple[np.ndarray, np.ndarray]:
        """(what signature, types and complexity add at most, boost) for each shape."""
        key = (params, typed, returns, complexity)
        known = self._known.get(key)
        if known is None:
            if len(self._known) > 10_000:
                self._known.clear()
            known = self._known[key] = np.array([(self._static(key, s), s[4]) for s in self.shapes]).T if self.shapes else np.zeros((2, 0))
        return known

    @staticmethod
    def _static(q: tuple, e: tuple) -> float:
        a, b = q[0], e[0]
        if a is None or b is None:
            signature = kinds = 1.0
        else:
            signature = 0.4 / (1 + abs(len(a) - len(b)) * 0.3)
            if a and b:
                signature += 0.3 * len(set(a) & set(b)) / max(len(set(a)), len(set(b))) + 0.3 * sum(x == y for x, y in zip(a, b, strict=False)) / len(a)
            kinds = 0.5 * (q[2] and e[2]) + 0.5 * bool(set(q[1] or ()) & set(e[1] or ()))
        near = 1.0 / (1.0 + abs(q[3] - e[3]) * 0.5) if q[3] == q[3] and e[3] == e[3] else 0.0
        return W["signature"] * signature + W["types"] * kinds + W["complexity"] * near

    @staticmethod
    def _name(size: int, overlap: np.ndarray, shortest: np.ndarray, synonym: np.ndarray, spaced: bool) -> np.ndarray:
        """What a name can be alike at most: a common subsequence has no more letters than both have."""
        if spaced:
            return np.ones(len(overlap))
        return np.where(synonym, 1.0, 2 * overlap / np.maximum(1, size + np.maximum(shortest, overlap)))

    def search(self, q, k: int, least: float) -> np.ndarray:
        """Numbers of the examples whose bound is at least ``least``; with k > 0 only those of
        the k highest bounds, and all that tie with the last."""
        static, boost = self.by_shape(_list(q.params), _list(q.typed), bool(q.returns), q.complexity)
        letters, mask, spaced = _letters(q.name), _mask(q.groups), any(c.isspace() for c in q.name) or not q.name
        overlap = np.minimum(letters, self.most).sum(1)
        name = self._name(len(q.name), overlap, self.shortest, (self.any_mask & mask) != 0, spaced)
        bound = boost[self.shape] * (W["name"] * name + static[self.shape] + W["module"] + self.most_fixed)
        order = np.argsort(-bound, kind="stable")
        order = order[: np.searchsorted(-bound[order], -(least - SLACK), "right")]
        top, found, values = self.tops.get(q.top, -1), [], []
        best = np.zeros(0)
        step = 4 if k else max(1, len(order))
        for i in range(0, len(order), step):
            if k and len(best) >= k and bound[order[i]] < best[-1] - SLACK:
                break
            chunk = order[i : i + step]
            rows = np.concatenate([np.arange(self.starts[c], self.ends[c]) for c in chunk])
            cell = np.repeat(chunk, self.ends[chunk] - self.starts[chunk])
            name = self._name(len(q.name), np.minimum(letters, self.letters[rows]).sum(1), self.size[rows], (self.masks[rows] & mask) != 0, spaced)
            value = boost[self.shape[cell]] * (W["name"] * name + static[self.shape[cell]] + W["module"] * (self.top[rows] == top) + self.fixed[rows])
            found.append(rows)
            values.append(value)
            if k:
                best = -np.sort(-np.r_[best, value])[:k]
        if not found:
            return np.zeros(0, int)
        rows, values = np.concatenate(found), np.concatenate(values)
        if k and len(best) >= k:
            least = max(least, best[-1])
        return rows[values >= least - SLACK]


class Classes(Cells):
    """Of examples whose verbs mean the same as the query's."""

    def __init__(self, rows: pd.DataFrame, ids: str = "example_id"):
        self.shapes, self.shape = _shapes(rows)
        self.ids, self.fixed = rows[ids].to_numpy(object), rows["fixed"].to_numpy(float)
        self.top, self.deep, self.words = rows["top"].to_numpy(object), rows["deep"].to_numpy(bool), rows["words"].to_numpy(float)
        found: dict[str, list[int]] = {}
        for i, marks in enumerate(rows["marks"]):
            for m in marks:
                found.setdefault(m, []).append(i)
        self.having = {m: np.array(x) for m, x in found.items()}
        self._known: dict[tuple, np.ndarray] = {}

    def search(self, q, k: int, least: float) -> np.ndarray:
        static, boost = self.by_shape(_list(q.params), _list(q.typed), bool(q.returns), q.complexity)
        both, module = np.zeros(len(self.ids)), np.where((self.top == q.top) & self.deep & bool(q.deep), 0.5, 0.0)
        for m in q.marks:
            rows = self.having.get(m)
            if rows is None:
                continue
            if m.startswith("word:"):
                both[rows] += 1
            else:
                module[rows] = 1.0
        either = self.words + q.words - both
        words = np.where(either > 0, both / np.maximum(either, 1), 1.0)
        value = boost[self.shape] * (W["name"] * (0.8 + 0.2 * words) + static[self.shape] + W["module"] * module + self.fixed)
        if 0 < k < len(value):
            least = max(least, -np.partition(-value, k - 1)[k - 1])
        return np.flatnonzero(value >= least - SLACK)
