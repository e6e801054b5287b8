"""Clustering around centroids with ball trees that filter the candidates.

Each task cuts its vectors into trees of balls. A ball stores its centre, its radius, how many
vectors it has and their integer sum. In a round, a centroid can't be the nearest of any vector
of a ball if it is further from the centre than the nearest centroid by over two radii
(triangle inequality), and is not looked at again below that ball. Where one is left, the
whole ball goes to it by its count and sum; else its halves are visited, down to leaves, where
distances are exact.

Trees are built once and stored; a round is one pass over them and a sum for each centroid and
component. Vectors are integers, so sums and distances are exact whatever their order.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Below this size of the components, sums over a vector are exact in double precision (and fast); others are Python integers.
PLAIN = 2**20
#: Sums go to Spark in digits of this base.
BASE = 2**40
LEAF, TREE = 16, 4096
LONG = 2**63 - 1


def usable(vectors: DataFrame, dim: int = 64, vector: str = "embedding") -> DataFrame:
    """(vec_id, v) of the vectors with just ``dim`` components, none null or non-finite."""
    v = F.col(vector).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vectors.select("vec_id", v.alias("v")).where((F.size("v") == dim) & ~F.exists("v", bad))


def integers(rows: Iterable[np.ndarray], scale: int = 256) -> np.ndarray:
    """floor(scale * x), in doubles where these are exact, else as Python integers."""
    x = np.floor(np.stack([np.asarray(r, float) for r in rows]) * float(scale))
    if np.isfinite(x).all() and np.abs(x).max(initial=0) < PLAIN:
        return x
    return np.array([[_scaled(c, scale) for c in r] for r in rows], object)


def _scaled(c: float, scale: int) -> int:
    """floor(c * scale) of one double, exactly."""
    top, below = float(c).as_integer_ratio()
    return top * scale // below


class Tree:
    """A balanced tree over rows of integers: level j has 2**j balls, ball i of a level the
    rows from bounds[j][i] to bounds[j][i + 1] in the tree's order."""

    def __init__(self, rows: np.ndarray, leaf: int = LEAF):
        near = rows.astype(float)
        order = np.arange(len(rows))
        self.bounds = [np.array([0, len(rows)])]
        while np.diff(self.bounds[-1]).max(initial=0) > leaf:
            cut = []
            for a, b in zip(self.bounds[-1], self.bounds[-1][1:], strict=False):
                part = near[order[a:b]]
                if len(part) > 1:
                    one = part[((part - part.mean(0)) ** 2).sum(1).argmax()]
                    other = part[((part - one) ** 2).sum(1).argmax()]
                    order[a:b] = order[a:b][np.argsort(part @ (other - one), kind="stable")]
                cut += [a, (a + b) // 2]
            self.bounds.append(np.array([*cut, len(rows)]))
        self.order, self.rows, self.near = order, rows[order], near[order]
        self.centres, self.radii, self.sums = [], [], []
        zero = np.zeros((1, rows.shape[1]), rows.dtype)
        total = np.concatenate([zero, np.cumsum(self.rows, axis=0)])
        for b in self.bounds:
            n = np.diff(b)
            self.sums.append(total[b[1:]] - total[b[:-1]])
            centre = self.sums[-1].astype(float) / np.maximum(n, 1)[:, None]
            gap = np.sqrt(((self.near - np.repeat(centre, n, axis=0)) ** 2).sum(1))
            self.centres.append(centre)
            self.radii.append(np.array([gap[i:j].max(initial=0) for i, j in zip(b, b[1:], strict=False)]))

    def assign(self, centroids: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """The nearest centroid of each row in the tree's order (ties: the smaller number), and
        the balls (level, ball, centroid) that went to theirs whole; rows of none are from leaves."""
        out = np.full(len(self.rows), -1, np.int64)
        near = centroids.astype(float)
        slack = 1e-9 * (1 + np.abs(near).max() + np.abs(self.near).max(initial=0)) * math.sqrt(near.shape[1])
        active, candidates = np.array([0]), np.ones((1, len(near)), bool)
        whole: list[tuple[int, int, int]] = []
        for level, b in enumerate(self.bounds):
            d = np.stack([np.sqrt(((self.centres[level][active] - m) ** 2).sum(1)) for m in near], 1)
            d[~candidates] = np.inf
            candidates = d <= d.min(1, keepdims=True) + 2 * self.radii[level][active, None] + slack
            single = candidates.sum(1) == 1
            for i, k in zip(active[single].tolist(), candidates[single].argmax(1).tolist(), strict=True):
                out[b[i] : b[i + 1]] = k
                whole.append((level, i, k))
            active, candidates = active[~single], candidates[~single]
            if level + 1 < len(self.bounds):
                active, candidates = np.stack([2 * active, 2 * active + 1], 1).ravel(), np.repeat(candidates, 2, axis=0)
                some = np.diff(self.bounds[level + 1])[active] > 0
                active, candidates = active[some], candidates[some]
        for i, c in zip(active, candidates, strict=True):
            at, numbers = slice(b[i], b[i + 1]), np.flatnonzero(c)
            out[at] = numbers[distances(self.rows[at], centroids[numbers]).argmin(1)]
        return out, whole

    def totals(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(counts, sums) for each centroid: of whole balls what they store, of leaves row by row."""
        mine, whole = self.assign(centroids)
        sums = np.zeros(centroids.shape, self.rows.dtype)
        by_row = np.ones(len(mine), bool)
        for level, i, k in whole:
            sums[k] += self.sums[level][i]
            by_row[self.bounds[level][i] : self.bounds[level][i + 1]] = False
        np.add.at(sums, mine[by_row], self.rows[by_row])
        return np.bincount(mine, minlength=len(centroids)), sums

    def __getstate__(self) -> dict:
        """Without what follows from the rows; small integers in two or four bytes."""
        held = dict(self.__dict__)
        del held["near"]
        if self.rows.dtype != object:
            held["rows"] = self.rows.astype(np.int16 if np.abs(self.rows).max(initial=0) < 2**15 else np.int32)
        return held

    def __setstate__(self, held: dict) -> None:
        self.__dict__ |= held
        if self.rows.dtype != object:
            self.rows = self.rows.astype(float)
        self.near = self.rows.astype(float)


def distances(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared, exact: doubles that hold integers below 2**53, or Python integers."""
    if rows.dtype == object or centroids.dtype == object:
        return np.stack([((rows.astype(object) - c) ** 2).sum(1) for c in centroids.astype(object)], 1)
    return (rows * rows).sum(1)[:, None] - 2 * rows @ centroids.T + (centroids * centroids).sum(1)[None, :]


def _compact(rows: list[list[int]]) -> np.ndarray:
    """Whole numbers as doubles if they are small, else as they are."""
    if all(abs(c) < PLAIN for r in rows for c in r):
        return np.array(rows, float)
    return np.array(rows, object)


def digits(value: int) -> list[int]:
    """Of base BASE, the lowest first; the last one has the sign."""
    out = []
    while abs(value) >= BASE:
        value, low = divmod(value, BASE)
        out.append(low)
    return [*out, value]


def trees(vectors: DataFrame, dim: int = 64) -> DataFrame:
    """embeddings (vec_id, embedding, ...) -> a stored table (vec_ids, tree), a row for at most
    TREE vectors of a task."""
    common.small_batches(vectors.sparkSession)

    @common.tidy
    def build(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list = []
        held: list[np.ndarray] = []

        def made() -> pd.DataFrame:
            tree = Tree(integers(held))
            return pd.DataFrame({"vec_ids": [[ids[i] for i in tree.order]], "tree": [pickle.dumps(tree)]})

        for b in batches:
            for i, v in zip(b["id_text"], b["v"], strict=True):
                ids.append(None if i is None else int(i))
                held.append(v)
                if len(held) == TREE:
                    yield made()
                    ids, held = [], []
        if held:
            yield made()

    whole = usable(vectors, dim).select(F.col("vec_id").cast("string").alias("id_text"), "v")
    return common.store(whole.mapInPandas(build, "vec_ids array<long>, tree binary"), "ball-trees")


def first_centroids(vectors: DataFrame, k: int, dim: int = 64) -> list[list[int]]:
    """The k vectors with the smallest hashes of "2:" and their ids, in that order; of equal ids the smaller vector first."""
    named = F.concat(F.lit("2:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = usable(vectors, dim).select("v", F.sha2(named, 256).alias("h")).orderBy("h", "v").limit(k).collect()
    return [[int(c) for c in r] for r in integers([r["v"] for r in rows])] if rows else []


def moved(forest: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """One round: every centroid with vectors becomes floor(sum / count) of them. For each task
    no more than the digits of its sums are shuffled, and as many come to the driver."""
    at = _compact(centroids)

    @common.tidy
    def partial(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, sums = np.zeros(len(at), np.int64), np.zeros(at.shape, object)
        for b in batches:
            for t in b["tree"]:
                n, s = pickle.loads(t).totals(at)
                counts += n
                sums += s.astype(object)
        out = [(k, -1, 0, int(n)) for k, n in enumerate(counts) if n]
        out += [(k, j, i, d) for k in np.flatnonzero(counts) for j, x in enumerate(sums[k]) for i, d in enumerate(digits(int(x)))]
        yield pd.DataFrame(out, columns=["cluster", "component", "digit", "part"])

    parts = forest.select("tree").mapInPandas(partial, "cluster int, component int, digit int, part long").groupBy("cluster", "component", "digit").agg(F.sum("part").alias("part"))
    sums: dict[tuple[int, int], int] = {}
    for r in parts.collect():
        key = r["cluster"], r["component"]
        sums[key] = sums.get(key, 0) + r["part"] * BASE ** r["digit"]
    return [[sums[k, j] // sums[k, -1] for j in range(len(c))] if (k, -1) in sums else c for k, c in enumerate(centroids)]


def assigned(forest: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """vec_id, cluster, distance (squared; null if it is beyond a long)."""
    at = _compact(centroids)

    @common.tidy
    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for ids, t in zip(b["vec_ids"], b["tree"], strict=True):
                tree = pickle.loads(t)
                mine, _ = tree.assign(at)
                exact = tree.rows.dtype != object and at.dtype != object
                d = ((tree.rows - at[mine]) ** 2).sum(1) if exact else ((tree.rows.astype(object) - at.astype(object)[mine]) ** 2).sum(1)
                ids = pd.array([None if i is None or i != i else int(i) for i in ids], "Int64")
                yield pd.DataFrame({"vec_id": ids, "cluster": mine.astype(np.int32), "distance": pd.array([int(x) if x <= LONG else None for x in d], "Int64")})

    return forest.mapInPandas(work, "vec_id long, cluster int, distance long")


@common.scratch()
def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64) -> DataFrame:
    """embeddings (vec_id, embedding, ...) -> vec_id, cluster, distance, cluster_inertia, inertia,
    centroid_sha256.

    Only vectors of ``dim`` components, none null or non-finite, are kept, times 256 and
    rounded down; the others have no row, and an empty table gives none. The k vectors of the smallest hashes
    are the first centroids (fewer vectors: fewer centroids; equal ones stay, and the smaller number wins
    ties). Rows that repeat a vec_id, and null ids, are vectors of their own; columns other than
    vec_id and embedding are not read. Components of any size are exact; a distance or
    inertia beyond a long is null. What comes to the driver and goes to every task is the centroids and their sums."""
    spark = vectors.sparkSession
    centroids = first_centroids(vectors, k, dim)
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    forest = trees(vectors, dim)
    for _ in range(rounds):
        centroids = moved(forest, centroids)
    found = common.keep(common.store(assigned(forest, centroids), "ball-clusters"))
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast(T.DecimalType(38, 0))).alias("s"), F.every(F.col("distance").isNotNull()).alias("whole")).collect()
    fits = lambda rows: x if all(r["whole"] for r in rows) and (x := int(sum(r["s"] for r in rows))) <= LONG else None
    names = [(r["cluster"], fits([r]), fits(sums), hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()) for r in sums]
    clusters = spark.createDataFrame(names, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k: int = 40, rounds: int = 5, dim: int = 64) -> str:
    pick = """a{i} as (select id, vec_id, v, k, d from (select p.*, row_number() over (partition by id order by d, k) as place from (
  select x.id, x.vec_id, x.v, c.k, list_sum([(x.v[i] - c.v[i]) * (x.v[i] - c.v[i]) for i in range(1, {n})]) as d from x, c{i} c) p) where place = 1)"""
    move = """c{j} as (select c.k, coalesce(m.v, c.v) as v from c{i} c left join (
  select k, list(cast(floor(s / n) as bigint) order by j) as v from (
    select k, j, sum(v[j]) as s, count(*) as n from a{i}, (select unnest(range(1, {n})) as j) group by k, j) group by k) m on m.k = c.k)"""
    steps = [f"""x as (select row_number() over (order by vec_id) as id, vec_id, [cast(floor(256 * e) as bigint) for e in embedding::double[]] as v from embeddings
  where embedding is not null and len(embedding) = {dim} and len([e for e in embedding if e is null or not isfinite(e)]) = 0)""",
        f"c0 as (select row_number() over (order by sha256('2:' || vec_id)) - 1 as k, v from x qualify k < {k})"]
    for i in range(rounds):
        steps += [pick.format(i=i, n=dim + 1), move.format(i=i, j=i + 1, n=dim + 1)]
    steps.append(pick.format(i=rounds, n=dim + 1))
    return f"""with {", ".join(steps)}
select a.vec_id, cast(a.k as int) as cluster, cast(a.d as bigint) as distance, cast(sum(a.d) over (partition by a.k) as bigint) as cluster_inertia,
  cast(sum(a.d) over () as bigint) as inertia, sha256(array_to_string(c.v, ',')) as centroid_sha256
from a{rounds} a join c{rounds} c on c.k = a.k"""


ORACLE = _oracle()
