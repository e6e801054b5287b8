"""Near-duplicate vectors by an exact range join in a metric space.

On unit vectors a cosine of c is the Euclidean distance sqrt(2 - 2c), a metric. Pivots cut
the space into cells: each vector's home is its nearest pivot's cell, and a cell is cut into
blocks by distance from its pivot. Partners of a vector at distance d from any pivot are
between d - r and d + r from it (triangle inequality), so a vector is sent to a block only if its
own distance from that pivot is within r of the block's band, and no more than 2r beyond its nearest
(r for each of the two). So each home vector finds all its partners in its own block, and blocks need
nothing of each other: a task holds a block and reads the vectors sent to it batch by batch.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Beyond what rounding in double precision moves a distance.
SLACK = 1e-9


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, v) with v in double precision; without vectors that are null or empty or
    hold null or non-finite components, or only zeros."""
    v = F.col(vector).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vectors.select("vec_id", v.alias("v")).where((F.size("v") > 0) & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0))


def _matrix(column: pd.Series) -> np.ndarray:
    x = np.stack(column.to_numpy())
    x = x / np.abs(x).max(1, keepdims=True)  # very large and very small ones neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """By sums that don't depend on how many rows come at a time: both passes see the same."""
    return np.sqrt(np.maximum(0.0, 2 - 2 * np.einsum("ij,kj->ik", x, pivots)))


BINS = 256


def bands(found: list, block: int) -> pd.DataFrame:
    """Counted bins (cell, bin, n, low, high) -> blocks (cell, first, low, high, parts) of
    about ``block`` vectors: neighbouring bins of a cell together, a fuller bin in parts."""
    out: list[list] = []
    for x in sorted(found, key=lambda x: (x["cell"], x["bin"])):
        if out and out[-1][0] == x["cell"] and out[-1][4] + x["n"] <= block:
            out[-1][3], out[-1][4] = x["high"], out[-1][4] + x["n"]
        else:
            out.append([x["cell"], x["bin"], x["low"], x["high"], x["n"]])
    return pd.DataFrame([(c, i, lo, hi, -(-n // block)) for c, i, lo, hi, n in out], columns=["cell", "first", "low", "high", "parts"])


def forest(hit: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Links (a, b) that connect what the matrix of hits connects: each id with the
    smallest id of its component, found by passing minima along rows and columns."""
    r, c = hit.any(1), hit.any(0)
    hit, rows, cols = hit[r][:, c], rows[r], cols[c]
    if not len(rows):
        return np.zeros((0, 2), np.int64)
    far = np.iinfo(np.int64).max
    low = rows.copy()
    while True:
        over = np.where(hit, low[:, None], far).min(0)
        over = np.minimum(over, cols)
        new = np.minimum(low, np.where(hit, over[None, :], far).min(1))
        if (new == low).all():
            break
        low = new
    out = np.concatenate([np.stack([rows, low], 1), np.stack([cols, over], 1)])
    return np.unique(out[out[:, 0] != out[:, 1]], axis=0)


NONE = "cls long, n_links long, edges array<struct<a:long, b:long>>"


def links(vectors: DataFrame, cosine: float = 0.95, pivots: int | None = None, block: int = 8192) -> DataFrame:
    """(cls, v, times) with unique cls -> (cls, n_links, edges): how many vectors (by times)
    are within the cosine, itself not counted, and links that connect it with them. Vectors of
    different lengths have no cosine and are not linked.

    pivots: by default a sixteenth of the root of the number of vectors, 4 to 64: of a
    sample of that size, chosen by hash, the vectors go to the driver and to every task; the driver
    also gets the counts of at most 256 bins of distance for each."""
    sizes = sorted(r[0] for r in vectors.select(F.size("v")).distinct().collect())
    found = [_links(vectors.where(F.size("v") == n) if len(sizes) > 1 else vectors, cosine, pivots, block) for n in sizes]
    return functools.reduce(DataFrame.unionAll, found) if found else vectors.sparkSession.createDataFrame([], NONE)


def _links(vectors: DataFrame, cosine: float, pivots: int | None, block: int) -> DataFrame:
    common.small_batches(vectors.sparkSession)
    n = vectors.count()
    k = pivots or min(64, max(4, math.isqrt(n) // 16))
    centres = _matrix(vectors.orderBy(F.xxhash64("cls")).limit(k).select("v").toPandas()["v"])
    r = math.sqrt(2 - 2 * cosine) + SLACK
    bin_of = lambda d: np.minimum((d * (BINS / 2)).astype(np.int64), BINS - 1)

    @common.tidy
    def home(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            d = _distances(_matrix(b["v"]), centres)
            near = d.min(1)
            x = pd.DataFrame({"cell": d.argmin(1).astype(np.int32), "bin": bin_of(near).astype(np.int32), "low": near, "high": near})
            x = x.groupby(["cell", "bin"]).agg(n=("low", "size"), low=("low", "min"), high=("high", "max")).reset_index()
            yield x[["cell", "bin", "n", "low", "high"]]

    counted = vectors.select("v").mapInPandas(home, "cell int, bin int, n long, low double, high double")
    blocks = bands(counted.groupBy("cell", "bin").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect(), block)
    cell, low, high, parts = (blocks[c].to_numpy() for c in ("cell", "low", "high", "parts"))
    starts = blocks["cell"].to_numpy(np.int64) * BINS + blocks["first"].to_numpy(np.int64)

    @common.tidy
    def deal(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(64, 4_000_000 // len(blocks))
        for b in batches:
            for at in range(0, len(b), step):
                x = b.iloc[at : at + step]
                u = _matrix(x["v"])
                d = _distances(u, centres)
                nearest = d.min(1)
                mine = np.searchsorted(starts, d.argmin(1) * BINS + bin_of(nearest), "right") - 1
                cls, times = x["cls"].to_numpy(np.int64), x["times"].to_numpy(np.int64)
                far = d[:, cell]
                i, blk = np.nonzero((far >= low - r) & (far <= high + r) & (far <= nearest[:, None] + 2 * r))
                many = parts[blk]
                i, blk, part = np.repeat(i, many), np.repeat(blk, many), np.concatenate([np.arange(m) for m in many]) if len(many) else many
                i, blk, part = np.concatenate([np.arange(len(x)), i]), np.concatenate([mine, blk]), np.concatenate([cls % parts[mine], part])
                raw = np.array([row.tobytes() for row in u], object)
                yield pd.DataFrame({"blk": blk.astype(np.int32), "part": part.astype(np.int32), "role": np.repeat(np.int32([0, 1]), [len(x), len(i) - len(x)]), "cls": cls[i], "times": times[i], "u": raw[i]})

    dealt = vectors.mapInPandas(deal, "blk int, part int, role int, cls long, times long, u binary").repartition(max(1, int(parts.sum())), "blk", "part").sortWithinPartitions("blk", "part", "role")

    @common.tidy
    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = None
        held: list[pd.DataFrame] = []
        own = ids = count = edges = None

        def result() -> pd.DataFrame:
            pairs = np.unique(np.concatenate(edges), axis=0) if edges else np.zeros((0, 2), np.int64)
            order = np.argsort(ids)
            to = order[np.searchsorted(ids[order], pairs[:, 1]).clip(0, len(ids) - 1)] if len(pairs) else np.zeros(0, int)
            by: dict[int, list[dict]] = {}
            for j, (a, b) in zip(to, pairs.tolist(), strict=True):
                by.setdefault(int(j), []).append({"a": a, "b": b})
            return pd.DataFrame({"cls": ids, "n_links": count, "edges": [by.get(j, []) for j in range(len(ids))]})

        for b in batches:
            for (blk, part, role), g in b.groupby(["blk", "part", "role"], sort=True):
                if key != (blk, part):
                    if own is not None:
                        yield result()
                    key, held, own = (blk, part), [], None
                if role == 0:
                    held.append(g)
                    continue
                if own is None:
                    if not held:
                        continue
                    h = pd.concat(held)
                    own = np.frombuffer(b"".join(h["u"]), float).reshape(len(h), -1)
                    ids, count, edges = h["cls"].to_numpy(np.int64), np.zeros(len(h), np.int64), []
                other = np.frombuffer(b"".join(g["u"]), float).reshape(len(g), -1)
                names, times = g["cls"].to_numpy(np.int64), g["times"].to_numpy(np.int64)
                step = max(16, 2_000_000 // len(own))
                for i in range(0, len(other), step):
                    hit = own @ other[i : i + step].T >= cosine
                    r_, c_ = np.nonzero(hit)
                    same = ids[r_] == names[i + c_]
                    hit[r_[same], c_[same]] = False
                    if not same.all():
                        rows_ = np.unique(r_[~same])
                        count[rows_] += hit[rows_] @ times[i : i + step]
                        edges.append(forest(hit[rows_], ids[rows_], names[i : i + step]))
        if own is not None:
            yield result()

    return dealt.mapInPandas(work, NONE)


@common.scratch()
def near_vectors(vectors: DataFrame, cosine: float = 0.95, pivots: int | None = None) -> DataFrame:
    """embeddings (vec_id, embedding, ...) -> vec_id, n_links, component_id, kept.

    Equal vectors form a class and are compared once; each counts as a link of the others.
    Vectors that are null, zero, empty, or hold null or non-finite components link with
    nothing, and vectors of different lengths not with each other. component_id is the smallest vec_id
    reachable, nulls last; rows that repeat a vec_id are vectors of their own. Columns other than
    vec_id and embedding are not read; an empty table gives no rows."""
    good = common.store(usable(vectors), "vectors")
    classes = good.groupBy("v").agg(F.count("*").alias("times"), F.min("vec_id").alias("first"))
    classes = common.store(classes.select(F.monotonically_increasing_id().alias("cls"), "v", "times", "first"), "vector-classes")
    found = common.store(links(classes.select("cls", "v", "times"), cosine, pivots), "vector-links")
    edges = found.select(F.explode("edges").alias("e")).select("e.a", "e.b")
    roots = common.store(common.components(edges, "vectors"), "vector-roots").withColumnRenamed("node", "cls")
    named = classes.select("cls", "first", "times").join(found.select("cls", "n_links"), "cls").join(roots, "cls", "left").select("cls", "first", (F.col("n_links") + F.col("times") - 1).alias("n_links"), F.coalesce("root", "cls").alias("root"))
    low = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(low, "root").select("cls", "n_links", "component_id")
    by_vector = classes.select("cls", "v").join(named, "cls").select("v", "n_links", "component_id")
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept")
    some = good.join(by_vector, "v").select("vec_id", "n_links", "component_id", kept)
    v = F.col("embedding").cast("array<double>")
    fine = F.coalesce((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    none = vectors.where(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return common.keep(common.store(some.unionAll(none), "vector-result"))


ORACLE = """
with recursive u as (
  select vec_id, embedding::double[] as v from embeddings
  where embedding is not null and len(embedding) > 0 and len([x for x in embedding if x is null or not isfinite(x)]) = 0 and len([x for x in embedding if x <> 0]) > 0),
pairs as (select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id and list_cosine_similarity(a.v, b.v) >= 0.95),
reach as (select vec_id as a, vec_id as b from u union select r.a, p.b from reach r join pairs p on r.b = p.a),
low as (select a, min(b) as c from reach group by a),
n as (select a, count(*) as n from pairs group by a)
select e.vec_id, coalesce(n.n, 0) as n_links, coalesce(low.c, e.vec_id) as component_id, coalesce(low.c, e.vec_id) = e.vec_id as kept
from embeddings e left join n on n.a = e.vec_id left join low on low.a = e.vec_id
"""
