"""The k nearest vectors of every query, exactly, without comparing all pairs.

Vectors are cut into cells around centres; a cell knows how near and how far its vectors are
from its centre. Cells are put together, or cut, to blocks of bounded size, one row of a stored table each.
What a query finds in its own block bounds what is left: by the triangle inequality a cell whose band can't
come within its k-th distance so far has nothing to offer.

Blocks of queries meet blocks of the corpus where tasks read them: a task reads some of both and keeps each query's
k best, so vectors are dealt out once, however many cells a query has to visit, and only what tasks find is shuffled.
On unit vectors the distance is sqrt(2 - 2 cosine).
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import shared
from .windows import top_per_key

SLACK = 1e-9
#: Similarities are rounded to so many digits before they are ranked, so that equal vectors tie.
DIGITS = 12


def _usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.select(F.col(key).alias("key"), v.alias("v")).where(F.col("key").isNotNull() & (F.size("v") > 0) & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _from(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * np.einsum("ij,kj->ik", x, centres)))


#: Bytes of the corpus that a task reads at most, and rows of queries that are compared at once.
READ, TILE = 64_000_000, 256


def knn_join(queries: DataFrame, corpus: DataFrame, k: int, least: float | None = None, cells: int | None = None, block: int = 16384) -> DataFrame:
    """(q_id, q_vec), (id, vec) -> q_id, id, similarity, rank: of every query the k vectors with
    the highest cosine, ties by id, none with its own id; least: only from this cosine on.

    Vectors that are null, empty or zero, or hold null or non-finite components, have no neighbours, nor
    have those of different lengths each other. cells: by default a quarter of the root of the
    corpus, at most 256: their centres, a sample by hash, go to the driver and to every task. block: as many
    vectors a block has at most; fewer if that gives the cores too few blocks."""
    out = []
    q, c = _usable(queries, "q_id", "q_vec"), _usable(corpus, "id", "vec")
    short = {s.schema[v].dataType.simpleString() for s, v in ((queries, "q_vec"), (corpus, "vec"))} == {"array<float>"}
    same = q.sameSemantics(c)
    c = shared.store(c, "neighbours")
    for n, count in sorted((r["n"], r["count"]) for r in c.groupBy(F.size("v").alias("n")).count().collect()):
        of = c.where(F.size("v") == n)
        out.append(_joined(of if same else q.where(F.size("v") == n), of, same, "<f4" if short else "<f8", count, k, least, cells, block))
    shared.discard(c)
    if not out:
        kinds = {f.name: f.dataType.simpleString() for f in [*queries.schema, *corpus.schema]}
        return queries.sparkSession.createDataFrame([], f"q_id {kinds['q_id']}, id {kinds['id']}, similarity double, rank int")
    return functools.reduce(DataFrame.unionAll, out)


def _joined(q: DataFrame, c: DataFrame, same: bool, dtype: str, count: int, k: int, least: float | None, cells: int | None, block: int) -> DataFrame:
    m = cells or min(256, max(1, math.isqrt(count) // 4))
    centres = _unit(np.stack(c.orderBy(F.xxhash64("v"), F.xxhash64("key")).limit(m).select("v").toPandas()["v"].to_numpy()))
    kind, qkind = c.schema["key"].dataType.simpleString(), q.schema["key"].dataType.simpleString()
    spark, width = c.sparkSession, centres.shape[1]
    block = min(block, max(512, count // (4 * spark.sparkContext.defaultParallelism)))

    def home(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                v = np.stack(b["v"].to_numpy())
                d = _from(_unit(v), centres)
                yield pd.DataFrame({"key": b["key"], "cell": d.argmin(1).astype(np.int32), "far": d.min(1), "raw": [x.tobytes() for x in v.astype(dtype)]})

    placed = c.mapInPandas(home, f"key {kind}, cell int, far double, raw binary")
    asked = q.mapInPandas(home, f"key {qkind}, cell int, far double, raw binary")
    known = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high")).collect()}
    most = {i: r["n"] for i, r in known.items()}
    if not same:
        for r in asked.groupBy("cell").count().collect():
            most[r["cell"]] = max(most.get(r["cell"], 0), r["count"])
    low, high = (np.array([known[i][s] if i in known else 9.0 for i in range(len(centres))]) for s in ("low", "high"))
    base, pieces, blocks = _dealt([most.get(i, 0) for i in range(len(centres))], block)

    at = lambda x: F.element_at(F.array(*map(F.lit, x)), F.col("cell") + 1)
    number = (at(base) + F.pmod(F.xxhash64("key"), at(pieces))).cast("int").alias("block")
    rows = placed.select(number, F.lit(1).alias("side"), F.lit(None).cast(qkind).alias("q_key"), "key", "cell", "raw")
    if not same:
        rows = rows.unionAll(asked.select(number, F.lit(0).alias("side"), F.col("key").alias("q_key"), F.lit(None).cast(kind).alias("key"), "cell", "raw"))
    schema = f"block int, q_key array<{qkind}>, q_cell binary, q_raw binary, floor binary, key array<{kind}>, cell binary, raw binary"
    packed = shared.store(rows.repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "side", "cell").mapInPandas(_packed(k, least, same, dtype, width), schema), "blocks")

    asking = packed.where("floor is not null").select("block", "q_key", "q_cell", "q_raw", "floor")
    parts = max(min(4, blocks), math.ceil(count * width * np.dtype(dtype).itemsize / READ))
    pairs = asking.crossJoin(packed.where("cell is not null").select("key", "cell", "raw").coalesce(parts).hint("shuffle_replicate_nl"))
    found = pairs.mapInPandas(_met(k, least, dtype, centres, low, high), f"q_id {qkind}, id {kind}, similarity double")
    return top_per_key(found, ["q_id"], [F.desc("similarity"), F.col("id")], k, "rank")


def _dealt(sizes: list[int], block: int) -> tuple[list[int], list[int], int]:
    """Sizes of cells -> the first block of each, in how many it is cut, and how many there are: small cells
    that follow each other share a block."""
    base, pieces, used, held = [], [], 0, 0
    for n in sizes:
        if held and held + n <= block:
            held += n
        else:
            used += pieces[-1] if pieces else 0
            held = n
        base.append(used)
        pieces.append(max(1, -(-n // block)))
    return base, pieces, used + pieces[-1]


def _packed(k: int, least: float | None, same: bool, dtype: str, width: int):
    """The rows of blocks -> a row for each, with what every query's neighbours have at least: ``floor``.
    Of a block's equal vectors only the k + 1 smallest ids can be among anyone's best."""

    def side(g: pd.DataFrame, key: str) -> tuple:
        return g[key].to_numpy(), g["cell"].to_numpy(np.int32), np.frombuffer(b"".join(g["raw"]), dtype).reshape(-1, width)

    def few(key: np.ndarray, cell: np.ndarray, x: np.ndarray) -> tuple:
        copy = np.unique(np.ascontiguousarray(x).view(f"V{x.itemsize * width}").ravel(), return_inverse=True)[1].ravel()
        if len(key) and np.bincount(copy).max() > k + 1:
            place = np.unique(key, return_inverse=True)[1]
            order = np.lexsort((place, copy))
            nth = np.arange(len(order)) - np.searchsorted(copy[order], copy[order], "left")
            kept = np.sort(order[nth <= k])
            key, cell, x = key[kept], cell[kept], x[kept]
        return key, cell, x

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        for number, b in pd.concat(held).groupby("block") if held else ():
            mine = side(b[b["side"] == 1], "key")
            asked = mine if same else side(b[b["side"] == 0], "q_key")
            key, cell, x = few(*mine)
            floor, own = np.full(len(asked[0]), -np.inf), _unit(x)
            if len(key) > k:
                # The own vector may be one of the k + 1.
                for i in range(0, len(floor), TILE):
                    s = _unit(asked[2][i : i + TILE]) @ own.T
                    floor[i : i + TILE] = np.partition(s, len(key) - k - 1, 1)[:, len(key) - k - 1] - SLACK
            if least is not None:
                floor = np.maximum(floor, least - SLACK)
            there, asks = len(key) > 0, len(floor) > 0
            yield pd.DataFrame({"block": [np.int32(number)], "q_key": [list(asked[0]) if asks else None], "q_cell": [asked[1].tobytes()], "q_raw": [asked[2].tobytes()], "floor": [floor.tobytes() if asks else None], "key": [list(key) if there else None], "cell": [cell.tobytes() if there else None], "raw": [x.tobytes()]})

    return work


def _met(k: int, least: float | None, dtype: str, centres: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Pairs of blocks, those of one block of queries after each other -> each query's k best in all of them."""
    width = centres.shape[1]

    def vectors(raw: bytes) -> np.ndarray:
        return _unit(np.frombuffer(raw, dtype).reshape(-1, width))

    def best(keys: np.ndarray, found: tuple) -> pd.DataFrame:
        i, name, s = found
        out = pd.DataFrame({"q_id": keys[i], "id": name, "similarity": s})
        return out if least is None else out[out["similarity"] >= least]

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, keys, x, floor, found = None, None, None, None, None
        for b in batches:
            for r in b.itertuples(index=False):
                if r.block != at:
                    if found is not None:
                        yield best(keys, found)
                    at, keys, x, floor = r.block, np.asarray(r.q_key), vectors(r.q_raw), np.frombuffer(r.floor, float).copy()
                    found = None
                names, own, cell = np.asarray(r.key), vectors(r.raw), np.frombuffer(r.cell, np.int32)
                here, column = np.unique(cell, return_inverse=True)
                d = _from(x, centres[here])
                gap = np.maximum(d - high[here], low[here] - d)
                for i in range(0, len(x), TILE):
                    f = floor[i : i + TILE]
                    can = gap[i : i + TILE] <= np.sqrt(np.maximum(0.0, 2 - 2 * np.maximum(f, -1.0)))[:, None] + SLACK
                    rows, cols = np.flatnonzero(can.any(1)), np.flatnonzero(can.any(0)[column])
                    if not len(rows):
                        continue
                    s = x[i + rows] @ (own if len(cols) == len(own) else own[cols]).T
                    # Where nothing bounds a query yet, its k + 1 best here do; the own vector may be one of them.
                    least_of, open_ = f[rows], np.isneginf(f[rows])
                    if open_.any() and len(cols) > k + 1:
                        least_of[open_] = np.partition(s[open_], len(cols) - k - 1, 1)[:, len(cols) - k - 1] - SLACK
                    u, j = np.divmod(np.flatnonzero(s >= least_of[:, None] - SLACK), s.shape[1])
                    u, j = i + rows[u], cols[j]
                    other = keys[u] != names[j]
                    found = _kept(found, u[other], j[other], x, own, names, k)
                if found is not None:
                    full = np.bincount(found[0], minlength=len(x)) == k
                    worst = np.full(len(x), np.inf)
                    np.minimum.at(worst, found[0], found[2])
                    floor[full] = np.maximum(floor[full], worst[full] - SLACK)
        if found is not None:
            yield best(keys, found)

    return work


def _kept(found: tuple | None, i: np.ndarray, j: np.ndarray, x: np.ndarray, own: np.ndarray, names: np.ndarray, k: int) -> tuple | None:
    """What was found and pairs of a query and a vector -> the k best of each query, by similarity and id."""
    if not len(i):
        return found
    # By sums that don't depend on where a vector stands in the block; copies may tie in great numbers.
    s = np.concatenate([np.round((x[i[at : at + 8192]] * own[j[at : at + 8192]]).sum(1), DIGITS) for at in range(0, len(i), 8192)])
    name, asks = names[j], np.unique(i)
    rest = None
    if found is not None:
        again = np.isin(found[0], asks)
        rest = tuple(a[~again] for a in found)
        i, name, s = (np.concatenate([a[again], b]) for a, b in zip(found, (i, name, s), strict=True))
    place = np.unique(name, return_inverse=True)[1]
    order = np.lexsort((place, -s, i))
    i, name, s = i[order], name[order], s[order]
    kept = np.arange(len(i)) - np.searchsorted(i, i, "left") < k
    out = (i[kept], name[kept], s[kept])
    return out if rest is None else tuple(np.concatenate([a, b]) for a, b in zip(rest, out, strict=True))
