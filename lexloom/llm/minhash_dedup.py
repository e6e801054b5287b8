"""Near duplicates by b-bit MinHash.

A document is the set of its distinct five-word shingles. Documents with the same set form
a class, which stands for them from then on. Each class has 200 minima in 40 bands of five;
of every minimum four bits are kept, packed into 100 bytes. Classes that agree on a band are
candidates. Counting equal four-bit fields of two signatures and correcting for chance
agreement (1 in 16) estimates their similarity; candidates well below the threshold go
(five standard errors), all others are compared by their full shingle sets.

Candidates are never all pairs of a bucket. A first pass links each class with the three
most similar of the smallest classes of its buckets. After it only buckets whose classes are
in different components matter: each is cut into cells of bounded size, in which all pairs
of different components meet once; classes of the component that has most of the bucket are
not compared with each other. A cell first looks at signatures alone and names the classes that
have a candidate; only their shingle sets are then sent to the cell, which counts exactly,
skips what has become one component meanwhile, and returns links between components.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .radix_dedup import normalised

SHINGLE = 5
BANDS, ROWS, BITS = 40, 5, 4
MINIMA = BANDS * ROWS
_RNG = np.random.default_rng(20240229)
_A = (_RNG.integers(0, 2**32, MINIMA, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _RNG.integers(0, 2**32, MINIMA, dtype=np.uint64).astype(np.uint32)
_MIX = _RNG.integers(0, 2**63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_ROW = _RNG.integers(0, 2**63, ROWS, dtype=np.uint64) | np.uint64(1)
#: A text's words: what these characters do not separate. (str.split() would also split at others.)
_GAPS = str.maketrans({c: " " for c in "\t\n\v\f\r"})


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ x >> np.uint64(33)


class Words(dict):
    """word -> 64-bit hash, the same in every process."""

    def __missing__(self, word: str) -> int:
        h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        if len(word) <= 64:
            self[word] = h
        return h


_WORDS = Words()


def forget() -> None:
    """Drops the words that this process knows."""
    _WORDS.clear()


def shingles(lowered: str) -> np.ndarray:
    """The sorted distinct shingle hashes of a text whose A-Z are lower-cased."""
    if len(_WORDS) > 150_000:
        _WORDS.clear()
    words = [w for w in lowered.translate(_GAPS).split(" ") if w]
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = len(h)
    k = min(n, SHINGLE)
    total = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        total = _finish(total * _MIX[i] + h[i : n - k + 1 + i])
    return np.unique(total)


def signature(hashes: np.ndarray, step: int = 512) -> np.ndarray:
    """The 200 minima of a set that isn't empty."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), step):
        np.minimum(out, (_A[:, None] * x[None, i : i + step] + _B[:, None]).min(1), out=out)
    return out


def low_bits(minima: np.ndarray) -> bytes:
    """Four bits of each minimum, two to a byte. The minima are mixed first: being small,
    they differ in their low bits as their shingles do, for every function alike."""
    x = minima * np.uint32(0x9E3779B1)
    x = (x ^ x >> np.uint32(15)) * np.uint32(0x85EBCA77)
    x = (x ^ x >> np.uint32(13)) & np.uint32(2**BITS - 1)
    return (x[::2] | x[1::2] << np.uint32(BITS)).astype(np.uint8).tobytes()


def band_keys(minima: np.ndarray) -> np.ndarray:
    m = minima.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        key = _finish(key * _ROW[i] + m[:, i])
    return key.view(np.int64)


_SAME = np.array([(i & 15 == 0) + (i >> 4 == 0) for i in range(256)], np.uint8)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from packed signatures (rows of bytes): the share of equal fields,
    corrected for fields that agree by chance."""
    share = _SAME[a ^ b].sum(-1, dtype=np.int32) / MINIMA
    return (share - 1 / 16) / (1 - 1 / 16)


def least_estimate(threshold: float) -> float:
    chance = 1 / 2**BITS
    p = threshold + (1 - threshold) * chance
    return threshold - 5 * (p * (1 - p) / MINIMA) ** 0.5 / (1 - chance)


SETS = "id_text string, th long, n_shingles long, print binary, sig binary, bands array<long>"


def sets_of(docs: DataFrame) -> DataFrame:
    """One row per document: set size, the set's fingerprint (128 bits of its sorted
    hashes; null if empty), packed signature and band keys. th: hash of the whole text."""
    common.small_batches(docs.sparkSession)

    @common.tidy
    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, th, text in zip(b["id_text"], b["th"], b["text"], strict=True):
                s = shingles(text)
                if len(s):
                    m = signature(s)
                    rows.append((name, th, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), low_bits(m), band_keys(m)))
                else:
                    rows.append((name, th, 0, None, None, None))
            yield pd.DataFrame(rows, columns=["id_text", "th", "n_shingles", "print", "sig", "bands"])
        forget()

    return _texts(docs).mapInPandas(work, SETS)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("string").alias("id_text"), F.xxhash64(normalised()).alias("th"), normalised().alias("text"))


def common_size(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements two sorted arrays without repetitions share."""
    if len(a) < len(b):
        a, b = b, a
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return int((a[at] == b).sum()) if len(b) else 0


def confirm(pairs: DataFrame, sets: DataFrame, threshold: int, chunk: int = 200) -> DataFrame:
    """pairs (a, b), sets (cls, hashes) -> the pairs with 100 * common >= threshold * union.

    A pair's members meet under (a, chunk): a's set once for each chunk of at most about
    ``chunk`` partners, before theirs, so a task holds one set and reads the partners' one
    by one, and a class with very many partners is dealt to many tasks."""
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    dealt = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int").alias("chunk"))
    heads = many.select("a", F.col("a").alias("cls"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("role"))
    wanted = heads.unionByName(dealt.select("a", F.col("b").alias("cls"), "chunk", F.lit(1).alias("role")))
    rows = wanted.join(sets, "cls").repartition("a", "chunk").sortWithinPartitions("a", "chunk", "role").select("a", "cls", "role", "hashes")

    @common.tidy
    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head = np.zeros(0, np.uint64)
        for b in batches:
            out = []
            for a, cls, role, blob in b.itertuples(index=False):
                s = np.frombuffer(blob, np.uint64)
                if role == 0:
                    head = s
                    continue
                both = common_size(head, s)
                if 100 * both >= threshold * (len(head) + len(s) - both):
                    out.append((a, cls))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return rows.mapInPandas(work, "a long, b long")


CELL = "bucket long, lo int, hi int, cls long, own int, root long, n_shingles int, sig binary, bands array<long>"


def cells(rooted: DataFrame, classes: DataFrame, size: int = 1000, per_unit: int = 2000) -> DataFrame:
    """rooted (bucket, cls, n_shingles, root) -> rows of CELL. In a bucket of several
    components, any two classes of different ones meet in exactly one cell (bucket, lo, hi).

    A block holds about ``size`` units, a class counting one for itself and one for each
    ``per_unit`` shingles. Classes of the bucket's largest component have blocks of their own,
    which meet those of the others only: a bucket of n classes, of which k are outside the
    largest component, makes about (n + k) * (1 + k / size) rows."""
    unit = 1 + F.floor(F.col("n_shingles") / per_unit)
    by_root = rooted.groupBy("bucket", "root").agg(F.sum(unit).alias("units"))
    mixed = by_root.groupBy("bucket").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("units", "root")).alias("main"), F.max("units").alias("most"), F.sum("units").alias("all")).where("roots > 1")
    blocks = lambda units: F.ceil(units / size).cast("int")
    mixed = mixed.select("bucket", "main", blocks(F.col("most")).alias("inner"), blocks(F.col("all") - F.col("most")).alias("outer"))
    x = rooted.join(mixed, "bucket").withColumn("of_main", F.col("root") == F.col("main"))
    draw = lambda n: F.pmod(F.xxhash64("cls"), n).cast("int")
    x = x.withColumn("own", F.when(F.col("of_main"), F.col("outer") + draw(F.col("inner"))).otherwise(draw(F.col("outer"))))
    last = F.when(F.col("of_main"), F.col("outer")).otherwise(F.col("outer") + F.col("inner")) - 1
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    x = x.select("bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "cls", "own", "root")
    return x.join(classes.select("cls", F.col("n_shingles").cast("int").alias("n_shingles"), "sig", "bands"), "cls").select("bucket", "lo", "hi", "cls", "own", "root", "n_shingles", "sig", "bands")


class Cell:
    """The classes of one cell. ``partners`` says which later ones a class is to be compared
    with: of another component (as merged so far) and, if the cell joins two blocks, of the
    other block; similar enough by size and signature; and with no earlier band in common, in
    whose cell the pair is compared already."""

    def __init__(self, rows: dict[str, np.ndarray], least: float, threshold: int):
        self.apart, self.least, self.threshold = rows["lo"][0] != rows["hi"][0], least, threshold
        self.own, self.root, self.n = rows["own"], rows["root"], rows["n_shingles"].astype(np.int64)
        self.sig = np.frombuffer(b"".join(rows["sig"]), np.uint8).reshape(len(self.own), -1)
        self.bands = np.stack(rows["bands"])
        self.band = int((self.bands[0] == rows["bucket"][0]).argmax())
        self.same = self.root.copy()

    def partners(self, i: int) -> np.ndarray:
        ok = self.same[i + 1 :] != self.same[i]
        if self.apart:
            ok &= self.own[i + 1 :] != self.own[i]
        n, m = self.n[i], self.n[i + 1 :]
        ok &= 100 * np.minimum(n, m) >= self.threshold * np.maximum(n, m)
        at = np.flatnonzero(ok) + i + 1
        if len(at):
            at = at[estimate(self.sig[at], self.sig[i]) >= self.least]
        if len(at):
            at = at[(self.bands[at] == self.bands[i]).argmax(1) == self.band]
        return at

    def merge(self, i: int, j: int) -> None:
        self.same[self.same == self.same[j]] = self.same[i]


def _by_cell(batches: Iterable[pd.DataFrame]) -> Iterator[list[dict[str, np.ndarray]]]:
    """Rows that come sorted by cell -> for each batch the cells that end in it, columns as
    arrays. Cells of one row are left out."""
    held: list[dict[str, np.ndarray]] = []

    def whole() -> dict[str, np.ndarray]:
        return held[0] if len(held) == 1 else {c: np.concatenate([x[c] for x in held]) for c in held[0]}

    for b in batches:
        if not len(b):
            continue
        cols = {c: b[c].to_numpy() for c in b.columns}
        keys = np.stack([cols[c].astype(np.int64) for c in ("bucket", "lo", "hi")], 1)
        ends = [*(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        done, at = [], 0
        for end in ends:
            if held and any(held[0][c][0] != k for c, k in zip(("bucket", "lo", "hi"), keys[at], strict=True)):
                done.append(whole())
                held = []
            held.append({c: v[at:end] for c, v in cols.items()})
            at = end
        yield [x for x in done if len(x["cls"]) > 1]
    if held:
        yield [x for x in [whole()] if len(x["cls"]) > 1]


def wanted(dealt: DataFrame, least: float, threshold: int) -> DataFrame:
    """The rows of cells whose classes have a candidate there."""

    @common.tidy
    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cells_ in _by_cell(batches):
            out = []
            for rows in cells_:
                cell, hit = Cell(rows, least, threshold), np.zeros(len(rows["cls"]), bool)
                for i in range(len(hit) - 1):
                    at = cell.partners(i)
                    if len(at):
                        hit[at] = hit[i] = True
                if hit.any():
                    out.append({c: v[hit] for c, v in rows.items()})
            if out:
                yield pd.DataFrame({c: np.concatenate([x[c] for x in out]) for c in out[0]})

    return dealt.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "cls").mapInPandas(work, CELL)


def settle(asked: DataFrame, sets: DataFrame, least: float, threshold: int, most: int = 2_000_000) -> DataFrame:
    """Rows of cells and the sets of their classes -> links (a, b) between components, enough
    of them to connect what the exact links connect. ``most``: shingles looked up at a time."""
    rows = asked.join(sets, "cls").repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "cls")

    @common.tidy
    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in itertools.chain.from_iterable(_by_cell(batches)):
            cell, out = Cell(rows, least, threshold), []
            flat, codes = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in rows["hashes"]]), return_inverse=True)
            marked = np.zeros(len(flat), bool)
            codes = np.split(codes.astype(np.int32), np.cumsum(cell.n)[:-1])
            for i in range(len(codes) - 1):
                at = cell.partners(i)
                if not len(at):
                    continue
                marked[codes[i]] = True
                while len(at):
                    part = at[: max(1, int(np.searchsorted(np.cumsum(cell.n[at]), most, "right")))]
                    at = at[len(part) :]
                    ends = np.cumsum(cell.n[part])
                    both = np.add.reduceat(marked[np.concatenate([codes[j] for j in part])], ends - cell.n[part], dtype=np.int64)
                    for j in part[100 * both >= threshold * (cell.n[i] + cell.n[part] - both)]:
                        if cell.same[j] != cell.same[i]:
                            out.append((cell.root[i], cell.root[j]))
                            cell.merge(i, j)
                    at = at[cell.same[at] != cell.same[i]]
                marked[codes[i]] = False
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return rows.select(*(f.split(" ")[0] for f in CELL.split(", ")), "hashes").mapInPandas(work, "a long, b long")


@common.scratch()
def near_duplicates(docs: DataFrame, threshold: int = 75) -> DataFrame:
    """documents (doc_id, text, ...) -> doc_id, n_shingles, component_id, kept.

    threshold: per cent of the union that two linked sets have in common. Null, empty and
    blank texts have no shingles and are linked with nothing: component_id is their own id.
    Null ids rank after all others. Of rows that repeat doc_id and text all get the same
    result. Other columns are ignored; an empty table gives no rows. Signatures miss a pair at
    the threshold itself with a chance of 2 in 100,000, and fewer above it."""
    rows = common.store(sets_of(docs), "minhash-sets")
    doc = F.col("id_text").cast("long")
    full = rows.where("n_shingles > 0")
    by_print = full.groupBy("print").agg(
        F.min(doc).alias("first"), F.min_by("th", doc).alias("th"), F.min("th").alias("any_th"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("bands").alias("bands")
    )
    classes = common.store(by_print.select(F.monotonically_increasing_id().alias("cls"), "print", "first", F.coalesce("th", "any_th").alias("th"), "n_shingles", "sig", "bands"), "minhash-classes")

    keys = classes.select("cls", "n_shingles", F.explode("bands").alias("bucket"))
    leaders = keys.groupBy("bucket").agg(F.min("cls").alias("a"), F.count("*").alias("n")).where("n > 1").select("bucket", "a")
    members = common.store(keys.join(leaders, "bucket").select("bucket", "cls", "n_shingles", "a"), "minhash-members")
    least = least_estimate(threshold / 100)
    of = lambda x: classes.select(F.col("cls").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
    star = members.where("a <> cls").select("a", F.col("cls").alias("b")).distinct().join(of("a"), "a").join(of("b"), "b")
    star = star.where(100 * F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b"))
    fields = F.pandas_udf(lambda a, b: pd.Series(estimate(np.frombuffer(b"".join(a), np.uint8).reshape(len(a), -1), np.frombuffer(b"".join(b), np.uint8).reshape(len(b), -1))), "double")
    star = star.select("a", "b", fields("sig_a", "sig_b").alias("like")).where(F.col("like") >= least)
    best = F.slice(F.sort_array(F.collect_list(F.struct("like", "a")), asc=False), 1, 3)  # of at most one for each band
    pairs = common.store(star.groupBy("b").agg(best.alias("best")).select("b", F.explode("best.a").alias("a")), "minhash-pairs")

    sets = common.store(_sets(docs, rows, classes.join(members.select("cls").distinct(), "cls", "left_semi")), "minhash-hashes")
    links = common.store(confirm(pairs, sets, threshold), "minhash-links")
    roots = common.store(common.components(links, "minhash"), "minhash-roots")
    rooted = members.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("bucket", "cls", "n_shingles", F.coalesce("root", "cls").alias("root"))
    asked = common.store(wanted(cells(rooted, classes), least, threshold), "minhash-asked")
    more = common.store(settle(asked, sets, least, threshold), "minhash-more")
    last = common.store(common.components(more, "minhash-last"), "minhash-last").select(F.col("node").alias("root"), F.col("root").alias("joined"))

    named = classes.select("cls", "print", "first").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    named = named.join(last, "root", "left").select("print", "first", F.coalesce("joined", "root").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = common.store(named.join(smallest, "root").select("print", "component_id"), "minhash-ids")
    out = lambda df, c: df.select(doc.alias("doc_id"), "n_shingles", c.alias("component_id"), F.coalesce(doc == c, F.lit(False)).alias("kept"))
    some = out(full.select("id_text", "n_shingles", "print").join(ids, "print"), F.col("component_id"))
    none = rows.where("n_shingles = 0").select(doc.alias("doc_id"), "n_shingles", doc.alias("component_id"), F.lit(True).alias("kept"))
    return common.keep(common.store(some.unionAll(none), "minhash-result"))


def _sets(docs: DataFrame, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls, hashes) of the classes that share a bucket, from one document of each: the text
    of its first id. Only ids are sent to the texts where the classes are few. Rows that repeat
    doc_id and text come once."""
    known = lambda df: df.withColumn("id_text", F.coalesce("id_text", F.lit("")))
    picked = common.store(known(classes.select("cls", F.col("first").cast("string").alias("id_text"), "th")), "minhash-picked")

    @common.tidy
    def hashed(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"cls": b["cls"], "hashes": [shingles(t).tobytes() for t in b["text"]]})
        forget()

    found = known(_texts(docs)).join(common.few(picked), ["id_text", "th"]).select("cls", "text").mapInPandas(hashed, "cls long, hashes binary")
    again = known(rows.select("id_text", "th")).join(common.few(picked), ["id_text", "th"]).count() > picked.count()
    return found.dropDuplicates(["cls"]) if again else found


@common.scratch()
def drop_near_duplicates(docs: DataFrame, threshold: int = 75) -> DataFrame:
    """docs without all but one document of each group of near copies, all columns, whatever
    their names. The rows are numbered and stored first, and the numbers serve as ids: of a
    group the row with the smallest doc_id stays (nulls last), of rows that repeat it any
    one; null, empty and blank texts all stay. Only the numbers of the rows that go are joined with the table."""
    row = common.free_name(docs, "row")
    numbered = common.keep(common.store(docs.withColumn(row, F.monotonically_increasing_id()), "minhash-input"))
    named = numbered.select(F.col(row).alias("row"), F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"))
    found = near_duplicates(numbered.select(F.col(row).alias("doc_id"), "text"), threshold).select(F.col("doc_id").alias("row"), F.col("component_id").alias("group"))
    several = found.where("row <> group").select("group").distinct()
    grouped = common.store(found.join(several, "group").join(named, "row"), "minhash-groups")
    stays = grouped.groupBy("group").agg(F.min(F.struct("id", "row")).alias("first")).select("group", "first.row")
    gone = common.keep(common.store(grouped.select("row").join(stays.select("row"), "row", "left_anti").select(F.col("row").alias(row)), "minhash-gone"))
    return numbered.join(common.few(gone), row, "left_anti").drop(row)
