"""Token ids as binary segments with Elias-Fano boundaries.

A segment holds the ids of consecutive documents, one after the other, and two monotone
sequences: the document ids, and where each document's ids begin. Elias-Fano keeps a
monotone sequence of n values below u in about n * (2 + log2(u / n)) bits: the low bits of
each value lie packed side by side, the high bits are a bit vector in unary, and value i is
found by select(i), the position of the i-th set bit. Positions of every 64th set bit are
sampled, so a select scans a few words. The reader has no table of 64-bit offsets.

Segments are rows of a Parquet table in the shared folder: Spark's writers commit a task's
segments once, whatever executors are lost, and any store that Spark reads can hold them.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, wordcache

SAMPLE = 64
#: Rows that the reader makes at a time.
SPAN = 1024
_HEAD = struct.Struct("<QQQB3xII")
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class EliasFano:
    """A non-decreasing sequence of 64-bit integers."""

    def __init__(self, n: int, first: int, top: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.first, self.top, self.low_bits, self.low, self.high, self.samples = n, first, top, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.int64)
        n = len(v)
        if not n:
            return cls(0, 0, 0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint32))
        if (v[1:] < v[:-1]).any():
            raise ValueError("values must not decrease")
        rel = v.astype(np.uint64) - v[:1].astype(np.uint64)
        top = int(rel[-1])
        bits = max(0, (top // n).bit_length() - 1)
        at = (rel >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(at[-1]) // 8 + 1) * 8, np.uint8)
        high[at] = 1
        low = ((rel[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        return cls(n, int(v[0]), top, bits, np.packbits(low.ravel(), bitorder="little"), np.packbits(high, bitorder="little"), at[::SAMPLE].astype(np.uint32))

    def to_bytes(self) -> bytes:
        parts = [x.tobytes() for x in (self.low, self.high, self.samples.astype("<u4"))]
        return _HEAD.pack(self.n, self.first & (2**64 - 1), self.top, self.low_bits, len(parts[0]), len(parts[1])) + b"".join(parts)

    @classmethod
    def read(cls, data: memoryview) -> tuple[EliasFano, int]:
        """The sequence at the front of data, and how many bytes it takes."""
        n, first, top, bits, a, b = _HEAD.unpack_from(data)
        at = _HEAD.size
        low, high = np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, np.uint8, b, at + a)
        k = -(-n // SAMPLE)
        return cls(n, first - 2**64 if first >> 63 else first, top, bits, low, high, np.frombuffer(data, "<u4", k, at + a + b)), at + a + b + 4 * k

    def select(self, i: int) -> int:
        """The position of the i-th set bit of the high part."""
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte = at // 8
        word = int(self.high[byte]) >> (at % 8) << (at % 8)
        while (c := int(_POP[word])) <= left:
            left -= c
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        return byte * 8 + (word & -word).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        low = 0
        for k in range(self.low_bits):
            j = i * self.low_bits + k
            low |= ((int(self.low[j // 8]) >> (j % 8)) & 1) << k
        return self.first + ((self.select(i) - i) << self.low_bits | low)

    def all(self) -> np.ndarray:
        """Every value, by one pass over the bits."""
        high = np.flatnonzero(np.unpackbits(self.high, bitorder="little")).astype(np.uint64) - np.arange(self.n, dtype=np.uint64)
        low = np.unpackbits(self.low, bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits).astype(np.uint64)
        low = (low << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64) if self.low_bits else np.zeros(self.n, np.uint64)
        return ((high << np.uint64(self.low_bits) | low) + np.array([self.first], np.int64).astype(np.uint64)).astype(np.int64)


MAGIC = b"LXEF"


def pack_segment(doc_ids: list[int | None], ids: list[bytes], code: str) -> bytes:
    """doc_ids ascend, nulls first; ids: each document's, as bytes of the type code."""
    nulls = sum(x is None for x in doc_ids)
    width = np.dtype(code).itemsize
    ends = np.concatenate([[0], np.cumsum([len(x) // width for x in ids])])
    head = struct.pack("<4scxxxII", MAGIC, code.encode(), len(doc_ids), nulls)
    return head + EliasFano.build(np.array([x for x in doc_ids if x is not None], np.int64)).to_bytes() + EliasFano.build(ends).to_bytes() + b"".join(ids)


def unpack_segment(blob: bytes) -> tuple[list[int | None], EliasFano, np.ndarray]:
    """Document ids, the boundaries, and all ids."""
    view = memoryview(blob)
    magic, code, _, nulls = struct.unpack_from("<4scxxxII", view)
    if magic != MAGIC:
        raise ValueError("not a segment")
    docs, used = EliasFano.read(view[16:])
    bounds, more = EliasFano.read(view[16 + used :])
    return [None] * nulls + docs.all().tolist(), bounds, np.frombuffer(view[16 + used + more :], np.dtype(code.decode()).newbyteorder("<"))


SEGMENTS = "part int, part_start long, n_ids long, n_docs int, blob binary"


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 0, segment_ids: int = 500_000) -> DataFrame:
    """documents (doc_id, text, ...) -> the stored table of segments.

    Every text (null: empty) is encoded by the tokenizers library without special tokens;
    end_id follows each document. Documents are dealt by ranges of doc_id, so the segments
    in order of (part, part_start) hold them in ascending order of doc_id, null ids first;
    rows that repeat a doc_id lie side by side in an order that their texts fix. A segment
    takes about segment_ids ids. An empty table gives no segments.
    """
    common.small_batches(docs.sparkSession)

    @functools.partial(common.tidy, keeps="tokens")
    def encode(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        cache = wordcache.library_cache(tokenizer_path, True)
        code = cache.code
        end = np.array([end_id], code).tobytes()
        width, start = len(end), 0
        names: list[int | None] = []
        held: list[bytes] = []
        n = 0

        def segment() -> pd.DataFrame:
            return pd.DataFrame({"part": [part], "part_start": [start], "n_ids": [n], "n_docs": [len(names)], "blob": [pack_segment(names, held, code)]})

        for b in batches:
            for i, ids in zip(b["id_text"], cache.many(b["text"].tolist()), strict=True):
                names.append(None if i is None else int(i))
                held.append(ids + end)
                n += len(ids) // width + 1
                if n >= segment_ids:
                    yield segment()
                    start, n, names, held = start + n, 0, [], []
        if names:
            yield segment()

    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # The id travels as text: a column of longs with nulls would come as doubles.
    dealt = whole.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    return common.keep(common.store(dealt.select(F.col("doc_id").cast("string").alias("id_text"), "text").mapInPandas(encode, SEGMENTS), "token-segments"))


def read_token_files(segments: DataFrame) -> DataFrame:
    """The stored segments -> doc_id, start, n_tokens, ids_crc32 (unsigned, ids as
    little-endian unsigned 32-bit integers), one row per document.

    A document's boundaries come by select, one after the other; they are never expanded.
    Only the sum of each part (one number for each partition written) goes to the driver
    and comes back with the tasks."""
    sums = {r["part"]: r["n"] for r in segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    before, total = {}, 0
    for part in sorted(sums):
        before[part], total = total, total + sums[part]

    @common.tidy
    def decode(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, start, blob in zip(b["part"], b["part_start"], b["blob"], strict=True):
                names, bounds, ids = unpack_segment(blob)
                for lo in range(0, len(names), SPAN):
                    rows = []
                    p = bounds[lo]
                    for i in range(lo, min(lo + SPAN, len(names))):
                        q = bounds[i + 1]
                        rows.append((start + before[part] + p, q - p, zlib.crc32(ids[p:q].astype("<u4"))))
                        p = q
                    out = pd.DataFrame(rows, columns=["start", "n_tokens", "ids_crc32"])
                    out.insert(0, "doc_id", pd.array(names[lo : lo + SPAN], "Int64"))
                    yield out

    return segments.select("part", "part_start", "blob").mapInPandas(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
