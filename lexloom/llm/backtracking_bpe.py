"""Byte-pair encoding by backtracking over longest token matches.

Merging pairs by rank is quadratic in a word's length in the worst case. The same ids come
from a left-to-right search: an Aho-Corasick automaton over the vocabulary's byte strings
gives the longest token at each position; a token may follow another only if their bytes
together still encode as those two (the pair-compatibility table); where none may, the
search goes back one token and takes the next shorter match. Since the encoding of a prefix
is unique, a position once found dead stays dead, which makes the time linear.

Two neighbours a, b are compatible unless some merge joins a right end of a with a left end
of b before both are complete. The right ends of a are a, its right child, and so on; each
exists from its own merge until its parent's. At equal rank the leftmost pair merges first.

Decoding gathers bytes from one buffer of all tokens through an offset table.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, wordcache


class BacktrackingBPE:
    """A byte-level vocabulary with merges, and the special tokens of its file."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], added: dict[str, int]):
        import ahocorasick
        import regex

        letters = wordcache.byte_letters()
        raw = lambda t: "".join(chr(letters[c]) for c in t)  # noqa: E731  bytes as Latin-1 text
        ids = {raw(t): i for t, i in vocab.items()}
        self.rank: dict[tuple[str, str], int] = {}
        self.children: dict[str, tuple[str, str]] = {}
        self.born: dict[str, int] = {}
        for r, (a, b) in enumerate(merges):
            a, b = raw(a), raw(b)
            self.rank.setdefault((a, b), r)
            self.children.setdefault(a + b, (a, b))
            self.born.setdefault(a + b, r)
        #: Tokens that merging can reach, by number; 0 stands for none.
        self.token = ["", *(t for t in ids if len(t) == 1 or t in self.children)]
        self.number = {t: k for k, t in enumerate(self.token)}
        self.length = [len(t) for t in self.token]
        self.id = [ids.get(t, -1) for t in self.token]
        self.shorter = [next((self.number[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.number), 0) for t in self.token]
        self.matcher = ahocorasick.Automaton()
        for k, t in enumerate(self.token):
            if k:
                self.matcher.add_word(t, (len(t) - 1, k))
        self.matcher.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.added = added
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
        self.split = regex.compile(wordcache.SPACED_SPLIT)
        table = {i: t.encode("latin-1") for t, i in ids.items()} | {i: t.encode() for t, i in added.items()}
        lengths = np.array([len(table.get(i, b"")) for i in range(max(table, default=-1) + 1)], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        self.buffer = np.frombuffer(b"".join(table.get(i, b"") for i in range(len(lengths))), np.uint8)

    @classmethod
    def from_file(cls, path: str) -> BacktrackingBPE:
        """Of a byte-level file. One that changes or splits texts in another way, or whose merges
        have marks of their own, would get other ids here, so it is an error."""
        data = wordcache.load(path)
        model = data["model"]
        marks = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        if not wordcache.cuttable(data, True) or model["type"] != "BPE" or any(model.get(m) for m in marks):
            raise ValueError(f"{path} is not a plain byte-level vocabulary")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        return cls(model["vocab"], merges, {t["content"]: t["id"] for t in data["added_tokens"]})

    def _ends(self, t: str, side: int) -> list[tuple[str, float]]:
        """The tokens at one end of t as it forms, each with the rank of the merge that takes it up."""
        out: list[tuple[str, float]] = []
        until = float("inf")
        while True:
            out.append((t, until))
            if t not in self.children:
                return out
            until = self.born[t]
            t = self.children[t][side]

    def compatible(self, a: int, b: int) -> bool:
        known = self.pairs.get(a << 32 | b)
        if known is None:
            known = True
            for x, x_until in self._ends(self.token[a], 1):
                for y, y_until in self._ends(self.token[b], 0):
                    r = self.rank.get((x, y))
                    if r is not None and r < x_until and r <= y_until:
                        known = False
            if len(self.pairs) > 500_000:
                self.pairs.clear()
            self.pairs[a << 32 | b] = known
        return known

    def piece(self, text: str) -> list[int]:
        """ids of one piece, given as the Latin-1 letters of its bytes."""
        if (k := self.number.get(text)) is not None:
            return [self.id[k]] if k else []
        n = len(text)
        longest = [0] * n
        for end, (back, k) in self.matcher.iter(text):  # for each end, the longest match comes first
            if self.length[longest[end - back]] <= back:
                longest[end - back] = k
        length, shorter, compatible = self.length, self.shorter, self.compatible
        dead = bytearray(n + 1)
        out: list[int] = []
        at = last = 0
        t = longest[0]
        while at < n:
            while t and (dead[at + length[t]] or last and not compatible(last, t)):
                t = shorter[t]
            if t:
                out.append(t)
                last = t
                at += length[t]
                t = longest[at] if at < n else 0
            else:
                dead[at] = 1
                t = out.pop()
                at -= length[t]
                t = shorter[t]
                last = out[-1] if out else 0
        return [self.id[k] for k in out]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            out += self._plain(text[at : m.start()])
            out.append(self.added[m[0]])
            at = m.end()
        return out + self._plain(text[at:])

    def _plain(self, text: str) -> list[int]:
        return [i for w in self.split.findall(text) for i in self.piece(w.encode().decode("latin-1"))]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of all ids: each output byte's place in the buffer is its token's offset
        and how far it is into the token."""
        if not len(ids):
            return b""
        start = self.offsets[ids]
        length = self.offsets[ids.astype(np.int64) + 1] - start
        ends = np.cumsum(length)
        return self.buffer[np.repeat(start - ends + length, length) + np.arange(ends[-1])].tobytes()


_LOADED: dict[str, tuple[BacktrackingBPE, wordcache.ChunkCache]] = {}


def _worker(path: str) -> tuple[BacktrackingBPE, wordcache.ChunkCache]:
    if path not in _LOADED:
        bpe = BacktrackingBPE.from_file(path)
        width = 2 if len(bpe.offsets) <= 65537 else 4
        cut = lambda c: bpe.split.findall(wordcache.spaced_source(c))
        _LOADED[path] = bpe, wordcache.ChunkCache(wordcache.spaced, cut, lambda w: bpe.piece(w.encode().decode("latin-1")), bpe.encode, " ", width)
    common.hold("bpe", _LOADED.clear)
    return _LOADED[path]


def encode_decode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """documents (doc_id, text, ...) -> doc_id, ids (little-endian unsigned 32-bit), decoded.

    Null texts count as empty and give no ids. Rows that repeat stay; nothing is shuffled.
    A lone surrogate cannot occur in Spark strings; bytes of any other text come back as they were."""
    return _run(docs, tokenizer_path, "ids binary, decoded string", lambda ids, text: {"ids": [x.tobytes() for x in ids], "decoded": [t.decode("utf-8", "replace") for t in text]})


def encode_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """As encode_decode, but of ids and decoded text only the digests leave the worker:
    doc_id, n_tokens, ids_sha256, decoded_sha256."""
    sha = lambda xs: [hashlib.sha256(x).hexdigest() for x in xs]
    return _run(docs, tokenizer_path, "n_tokens long, ids_sha256 string, decoded_sha256 string", lambda ids, text: {"n_tokens": [len(x) for x in ids], "ids_sha256": sha(x.data for x in ids), "decoded_sha256": sha(t.decode("utf-8", "replace").encode() for t in text)})


def _run(docs: DataFrame, path: str, columns: str, made) -> DataFrame:
    common.small_batches(docs.sparkSession)

    @functools.partial(common.tidy, keeps="bpe")
    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe, cache = _worker(path)
        for b in batches:
            ids = [wordcache.as_u32(x, cache.code) for x in cache.many(b["text"].tolist())]
            text = [bpe.decode(x) for x in ids]
            yield pd.DataFrame({"doc_id": pd.array([None if i is None else int(i) for i in b["id_text"]], "Int64"), **made(ids, text)})

    whole = docs.select(F.col("doc_id").cast("string").alias("id_text"), F.coalesce("text", F.lit("")).alias("text"))
    return whole.mapInPandas(work, f"doc_id long, {columns}")
