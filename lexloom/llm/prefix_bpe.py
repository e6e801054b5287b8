"""Byte-pair encoding by dynamic programming over prefixes.

A text's encoding ends, at each of its bytes, in exactly one token that is valid there: the
last one of that prefix's own encoding. So a table with one token for each byte holds the
encodings of all prefixes, and a prefix's ids are read by walking back by token lengths.

The token at a byte follows from tokens before it alone: of the vocabulary's tokens that end
there (an Aho-Corasick automaton lists them), the valid one is that whose bytes, together with
the token that ends where it begins, encode as just these two. Hence:

* bytes may be appended at any time; what is in the table stays;
* after an edit the table is recomputed from the edit on, until as many tokens in a row as the
  longest token has bytes are what they were before; from there on all of them are.

Ranks decide merges as in tiktoken: of all neighbours whose bytes together are in the
vocabulary, those with the lowest rank merge first, the leftmost if equal; a piece that is in
the vocabulary is that token however it would merge.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, wordcache

#: How far beyond its end the split looks before it ends a piece: two letters, in "'ll".
LOOK = 2


class PrefixBPE:
    """A vocabulary of byte strings with ranks, which are also the ids."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick
        import regex

        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every single byte must be in the vocabulary")
        self.rank = {t.decode("latin-1"): r for t, r in ranks.items()}
        #: Tokens that merging reaches; only they can be a prefix's last.
        self.reached = {t: r for t, r in self.rank.items() if self.merge(t) == [t]}
        self.name = {r: t for t, r in self.reached.items()}
        self.size = {r: len(t) for r, t in self.name.items()}
        self.longest = max(self.size.values())
        self.matcher = ahocorasick.Automaton()
        for t, r in self.reached.items():
            self.matcher.add_word(t, (len(t), r))
        self.matcher.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.split = regex.compile(wordcache.SPACED_SPLIT)
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for t, r in ranks.items():
            lengths[r] = len(t)
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        self.buffer = np.frombuffer(b"".join(t for t, _ in sorted(ranks.items(), key=lambda x: x[1])), np.uint8)

    @classmethod
    def from_file(cls, path: str) -> PrefixBPE:
        """Lines of a token in base 64 and its rank."""
        with open(path, "rb") as f:
            return cls({base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())})

    def merge(self, text: str) -> list[str]:
        """The tokens of a short text by merging as the ranks say; for pairs of tokens only."""
        parts = list(text)
        while len(parts) > 1:
            low, at = min((self.rank.get(a + b, 1 << 62), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if low == 1 << 62:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            x, y = self.name[a], self.name[b]
            if len(self.pairs) > 500_000:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merge(x + y) == [x, y]
        return known

    def fill(self, piece: str, last: list[int], at: int, old: list[int] | None = None, shift: int = 0, same_from: int = 0) -> int:
        """Sets last[at + 1 ...] for a piece given as Latin-1 letters; last[p] is the last token
        of its first p bytes, last[0] unused. Returns how many were worked out.

        With ``old``, the table before an edit that moved what follows by ``shift`` bytes: from
        ``same_from`` on the piece's bytes are old ones; once a token's length of tokens agrees
        there, the rest is taken over."""
        begin = max(0, at - self.longest + 1)
        size, compatible = self.size, self.compatible
        done = at
        agreed = 0
        for end, (n, token) in self.matcher.iter(piece, begin) if begin else self.matcher.iter(piece):
            p = end + 1
            if p <= done:
                continue
            before = p - n
            if before < begin or before and not compatible(last[before], token):
                continue
            last[p] = token
            done = p
            if old is not None and p - self.longest >= same_from:
                agreed = agreed + 1 if old[p - shift] == token else 0
                if agreed >= self.longest:
                    last[p + 1 :] = old[p - shift + 1 :]
                    return p - at
        return len(piece) - at

    def walk(self, last: list[int]) -> list[int]:
        """The ids of a piece, from its table."""
        out = []
        p = len(last) - 1
        while p:
            out.append(last[p])
            p -= self.size[last[p]]
        return out[::-1]

    def table(self, piece: str) -> list[int]:
        last = [0] * (len(piece) + 1)
        self.fill(piece, last, 0)
        return last

    def piece(self, word: str) -> list[int]:
        raw = word.encode().decode("latin-1")
        known = self.rank.get(raw)
        return [known] if known is not None else self.walk(self.table(raw))

    def encode(self, text: str) -> list[int]:
        return [i for w in self.split.findall(text) for i in self.piece(w)]

    def decode(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        start = self.offsets[ids]
        length = self.offsets[ids.astype(np.int64) + 1] - start
        ends = np.cumsum(length)
        return self.buffer[np.repeat(start - ends + length, length) + np.arange(ends[-1])].tobytes()


class PrefixText:
    """A text with its pieces and the table of each, for appends and edits."""

    def __init__(self, bpe: PrefixBPE, text: str = "", state: tuple[bytes, bytes] | None = None):
        self.bpe, self.text = bpe, text
        #: For each piece: its letters, its bytes as Latin-1 letters, its table.
        self.pieces: list[tuple[str, str, list[int]]] = []
        #: Prefixes whose last token had to be worked out so far.
        self.worked = 0
        if state is None:
            for w in bpe.split.findall(text):
                self._add(self.pieces, w)
            return
        at, lengths, last = 0, np.frombuffer(state[0], "<u4").tolist(), np.frombuffer(state[1], "<u4")
        byte = 0
        for n in lengths:
            word = text[at : at + n]
            raw = word.encode().decode("latin-1")
            self.pieces.append((word, raw, [0, *last[byte : byte + len(raw)].tolist()]))
            at, byte = at + n, byte + len(raw)

    def _add(self, pieces: list, word: str) -> None:
        raw = word.encode().decode("latin-1")
        pieces.append((word, raw, self.bpe.table(raw)))
        self.worked += len(raw)

    def state(self) -> tuple[bytes, bytes]:
        """Letters of each piece, and the last token of each byte's prefix, as unsigned 32-bit integers."""
        return np.array([len(w) for w, _, _ in self.pieces], "<u4").tobytes(), np.array([t for _, _, last in self.pieces for t in last[1:]], "<u4").tobytes()

    def ids(self) -> list[int]:
        out: list[int] = []
        for _, raw, last in self.pieces:
            known = self.bpe.rank.get(raw)
            out += [known] if known is not None else self.bpe.walk(last)
        return out

    def append(self, text: str) -> None:
        self.edit(len(self.text), len(self.text), text)

    def edit(self, start: int, stop: int, insert: str) -> None:
        """Puts ``insert`` in place of the letters from start up to stop."""
        new = self.text[:start] + insert + self.text[stop:]
        keep = at = 0
        while keep < len(self.pieces) and at + len(self.pieces[keep][0]) + LOOK < start:
            at += len(self.pieces[keep][0])
            keep += 1
        old_at = {}  # where old pieces begin, as letters of the new text
        moved, p = len(insert) - (stop - start), at
        for k in range(keep, len(self.pieces)):
            if p >= stop:
                old_at[p + moved] = k
            p += len(self.pieces[k][0])
        old_at[len(new)] = len(self.pieces)
        fresh: list[tuple[str, str, list[int]]] = []
        rest = len(self.pieces)
        for m in self.bpe.split.finditer(new, at):
            if m.start() in old_at and m.start() >= start + len(insert):
                rest = old_at[m.start()]
                break
            self._near(fresh, m[0], keep)
        self.pieces[keep:rest] = fresh
        self.text = new

    def _near(self, fresh: list, word: str, keep: int) -> None:
        """A piece of the new text: the first one starts as an old one did, and shares with it
        what is before and behind the edit."""
        if fresh or keep >= len(self.pieces):
            return self._add(fresh, word)
        raw, (_, was, table) = word.encode().decode("latin-1"), self.pieces[keep]
        n = min(len(raw), len(was))
        head = next((i for i in range(n) if raw[i] != was[i]), n)
        tail = next((i for i in range(n - head) if raw[-1 - i] != was[-1 - i]), n - head)
        last = table[: head + 1] + [0] * (len(raw) - head)
        self.worked += self.bpe.fill(raw, last, head, table, len(raw) - len(was), len(raw) - tail) if head < len(raw) else 0
        fresh.append((word, raw, last))


_LOADED: dict[str, tuple[PrefixBPE, wordcache.ChunkCache]] = {}


def _worker(path: str) -> tuple[PrefixBPE, wordcache.ChunkCache]:
    if path not in _LOADED:
        bpe = PrefixBPE.from_file(path)
        cut = lambda c: bpe.split.findall(wordcache.spaced_source(c))
        width = 2 if len(bpe.offsets) <= 65537 else 4
        _LOADED[path] = bpe, wordcache.ChunkCache(wordcache.spaced, cut, bpe.piece, bpe.encode, " ", width)
    common.hold("prefixes", _LOADED.clear)
    return _LOADED[path]


def encode(docs: DataFrame, ranks_path: str, prefixes: bool = False) -> DataFrame:
    """documents (doc_id, text, ...) -> doc_id, ids (little-endian unsigned 32-bit), decoded;
    with ``prefixes`` also text, and piece_letters and last_tokens for ``edit``: four bytes for each
    byte of the text.

    The split is the usual one of byte-level vocabularies. Null and empty texts give no ids, an empty
    table no rows; columns other than doc_id and text are not read. A text of any length is encoded
    whole, in time linear in its bytes and at most the longest token for each; rows that repeat stay. Nothing is shuffled."""
    more = ", text string, piece_letters binary, last_tokens binary" if prefixes else ""

    def made(bpe: PrefixBPE, cache: wordcache.ChunkCache, texts: list[str]) -> dict:
        if not prefixes:
            ids = [wordcache.as_u32(x, cache.code) for x in cache.many(texts)]
            return {"ids": [x.tobytes() for x in ids], "decoded": [bpe.decode(x).decode() for x in ids]}
        held = [PrefixText(bpe, t) for t in texts]
        ids = [np.array(t.ids(), "<u4") for t in held]
        states = [t.state() for t in held]
        return {"ids": [x.tobytes() for x in ids], "decoded": [bpe.decode(x).decode() for x in ids], "text": texts, "piece_letters": [s[0] for s in states], "last_tokens": [s[1] for s in states]}

    return _run(docs, ranks_path, f"ids binary, decoded string{more}", made)


def encode_digests(docs: DataFrame, ranks_path: str) -> DataFrame:
    """As ``encode``, but only digests leave the worker: doc_id, n_tokens, ids_sha256 (of decimal
    ids joined by commas), decoded_sha256 (of the decoded bytes)."""

    def made(bpe: PrefixBPE, cache: wordcache.ChunkCache, texts: list[str]) -> dict:
        out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for x in cache.many(texts):
            ids = wordcache.as_u32(x, cache.code)
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(bpe.decode(ids)).hexdigest())
        return out

    return _run(docs, ranks_path, "n_tokens long, ids_sha256 string, decoded_sha256 string", made)


def _run(docs: DataFrame, path: str, columns: str, made) -> DataFrame:
    common.small_batches(docs.sparkSession)

    @functools.partial(common.tidy, keeps="prefixes")
    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe, cache = _worker(path)
        for b in batches:
            yield pd.DataFrame({"doc_id": pd.array([None if i is None else int(i) for i in b["id_text"]], "Int64"), **made(bpe, cache, b["text"].tolist())})

    whole = docs.select(F.col("doc_id").cast("string").alias("id_text"), F.coalesce("text", F.lit("")).alias("text"))
    return whole.mapInPandas(work, f"doc_id long, {columns}")


def edit(encoded: DataFrame, edits: DataFrame, ranks_path: str) -> DataFrame:
    """What ``encode(..., prefixes=True)`` gave, and edits (doc_id, at, start, stop, insert) ->
    the same columns after them and ``worked``: how many prefixes' tokens had to be found anew.

    An edit puts ``insert`` (null: nothing) in place of the letters from start up to stop, which
    are clipped to the text; start = stop = a large number appends. Edits of a document are
    applied one after the other by ``at``, each to the text as the one before left it. Documents
    without edits are passed on as they are, with worked = 0; edits of unknown or null ids do
    nothing. Rows that repeat a doc_id all get its edits. The edits of one document are held
    together in one row, so they are taken to be short beside its text."""
    steps = edits.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("at", "start", "stop", F.coalesce("insert", F.lit("")).alias("insert")))).alias("steps"))
    columns = ["doc_id", "ids", "decoded", "text", "piece_letters", "last_tokens"]
    both = encoded.select(*columns).join(steps, "doc_id", "left")
    same = both.where(F.col("steps").isNull()).select(*columns, F.lit(0).cast("long").alias("worked"))
    common.small_batches(encoded.sparkSession)

    @functools.partial(common.tidy, keeps="prefixes")
    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe, _ = _worker(ranks_path)
        for b in batches:
            out = []
            for x in b.itertuples(index=False):
                t = PrefixText(bpe, x.text, (x.piece_letters, x.last_tokens))
                for s in x.steps:
                    start = min(max(int(s["start"]), 0), len(t.text))
                    t.edit(start, min(max(int(s["stop"]), start), len(t.text)), s["insert"])
                ids = np.array(t.ids(), "<u4")
                out.append((x.doc_id, ids.tobytes(), bpe.decode(ids).decode(), t.text, *t.state(), t.worked))
            yield pd.DataFrame(out, columns=[*columns, "worked"])

    changed = both.where(F.col("steps").isNotNull()).mapInPandas(work, "doc_id long, ids binary, decoded string, text string, piece_letters binary, last_tokens binary, worked long")
    return changed.unionAll(same)
