"""Encoding whole texts through a cache of their space-separated chunks.

A tokenizer spends nearly all of its time on words that it has met before. Both layouts
below cut a text so that each chunk's ids don't depend on its neighbours; a chunk is
encoded once in a worker, and a text is then a join of cached byte strings. Texts with
characters or white-space runs for which that doesn't hold go to the tokenizer whole.
"""

from __future__ import annotations

import functools
import json
import os
from array import array
from collections.abc import Callable, Iterable, Iterator
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common

#: Characters of the texts whose chunks are looked up at a time.
SLICE = 8_000_000


def _plain(text: str) -> bool:
    """Only printable Latin-1, spaces and line feeds, and no special token: no rule of
    either tokenizer (composition, case, white space) then looks beyond a chunk."""
    if "<|" in text or not text.replace("\n", "").isprintable():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def spaced(text: str) -> list[str] | None:
    """Chunks for a byte-level tokenizer whose words carry the space before them: a chunk
    stands for itself with a space before it, unless it begins with a line feed or (the
    first) with NUL. None: the text has to be encoded whole."""
    if not _plain(text):
        return None
    flat = text.replace("\n", " ")
    if "   " in flat or flat.endswith("  "):
        return None
    parts = text.replace("\n", " \n").split(" ")
    parts[0] = f"\0{parts[0]}"
    return parts


#: What ``spaced`` refuses.
_UNSPACED = r"[^\n\x20-\x7e\x{a1}-\x{ac}\x{ae}-\x{ff}]|<\||[\n ]{3}|[\n ]{2}\z"


def spaced_column(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """``spaced`` for a column: which texts have to be encoded whole, and the chunks of the others."""
    none = pa.scalar("", texts.type)
    whole = pc.match_substring_regex(texts, _UNSPACED)
    flat = pc.replace_substring(pc.if_else(whole, none, texts), "\n", " \n")
    return whole, pc.split_pattern(pc.binary_join_element_wise(pa.scalar("\0", texts.type), flat, none), " ")


#: A word and ASCII marks after it, which no split of a byte-level vocabulary takes together.
_MARKED = r"^(?P<word>\pL+)(?P<marks>[!-/:-@\[-`{-~]+)\z"


def spaced_source(chunk: str) -> str:
    """The text that a chunk of ``spaced`` stands for."""
    return chunk[1:] if chunk[:1] == "\0" else chunk if chunk[:1] == "\n" else f" {chunk}"


def dropped(text: str) -> list[str] | None:
    """Chunks for a tokenizer that drops white space."""
    return text.replace("\n", " ").split(" ") if _plain(text) else None


class _Known(dict):
    def __init__(self, find: Callable[[str], bytes]):
        self.find = find

    def __missing__(self, key: str) -> bytes:
        out = self.find(key)
        if len(key) <= 64:
            self[key] = out
        return out


class ChunkCache:
    """texts -> ids as bytes of the type code.

    A chunk is cut into pieces (``pieces``: chunk -> pieces), a piece encoded by ``piece``
    (-> ids); ``whole`` encodes a text that cannot be cut; a chunk of letters only is one piece,
    with ``before`` before it. Two generations of at most ``limit`` chunks, and a quarter of
    that of pieces, are kept: what is met again moves to the young one."""

    def __init__(self, cut: Callable[[str], list[str] | None], pieces: Callable[[str], list[str]], piece: Callable[[str], list[int]], whole: Callable[[str], list[int]], before: str = "", width: int = 2, limit: int = 450_000):
        self.cut, self.pieces, self.piece, self.whole, self.before, self.limit = cut, pieces, piece, whole, before, limit
        self.code = {2: "H", 4: "I"}[width]
        self.young, self.old = _Known(self._chunk), {}
        self.words, self.old_words = _Known(self._word), {}

    def _chunk(self, chunk: str) -> bytes:
        known = self.old.get(chunk)
        if known is None:
            if chunk.isalpha():  # most chunks are a word, or a word and a mark
                return array(self.code, self.piece(self.before + chunk)).tobytes()
            if chunk[-1:] in (".", ",") and chunk[:-1].isalpha():
                return self.young[chunk[:-1]] + self.words[chunk[-1]]
            known = b"".join(map(self.words.__getitem__, self.pieces(chunk)))
        return known

    def _word(self, word: str) -> bytes:
        known = self.old_words.get(word)
        return array(self.code, self.piece(word)).tobytes() if known is None else known

    def turn(self) -> None:
        if len(self.young) > self.limit:
            self.old, self.young = self.young, _Known(self._chunk)
        if len(self.words) > self.limit // 4:
            self.old_words, self.words = self.words, _Known(self._word)

    def one(self, text: str) -> bytes:
        self.turn()
        parts = self.cut(text)
        return array(self.code, self.whole(text)).tobytes() if parts is None else b"".join(map(self.young.__getitem__, parts))

    def many(self, texts: Iterable[str]) -> Iterable[bytes]:
        return map(self.one, texts)


class ColumnCache(ChunkCache):
    """The same with Arrow, by ``columns`` (``cut`` for a column): a slice of texts is cut and
    joined there, and Python looks up each distinct chunk of the slice once."""

    def __init__(self, columns: Callable[[pa.Array], tuple[pa.Array, pa.Array]], *args, **kw):
        super().__init__(*args, **kw)
        self.columns = columns

    def many(self, texts: Iterable[str]) -> Iterable[bytes]:
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= SLICE:
                yield from self._slice(held)
                held, size = [], 0
        if held:
            yield from self._slice(held)

    def _slice(self, texts: list[str]) -> Iterator[bytes]:
        self.turn()
        whole, chunks = self.columns(pa.array(texts, pa.large_string()))
        coded = chunks.values.dictionary_encode()
        # The ids of a text's chunks lie side by side in what take gives.
        _, ends, data = self._distinct(coded.dictionary).take(coded.indices).buffers()
        bounds = np.frombuffer(ends, np.int64)[chunks.offsets.to_numpy()].tolist()
        joined = memoryview(data or b"")
        for i, uncut in enumerate(whole.to_pylist()):
            yield array(self.code, self.whole(texts[i])).tobytes() if uncut else joined[bounds[i] : bounds[i + 1]].tobytes()

    def _distinct(self, chunks: pa.Array) -> pa.Array:
        """The ids of chunks. A word with marks after it has those of the word and of the marks."""
        split = pc.extract_regex(chunks, _MARKED)
        marks = pc.fill_null(pc.struct_field(split, "marks"), "").dictionary_encode()
        words = pc.coalesce(pc.struct_field(split, "word"), chunks).dictionary_encode()
        after = pa.array([self.words[m] if m else b"" for m in marks.dictionary.to_pylist()], pa.large_binary()).take(marks.indices)
        before = pa.array(self._found(words.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(words.indices)
        return pc.binary_join_element_wise(before, after, pa.scalar(b"", pa.large_binary()))

    def _found(self, chunks: list[str]) -> list[bytes]:
        young, old = self.young, self.old
        out = list(map(young.get, chunks))
        for i in [i for i, ids in enumerate(out) if ids is None]:
            chunk = chunks[i]
            ids = old.get(chunk)
            if ids is None:
                ids = young[chunk]  # encodes it
            else:
                young[chunk] = ids
            out[i] = ids
        return out

    def _chunk(self, chunk: str) -> bytes:
        if chunk[:1] in ("\0", "\n"):
            word = chunk[1:].rstrip(punctuation)
            if word.isalpha():  # a word without a space before it, and marks
                marks = chunk[1 + len(word) :]
                return (self.words["\n"] if chunk[0] == "\n" else b"") + self.words[word] + (self.words[marks] if marks else b"")
        return super()._chunk(chunk)


#: Fixed: how byte-level vocabularies split texts before merging (white space by the Unicode
#: property), and how the lower-case one with word ends does.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SPACED_SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
DROPPED_SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+"


#: Fixed: normalizer and pre-tokenizer of the files for which the two layouts hold.
SPACED_FILE = (None, {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True})
DROPPED_FILE = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False},
    ]},
)


def load(path: str) -> dict:
    """A tokenizer file, without what concerns offsets in the text only."""
    with open(path, encoding="utf-8") as f:
        return json.load(f, object_hook=lambda d: {k: v for k, v in d.items() if k != "trim_offsets"})


def cuttable(data: dict, spaces: bool) -> bool:
    """Whether a tokenizer file is of the layout of ``spaced`` (spaces) or ``dropped`` and
    its special tokens are such as ``_plain`` sees. Texts of any other are encoded whole."""
    return (data["normalizer"], data["pre_tokenizer"]) == (SPACED_FILE if spaces else DROPPED_FILE) and all("<|" in t["content"] for t in data["added_tokens"])


def uncut(text: str) -> None:
    """The cut of a file of another layout: no text can be."""


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 ones
    stand for themselves, the others for 256, 257, ... in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


_CACHES: dict[tuple[str, bool], ChunkCache] = {}


def library_cache(path: str, spaces: bool) -> ChunkCache:
    """By the tokenizers library, whose model encodes each piece, and whose encode() each
    text that cannot be cut, or all if the file is not of the expected layout. One for each worker process, which Spark keeps for its next tasks."""
    if (path, spaces) in _CACHES:
        common.hold("tokens", _CACHES.clear)
        return _CACHES[path, spaces]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import regex
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    model, split = t.model.tokenize, regex.compile(SPACED_SPLIT if spaces else DROPPED_SPLIT).findall
    letters = {b: c for c, b in byte_letters().items()}

    def piece(word: str) -> list[int]:
        if not spaces:
            word = word.lower()
        if word.isascii() and word[1:].isalpha():
            return [x.id for x in model("Ġ" + word[1:] if word[0] == " " else word)]
        return [x.id for x in model(word.encode().decode("latin-1").translate(letters))]

    common.hold("tokens", _CACHES.clear)
    cut, pieces = (spaced, lambda c: split(spaced_source(c))) if spaces else (dropped, lambda c: split(c.lower()))
    kind = functools.partial(ColumnCache, spaced_column) if spaces else ChunkCache
    if not cuttable(load(path), spaces):
        cut, kind = uncut, ChunkCache
    width = 2 if t.get_vocab_size(with_added_tokens=True) <= 65536 else 4
    _CACHES[path, spaces] = kind(cut, pieces, piece, lambda text: t.encode(text, add_special_tokens=False).ids, " " if spaces else "", width)
    return _CACHES[path, spaces]


def as_u32(ids: bytes, code: str) -> np.ndarray:
    return np.frombuffer(ids, dtype=np.dtype(code).newbyteorder("<")).astype("<u4")
