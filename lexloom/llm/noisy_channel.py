"""Toxicity of text that may be disguised.

Who disguises an insult swaps letters for look-alikes (l0ser), spaces them out (l o s e r)
or repeats them (looooser). Such a token is a lattice: each character may stand for some
letters, a separator or a repeated letter may stand for nothing. The Viterbi path through
the lattice under a character trigram model is what was most likely meant. Model counts come
from every document of the corpus. Restored words are then scored: words and word beginnings
that labelled documents show to go with toxicity carry evidence, and a logistic curve fitted
on the same documents turns a text's evidence into a probability.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed: the letters for which a character often stands.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "gq", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
#: Fixed: letters that look like plain Latin ones and don't come apart into one and a mark.
HOMOGLYPHS = {
    "а": "a", "е": "e", "і": "i", "ї": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "ѕ": "s", "у": "y", "х": "x", "һ": "h", "ԁ": "d", "ո": "n", "ӏ": "l", "ԛ": "q", "ԝ": "w",
    "α": "a", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ł": "l", "þ": "p", "ø": "o", "đ": "d", "ħ": "h", "ı": "i", "ŧ": "t", "ƒ": "f", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʏ": "y", "ɪ": "i", "ʀ": "r", "ɴ": "n", "ʟ": "l",
}
SEPARATORS = " .-_*~"
_STRIP = ".,;:!?\"'()[]{}<>|*_-~#%&/\\"
#: Of these what is no look-alike.
_EDGE = "".join(c for c in _STRIP if c not in LOOKALIKES)
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Model classes: 0 no letter, 1-26 a-z, 27 any other letter.
CLASSES = 28
_CLASS = np.zeros(256, np.uint8)
for _b in range(256):
    _c = bytes([_b]).decode("latin-1").lower()
    _CLASS[_b] = _LETTERS.index(_c) + 1 if _c in _LETTERS else 27 if _c.isalpha() else 0
#: Letters one by one, with any number of anything else between.
_SPACED = re.compile(r"(?<![^\W_])[^\W_](?:[\W_]+[^\W_]){2,}(?![^\W_])|(?<!\S)[\w@$!|+(€£](?:(?:[^\w@$!|+(€£]|_)+[\w@$!|+(€£]){3,}(?!\S)")
#: Fixed: marks without width, and marks on the letter before.
_UNSEEN = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]")
_NOISY = re.compile(r"[0-9@$!|+(€£]|[.\-_*~]")
_PARTS = re.compile(r"[^\w]+|_")
_TWICE = re.compile(r"(.)\1+")
_FAR = re.compile(r"[^\x00-\xff]")
_FOREIGN = re.compile(f"[{''.join(HOMOGLYPHS)}]")
_LATIN = str.maketrans(HOMOGLYPHS)
#: Where a token is cut into parts that are decoded on their own: at what can't stand inside a word, and at every separator.
_CUTS = (re.compile(r"[^\w@$!|+(€£.\-*~]+"), re.compile(r"[^\w@$!|+(€£]+|_+"))


def classes(text: str) -> np.ndarray:
    """The class of each character, with a space before and after. A letter beyond Latin-1
    counts as any other letter."""
    try:
        raw = f" {text} ".encode("latin-1")
    except UnicodeEncodeError:
        raw = _FAR.sub(lambda m: "ÿ" if m[0].isalpha() else "?", f" {text} ").encode("latin-1")
    return _CLASS[np.frombuffer(raw, np.uint8)]


def plain(text: str) -> str:
    """Lower-cased; of compatible forms (full width, circled, ligatures) the usual one, and
    nothing that isn't seen. Letters with marks of their own stay letters of their own."""
    if text.isascii():
        return text.lower()
    return _UNSEEN.sub("", unicodedata.normalize("NFKC", text)).lower()


def collapsed(word: str) -> str:
    """Look-alikes of other letters as Latin ones, each repeated letter once. Letters with
    marks of their own (é, ü) are those of other languages' words, and stay what they are."""
    return _TWICE.sub(r"\1", word.translate(_LATIN))


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(code, n) of class trigrams in all whole texts; code = (a * 28 + b) * 28 + c.
    Each task sends at most 28^3 sums."""
    common.small_batches(docs.sparkSession)

    @common.tidy
    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(CLASSES**3, np.int64)
        for b in batches:
            for text in b["text"]:
                x = classes(text).astype(np.uint16)
                total += np.bincount((x[:-2] * CLASSES + x[1:-1]) * np.uint16(CLASSES) + x[2:], minlength=CLASSES**3)
        code = np.flatnonzero(total)
        yield pd.DataFrame({"code": code.astype(np.int32), "n": total[code]})

    return docs.where("text is not null").select("text").mapInPandas(count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def log_model(counts: dict[int, int]) -> np.ndarray:
    """log P(c | a, b) of letters and the word end, shorter contexts filling in."""
    n = np.zeros(CLASSES**3)
    for code, k in counts.items():
        n[code] = k
    n = n.reshape(CLASSES, CLASSES, CLASSES)
    one = (n.sum((0, 1)) + 1) / (n.sum() + CLASSES)
    two = (n.sum(0) + 50 * one) / (n.sum((0, 2))[:, None] + 50)
    return np.log((n + 50 * two) / (n.sum(2)[:, :, None] + 50))


_NOTHING: dict[str, float] = {}


@dataclass
class Model:
    """Everything that scoring needs; its size doesn't depend on the corpus."""

    log_p: np.ndarray
    evidence: dict[str, float] = field(default_factory=dict)
    weights: tuple[float, float] = (-4.0, 0.0)
    restored: dict[tuple[str, bool], str] = field(default_factory=dict)
    table: list | None = None
    seen: dict[str, dict[str, float]] = field(default_factory=dict)
    stems: frozenset[str] | None = None

    def restore(self, token: str, loose: bool = False) -> str:
        """The most likely letters behind a token of any length; only short ones are
        remembered. loose: what the edges have of punctuation may be just that."""
        known = self.restored.get((token, loose))
        if known is None:
            if self.table is None:
                self.table = self.log_p.tolist()
            known = viterbi(token, self.table, loose=_STRIP if loose else "")
            if len(token) <= 64:
                if len(self.restored) > 50_000:
                    self.restored.clear()
                self.restored[token, loose] = known
        return known

    def inside(self, run: str) -> Iterator[str]:
        """Words with evidence in a text written letter by letter, which has lost its word ends."""
        run = collapsed(run)
        return (w for w in self.evidence if len(w) > 3 and w[-1] != "*" and collapsed(w) in run)

    def of_word(self, word: str) -> float:
        get = self.evidence.get
        return max(get(word, 0.0), get(f"{word[:4]}*", 0.0), get(f"{word[:5]}*", 0.0))

    def matters(self, word: str) -> bool:
        """Whether dropping repetitions from a word can give one with evidence: what is
        restored collapses to the same letters. Always, while nothing is learned."""
        if not self.evidence:
            return True
        if self.stems is None:
            self.stems = frozenset(collapsed(w.rstrip("*")) + w[len(w.rstrip("*")) :] for w in self.evidence)
        short = collapsed(word)
        return short in self.stems or any(f"{short[:k]}*" in self.stems for k in range(1, 6))

    def of_token(self, token: str) -> set[str]:
        """The words that a token, lower-cased and without white space, may stand for: as
        written and, where disguised, restored."""
        w = token.strip(_EDGE)
        if w.isalpha():
            return {w, self.restore(w)} if self.disguised(w) else {w}
        w = w.strip(_STRIP)
        out = {w} if w.isalpha() else {y for y in _PARTS.split(w) if y.isalpha()}
        for y in readings(token):
            if self.disguised(y) if y.isalpha() else _NOISY.search(y):
                out.add(self.restore(y))
                if y[:2].strip(_STRIP) == "" or y[-2:].strip(_STRIP) == "":
                    out.add(self.restore(y, True))
        return out

    def disguised(self, word: str) -> bool:
        """Whether a word of letters only may be another with repetitions or foreign letters."""
        return bool(_TWICE.search(word) or not word.isascii() and _FOREIGN.search(word)) and self.matters(word)

    def spelled(self, lowered: str) -> set[str]:
        """What is written letter by letter, whatever else is between and however much."""
        x = classes(lowered)
        letter = np.flatnonzero(x[1:-1] > 0) + 1
        alone = (x[letter - 1] == 0) & (x[letter + 1] == 0)
        out: set[str] = set()
        if (alone[2:] & alone[1:-1] & alone[:-2]).any() or any(s in lowered for s in LOOKALIKES):
            for m in _SPACED.finditer(lowered):
                run = self.restore(m[0])
                out.add(run)
                out.update(self.inside(run))
        return out

    def words(self, text: str) -> set[str]:
        """Distinct words of a text, as written and, where disguised, restored."""
        t = plain(text)
        return self.spelled(t).union(*map(self.of_token, set(t.split())))

    def _told(self, token: str) -> dict[str, float]:
        """The words of a token that have evidence."""
        told = {w: odds for w in self.of_token(token) if (odds := self.of_word(w))} or _NOTHING
        if len(token) <= 64:
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[token] = told
        return told

    def total(self, text: str) -> float:
        """The summed evidence of a text's distinct words."""
        t, known, found = plain(text), self.seen.get, {}
        for token in set(t.split()):
            told = known(token)
            if told is None:
                told = self._told(token)
            if told:
                found.update(told)
        found.update((w, odds) for w in self.spelled(t) if (odds := self.of_word(w)))
        return math.fsum(found.values())

    def score(self, text: str) -> float:
        a, b = self.weights
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * math.log1p(self.total(text))))))


def readings(token: str) -> set[str]:
    """What a token may be meant as: it and its parts, with all, the innermost or none of the
    look-alikes at either edge, which may be punctuation as well. All are decoded; their
    evidence, learned from the same readings, decides."""
    found = set()
    for part in {token, *(y for cut in _CUTS for y in cut.split(token))}:
        part = part.strip(_EDGE)
        core = part.strip(_STRIP)
        if core:
            at = part.index(core)
            end = at + len(core)
            found |= {part[i:j] for i in (0, max(0, at - 1), at) for j in (end, end + 1, len(part))}
        elif part:
            found.add(part)
    return found


def viterbi(token: str, log_p: np.ndarray | list, swap: float = -1.0, drop: float = -0.7, keep: float = -0.1, loose: str = "") -> str:
    """States are the last two classes; an arc emits a letter or nothing. swap: cost of a
    look-alike; drop: of a repeated letter or separator that stands for nothing; loose:
    characters that may do so at the edges. Work is in proportion to the token: the states
    do not grow with it, and paths share their beginnings."""
    p = log_p.tolist() if isinstance(log_p, np.ndarray) else log_p
    best: dict[tuple[int, int, str], tuple[float, tuple | None]] = {(0, 0, ""): (0.0, None)}
    token = token.lower()
    inner = range(len(token) - len(token.lstrip(loose)), len(token.rstrip(loose))) if loose else range(len(token))
    for i, ch in enumerate(token):
        arcs: list[tuple[int, str, float]] = []
        if ch in _LETTERS:
            arcs.append((_LETTERS.index(ch) + 1, ch, keep))
        elif ch.isalpha():
            arcs.append((27, ch, keep))
        arcs += [(_LETTERS.index(c) + 1, c, swap) for c in LOOKALIKES.get(ch) or HOMOGLYPHS.get(ch, "")]
        after: dict[tuple[int, int, str], tuple[float, tuple | None]] = {}
        for (a, b, last), (score, text) in best.items():
            options = [(a, b, last, score + drop, text)] if ch in SEPARATORS or not arcs or i not in inner or any(c == last for _, c, _ in arcs) else []
            options += [(b, k, c, score + cost + p[a][b][k], (text, c)) for k, c, cost in arcs]
            for a2, b2, c2, s2, t2 in options:
                if (a2, b2, c2) not in after or after[a2, b2, c2][0] < s2:
                    after[a2, b2, c2] = (s2, t2)
        best = after
    path = max(((s + p[a][b][0], t) for (a, b, _), (s, t) in best.items()), key=lambda x: x[0])[1]
    out = []
    while path is not None:
        path, c = path
        out.append(c)
    return "".join(reversed(out))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


#: Parts of one into which the logarithm of a document's evidence is rounded where the curve is fitted.
STEPS = 1000
#: Fixed: how likely a feature that says nothing may seem to go with toxicity.
CHANCE = 1e-4


def surprise(share: float) -> Column:
    """n times the divergence of a feature's toxic share from that of all documents: minus
    the log of Chernoff's bound on the chance of at least so many toxic among the n that
    have it. Holds for any number of labels; 0 where the share is not above."""
    n = F.col("toxic") + F.col("clean")
    part = lambda k, q: F.when(k > 0, k * F.log(k / (n * q))).otherwise(0.0)
    return F.when(F.col("toxic") > n * share, part(F.col("toxic"), share) + part(F.col("clean"), 1 - share)).otherwise(0.0)


@common.scratch()
def fit(docs: DataFrame, labels: DataFrame, max_train: int = 20_000, least_share: float = 0.01, least_evidence: float = 1.5) -> Model:
    """The character model from all texts; evidence and curve from at most max_train
    labelled documents outside the held-out fold (those with the smallest hashed ids, so
    the same ones each time). A word or beginning counts if it is in at least least_share
    of the toxic ones, its log odds are least_evidence, and so many toxic ones among those
    that have it would be a chance of at most ``CHANCE`` if it did not matter. To the driver go
    28^3 counts, at most 1 / least_share features for each word of a text, and max_train
    numbers. Without labels of both kinds nothing has evidence and all scores are low."""
    counts = {r["code"]: r["n"] for r in trigram_counts(docs).collect()}
    model = Model(log_model(counts))
    chosen = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    # Bounded by max_train rows of two numbers.
    train = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")

    @common.tidy
    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            for text, toxic in zip(b["text"], b["toxic"], strict=True):
                words = model.words(text)
                seen = words | {f"{w[:4]}*" for w in words if len(w) > 4} | {f"{w[:5]}*" for w in words if len(w) > 5}
                by[int(toxic > 0)].update(seen | {""})
        yield pd.DataFrame([(w, by[1][w], by[0][w]) for w in by[0].keys() | by[1].keys()], columns=["feature", "toxic", "clean"])

    common.small_batches(docs.sparkSession)
    found = train.mapInPandas(count, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    found = common.store(found, "toxic-features")
    whole = found.where("feature = ''").first()
    if whole is None or not whole["toxic"] or not whole["clean"]:
        return model
    share = whole["toxic"] / (whole["toxic"] + whole["clean"])
    least = least_share * whole["toxic"]
    odds = F.log((F.col("toxic") + 0.5) / (F.col("clean") + 0.5)) - math.log((whole["toxic"] + 1) / (whole["clean"] + 1))
    rows = found.where(F.col("toxic") >= least).where(surprise(share) >= -math.log(CHANCE)).select("feature", odds.alias("odds")).where(F.col("odds") >= least_evidence).where("feature <> ''").collect()
    model.evidence = {r["feature"]: r["odds"] for r in rows}

    @common.tidy
    def sums(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()
        for b in batches:
            n.update((round(math.log1p(model.total(t)) * STEPS), int(y > 0)) for t, y in zip(b["text"], b["toxic"], strict=True))
        yield pd.DataFrame([(x, y, k) for (x, y), k in n.items()], columns=["x", "y", "n"])

    # Bounded by the steps, whatever rows repeat.
    got = train.mapInPandas(sums, "x int, y int, n long").groupBy("x", "y").agg(F.sum("n").alias("n")).toPandas()
    model.weights = logistic(got["x"].to_numpy(float) / STEPS, got["y"].to_numpy(float), got["n"].to_numpy(float))
    return model


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.1) -> tuple[float, float]:
    """Intercept and slope by Newton steps over points that stand for n documents each."""
    z, w = np.stack([np.ones_like(x), x], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (n * p * (1 - p))[:, None]).T @ z + ridge * np.eye(2), z.T @ (n * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """documents -> the same columns with the score (0 to 1) under ``name``, which must be
    free (``common.free_name``). Null and empty texts have no evidence. Texts of any length are read
    whole; the distinct words of one are held at a time. Rows that repeat stay; an empty table gives no rows; nothing is shuffled."""
    common.small_batches(docs.sparkSession)
    columns = docs.columns
    schema = docs.withColumn(name, F.lit(0.0)).schema

    @common.tidy
    def work(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for b in batches:
            scores = [model.score(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(scores, pa.float64())], names=[*columns, name])

    return docs.mapInArrow(work, schema)


def score_documents(docs: DataFrame, labels: DataFrame, max_train: int = 20_000) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from a score of 0.5 on); a null doc_id is not
    held out. Only the text makes a score."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels, max_train))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
