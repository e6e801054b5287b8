"""Small cases: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexloom.llm import backtracking_bpe, elias_fano, jump_hash, minhash_dedup, noisy_channel, packing, radix_dedup, secret_ownership, wordcache
from lexloom.llm.queries import tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, kept int, row int, cls int, score int"
random.seed(5)
WORDS = ["".join(random.choice("abcdeé'stREl") for _ in range(random.randint(1, 9))) for _ in range(80)]


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def odd_rows():
    base = prose(60, 1)
    texts = [None, "", " ", "\n", "x", base, base, base.upper(), base + " more", prose(60, 2), "a b", "a b", "A B", prose(9000, 3), "日本 ñ 🙂 ½ <|endoftext|> \t\x1c\x85 a   b  \n", "<|endoftext|>", "e\u0301 x"]
    return [(i, t) for i, t in enumerate(texts)] + [(5, base), (None, base), (None, None), (900, prose(60, 2).replace(WORDS[3], "zz", 1))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", f"s{k % 3}", 1, 2, 3, 4, 5, 6) for k, (i, t) in enumerate(odd_rows())], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def library_ids(name, texts):
    return [e.ids for e in Tokenizer.from_file(tokenizer(name)).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_token_files(docs, none):
    path = tokenizer("byte_bpe_50k.json")
    got = elias_fano.read_token_files(elias_fano.write_token_files(docs, path, segment_ids=500)).collect()
    rows = odd_rows()
    want = Counter((i, len(x) + 1, zlib.crc32(np.array([*x, 0], "<u4").tobytes())) for (i, _), x in zip(rows, library_ids("byte_bpe_50k.json", [t for _, t in rows]), strict=True))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == np.cumsum([0, *(r["n_tokens"] for r in ordered)])[:-1].tolist()
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in ordered]
    assert ids == sorted(ids)
    assert elias_fano.read_token_files(elias_fano.write_token_files(none, path)).count() == 0


@pytest.mark.parametrize("values", [[], [7], [-3, -3, 0, 7, 2**40], list(range(500)), sorted(random.randint(-(2**63), 2**63 - 1) for _ in range(300))])
def test_elias_fano(values):
    e, used = elias_fano.EliasFano.read(memoryview(elias_fano.EliasFano.build(np.array(values, np.int64)).to_bytes() + b"tail"))
    assert e.all().tolist() == values and [e[i] for i in range(len(values))] == values
    if len(values) == 500:
        assert used < 500 * 2


def test_the_reader_finds_boundaries_by_select(spark, monkeypatch):
    ids = [np.arange(k % 5, dtype="<u2").tobytes() for k in range(3000)]
    doc_ids = [None, None, *range(-7, 2991)]
    blob = elias_fano.pack_segment(doc_ids, ids, "H")
    calls = []
    real, frame = elias_fano.EliasFano.select, spark.createDataFrame([(0, 10, sum(k % 5 for k in range(3000)), 3000, bytearray(blob))], elias_fano.SEGMENTS)
    got = sorted((r["start"], r["n_tokens"], r["ids_crc32"], r["doc_id"]) for r in elias_fano.read_token_files(frame).collect() if r["n_tokens"])
    at, want = 10, []
    for i, x in zip(doc_ids, ids, strict=True):
        n = len(x) // 2
        want += [(at, n, zlib.crc32(np.frombuffer(x, "<u2").astype("<u4")), i)] if n else []
        at += n
    assert got == want

    # The reader's own function, here: bounds are read by select and not expanded.
    monkeypatch.setattr(elias_fano.EliasFano, "select", lambda self, i: calls.append(i) or real(self, i))
    kept = {}
    monkeypatch.setattr(elias_fano.common, "tidy", lambda f: kept.setdefault("f", f))
    elias_fano.read_token_files(frame)
    rows = sum(map(len, kept["f"]([elias_fano.pd.DataFrame({"part": [0], "part_start": [10], "blob": [blob]})])))
    assert rows == 3000 and len(calls) >= 3001


def test_elias_fano_refuses_disorder():
    with pytest.raises(ValueError):
        elias_fano.EliasFano.build(np.array([2, 1]))


def test_jump_hash(docs, none):
    got = jump_hash.assign_shards(docs, 8, parts=3).collect()
    assert len(got) == len(odd_rows())
    for s in range(8):
        mine = sorted(r["slot"] for r in got if r["shard"] == s)
        assert mine == list(range(len(mine)))
    assert all(r["grown_shard"] in (r["shard"], 8) for r in got)
    assert sorted((r["size"], r["text_crc32"]) for r in got) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in odd_rows())
    assert jump_hash.assign_shards(none).count() == 0


def test_jump_hash_equals_the_published_loop():
    def slow(key, n):
        """One key at a time, in whole numbers and one division, as published."""
        x, at, ahead = key, -1, 0
        while ahead < n:
            at = ahead
            x = (x * 2862933555777941757 + 1) % 2**64
            ahead = int((at + 1) * (float(2**31) / float((x >> 33) + 1)))
        return at

    keys = np.array([0, 1, -1, 7, 2**63 - 1, -(2**63), *range(1000, 1300)], np.int64)
    for n in (1, 2, 8, 9, 1000):
        assert jump_hash.jump(keys, n).tolist() == [slow(int(k), n) for k in jump_hash.mixed(keys)]


def test_jump_hash_moves_only_into_the_new_shard():
    keys = np.arange(20000)
    for n in (1, 2, 8, 100):
        a, b = jump_hash.jump(keys, n), jump_hash.jump(keys, n + 1)
        assert set(b[a != b]) <= {n} and abs((a != b).mean() - 1 / (n + 1)) < 0.02
        assert np.bincount(a, minlength=n).min() > 0.7 * 20000 / n


def brute_groups(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[lower(t)].append(i)
    return by


def test_radix_dedup(docs, none):
    by = brute_groups(odd_rows())
    got = radix_dedup.duplicate_groups(docs, first_block=4, growth=2).collect()
    want = Counter((i, max((x for x in ids if x is not None), default=None), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in by.items() for i in ids)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(by) == len({r["text_sha256"] for r in kept}) and all(r["doc_id"] == r["keep_id"] for r in kept)
    assert radix_dedup.duplicate_groups(none).count() == 0
    left = radix_dedup.drop_duplicates(docs)
    assert left.columns == docs.columns and left.count() == len(by)


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                root[find(a)] = find(b)
    low = {}
    for k, (i, s) in enumerate(sets):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return [(i, len(s), low.get(find(k)) if s else i) for k, (i, s) in enumerate(sets)]


def near_rows():
    rows = odd_rows()
    r = random.Random(9)
    for g in range(6):
        words = prose(120, 100 + g).split(" ")
        for k in range(8):
            w = list(words)
            for _ in range(k):
                w[r.randrange(len(w))] = f"q{r.randrange(1000)}"
            rows.append((1000 + 10 * g + k, " ".join(w)))
    return rows


def test_near_duplicates(spark, none):
    rows = near_rows()
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, cls int, root int").repartition(3)
    got = minhash_dedup.near_duplicates(df).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter(brute_components(rows))
    assert all(r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["component_id"]) for r in got if r["n_shingles"])
    assert minhash_dedup.near_duplicates(none).count() == 0


def test_one_document_of_each_group_stays(docs):
    left = minhash_dedup.drop_near_duplicates(docs)
    want = len({c for i, n, c in brute_components(odd_rows()) if n}) + sum(1 for i, n, c in brute_components(odd_rows()) if not n)
    assert left.columns == docs.columns and left.count() == want


def test_classes_of_different_components_meet_once(spark):
    root = lambda i: 0 if i < 200 else 200 + (i - 200) // 3
    rooted = spark.createDataFrame([(1, i, 9, root(i)) for i in range(300)] + [(2, i, 9, 7) for i in range(5)], "bucket long, cls long, n_shingles int, root long")
    classes = spark.createDataFrame([(i, 9, b"a", [1]) for i in range(300)], "cls long, n_shingles int, sig binary, bands array<long>")
    rows = minhash_dedup.cells(rooted, classes, size=40).collect()
    cells, met = defaultdict(list), Counter()
    for r in rows:
        cells[r["bucket"], r["lo"], r["hi"]].append((r["cls"], r["own"]))
    for (_, lo, hi), x in cells.items():
        met.update((a, b) for a, i in x for b, j in x if a < b and (lo == hi or i != j) and root(a) != root(b))
    assert met == Counter((a, b) for b in range(300) for a in range(b) if root(a) != root(b))
    assert len(rows) < 300 * 9 and {r["bucket"] for r in rows} == {1}


def test_a_group_just_under_the_threshold_is_not_paired_out(spark, monkeypatch):
    r = random.Random(11)
    base = [f"w{k}" for k in range(300)]
    texts = []
    for i in range(400):
        w = list(base)
        for k in r.sample(range(300), 7):
            w[k] = f"x{i}y{k}"
        texts.append(" ".join(w))
    counted = {}
    for name in ("confirm", "settle"):
        real = getattr(minhash_dedup, name)
        monkeypatch.setattr(minhash_dedup, name, lambda rows, *a, real=real, name=name: counted.__setitem__(name, rows.count()) or real(rows, *a))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = Counter((x["doc_id"], x["n_shingles"], x["component_id"]) for x in minhash_dedup.near_duplicates(df).collect())
    assert got == Counter(brute_components(list(enumerate(texts))))
    assert counted["confirm"] <= 3 * 400 and counted["settle"] < 20 * 400


def test_recall_on_pairs_near_the_threshold(spark):
    """600 pairs with a similarity of 0.75 to 0.85, each found or not by itself."""
    r = random.Random(12)
    rows, true = [], 0
    for i in range(600):
        words = [f"w{i}x{k}" for k in range(200)]
        other = [f"y{k}" if k % 40 == 3 else w for k, w in enumerate(words)]
        other = other[: 200 - r.randrange(8)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        x, y = shingle_set(rows[-2][1]), shingle_set(rows[-1][1])
        true += 100 * len(x & y) >= 75 * len(x | y)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = sum(x["component_id"] != x["doc_id"] for x in minhash_dedup.near_duplicates(df).collect())
    assert true > 300 and found <= true and found >= 0.999 * true


def test_estimate_of_similarity():
    a = np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for share in (0.0, 0.5, 0.75, 1.0):
        k = int(1000 * 2 * share / (1 + share))
        b = np.concatenate([a[:k], np.arange(5000, 6000 - k, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)])
        x, y = (np.frombuffer(minhash_dedup.low_bits(minhash_dedup.signature(minhash_dedup._finish(s))), np.uint8) for s in (a, b))
        assert abs(minhash_dedup.estimate(x[None], y)[0] - share) < 0.14


def test_the_estimate_loses_far_fewer_pairs_than_the_bands():
    n, t = minhash_dedup.MINIMA, 0.75
    p = t + (1 - t) / 16
    lost = sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1) if (k / n - 1 / 16) / (1 - 1 / 16) < minhash_dedup.least_estimate(t))
    bands = (1 - t**minhash_dedup.ROWS) ** minhash_dedup.BANDS
    assert lost < bands / 10, (lost, bands)


def test_backtracking_equals_the_library(docs, none):
    path = tokenizer("byte_bpe_50k.json")
    rows = odd_rows()
    got = backtracking_bpe.encode_digests(docs, path).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter((i, len(x), sha(np.array(x, "<u4").tobytes()), sha((t or "").encode())) for (i, t), x in zip(rows, library_ids("byte_bpe_50k.json", [t for _, t in rows]), strict=True))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
    assert Counter(r["decoded"] for r in backtracking_bpe.encode_decode(docs, path).collect()) == Counter(t or "" for _, t in rows)
    assert backtracking_bpe.encode_digests(none, path).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunk_caches_equal_the_library(name):
    r = random.Random(3)
    letters = " \n\t  abcdeé'stREl0195.,!<|endoftext|> \x1c\x85日ñ🙂½"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(40))) for _ in range(3000)] + ["x \n", "a  \n b", "\n\n", "it's 'S don't", "aaaa" * 500]
    cache = wordcache.library_cache(tokenizer(name), name.startswith("byte"))
    assert [wordcache.as_u32(x, cache.code).tolist() for x in cache.many(texts)] == library_ids(name, texts)


def test_a_column_is_cut_like_its_texts():
    r = random.Random(4)
    letters = " \n  ab,é<|\0\x1c\x7f\x85\xa0\xad½ÿ\u2028日"
    texts = ["".join(r.choice(letters[: r.choice((8, len(letters)))]) for _ in range(r.randrange(9))) for _ in range(5000)] + ["", "a  ", "a \n", "\n\n\n", "<|a"]
    whole, chunks = wordcache.spaced_column(pa.array(texts, pa.large_string()))
    assert [None if uncut else cut for uncut, cut in zip(whole.to_pylist(), chunks.to_pylist(), strict=True)] == [wordcache.spaced(t) for t in texts]


def test_words_are_encoded_and_looked_up_once(monkeypatch):
    monkeypatch.setattr(wordcache, "_CACHES", {})
    monkeypatch.setattr(wordcache, "SLICE", 3000)
    r = random.Random(5)
    words = ["".join(r.choice("abcdeéR") for _ in range(r.randrange(2, 9))) for _ in range(150)]
    texts = [" ".join(r.choice(words) + r.choice(["", "", ",", ".", "!?", "'%&", "\n"]) for _ in range(300)) for _ in range(12)] + ["", "b" * 70 + ". " + "b" * 70]
    cache = wordcache.library_cache(tokenizer("byte_bpe_50k.json"), True)
    pieces, chunks, piece, found = [], [], cache.piece, cache._found
    cache.piece = lambda word: pieces.append(word) or piece(word)
    cache._found = lambda some: chunks.append(some) or found(some)
    want = library_ids("byte_bpe_50k.json", texts)
    assert [wordcache.as_u32(x, cache.code).tolist() for x in cache.many(texts)] == want
    assert len(chunks) > 5 and all(len(set(some)) == len(some) for some in chunks)
    short = [p for p in pieces if len(p) <= 64]
    assert len(set(short)) == len(short)
    cache.limit = 20  # what is forgotten is encoded again
    assert [wordcache.as_u32(x, cache.code).tolist() for x in cache.many(texts)] == want


@pytest.mark.parametrize(
    "name, changes",
    [
        ("byte_bpe_50k.json", {"normalizer": {"type": "Lowercase"}}),
        ("byte_bpe_50k.json", {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}),
        ("word_bpe_49k.json", {"normalizer": None}),
    ],
)
def test_files_of_another_layout_are_not_cut(name, changes, tmp_path):
    path = str(tmp_path / "other.json")
    with open(tokenizer(name), encoding="utf-8") as f:
        data = json.load(f) | changes
    with open(path, "w", encoding="utf-8") as f:
        json.dump(data, f)
    texts = ["Some Words, and Émore", "it's", "", " x  Y\n", "<|endoftext|>A"]
    cache = wordcache.library_cache(path, name.startswith("byte"))
    library = Tokenizer.from_file(path)
    assert [wordcache.as_u32(x, cache.code).tolist() for x in cache.many(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    with pytest.raises(ValueError):
        backtracking_bpe.BacktrackingBPE.from_file(path)


def test_secrets(spark, none):
    key = "A" * 4 + "KIA" + "X1" * 8
    rows = [(1, f"password = 'abcdefghijkl' {key} {'0a' * 10}", "o1/r"), (2, None, "o1/r"), (3, "", None), (4, "token: token: abcdefghijklmnop", "o2/r"), (5, "SECRET=AbCdEfGhIjK1 x Zz9" + "Qw3" * 8, "o3/r"), (6, "Zz9" + "Qw3" * 8, "o3/q")]
    rows += [(10 + i, f"api_key={'e' * 14} é Ex4mple{'Ab1' * 6}", f"own{i}/r") for i in range(5)]
    df = spark.createDataFrame([(i, t, s, 1) for i, t, s in rows], "doc_id long, text string, source string, row int")
    got = {r["doc_id"]: r for r in secret_ownership.scan(df).collect()}
    assert len(got) == len(rows) and got[2]["spans"] == got[3]["spans"] == "" and got[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    for i, t, _ in rows:
        spans = []
        for m in secret_ownership.ASSIGN.finditer(t or ""):
            spans += [(m.start(), 0, f"assign:{m.start()}:{m.end()}")] * (len(m[2]) >= 12)
        spans += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 18]
        spans += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", t or "") if len(m[0]) >= 16]
        base = [s for _, _, s in sorted(spans)]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [got[i][c] for c in ("n_assign", "n_access", "n_hex")] == [sum(k == j for _, k, _ in spans) for j in range(3)]
        assert set(base) <= set(filter(None, got[i]["spans"].split(",")))
    assert got[4]["n_assign"] == 0
    assert "token:" in got[5]["spans"] and "token:" in got[6]["spans"]
    assert got[10]["n_live"] == 0 and got[10]["n_example"] == 2 and "token:" not in got[10]["spans"]
    assert secret_ownership.scan(none).count() == 0


def test_only_live_secrets_are_masked(spark):
    rows = [(1, "password=abcdefghijkl1", "a/r", 22)] + [(10 + i, "token=samplesample1", f"o{i}/r", 19) for i in range(4)] + [(9, None, "a/r", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in secret_ownership.redact(df).collect()}
    assert got == {1: ("[REDACTED]", 10), 9: (None, None), **{10 + i: ("token=samplesample1", 19) for i in range(4)}}
    spans = spark.createDataFrame([("aé🙂def", [(1, 3), (2, 4), (5, 6)])], "text string, spans array<struct<start:int,end:int>>")
    assert spans.select(secret_ownership.masked(F.col("text"), F.col("spans"))).first()[0] == "a[REDACTED]e[REDACTED]"


def test_packing(docs, none):
    path = tokenizer("word_bpe_49k.json")
    rows = odd_rows()
    got = packing.pack(docs, path, capacity=64).collect()
    want = Counter()
    for (i, _), x in zip(rows, library_ids("word_bpe_49k.json", [t for _, t in rows]), strict=True):
        x = [*x, 1]
        want.update((i, k, s, len(x[s : s + 64]), zlib.crc32(np.array(x[s : s + 64], "<u4").tobytes())) for k, s in enumerate(range(0, len(x), 64)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in by.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= 64
    assert packing.pack(none, path).count() == 0


@pytest.mark.parametrize("seed", range(60))
def test_plans_place_every_piece_once(seed):
    r = random.Random(seed)
    cap = r.choice([10, 50, 4096])
    counts: dict[int, int] = {}
    for _ in range(r.randrange(200)):
        w = r.randint(1, cap)
        counts[w] = counts.get(w, 0) + r.choice([1, 2, 50])
    rules, bins = packing.plan(dict(counts), cap)
    full: dict[int, list] = defaultdict(list)
    ranks = defaultdict(list)
    for w, rank, n, first, each, offset in rules.itertuples(index=False):
        ranks[w] += range(rank, rank + n)
        for k in range(n):
            full[first + k // each].append((offset + k % each * w, w))
    assert all(sorted(ranks[w]) == list(range(counts[w])) for w in counts) and len(full) == bins
    for x in full.values():
        at = 0
        for o, w in sorted(x):
            assert o == at
            at += w
        assert at <= cap
    assert bins >= -(-sum(w * n for w, n in counts.items()) // cap)


def best(items, cap):
    """The least number of sequences, by trying everything."""
    items = sorted(items, reverse=True)
    found = [len(items)]

    def place(i, bins):
        if len(bins) >= found[0]:
            return
        if i == len(items):
            found[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= cap and bins[k] not in bins[:k]:
                bins[k] += items[i]
                place(i + 1, bins)
                bins[k] -= items[i]
        place(i + 1, [*bins, items[i]])

    place(0, [])
    return found[0]


@pytest.mark.parametrize("seed", range(40))
def test_reduction_never_costs_a_sequence(seed):
    """Fixed sequences keep the optimum: with what the reduction left packed at best, the total is the optimum."""
    r = random.Random(seed)
    items = [r.randint(1, 20) for _ in range(9)]
    c = packing._Counts(Counter(items))
    fixed, rest = 0, []
    for j in sorted(set(items), reverse=True):
        while c.n.get(j):
            c.take(j, 1)
            beside = packing.dominant_set(c, j, 20 - j)
            if beside is None:
                rest.append(j)
                continue
            for w in beside:
                c.take(w, 1)
            fixed += 1
    if not rest:
        assert fixed == best(items, 20)
    bins = packing.plan(dict(Counter(items)), 20)[1]
    assert bins <= best(items, 20) + 1


def test_disguised_words_are_restored():
    counts: Counter = Counter()
    for text in ["loser trash stupid moron disgusting clown idiot pathetic scum the of and that was her"] * 50:
        x = noisy_channel._CLASS[np.frombuffer(f" {text} ".encode("latin-1"), np.uint8)].astype(int)
        counts.update(((x[:-2] * 28 + x[1:-1]) * 28 + x[2:]).tolist())
    log_p = noisy_channel.log_model(counts)
    for seen, meant in (("l0ser", "loser"), ("l o s e r", "loser"), ("looooser", "loser"), ("tr4sh", "trash"), ("$tup1d", "stupid"), ("i.d.i.o.t", "idiot"), ("p@thetic", "pathetic"), ("5cum", "scum")):
        assert noisy_channel.viterbi(seen, log_p) == meant
    m = noisy_channel.Model(log_p, {"loser": 5.0, "idiot": 5.0}, (-4.0, 4.0))
    assert all(m.score(t) > 0.5 for t in ("you l0ser", "you l o s e r !", "Looooser", "an i.d.i.o.t", "LOSER"))
    assert m.score("the of and her") < 0.5 and m.score("") < 0.5 and m.score("a1b2c3d4e5f60718 3.14 x=1") < 0.5


def likeliest(token, log_p, swap=-1.0, drop=-0.7, keep=-0.1):
    """The best reading, by trying every path through the lattice."""
    found = []

    def go(i, a, b, last, score, text):
        if i == len(token):
            found.append((score + log_p[a][b][0], text))
            return
        ch = token[i]
        arcs = [(noisy_channel._LETTERS.index(ch) + 1, ch, keep)] if ch in noisy_channel._LETTERS else [(27, ch, keep)] if ch.isalpha() else []
        arcs += [(noisy_channel._LETTERS.index(c) + 1, c, swap) for c in noisy_channel.LOOKALIKES.get(ch, "") + noisy_channel.HOMOGLYPHS.get(ch, "")]
        if ch in noisy_channel.SEPARATORS or not arcs or any(c == last for _, c, _ in arcs):
            go(i + 1, a, b, last, score + drop, text)
        for k, c, cost in arcs:
            go(i + 1, b, k, c, score + cost + log_p[a][b][k], text + c)

    go(0, 0, 0, "", 0.0, "")
    return max(found)[1]


def test_viterbi_finds_the_best_of_all_readings():
    log_p, r = insults().log_p, random.Random(2)
    for _ in range(300):
        token = "".join(r.choice("losertraidcé01345!|@$. -а") for _ in range(r.randint(1, 8)))
        assert noisy_channel.viterbi(token, log_p) == likeliest(token, log_p), token


def insults():
    counts: Counter = Counter()
    for text in ["loser trash stupid moron disgusting clown idiot pathetic scum worthless the of and that was her you are"] * 50:
        x = noisy_channel._CLASS[np.frombuffer(f" {text} ".encode("latin-1"), np.uint8)].astype(int)
        counts.update(((x[:-2] * 28 + x[1:-1]) * 28 + x[2:]).tolist())
    return noisy_channel.Model(noisy_channel.log_model(counts), {w: 5.0 for w in "loser idiot pathetic moron trash worthless clown".split()}, (-4.0, 4.0))


def test_no_length_keeps_a_disguise():
    m = insults()
    assert {"loser", "pathetic", "moron"} <= m.words("you/f1lthy/l0s3r/and/a/p4thetic/w0rthless/m0ron")
    spelled = " ".join("you are the of and that was her" * 5).replace("   ", " ")
    for text in ("that/was/her/and/the/of/you/are/that/was/her/l0ser", "l0s" + "e" * 60 + "r", "you/l.0s.er/and/you/are/that/was/her/and/more", spelled + " l o s e r " + spelled):
        assert len(text) > 40 and m.score(text) > 0.5, text
    assert m.score("that/was/her/and/the/of/y0u/are/that/was/her/and") < 0.5 and m.score(spelled) < 0.5
    assert noisy_channel.viterbi("l.o.s.e.r." * 20_000, m.log_p) == "loser" * 20_000


def test_no_separator_keeps_a_disguise():
    m = insults()
    for between in ("    ", "/", "—", "\u200b", "\n", " \t ", "_" * 9, " . . . ", "\u0336 "):
        assert m.score(f"you are a {between.join('idiot')} and that") > 0.5, repr(between)
    for text in ("ＩＤＩＯＴ", "id\u200bi\u00adot", "ıdıøt", "ⅰⅾⅰot", "ⓛⓞⓢⓔⓡ", "i̶d̶i̶o̶t̶", "łoser", "þathetic"):
        assert m.score(text) > 0.5, text
    assert m.score("a b c, d - e / f\ng h") < 0.5 and m.score("1 + 2 = 3, 4 | 5") < 0.5


def test_no_gate_keeps_a_disguise():
    m = insults()
    for seen, meant in (("1d10t", "idiot"), ("l053r", "loser"), ("7r45h", "trash"), ("w0r7hl355", "worthless"), ("p47h371c", "pathetic"), ("!diot", "idiot"), ("|oser", "loser"), ("(|oser),", "loser"), ("((|own!", "clown"), ("!!(|own", "clown"), ("l053r!!", "loser"), ("of/!diot/her", "idiot"), ("m0r0n", "moron")):
        assert meant in m.words(f"you {seen} of") and m.score(f"you {seen} of") > 0.5, seen
    for text in ("an idiioot", "iddiot", "i. d. i. o. t", "an \u0456diot", "l\u043es\u0435r", "mo\u03bfr\u043en.", "l - o - s - e - r", "m00r0n"):
        assert m.score(f"you {text} of") > 0.5, text
    assert m.score("you are 2023 3.14 +49 (of) her!! and $100 |") < 0.5 and m.score("a - b and i. e. x, better tree \u0434\u043e\u043c") < 0.5


def test_what_is_remembered_changes_no_score():
    m, texts = insults(), ["you l0ser l0ser", "idiioot, idiot", "tr4sh l o s e r", "the of", "idiioot"]
    fresh = [insults().score(t) for t in texts]
    assert [m.score(t) for t in texts + texts] == fresh + fresh
    assert all(math.isclose(m.total(t), sum(map(m.of_word, m.words(t)))) for t in texts)


def test_toxicity_learns_from_its_fold_only(spark, none):
    rows, marks = [], []
    for i in range(400):
        toxic = i % 4 == 0
        rows.append((i, prose(30, i) + (" loser l0ser" if toxic and i % 8 else " l0ser" if toxic else ""), 1, 2))
        marks.append((i, 1, int(toxic)))
    rows += [(1000, None, 1, 2), (1001, "", 1, 2), (None, "loser", 1, 2), (3, rows[3][1], 1, 2)]
    marks += [(None, 1, 1), (5, 1, None), (0, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int, toxic int")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = noisy_channel.score_documents(docs, labels).collect()
    assert len(got) == len(rows)
    toxic = {i for i, _, t in marks if t}
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    judged = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 1000]
    assert np.mean([r["predicted"] == (r["doc_id"] in toxic) for r in judged if r["held_out"]]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    flipped = labels.withColumn("toxic", F.when(noisy_channel.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    key = lambda rs: sorted((r["doc_id"] or -1, round(r["score"], 9)) for r in rs)
    assert key(noisy_channel.score_documents(docs, flipped).collect()) == key(got)
    assert noisy_channel.score_documents(none, labels).count() == 0
    assert {r["predicted"] for r in noisy_channel.score_documents(docs, labels.limit(0)).collect()} == {0}


def test_few_labels_give_evidence(spark):
    rows = [(i, prose(30, i) + (" you l0ser" if i % 8 == 0 else "")) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(60)], "doc_id long, toxic int")
    assert labels.where(~noisy_channel.held_out(F.col("doc_id")) & (F.col("toxic") > 0)).count() < 10
    got = noisy_channel.score_documents(docs, labels).collect()
    assert {r["doc_id"] for r in got if r["predicted"]} == {i for i, _ in rows if i % 8 == 0}
