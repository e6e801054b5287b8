"""Ball trees, prefix programming and conversation repair against plain versions of the same."""

from __future__ import annotations

import base64
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import ball_tree, conversation_repair, prefix_bpe, queries

SPACE = " \t\n\x0b\x0c\r"


# conversations


def turns_after(rows):
    """The contract's damage, and the turns of each conversation in order."""
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            mine += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    rank = lambda t: (t[0] is not None, t[0] or 0, t[1], t[2][:64], hashlib.sha256(t[2].encode()).digest())
    return {c: sorted(x, key=rank) for c, x in out.items()}


def faults_of(turns):
    seen, out = set(), []
    for _, role, text in turns:
        shown = text.strip(SPACE)
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(turns, faults):
    """By trying everything: (cost, audit, repaired), over all edits with at most two insertions at a place."""
    best = None

    def go(i, cost, audit, done):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(turns):
            for n in range(3):
                for more in itertools.product(("user", "assistant"), repeat=n):
                    all_ = done + [(r, "") for r in more]
                    if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in all_)):
                        mine = (cost + 5 * n, audit + "I" * n, "\n".join(f"{r}:{t}" for r, t in all_))
                        best = min(best, mine) if best else mine
            return
        _, role, text = turns[i]
        for n in range(3):
            for more in itertools.product(("user", "assistant"), repeat=n):
                base = done + [(r, "") for r in more]
                if not re.match("s?(ua)*u?$", "".join(r[:1] or "?" for r, _ in base)):
                    continue
                go(i + 1, cost + 5 * n + 2, audit + "I" * n + "D", base)
                if faults[i] not in ("blank", "duplicate"):
                    stay = 5 * (faults[i] == "truncated")
                    for letter, r, c in (("K", role, 0), ("R", "user", 1), ("R", "assistant", 1)):
                        if re.match("s?(ua)*u?$", "".join(x[:1] or "?" for x, _ in base) + (r[:1] or "?")):
                            go(i + 1, cost + 5 * n + c + stay, audit + "I" * n + letter, base + [(r, text)])

    go(0, 0, "", [])
    return best


def expected(rows):
    out = []
    for conv, turns in turns_after(rows).items():
        faults = faults_of(turns)
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        bad = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        cost, audit, repaired = cheapest(turns, faults)
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), bad, cost, audit, hashlib.sha256(repaired.encode()).hexdigest()))
    return sorted(out, key=str)


def odd_conversations(n, seed):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", "", "  \t", None, "same.", "same.", "x\n", "Ünï."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, ""]
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, 6)):
            rows.append((None if c == 3 else c, None if rng.random() < 0.1 else t + (rng.random() < 0.1) * 3, rng.choice(roles), rng.choice(texts)))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("parts", [1, 13])
def test_repairs_are_the_cheapest(spark, parts):
    rows = odd_conversations(150, parts)
    table = spark.createDataFrame(rows, SCHEMA).withColumns({"kind": F.lit(1), "row": F.lit("x"), "Digest": F.lit(0)}).repartition(3)
    got = conversation_repair.repair(conversation_repair.damage(table), parts).select(conversation_repair.RESULT).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(rows)
    assert {r["conv_id"] for r in got} == {r[0] for r in rows}


def test_blocks_give_what_one_block_gives(spark, monkeypatch):
    rng = random.Random(3)
    roles, texts = ["user", "assistant", "system", "user", "assistant", "tool"], ["Yes.", "No!", "cut", "", "a.", "b.", "c?"]
    rows = [(7, i // 2, rng.choice(roles), rng.choice(texts) + str(i % 40) + ".") for i in range(400)] + [(8, 0, "user", "Equal.")] * 300 + [(9, None, "user", "No turn.")] * 40
    rows += [(c, t, rng.choice(roles), rng.choice(texts)) for c in range(20, 40) for t in range(4)]
    turns = conversation_repair.damage(spark.createDataFrame(rows, SCHEMA))
    one = sorted(map(tuple, conversation_repair.repair(turns, 1).collect()), key=str)
    many = sorted(map(tuple, conversation_repair.repair(turns, 29).collect()), key=str)
    assert one == many and len(one) == 23
    machine = conversation_repair.Machine()
    of = turns_after(rows)[7]
    kinds = [conversation_repair.kind_of(r, {"": 0, "blank": 1, "duplicate": 2, "truncated": 3}[f]) for (_, r, _), f in zip(of, faults_of(of), strict=True)]
    parents = []
    layer, total = machine.run(0, kinds, parents)
    cost, state, n = conversation_repair.ending(layer)
    mine = next(r for r in one if r[0] == 7)
    assert mine[6] == total + cost and mine[7] == "".join(conversation_repair.letters(parents, state)) + "I" * n


def test_macros_are_prefix_free_and_ordered():
    codes = conversation_repair.MACROS
    assert codes == sorted(codes) and not any(a != b and b.startswith(a) for a in codes for b in codes)


def test_no_conversations(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert conversation_repair.repair(conversation_repair.damage(empty)).count() == 0


def test_repair_of_the_table(spark, sf_dir):
    rows = [tuple(r) for r in queries.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op13_conversation_repair(spark, sf_dir).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(rows)


# byte-level encoding


@pytest.fixture(scope="module")
def tokens():
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return path, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


LETTERS = "ab etaoin  \n\n\t'sl'léüñ你好12٣.,!—​\x1c\x85\xa0🎉<|endoftext|>"


def test_edits_and_appends_are_exact_and_local(tokens):
    path, library = tokens
    bpe, rng = prefix_bpe.PrefixBPE.from_file(path), random.Random(5)
    some = lambda n: "".join(rng.choice(LETTERS) for _ in range(n))
    for _ in range(400):
        t = prefix_bpe.PrefixText(bpe, some(rng.randrange(80)))
        t = prefix_bpe.PrefixText(bpe, t.text, t.state())
        for _ in range(4):
            start = rng.randrange(len(t.text) + 1)
            t.edit(start, min(len(t.text), start + rng.randrange(5)), some(rng.randrange(6)))
            if rng.random() < 0.3:
                t.append(some(3))
            assert t.ids() == library.encode_ordinary(t.text)
    t = prefix_bpe.PrefixText(bpe, "".join(rng.choice("abcdefgh") for _ in range(60_000)))
    before = t.worked
    t.edit(30_000, 30_003, "zq")
    t.append("hello")
    assert t.worked - before < 10 * bpe.longest and t.ids() == library.encode_ordinary(t.text)


def test_every_prefix_has_its_own_encoding(tokens):
    path, library = tokens
    bpe = prefix_bpe.PrefixBPE.from_file(path)
    word = "unbelievablyantidisestablishmentarianism"
    last = bpe.table(word)
    for n in range(1, len(word) + 1):
        assert bpe.walk(last[: n + 1]) == library.encode_ordinary(word[:n])


def test_encoded_documents(spark, tokens):
    path, library = tokens
    rng = random.Random(6)
    texts = [None, "", " ", "a" * 50_000, "word " * 20_000, "same", "same", "<|endoftext|>x", *("".join(rng.choice(LETTERS) for _ in range(rng.randrange(200))) for _ in range(200))]
    docs = spark.createDataFrame([(i if i != 5 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(3)
    want = sorted(((i if i != 5 else None, (ids := library.encode_ordinary(t or "")), t or "") for i, t in enumerate(texts)), key=lambda x: str(x[0]))
    got = sorted(prefix_bpe.encode(docs, path).collect(), key=lambda r: str(r["doc_id"]))
    assert [(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist(), r["decoded"]) for r in got] == want
    digests = sorted(prefix_bpe.encode_digests(docs, path).collect(), key=lambda r: str(r["doc_id"]))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert [tuple(r) for r in digests] == [(i, len(ids), sha(",".join(map(str, ids)).encode()), sha(t.encode())) for i, ids, t in want]
    assert prefix_bpe.encode(docs.limit(0), path).count() == 0


def test_edited_documents(spark, tokens):
    path, library = tokens
    docs = spark.createDataFrame([(1, "The cat sat on the mat."), (2, None), (3, "left alone"), (None, "no id")], "doc_id long, text string")
    edits = spark.createDataFrame([(1, 2, 99, 99, " It purred."), (1, 1, 4, 7, "dog"), (2, 1, 0, 0, "new"), (None, 1, 0, 0, "x"), (8, 1, 0, 0, "x"), (1, 3, 0, 4, None)], "doc_id long, at int, start int, stop int, insert string")
    got = {r["doc_id"]: r for r in prefix_bpe.edit(prefix_bpe.encode(docs, path, prefixes=True), edits, path).collect()}
    assert {i: r["text"] for i, r in got.items()} == {1: "dog sat on the mat. It purred.", 2: "new", 3: "left alone", None: "no id"}
    for r in got.values():
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode_ordinary(r["text"]) and r["decoded"] == r["text"]
    assert got[3]["worked"] == got[None]["worked"] == 0 < got[1]["worked"] < 60


def test_encoding_of_the_table(spark, sf_dir, tokens):
    _, library = tokens
    want = {r["doc_id"]: library.encode_ordinary(r["text"] or "") for r in queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    for r in queries.op12_prefix_bpe(spark, sf_dir).collect():
        assert (r["n_tokens"], r["ids_sha256"]) == (len(want[r["doc_id"]]), hashlib.sha256(",".join(map(str, want[r["doc_id"]])).encode()).hexdigest())


# clustering


def lloyd(rows, k=40, rounds=5, dim=64):
    """The contract in Python integers."""
    kept = [(i, [math.floor(256 * c) if abs(c) < 1e15 else int(c) * 256 for c in v]) for i, v in rows if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda x: (hashlib.sha256(f"2:{'' if x[0] is None else x[0]}".encode()).hexdigest(), x[1]))
    centroids = [v for _, v in order[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min((far(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(centroids)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    fits = lambda xs: sum(xs) if all(x < 2**63 for x in xs) and sum(xs) < 2**63 else None
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    all_ = fits([d for _, _, d in found])
    return sorted(((i, j, d if d < 2**63 else None, fits([e for _, h, e in found if h == j]), all_, name[j]) for i, j, d in found), key=str)


def clustered(spark, rows, **how):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"v": F.lit(1), "Tree": F.lit("x"), "cluster": F.lit(0)}).repartition(3)
    return sorted((tuple(r) for r in ball_tree.cluster(frame, **how).collect()), key=str)


def odd_vectors(scale=1.0):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 6))
    rows = [(i, (scale * (base[i % 12] + rng.normal(scale=0.01 if i % 3 else 0.4, size=6))).tolist()) for i in range(300)]
    rows += [(900, rows[0][1]), (900, rows[1][1]), (901, rows[0][1]), (None, rows[2][1]), (902, [0.0] * 6)] + [(903 + i, rows[5][1]) for i in range(40)]
    return rows + [(950, None), (951, []), (952, [1.0] * 5), (953, [1.0] * 5 + [None]), (954, [math.nan] + [1.0] * 5), (955, [math.inf] + [1.0] * 5)]


@pytest.mark.parametrize("scale", [1.0, 1e4, 1e32])
def test_clusters_are_those_of_plain_rounds(spark, scale):
    rows = odd_vectors(scale)
    assert clustered(spark, rows, k=10, dim=6) == lloyd(rows, 10, dim=6)


def test_few_or_no_vectors(spark):
    rows = [(1, [0.5] * 6), (2, [-0.25] * 6), (3, None)]
    assert clustered(spark, rows, dim=6) == lloyd(rows, dim=6)
    assert clustered(spark, [(3, None)], dim=6) == []


def test_balls_go_whole_where_they_can():
    rng = np.random.default_rng(9)
    base = 5 * rng.normal(size=(20, 8))
    rows, at = np.floor(256 * (base[rng.integers(0, 20, 2000)] + 0.01 * rng.normal(size=(2000, 8)))), np.floor(256 * base)
    tree = ball_tree.Tree(rows)
    mine, whole = tree.assign(at)
    d = ((tree.rows[:, None] - at[None]) ** 2).sum(2)
    assert (mine == d.argmin(1)).all() and len(whole) < 400
    assert sum(tree.bounds[level][i + 1] - tree.bounds[level][i] for level, i, _ in whole) > 1000
    counts, sums = tree.totals(at)
    assert counts.sum() == 2000 and (sums == np.stack([rows[tree.order][mine == k].sum(0) for k in range(20)])).all()


def test_digits_come_back():
    for x in (0, -1, 5, 2**40, -(2**40), 3**90, -(3**90)):
        assert sum(d * ball_tree.BASE**i for i, d in enumerate(ball_tree.digits(x))) == x
