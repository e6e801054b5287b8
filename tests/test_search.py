"""Exact searches and selections against plain versions: examples, vectors, word sets, percentiles."""

from __future__ import annotations

import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexloom.operators import generators, index, joins, nearest, patterns, retrieval, selection


def corpus_and_queries(spark, n, seed):
    rng = random.Random(seed)
    verbs, nouns = ["get", "fetch", "load", "parse", "build", "is", "compute"], ["user", "order", "page", "file", "index", "rate"]
    types = ["int", "str", "Optional[int]", "List[str]", None]

    def signature():
        params = [rng.choice(["size", "name", "path", "limit", "url"]) for _ in range(rng.randrange(4))]
        params = [f"{p}: {t}" if (t := rng.choice(types)) else p for p in dict.fromkeys(params)]
        return f"({', '.join(params)})" + rng.choice(["", " -> int", " -> str", " -> None"])

    def name():
        return f"{rng.choice(verbs)}_{rng.choice(nouns)}" + rng.choice(["", "", "_by_id", str(rng.randrange(9))])

    examples = [(i, m := name(), f"def {m}{signature()}" if i % 17 else None if i % 2 else "broken(", f"{rng.choice(['shop', 'lib'])}.m{i % 5}", rng.randrange(1, 6) if i % 13 else None, rng.randrange(1, 6), rng.choice(["accepted", "curated"]), 1.7e9 - 86400.0 * rng.randrange(60)) for i in range(n)]
    queries = [(f"q{i}", m := name() if i % 19 else "two words", f"def {m.replace(' ', '_')}{signature()}" if i % 23 else None, f"{rng.choice(['shop', 'lib'])}/m{i % 7}.py") for i in range(n // 2)]
    e = spark.createDataFrame(examples, "example_id long, function_name string, function_signature string, module_path string, complexity_score int, quality_score int, source string, timestamp double")
    return spark.createDataFrame(queries, "query_id string, name string, signature string, file_path string"), e


@pytest.mark.parametrize("k, least, part", [(3, 0.3, 50_000), (1, 0.3, 60), (5, 0.75, 50_000)])
def test_retrieval_by_bounds_is_retrieval_by_all(spark, k, least, part):
    q, c = corpus_and_queries(spark, 240, k)
    rows = lambda df: sorted((r["query_id"], r["rank"], r["example_id"], round(r["similarity"], 9)) for r in df.collect())
    found = rows(retrieval.retrieve(q, c, F.lit(1.7e9), k, least, part))
    assert found == rows(retrieval.retrieve_by_all(q, c, F.lit(1.7e9), k, least)) and found
    assert retrieval.retrieve(q, c.limit(0), F.lit(1.7e9), k, least).count() == 0 == retrieval.retrieve(q.limit(0), c, F.lit(1.7e9), k, least).count()


def test_names_of_one_verb_are_met_by_class(spark, monkeypatch):
    """Words of the tables' kind: all names begin with one verb, few words repeat, a number tells them apart."""
    words, rng = ["hot_bolt", "hot_ring", "old_ring", "old_plate", ""], random.Random(4)
    name = lambda i: f"get_{words[i % 5]}{'_' if i % 5 < 4 else ''}{i if i % 7 else 'x'}"
    module = lambda i: rng.choice([f"shop.b{i % 3}.part_{i}", f"shop.b{i % 3}", "shop", "lib", ""])
    examples = [(i, name(i), f"def {name(i)}(size: int, label: str = 'x') -> int", module(i), 3, 4 + i % 2, rng.choice(["accepted", "curated"]), 1.7e9 - 86400.0 * (500 - i // 4)) for i in range(400)]
    queries = [(i, name(i), f"def {name(i)}(size: {'int' if i % 3 else 'float'}, label: str) -> int", None if i % 11 == 0 else f"shop/b{i % 3}/part_{i}.py") for i in range(0, 800, 8)]
    c = spark.createDataFrame(examples, "example_id long, function_name string, function_signature string, module_path string, complexity_score int, quality_score int, source string, timestamp double")
    q = spark.createDataFrame(queries, "query_id long, name string, signature string, file_path string")
    rows = lambda df: sorted((r["query_id"], r["rank"], r["example_id"], round(r["similarity"], 9)) for r in df.collect())
    want = rows(retrieval.retrieve_by_all(q, c, F.lit(1.7e9), 3, 0.3))
    seen, scored = [], retrieval._scored
    monkeypatch.setattr(retrieval, "_scored", lambda pairs, as_of: seen.append(pairs.count()) or scored(pairs, as_of))
    assert rows(retrieval.retrieve(q, c, F.lit(1.7e9), 3, 0.3, part=150, block=30)) == want and len(want) == 300
    assert max(seen) < 0.1 * len(queries) * len(examples)


def test_bounds_are_never_below_scores_and_leave_most_out(spark):
    q, c = corpus_and_queries(spark, 400, 9)
    asked = retrieval._query_side(q).select("query_id", *index.query_columns()).toPandas()
    examples = retrieval._corpus_side(c).select("example_id", *index.example_columns(F.lit(1.7e9))).toPandas()
    cells = index.Cells(examples)
    score = {}
    for r in retrieval.retrieve_by_all(q, c, F.lit(1.7e9), 400, 0.0).collect():
        score.setdefault(r["query_id"], {})[r["example_id"]] = r["similarity"]
    opened = 0
    for x in asked.itertuples(index=False):
        third = sorted(score[x.query_id].values())[-3]
        hit = set(cells.ids[cells.search(x, 0, min(third, 1.0))])
        assert {e for e, s in score[x.query_id].items() if s >= third} <= hit
        opened += len(hit)
    assert opened < 0.25 * len(asked) * len(examples)


def test_neighbours_by_cells_are_all_neighbours(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 8))
    rows = [(i, (base[i % 30] + rng.normal(scale=0.05 if i % 4 else 0.6, size=8)).tolist()) for i in range(300)]
    rows += [(700, rows[3][1]), (701, rows[3][1]), (702, [2 * x for x in rows[3][1]]), (703, None), (704, [0.0] * 8), (705, [1.0] * 7), (706, [float("nan")] * 8), (707, []), (708, [2.0, 1.0])]
    c = spark.createDataFrame(rows, "id long, vec array<double>")
    q = c.select(F.col("id").alias("q_id"), F.col("vec").alias("q_vec"))
    good = [(i, np.array(v)) for i, v in rows if v and len(v) == 8 and np.isfinite(v).all() and any(v)]
    u = np.stack([v / np.linalg.norm(v) for _, v in good])
    s, ids = np.round(u @ u.T, 12), [i for i, _ in good]
    for how in ({"k": 5}, {"k": 40, "cells": 20, "block": 30}, {"k": 5, "least": 0.95, "cells": 10}):
        want = {i: [j for _, j in sorted((-s[x, y], j) for y, j in enumerate(ids) if j != i and s[x, y] >= how.get("least", -2))[: how["k"]]] for x, i in enumerate(ids)}
        got = {i: [] for i in ids}
        for r in sorted(nearest.knn_join(q, c, **how).collect(), key=lambda r: r["rank"]):
            got[r["q_id"]].append(r["id"])
        assert got == want
    assert nearest.knn_join(q, c.limit(0), 3).count() == 0


@pytest.mark.parametrize("above", [0.3, 0.6, 0.8])
def test_word_pairs(spark, above):
    rng = random.Random(7)
    words = [f"w{int(rng.paretovariate(0.7)) % 40}" for _ in range(2000)]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(0, 9)))
    sides = [[(i, i % 3, text() if i else None) for i in range(80)] for _ in range(2)]
    a, b = (spark.createDataFrame(s, "id long, function_id long, description string") for s in sides)
    got = {(r["a_id"], r["b_id"]): round(r["overlap"], 9) for r in joins.word_pairs(a, b, ["function_id"], "description", above).collect()}
    want = {}
    for i, f, s in sides[0]:
        for j, g, t in sides[1]:
            x, y = set((s or "").split()), set((t or "").split())
            if f == g and x and y and len(x & y) / max(len(x), len(y)) > above:
                want[i, j] = round(len(x & y) / max(len(x), len(y)), 9)
    assert got == want and got


def test_findings_pair_by_line_or_words(spark):
    schema = "id long, function_id string, issue_type string, line_number int, description string"
    a = spark.createDataFrame([(1, "f", "t", 10, "the size is not documented"), (2, "f", "t", 90, "x"), (3, "g", "t", 10, "same words here")], schema)
    b = spark.createDataFrame([(7, "f", "t", 12, "other"), (8, "f", "u", 70, "size is not documented"), (9, "h", "t", 10, "same words here")], schema)
    assert {tuple(r) for r in joins.merged_pairs(a, b).collect()} == {(1, 7), (1, 8)}


def groups(spark, n=4000):
    rng = random.Random(11)
    rows = [("hot", rng.gauss(0, 1)) for _ in range(n)] + [("same", 5.0)] * n + [("two", float(i % 2)) for i in range(n)] + [("one", 3.0), ("none", None), (None, 1.0), (None, 2.0), ("far", 1e300), ("far", -1e300), ("far", 0.0)]
    rows += [("mixed", 7.0)] * n + [("mixed", rng.random() * 100) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "k string, v double").repartition(5)


@pytest.mark.parametrize("few, bins, plain", [(100_000, 64, 0), (50, 4, 0), (1, 16, 0), (1, 4, 10**9)])
def test_percentiles_without_sorting_a_group(spark, few, bins, plain):
    rows, df = groups(spark, 700)
    shares = (0.0, 0.5, 0.95, 0.99, 1.0)
    got = {r["k"]: r["p"] for r in selection.percentiles(df, ["k"], "v", shares, few, bins, plain).collect()}
    assert got["none"] is None and set(got) == {k for k, _ in rows}
    for k in set(got) - {"none"}:
        assert np.allclose(got[k], np.percentile([v for g, v in rows if g == k], [100 * s for s in shares]), rtol=1e-12), k
    whole = selection.percentiles(df.where("k <> 'far'"), [], "v", shares, few, bins, plain).collect()
    assert np.allclose(whole[0]["p"], np.percentile([v for k, v in rows if v is not None and k not in (None, "far")], [100 * s for s in shares]))


@pytest.mark.parametrize("parts, plain", [(1, 0), (9, 0), (1, 10**9)])
def test_rolling_percentile(spark, parts, plain):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.randrange(300), rng.choice([None, round(rng.random(), 2)]) if rng.random() < 0.2 else rng.random()) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, k string, t int, v double")
    got = {r["id"]: r["p"] for r in selection.rolling(df, ["k"], ["t", "id"], "v", "id", 0.9, 40, 3, parts, plain).collect()}
    assert len(got) == 500
    for key in ("a", "b", None):
        mine = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0]))
        for i, r in enumerate(mine):
            last = mine[max(0, i - 39) : i + 1]
            known = [x[3] for x in last if x[3] is not None]
            want = np.percentile(known, 90) if len(last) >= 3 and known else None
            assert got[r[0]] is None if want is None else abs(got[r[0]] - want) < 1e-9


DOC = 'Load it.\n\nA loaded page is kept. It has words.\n\nArgs:\n    limit (int): The most rows to read. Must be positive.\n    path (str): Where the file lies.\n\nReturns:\n    int: How many rows there were.\n\nRaises:\n    ValueError: If limit is negative.\n\nExample:\n    >>> load_page(3, "x")'


def test_hints_of_examples(spark):
    kinds = "function_id string, name string, file_path string, is_async boolean, return_type string, parameters array<struct<pos:int, name:string, type_annotation:string, default_value:string, is_required:boolean>>, exceptions array<struct<exception_type:string, description:string, line:int, is_re_raised:boolean, confidence:double>>"
    f = spark.createDataFrame([("f", "load_page_rows", "shop/a.py", False, "int", [(0, "limit", "int", None, True), (1, "file_path", "str", None, True)], [("ValueError", "d", 1, False, 0.95), ("KeyError", "d", 1, False, 0.4)]), ("lone", "zzz", "other/b.py", False, None, [], [])], kinds)
    corpus = [("e1", "load_page", "shop.a", DOC), ("e2", "load_pages", "shop.b", DOC.replace("How many rows", "What number of rows").replace("If limit is negative", "When the limit is too large")), ("self", "load_page_rows", "shop.a", "Me.\n\nArgs:\n    limit (int): Myself.")]
    corpus = spark.createDataFrame([(i, n, f"def {n}(limit: int, path: str) -> int", m, 3, 5, "curated", 0.0, d) for i, n, m, d in corpus], "example_id string, function_name string, function_signature string, module_path string, complexity_score int, quality_score int, source string, timestamp double, docstring_content string")
    hits = patterns.examples_for(f, corpus, F.lit(0.0))
    assert {(r["function_id"], r["example_id"]) for r in hits.collect() if r["function_id"] == "f"} == {("f", "e1"), ("f", "e2")}
    got = {r["function_id"]: r for r in patterns.hints(f, hits.where("function_id = 'f'")).collect()}
    said = {(h["slot"], h["subject"], h["rank"]): h["text"] for h in got["f"]["hints"]}
    assert got["f"]["examples_used"] == 2 and set(got) == {"f"}
    assert said["parameter", "limit", 1].startswith("The most rows to read. Must be positive.") and said["parameter", "file_path", 1].startswith("Where the file lies.")
    assert said["raises", "ValueError", 1] == "If limit is negative or the limit is too large." and said["returns", "", 1] == "How many rows there were."
    assert said["behaviour", "", 1] == "A loaded page is kept." and said["example", "", 1] == '>>> load_page_rows(3, "x")'


def test_what_examples_say_meets_by_function_alone(spark):
    f = spark.createDataFrame([(f"f{i}", f"load_page_{i}", "int", [(0, "limit", "int", None, True)], [("ValueError", "d", 1, False, 0.95)]) for i in range(40)], "function_id string, name string, return_type string, parameters array<struct<pos:int, name:string, type_annotation:string, default_value:string, is_required:boolean>>, exceptions array<struct<exception_type:string, description:string, line:int, is_re_raised:boolean, confidence:double>>")
    told = spark.createDataFrame([(f"f{i}", f"e{i}", 0.5, [("limit", "int", "The most rows.")], [("ValueError", "If limit is negative.")]) for i in range(40)], "function_id string, example_id string, similarity double, p array<struct<name:string, type_str:string, description:string>>, r array<struct<exception_type:string, description:string>>")
    hits = told.select("function_id", "example_id", "similarity", F.struct(F.col("p").alias("parameters"), F.col("r").alias("raises")).alias("doc"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for found in (patterns.for_parameters(f, hits), patterns.for_exceptions(f, hits)):
            assert found.count() == 40
            assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_scores_read_one_query_of_a_class(spark, monkeypatch):
    q = spark.createDataFrame([(i, f"get_red_bolt_{i}", "def f(size: int) -> int", f"shop/a/part_{i}.py") for i in range(300)], "query_id long, name string, signature string, file_path string")
    c = spark.createDataFrame([(i, f"get_red_bolt_{1000 + i}", "def f(size: int) -> int", f"shop.b.part_{i}", 3, 5, "curated", 0.0) for i in range(200)], "example_id long, function_name string, function_signature string, module_path string, complexity_score int, quality_score int, source string, timestamp double")
    stored, store = {}, retrieval.shared.store
    monkeypatch.setattr(retrieval.shared, "store", lambda df, label, *more: stored.setdefault(label, store(df, label, *more)))
    sizes, scored = {}, retrieval._scored
    monkeypatch.setattr(retrieval, "_scored", lambda pairs, as_of: sizes.update({k: stored[k].count() for k in ("queries-scored", "examples-scored")}) or scored(pairs, as_of))
    got = sorted(map(tuple, retrieval.retrieve(q, c, F.lit(0.0), 3).select("query_id", "example_id").collect()))
    assert sizes == {"queries-scored": 1, "examples-scored": 3} and got == [(i, e) for i in range(300) for e in range(3)]


def case(issue, source="", decorators=(), name="f", doc=None, params=(), exceptions=(), hints=None):
    base = generators.EMPTY | {"summary": "Do it.", "description": "At length.", "parameters": [{"name": "x", "type_str": "int", "description": "The number.", "is_optional": False, "default_value": None}], "raises": [{"exception_type": "KeyError", "description": "If lost."}], "examples": [">>> f(1)"]}
    return generators.Case(issue, None, name, list(params), None, list(exceptions), list(decorators), False, base | (doc or {}), source, hints or {})


@pytest.mark.parametrize("decorator, kind", [("property", "property"), ("x.setter", "property"), ("classmethod", "classmethod"), ("staticmethod", "staticmethod"), ("contextlib.contextmanager", "contextmanager"), ("typing.overload", "overload")])
def test_special_constructs_lose_nothing(decorator, kind):
    for issue in generators.GENERATORS:
        c = case(issue, "def f(self, x):\n    if x < 0:\n        raise ValueError(x)\n", [decorator], params=[{"pos": 0, "name": "x", "type_annotation": "int", "default_value": None, "is_required": True}], exceptions=[{"exception_type": "ValueError", "description": "d", "confidence": 0.95}])
        text, found, _, ready, error = generators.made(c, generators.GENERATORS, "google", 88)
        assert error is None
        if ready:
            assert all(x in text for x in ("Do it.", "At length.", "x (int): The number.", "KeyError: If lost.")), (issue, text)
        if issue == "missing_raises":
            assert "ValueError" in text
        if issue == "description_outdated":
            assert found == kind and generators.CONSTRUCTS[kind] in text


def test_magic_methods_keep_a_summary():
    kept = generators.made(case("missing_raises", name="__getitem__", exceptions=[{"exception_type": "IndexError", "description": "d", "confidence": 0.95}]), generators.GENERATORS, "google", 88)
    assert kept[1] == "magic" and "Do it." in kept[0] and "IndexError" in kept[0] and "KeyError: If lost." in kept[0]
    assert "How many items there are." in generators.made(case("missing_returns", name="__len__", doc={"summary": ""}), generators.GENERATORS, "google", 88)[0]


def test_conditions_of_raises_in_words():
    source = "def f(x, y):\n    if x < 0 and not y:\n        raise ValueError(x)\n    if x not in y:\n        for z in y:\n            raise KeyError(z)\n    else:\n        raise OSError\n    raise TypeError\n"
    assert generators.raise_conditions(source) == {"ValueError": "x is below 0 and y is empty or false", "KeyError": "x is not in y"}


def test_hints_go_into_texts():
    p = [{"pos": 0, "name": "x", "type_annotation": "int", "default_value": None, "is_required": True}, {"pos": 1, "name": "y", "type_annotation": None, "default_value": None, "is_required": True}]
    c = case("missing_params", params=p, hints={("parameter", "y"): ["From an example."]})
    text = generators.made(c, generators.GENERATORS, "google", 88)[0]
    assert "y: From an example." in text and "x (int): The number." in text and c.used == {"parameter"}


@pytest.mark.parametrize("how", [{}, {"half": True}, {"block": 7, "part": 20}])
def test_closest_holds_the_best_and_few_others(spark, how):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 6))
    rows = [(i, base[i % 40].tolist() if i % 3 else rng.normal(size=6).tolist()) for i in range(300)] + [(300, None), (301, [0.0] * 6), (302, [1.0, 2.0]), (303, [1.0, None] * 3)]
    c = spark.createDataFrame(rows, "id long, vec array<double>")
    q = c.where("id % 10 = 0").select(F.col("id").alias("q_id"), F.col("vec").alias("q_vec"))
    # Far ids lose; from 0.9 on all tie, and the smallest ids come first.
    lower = lambda s, a, b: s - np.where(abs(a - b) > 90, 0.2, 0.0)
    value = F.least(F.lit(0.9), F.col("similarity") - F.when(F.abs(F.col("q_id") - F.col("id")) > 90, 0.2).otherwise(0.0))
    found = joins.closest(q, c, 3, score=lower, cap=0.9, **how)
    got = sorted(map(tuple, joins.top_per_key(found.select("q_id", "id", value.alias("v")), ["q_id"], [F.desc("v"), F.col("id")], 3).collect()))
    good = [(i, np.array(v)) for i, v in rows if i < 300]
    want = []
    for i, a in good[::10]:
        s = [(float(a @ b) / np.sqrt(a @ a) / np.sqrt(b @ b), j) for j, b in good if j != i]
        s = [(min(0.9, ((1 + x) / 2 if how.get("half") else x) - 0.2 * (abs(i - j) > 90)), j) for x, j in s]
        want += [(i, j, x) for x, j in sorted(s, key=lambda p: (-round(p[0], 12), p[1]))[:3]]
    assert [(a, b, round(v, 9)) for a, b, v in got] == [(a, b, round(v, 9)) for a, b, v in sorted(want)]
    assert found.count() < 0.2 * 30 * 300 or "part" in how


def test_knn_sends_no_rows_for_all_pairs(spark):
    v = spark.createDataFrame([(i, [float(i % 7), float(i % 3), 1.0]) for i in range(600)], "id long, vec array<double>")
    found = joins.closest(v.where("id % 10 = 0").select(F.col("id").alias("q_id"), F.col("vec").alias("q_vec")), joins.top_per_key(v, ["vec"], [F.col("id")], 4), 3)
    assert found.count() < 60 * 600 / 20


def test_classes_hold_the_best_rows(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("ab") if i % 9 else None, rng.randrange(3)) for i in range(400)]
    p = spark.createDataFrame(rows, "id long, x string, y int")
    q = p.where("id % 10 = 0").select(*(F.col(c).alias(f"q_{c}") for c in p.columns))
    score = F.col("q_x").eqNullSafe(F.col("x")).cast("double") + F.abs(F.col("q_y") - F.col("y")) * 0.5
    got = joins.best_of_classes(q, p, ["x", "y"], score, 3)
    want = [(i, j, (x == a) + abs(y - b) * 0.5) for i, x, y in rows[::10] for j, a, b in rows if i != j]
    want = {i: [(j, s) for _, j, s in sorted((w for w in want if w[0] == i), key=lambda w: (-w[2], w[1]))[:3]] for i, *_ in rows[::10]}
    found = {i: [] for i in want}
    for r in sorted(got.collect(), key=lambda r: (-r["similarity"], r["id"])):
        found[r["q_id"]].append((r["id"], r["similarity"]))
    assert found == want
    # Classes met, not 40 x 400 rows.
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [x" in text


def test_copies_send_k_rows_of_a_block(spark):
    u = np.tile(np.array([[0.6, 0.8]]), (500, 1))
    g = pd.DataFrame({"key": range(5), "u": [u[0].tobytes()] * 5})
    found = nearest._best(g, u, np.arange(500), 3, None)
    assert found["id"].notna().sum() == 15 and set(found["id"].dropna()) <= set(range(4))


def test_namesakes_are_counted_once_for_rows_alike(spark):
    rows = spark.range(3000).selectExpr("id", "cast(id % 3 as string) as name", "cast(id % 2 as string) as place")
    found = joins.unique_elsewhere(rows, rows.select("name", "place").distinct(), "name", F.col("r.place") != F.col("c.place"))
    got = found.collect()
    assert len(got) == 3000 and all(int(r["place"]) == 1 - r["id"] % 2 for r in got)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") >= 3


def test_pairs_of_a_frequent_key_are_dealt_out(spark):
    a = spark.range(400).selectExpr("id as a_id", "if(id < 390, 0, id) as key")
    b = spark.range(400).selectExpr("id as b_id", "if(id < 390, 0, id) as key")
    got = joins.dealt_join(a, b, ["key"], pairs=5000)
    assert got.select("a_id", "b_id").distinct().count() == got.count() == 390 * 390 + 10
    held = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(held) > 1 and max(held) < 0.7 * 390 * 390


def test_merged_findings_are_judged_once_and_not_shuffled(spark):
    """Pieces of functions, null keys, ids that occur twice: the pairs of all rows, and no exchange of pairs."""
    rng = random.Random(3)
    text = lambda: " ".join(f"w{int(rng.paretovariate(0.8)) % 30}" for _ in range(rng.randrange(0, 9)))
    schema = "id long, function_id string, issue_type string, line_number int, description string"
    one = lambda i: (i // 2 if i < 20 else i, rng.choice(["f", "f", "f", "g", None]), rng.choice(["t", "u", None]), rng.choice([*range(30), None]), rng.choice([text(), text(), None]))
    sides = [[one(i) for i in range(150)] for _ in range(2)]
    want = []
    for i, f, s, x, p in sides[0]:
        for j, g, t, y, q in sides[1]:
            v, w = set((p or "").split()), set((q or "").split())
            if f == g and (s == t and None not in (x, y) and abs(x - y) <= 1 or f and v and w and len(v & w) / max(len(v), len(w)) > 0.3):
                want.append((i, j))
    a, b = (spark.createDataFrame(s, schema) for s in sides)
    for block in (7, 8192):
        got = joins.merged_pairs(a, b, reach=1, above=0.3, block=block)
        assert sorted(map(tuple, got.collect())) == sorted(want)
        assert "hashpartitioning(a_id" not in got._jdf.queryExecution().executedPlan().toString()


def test_vectors_are_dealt_out_once_in_a_search_of_all(spark):
    """Near orthogonal vectors visit nearly all cells; names, other vectors as queries and many copies too."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[:300] = x[0]
    c = spark.createDataFrame([(f"n{i % 7}-{i}", v.tolist()) for i, v in enumerate(x)], "id string, vec array<float>")
    ask = spark.createDataFrame([(f"n{i % 7}-{i}", v.tolist()) for i, v in enumerate(x) if i % 3 == 0] + [("new", [1.0] * 16)], "q_id string, q_vec array<float>")
    names, u = [f"n{i % 7}-{i}" for i in range(900)], x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    for q, vectors in ((c.select(F.col("id").alias("q_id"), F.col("vec").alias("q_vec")), dict(zip(names, u))), (ask, dict(zip(names[::3], u[::3])) | {"new": np.full(16, 0.25)})):
        got = nearest.knn_join(q, c, 4, block=100)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and not re.search(r"Exchange [^\n]*(cell|block)", plan)
        for r in (rows := got.collect())[::10]:
            s = np.round(u @ vectors[r["q_id"]], 12)
            assert r["id"] == sorted((-v, n) for v, n in zip(s, names) if n != r["q_id"])[r["rank"] - 1][1]
        assert len(rows) == 4 * len(vectors)
