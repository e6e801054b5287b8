from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from lexloom.config import EngineConfig, deep_merge
from lexloom.functions import docs, errors, hashing, json_text, names, stats, types
from lexloom.operators import aggregates, joins, matching, parse, routing, rules, suggestions, windows
from lexloom.streaming import monitors


def one(spark, expr, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()), F.lit(0).alias("_")).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(("name", "want"), [("getHTTPResponseCode", ["get", "http", "response", "code"]), ("snake_case_name", ["snake", "case", "name"]), ("v2", ["v"]), ("_x_", ["x"]), ("", [])])
def test_tokens(spark, name, want):
    assert one(spark, names.tokens("n"), n=name) == want


def test_name_similarities(spark):
    assert one(spark, names.character_similarity("a", "b"), a="get_user", b="user") == 0.8
    assert one(spark, names.prefix_similarity("a", "b"), a="abcd", b="abxy") == 0.5
    assert one(spark, names.follows_pattern("a", "b"), a="get_user", b="fetch_user")
    assert one(spark, names.follows_pattern("a", "b"), a="userName", b="user_name")
    assert not one(spark, names.follows_pattern("a", "b"), a="get_user", b="get_order")
    assert one(spark, names.module_distance("a", "b"), a="src.utils.helpers", b="src.core.main") == 4
    assert one(spark, names.semantic_similarity("a", "b", F.lit(0.1)), a="get_user", b="fetch_user") == 1.0
    assert one(spark, names.module_of(F.col("a")), a="pkg/sub/__init__.py") == "pkg.sub"


@pytest.mark.parametrize(("a", "b", "want"), [("str", "string", True), ("Optional[int]", "int | None", True), ("List[int]", "list[int]", True), ("int", "str", False), ("", "", True), ("int", "", False), ("Union[str, None]", "Optional[str]", True)])
def test_type_equivalence(spark, a, b, want):
    assert one(spark, types.same("a", "b"), a=a, b=b) is want


def test_type_parts(spark):
    assert one(spark, types.base("a"), a="List[int]") == "int"
    assert one(spark, types.base("a"), a="dict[str, int]") == "str, int"
    assert one(spark, types.compatibility("a", "b"), a="int", b="float") == 0.5
    assert one(spark, types.for_style("a", "google"), a="Optional[List[int]]") == "list[int], optional"


def test_md5_bucket_is_the_whole_hash(spark):
    keys = [f"f{i}(x)" for i in range(200)]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select("k", hashing.md5_mod("k").alias("m")).collect()
    assert all(r["m"] == int(hashlib.md5(r["k"].encode()).hexdigest(), 16) % 100 for r in got)


def test_statistics(spark):
    low, high = one(spark, stats.wilson("h", "n"), h=2, n=5)
    assert (round(low, 4), round(high, 4)) == (0.1176, 0.7693)
    assert tuple(one(spark, stats.wilson("h", "n"), h=0, n=0)) == (0.0, 0.0)
    assert round(one(spark, stats.two_sided_p(F.col("z")), z=1.959963984540054), 6) == 0.05
    assert one(spark, aggregates.improvement(F.col("a"), F.col("b")), a=0.4, b=0.8) == pytest.approx(100.0)
    assert one(spark, aggregates.improvement(F.col("a"), F.col("b")), a=0.0, b=0.8) == 0.0


@pytest.mark.parametrize("reply", ['{"issues": [{"type": "type_mismatch", "description": "d", "suggestion": "s", "confidence": 0.9, "line_number": 2}]}', 'Sure:\n```json\n{"issues": [{"type": "type_mismatch", "description": "d", "suggestion": "s", "confidence": 0.9}]}\n```', 'I think {x} so {"issues": [{"type": "other", "description": "a } b", "suggestion": "s", "confidence": 0.9}]} ok'])
def test_json_in_replies(spark, reply):
    r = routing.answers(spark.createDataFrame([("f", reply)], "function_id string, reply string")).collect()
    assert len(r) == 1 and r[0]["confidence"] == 0.9


def test_bad_replies_are_recovered_or_dropped(spark):
    rows = [("a", "There is a mismatch here.\nFine."), ("b", '{"issues": [{"type": "x", "description": "d", "suggestion": "s", "confidence": 1.5}]}'), ("c", None)]
    r = routing.answers(spark.createDataFrame(rows, "function_id string, reply string")).collect()
    assert [(x["function_id"], x["confidence"]) for x in r] == [("a", 0.3)]


def test_a_failing_model_is_a_row(spark):
    def fails(prompts):
        raise RuntimeError("429 too many requests")

    q = spark.createDataFrame([("a", "p")], "function_id string, prompt string")
    r = routing.ask(q, fails).withColumn("e", errors.analyse("error")["kind"]).first()
    assert r["reply"] is None and r["e"] == "rate_limit"
    assert routing.ask(q).first()["error"] == "offline"


def test_config_layers():
    c = EngineConfig().layered({"min_confidence": 0.7}, None, {"severity_overrides": {"missing_raises": "low"}, "disabled_rules": ["parameter_count"]})
    assert c.min_confidence == 0.7 and c.disabled_rules == ("parameter_count",) and "parameter_count" not in rules.effective(c)
    assert deep_merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    with pytest.raises(ValueError):
        EngineConfig().layered({"nonsense": 1})


FILE = '''
def f(self, a: int, b: str = None, *rest, **more) -> int:
    """Do.

    Args:
        b (str): B.
        a (int): A.
    """
    raise KeyError(a)


def g(cls, x):
    """Do.

    Returns:
        int: It.
    """
'''


def issues(spark, source, config=EngineConfig()):
    files = spark.createDataFrame([("m.py", source)], "path string, content string")
    return {(r["function_id"].split(":")[-1], r["rule"], r["subject"], r["severity"]) for r in rules.check(matching.documented(parse.functions(files)), config).collect()}


def test_rules_on_one_file(spark):
    found = issues(spark, FILE)
    assert {r for f, r, *_ in found if f == "f"} == {"parameter_names", "parameter_count", "missing_params", "undocumented_kwargs", "parameter_order", "return_type", "missing_returns", "missing_raises", "optional_parameters"}
    assert ("f", "optional_parameters", "b", "high") in found and ("f", "missing_raises", "KeyError", "medium") in found
    assert ("g", "method_decorators", "cls", "critical") in found
    assert ("f", "missing_raises", "KeyError", "low") in issues(spark, FILE, EngineConfig(severity_overrides={"missing_raises": "low"}, enabled_rules=("missing_raises",)))


def test_no_findings_for_clean_code_and_none_without_documentation(spark):
    assert issues(spark, 'def f(a: int) -> int:\n    """Do.\n\n    Args:\n        a (int): A.\n\n    Returns:\n        int: It.\n    """\n    return a\n') == set()
    assert issues(spark, "def f(a):\n    pass\n") == set()


def test_contextual_matching(spark):
    rows = [("a/x.py", 'from b.y import helper\n\n\ndef helper(q):\n    return q\n\n\ndef lone():\n    pass\n'), ("b/y.py", 'def helper(q):\n    """Help at length, indeed.\n\n    Args:\n        q: Q.\n    """\n'), ("c/z.py", 'def lone():\n    """Stand alone, at some length."""\n'), ("d/w.py", '"""Module.\n\nodd: It is odd.\n"""\n\n\ndef odd():\n    pass\n')]
    files = spark.createDataFrame(rows, "path string, content string")
    fs = matching.documented(parse.functions(files))
    out = matching.contextual(fs, matching.direct(fs), parse.imports(files), matching.module_docs(parse.modules(files))).collect()
    assert {(r["function_id"].split(":")[0], r["doc_function_id"].split(":")[0], r["stage"]) for r in out} == {("a/x.py", "b/y.py", 1), ("a/x.py", "c/z.py", 2), ("d/w.py", "d.w", 3)}


def test_signature_and_suggestion(spark):
    files = spark.createDataFrame([("m.py", FILE)], "path string, content string")
    fs = matching.documented(parse.functions(files))
    assert fs.where("name = 'f'").select(matching.signature_text()).first()[0] == "def f(self, a: int, b: str = None, *rest, **more) -> int"
    s = suggestions.suggest(fs.where("name = 'f'")).first()
    assert "Raises:\n    KeyError" in s["suggested_text"] and "+Raises:" in s["diff"]


def test_indel_ratio(spark):
    r = spark.createDataFrame([("kitten", "sitting"), ("", ""), ("a", "")], "a string, b string").select(suggestions.indel_ratio("a", "b").alias("r")).collect()
    assert [round(x["r"], 4) for x in r] == [0.6154, 1.0, 0.0]


def test_near_pairs_equals_brute_force(spark):
    a = spark.range(60).selectExpr("id % 3 as k", "(id * 7) % 40 as p")
    got = joins.near_pairs(a, a, ["k"], "p", 2).count()
    rows = [(r["k"], r["p"]) for r in a.collect()]
    assert got == sum(k == m and abs(p - q) <= 2 for k, p in rows for m, q in rows)


def test_knn_of_zero_and_null_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [2.0, 0.0]), (4, None)], "id long, vec array<double>")
    q = v.where("id = 1").selectExpr("id as q_id", "vec as q_vec")
    assert [(r["id"], r["similarity"]) for r in joins.knn(q, v, 5).collect()] == [(3, 1.0)]


def test_keep_most_used(spark):
    x = spark.range(10).selectExpr("1 as k", "id as uses", "id as at", "id as e")
    assert windows.keep_most_used(x, ["k"], "uses", "at", 5, 3).count() == 3
    assert windows.keep_most_used(x, ["k"], "uses", "at", 10, 3).count() == 10


def test_monitors():
    c = monitors.Cooldown(10, 300)
    assert [c.step(t, v) for t, v in ((0, 11), (100, 12), (299, 20), (300, 9), (301, 11), (700, 50))] == [True, False, False, False, True, True]
    b = monitors.Bucket(1.0, 2)
    assert [b.step(t) for t in (0, 0, 0, 0.5, 1.5, 10)] == [True, True, False, False, True, True]
    k = monitors.Breaker(2, 60)
    assert [k.step(t, ok) for t, ok in ((0, False), (1, False), (2, True), (61.5, True), (62, False), (63, True))] == [True, True, False, True, True, True]
    life = monitors.Lifecycle()
    assert [life.step(0, e) for e in ("displayed", "accepted", "displayed")] == [True, True, False] and life.stage == "accepted"


def test_stream_equals_batch(spark, tmp_path):
    import datetime

    rows = [(i % 3, i, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=40 * i), float(i * 37 % 100)) for i in range(120)]
    df = spark.createDataFrame(rows, "user long, event_id long, ts timestamp, x double")
    for i in range(3):
        df.where(f"event_id % 120 >= {40 * i} and event_id % 120 < {40 * i + 40}").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/b{i}"))
    make = lambda: monitors.Cooldown(50.0, 300.0)
    want = {r["event_id"]: r["passed"] for r in monitors.fold(df.withColumn("t", F.col("ts").cast("double")), "user", make, float).collect()}
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = monitors.fold_stream(s, "user", make, float, "1 day").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["event_id"]: r["passed"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == want


def test_documentation_scores(spark):
    assert one(spark, docs.completeness("t"), t="") == 0.0
    assert one(spark, docs.completeness("t"), t="Args: x\nReturns: y\nRaises: z\n>>> a" + " " * 100) == pytest.approx(1.0)
    assert one(spark, docs.actionable("t"), t="Please fix this") is False
    assert one(spark, docs.actionable("t"), t="Add a Returns section") is True
    assert one(spark, docs.format_of("t"), t="X\n\nParameters\n----------\na : int") == "numpy"
    assert one(spark, json_text.issue_type("t"), t="missing_exception") == "missing_raises"


def test_relevance(spark):
    from lexloom.functions import relevance as r

    assert one(spark, r.parameter_similarity("a", "b"), a="msg", b="message_text") == 0.8
    assert one(spark, r.parameter_similarity("a", "b"), a="user_name", b="name_list") == 0.5
    assert one(spark, r.exceptions_match("a", "b"), a="ValueError", b="ValidationError")
    assert one(spark, r.resolved_import("s", "n", "m"), s="x", n=2, m="a.b.c") == "a.x"
    assert one(spark, r.resolved_import("s", "n", "m"), s="x", n=4, m="a.b.c") is None
    e = one(spark, r.example_profile("t"), t="import os\nx = f(1)\n# note\nassert x\nprint(await g())")
    assert (e["setup"], e["calls"], e["assertions"], e["features"], e["complexity"]) == (1, 1, 2, ["async"], "intermediate")


def test_signature_text_reads_back():
    from lexloom.operators.retrieval import parse_signature

    got = parse_signature("async def f(a, b: dict[str, int] = {}, *c: int, d=(1, 2)) -> list[int]")
    assert got["name"] == "f" and got["return_type"] == "list[int]"
    assert [(p["name"], p["type"], p["default"]) for p in got["parameters"]] == [("a", None, None), ("b", "dict[str, int]", "{}"), ("*c", "int", None), ("d", None, "(1, 2)")]
    assert parse_signature("f(a)")["name"] is None and parse_signature(None)["parameters"] is None


def test_token_set_ratio():
    from lexloom.operators.suggestions import _token_set_ratio as f

    assert f("a b", "b a c") == 1.0 and f("", "a") == 0.0 and round(f("get_user", "get_order"), 3) == round(2 * 6 / 17, 3)


def test_retrieval_against_brute_force(spark):
    from lexloom.operators import retrieval

    q = spark.createDataFrame([(1, "get_user", "def get_user(uid: int) -> str", "a/b.py")], "query_id long, name string, signature string, file_path string")
    c = spark.createDataFrame([(1, "fetch_user", "def fetch_user(uid: int) -> str", "a.b", 3, 5, "accepted", 0.0), (2, "zzz", "", "x.y", 1, 1, "curated", 0.0)], "example_id long, function_name string, function_signature string, module_path string, complexity_score int, quality_score int, source string, timestamp double")
    r = retrieval.retrieve(q, c, F.lit(0.0), least=0.0).collect()
    assert r[0]["example_id"] == 1 and r[0]["similarity"] == 1.0
    assert r[1]["example_id"] == 2 and r[1]["similarity"] < 0.2
