"""What the queries can't show: stores on disk, streams, retries, plans, failing parts."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from lexloom import config
from lexloom.operators import docstrings, embedding, engine, generators, matching, parse, routing, rules
from lexloom.sources import gallery, stores
from lexloom.streaming import tracking


@pytest.fixture(scope="module")
def files(spark):
    return gallery.source_files(spark.range(10, 20).select(F.col("id").alias("p_partkey")))


def test_keyed_table(spark, tmp_path):
    t = stores.KeyedTable(spark, str(tmp_path / "t"), "cache_key string, v int, hit_count long, accessed_at double", ["cache_key"])
    assert t.read().count() == 0
    rows = lambda *x: spark.createDataFrame([(k, v, 0, 1.0) for k, v in x], t.schema)
    t.put(rows(("a", 1), ("b", 2)))
    t.put(rows(("b", 3), ("c", 4)))
    assert {r["cache_key"]: r["v"] for r in t.read().collect()} == {"a": 1, "b": 3, "c": 4}
    t.touch(spark.createDataFrame([("a", 9.0), ("a", 8.0)], "cache_key string, t double"))
    assert t.get(cache_key="a")[0].asDict() == {"cache_key": "a", "v": 1, "hit_count": 2, "accessed_at": 9.0} and t.get(cache_key="z") == []
    t.delete(rows(("c", 0)))
    t.expire("accessed_at", F.lit(86400.0 + 5), 1)
    assert [r["cache_key"] for r in t.read().collect()] == ["a"] and len(list((tmp_path / "t").iterdir())) == 2


def test_newest_good_version(spark, tmp_path):
    rows = spark.createDataFrame([("f", "m", 3)], "function_name string, module_path string, quality_score int")
    for v in (1, 2):
        stores.write_corpus(rows, f"file://{tmp_path}/c", v)
    bad = next((tmp_path / "c/v00000002").glob("part-*"))
    bad.write_text("{not json")
    for crc in (tmp_path / "c/v00000002").glob(".*.crc"):
        crc.unlink()
    assert stores.newest_good(spark, f"file://{tmp_path}/c").select("function_name", "quality_score").collect() == [("f", 3)]


def test_sessions_and_counters(spark, tmp_path):
    now = 1.7e9
    m = spark.createDataFrame([(now - d * 86400, d) for d in (0, 1, 6, 8, 30)], "t double, v int")
    stores.append_session(m, str(tmp_path / "s"))
    assert {r["v"] for r in stores.sessions(spark, str(tmp_path / "s"), now).collect()} == {0, 1, 6}
    stores.save_counters(spark, {"hits": 3}, str(tmp_path / "k"), now)
    assert stores.load_counters(spark, str(tmp_path / "k"), now + 3600) == {"hits": 3.0} and stores.load_counters(spark, str(tmp_path / "k"), now + 90000) == {}


def test_tracking(spark, tmp_path):
    seen = []
    with tracking.Tracker("a", 0.01, [seen.append]) as t:
        time.sleep(0.02)
    assert t.slow and t.ok and seen == [t] and t.memory_mb >= 0
    with pytest.raises(ValueError), tracking.Tracker("b", callbacks=[seen.append]):
        raise ValueError
    assert not seen[1].ok
    df, o = tracking.observed(spark.range(10), "n", rows=F.count("*"), even=F.count_if(F.col("id") % 2 == 0))
    df.write.format("noop").mode("overwrite").save()
    assert o.get == {"rows": 10, "even": 5}
    spark.range(25).write.parquet(str(tmp_path / "in"))
    got = []
    q = tracking.on_each(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), lambda rows: got.append(len(rows)), 10, checkpointLocation=str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sum(got) == 25 and max(got) <= 10


def test_breaker_of_two_states():
    b = embedding.TwoState(2, 10)
    assert [b.step(t, ok) for t, ok in ((0, False), (1, False), (2, True), (11, False), (12, True), (21, True), (22, True))] == [True, True, False, True, False, True, True]
    b.forced = "open"
    assert not b.step(23, True)
    b.forced = "closed"
    assert b.step(24, False)


def test_vectors_fall_back_and_broken_makers_are_passed_over(spark):
    calls = spark.sparkContext.accumulator(0)

    def dead(texts):
        calls.add(1)
        raise RuntimeError("down")

    texts = spark.createDataFrame([(str(i), f"t {i}") for i in range(50)], "function_id string, text string").coalesce(1)
    rows = embedding.generate(texts, (("dead", dead), ("hashing", embedding.hashed_words)), batch=5, limit=3).collect()
    assert {r["model"] for r in rows} == {"hashing"} and len(rows) == 50 and calls.value <= 4
    assert len({r["cache_key"] for r in rows}) == 50
    cache = spark.createDataFrame([("0", [1.0])], "function_id string, vec array<double>")
    both = {r["function_id"]: r["vec"] for r in embedding.with_cache(texts, cache).collect()}
    assert both["0"] == [1.0] and len(both) == 50


def test_retries_follow_the_error():
    assert routing.policy("401 unauthorized", 0)[0] is False and routing.policy("odd", 0)[0] is True and routing.policy("odd", 1)[0] is False
    waits = [routing.policy("timed out", n)[1] for n in range(8)]
    assert all(0.9 * min(60, 2**n) <= w <= 1.1 * min(60, 2**n) for n, w in enumerate(waits)) and 54 <= routing.policy("rate limit", 0)[1] <= 60 * 1.1


def test_a_prompt_is_tried_again(spark):
    def flaky(prompts):
        import random

        if len(prompts) > 1 or random.random() < 0.3:
            raise ValueError("timed out")
        return ["ok"]

    r = spark.createDataFrame([(str(i), "p", 1) for i in range(20)], "function_id string, prompt string, tokens int")
    got = routing.ask(r, flaky, retries=30, pause=lambda s: None).collect()
    assert [x["reply"] for x in got] == ["ok"] * 20


def test_settings():
    assert config.problems(config.EngineConfig()) == []
    assert len(config.problems(config.EngineConfig(min_confidence=2, top_n=0, severity_overrides={"x": "odd"}))) == 3


def test_documentation_is_parsed_once(spark, files):
    p = matching.documented(parse.functions(files))
    for df in (rules.check(p), matching.direct(p)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython [") <= 1, plan


def test_a_failing_generator_leaves_a_fallback(spark, files):
    def broken(case):
        raise KeyError("no")

    p = matching.documented(parse.functions(files))
    e = engine.enhance(engine.analyse(p), p, registry={"parameter_missing": broken}).collect()
    assert {(r["kind"], r["is_ready"]) for r in e if r["issue_type"] == "parameter_missing"} == {("fallback", False)} and any("KeyError" in (r["error"] or "") for r in e)
    assert {r["kind"] for r in engine.enhance(engine.analyse(p), p, treatment=0.0).collect()} == {"rule"}


def test_every_issue_type_has_a_generator():
    assert set(config.ISSUE_SEVERITY) <= set(generators.GENERATORS)


def test_cut_at_a_syntax_error_keeps_what_parses():
    source = "".join(f"def f{i}(x):\n    return x\n\n" for i in range(40)) + "class A:\n    def g(self):\n        return (\n\ndef broken(:\n"
    tree, error = parse.tree_of(source)
    assert tree is not None and error and len(tree.body) == 40


def test_sections_keep_unknown_ones():
    text = "Do.\n\nArgs:\n    a: b\n\nHistory:\n    old\n\nReturns:\n    c"
    out = docstrings.put_section(docstrings.put_section(text, "Args:\n    z: y"), "Raises:\n    E: e")
    assert out == "Do.\n\nArgs:\n    z: y\n\nHistory:\n    old\n\nReturns:\n    c\n\nRaises:\n    E: e"


def test_many_queries_meet_the_corpus_in_blocks(spark, monkeypatch):
    from lexloom.operators import joins

    v = spark.createDataFrame([(i, [float(i % 7), float(i % 3), 1.0]) for i in range(60)], "id long, vec array<double>")
    q = v.select(F.col("id").alias("q_id"), F.col("vec").alias("q_vec"))
    few = sorted(map(tuple, joins.knn(q, v, 3).collect()))
    monkeypatch.setattr(joins, "FEW_QUERIES", 7)
    many = joins.knn(q, v, 3)
    assert sorted(map(tuple, many.collect())) == few and len(few) == 180
    assert "NestedLoop" not in many._jdf.queryExecution().executedPlan().toString()


def test_descriptions_of_parameters(spark):
    from lexloom.operators import retrieval

    wanted = spark.createDataFrame([(1, "file", "str"), (2, "count", "int")], "query_id long, name string, type string")
    corpus_ = spark.createDataFrame([(10, "path", "str", "Where it is.", 0.9), (11, "file", "str", "The file.", 0.5), (12, "zz", "dict", "Odd.", 1.0)], "example_id long, p_name string, p_type string, description string, similarity double")
    got = {(r["query_id"], r["example_id"]): round(r["score"], 6) for r in retrieval.parameter_patterns(wanted, corpus_).collect()}
    assert got == {(1, 10): round((0.6 * 0.8 + 0.4) * 0.9, 6), (1, 11): 0.5}


def test_what_is_asked_of_functions_stays_with_them(spark, sf_dir):
    """A file is parsed once and no side is joined: the bytes of part's keys made millions of rows look small enough to broadcast."""
    from lexloom.plans import registry

    plan = registry.QUERIES["generated_kinds"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan and plan.count("MapInPandas") == 1
