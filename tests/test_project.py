"""One parse for a file, one call for a prompt, and what a syntax error leaves."""

from __future__ import annotations

import ast
import random
import subprocess
import sys
import warnings

import pytest
from pyspark.sql import functions as F

from lexloom import config
from lexloom.operators import embedding, engine, parse, routing
from lexloom.sources import gallery, shared


@pytest.fixture(scope="module")
def files(spark):
    return gallery.source_files(spark.range(10, 30).select(F.col("id").alias("p_partkey")))


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_call_for_each_prompt(spark, files):
    calls = spark.sparkContext.accumulator(0)

    def model(prompts):
        calls.add(len(prompts))
        return ['{"issues": [{"type": "description_outdated", "description": "Old.", "suggestion": "Update the text.", "confidence": 0.9}], "confidence": 0.9}'] * len(prompts)

    functions = engine.opened(files).functions
    asked = functions.where("raw_doc is not null").count()
    found = engine.analyse(functions, config.EngineConfig(analysis_types=("behavior",)), model)
    assert found.where("origin = 'model'").count() == asked
    found.collect()
    assert calls.value == asked


def test_one_parse_for_each_file(spark, files):
    parses = spark.sparkContext.accumulator(0)
    counted = files.select("path", F.udf(lambda c: (parses.add(1), c)[1])("content").alias("content"))
    project = engine.opened(counted)
    assert parses.value == 20
    matched = engine.match_project(project)
    enhanced = engine.enhanced_issues(project)
    for df in (matched, enhanced, engine.match_statistics(project.functions, matched)):
        assert "MapInPandas" not in plan_of(df)
        assert df.count()
    assert parses.value == 20
    assert "source_code" not in plan_of(matched)
    plain = parse.functions(files)
    assert project.functions.select(plain.columns).exceptAll(plain).count() == 0 == plain.exceptAll(project.functions.select(plain.columns)).count()
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(project.imports) == rows(parse.imports(files))
    assert rows(project.modules) == rows(parse.modules(files))
    project.discard()


def test_model_and_rule_pair_by_what_they_are_about(spark):
    rules = spark.createDataFrame([("f", "m.py", 1, 0, "r", "parameter_missing", "critical", "'alpha' is not documented", "Add it", 0.85, "alpha", "rules"), ("f", "m.py", 1, 1, "r", "parameter_missing", "critical", "'beta' is not documented", "Add it", 0.85, "beta", "rules")], "function_id string, file_path string, line_number int, ordinal int, rule string, issue_type string, severity string, description string, suggestion string, confidence double, subject string, origin string")
    said = spark.createDataFrame([("f", "parameter_missing", "The parameter beta is missing.", "Describe beta.", 0.9, 3), ("f", "parameter_missing", "Something else.", None, 0.95, None), ("g", "missing_raises", "No word on errors.", "Add them.", 0.9, 7)], "function_id string, issue_type string, description string, suggestion string, confidence double, line_number int")
    got = {(r["function_id"], r["subject"], r["origin"]): r for r in engine.with_model(rules, said).collect()}
    assert set(got) == {("f", "alpha", "rules"), ("f", "beta", "model"), ("f", None, "model"), ("g", None, "model")}
    assert got["f", "beta", "model"]["description"] == "The parameter beta is missing." and got["g", None, "model"]["line_number"] == 7


@pytest.mark.parametrize("made", [lambda n: n - 1, lambda n: n + 1, lambda n: 0 if n > 1 else 1])
def test_reply_lists_of_another_length(spark, made):
    requests = spark.createDataFrame([(str(i), "p", 1) for i in range(11)], "function_id string, prompt string, tokens int").coalesce(1)
    got = routing.ask(requests, lambda p: ["ok"] * made(len(p)), batch=4, retries=1, pause=lambda s: None).collect()
    assert len(got) == 11 and all((r["reply"] is None) != (r["error"] is None) for r in got)
    texts = requests.select("function_id", F.col("prompt").alias("text"))
    vectors = embedding.generate(texts, (("odd", lambda t: [[1.0]] * made(len(t))), ("hashing", embedding.hashed_words)), batch=4).collect()
    assert len(vectors) == 11 and all(r["vec"] is not None for r in vectors)


def test_only_findings_that_tell_what_to_do(spark):
    reply = '{"issues": [{"type": "description_outdated", "description": "a", "suggestion": "Add a Returns section that tells what the result holds, and when it is empty.", "confidence": 0.9}, {"type": "description_outdated", "description": "b", "suggestion": "fix", "confidence": 0.9}, {"type": "description_outdated", "description": "c", "suggestion": "Add a Raises section that tells when a KeyError comes, and from where.", "confidence": 0.2}]}'
    replies = spark.createDataFrame([("f", reply, None)], "function_id string, reply string, error string")
    assert routing.answers(replies).count() == 3
    assert [r["description"] for r in routing.answers(replies, 0.5).collect()] == ["a"]


def test_prompts_ask_what_their_kinds_ask(spark):
    pairs = spark.createDataFrame([("f", "def f(): pass", "Doc.", ["types", "odd"]), ("g", "def g(): pass", None, ["examples"])], "function_id string, source_code string, raw_doc string, kinds array<string>")
    related = spark.createDataFrame([("f", ["g", "h"])], "function_id string, related array<string>")
    got = {r["function_id"]: r["prompt"] for r in routing.prompts(pairs, F.col("kinds"), related).collect()}
    assert routing.TEMPLATES["types"] in got["f"] and routing.TEMPLATES["behavior"] in got["f"] and "RELATED: g, h" in got["f"]
    assert routing.TEMPLATES["examples"] in got["g"] and "RELATED" not in got["g"]


def test_related_functions_of_a_large_file(spark):
    rows = [(f"f{i}", "a.py", i * i % 97, f"n{i}") for i in range(60)] + [("only", "b.py", 1, "only")]
    got = {r["function_id"]: r["related"] for r in routing.with_related(spark.createDataFrame(rows, "function_id string, file_path string, line_number int, name string")).collect()}
    for i, _, line, _ in rows[:60]:
        others = sorted((abs(l - line), l, n) for j, _, l, n in rows[:60] if j != i)
        assert sorted(abs(dict((r[3], r[2]) for r in rows)[n] - line) for n in got[i]) == [d for d, _, _ in others[:3]]
    assert got["only"] == []


@pytest.mark.parametrize("k", [1, 3, 8, 12, 20, 25, 40, 5000])
def test_functions_before_an_error_survive(k):
    source = "".join(f'def f{i}(x):\n    """Doc {i}."""\n    return x + {i}\n\n\n' for i in range(12)) + "D = {\n" + "".join(f"'a{j}': {j},\n" for j in range(k)) + "'b' 3,\n}\ndef g(): pass\n"
    found = parse.functions_of("m.py", source)
    assert [r[4] for r in found] == [f"f{i}" for i in range(12)] and all(r[-1] for r in found)


def longest(source: str) -> str | None:
    lines = source.split("\n")
    for cut in reversed([i for i, x in enumerate(lines) if i and x[:1] not in ("", " ", "\t", "#", ")", "]", "}")]):
        try:
            tree = ast.parse("\n".join(lines[:cut]))
            return ast.dump(tree) if tree.body else None
        except (SyntaxError, ValueError):
            continue
    return None


def test_the_longest_prefix_is_found():
    rng = random.Random(3)
    pieces = ["def f(x):", "    return x", "x = (", "1,", "2)", ")", "'''", "text", "@deco", "if a:", "    pass", "else:", "try:", "    y", "except E:", "class A:", "    def m(self): pass", "y = [1,", "3]", "bad bad", "# c", "", "z = 'a", "lambda", "w = 1", "x = \\", "q = f'''{", "}'''", "\x00"]
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for _ in range(3000):
            source = "\n".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14)))
            tree, error = parse.tree_of(source)
            if error:
                assert (ast.dump(tree) if tree else None) == longest(source)


def test_every_file_has_a_row(spark):
    project = parse.Project(spark.createDataFrame([("a.py", "bad bad"), ("b.py", "x = 1"), ("c.py", None), ("d.py", "def f(): pass\nbad bad")], "path string, content string"))
    got = {r["path"]: (r["functions"], r["parse_error"] is not None) for r in project.files.collect()}
    assert got == {"a.py": (0, True), "b.py": (0, False), "c.py": (0, False), "d.py": (1, True)}


@pytest.mark.parametrize("module", ["gallery", "cases", "feeds", "code", "registry"])
def test_plans_can_be_imported_in_any_order(module):
    subprocess.run([sys.executable, "-c", f"import lexloom.plans.{module}"], check=True)


def test_stored_tables_go_with_the_driver(spark):
    path = shared.store(spark.range(3), "here").stored_path
    assert "/lexloom/run-" in path and spark.read.parquet(path).count() == 3
