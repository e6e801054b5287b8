from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lexloom.operators import parse
from lexloom.sources import gallery, python_files, stores, synthetic


def test_scan_skips_folders_and_decodes(spark, tmp_path):
    for path, data in (("a/x.py", "s = 'é'".encode()), ("a/y.py", "s = 'é'".encode("latin-1")), ("venv/z.py", b"x"), ("a/.hidden/w.py", b"x"), ("a/t.txt", b"x"), ("a/skip_me/v.py", b"x")):
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    rows = python_files.read(spark, str(tmp_path), globs=("skip_*/*",)).collect()
    assert {(r["path"].rsplit("/", 1)[1], r["content"]) for r in rows} == {("x.py", "s = 'é'"), ("y.py", "s = 'é'")}


def test_scan_to_functions_as_a_stream(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/m.py").write_text("def f():\n    pass\n")
    q = python_files.stream(spark, str(tmp_path / "src")).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert parse.functions(spark.read.parquet(str(tmp_path / "out"))).count() == 1


def test_corpus_versions(spark, tmp_path):
    example = {"function_name": "f", "quality_score": 4, "original_issue": "missing_raises"}
    for v in ("1.2", "2.0"):
        (tmp_path / f"c{v}.json").write_text(json.dumps({"version": v, "examples": [example]}))
    r = stores.read_corpus(spark, str(tmp_path / "c1.2.json"), source="curated", now=5.0).first()
    assert (r["source"], r["timestamp"], r["issue_types"]) == ("curated", 5.0, ["missing_raises"])
    assert stores.read_corpus(spark, str(tmp_path / "c2.0.json")).count() == 0


def test_corpus_is_written_whole_and_old_versions_go(spark, tmp_path):
    rows = spark.createDataFrame([("f",)], "function_name string")
    for v in range(7):
        stores.write_corpus(rows, str(tmp_path), v, keep=5)
    assert sorted(p.name for p in tmp_path.iterdir()) == [f"v{v:08d}" for v in range(2, 7)]
    (tmp_path / "v00000099").mkdir()  # one that never committed
    assert stores.newest(spark, str(tmp_path)).count() == 1


def test_keyed_tables(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert {tuple(r) for r in stores.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert {tuple(r) for r in stores.invalidate(old, new, "k").collect()} == {(1, "a")}
    made = stores.fill_misses(new.select("k"), old, "k", lambda m: m.select("k", F.lit("new").alias("v")))
    assert {tuple(r) for r in made.collect()} == {(2, "b"), (3, "new")}


def test_edits(tmp_path):
    p = tmp_path / "x.py"
    p.write_text("a a")
    stores.apply_edit(str(p), "a", "b")
    assert p.read_text() == "b a" and (tmp_path / "x.py.bak").read_text() == "a a"
    with pytest.raises(ValueError):
        stores.apply_edit(str(p), "zzz", "b")


def test_yaml(tmp_path):
    stores.write_yaml({"a": {"b": 1}}, str(tmp_path / "c.yml"))
    assert stores.read_yaml(str(tmp_path / "c.yml")) == {"a": {"b": 1}}


def test_a_change_rewrites_the_buckets_of_its_keys_only(spark, tmp_path):
    import os

    from lexloom.sources import stores

    t = stores.BucketedTable(spark, f"file://{tmp_path}/b", "k string, v int, hit_count long, accessed_at double", ["k"], 16)
    rows = lambda *x: spark.createDataFrame([(k, v, 0, 1.0) for k, v in x], t.schema)
    assert t.read().count() == 0
    t.put(rows(*((f"k{i}", i) for i in range(200))))
    files = lambda: {str(p): os.stat(p).st_ino for p in (tmp_path / "b").rglob("part-*.parquet")}
    before = files()
    met = t.put(rows(("k3", 33), ("new", 1)))
    after = files()
    assert 1 <= len(met) <= 2
    assert {p.split("/")[-2] for p in set(after) - set(before)} == {f"_bucket={b}" for b in met} == {p.split("/")[-2] for p in set(before) - set(after)} | ({p.split("/")[-2] for p in set(after) - set(before)} - {p.split("/")[-2] for p in before})
    assert {r["k"]: r["v"] for r in t.read().collect()} == {f"k{i}": i for i in range(200)} | {"k3": 33, "new": 1}
    t.touch(spark.createDataFrame([("k3", 9.0), ("k3", 8.0)], "k string, t double"))
    assert t.get(k="k3")[0].asDict() == {"k": "k3", "v": 33, "hit_count": 2, "accessed_at": 9.0} and t.get(k="zz") == []
    gone = t.delete(t.read())
    assert t.read().count() == 0 and len(gone) == 16 and not files()


def test_patterns_of_names_are_checked(spark):
    from pyspark.sql import functions as F

    from lexloom import config
    from lexloom.functions import names

    s = config.EngineConfig().layered({"name_patterns": {"a": "[a-z]+", "b": "x.*"}})
    assert config.problems(s) == [] and len(config.problems(config.EngineConfig(name_patterns={"a": "("}))) == 1
    df = spark.createDataFrame([("abc",), ("xyz",), ("X1",), (None,)], "n string").select("n", names.unlike("n", s.name_patterns).alias("u"), names.unlike("n", {}).alias("none"))
    assert {r["n"]: r["u"] for r in df.collect()} == {"abc": ["b"], "xyz": [], "X1": ["a", "b"], None: ["a", "b"]} and all(r["none"] == [] for r in df.collect())


@pytest.mark.parametrize("made", [synthetic, gallery])
def test_files_of_a_small_table_go_to_all_cores(spark, made):
    parts = spark.range(400).selectExpr("id as p_partkey", "'hot bolt' as p_name", "'Brand#1' as p_brand").coalesce(1)
    held = made.source_files(parts).groupBy(F.spark_partition_id()).count().collect()
    assert len(held) >= 4 and max(r["count"] for r in held) < 200
