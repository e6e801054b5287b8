"""Every query against the SQL that must give the same rows."""

import pytest

from lexloom.plans import registry

from .conftest import rows_of


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, sf_dir, duck):
    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    if name in registry.ORACLES:
        assert rows_of(got) == rows_of(duck.execute(registry.ORACLES[name]).df())
    else:
        assert len(got)


def test_rows_do_not_depend_on_partitions(spark, sf_dir):
    from pyspark.sql import functions as F

    from lexloom.operators import windows

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    top = lambda df: rows_of(windows.top_per_key(df, ["user_id"], [F.desc("value"), F.col("event_id")], 3).select("event_id").toPandas())
    assert top(e) == top(e.repartition(7)) == top(e.orderBy(F.rand(1)).coalesce(1))


def test_retrieval_plan_prunes_and_limits_before_the_shuffle(spark, sf_dir):
    from pyspark.sql import functions as F

    from lexloom.operators import windows

    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_extendedprice")
    plan = windows.top_per_key(x, ["l_orderkey"], [F.desc("l_extendedprice"), F.col("l_linenumber")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "l_tax" not in plan


def test_many_namesakes_in_the_own_place_hide_no_one(spark):
    from pyspark.sql import functions as F

    from lexloom.operators import joins

    rows = spark.createDataFrame([(1, "f", "a"), (2, "g", "a"), (3, "h", "a")], "id long, name string, place string")
    found = spark.createDataFrame([("f", "a")] * 100 + [("f", "b"), ("g", "b"), ("g", "b")] + [("h", "a")], "name string, place string")
    got = joins.unique_elsewhere(rows, found, "name", F.col("r.place") != F.col("c.place")).collect()
    assert [tuple(r) for r in got] == [(1, "b")]


@pytest.mark.parametrize("name", ["bare_names", "chosen_analyses", "decoded_files", "documentation_quality", "example_profiles", "fenced_texts", "four_factor_quality", "kept_descriptions", "line_changes", "memory_deltas"])
def test_rows_grow_with_a_table(name, spark, sf_dir):
    used = "lineitem" if name in ("four_factor_quality", "memory_deltas") else "part"
    assert registry.QUERIES[name](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/{used}.parquet").count()


def test_generators_run_once_for_a_finding(spark, sf_dir):
    plan = registry.QUERIES["enhanced_by_class"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("run(issue_type") == 1
