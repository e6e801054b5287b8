"""Keyed tables, corpora, metric files and edits."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from . import shared

EXAMPLES = """function_name string, module_path string, function_signature string, docstring_format string, docstring_content string, has_params boolean, has_returns boolean,
 has_examples boolean, complexity_score int, quality_score int, source string, timestamp double, category string, issue_types array<string>, original_issue string, improvement_score double"""


def read_corpus(spark: SparkSession, path: str, source: str | None = None, major: int = 1, now: float | None = None) -> DataFrame:
    """A JSON envelope {version, examples} -> its examples. Files of another major version
    give none; a given source overrides the rows'; missing times are ``now`` and missing
    issue types the original issue."""
    x = spark.read.schema(f"version string, last_updated string, total_accepted long, examples array<struct<{_fields(EXAMPLES)}>>").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    ok = F.coalesce(F.split("version", "[.]")[0].cast("int"), F.lit(major)) == major
    rows = x.where(ok).select(F.inline("examples"))
    if source:
        rows = rows.withColumn("source", F.lit(source))
    when = F.lit(now) if now is not None else F.unix_timestamp().cast("double")
    return rows.withColumn("timestamp", F.coalesce("timestamp", when)).withColumn("issue_types", F.coalesce("issue_types", F.when(F.col("original_issue").isNotNull(), F.array("original_issue"))))


def _fields(ddl: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (f.strip().split(" ", 1) for f in ddl.split(",")))


def write_corpus(rows: DataFrame, folder: str, version: int, keep: int = 5) -> str:
    """A version of the corpus in a folder of its own, written whole or not at all by the
    commit protocol; the ``keep`` newest versions stay. Null fields are left out."""
    spark = rows.sparkSession
    path = f"{folder}/v{version:08d}"
    rows.write.mode("overwrite").option("ignoreNullFields", True).json(path)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    old = sorted(str(s.getPath()) for s in fs.listStatus(fs_path) if s.getPath().getName().startswith("v"))
    for p in old[:-keep]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(p), True)
    return path


def newest(spark: SparkSession, folder: str) -> DataFrame:
    """The newest version that committed."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    done = sorted(str(s.getPath()) for s in fs.listStatus(fs_path) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
    return spark.read.schema(EXAMPLES).json(done[-1])


def newest_good(spark: SparkSession, folder: str) -> DataFrame | None:
    """The newest committed version whose files can all be read; None if there is none."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    done = sorted((str(s.getPath()) for s in fs.listStatus(fs_path) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))), reverse=True)
    for path in done:
        rows = spark.read.schema(EXAMPLES).option("mode", "FAILFAST").json(path)
        try:
            rows.write.format("noop").mode("overwrite").save()
        except Exception:  # noqa: BLE001  a corrupt version: the one before it
            continue
        return rows
    return None


class KeyedTable:
    """Rows by key in versions of a Parquet table: vectors, cached answers, metrics.

    Each change writes a new version whole and the two newest stay, so readers of the one
    before are not disturbed. Compression is Parquet's."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: Sequence[str]):
        self.spark, self.folder, self.schema, self.key = spark, folder.rstrip("/"), schema, list(key)

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[str]:
        path, fs = self._fs()
        if not fs.exists(path):
            return []
        found = [s.getPath() for s in fs.listStatus(path)]
        return sorted(str(p) for p in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def read(self) -> DataFrame:
        v = self._versions()
        return self.spark.read.schema(self.schema).parquet(v[-1]) if v else self.spark.createDataFrame([], self.schema)

    def _replace(self, rows: DataFrame) -> None:
        v = self._versions()
        n = int(v[-1].rsplit("/v", 1)[1]) + 1 if v else 1
        rows.select(*self.spark.createDataFrame([], self.schema).columns).write.parquet(f"{self.folder}/v{n:08d}")
        _, fs = self._fs()
        for old in v[:-1]:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(old), True)

    def put(self, rows: DataFrame) -> None:
        """Rows replace those of their key."""
        self._replace(upsert(self.read(), rows, self.key))

    def delete(self, keys: DataFrame) -> None:
        self._replace(self.read().join(keys.select(*self.key).distinct(), self.key, "left_anti"))

    def get(self, **key) -> list:
        """The rows of one key."""
        out = self.read()
        for k, v in key.items():
            out = out.where(F.col(k) == v)
        return out.collect()

    def touch(self, reads: DataFrame) -> None:
        """Counts reads (key, t) in hit_count and accessed_at."""
        from ..operators import corpus

        self._replace(corpus.hit_counts(self.read(), reads, self.key[0]))

    def expire(self, time: str, as_of, days: float) -> None:
        self._replace(recent(self.read(), time, as_of, days))


class BucketedTable:
    """Rows by key in a Parquet table that is cut by the hash of the key into buckets, a folder
    each. A change reads and rewrites the buckets of its own keys, not the table: what it writes is
    worked out and stored elsewhere first, then put in their place."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: Sequence[str], buckets: int = 64):
        self.spark, self.folder, self.key, self.buckets = spark, folder.rstrip("/"), list(key), buckets
        self.schema = spark.createDataFrame([], schema).schema

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int").alias("_bucket")

    def _path(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _all(self) -> DataFrame:
        path, fs = self._path()
        columns = StructType([*self.schema.fields, StructField("_bucket", IntegerType())])
        return self.spark.read.schema(columns).parquet(self.folder) if fs.exists(path) else self.spark.createDataFrame([], columns)

    def read(self) -> DataFrame:
        return self._all().drop("_bucket")

    def get(self, **key) -> list:
        """The rows of one key, from its bucket."""
        values = [F.lit(key[k]).cast(self.schema[k].dataType) for k in self.key]
        b = self.spark.range(1).select(F.pmod(F.xxhash64(*values), F.lit(self.buckets)).cast("int")).first()[0]
        out = self._all().where(F.col("_bucket") == b)
        for k in self.key:
            out = out.where(F.col(k) == key[k])
        return out.drop("_bucket").collect()

    def _change(self, keys: DataFrame, made) -> list[int]:
        """made: the rows of the buckets that keys are in -> those rows after the change."""
        met = sorted(r[0] for r in keys.select(self._bucket()).distinct().collect())
        after = shared.store(made(self._all().where(F.col("_bucket").isin(met)).drop("_bucket")).select(*self.schema.names, self._bucket()), "buckets")
        left = {r[0] for r in after.select("_bucket").distinct().collect()}
        after.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(self.folder)
        for b in set(met) - left:
            path, fs = self._path(f"_bucket={b}")
            fs.delete(path, True)
        shared.discard(after)
        return met

    def put(self, rows: DataFrame) -> list[int]:
        """Rows replace those of their key. Returns the buckets that were rewritten."""
        return self._change(rows, lambda old: upsert(old, rows, self.key))

    def delete(self, keys: DataFrame) -> list[int]:
        return self._change(keys, lambda old: old.join(keys.select(*self.key).distinct(), self.key, "left_anti"))

    def touch(self, reads: DataFrame) -> list[int]:
        """Counts reads (key, t) in hit_count and accessed_at."""
        from ..operators import corpus

        return self._change(reads, lambda old: corpus.hit_counts(old, reads, self.key[0]))


def append_session(metrics: DataFrame, folder: str) -> None:
    """Metrics of a session (with a time ``t`` in seconds), added to those of earlier ones by day."""
    metrics.withColumn("day", F.to_date(F.timestamp_seconds("t"))).write.mode("append").partitionBy("day").parquet(folder)


def sessions(spark: SparkSession, folder: str, as_of: float, days: float = 7) -> DataFrame:
    """Metrics of the last days; only their partitions are read."""
    first = F.to_date(F.timestamp_seconds(F.lit(as_of - days * 86400)))
    return recent(spark.read.parquet(folder).where(F.col("day") >= first), "t", F.lit(as_of), days).drop("day")


def save_counters(spark: SparkSession, counters: dict[str, float], path: str, at: float) -> None:
    spark.createDataFrame([(at, {k: float(v) for k, v in counters.items()})], "t double, counters map<string,double>").coalesce(1).write.mode("overwrite").json(path)


def load_counters(spark: SparkSession, path: str, as_of: float, hours: float = 24) -> dict[str, float]:
    """The saved counters, or none if they are older."""
    row = spark.read.schema("t double, counters map<string,double>").json(path).first()
    return dict(row["counters"]) if row is not None and as_of - row["t"] <= hours * 3600 else {}


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """New rows replace old ones of their key."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new)


def invalidate(cache: DataFrame, changed: DataFrame, on: str = "file_path") -> DataFrame:
    """Without the entries of changed files."""
    return cache.join(changed.select(on).distinct(), on, "left_anti")


def recent(rows: DataFrame, time: str, as_of, days: float) -> DataFrame:
    return rows.where(F.col(time) >= as_of - F.lit(days * 86400.0))


def fill_misses(wanted: DataFrame, cache: DataFrame, key: str, make) -> DataFrame:
    """Cached rows of the wanted keys, and made ones (make: DataFrame -> same columns) for the rest."""
    return cache.join(wanted.select(key).distinct(), key, "left_semi").unionByName(make(wanted.join(cache.select(key), key, "left_anti")))


def apply_edit(path: str, old: str, new: str, backup: bool = True) -> None:
    """Replaces the first occurrence in a local file; an error if there is none."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if old not in text:
        raise ValueError(f"the text to replace is not in {path}")
    if backup:
        shutil.copy2(path, f"{path}.bak")
    with tempfile.NamedTemporaryFile("w", encoding="utf-8", dir=os.path.dirname(path) or ".", delete=False) as f:
        f.write(text.replace(old, new, 1))
    os.replace(f.name, path)


def read_yaml(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def write_yaml(settings: dict, path: str) -> None:
    import yaml

    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump(settings, f, sort_keys=True)


def markdown_report(rates: list[dict], title: str = "Improvement report") -> str:
    """Of the few rows of an acceptance aggregate."""
    lines = [f"# {title}", "", "| group | shown | accepted | rate |", "|-|-|-|-|"]
    return "\n".join(lines + [f"| {r['ab_group']} | {r['shown']} | {r['accepted']} | {r['rate']:.1%} |" for r in rates])


def append_alerts(alerts: DataFrame, path: str) -> None:
    alerts.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)


def to_json_rows(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*")).alias("json"))


def dumps(x) -> str:
    return json.dumps(x, sort_keys=True)
