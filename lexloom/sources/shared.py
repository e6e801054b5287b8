"""Tables that several results read: written once to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_RUNS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The session names it in ``spark.checkpoint.dir``, or its context by setCheckpointDir().
    Where neither is set, a folder of this process serves a local session, as in tests; on a
    cluster that would lose rows, so it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        named = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = named.get() if named.isDefined() else None
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if "dir" not in _LOCAL:
            _LOCAL["dir"] = tempfile.mkdtemp(prefix="lexloom-")
            atexit.register(shutil.rmtree, _LOCAL["dir"], True)
        base = f"file://{_LOCAL['dir']}"
    return base.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """A folder of this driver within the shared one, which goes when its JVM ends."""
    base = shared_dir(spark)
    if base not in _RUNS:
        _RUNS[base] = f"{base}/lexloom/run-{uuid.uuid4().hex}"
        p = spark._jvm.org.apache.hadoop.fs.Path(_RUNS[base])
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(p)
        fs.deleteOnExit(p)
    return _RUNS[base]


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """Rows dealt to all cores by a hash of some columns, before work that costs far more than
    their bytes say: a table of a few MB is read by one task otherwise, however many rows it has."""
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return rows.repartition(n, *by)


def store(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Writes df and reads it back: it is computed once, its rows stay as they are, and losing
    an executor costs no recomputation of what came before. The path is ``stored_path`` of
    the result, for ``discard``; what is never discarded goes with the driver."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that no pending result reads."""
    for t in tables:
        spark = SparkSession.getActiveSession() or t.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(t.stored_path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
