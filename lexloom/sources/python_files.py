"""Python source files as rows (path, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that hold no source of a project's own.
EXCLUDED = (".venv", "venv", "env", "__pycache__", ".git", "build", "dist")


def wanted(path: Column, excluded: tuple[str, ...] = EXCLUDED, hidden: bool = False, globs: tuple[str, ...] = ()) -> Column:
    """By path parts: none is excluded, begins with a dot, or fits a glob."""
    parts = F.split(F.regexp_replace(path, "^[a-z]+:/*", ""), "/")
    ok = ~F.arrays_overlap(parts, F.array(*map(F.lit, excluded)))
    if not hidden:
        ok = ok & ~F.exists(parts, lambda p: p.startswith(".") & (F.length(p) > 1) & (p != ".."))
    for g in globs:
        pattern = "^" + "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() else c for c in g.removesuffix("/*").rstrip("/")) + "$"
        ok = ok & ~_some_like(parts, pattern)
    return ok


def _some_like(parts: Column, pattern: str) -> Column:
    return F.exists(parts, lambda p: p.rlike(pattern))


def read(spark: SparkSession, folder: str, **options) -> DataFrame:
    """All *.py files below a folder, decoded as UTF-8 or else Latin-1."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.py").load(folder)
    return files.where(wanted(F.col("path"), **options)).select("path", decoded("content").alias("content"))


def stream(spark: SparkSession, folder: str, **options) -> DataFrame:
    """New and changed files as they appear."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.py").load(folder)
    return files.where(wanted(F.col("path"), **options)).select("path", decoded("content").alias("content"))


def decoded(content: str) -> Column:
    return F.coalesce(F.try_validate_utf8(F.col(content).cast("binary")).cast("string") if hasattr(F, "try_validate_utf8") else F.decode(content, "UTF-8"), F.decode(content, "ISO-8859-1"))
