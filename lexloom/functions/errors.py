"""What an error text calls for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._lift import any_of, col

# Fixed values, in order: words in the text, kind, action, seconds to wait.
KINDS = (
    (("rate limit", "too many requests", "429"), "rate_limit", "wait", 60),
    (("timeout", "timed out"), "timeout", "retry", 5),
    (("unauthorized", "api key", "401", "403"), "auth", "stop", 0),
    (("connection", "network", "dns"), "network", "retry", 10),
    (("memory", "oom"), "memory", "shrink", 0),
    (("not found", "404"), "not_found", "fallback", 0),
)


def analyse(text) -> Column:
    """struct(kind, action, wait); unknown texts are retried once."""
    t = F.lower(F.coalesce(col(text), F.lit("")))
    out = F.struct(F.lit("unknown").alias("kind"), F.lit("retry_once").alias("action"), F.lit(1).alias("wait"))
    for words, kind, action, wait in reversed(KINDS):
        out = F.when(any_of(t, words), F.struct(F.lit(kind).alias("kind"), F.lit(action).alias("action"), F.lit(wait).alias("wait"))).otherwise(out)
    return out
