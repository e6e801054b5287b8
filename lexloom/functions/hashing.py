"""Stable hashes: experiment buckets and cache keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._lift import col


def md5_mod(text, modulus: int = 100, plus: int = 0) -> Column:
    """The 128-bit MD5 value plus a seed, modulo a small number, by its 32-bit words."""
    h = F.md5(col(text).cast("binary"))
    out = F.lit(0).cast("long")
    for i in range(4):
        out = (out * ((1 << 32) % modulus) + F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long")) % modulus
    return (out + plus) % modulus


def ab_group(key, treatment: float = 0.5, seed: int | None = None) -> Column:
    """treatment or control, the same for a key each time; a seed of 0 is none."""
    return F.when(md5_mod(key, 100, seed or 0) < treatment * 100, "treatment").otherwise("control")


def uniform(key, salt: str = "") -> Column:
    """A number in [0, 1) that the key decides."""
    return md5_mod(F.concat(col(key).cast("string"), F.lit(salt)), 1_000_003) / 1_000_003


def embedding_key(text, model) -> Column:
    return F.sha2(F.concat_ws(":", col(model), col(text)), 256)


def signature_hash(signature) -> Column:
    return F.left(F.sha2(col(signature), 256), F.lit(16))


def analysis_key(signature, docstring, types: Column, model) -> Column:
    """Types are sorted: their order doesn't matter."""
    return F.md5(F.concat_ws("|", col(signature), F.coalesce(col(docstring), F.lit("")), F.array_join(F.array_sort(types), ","), col(model)).cast("binary"))
