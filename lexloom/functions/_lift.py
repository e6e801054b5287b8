"""Small helpers for building expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit_list(xs: Iterable) -> Column:
    return F.array(*map(F.lit, xs))


def lookup(key: Column, table: Mapping, default=None) -> Column:
    """A small fixed table as a chain of conditions."""
    out = F.lit(default)
    for k, v in reversed(list(table.items())):
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def jaccard(a: Column, b: Column, both_empty: float, one_empty: float) -> Column:
    """Of two arrays as sets."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), both_empty).when((F.size(a) == 0) | (F.size(b) == 0), one_empty).otherwise(F.size(F.array_intersect(a, b)) / union)


def bound(c: Column, use) -> Column:
    """use(c), where c is worked out once for a row however often ``use`` names it."""
    return F.transform(F.array(c), use)[0]


def clip(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def any_of(text: Column, phrases: Iterable[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(text, F.lit(p))
    return out


def arrow_function(returns: str, once: bool = False):
    """A pandas UDF that comes into being where it is used: workers import these modules
    too, and they have no session to read a type with.

    once: for dear functions. Filters on the result then stay above it; else the planner
    moves them below and evaluates the function both for the filter and for the result."""

    def wrap(f):
        def use(*cols: Column | str) -> Column:
            udf = F.pandas_udf(f, returns)
            return (udf.asNondeterministic() if once else udf)(*cols)

        use.__name__, use.__doc__ = f.__name__, f.__doc__
        use.plain = f
        return use

    return wrap
